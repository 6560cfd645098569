"""Packing of documents into training sequences of several permitted lengths.

Variable-capacity best fit: pieces go, longest first, to the open bin that they leave the
least room in; where none has room a bin is opened.  A sequence of ``c`` tokens costs
``c + c * c / QUADRATIC + BIN_COST``, for its tokens, their attention to each other and the
sequence itself, so neither short nor long ones are always best.  The capacity opened is
the one of least cost for each token that will fill it, as far as the waiting pieces that
fit its room go round.  When all are placed, each bin shrinks to the smallest capacity that
holds its contents.

Documents are encoded by a public byte-level BPE and end with a mark.  One of more tokens
than the largest capacity is cut into pieces of that capacity and a last piece.  Pieces are
dealt by a hash of id, text, copy and piece into shards of about ``SHARD_BYTES`` of text,
with their tokens, and packed and put together there: an exact global order would need one
task, and a shard leaves at most a few bins part-filled.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.byte_pairs import encoder, load_ranks
from mensura.llm.common import body, cut

CAPACITIES = (512, 1024, 2048, 4096, 8192)
QUADRATIC = 8192  # tokens of a sequence whose attention costs as much as the tokens themselves
BIN_COST = 128  # tokens' worth of cost that any sequence has
SHARD_BYTES = 8 << 20
END_MARK = "<|endoftext|>"


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / QUADRATIC + BIN_COST


def best_fit(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int, int]]:
    """Bin number, offset and final capacity of each of ``sizes``, which must not increase."""
    falling = [-s for s in sizes]
    rest = np.concatenate((np.cumsum(sizes[::-1], dtype=np.int64)[::-1], [0])).tolist()  # of the sizes from each place on
    roomy: dict[int, list[int]] = {}  # bins by room left
    rooms = 0  # bit r is set if a bin has room r
    used: list[int] = []
    placed: list[tuple[int, int]] = []

    def cost_a_token(capacity: int, size: int, at: int) -> float:
        room = capacity - size
        waiting = rest[max(at + 1, bisect_left(falling, -room))]  # of pieces that fit the room
        return cost(capacity) / max(size + min(room, waiting), 1)

    for at, size in enumerate(sizes):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            place = roomy[room].pop()
            if not roomy[room]:
                rooms ^= 1 << room
        else:
            place = len(used)
            room = min((c for c in capacities if c >= size), key=lambda c: (cost_a_token(c, size, at), c))
            used.append(0)
        placed.append((place, used[place]))
        used[place] += size
        room -= size
        if not roomy.setdefault(room, []):
            rooms |= 1 << room
        roomy[room].append(place)
    final = [min(c for c in capacities if c >= u) for u in used]
    return [(place, offset, final[place]) for place, offset in placed]


def pack(
    df: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: tuple[int, ...] = CAPACITIES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Training sequences of the permitted ``capacities`` that hold every row of ``df`` whole.

    Returns a row for each sequence: ``bin_id``, ``bin_capacity``, ``bin_tokens``,
    ``token_ids``, and ``pieces``, what stands in it in order: ``doc_id``, ``piece`` and
    ``piece_start`` (where in the document it is), ``tokens`` and ``bin_offset``.

    A null text counts as empty; an empty text is its end mark; a text of any length is in
    pieces.  Rows with equal or null ids are packed each on its own, and rows that repeat
    id and text are numbered copies.  Pieces of equal length go by id (null last), text
    hash, copy and piece, so the result is the same however the rows are partitioned.  An
    empty table gives an empty result.  Other columns are ignored.  ``ranks_path`` is read
    by the driver.
    """
    capacities = tuple(sorted(set(capacities)))
    top = capacities[-1]
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path, (END_MARK,)))  # bounded by the file
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"), F.xxhash64(body(text_col)).alias("hash"))
    known = cut(docs.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")))
    shards = max(1, -(-(known.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes))
    repeats = known.where("n > 1").withColumnsRenamed({"doc_id": "id", "hash": "code"})
    numbered = docs.withColumn("copy", F.lit(0))
    if not repeats.isEmpty():
        same = docs["doc_id"].eqNullSafe(repeats["id"]) & (docs["hash"] == repeats["code"])
        once = docs.join(repeats.select("id", "code"), same, "left_semi").dropDuplicates(["doc_id", "hash"])
        again = once.join(repeats, once["doc_id"].eqNullSafe(repeats["id"]) & (once["hash"] == repeats["code"]))
        again = again.select("doc_id", "text", "hash", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))
        numbered = docs.join(repeats, same, "left_anti").withColumn("copy", F.lit(0)).unionByName(again)

    def encoded(batches):
        tokenizer = encoder(shared.value)
        end = tokenizer.encode(END_MARK)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.concatenate((tokenizer.encode_plain(batch.column(1)[k].as_py()), end))
                starts = np.arange(0, len(ids), top)
                bounds = pa.array(np.append(starts, len(ids)), pa.int32())
                same = [pa.repeat(batch.column(c)[k], len(starts)) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(starts)), pa.int32()), pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32()))], ["doc_id", "hash", "copy", "piece", "ids"])

    pieces = numbered.select("doc_id", "text", "hash", "copy").mapInArrow(encoded, "doc_id long, hash long, copy int, piece int, ids array<int>")

    def pack_shard(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.append_column("size", pa.array(np.diff(_bounds(rows["ids"])), pa.int64()))
        rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending"), ("hash", "ascending"), ("copy", "ascending"), ("piece", "ascending")]).combine_chunks()
        sizes = rows["size"].to_pylist()
        bins: dict[int, list[tuple[int, int]]] = {}
        capacity = {}
        for k, (place, offset, final) in enumerate(best_fit(sizes, capacities)):
            bins.setdefault(place, []).append((k, offset))
            capacity[place] = final
        ids, docs, numbers = rows["ids"].chunk(0), rows["doc_id"].to_pylist(), rows["piece"].to_pylist()
        order = pa.array([k for held in bins.values() for k, _ in held], pa.int64())
        totals = [sum(sizes[k] for k, _ in held) for held in bins.values()]
        return pa.table(
            [
                [f"{key[0]}-{place}" for place in bins],
                [capacity[place] for place in bins],
                totals,
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *totals]), pa.int32()), ids.take(order).flatten()),
                [[{"doc_id": docs[k], "piece": numbers[k], "piece_start": numbers[k] * top, "tokens": sizes[k], "bin_offset": offset} for k, offset in held] for held in bins.values()],
            ],
            schema=pa.schema(
                [("bin_id", pa.string()), ("bin_capacity", pa.int64()), ("bin_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())),
                 ("pieces", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int64()), ("piece_start", pa.int64()), ("tokens", pa.int64()), ("bin_offset", pa.int64())])))]
            ),
        )

    return (
        pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "hash", "copy", "piece"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(
            pack_shard,
            "bin_id string, bin_capacity long, bin_tokens long, token_ids array<int>, pieces array<struct<doc_id:long,piece:long,piece_start:long,tokens:long,bin_offset:long>>",
        )
    )


def _bounds(lists: pa.ChunkedArray) -> np.ndarray:
    return np.cumsum(np.concatenate([[0], *(np.diff(c.offsets.to_numpy()) for c in lists.chunks)]))
