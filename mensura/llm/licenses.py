r"""Licence scans by an exact set-similarity join with licence templates.

Words are what is left between ASCII characters other than letters and digits, in lower
case.  A text is read in blocks of ``BLOCK_WORDS`` words, each starting half a block after
the one before, and a template in blocks of at most half that, so that a template block
in a text lies whole in one text block.

The join finds every pair of blocks in which at least ``threshold`` of the template's
distinct words are in the text block.  Template words are put in order of the number of
text blocks that hold them, counted over all texts, rarest first.  A pair that qualifies
shares one of a template's first words, its prefix; a text block must have enough words
(length filter), and from the first shared place enough must be left on either side
(position filter).  What passes is counted out.

Templates are whole licences and notices of nine words and more: a shorter one would match
words that stand apart in any order.  They are the bounded side: their words, places and
prefixes are broadcast.  Texts are divided into words once; the blocks that hold fewer
template words than any template needs go at once, the rest wait for the counts.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import body, cut
from mensura.llm.license_texts import BASE_PHRASES, TEMPLATES

BLOCK_WORDS = 64
THRESHOLD = 0.8

_SEPARATED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words of a text in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_SEPARATED).split()


def phrase_starts(words: list[bytes], phrase: bytes, line: bytes) -> list[int]:
    """Numbers of the words at which ``phrase`` starts; ``line`` is the words between spaces."""
    found, at, word, seen = [], line.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += line.count(b" ", seen, at)
        seen = at
        found.append(word)
        at = line.find(b" " + phrase + b" ", at + 1)
    return found


def template_blocks(
    templates: list[tuple[str, str]] = TEMPLATES, block_words: int = BLOCK_WORDS, threshold: float = THRESHOLD
) -> list[tuple[str, list[bytes]]]:
    """Label and distinct words of each block of the templates.

    Of templates of several blocks, those that another label's template would match as
    well are left out.
    """
    split = [(label, words_of(text)) for label, text in templates]
    half, blocks = block_words // 2, []
    seen = [(label, set(words[at : at + block_words])) for label, words in split for at in range(0, len(words), half)]
    for label, words in split:
        count = -(-len(words) // half)
        size = -(-len(words) // count)
        for at in range(0, len(words), size):
            block = set(words[at : at + size])
            if count == 1 or not any(other != label and len(block & text) >= threshold * len(block) for other, text in seen):
                blocks.append((label, sorted(block)))
    return blocks


def _block_words(words: list[bytes], known: dict[bytes, int], size: int) -> dict[int, set[int]]:
    """Known words, by number, of each block that has one."""
    blocks: dict[int, set[int]] = {}
    half = size // 2
    for at, word in enumerate(words):
        if word in known:
            block = at // half
            blocks.setdefault(block, set()).add(known[word])
            if block:
                blocks.setdefault(block - 1, set()).add(known[word])
    return blocks


def scan_licenses(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: list[tuple[str, str]] = BASE_PHRASES,
    threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Licences named or quoted in every row's whole text.

    Returns a row per row of ``df``: ``doc_id``, ``n_words``, ``n_base`` (places of the
    phrases), ``first_word`` and ``last_word`` (smallest and largest word they start at,
    else null), ``base_labels``, ``labels`` (base labels and those of matched templates,
    sorted and joined by commas) and ``score``, one if there is a phrase, else the largest
    containment of a matched template block, zero if none matches.

    A null text counts as empty, a text of any length is read whole; repeated rows and null
    ids are scanned like any other, an empty table gives an empty result, and other columns
    are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    blocks = template_blocks(templates, block_words, threshold)
    vocabulary = sorted({w for _, words in blocks for w in words})
    known = {w: i for i, w in enumerate(vocabulary)}
    needs = [ceil(threshold * len(words) - 1e-9) for _, words in blocks]
    sought = [(label, b" ".join(words_of(phrase))) for label, phrase in phrases]
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.list_(pa.string())),
         ("blocks", pa.list_(pa.struct([("size", pa.int32()), ("words", pa.list_(pa.int32()))]))), ("counts", pa.list_(pa.int64()))]
    )

    def scanned(batches):
        half, least, counts = block_words // 2, min(needs, default=0), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(str(text))
                line = b" " + b" ".join(words) + b" "
                base = [(label, at) for label, phrase in sought for at in phrase_starts(words, phrase, line)]
                starts = [at for _, at in base]
                candidates = []
                for b, found in _block_words(words, known, block_words).items():
                    found = list(found)
                    counts[found] += 1
                    if len(found) >= least:
                        candidates.append({"size": len(set(words[half * b : half * b + block_words])), "words": found})
                rows.append(
                    {
                        "doc_id": doc_id,
                        "n_words": len(words),
                        "n_base": len(base),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base": sorted({label for label, _ in base}),
                        "blocks": candidates,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema)
        yield pa.RecordBatch.from_pylist([{"counts": counts.tolist()}], schema)  # of the task's blocks that hold each word

    read = cut(
        docs.mapInArrow(
            scanned,
            "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<size:int,words:array<int>>>, counts array<long>",
        ).withColumn("row", F.monotonically_increasing_id())
    )
    totals = read.where("counts is not null").select(F.posexplode("counts").alias("word", "n")).groupBy("word").agg(F.sum("n").alias("n"))
    counts = dict(map(tuple, totals.collect()))  # a row for each template word
    order = sorted(range(len(vocabulary)), key=lambda w: (counts.get(w, 0), vocabulary[w]))
    rank = {w: r for r, w in enumerate(order)}
    entries, prefixes = [], set()
    for number, ((label, words), need) in enumerate(zip(blocks, needs)):
        ranks = sorted(rank[known[w]] for w in words)
        entries += [(r, number, label, place, ranks, need) for place, r in enumerate(ranks[: len(ranks) - need + 1])]
        prefixes |= set(ranks[: len(ranks) - need + 1])

    ranks = F.lit([rank[w] for w in range(len(vocabulary))])
    found = read.where("counts is null").drop("counts")
    ranked = F.transform("blocks", lambda b: F.struct(b["size"].alias("size"), F.array_sort(F.transform(b["words"], lambda w: F.get(ranks, w))).alias("ranks")))
    promising = F.filter(ranked, lambda b: F.arrays_overlap(b["ranks"], F.lit(sorted(prefixes))))
    table = F.broadcast(  # a row for each prefix word of each template block
        df.sparkSession.createDataFrame(entries, "rank int, template int, label string, place int, wanted array<int>, need int")
    )
    candidates = (
        found.where(F.size("blocks") > 0)
        .select("row", F.posexplode(promising).alias("block", "b"))
        .select("row", "block", "b.size", "b.ranks", F.posexplode("b.ranks").alias("at", "rank"))
        .join(table, "rank")
        .where("size >= need")
        .groupBy("row", "block", "template", "label", "need", "wanted", "ranks", "size")
        .agg(F.min(F.struct("place", "at")).alias("first"))
        .where("1 + least(size(wanted) - first.place - 1, size(ranks) - first.at - 1) >= need")
    )
    matched = (
        candidates.withColumn("overlap", F.size(F.array_intersect("ranks", "wanted")))
        .where("overlap >= need")
        .groupBy("row")
        .agg(F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.size("wanted")).alias("score"))
    )
    return found.join(matched, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )
