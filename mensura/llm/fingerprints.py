"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range.  Its size
follows the text's, so that sketches of very unequal texts still tell how much of one is
in the other, and the sketch of a union is the union of the sketches.  Beside these hashes,
and apart from them, a sketch has the least hash of all, by which texts are told apart that
are so short that none of their hashes is below the fraction; the least of a union is the
lesser of the two.

Everything here is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mensura.llm.common import body, cut

SHINGLE_WORDS = 5
SCALE = 8
BUCKET_ROWS = 512
MAX_BUCKETS = 1 << 16  # of more rows than fill them, a bucket has its even share
STEP = 32
CELLS = STEP * STEP


def sketch(text: Column, shingle_words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """Sketch of a text column: ``kept``, the sorted distinct shingle hashes of the first ``1 / scale`` of the range, and ``least``.

    A text without words keeps nothing and has no least hash.  Words are lower-cased and divided by white space; a text of fewer words than a shingle
    has one shingle of all its words.  Shingles are hashed from the hashes of their words.
    """
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(F.array(hashes), lambda h: _kept(h, shingle_words, scale))[0]


def _kept(hashes: Column, shingle_words: int, scale: int) -> Column:
    count = F.size(hashes) - shingle_words + 1
    many = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(shingle_words)]),
    )
    few = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<long>"))
    # the lowest part of the signed range is a fixed fraction of it
    limit = -(1 << 63) + (1 << 64) // scale
    every = F.when(count > 0, many).otherwise(few)
    return F.transform(
        F.array(every),
        lambda e: F.struct(F.array_sort(F.array_distinct(F.filter(e, lambda h: h < limit))).alias("kept"), F.array_min(e).alias("least")),
    )[0]


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of the union of two texts' shingles that both have; 1 if neither has any.

    If neither keeps a hash, it is 1 or 0 as their least ones are equal or not.
    """
    union = F.size(F.array_union(a["kept"], b["kept"]))
    alike = F.when(a["least"].eqNullSafe(b["least"]), 1.0).otherwise(0.0)
    return F.when(union == 0, alike).otherwise(F.size(F.array_intersect(a["kept"], b["kept"])) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that are in the second; 1 if it has none.

    If the first keeps no hash, it is 1 or 0 as the least ones are equal or not.
    """
    alike = F.when(a["least"].isNull() | a["least"].eqNullSafe(b["least"]), 1.0).otherwise(0.0)
    return F.when(F.size(a["kept"]) == 0, alike).otherwise(F.size(F.array_intersect(a["kept"], b["kept"])) / F.size(a["kept"]))


def merge(a: Column, b: Column) -> Column:
    """Sketch of the shingles of two texts taken together."""
    return F.struct(F.array_sort(F.array_union(a["kept"], b["kept"])).alias("kept"), F.least(a["least"], b["least"]).alias("least"))


def _hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def encoded(a: Column) -> Column:
    """A sketch as text: its hashes in 16 hexadecimal digits each; if it keeps none, a tilde and the least; empty for no words."""
    kept = F.array_join(F.transform(a["kept"], _hex), "")
    return F.when(F.size(a["kept"]) > 0, kept).otherwise(F.coalesce(F.concat(F.lit("~"), _hex(a["least"])), F.lit("")))


def with_next(df: DataFrame, id_col: str, columns: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``next_<c>`` of each column: its value in the row of the next smaller id.

    After the smallest id the largest comes, and null ids come last; equal ids go by the
    columns.  Rows are dealt by ranges of ids into buckets of about ``bucket_rows`` in one
    shuffle; the first row of a bucket also goes, as a guest, to the bucket before it.
    The ranges are cells between approximate quantiles of the ids, each divided evenly:
    at most ``CELLS`` rows describe them, and at most ``MAX_BUCKETS`` the guests.
    """
    ids = df.select(F.col(id_col).alias("id"))
    shares = [k / CELLS for k in range(1, CELLS)]
    n, bounds = ids.agg(F.count(F.lit(1)), F.percentile_approx("id", shares, 16 * CELLS)).first()
    if n == 0:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    wanted = max(1, min(MAX_BUCKETS, -(-n // bucket_rows)))
    bounds = sorted(set(bounds or [0]))
    coarse, fine = F.lit(bounds[STEP - 1 :: STEP] or [bounds[-1]]), F.lit(bounds)

    def celled(rows: DataFrame, key: str) -> DataFrame:
        """With the number of bounds up to the key, null for none, found in two steps."""
        step = F.size(F.filter(coarse, lambda b: b <= F.col(key))) if len(bounds) >= STEP else F.lit(0)
        rest = F.size(F.filter(F.slice(fine, F.col("_step") * STEP + 1, F.lit(STEP)), lambda b: b <= F.col(key)))
        return rows.withColumn("_step", step).withColumn("_cell", F.when(F.col(key).isNotNull(), F.col("_step") * STEP + rest)).drop("_step")

    counts = celled(ids.where("id is not null"), "id").groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = F.broadcast(  # at most CELLS rows
        cut(
            counts.select(
                "_cell",
                F.floor(before * wanted / n).cast("int").alias("base"),
                (F.col("n") * wanted / n).alias("share"),
                "lo",
                (F.col("hi") - F.col("lo") + 1).alias("span"),
            )
        )
    )

    def bucketed(rows: DataFrame, key: str) -> DataFrame:
        inside = F.col("base") + F.floor((F.col(key) - F.col("lo")) / F.col("span") * F.col("share")).cast("int")
        return (
            celled(rows, key)
            .join(cells, "_cell", "left")
            .withColumn("_bucket", F.coalesce(inside, F.lit(-1)))
            .drop("_cell", "base", "share", "lo", "span")
        )

    firsts = bucketed(ids, "id").groupBy("_bucket").agg(F.max("id").alias("_first"))
    down = Window.orderBy(F.col("_bucket").desc())
    host = F.coalesce(F.lag("_bucket").over(down), F.min("_bucket").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = F.broadcast(cut(firsts.select("_first", host.alias("_host"))))  # a row for each bucket

    placed = bucketed(df.withColumn("_id", F.col(id_col)), "_id")
    placed = placed.join(guests, placed["_id"].eqNullSafe(guests["_first"]), "left").drop("_first")
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_host").alias("bucket"), F.lit(True).alias("guest"))
    spread = placed.withColumn("_at", F.explode(F.when(F.col("_host").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    order = Window.partitionBy("_at.bucket").orderBy("_at.guest", F.col("_id").desc_nulls_last(), *columns)
    return (
        spread.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
        .where("not _at.guest")
        .drop("_id", "_bucket", "_host", "_at")
    )


def fingerprint_with_edits(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, scale: int = SCALE
) -> DataFrame:
    """Sketch every whole text and its edited text, whose last half is the next document's first.

    Returns ``doc_id``, ``n_chars``, ``edited_text``, ``sketch``, ``edited_sketch`` and
    ``next_sketch``.  A null text counts as empty; a single row follows itself; rows of
    equal id follow each other in the order of their texts.  Texts of any length are read
    whole, an empty table gives an empty result, and other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    paired = with_next(docs.withColumn("sketch", sketch(F.col("text"), shingle_words, scale)), "doc_id", ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next_text").substr(F.lit(1), half))
    return paired.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        edited.alias("edited_text"),
        "sketch",
        sketch(edited, shingle_words, scale).alias("edited_sketch"),
        "next_sketch",
    )
