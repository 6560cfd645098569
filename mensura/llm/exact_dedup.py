"""Exact duplicate detection by distributed MSD radix partitioning.

A text is read as its length in bytes followed by its UTF-8 bytes, and split from the
most significant end.  The first digit is the length with the leading bytes; each later
digit is a wider run of the bytes that follow.  A level counts the documents of every
(group, digit); a group of one is settled, a group whose bytes have ended holds equal
texts, and every other group goes to the next level.  Groups are compared by their own
bytes, so equality needs no digest.

Only groups of two and more survive a level, so the bytes of unlike texts are compared no
further than where they part.  A level is one map-side combined count and one join on the
same keys; rows of hot groups stay where they are and have theirs broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import body, cut
from mensura.llm.components import joined_unskewed

FIRST_WIDTH = 64
WIDENING = 64
MAX_WIDTH = 1 << 26


def exact_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    first_width: int = FIRST_WIDTH,
    widening: int = WIDENING,
    max_width: int = MAX_WIDTH,
) -> DataFrame:
    """Classify every row of ``df`` by equality of its whole text.

    Returns one row per row of ``df``: ``doc_id``, ``keep_id`` (largest id among the equal
    texts), ``group_size``, ``kept`` and ``text_sha256``.

    A null text counts as empty; a text of any length is compared to its end.  Ids may be
    null: null is smaller than any id.  Where rows repeat both id and text, exactly one of
    them is kept.  An empty table gives an empty result.  Other columns are ignored,
    whatever their names.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.sha2(body(text_col), 256).alias("carried"))
    settled = _settled(docs, False, first_width, widening, max_width)
    return settled.select("doc_id", "keep_id", "group_size", "kept", F.col("carried").alias("text_sha256"))


def _settled(docs: DataFrame, with_text: bool, first_width: int, widening: int, max_width: int) -> DataFrame:
    """``doc_id`` and ``carried`` of every row, its ``text`` if wanted, and what the split tells of it."""
    data = body("text").cast("binary")
    keyed = docs.withColumns({"size": F.octet_length(data), "digit": F.substring(data, 1, first_width)})
    groups = cut(
        keyed.groupBy("size", "digit")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("size", "digit", "n", F.monotonically_increasing_id().alias("grp"))
    )
    result = ["doc_id", "carried", *["text"] * with_text]
    single = joined_unskewed(keyed.select(*result, "size", "digit"), groups, ["size", "digit"], "left_anti").select(
        *result, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    open_rows = cut(joined_unskewed(keyed, groups, ["size", "digit"]).select("doc_id", "carried", "text", "size", "grp", F.monotonically_increasing_id().alias("row")))

    settled, start, width = [single], first_width, first_width
    while not open_rows.isEmpty():
        width = min(width * widening, max_width)
        level = open_rows.withColumn("digit", F.substring(data, start + 1, width))
        groups = cut(
            level.groupBy("grp", "digit")
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row")).alias("keep"))
            .where("n > 1")
            .select("grp", "digit", "n", "keep", F.monotonically_increasing_id().alias("sub"))
        )
        start += width
        done = F.col("n").isNull() | (F.col("size") <= start)
        text = F.col("text") if with_text else F.when(~done, F.col("text"))
        split = cut(
            joined_unskewed(level, groups, ["grp", "digit"], "left").select(
                "doc_id", "carried", text.alias("text"), "size", "row", "n", "keep", done.alias("done"), F.col("sub").alias("grp")
            )
        )
        settled.append(
            split.where("done").select(
                *result,
                F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
                F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
                (F.col("n").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"),
            )
        )
        open_rows = split.where("not done").select("doc_id", "carried", "text", "size", "grp", "row")
    return reduce(DataFrame.unionByName, settled)


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` with one row for each distinct text, that with the largest id.

    All columns stay, whatever their names, and go with the text through the split, so
    that no digest and no further join is needed.  Of rows that repeat both id and text
    one stays; null and empty texts are equal.  An empty table gives an empty result.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col])
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), others.alias("carried"))
    kept = _settled(docs, True, FIRST_WIDTH, WIDENING, MAX_WIDTH).where("kept")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"carried.`{c}`") for c in df.columns])
