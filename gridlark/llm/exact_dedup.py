"""Exact dedup by two passes over a Bloom filter, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import ascii_lower, filter_rows, filter_size, scratch, slots, test_slots

#: Most rows of 4 KiB of the filter.
MOST_FILTER = 1 << 14


def repeat_filter(digests: DataFrame, column: str, buckets: int) -> DataFrame:
    """First pass: (bucket, words) with a bit for each slot that two or more rows hit.

    Slots are counted with map-side combination. At most `buckets` rows of 4 KiB come out, whatever the input."""
    bucket, bits = slots(F.col(column), buckets)
    hits = digests.select(bucket.alias("bucket"), F.explode(F.array_distinct(F.array(*bits))).alias("bit"))
    return filter_rows(hits.groupBy("bucket", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "bit"))


def maybe_repeated(digests: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """Adds `maybe`: false only for rows of the table whose digest no other row has.

    The filter has 16 bits a row up to MOST_FILTER rows of 4 KiB (64 MiB), so it may be broadcast at any input size; it is
    written once. Beyond some ten million rows it fills up: more rows are taken for possibly repeated, and no result changes."""
    buckets = buckets or filter_size(digests.count(), MOST_FILTER)
    return test_slots(digests, column, scratch(repeat_filter(digests, column, buckets)), buckets, "maybe")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest id stays.
    Rows that also share the id are all kept or all dropped; a null id loses against any other and stays only where
    all ids of its group are null. Other columns are not read; an empty table gives an empty result. A text has to fit a
    task; only its digest is shuffled."""
    digest = F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)
    digests = scratch(docs.select(F.col(id_col).alias("id"), digest.alias("sha")))
    rows = maybe_repeated(digests, "sha", buckets)
    some = rows.where("maybe")
    # written first, so that the join reads two plain shuffles and Spark can split a hot digest's rows
    groups = some.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    repeated = some.join(scratch(groups), "sha").select("id", "keep_id", "group_size", "sha")
    alone = rows.where("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return alone.unionByName(repeated).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
