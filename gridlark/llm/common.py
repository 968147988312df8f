"""What the corpus operators share: reading tables, shared scratch tables, normalised text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of any file system that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where a local session names none, as in tests, one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gridlark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of scratch() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null is empty. Rows of one byte a character take the short way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts Arrow batches into blocks of about `limit` bytes of text: (rows, bytes, offsets), null text as empty.

    The bytes are a view of Arrow's buffer where the column has no nulls; one row is never cut."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        if not len(texts):
            continue
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


#: Bits of one row of a Bloom filter of rows, and of the words it is an array of.
ROW_BITS, WORD_BITS = 32768, 64


def slots(key: Column, buckets: int) -> tuple[Column, list[Column]]:
    """Bucket and three bits within it of a key, for Bloom filters of rows."""
    h = F.xxhash64(key)
    bits = [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(ROW_BITS - 1)).cast("int") for k in (19, 34, 49)]
    return F.pmod(F.xxhash64(key, F.lit("bucket")), F.lit(buckets)), bits


def filter_rows(bits: DataFrame) -> DataFrame:
    """(bucket, words) of (bucket, bit): each row of the filter as an array of 64-bit words.

    Words are combined before the shuffle."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % WORD_BITS)
    each = bits.groupBy("bucket", F.floor(F.col("bit") / WORD_BITS).cast("int").alias("w")).agg(F.bit_or(one).alias("x"))
    found = each.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("found"))
    words = F.transform(F.sequence(F.lit(0), F.lit(ROW_BITS // WORD_BITS - 1)), lambda w: F.coalesce(F.try_element_at("found", w), F.lit(0).cast("long")))
    return found.select("bucket", words.alias("words"))


def test_slots(rows: DataFrame, column: str, known: DataFrame, buckets: int, name: str) -> DataFrame:
    """Adds the boolean `name`: whether all bits of the column's key are set in `known` (bucket, words).

    `known` has at most `buckets` rows of 4 KiB and callers bound `buckets` (see filter_size), so it may be broadcast."""
    bucket, bits = slots(F.col(column), buckets)
    is_set = lambda bit: F.call_function("shiftright", F.get("words", F.floor(bit / WORD_BITS).cast("int")), bit % WORD_BITS).bitwiseAND(F.lit(1).cast("long")) == 1
    rows = rows.withColumn("bucket", bucket).join(F.broadcast(known), "bucket", "left")
    return rows.withColumn(name, F.coalesce(is_set(bits[0]) & is_set(bits[1]) & is_set(bits[2]), F.lit(False))).drop("bucket", "words")


#: Bits of a filter for each key, and most rows of a filter (16 MiB in all).
KEY_BITS, MOST_ROWS = 16, 4096


def filter_size(n: int, most: int = MOST_ROWS) -> int:
    """Rows of a filter for n keys, up to `most`; a filter of more keys lets more rows pass."""
    return max(16, min(most, -(-n * KEY_BITS // ROW_BITS)))


def mark_members(rows: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """Adds the boolean `name`: false only for rows whose column is not among `keys` (a table; its first column).

    The Bloom filter grows with the keys up to 16 MiB, is written once and broadcast. When it is full, it lets more rows
    pass, and a join after it decides; it only spares the others the shuffle."""
    buckets = filter_size(keys.count())
    bucket, bits = slots(F.col(keys.columns[0]), buckets)
    known = scratch(filter_rows(keys.select(bucket.alias("bucket"), F.explode(F.array(*bits)).alias("bit"))))
    return test_slots(rows, column, known, buckets, name)


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose id is not among `ids` (its first column); null ids stay.

    The row is one column meanwhile, so that none of its names can clash; only rows that the filter of mark_members
    lets through are shuffled."""
    gone = ids.select(F.col(ids.columns[0]).alias("gone"))
    marked = mark_members(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc")), "doc", gone, "maybe")
    kept = marked.where("maybe").join(gone, F.col("doc") == F.col("gone"), "left_anti")
    return marked.where("not maybe").select("row.*").union(kept.select("row.*"))
