"""Aligned sequences (name, aligned): column statistics, position maps, pooling of residues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.rand import shuffle_key
from gridlark.functions.text import chars


def residues(rows: DataFrame, name: str = "name", aligned: str = "aligned") -> DataFrame:
    """(name, pos, ch): one row per column of each aligned row, from 0."""
    return rows.select(name, F.posexplode(chars(F.col(aligned))).alias("pos", "ch"))


def column_histogram(rows: DataFrame, **names) -> DataFrame:
    """(pos, ch, n)."""
    return residues(rows, **names).groupBy("pos", "ch").agg(F.count(F.lit(1)).alias("n"))


def column_coverage(rows: DataFrame, threshold: float = 0.4, **names) -> DataFrame:
    """(pos, coverage, covered): share of rows without a gap, and whether it is over the threshold."""
    c = residues(rows, **names).groupBy("pos").agg(F.avg(F.when(F.col("ch") != "-", 1.0).otherwise(0.0)).alias("coverage"))
    return c.withColumn("covered", F.col("coverage") > threshold)


def column_conservation(rows: DataFrame, **names) -> DataFrame:
    """(pos, gaps, most): number of gaps, and of the most frequent letter."""
    h = column_histogram(rows, **names)
    return h.groupBy("pos").agg(F.sum(F.when(F.col("ch") == "-", F.col("n")).otherwise(0)).alias("gaps"), F.coalesce(F.max(F.when(F.col("ch") != "-", F.col("n"))), F.lit(0)).alias("most"))


def ranked_columns(rows: DataFrame, k: int, by: str = "coverage", seed: int = 1, **names) -> DataFrame:
    """k columns of fewest gaps ("coverage") or highest letter count ("conservation"); ties are drawn by seed."""
    c = column_conservation(rows, **names)
    value = F.col("gaps") if by == "coverage" else -F.col("most")
    # columns of an alignment, not rows: a bounded table
    cap = c.select(value.alias("v")).orderBy("v").limit(k).agg(F.max("v").alias("cap"))
    return c.crossJoin(F.broadcast(cap)).where(value <= F.col("cap")).withColumn("__key", shuffle_key(seed, "pos")).orderBy("__key", "pos").limit(k).select("pos")


def position_maps(rows: DataFrame, name: str = "name", aligned: str = "aligned") -> DataFrame:
    """(name, pos, ch, seq_pos): for each column the position in the ungapped sequence, null at gaps."""
    w = Window.partitionBy(name).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    solid = F.when(F.col("ch") != "-", 1).otherwise(0)
    return residues(rows, name, aligned).withColumn("seq_pos", F.when(F.col("ch") != "-", F.sum(solid).over(w) - 1))


def pool_mean(vectors: DataFrame, key: str, value: str = "residues") -> DataFrame:
    """Mean over the rows of a matrix (array of arrays), dimension by dimension."""
    each = vectors.select(key, F.explode(value).alias("row")).select(key, F.posexplode("row").alias("dim", "x"))
    return each.groupBy(key, "dim").agg(F.avg("x").alias("x"))


def pool_positions(vectors: DataFrame, positions: DataFrame, key: str, value: str = "residues") -> DataFrame:
    """Mean over the rows of a matrix at given positions (key, pos); a matrix without any gives zeros."""
    each = vectors.select(key, F.posexplode(value).alias("pos", "row")).select(key, "pos", F.posexplode("row").alias("dim", "x"))
    hit = each.join(positions.withColumn("hit", F.lit(1)), [key, "pos"], "left")
    return hit.groupBy(key, "dim").agg(F.coalesce(F.avg(F.when(F.col("hit") == 1, F.col("x"))), F.lit(0.0)).alias("x"))


def concat_positions(vectors: DataFrame, positions: list[int], key: str, value: str = "residues") -> DataFrame:
    """Rows of a matrix at fixed positions, one after the other."""
    return vectors.select(key, F.flatten(F.transform(F.filter(F.array(*map(F.lit, positions)), lambda p: p < F.size(value)), lambda p: F.get(F.col(value), p))).alias("features"))
