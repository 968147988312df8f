"""Places and running sums in an order, without a task that sees a whole group or table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.sources.shared import written

#: Ranges that a numeric order is cut into.
RANGES = 256


def running_before(rows: DataFrame, by: list[str], order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """rows with <sum>_before, for each of `sums` the sum over the rows of the group that come before in `order`.

    `order` is a number, different within a group. Its quantiles over all rows cut every group into ranges; a group's
    running sum is that of its ranges before, at most RANGES rows, and that within the range. So one task holds about a
    RANGES-th of all rows at most, however few the groups are. Null comes first, or last if descending."""
    cuts = rows.agg(F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)], 8 * RANGES).alias("__cuts"))
    place = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(order))), F.lit(-1)) * (-1 if descending else 1)
    cut = rows.crossJoin(F.broadcast(cuts)).withColumn("__range", F.when(F.col(order).isNull(), F.lit(RANGES if descending else -1)).otherwise(place)).drop("__cuts")  # one row
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    sizes = sizes.select(*(F.col(b).alias(f"__by{k}") for k, b in enumerate(by)), F.col("__range").alias("__at"), *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums))
    same = F.col("__range") == F.col("__at")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by{k}"))
    within = Window.partitionBy(*by, "__range").orderBy(F.col(order).desc() if descending else F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    found = cut.join(sizes, same)
    return found.select(*rows.columns, *((F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"__{c}")).alias(f"{c}_before") for c in sums))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place from 0 in the order of some columns, which must differ between rows or ties are arbitrary.

    Rows are sorted into ranges that are written once; a row's place is that in its range after the sizes of those
    before, one row a range."""
    placed = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy().orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(every), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__range").orderBy(*order)
    return placed.join(F.broadcast(before), "__range").select(*rows.columns, (F.row_number().over(within) - 1 + F.col("__before")).cast("long").alias(name))


#: Rows of a small side that are broadcast, and shares that a larger one's partners are dealt to.
MOST_BROADCAST, SHARES = 100_000, 64


def crossed(rows: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Every row with every row of `small` that has the same `on`; small is counted and broadcast if it is small, else
    both are dealt by `on` and a share of the rows."""
    if small.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(small), on)
    dealt = rows.withColumn("__share", F.pmod(F.xxhash64(*rows.columns), F.lit(SHARES)))
    every = small.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    return dealt.join(every, [on, "__share"]).drop("__share")


#: Partitions that meeting blocks are dealt to, at most. What leaves them is much more than what Spark sees come in, so
#: they are set and not left to adaptive execution.
MOST_DEALT = 4096


def block(c: str | Column, n: int) -> Column:
    """One of n blocks, by hash."""
    return F.pmod(F.xxhash64(c), F.lit(n))


def blocks_of(rows: int, most: int, least: int = 16) -> int:
    """Blocks that so many rows are dealt to: some for every core, none of more than `most` rows or under 256, about."""
    return 1 + max(rows // most, min(rows // 256, least))


def every(n: int) -> Column:
    """A row for each of n blocks."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
