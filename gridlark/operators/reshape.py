"""Dense grids (seq, sub, label): pivots, task validity, melting of result tables, sampling of labels and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.rand import shuffle_key, uniform


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in all double and float columns; done once, at the source."""
    return df.select(*(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema))


def pivot(grid: DataFrame, index: str, task: str, tasks: list, value: str = "label") -> DataFrame:
    """Wide table with a column <value>_<task> for each given task; raises if a cell has two rows."""
    cell = grid.groupBy(index, task).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("n"))
    cell = cell.withColumn(value, F.when(F.col("n") > 1, F.raise_error(F.lit("a cell has two rows"))).otherwise(F.col(value)))
    wide = cell.groupBy(index).pivot(task, tasks).agg(F.max(value))
    return wide.select(index, *(F.col(f"`{t}`").alias(f"{value}_{t}") for t in tasks))


def unpivot(wide: DataFrame, index: str, task: str, value: str = "label") -> DataFrame:
    """Long form of <label>_<task> columns; missing cells are left out. The text after the last _ is the task."""
    columns = [c for c in wide.columns if c != index]
    long = wide.unpivot([index], columns, "name", "value").where("value is not null")
    return long.select(index, F.regexp_extract("name", "^(.*)_([^_]*)$", 2).alias(task), F.regexp_extract("name", "^(.*)_([^_]*)$", 1).alias("label_name"), F.col("value").alias(value))


def task_validity(grid: DataFrame, task: str, value: str = "label", max_imbalance: float = 0.9, min_positives: int = 2, min_size: int = 2, regression: bool = False) -> DataFrame:
    """(task, n, n_pos, skip): a task is skipped if it has too few labels, or for classes too few positives or too
    uneven a share. Without any label it is skipped."""
    c = grid.groupBy(task).agg(F.count(value).alias("n"), F.coalesce(F.sum(F.when(F.col(value) == 1, 1).otherwise(0)), F.lit(0)).alias("n_pos"))
    share_safe = F.when(F.col("n") > 0, F.col("n_pos") / F.greatest(F.col("n"), F.lit(1)))
    uneven = F.lit(False)
    if not regression:
        uneven = (F.col("n_pos") < min_positives) | F.coalesce((share_safe > max_imbalance) | (share_safe < F.lit(1.0) - F.lit(max_imbalance)), F.lit(True))
    return c.withColumn("skip", (F.col("n") <= min_size) | uneven)


def dataset_summary(grid: DataFrame, **rule) -> DataFrame:
    """One row: rows, distinct values and valid tasks of both axes."""
    total = grid.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("seq").alias("n_seq"), F.countDistinct("sub").alias("n_sub"))
    for axis in ("seq", "sub"):
        valid = task_validity(grid, axis, **rule).agg(F.coalesce(F.sum(F.when(~F.col("skip"), 1).otherwise(0)), F.lit(0)).alias(f"valid_{axis}"))
        total = total.crossJoin(valid)  # one row each
    return total


def melt_metrics(results: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Wide <metric>_<task> columns to one row per task with a column per metric; tasks without values are left out."""
    columns = [c for c in results.columns if c not in ids]
    long = results.unpivot(ids, columns, "name", "value").where("value is not null")
    known = "|".join(sorted(metrics, key=len, reverse=True))
    long = long.select(*ids, F.regexp_extract("name", f"^({known})", 1).alias("metric"), F.regexp_extract("name", "_([^_]*)$", 1).alias("task"), "value")
    return long.groupBy(*ids, "task").pivot("metric", metrics).agg(F.first("value"))


def mask_labels(rows: DataFrame, share: float, seed: int, keys: list[str], value: str = "label") -> DataFrame:
    """Labels of a random share of rows become null."""
    return rows.withColumn(value, F.when(uniform(seed, *keys) >= share, F.col(value)))


def task_subset(rows: DataFrame, task: str, k: int, seed: int) -> DataFrame:
    """Rows of k random tasks."""
    chosen = rows.select(task).distinct().withColumn("__key", shuffle_key(seed, task)).orderBy("__key", task).limit(k).drop("__key")
    return rows.join(F.broadcast(chosen), task, "left_semi")


def semi(rows: DataFrame, items: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among the items; without items, all rows."""
    return rows.join(items, on, "left_semi")


def lookup(rows: DataFrame, found: DataFrame, on: str, column: str) -> DataFrame:
    """Keyed lookup that fails on the first key that is not there."""
    return rows.join(found.withColumn("__there", F.lit(True)), on, "left").withColumn(column, F.when(F.col("__there"), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("no entry for "), F.col(on).cast("string"))))).drop("__there")


def for_distinct(rows: DataFrame, on: str, name: str, compute: Column) -> DataFrame:
    """Computes a costly expression once for each distinct input and joins it back."""
    return rows.join(rows.select(on).distinct().withColumn(name, compute), on)


def union_all(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """All rows by column name; missing columns are null."""
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def concat_features(rows: DataFrame, blocks: dict[str, int]) -> DataFrame:
    """Adds `features`: the blocks one after the other; fails on a block that hasn't its width."""
    right = [F.when(F.size(c) == n, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must have {n} values"))) for c, n in blocks.items()]
    return rows.withColumn("features", F.concat(*right))


def category_one_hot(rows: DataFrame, key: str, category: str, most: int = 499) -> DataFrame:
    """(key, code, dim, x): one-hot categories, numbered in the order of the least key that has them; fails on more than
    `most` of them."""
    first = rows.groupBy(category).agg(F.min(key).alias("__first"))
    # one row a category, of which there are at most `most`
    numbered = first.withColumn("code", (F.row_number().over(Window.orderBy("__first", category)) - 1).cast("long")).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))
    numbered = numbered.withColumn("__n", F.when(F.col("__n") <= most, F.col("__n")).otherwise(F.raise_error(F.lit(f"more than {most} categories")))).drop("__first")
    dims = rows.join(numbered, category).withColumn("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    return dims.select(key, "code", "dim", F.when(F.col("dim") == F.col("code"), 1.0).otherwise(0.0).alias("x"))
