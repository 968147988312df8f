"""Grouped metrics over a table of predictions. Rows without a label are left out; undefined metrics are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.operators.ranges import running_before
from gridlark.sources.shared import written


def _confusion(y: str, p: str, cut: float) -> dict[str, Column]:
    hit, said = F.col(y) == 1, F.col(p) >= cut
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    return {"tp": count(hit & said), "fp": count(~hit & said), "fn": count(hit & ~said), "tn": count(~hit & ~said)}


def binary_metrics(facts: DataFrame, by: list[str], y: str = "label", p: str = "pred", cut: float = 0.5) -> DataFrame:
    """precision, recall, accuracy, f1 and mcc at a cut; 0 where a denominator is 0."""
    c = facts.where(F.col(y).isNotNull()).groupBy(*by).agg(*(v.alias(k) for k, v in _confusion(y, p, cut).items()))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return c.select(*by, zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(tp + tn, tp + tn + fp + fn).alias("accuracy"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"), zero(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"))


def error_metrics(facts: DataFrame, by: list[str], y: str = "label", p: str = "pred") -> DataFrame:
    """mae and rmse."""
    e = F.col(y) - F.col(p)
    return facts.where(F.col(y).isNotNull()).groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def _by_score(facts: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Per distinct score: rows and positives; ranks then need one row a score, whatever the ties."""
    return facts.where(F.col(y).isNotNull()).groupBy(*by, F.col(p).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"))


def roc_auc(facts: DataFrame, by: list[str], y: str = "label", p: str = "pred") -> DataFrame:
    """auc_roc by rank sums, ties count half; null for a single class."""
    s = running_before(_by_score(facts, by, y, p), by, "score", ["n"]).withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2)
    s = s.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    return s.select(*by, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc_roc"))


def average_precision(facts: DataFrame, by: list[str], y: str = "label", p: str = "pred") -> DataFrame:
    """avg_pr: step-wise area over distinct scores; null without positives."""
    s = running_before(_by_score(facts, by, y, p), by, "score", ["n", "pos"], descending=True)
    s = s.select(*by, "pos", ((F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))).alias("precision"))
    return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.sum("pos")).alias("avg_pr"))


#: Rows of a group that one task ranks at most.
MOST_RANKED = 1 << 20


def _ranked_whole(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with a and b, their average ranks by y and x; a group's rows are sorted in one task."""
    within = Window.partitionBy(*by)
    rank = lambda c: F.rank().over(within.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2
    return rows.repartition(*by).withColumn("a", rank("y")).withColumn("b", rank("x"))


def _ranked_in_ranges(rows: DataFrame, by: list[str]) -> DataFrame:
    """The same by one row per distinct score, counted in ranges; no task sees a whole group."""
    for value, name in (("y", "a"), ("x", "b")):
        c = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
        c = running_before(c, by, value, ["c"]).withColumn(name, F.col("c_before") + (F.col("c") + 1) / 2)
        rows = rows.join(c.drop("c", "c_before"), [*by, value])
    return rows.select(*by, "y", "x", "a", "b")


def spearman(facts: DataFrame, by: list[str], y: str = "label", p: str = "pred") -> DataFrame:
    """Pearson's coefficient of average ranks; null for a constant side.

    Groups are ranked in one shuffle by group; those of over MOST_RANKED rows are ranked in ranges instead."""
    rows = facts.where(F.col(y).isNotNull()).select(*by, F.col(y).alias("y"), F.col(p).alias("x")).dropna(subset=by)
    large = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > MOST_RANKED).drop("__n")
    large = written(large)  # a row for MOST_RANKED rows at least
    ranked = _ranked_whole(rows.join(F.broadcast(large), by, "left_anti"), by)
    if large.limit(1).count():
        ranked = ranked.union(_ranked_in_ranges(rows.join(F.broadcast(large), by, "left_semi"), by))
    ranked = ranked.where("x is not null")
    r = ranked.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return r.select(*by, F.try_divide(F.col("n") * F.col("ab") - F.col("sa") * F.col("sb"), F.sqrt((F.col("n") * F.col("aa") - F.col("sa") * F.col("sa")) * (F.col("n") * F.col("bb") - F.col("sb") * F.col("sb")))).alias("spearman"))


#: Metric name to builder; add to it to extend the engine.
REGISTRY = {"binary": binary_metrics, "errors": error_metrics, "auc_roc": roc_auc, "avg_pr": average_precision, "spearman": spearman}
REGRESSION, CLASSIFICATION = ("errors", "spearman"), ("binary", "auc_roc", "avg_pr")


def evaluate(facts: DataFrame, by: list[str], names: tuple[str, ...] = CLASSIFICATION, **how) -> DataFrame:
    """All named metrics, one row per group."""
    first, *rest = (REGISTRY[n](facts, by, **how) for n in names)
    for df in rest:
        first = first.join(df, by)
    return first


def chained_means(metrics: DataFrame, levels: list[str], columns: list[str]) -> DataFrame:
    """Means of means: drops the last level, then the one before, until the first is left. Nulls don't count."""
    for k in range(len(levels) - 1, 0, -1):
        metrics = metrics.groupBy(*levels[:k]).agg(*(F.avg(c).alias(c) for c in columns))
    return metrics
