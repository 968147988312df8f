"""Summaries of result tables: seed intervals, best flags, tests between methods, string tables."""

from __future__ import annotations

from math import exp, lgamma, log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Cutoffs of one star each.
STAR_CUTS = (1e-4, 1e-3, 1e-2, 5e-2)


def seed_interval(results: DataFrame, by: list[str], seed: str, value: str) -> DataFrame:
    """(by, mean, half): mean of the seeds' means, and 1.96 standard errors over seeds."""
    m = results.groupBy(*by, seed).agg(F.avg(value).alias("__m"))
    half = 1.96 * F.try_divide(F.stddev_samp("__m"), F.sqrt(F.count("__m")))
    return m.groupBy(*by).agg(F.avg("__m").alias("mean"), half.alias("half"))


def best_flags(intervals: DataFrame, within: list[str]) -> DataFrame:
    """Adds best: the mean is not under the largest mean less that one's half-width."""
    top = intervals.groupBy(*within).agg(F.max_by(F.struct("mean", F.coalesce("half", F.lit(0.0)).alias("half")), "mean").alias("top"))
    return intervals.join(top, within).withColumn("best", F.col("mean") >= F.col("top.mean") - F.col("top.half")).drop("top")


def string_table(cells: DataFrame, index: str, column: str, columns: list, text: str) -> DataFrame:
    """Pivot of strings, joined in order if a cell has several."""
    return cells.groupBy(index).pivot(column, columns).agg(F.array_join(F.array_sort(F.collect_list(text)), ""))


def latex_lines(header: list[str], rows: list[tuple]) -> list[str]:
    """Lines of a LaTeX tabular of a small report table; missing values are blank."""
    line = lambda cells: " & ".join("" if v is None else str(v) for v in cells) + r" \\"
    return [f"\\begin{{tabular}}{{{'l' * len(header)}}}", line(header), *map(line, rows), r"\end{tabular}"]


def linear_fit(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, slope, intercept, r2, stderr) of a least-squares line."""
    s = rows.where(f"{x} is not null and {y} is not null").groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    slope = F.try_divide(F.col("c"), F.col("vx"))
    r2 = F.try_divide(F.col("c") * F.col("c"), F.col("vx") * F.col("vy"))
    err = F.sqrt(F.try_divide((1 - r2) * F.col("vy"), F.col("vx") * (F.col("n") - 2)))
    return s.select(*by, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), r2.alias("r2"), err.alias("stderr"))


def welch(results: DataFrame, by: list[str], method: str, value: str, central: str) -> DataFrame:
    """(by, method, t, dof): the central method against each other one."""
    s = results.groupBy(*by, method).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    c = s.where(F.col(method) == central).select(*by, F.col("n").alias("cn"), F.col("m").alias("cm"), F.col("v").alias("cv"))
    j = s.where(F.col(method) != central).join(F.broadcast(c) if not by else c, by) if by else s.where(F.col(method) != central).crossJoin(F.broadcast(c))
    a, b = F.try_divide(F.col("cv"), F.col("cn")), F.try_divide(F.col("v"), F.col("n"))
    t = F.try_divide(F.col("cm") - F.col("m"), F.sqrt(a + b))
    dof = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("cn") - 1) + F.try_divide(b * b, F.col("n") - 1))
    return j.select(*by, method, t.alias("t"), dof.alias("dof"))


def _t_tail(t: float, dof: float) -> float:
    """P(T > t) by the continued fraction of the incomplete beta function."""
    x = dof / (dof + t * t)
    a, b = dof / 2, 0.5
    if x <= 0:
        return 0.0 if t > 0 else 1.0
    if x >= 1:
        return 0.5

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + num / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    beta = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return beta / 2 if t > 0 else 1 - beta / 2


@F.pandas_udf(DoubleType())
def t_upper_tail(t: pd.Series, dof: pd.Series) -> pd.Series:
    """P(T > t) with dof degrees of freedom; null where either is."""
    return pd.Series([None if x is None or d is None or x != x or d != d else _t_tail(x, d) for x, d in zip(t, dof, strict=True)], dtype="float64")


def _signed_rank(d: list[float]) -> float:
    """Two-sided p of Wilcoxon's signed-rank test: exact up to 25 differences without ties, else normal."""
    d = [x for x in d if x]
    n = len(d)
    if not n:
        return 1.0
    order = sorted(abs(x) for x in d)
    rank = {v: sum(i + 1 for i, w in enumerate(order) if w == v) / order.count(v) for v in set(order)}
    plus = sum(rank[abs(x)] for x in d if x > 0)
    w = min(plus, n * (n + 1) / 2 - plus)
    if n <= 25 and len(rank) == n:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(order.count(v) ** 3 - order.count(v) for v in rank) / 48
    from statistics import NormalDist

    return min(1.0, 2 * NormalDist().cdf((w - n * (n + 1) / 4) / var**0.5))


@F.pandas_udf(DoubleType())
def wilcoxon_p(differences: pd.Series) -> pd.Series:
    """p of the signed-rank test of each array of paired differences."""
    return pd.Series([None if d is None else _signed_rank([float(x) for x in d]) for d in differences], dtype="float64")


def benjamini_hochberg(tests: DataFrame, by: list[str], p: str) -> DataFrame:
    """Adds adjusted: step-up false discovery rate within each family of tests."""
    up = Window.partitionBy(*by).orderBy(p, *(c for c in tests.columns if c not in (*by, p)))
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    step = tests.withColumn("__q", F.col(p) * m / F.row_number().over(up)).withColumn("__r", F.row_number().over(up))
    rest = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return step.withColumn("adjusted", F.least(F.lit(1.0), F.min("__q").over(rest))).drop("__q", "__r")


def stars(p: Column) -> Column:
    """One star for each cutoff that p is not over; none for null."""
    return F.repeat(F.lit("*"), sum((F.when(p <= c, 1).otherwise(0) for c in STAR_CUTS), F.lit(0)))
