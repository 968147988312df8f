"""Clustering losses on (key, cluster, dim, x), where x may be null, and agreement of two labellings."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Terms of an expectation that are computed at once.
STRETCH = 1 << 16


def centroid_loss(points: DataFrame, n_dims: int, squared: bool = True) -> DataFrame:
    """(key, loss): distance of each point to its cluster's mean over present dimensions, scaled up to all: Euclidean
    by sqrt(dims / present * sum), else Manhattan by dims / present * sum."""
    mean = points.groupBy("cluster", "dim").agg(F.avg("x").alias("m"))
    d = points.join(mean, ["cluster", "dim"]).where("x is not null")
    gap = F.col("x") - F.col("m")
    s = d.groupBy("key").agg(F.sum(gap * gap if squared else F.abs(gap)).alias("s"), F.count(F.lit(1)).alias("n"))
    scaled = F.lit(float(n_dims)) / F.col("n") * F.col("s")
    return s.select("key", (F.sqrt(scaled) if squared else scaled).alias("loss"))


def intra_cluster(points: DataFrame, n_dims: int) -> DataFrame:
    """(key, loss): mean Manhattan distance to all members of the cluster, the point itself included.

    By sorted sums in each dimension, so no pairs of a cluster are made; all dimensions must be present."""
    w = Window.partitionBy("cluster", "dim").orderBy("x", "key")
    up, all_ = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("cluster", "dim")
    p = points.withColumns({"r": F.row_number().over(w), "below": F.sum("x").over(up), "total": F.sum("x").over(all_), "n": F.count("x").over(all_)})
    s = F.col("x") * F.col("r") - F.col("below") + (F.col("total") - F.col("below")) - F.col("x") * (F.col("n") - F.col("r"))
    return p.groupBy("key").agg((F.sum(s / F.col("n"))).alias("loss"))


def silhouette(means: DataFrame, clusters: DataFrame) -> DataFrame:
    """(key, silhouette) from mean distances (query, cluster, mean) to each cluster and (key, cluster)."""
    own = clusters.select(F.col("key").alias("query"), F.col("cluster").cast("long").alias("own"))
    m = means.join(own, "query")
    s = m.groupBy("query").agg(F.max(F.when(F.col("cluster") == F.col("own"), F.col("mean"))).alias("a"), F.min(F.when(F.col("cluster") != F.col("own"), F.col("mean"))).alias("b"))
    return s.select(F.col("query").alias("key"), F.when(F.col("a").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("silhouette"))


def _contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(f"{a} is not null and {b} is not null").groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index of two labellings."""
    cells = _contingency(rows, a, b)
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    joint = cells.agg(pairs(F.col("n")).alias("j"), F.sum("n").alias("n"))
    left = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("l"))
    right = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("r"))
    t = joint.crossJoin(left).crossJoin(right)  # one row each
    expected = F.col("l") * F.col("r") / (F.col("n") * (F.col("n") - 1) / 2)
    return t.select(F.try_divide(F.col("j") - expected, (F.col("l") + F.col("r")) / 2 - expected).alias("ari"))


def _expected_terms(parts):
    """The expected mutual information, times the number of class pairs, for each pair of class sizes."""
    for pdf in parts:
        out = []
        for p, q, total, ways in zip(*(pdf[c].to_numpy(dtype=float) for c in ("p", "q", "total", "ways")), strict=True):
            low, high = max(1.0, p + q - total), min(p, q)
            log_ways = lgamma(p + 1) + lgamma(q + 1) + lgamma(total - p + 1) + lgamma(total - q + 1) - lgamma(total + 1) - lgamma(low + 1) - lgamma(p - low + 1) - lgamma(q - low + 1) - lgamma(total - p - q + low + 1)
            found, at = 0.0, low
            while at <= high:  # each term from the one before, a stretch of them at once
                n = np.arange(at, min(high, at + STRETCH - 1) + 1)
                steps = np.log((p - n) * (q - n) / ((n + 1) * (total - p - q + n + 1)), where=(p > n) & (q > n), out=np.full(len(n), -np.inf))
                logs = log_ways + np.concatenate([[0.0], np.cumsum(steps[:-1])])
                found += float((n / total * np.log(total * n / (p * q)) * np.exp(logs)).sum())
                at, log_ways = at + STRETCH, logs[-1] + steps[-1]
            out.append(ways * found)
        yield pd.DataFrame({"expected": out})


def adjusted_mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information of two labellings adjusted for chance (mean of entropies); 1 where nothing is left to
    adjust, null without rows.

    The expectation depends on the sizes of classes alone: it is summed over pairs of different sizes, of which there
    are at most 2 n, each weighed by how many classes have them."""
    cells = _contingency(rows, a, b)
    left, right = (cells.groupBy(c).agg(F.sum("n").alias(f"n{c}")) for c in ("a", "b"))
    total = cells.agg(F.sum("n").alias("total"))
    x = cells.join(left, "a").join(right, "b").crossJoin(F.broadcast(total))  # one row
    mutual = x.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("total") * F.col("n") / (F.col("na") * F.col("nb")))).alias("mutual"))
    entropy = lambda side, c: side.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total")))).alias(f"h{c}"))
    sizes = lambda side, c, name: side.groupBy(F.col(c).alias(name)).agg(F.count(F.lit(1)).alias(f"w{name}"))
    pairs = sizes(left, "na", "p").crossJoin(sizes(right, "nb", "q")).crossJoin(F.broadcast(total))
    expected = pairs.select("p", "q", "total", (F.col("wp") * F.col("wq")).alias("ways")).repartition("p", "q").mapInPandas(_expected_terms, "expected double").agg(F.sum("expected").alias("expected"))
    t = mutual.crossJoin(entropy(left, "na")).crossJoin(entropy(right, "nb")).crossJoin(expected)  # one row each
    rest = (F.col("hna") + F.col("hnb")) / 2 - F.col("expected")
    return t.select(F.when(F.abs(rest) > 1e-12, (F.col("mutual") - F.col("expected")) / rest).when(rest.isNotNull(), 1.0).alias("ami"))
