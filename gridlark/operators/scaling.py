"""Scaling, selection and projection of features in long form (key, dim, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_form(rows: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """(key, dim, x) of an array column."""
    return rows.select(key, *more, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def standard_scale(features: DataFrame, fit: DataFrame, by: list[str] | None = None, value: str = "x") -> DataFrame:
    """(value - mean) / population deviation as fitted on `fit`, by dimension or task; deviation 0 counts as 1."""
    by = by or ["dim"]
    stats = fit.groupBy(*by).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__dev"))
    scale = F.when(F.col("__dev") > 0, F.col("__dev")).otherwise(1.0)
    return features.join(stats, by).withColumn(value, (F.col(value) - F.col("__mean")) / scale).drop("__mean", "__dev")


def inverse_scale(scaled: DataFrame, fit: DataFrame, by: list[str], value: str) -> DataFrame:
    """Undoes standard_scale with the same fit."""
    stats = fit.groupBy(*by).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__dev"))
    scale = F.when(F.col("__dev") > 0, F.col("__dev")).otherwise(1.0)
    return scaled.join(stats, by).withColumn(value, F.col(value) * scale + F.col("__mean")).drop("__mean", "__dev")


def variance_select(features: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Dimensions whose population variance is over the threshold."""
    return features.groupBy("dim").agg(F.var_pop("x").alias("variance")).where(F.col("variance") > threshold)


def chi2_select(features: DataFrame, label: str, k: int = 30) -> DataFrame:
    """(dim, chi2) of the k best dimensions: sums of a non-negative feature by class against those expected."""
    seen = features.groupBy("dim", label).agg(F.sum("x").alias("seen"))
    classes = features.where("dim = 0").groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    classes = classes.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy()))  # one row a class
    total = seen.groupBy("dim").agg(F.sum("seen").alias("total"))
    e = F.col("share") * F.col("total")
    scored = seen.join(F.broadcast(classes), label).join(total, "dim").groupBy("dim").agg(F.sum(F.try_divide((F.col("seen") - e) * (F.col("seen") - e), e)).alias("chi2"))
    return scored.orderBy(F.col("chi2").desc_nulls_last(), "dim").limit(k)


def pca(rows: DataFrame, key: str, vector: str, n: int = 10) -> DataFrame:
    """(key, components): centred projection on the first n principal axes; signs are arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(v).transform(v)
    return PCA(k=n, inputCol="centred", outputCol="pc").fit(centred).transform(centred).select(key, vector_to_array("pc").alias("components"))


def kmer_frequencies(rows: DataFrame, key: str, kmers) -> DataFrame:
    """(key, kmer, freq): share of each k-mer of a sequence, given as an array Column."""
    c = rows.select(key, F.explode(kmers).alias("kmer")).groupBy(key, "kmer").agg(F.count(F.lit(1)).alias("c"))
    return c.select(key, "kmer", (F.col("c") / F.sum("c").over(Window.partitionBy(key))).alias("freq"))


def outer_features(items: DataFrame, a: str, b: str, key: str, fit: str, least_deviation: float = 0.1, n: int = 10) -> DataFrame:
    """(key, components): outer products of two vectors, first without columns of small deviation on the fitting rows, then projected.

    `fit` is a condition that says which rows are fitted on."""
    from gridlark.functions.vectors import outer

    def strong(column: str) -> list[int]:
        # dimensions of a vector, a bounded list
        s = long_form(items.where(fit), key, column).groupBy("dim").agg(F.stddev_pop("x").alias("d")).where(F.col("d") > least_deviation)
        return sorted(r["dim"] for r in s.collect())

    pick = lambda column: F.transform(F.array(*map(F.lit, strong(column))), lambda i: F.get(F.col(column), i).cast("double"))
    crossed = items.select(key, outer(pick(a), pick(b)).alias("__outer"))
    return pca(crossed, key, "__outer", n)
