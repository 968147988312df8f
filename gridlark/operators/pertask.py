"""One model for each task of a grid, all fitted in the same jobs from sums over their rows.

Rows are (task, features, label); rows with a null label or without features count for nothing. Ridge regression takes
one pass, logistic regression one a Newton round. Models with kernels are these on features that inducing points give."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.sums import matrix_sums
from gridlark.sources.shared import forget, written


def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of all products of (1, features, label)."""
    z = np.column_stack([np.ones(len(x)), x, y])
    return z.T @ z


def solve_ridge(m: np.ndarray, alpha: float, intercept: bool = True) -> np.ndarray:
    """(intercept, weights) that minimise the squared error plus alpha |weights|^2, given moments."""
    x, y = (m[1:-1, 1:-1], m[1:-1, -1]) if not intercept else (m[1:-1, 1:-1] - np.outer(m[0, 1:-1], m[0, 1:-1]) / m[0, 0], m[1:-1, -1] - m[0, 1:-1] * m[0, -1] / m[0, 0])
    a = x + alpha * np.eye(len(x))
    w = np.linalg.solve(a, y) if alpha > 0 else np.linalg.lstsq(a, y, rcond=None)[0]
    return np.append((m[0, -1] - m[0, 1:-1] @ w) / m[0, 0] if intercept else 0.0, w)


def matrix_of(pdf: pd.DataFrame) -> np.ndarray:
    """A group's matrix from its rows (i, sums)."""
    return np.stack(pdf.sort_values("i")["sums"].to_list())


def fit_ridge(train: DataFrame, task: str = "task", alpha: float = 1.0, intercept: bool = True) -> DataFrame:
    """(task, coef): intercept and weights of each task's ridge regression."""
    sums = matrix_sums(train, [task], ["features", "label"], moments)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({task: pdf[task].iloc[:1], "coef": [solve_ridge(matrix_of(pdf), alpha, intercept)]})

    return sums.groupBy(task).applyInPandas(solve, f"{task} {train.schema[task].dataType.simpleString()}, coef array<double>")


def linear(features: Column, coef: Column) -> Column:
    """Intercept plus weights times features; null where there is no model."""
    rest = F.slice(coef, 2, F.greatest(F.size(coef) - 1, F.lit(0)))
    return F.aggregate(F.zip_with(rest, features, lambda a, b: a * b), F.get(coef, F.lit(0)), lambda s, x: s + x)


def logistic_terms(x: np.ndarray, y: np.ndarray, coef: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """Hessian, gradient and loss of weighted logistic regression, as one matrix; all rows have the same coef."""
    z = np.column_stack([np.ones(len(x)), x])
    score, weight = z @ coef[0], np.where(y > 0.5, w1, w0)
    p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
    loss = np.zeros(z.shape[1])
    loss[0] = weight @ (np.logaddexp(0, score) - y * score)
    return np.column_stack([(z * (weight * p * (1 - p))[:, None]).T @ z, z.T @ (weight * (p - y)), loss])


def newton_step(m: np.ndarray, coef: np.ndarray, best: np.ndarray, best_loss: float, alpha: float, intercept: bool) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(next, best, its loss, length of the step) after the terms at coef; a step that made things worse is halved."""
    penalty = np.full(len(coef), alpha)
    penalty[0] = 0.0
    loss = m[0, -1] + 0.5 * penalty @ (coef * coef)
    if loss > best_loss + 1e-12 * (1 + abs(best_loss)):
        after = (coef + best) / 2
        return after, best, best_loss, float(np.abs(after - best).max())
    free = np.arange(len(coef)) >= (0 if intercept else 1)
    step = np.zeros(len(coef))
    step[free] = np.linalg.lstsq((m[:, :-2] + np.diag(penalty))[np.ix_(free, free)], (m[:, -2] + penalty * coef)[free], rcond=None)[0]
    return coef - step, coef, loss, float(np.abs(step).max())


def fit_logistic(train: DataFrame, task: str = "task", alpha: float = 1.0, balanced: bool = True, intercept: bool = True, tolerance: float = 1e-8, most_rounds: int = 50) -> DataFrame:
    """(task, coef, constant): each task's logistic regression, which minimises the loss plus alpha / 2 |weights|^2.

    balanced gives both classes of a task the same weight in all. A task of one class has no coef but its constant. The
    rows and the models of each round are written to the shared folder; a round is one job over all tasks."""
    rows = written(train.select(task, "features", F.col("label").cast("double").alias("label")).where(f"{task} is not null and features is not null and label is not null"))
    counts = rows.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") > 0.5, 1)).alias("n1"), F.first(F.size("features")).alias("d"))
    one = lambda c: F.col("n") / (2 * c) if balanced else F.lit(1.0)
    zero = F.array_repeat(F.lit(0.0), F.col("d") + 1)
    state = written(counts.where("n1 > 0 and n1 < n").select(task, one(F.col("n") - F.col("n1")).alias("w0"), one(F.col("n1")).alias("w1"), zero.alias("coef"), zero.alias("best"), F.lit(float("inf")).alias("loss"), F.lit(float("inf")).alias("move")))
    alone = written(counts.where("n1 = 0 or n1 = n").select(task, F.when(F.col("n1") > 0, 1.0).otherwise(0.0).alias("constant")))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        coef, best, loss, move = newton_step(matrix_of(pdf), np.asarray(first["coef"]), np.asarray(first["best"]), first["loss"], alpha, intercept)
        return pd.DataFrame({task: pdf[task].iloc[:1], "w0": [first["w0"]], "w1": [first["w1"]], "coef": [coef], "best": [best], "loss": [loss], "move": [move]})

    for _ in range(most_rounds):
        terms = matrix_sums(rows.join(state.where(f"move > {tolerance}").select(task, "coef", "w0", "w1"), task), [task], ["features", "label", "coef", "w0", "w1"], logistic_terms)
        moved = terms.join(state, task).groupBy(task).applyInPandas(step, state.schema)
        after = written(moved.union(state.where(f"move <= {tolerance}")))
        forget(state)
        state = after
        if not state.where(f"move > {tolerance}").limit(1).count():
            break
    forget(rows)
    return state.select(task, "coef", F.lit(None).cast("double").alias("constant")).union(alone.select(task, F.lit(None).cast("array<double>"), "constant"))


def predict_ridge(rows: DataFrame, fitted: DataFrame, task: str = "task") -> DataFrame:
    """rows with pred; null for a task without a model."""
    return rows.join(fitted.select(task, F.col("coef").alias("__coef")), task, "left").withColumn("pred", linear(F.col("features"), F.col("__coef"))).drop("__coef")


def predict_logistic(rows: DataFrame, fitted: DataFrame, task: str = "task") -> DataFrame:
    """rows with pred, the probability of 1; null for a task without a model."""
    joined = rows.join(fitted.select(task, F.col("coef").alias("__coef"), F.col("constant").alias("__constant")), task, "left")
    return joined.withColumn("pred", F.coalesce(1 / (1 + F.exp(-linear(F.col("features"), F.col("__coef")))), "__constant")).drop("__coef", "__constant")


# --- penalties by cross-validation ---------------------------------------------------------------------------------


def squared_error(m: np.ndarray, coef: np.ndarray) -> float:
    """The sum of squared errors of a linear model, from moments."""
    v = np.append(coef, -1.0)
    return float(v @ m @ v)


def ridge_errors(folds: DataFrame, alphas: list[float], task: str = "task", fold: str = "fold") -> DataFrame:
    """(alpha, mse): mean squared error over all held-out rows of all tasks, for each penalty.

    One pass over the rows makes the moments of each task and fold; training moments are those of the other folds, and
    errors follow from moments too, so that a penalty costs no pass."""
    sums = matrix_sums(folds, [task, fold], ["features", "label"], moments)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [matrix_of(p) for _, p in pdf.groupby(fold)]
        total, out = sum(parts), []
        for a in alphas:
            fits = [(p, solve_ridge(total - p, a)) for p in parts if (total - p)[0, 0] > 0]
            out.append((a, sum(squared_error(p, w) for p, w in fits), sum(p[0, 0] for p, _ in fits)))
        return pd.DataFrame(out, columns=["alpha", "error", "n"])

    scored = sums.groupBy(task).applyInPandas(score, "alpha double, error double, n double")
    return scored.groupBy("alpha").agg(F.try_divide(F.sum("error"), F.sum("n")).alias("mse"))


# --- kernels -------------------------------------------------------------------------------------------------------


def rbf(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-np.maximum(square, 0) / (2 * scale * scale))


def inducing_features(rows: DataFrame, points: np.ndarray, scale: float = 1.0, jitter: float = 1e-10) -> DataFrame:
    """rows with features replaced by those whose products are the kernel as seen through the inducing points, and
    `self`, what a row's own variance has beyond it. The points are a bounded, given set."""
    root = np.linalg.inv(np.linalg.cholesky(rbf(points, points, scale) + jitter * np.eye(len(points)))).T

    def run(batches):
        for pdf in batches:
            if len(pdf):
                f = rbf(np.stack(pdf["features"].to_list()).astype(float), points, scale) @ root
                pdf["features"], pdf["self"] = list(f), np.maximum(1 - (f * f).sum(axis=1), 0)
                yield pdf

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("features", "self")]
    named = [f.split(" ")[0] for f in kept]
    return rows.where("features is not null").select(*named, "features").mapInPandas(lambda b: (x[[*named, "features", "self"]] for x in run(b)), ", ".join([*kept, "features array<double>", "self double"]))


def sample_points(rows: DataFrame, key: str, most: int, seed: int = 1) -> np.ndarray:
    """Features of at most `most` rows, a sample by hash of the key: the inducing points."""
    picked = rows.where("features is not null").select("features", F.xxhash64(F.lit(seed), F.col(key)).alias("h"), key).orderBy("h", key).limit(most)
    return np.array([list(r["features"]) for r in picked.select("features").collect()], dtype=float)


def gp_regression(train: DataFrame, test: DataFrame, points: np.ndarray, task: str = "task", scale: float = 1.0, noise: float = 1e-6) -> DataFrame:
    """test with pred: Gaussian-process regression through inducing points, for each task; equal to the full solution
    where all training rows are inducing points."""
    fitted = fit_ridge(inducing_features(train, points, scale), task, noise, intercept=False)
    return predict_ridge(inducing_features(test, points, scale), fitted, task)


def gp_classification(train: DataFrame, test: DataFrame, points: np.ndarray, task: str = "task", scale: float = 1.0) -> DataFrame:
    """test with pred, the probability of 1: Laplace's approximation of a Gaussian process through inducing points, for
    each task. The mode is found by Newton rounds; the probability is averaged over the posterior."""
    fit = inducing_features(train, points, scale)
    fitted = written(fit_logistic(fit, task, 1.0, balanced=False, intercept=False))
    modes = fitted.where("coef is not null").select(task, "coef", F.lit(1.0).alias("w0"), F.lit(1.0).alias("w1"))
    terms = matrix_sums(fit.withColumn("label", F.col("label").cast("double")).select(task, "features", "label").join(modes, task), [task], ["features", "label", "coef", "w0", "w1"], logistic_terms)

    def covariance(pdf: pd.DataFrame) -> pd.DataFrame:
        h = matrix_of(pdf)[1:, 1:-2]
        return pd.DataFrame({task: pdf[task].iloc[:1], "root": [np.linalg.inv(np.linalg.cholesky(np.eye(len(h)) + h)).ravel()]})

    roots = terms.groupBy(task).applyInPandas(covariance, f"{task} {train.schema[task].dataType.simpleString()}, root array<double>")
    nodes, weights = np.polynomial.hermite_e.hermegauss(32)

    def averaged(mean: pd.Series, variance: pd.Series) -> pd.Series:
        f = mean.to_numpy()[:, None] + np.sqrt(np.maximum(variance.to_numpy(), 0))[:, None] * nodes
        return pd.Series(pd.array(np.where(np.isnan(mean.to_numpy()), np.nan, (1 / (1 + np.exp(-np.clip(f, -500, 500)))) @ (weights / weights.sum()))))

    def deviation(features: pd.Series, root: pd.Series) -> pd.Series:
        return pd.Series([((np.asarray(r).reshape(len(f), -1) @ np.asarray(f)) ** 2).sum() if r is not None else np.nan for f, r in zip(features, root, strict=True)])

    from pyspark.sql.functions import pandas_udf

    moved = inducing_features(test, points, scale).join(fitted.select(task, F.col("coef").alias("__coef"), F.col("constant").alias("__constant")), task, "left").join(roots.withColumnRenamed("root", "__root"), task, "left")
    spread = F.col("self") + pandas_udf(deviation, "double")("features", "__root")
    pred = pandas_udf(averaged, "double")(linear(F.col("features"), F.col("__coef")), spread)
    return moved.withColumn("pred", F.coalesce(F.nanvl(pred, F.lit(None).cast("double")), "__constant")).drop("__coef", "__constant", "__root", "self")
