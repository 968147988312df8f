"""Models per task on a table (task, role, key, features, label): linear, trees, neighbours, baselines, networks.

Spark ML fits models over all rows; per-task models of tables that fit a task run in groups, one task each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.rand import shuffle_key, uniform
from gridlark.operators import gaussian


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("__v", array_to_vector(F.col("features").cast("array<double>")))


def ridge(train: DataFrame, test: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Ridge regression over all rows: test with pred. The penalty is scaled so that it is alpha |w|^2 as in sums."""
    from pyspark.ml.regression import LinearRegression

    train = train.where("label is not null")
    n, dev = train.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    if not n:
        return test.withColumn("pred", F.lit(None).cast("double"))
    if not dev:
        return test.withColumn("pred", F.lit(train.agg(F.avg("label")).first()[0]))
    fit = LinearRegression(featuresCol="__v", labelCol="label", predictionCol="pred", regParam=alpha / n * dev, elasticNetParam=0.0, standardization=False, solver="normal").fit(_vectors(train))
    return fit.transform(_vectors(test)).drop("__v")


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight n / (2 n_class)."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    n = n.withColumn("weight", F.sum("__c").over(Window.partitionBy()) / (2 * F.col("__c"))).drop("__c")  # one row a class
    return rows.join(F.broadcast(n), label)


def logistic(train: DataFrame, test: DataFrame, alpha: float = 1.0, balanced: bool = True) -> DataFrame:
    """Logistic regression with C = 1 / alpha: test with pred, the probability of 1. One class gives a constant."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    train = train.where("label is not null")
    n, low, high = train.agg(F.count(F.lit(1)), F.min("label"), F.max("label")).first()
    if not n or low == high:
        return test.withColumn("pred", F.lit(low).cast("double"))
    data = class_weights(train) if balanced else train.withColumn("weight", F.lit(1.0))
    fit = LogisticRegression(featuresCol="__v", labelCol="label", weightCol="weight", regParam=alpha / n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(_vectors(data))
    return fit.transform(_vectors(test)).withColumn("pred", F.get(vector_to_array("probability"), F.lit(1))).drop("__v", "rawPrediction", "probability", "prediction")


def fit_linear_svm(train: DataFrame, penalty: float = 1.0):
    """A linear support-vector machine on rows with vectors (__v); the penalty is that of a sum over rows."""
    from pyspark.ml.classification import LinearSVC

    n = max(train.where("label is not null").count(), 1)
    return LinearSVC(featuresCol="__v", labelCol="label", regParam=1.0 / (penalty * n), maxIter=200, tol=1e-7, standardization=False).fit(train.where("label is not null"))


def linear_svm(train: DataFrame, test: DataFrame, penalty: float = 1.0) -> DataFrame:
    """Support-vector machine: test with pred, the distance from the separating plane. One class gives a constant."""
    from pyspark.ml.functions import vector_to_array

    low, high = train.agg(F.min("label"), F.max("label")).first()
    if low == high:
        return test.withColumn("pred", F.lit(low).cast("double"))
    fitted = fit_linear_svm(_vectors(train), penalty).transform(_vectors(test))
    return fitted.withColumn("pred", F.get(vector_to_array("rawPrediction"), F.lit(1))).drop("__v", "rawPrediction", "prediction")


def forest(train: DataFrame, test: DataFrame, trees: int = 100, depth: int = 8, regression: bool = False, seed: int = 1) -> DataFrame:
    """Random forest with balanced weights: test with pred. One class gives a constant."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    train = train.where("label is not null")
    n, low, high = train.agg(F.count(F.lit(1)), F.min("label"), F.max("label")).first()
    if not n or low == high:
        return test.withColumn("pred", F.lit(low).cast("double"))
    if regression:
        fit = RandomForestRegressor(featuresCol="__v", labelCol="label", predictionCol="pred", numTrees=trees, maxDepth=depth, seed=seed).fit(_vectors(train))
        return fit.transform(_vectors(test)).drop("__v")
    fit = RandomForestClassifier(featuresCol="__v", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(_vectors(class_weights(train)))
    return fit.transform(_vectors(test)).withColumn("pred", F.get(vector_to_array("probability"), F.lit(1))).drop("__v", "rawPrediction", "probability", "prediction")


def constant(rows: DataFrame, by: list[str], train: str = "role = 'train'") -> DataFrame:
    """Rows with pred: the group's mean label in training, else the mean over all training rows."""
    fit = rows.where(train).groupBy(*by).agg(F.avg("label").alias("pred"))
    whole = rows.where(train).agg(F.avg("label").alias("__all"))
    return rows.join(fit, by, "left").crossJoin(F.broadcast(whole)).withColumn("pred", F.coalesce("pred", "__all")).drop("__all")


def random_guess(rows: DataFrame, by: list[str], keys: list[str], seed: int, train: str = "role = 'train'") -> DataFrame:
    """Rows with pred 0 or 1, drawn with the training rate of positives."""
    rate = rows.where(train).groupBy(*by).agg(F.avg(F.when(F.col("label") == 1, 1.0).otherwise(0.0)).alias("__rate"))
    return rows.join(rate, by, "left").withColumn("pred", F.when(uniform(seed, *keys) < F.coalesce("__rate", F.lit(0.0)), 1.0).otherwise(0.0)).drop("__rate")


def warmup_rate(step: int, warmup: int, total: int, low: float, high: float, final: float) -> float:
    """Learning rate that grows linearly over the first steps and falls exponentially after."""
    if step <= warmup:
        return low + (high - low) * step / max(warmup, 1)
    return high * (final / high) ** ((step - warmup) / max(total - warmup, 1))


def train_network(x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, hidden: int = 50, layers: int = 3, epochs: int = 5, rate: float = 1e-3, batch: int = 64, dropout: float = 0.1, decay: float = 0.0, regression: bool = False, seed: int = 0, warmup: int = 0, history: list | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """A feed-forward network on several tasks, NaN labels left out, by Adam; the epoch of least validation loss is kept.

    A given `history` list gets (epoch, validation loss)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    sizes = [x.shape[1], *([hidden] * layers), y.shape[1]]
    w = [[rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)] for a, b in zip(sizes, sizes[1:], strict=False)]
    flat = [p for pair in w for p in pair]
    m, v, t = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], 0

    def forward(x: np.ndarray, train: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
        acts, masks = [x], []
        for k, (a, b) in enumerate(w):
            z = acts[-1] @ a + b
            if k < len(w) - 1:
                z = np.maximum(z, 0)
                keep = (rng.random(z.shape) >= dropout) / (1 - dropout) if train and 0 < k < len(w) - 1 and dropout else np.ones_like(z)
                masks.append(keep)
                z = z * keep
            acts.append(z)
        return acts, masks

    def loss(x: np.ndarray, y: np.ndarray) -> float:
        z, seen = forward(x)[0][-1], ~np.isnan(y)
        if not seen.any():
            return float("inf")
        z, y = z[seen], y[seen]
        return float(np.mean((z - y) ** 2 if regression else np.logaddexp(0, z) - y * z))

    best, kept, steps = None, None, epochs * max(1, -(-len(x) // batch))
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            part = order[at : at + batch]
            acts, masks = forward(x[part], True)
            seen = ~np.isnan(y[part])
            z = acts[-1]
            g = np.where(seen, (2 * (z - np.nan_to_num(y[part])) if regression else 1 / (1 + np.exp(-np.clip(z, -50, 50))) - np.nan_to_num(y[part])) / max(seen.sum(), 1), 0)
            grads = []
            for k in range(len(w) - 1, -1, -1):
                grads = [acts[k].T @ g + decay * w[k][0], g.sum(axis=0), *grads]
                if k:
                    g = (g @ w[k][0].T) * masks[k - 1] * (acts[k] > 0)
            t += 1
            lr = warmup_rate(t, warmup, steps, rate / 10, rate, rate / 10) if warmup else rate
            for k, (p, d) in enumerate(zip(flat, grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p -= lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        now = loss(xv, yv) if len(xv) else loss(x, y)
        if history is not None:
            history.append((epoch, now))
        if best is None or now < best:
            best, kept = now, [p.copy() for p in flat]
    for p, k in zip(flat, kept or flat, strict=True):
        p[...] = k

    def predict(x: np.ndarray) -> np.ndarray:
        z = forward(x)[0][-1]
        return z if regression else 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    return predict


def network_per_task(rows: DataFrame, task: str, key: str, members: int = 1, **how) -> DataFrame:
    """(task, key, pred, spread): an ensemble of networks for each task, trained on role train, chosen on role val.

    A task's rows go to one Python worker, so this is for tasks that fit it; `ridge` and `logistic` have no such bound."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["features"].to_list()).astype(float)
        y = pdf["label"].to_numpy(dtype=float)[:, None]
        fit, val, out = (pdf["role"].to_numpy() == r for r in ("train", "val", "test"))
        p = np.stack([train_network(x[fit], y[fit], x[val], y[val], seed=s, **how)(x[out])[:, 0] for s in range(members)]) if fit.any() and out.any() else np.full((1, int(out.sum())), np.nan)
        return pd.DataFrame({task: pdf[task][out], key: pdf[key][out], "pred": p.mean(axis=0), "spread": p.std(axis=0)})

    return rows.select(task, key, "role", "features", "label").groupBy(task).applyInPandas(run, f"{task} {kind[task]}, {key} {kind[key]}, pred double, spread double")


#: Rows of a task, training and test, whose kernel matrix a worker holds.
GP_ROWS = 4096


def gaussian_process(rows: DataFrame, task: str, key: str, scale: float = 1.0, noise: float = 1e-6) -> DataFrame:
    """(task, key, pred): regression with an RBF kernel for each task, on all its training rows.

    A task of up to GP_ROWS rows is solved in one worker; larger ones, one after another, in blocks, where a key tells
    rows apart and rows without features have no part."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    used = rows.select(task, key, "role", "features", "label").where("role in ('train', 'test')")
    large = [r[0] for r in used.groupBy(task).count().where(F.col("count") > GP_ROWS).select(task).collect()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(pdf["features"].to_list()).astype(float), pdf["label"].to_numpy(dtype=float)
        fit, out = (pdf["role"].to_numpy() == "train") & ~np.isnan(y), pdf["role"].to_numpy() == "test"
        pred = gaussian.rbf(x[out], x[fit], scale) @ np.linalg.solve(gaussian.rbf(x[fit], x[fit], scale) + noise * np.eye(int(fit.sum())), y[fit]) if fit.any() else np.full(int(out.sum()), np.nan)
        return pd.DataFrame({task: pdf[task][out], key: pdf[key][out], "pred": pred})

    is_large = reduce(lambda a, t: a | F.col(task).eqNullSafe(F.lit(t)), large, F.lit(False))
    found = used.where(~is_large).groupBy(task).applyInPandas(run, f"{task} {kind[task]}, {key} {kind[key]}, pred double")
    for t in large:
        own = used.where(F.col(task).eqNullSafe(F.lit(t)))
        train = own.where("role = 'train' and features is not null and label is not null and not isnan(label)")
        test = own.where("role = 'test'").select(F.col(key).alias("key"), F.col("features").alias("x"))
        if train.limit(1).count():
            train = train.select(F.xxhash64(key).alias("h"), F.col("features").alias("x"), F.col("label").cast("double").alias("y"))
            preds = gaussian.predicted(test.where("x is not null"), gaussian.solve(train, scale, noise), scale)
        else:
            preds = test.select("key", F.lit(float("nan")).alias("pred"))
        found = found.union(preds.select(F.lit(t).cast(kind[task]).alias(task), F.col("key").alias(key), "pred"))
    return found


def balanced_sampler_weights(rows: DataFrame, task: str, key: str) -> DataFrame:
    """(key, weight): mean over tasks of 0.5 / class size, normalised by task; rows without a label count 0."""
    per = Window.partitionBy(task, "label")
    w = rows.withColumn("w", F.when(F.col("label").isNull(), 0.0).otherwise(0.5 / F.count(F.lit(1)).over(per)))
    w = w.withColumn("w", F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy(task))))
    return w.groupBy(key).agg(F.avg("w").alias("weight"))


def weighted_draws(rows: DataFrame, key: str, weight: str, n: int, seed: int, ranges: int = 256) -> DataFrame:
    """(key, draws): how often each row is drawn when n are drawn with replacement, in proportion to whole weights.

    Rows are laid out by a hash of seed and key, each as long as its weight, and n points of equal distance are set on
    the line: the total is exact, a row's share is off by less than one draw. Running sums are taken within `ranges`
    ranges of the hash and shifted by those of the ranges before, so that no task sees all rows. Rows without a positive
    weight are never drawn."""
    h = shuffle_key(seed, key)
    laid = rows.where(F.col(weight) > 0).select(key, F.col(weight).cast("decimal(20,0)").alias("__w"), h.alias("__h"), F.floor(F.conv(F.substring(h, 1, 6), 16, 10).cast("long") * ranges / F.lit(1 << 24)).alias("__range"))
    sizes = laid.groupBy("__range").agg(F.sum("__w").alias("__size"))
    every = Window.partitionBy()  # at most `ranges` rows
    before = sizes.select("__range", (F.sum("__size").over(every.orderBy("__range")) - F.col("__size")).alias("__before"), F.sum("__size").over(every).alias("__total"))
    upto = F.col("__before") + F.sum("__w").over(Window.partitionBy("__range").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = laid.join(F.broadcast(before), "__range").withColumn("__upto", upto.cast("decimal(26,0)")).withColumn("__total", F.col("__total").cast("decimal(26,0)"))
    # points lie half a step in: floor((2 n at + total) / (2 total)) of them are before a place
    points = lambda at: F.expr(f"(cast({2 * n} as decimal(12,0)) * ({at}) + __total) div (2 * __total)")
    drawn = lines.select(key, (points("__upto") - points("__upto - __w")).alias("draws"))
    return drawn.where("draws > 0")


def loss_curve(rows: DataFrame, task: str, epochs: int, **how) -> DataFrame:
    """(task, epoch, loss): validation loss of each task's network."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, seen = np.stack(pdf["features"].to_list()).astype(float), pdf["label"].to_numpy(dtype=float)[:, None], []
        fit, val = (pdf["role"].to_numpy() == r for r in ("train", "val"))
        train_network(x[fit], y[fit], x[val], y[val], epochs=epochs, history=seen, **how)
        return pd.DataFrame({task: [pdf[task].iloc[0]] * len(seen), "epoch": [e for e, _ in seen], "loss": [v for _, v in seen]})

    return rows.select(task, "role", "features", "label").groupBy(task).applyInPandas(run, f"{task} {kind[task]}, epoch int, loss double")


def best_epoch(curve: DataFrame, task: str) -> DataFrame:
    """(task, epoch) of least loss."""
    return curve.groupBy(task).agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("epoch"))


def ensemble(predictions: DataFrame, by: list[str]) -> DataFrame:
    """(by, pred, spread): mean and population deviation over the members."""
    return predictions.groupBy(*by).agg(F.avg("pred").alias("pred"), F.stddev_pop("pred").alias("spread"))


def tune_linear(folds: list[tuple[DataFrame, DataFrame]], powers: list[int], fit: Callable = ridge) -> dict[int, float]:
    """Mean squared error over the folds for each penalty 10 ** power; the caller takes the least."""
    return {p: sum(fit(a, b, 10.0**p).agg(F.avg((F.col("pred") - F.col("label")) ** 2)).first()[0] or 0.0 for a, b in folds) / max(len(folds), 1) for p in powers}


def save_model(model, path: str) -> None:
    """Writes a fitted Spark ML model to a folder that Spark can reach."""
    model.write().overwrite().save(path)


def load_model(kind: type, path: str):
    return kind.load(path)
