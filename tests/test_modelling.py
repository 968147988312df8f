"""Models fitted across tasks against closed forms and single-process runs, on odd rows too."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gridlark.operators import models, network, pertask, scaling, search, steps

SCHEMA = "task string, key long, features array<double>, label double, fold int"


@pytest.fixture(scope="module")
def cells():
    """(task, key, features, label, fold): four tasks, one of a single class, one of two rows; null labels and features."""
    rng = np.random.default_rng(4)
    out = []
    for t, n in (("a", 400), ("b", 90), ("one", 20), ("tiny", 2)):
        w = rng.normal(size=5)
        x = rng.normal(size=(n, 5)) + 3
        for i in range(n):
            label = 1.0 if t == "one" else float(i % 2) if t == "tiny" else float((x[i] - 3) @ w + rng.normal() > 0.5)
            out.append((t, i, x[i].tolist(), None if i % 9 == 8 else label, i % 3))
    return [*out, ("a", 9001, None, 1.0, 0), (None, 9002, [1.0] * 5, 1.0, 1), ("empty", 9003, [1.0] * 5, None, 0)]


@pytest.fixture(scope="module")
def rows(spark, cells):
    return spark.createDataFrame(cells, SCHEMA).repartition(7).cache()


def arrays(cells, task):
    seen = [(x, y) for t, _, x, y, _ in cells if t == task and x is not None and y is not None]
    return np.array([x for x, _ in seen]), np.array([y for _, y in seen])


def test_ridge_per_task(rows, cells):
    for alpha in (0.0, 1.0, 30.0):
        got = {r["task"]: np.array(r["coef"]) for r in pertask.fit_ridge(rows, alpha=alpha).collect()}
        assert set(got) == {"a", "b", "one", "tiny"}
        for t in ("a", "b", "one") if alpha == 0 else got:
            x, y = arrays(cells, t)
            c = x - x.mean(axis=0)
            w = np.linalg.solve(c.T @ c + alpha * np.eye(5), c.T @ (y - y.mean()))
            assert np.allclose(got[t], np.append(y.mean() - x.mean(axis=0) @ w, w), atol=1e-7)
    pred = pertask.predict_ridge(rows, pertask.fit_ridge(rows))
    assert pred.where("task = 'empty' and pred is not null").count() == 0 and pred.count() == len(cells)
    assert pertask.fit_ridge(rows.where("false")).count() == 0


def newton(x, y, alpha, balanced, intercept=True):
    z = np.column_stack([np.ones(len(x)), x]) if intercept else x
    s = np.where(y > 0.5, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1))) if balanced else np.ones(len(y))
    pen = np.full(z.shape[1], alpha)
    pen[0] = 0 if intercept else alpha
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (s * p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (s * (p - y)) + pen * w)
    return w


def test_logistic_per_task(rows, cells):
    for alpha, balanced in ((1.0, True), (0.01, False)):
        fitted = pertask.fit_logistic(rows, alpha=alpha, balanced=balanced)
        got = {r["task"]: r for r in fitted.collect()}
        assert set(got) == {"a", "b", "one", "tiny"}
        assert got["one"]["coef"] is None and got["one"]["constant"] == 1.0
        for t in ("a", "b", "tiny"):
            assert np.allclose(got[t]["coef"], newton(*arrays(cells, t), alpha, balanced), atol=1e-6)
    p = {(r["task"], r["key"]): r["pred"] for r in pertask.predict_logistic(rows, fitted).collect()}
    assert p["one", 1] == 1.0 and p["empty", 9003] is None and p["a", 9001] is None and 0 < p["a", 0] < 1


def test_ridge_errors(rows, cells):
    alphas = [0.1, 10.0]
    got = {r["alpha"]: r["mse"] for r in pertask.ridge_errors(rows.where("task in ('a', 'b')"), alphas).collect()}
    for alpha in alphas:
        errors = []
        for t in ("a", "b"):
            seen = [(x, y, f) for u, _, x, y, f in cells if u == t and x is not None and y is not None]
            for fold in range(3):
                x, y = (np.array([r[k] for r in seen if r[2] != fold]) for k in (0, 1))
                c = x - x.mean(axis=0)
                w = np.linalg.solve(c.T @ c + alpha * np.eye(5), c.T @ (y - y.mean()))
                errors += [(y.mean() + (np.array(v) - x.mean(axis=0)) @ w - u) ** 2 for v, u, g in seen if g == fold]
        assert math.isclose(got[alpha], np.mean(errors), rel_tol=1e-8)


def test_gaussian_processes_are_full_with_all_points(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.7).astype(float)
    xt = rng.normal(size=(15, 3))
    make = lambda a, b: spark.createDataFrame([("t", i, v.tolist(), float(u)) for i, (v, u) in enumerate(zip(a, b, strict=True))], "task string, key long, features array<double>, label double")
    train, test = make(x, y).repartition(4), make(xt, np.zeros(15))
    k, kt = pertask.rbf(x, x, 1.0), pertask.rbf(xt, x, 1.0)
    got = {r["key"]: r["pred"] for r in pertask.gp_regression(train, test, x, noise=0.1).collect()}
    assert np.allclose([got[i] for i in range(15)], kt @ np.linalg.solve(k + 0.1 * np.eye(40), y), atol=1e-5)
    # Laplace, in the function's own values
    f = np.zeros(40)
    for _ in range(100):
        p = 1 / (1 + np.exp(-f))
        w = p * (1 - p)
        b = w * f + y - p
        root = np.sqrt(w)
        inner = np.eye(40) + root[:, None] * k * root[None, :]
        f = k @ (b - root * np.linalg.solve(inner, root * (k @ b)))
    p = 1 / (1 + np.exp(-f))
    root = np.sqrt(p * (1 - p))
    mean = kt @ (y - p)
    variance = 1 - np.einsum("ij,ij->i", kt * root, np.linalg.solve(np.eye(40) + root[:, None] * k * root[None, :], (kt * root).T).T)
    nodes, weights = np.polynomial.hermite_e.hermegauss(32)
    want = (1 / (1 + np.exp(-(mean[:, None] + np.sqrt(variance)[:, None] * nodes)))) @ (weights / weights.sum())
    got = {r["key"]: r["pred"] for r in pertask.gp_classification(train, test, x).collect()}
    assert np.allclose([got[i] for i in range(15)], want, atol=1e-4)
    few = pertask.sample_points(train, "key", 20)
    assert few.shape == (20, 3)
    near = {r["key"]: r["pred"] for r in pertask.gp_regression(train, test, few, noise=0.1).collect()}
    assert np.corrcoef([near[i] for i in range(15)], kt @ np.linalg.solve(k + 0.1 * np.eye(40), y))[0, 1] > 0.9


def labelled(rng, n=300, d=6, tasks=3):
    x = rng.normal(size=(n, d))
    y = (x @ rng.normal(size=(d, tasks)) > 0).astype(float)
    y[rng.random(y.shape) < 0.3] = np.nan
    return x, y


def lists(a):
    return [[None if math.isnan(v) else float(v) for v in r] for r in a]


def test_networks_equal_a_single_process(spark):
    rng = np.random.default_rng(8)
    x, y = labelled(rng)
    role = np.array(["train"] * 200 + ["val"] * 60 + ["test"] * 40)
    df = spark.createDataFrame([(i, a, b, r) for i, (a, b, r) in enumerate(zip(lists(x), lists(y), role.tolist(), strict=True))], "key long, features array<double>, labels array<double>, role string").repartition(6)
    ids = np.array([r["h"] for r in df.select("key", F.xxhash64("key").alias("h")).orderBy("key").collect()]).view(np.uint64)
    nets = [network.Network((6,), 3, hidden=8, layers=3, dropout=0.2, decay=1e-3, rate=5e-2, warmup=2, seed=s) for s in (1, 2)]
    fitted = network.fit_networks(df, nets, "key", ["features"], epochs=6, batches=1)
    for net, got in zip(nets, fitted, strict=True):
        flat, adam, curve, best = net.start(), network.Adam(net, 6), [], None
        for epoch in range(7):
            if epoch:
                part = role == "train"
                flat = adam.move(flat, network.gradient(net, flat, [x[part]], y[part], ids[part], epoch - 1))
            loss, seen, _ = network.loss_and_slope(net, network.forward(net, flat, [x[role == "val"]])[0], y[role == "val"])
            if not curve or loss / seen < min(curve):
                best = flat
            curve.append(loss / seen)
        assert np.allclose(got.history, curve, atol=1e-9) and np.allclose(got.weights, best, atol=1e-8)
        assert min(curve) < curve[0]
    two = network.fit_networks(df, nets[:1], "key", ["features"], epochs=8, batches=3)
    assert len(two[0].history) == 9 and min(two[0].history) < min(fitted[0].history)
    p = {r["key"]: r["pred"] for r in network.predict_networks(df.where("role = 'test'"), two, "key", ["features"]).collect()}
    hits = np.mean([(p[i][t] > 0.5) == y[i, t] for i in p for t in range(3) if not math.isnan(y[i, t])])
    assert len(p) == 40 and hits > 0.75


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    for net, inputs in ((network.Network((4,), 2, hidden=5, layers=3, dropout=0.3, seed=1), [rng.normal(size=(20, 4))]), (network.Network((4, 3), 2, hidden=5, layers=2, regression=True, dropout=0.0, seed=2), [rng.normal(size=(20, 4)), rng.normal(size=(20, 3))])):
        y = np.where(rng.random((20, 2)) < 0.2, np.nan, rng.integers(0, 2, (20, 2)))
        ids, flat = rng.integers(0, 2**63, 20).astype(np.uint64), net.start()
        got = network.gradient(net, flat, inputs, y, ids, 5)
        for k in rng.integers(0, len(flat), 40):
            step = np.zeros(len(flat))
            step[k] = 1e-6
            up, down = (network.gradient(net, flat + s, inputs, y, ids, 5)[-2] for s in (step, -step))
            assert math.isclose((up - down) / 2e-6, got[k], rel_tol=1e-4, abs_tol=1e-5)


def test_two_towers_learn_what_a_rate_cannot(spark):
    """Labels follow from the product of both axes: held-out items are predicted, where a task's rate knows nothing."""
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(120, 4)), rng.normal(size=(12, 4))
    mix = rng.normal(size=(4, 4))
    cells = [(f"{i}:{j}", j, a[i].tolist(), b[j].tolist(), [float(a[i] @ mix @ b[j] > 0)], "test" if i % 4 == 0 else "val" if i % 4 == 1 else "train") for i in range(120) for j in range(12)]
    df = spark.createDataFrame(cells, "key string, sub int, a array<double>, b array<double>, labels array<double>, role string").repartition(4)
    fitted = network.fit_networks(df, [network.Network((4, 4), 1, hidden=16, layers=2, dropout=0.0, rate=3e-2, seed=1)], "key", ["a", "b"], epochs=40)
    test = df.where("role = 'test'").select("key", F.get("labels", F.lit(0)).alias("label"))
    pred = network.predict_networks(df.where("role = 'test'"), fitted, "key", ["a", "b"]).select("key", F.get("pred", F.lit(0)).alias("p"))
    rate = models.constant(df.select("key", "sub", "role", F.get("labels", F.lit(0)).alias("label")), ["sub"]).where("role = 'test'").select("key", F.col("pred").alias("rate"))
    hits = test.join(pred, "key").join(rate, "key").agg(F.avg(((F.col("p") > 0.5) == (F.col("label") == 1)).cast("int")), F.avg(((F.col("rate") > 0.5) == (F.col("label") == 1)).cast("int"))).first()
    assert hits[0] > 0.85 and hits[0] > hits[1] + 0.2


def test_search_learns():
    space = search.SEARCH_SPACES["network"]

    def score(trials):
        return [(math.log10(t["rate"]) + 3.4) ** 2 + (t["hidden"] - 50) ** 2 / 900 + abs(t["dropout"] - 0.05) * 5 + (t["layers"] - 2) ** 2 / 4 for t in trials]

    a, b = search.search(space, score, rounds=8, per_round=6, seed=3), search.search(space, score, rounds=8, per_round=6, seed=3)
    assert a == b and len(a) == 48
    assert all(space[k].low <= v <= space[k].high for t, _ in a for k, v in t.items())
    assert all((t["hidden"] - 10) % 20 == 0 and isinstance(t["layers"], int) for t, _ in a)
    mean = lambda learn: np.mean([search.best_trial(search.search(space, score, rounds=8, per_round=6, seed=s, learn=learn))[1] for s in range(20)])
    assert mean(True) < mean(False)
    odd = search.search({"k": search.Range(1, 3, 1)}, lambda t: [float("nan")] * len(t), rounds=5, per_round=4, seed=1)
    assert {t["k"] for t, _ in odd} <= {1, 2, 3}


def test_fitted_steps(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = np.abs(rng.normal(size=(80, 8))) * np.array([1, 0.1, 2, 0.05, 1, 0, 3, 0.3])
    df = spark.createDataFrame([(i, v.tolist(), float(v[0] > 0.6)) for i, v in enumerate(x)], "id long, x array<double>, label double").withColumn("features", array_to_vector("x")).repartition(3)
    train, rest = df.where("id < 60"), df.where("id >= 60")
    long = scaling.long_form(train, "id", "x", "label")
    for rule, how, want in (("variance", {"threshold": 0.05}, scaling.variance_select(long, 0.05)), ("chi2", {"most": 3}, scaling.chi2_select(long, "label", 3))):
        fitted = Pipeline(stages=[steps.DimensionSelector(rule=rule, **how), steps.VectorScaler(inputCol="selected")]).fit(train)
        fitted.write().overwrite().save(str(tmp_path / rule))
        kept = sorted(r["dim"] for r in want.collect())
        loaded = PipelineModel.load(str(tmp_path / rule))
        assert loaded.stages[0].getOrDefault("kept") == kept
        dev = x[:60, kept].std(axis=0)
        scaled = (x[:, kept] - x[:60, kept].mean(axis=0)) / np.where(dev > 0, dev, 1)
        for r in loaded.transform(rest).select("id", vector_to_array("scaled").alias("v")).collect():
            assert np.allclose(r["v"], scaled[r["id"]], atol=1e-9)
    assert steps.DimensionSelector(rule="chi2").copy().getOrDefault("most") == 30


def test_weighted_draws(spark):
    df = spark.createDataFrame([(i, i % 4, "x") for i in range(400)] + [(1000, None, "x"), (1001, 100, "x")], "key long, weight int, draws string").repartition(5)
    got = {r["key"]: r["draws"] for r in models.weighted_draws(df, "key", "weight", 3000, 5).collect()}
    again = {r["key"]: r["draws"] for r in models.weighted_draws(df.repartition(2), "key", "weight", 3000, 5).collect()}
    total = sum(i % 4 for i in range(400)) + 100
    assert got == again and sum(got.values()) == 3000 and 1000 not in got and not any(k < 400 and k % 4 == 0 for k in got)
    assert all(abs(got.get(k, 0) - 3000 * w / total) < 1 for k, w in [(i, i % 4) for i in range(400)] + [(1001, 100)])
    few = Counter(r["draws"] for r in models.weighted_draws(df, "key", "weight", 10, 5).collect())
    assert sum(k * v for k, v in few.items()) == 10


def test_networks_are_saved_whole(spark, tmp_path):
    made = [network.Trained(network.Network((4, 3), 2, hidden=5, layers=2, seed=s), network.Network((4, 3), 2, hidden=5, layers=2, seed=s).start(), [0.7, 0.6], 1) for s in (1, 2)]
    network.save_networks(made, spark, str(tmp_path / "nets"))
    for a, b in zip(made, network.load_networks(spark, str(tmp_path / "nets")), strict=True):
        assert a.network == b.network and np.array_equal(a.weights, b.weights) and (a.history, a.best_epoch) == (b.history, b.best_epoch)
    assert network.loss_history(made, spark).where("best").count() == 2


def test_ridge_on_outer_products(spark):
    """Products of the strong dimensions, centred and projected, then a ridge: as numpy has it, whatever the signs."""
    rng = np.random.default_rng(12)
    a, b = rng.normal(size=(60, 5)) * [1, 0.01, 2, 1, 0.5], rng.normal(size=(60, 4)) * [1, 1, 0.02, 3]
    y = a[:, 0] * b[:, 3] + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist(), "t", float(y[i])) for i in range(60)], "key long, a array<double>, b array<double>, task string, label double")
    crossed = scaling.outer_features(df, "a", "b", "key", "key < 50", 0.1, 6).withColumnRenamed("components", "features")
    rows = df.select("key", "task", "label").join(crossed, "key")
    got = {r["key"]: r["pred"] for r in pertask.predict_ridge(rows, pertask.fit_ridge(rows.where("key < 50"), alpha=0.5)).collect()}
    x = np.einsum("ni,nj->nij", a[:, [0, 2, 3, 4]], b[:, [0, 1, 3]]).reshape(60, -1)
    x = x - x.mean(axis=0)
    x = x @ np.linalg.svd(x, full_matrices=False)[2][:6].T
    c, m = x[:50] - x[:50].mean(axis=0), y[:50].mean()
    w = np.linalg.solve(c.T @ c + 0.5 * np.eye(6), c.T @ (y[:50] - m))
    assert np.allclose([got[i] for i in range(60)], (x - x[:50].mean(axis=0)) @ w + m, atol=1e-6)
