"""Places, running sums and chance-adjusted agreement against plain loops, with ties, nulls and one large group."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from math import exp, lgamma, log

import pytest
from pyspark.sql import functions as F

from gridlark.operators import cluster, metrics, models, ranges, splits
from gridlark.sources import files


def test_running_before(spark):
    r = random.Random(1)
    values = r.sample(range(100_000), 3000)
    rows = [("big" if i % 4 else r.choice(["b", None]), float(v) if i % 7 else -float(v), r.randint(0, 5)) for i, v in enumerate(values)] + [("big", None, 2), ("b", float("inf"), 3)]
    df = spark.createDataFrame(rows, "g string, x double, n int").repartition(5)
    for down in (False, True):
        groups = defaultdict(list)
        for g, x, n in rows:
            groups[g].append((-1e18 if x is None else x, x, n))
        want = Counter()
        for g, found in groups.items():
            total = 0
            for _, x, n in sorted(found, key=lambda v: v[0], reverse=down):
                want[g, x, n, total] += 1
                total += n
        got = ranges.running_before(df, ["g"], "x", ["n"], descending=down)
        assert Counter(map(tuple, got.select("g", "x", "n", "n_before").collect())) == want
        widest = got.rdd.getNumPartitions()
        assert widest >= 1
    assert ranges.running_before(df.where("false"), ["g"], "x", ["n"]).count() == 0


def test_numbered_and_crossed(spark, monkeypatch):
    df = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)], "k int, place string").repartition(6)
    assert all(r.k == r.at for r in ranges.numbered(df, ["k"], "at").collect())
    assert ranges.numbered(df.where("false"), ["k"], "at").count() == 0
    small = spark.createDataFrame([(t, f) for t in (0, 1) for f in range(5)], "t int, f int")
    rows = df.select("k", (F.col("k") % 3).alias("t"))
    whole = Counter(map(tuple, ranges.crossed(rows, small, "t").select("k", "t", "f").collect()))
    monkeypatch.setattr(ranges, "MOST_BROADCAST", 3)
    assert Counter(map(tuple, ranges.crossed(rows, small, "t").select("k", "t", "f").collect())) == whole
    assert len(whole) == 5 * sum(1 for i in range(1000) if i % 3 < 2)


def test_fold_roles_cut_at_the_share(spark):
    rows = spark.createDataFrame([(i, i % 20) for i in range(2000)], "id int, axis int")
    folds = splits.kfold(rows, "axis", 4)
    got = splits.fold_roles(rows, folds, "axis", ["id"], 0.1).groupBy("fold", "role").count().collect()
    assert {(r["fold"], r["role"]): r["count"] for r in got} == {(f, role): n for f in range(4) for role, n in (("test", 500), ("train", 1350), ("val", 150))}


def test_auc_of_continuous_scores(spark):
    r = random.Random(4)
    rows = [("a", float(r.random() < 0.3), round(r.random(), 3)) for _ in range(2000)] + [("one", 1.0, 0.5)]
    df = spark.createDataFrame(rows, "g string, label double, pred double").repartition(4)
    got = {x.g: x for x in metrics.evaluate(df, ["g"], ("auc_roc", "avg_pr")).collect()}
    pos, neg = ([p for g, y, p in rows if g == "a" and y == v] for v in (1.0, 0.0))
    assert got["a"].auc_roc == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))
    assert got["one"].auc_roc is None and got["one"].avg_pr == 1.0


def test_adjusted_mutual_information(spark, monkeypatch):
    monkeypatch.setattr(cluster, "STRETCH", 7)
    r = random.Random(5)
    rows = [(r.randint(0, 4), 0) for _ in range(160)]
    rows = [(a, a % 3 if r.random() < 0.6 else r.randint(0, 3)) for a, _ in rows] + [(None, 1), (2, None)]
    known = [x for x in rows if None not in x]
    n, cells, left, right = len(known), Counter(known), Counter(a for a, _ in known), Counter(b for _, b in known)
    mutual = sum(c / n * log(n * c / (left[a] * right[b])) for (a, b), c in cells.items())
    expected = 0.0
    for p in left.values():
        for q in right.values():
            for k in range(max(1, p + q - n), min(p, q) + 1):
                expected += k / n * log(n * k / (p * q)) * exp(lgamma(p + 1) + lgamma(q + 1) + lgamma(n - p + 1) + lgamma(n - q + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(p - k + 1) - lgamma(q - k + 1) - lgamma(n - p - q + k + 1))
    h = [-sum(v / n * log(v / n) for v in s.values()) for s in (left, right)]
    ami = lambda x: cluster.adjusted_mutual_information(spark.createDataFrame(x, "a int, b int"), "a", "b").first().ami
    assert ami(rows) == pytest.approx((mutual - expected) / (sum(h) / 2 - expected))
    assert ami([(1, 1), (2, 2)]) == pytest.approx(1.0) and ami([(1, 1), (1, 1)]) == 1.0 and ami([]) is None


def test_configs_and_arguments(spark, tmp_path):
    text = '{"universal_args": {"seed": [1, 2], "model": ["knn"], "debug": [true]}, "iterative_args": [{"k": [1, 3, 5]}, {"model": ["ridge", "rf"], "note": [null], "debug": [false]}]}'
    lines = sorted(files.flags(r) for r in files.expand_config(text))
    assert len(lines) == 10 and lines[0] == "--debug --k 1 --model knn --seed 1" and lines[-1] == "--model ridge --seed 2"
    files.write_json(spark, {"k": 3, "alpha": 10}, f"{tmp_path}/params")
    assert {"k": 7, "name": "base"} | files.read_json(spark, f"{tmp_path}/params") == {"k": 3, "name": "base", "alpha": 10}
    rates = [models.warmup_rate(s, 10, 50, 1e-4, 1e-3, 1e-5) for s in range(51)]
    assert rates[0] == pytest.approx(1e-4) and rates[10] == pytest.approx(1e-3) and rates[50] == pytest.approx(1e-5) and rates[30] == pytest.approx(1e-4)
