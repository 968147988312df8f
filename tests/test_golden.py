"""Hand-checkable cases and properties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.functions import text as tx
from gridlark.operators import cluster, metrics, models, msa, neighbors, report, reshape, scaling, splits
from gridlark.sources import files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize(("a", "b", "want"), [("AC-D", "AG-E", 2 / 3), ("--", "AB", 1.0), ("ACDEF", "ACD", 0.0)])
def test_hamming(spark, a, b, want):
    assert one(spark, tx.hamming_fraction(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_alphabet(spark):
    assert one(spark, tx.alphabet_codes(F.col("s")), s="AXOUBZ-") == [0, 20, 11, 4, 20, 20, 20]


def test_tanimoto():
    v = lambda s: np.array([float(c) for c in s])
    d = neighbors.DISTANCES["tanimoto"]
    assert d(v("1100")[None], v("1000")[None])[0, 0] == 2
    assert d(v("1100")[None], v("0001")[None])[0, 0] == 10000
    assert math.isnan(d(v("00")[None], v("00")[None])[0, 0])


def test_distances_are_those_of_single_vectors():
    rng = np.random.default_rng(1)
    q, r = rng.normal(size=(7, 5)), rng.normal(size=(9, 5))
    r[3] = q[2]
    for name, one in (("l1", lambda a, b: np.abs(a - b).sum()), ("l2", lambda a, b: np.linalg.norm(a - b)), ("cosine", lambda a, b: max(0.0, 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-9)))):
        assert np.allclose(neighbors.DISTANCES[name](q, r), [[one(a, b) for b in r] for a in q], atol=1e-6)
    assert neighbors.DISTANCES["l2"](q, r)[2, 3] == 0


def test_ranking_metrics(spark):
    f = spark.createDataFrame(list(zip([1] * 5, [1.0, 0.0, 1.0, 0.0, 1.0], [0.9, 0.8, 0.8, 0.3, 0.2], strict=True)), "g int, label double, pred double")
    m = metrics.evaluate(f, ["g"], ("auc_roc", "avg_pr")).first()
    assert (round(m.auc_roc, 6), round(m.avg_pr, 6)) == (0.583333, 0.755556)
    single = f.withColumn("label", F.lit(1.0))
    assert metrics.roc_auc(single, ["g"]).first().auc_roc is None
    assert metrics.average_precision(single, ["g"]).first().avg_pr == 1


def test_missing_labels_change_nothing(spark):
    f = spark.createDataFrame([(1, 1.0, 0.9), (1, 0.0, 0.2), (1, 1.0, 0.4)], "g int, label double, pred double")
    more = f.union(spark.createDataFrame([(1, None, 0.99)], f.schema))
    names = tuple(metrics.REGISTRY)
    assert metrics.evaluate(f, ["g"], names).first() == metrics.evaluate(more, ["g"], names).first()


def test_fold_sizes_and_partition(spark):
    keys = spark.range(23).select(F.col("id").alias("k"))
    a = splits.kfold(keys, "k", 5, 2)
    sizes = {(r.trial, r.fold): r["count"] for r in a.groupBy("trial", "fold").count().collect()}
    assert [sizes[0, f] for f in range(5)] == [5, 5, 5, 4, 4]
    assert a.where("trial = 1").select("k").distinct().count() == 23
    with pytest.raises(ValueError, match="two folds"):
        splits.kfold(keys, "k", 1)


def test_random_split_is_disjoint(spark):
    rows = spark.range(101).select(F.col("id").alias("k"))
    s = splits.random_split(rows, ["k"], 0.8, 0.1, 0.1)
    assert {r.role: r["count"] for r in s.groupBy("role").count().collect()} == {"train": 80, "val": 10, "test": 11}
    with pytest.raises(ValueError, match="sum to 1"):
        splits.random_split(rows, ["k"], 0.8, 0.3, 0.1)


def test_roles(spark):
    g = spark.range(30).select((F.col("id") % 5).alias("seq"), F.col("id").alias("row"))
    r = splits.fold_roles(g, splits.leave_one_out(g, "seq"), "seq", ["row"], 0.25)
    assert {x.role: x["count"] for x in r.where("fold = '3'").groupBy("role").count().collect()} == {"test": 6, "train": 18, "val": 6}


def test_skip_rule(spark):
    tasks = {"a": [1.0, 1.0, 0.0, None], "b": [1.0, 0.0, 0.0], "c": [1.0] * 19 + [0.0], "d": [None, None]}
    rows = spark.createDataFrame([(t, y) for t, ys in tasks.items() for y in ys], "sub string, label double")
    assert {r["sub"]: r["skip"] for r in reshape.task_validity(rows, "sub").collect()} == {"a": False, "b": True, "c": True, "d": True}


def test_pivot_roundtrip_and_duplicates(spark):
    g = spark.createDataFrame([("s", "CCO", 1.0), ("t", "CC", 0.0)], "seq string, sub string, label double")
    wide = reshape.pivot(g, "seq", "sub", ["CC", "CCO"])
    assert {tuple(r) for r in reshape.unpivot(wide, "seq", "sub").select("seq", "sub", "label").collect()} == {("s", "CCO", 1.0), ("t", "CC", 0.0)}
    with pytest.raises(Exception, match="two rows"):
        reshape.pivot(g.union(g), "seq", "sub", ["CC", "CCO"]).collect()


def test_nan_becomes_null(spark):
    assert reshape.nan_to_null(spark.createDataFrame([(float("nan"),)], "x double")).first().x is None


def test_lookup_fails_on_a_miss(spark):
    found = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(Exception, match="no entry for b"):
        reshape.lookup(spark.createDataFrame([("b",)], "k string"), found, "k", "v").collect()


def test_cluster_losses(spark):
    pts = [(0, 0, [0.0, 0.0]), (1, 0, [2.0, None]), (2, 0, [4.0, 2.0]), (3, 1, [10.0, 0.0])]
    p = spark.createDataFrame([(k, c, d, x) for k, c, v in pts for d, x in enumerate(v)], "key int, cluster int, dim int, x double")
    sq = {r.key: r.loss for r in cluster.centroid_loss(p, 2).collect()}
    assert [round(sq[k], 6) for k in range(4)] == [round(math.sqrt(5), 6), 0, round(math.sqrt(5), 6), 0]
    ab = {r.key: r.loss for r in cluster.centroid_loss(p, 2, squared=False).collect()}
    assert [ab[k] for k in range(4)] == [3, 0, 3, 0]


def test_mutual_information(spark):
    rows = spark.createDataFrame([(i % 3, i % 3) for i in range(30)] + [(None, 1)], "a int, b int")
    assert cluster.adjusted_mutual_information(rows, "a", "b").first().ami == pytest.approx(1)
    assert cluster.adjusted_rand(rows, "a", "b").first().ari == pytest.approx(1)


def test_soft_alignment(spark):
    a, b = [(0, 0), (1, 1)], [(0, 1), (2, 2)]
    d = [("a", "b", i, j, float(abs(x[0] - y[0]) + abs(x[1] - y[1]))) for i, x in enumerate(a) for j, y in enumerate(b)]
    out = neighbors.soft_alignment(spark.createDataFrame(d, "a string, b string, i int, j int, d double")).first()
    assert out.dist == pytest.approx(1.478721, abs=1e-6)


def test_half_width_and_adjustment(spark):
    r = spark.createDataFrame([("x", s, v) for s, v in enumerate((0.5, 0.6, 0.7))], "m string, seed int, v double")
    assert report.seed_interval(r, ["m"], "seed", "v").first().half == pytest.approx(0.113161, abs=1e-6)
    p = spark.createDataFrame([(1, 0.01), (1, 0.04), (1, 0.03)], "f int, p double")
    assert sorted(round(x.adjusted, 6) for x in report.benjamini_hochberg(p, ["f"], "p").collect()) == [0.03, 0.04, 0.04]


def test_tails():
    assert report._t_tail(0.0, 5) == pytest.approx(0.5)
    assert report._t_tail(2.015048, 5) == pytest.approx(0.05, abs=1e-6)
    assert report._t_tail(-2.015048, 5) == pytest.approx(0.95, abs=1e-6)
    assert report._signed_rank([1.0, 2.0, 3.0, 4.0, 5.0]) == pytest.approx(2 / 32)


def test_fasta_and_references(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">s1 x\nAC-\nDE\n>s2\nG-G\nHH\n")
    got = {r["name"]: (r.aligned, r.seq) for r in files.read_fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {"s1 x": ("AC-DE", "ACDE"), "s2": ("G-GHH", "GGHH")}
    (tmp_path / "r.txt").write_text("head\nABCDEFL\n(6,'F')\n(7, 'L')\n")
    assert files.read_references(spark, str(tmp_path / "r.txt")).first().positions == [5, 6]
    (tmp_path / "w.txt").write_text("head\nABC\n(1,'B')\n")
    with pytest.raises(Exception, match="residue"):
        files.read_references(spark, str(tmp_path / "w.txt")).collect()
    (tmp_path / "e.txt").write_text("head\nABC\n")
    assert files.read_references(spark, str(tmp_path / "e.txt")).first().positions == []


def test_config():
    text = '{"universal_args": {"seed": [1, 2], "model": ["a"]}, "iterative_args": [{"model": ["b", "c"]}, {"k": [3]}]}'
    assert len(files.expand_config(text)) == 6


def test_empty_positions_give_zeros(spark):
    m = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]])], "key int, residues array<array<double>>")
    none = spark.createDataFrame([], "key int, pos int")
    assert {r.x for r in msa.pool_positions(m, none, "key").collect()} == {0.0}


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "key int, features array<double>, label double")
    got = np.array([r.pred for r in models.ridge(df, df, 2.0).orderBy("key").collect()])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 2 * np.eye(4), xc.T @ yc)
    assert np.allclose(got, xc @ w + y.mean(), atol=1e-8)


def test_one_class_is_constant(spark):
    df = spark.createDataFrame([(1, [1.0], 1.0), (2, [2.0], 1.0)], "key int, features array<double>, label double")
    assert {r.pred for r in models.logistic(df, df).collect()} == {1.0}
    assert {r.pred for r in models.forest(df, df).collect()} == {1.0}


def test_network_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, :1] > 0).astype(float)
    y[::50] = np.nan
    p = models.train_network(x[:300], y[:300], x[300:], y[300:], epochs=40, rate=1e-2, layers=2, hidden=16, dropout=0.0)(x[300:])
    seen = ~np.isnan(y[300:])
    assert ((p > 0.5) == (y[300:] == 1))[seen].mean() > 0.9


def test_scaling_zero_variance(spark):
    f = spark.createDataFrame([(1, 0, 5.0), (2, 0, 5.0)], "key int, dim int, x double")
    assert {r.x for r in scaling.standard_scale(f, f).collect()} == {0.0}


def test_k_core_fixpoint(spark):
    tri = [(1, 2), (2, 3), (1, 3), (3, 4)]
    e = spark.createDataFrame(tri + [(b, a) for a, b in tri], "a int, b int")
    assert {r.a for r in neighbors.k_core(e, 2).collect()} == {1, 2, 3}


def test_nearest_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i), 0.0]) for i in range(20)]
    q = spark.createDataFrame(rows[:6], "query long, vector array<double>")
    r = spark.createDataFrame(rows, "ref long, vector array<double>")
    whole = sorted(map(tuple, neighbors.distances(q, r, "l2", 3).select("query", "ref", "rank").collect()))
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 4)
    assert sorted(map(tuple, neighbors.distances(q, r, "l2", 3).select("query", "ref", "rank").collect())) == whole
    assert neighbors.distances(q.limit(0), r, "l2", 3).count() == 0


def test_features_of_another_width_fail(spark):
    df = spark.createDataFrame([([1.0], [2.0, 3.0])], "a array<double>, b array<double>")
    assert reshape.concat_features(df, {"a": 1, "b": 2}).first().features == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="b must have 3"):
        reshape.concat_features(df, {"a": 1, "b": 3}).collect()


def test_too_many_categories_fail(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "k int, c string")
    assert {(r.k, r.code, r.dim, r.x) for r in reshape.category_one_hot(df, "k", "c").collect() if r.x} == {(1, 0, 0, 1.0), (2, 1, 1, 1.0), (3, 0, 0, 1.0)}
    with pytest.raises(Exception, match="more than 1 categories"):
        reshape.category_one_hot(df, "k", "c", most=1).collect()


def test_stored_tables_are_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for how in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert files.cached(spark, str(tmp_path), how, build).count() == 3
    assert len(built) == 2


def test_linear_svm(spark):
    e = spark.createDataFrame([(i, [float(i % 2), i / 100], float(i % 2)) for i in range(80)], "id int, features array<double>, label double")
    assert all((r.pred > 0) == (r.label == 1) for r in models.linear_svm(e.where("id < 60"), e.where("id >= 60")).collect())
    assert {r.pred for r in models.linear_svm(e.where("label = 1"), e).collect()} == {1.0}
