"""Registered queries of models fitted across tasks: linear ones per task, networks, kernels, searches, fitted steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.rand import uniform
from gridlark.operators import models, neighbors, network, pertask, scaling, search, steps
from gridlark.functions import text as tx
from gridlark.plans.catalogue import _ALIGNED, _RES, GRID, MASKED, aligned, facts, grid, query, r6, residue_matrix
from gridlark.sources import files
from gridlark.sources.shared import shared_path
from gridlark.sources.tables import table

#: Rows of the grid with two features of the first axis; a fifth of its values are held out.
_CELLS = MASKED + """, x as (select seq, sub, label, case when label is not null then pred end as y, cast(s_acctbal as double) / 1000 as x1, cast(s_nationkey as double) as x2, seq % 5 = 0 as held from facts join supplier on s_suppkey = seq)"""


def cells(spark: SparkSession, sf: str, label: str) -> DataFrame:
    """(task, key, features, label, held): masked cells of the grid, features of their first axis."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seq"), F.array(F.col("s_acctbal").cast("double") / 1000, F.col("s_nationkey").cast("double")).alias("features"))
    value = F.when(F.col("label").isNotNull(), F.col(label))
    return facts(spark, sf).withColumn("label", value).join(s, "seq").select(F.col("sub").alias("task"), F.col("seq").alias("key"), "features", "label", (F.col("seq") % 5 == 0).alias("held"))


@query(_CELLS + """, t as (select sub, count(*) as n, avg(x1) as m1, avg(x2) as m2, avg(y) as my, sum(x1 * x1) as s11, sum(x1 * x2) as s12, sum(x2 * x2) as s22, sum(x1 * y) as s1y, sum(x2 * y) as s2y from x where not held and y is not null group by 1),
  c as (select *, s11 - n * m1 * m1 + 1 as a, s12 - n * m1 * m2 as b, s22 - n * m2 * m2 + 1 as d, s1y - n * m1 * my as p, s2y - n * m2 * my as q from t)
  select x.sub as task, seq as key, round(my + (d * p - b * q) / (a * d - b * b) * (x1 - m1) + (a * q - b * p) / (a * d - b * b) * (x2 - m2), 6) as pred from x left join c on c.sub = x.sub where held""")
def ridge_tasks(spark, sf):
    """Ridge regression of every task of the masked grid, all fitted in one job from sums."""
    rows = cells(spark, sf, "pred")
    return pertask.predict_ridge(rows.where("held"), pertask.fit_ridge(rows.where("not held"), alpha=1.0)).select("task", "key", r6("pred", "pred"))


@query()
def logistic_tasks(spark, sf):
    """Balanced logistic regression of every task of the masked grid, a job a Newton round for all."""
    rows = cells(spark, sf, "label")
    return pertask.predict_logistic(rows.where("held"), pertask.fit_logistic(rows.where("not held"), alpha=1.0)).select("task", "key", r6("pred", "pred"))


def labelled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(key, features, labels, role): embeddings with a label for each of ten classes, a fifth of them missing."""
    role = F.when(F.col("vec_id") % 5 == 0, "test").when(F.col("vec_id") % 5 == 1, "val").otherwise("train")
    each = [F.when(uniform(31 + k, "vec_id") >= 0.2, F.when(F.col("label") == k, 1.0).otherwise(0.0)) for k in range(10)]
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("features"), F.array(*each).alias("labels"), role.alias("role"), F.col("label").alias("truth"))


@query()
def multitask_network(spark, sf):
    """An ensemble of two networks on ten labels at once, trained across tasks; scores of test rows."""
    rows = labelled_vectors(spark, sf)
    nets = [network.Network((64,), 10, hidden=32, layers=2, rate=1e-2, seed=s) for s in (1, 2)]
    fitted = network.fit_networks(rows, nets, "key", ["features"], epochs=6, batches=2)
    found = network.predict_networks(rows.where("role = 'test'"), fitted, "key", ["features"])
    return found.select("key", F.posexplode(F.arrays_zip("pred", "spread")).alias("task", "v")).select("key", "task", F.round("v.pred", 5).alias("pred"), F.round("v.spread", 5).alias("spread"))


def grid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(key, seq, sub, a, b, labels, role): cells with features of both axes; rows of a fifth of the items are test."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seq"), F.array(F.col("s_acctbal") / 10000, *((F.col("s_nationkey") % 5 == k).cast("double") for k in range(5))).alias("a"))
    b = table(spark, sf, "part").groupBy(F.col("p_brand").alias("sub")).agg(F.array(F.avg("p_size") / 50, F.avg("p_retailprice") / 2000, F.stddev_pop("p_size") / 50).alias("b"))
    role = F.when(F.col("seq") % 5 == 0, "test").when(F.col("seq") % 5 == 1, "val").otherwise("train")
    return facts(spark, sf).join(s, "seq").join(b, "sub").select(F.concat_ws(":", "seq", "sub").alias("key"), "seq", "sub", "a", "b", F.array("label").alias("labels"), role.alias("role"))


@query()
def two_tower_network(spark, sf):
    """A network over both axes whose learned projections are multiplied, on the masked grid."""
    rows = grid_pairs(spark, sf)
    fitted = network.fit_networks(rows, [network.Network((6, 3), 1, hidden=16, layers=2, rate=1e-2, seed=3)], "key", ["a", "b"], epochs=5, batches=1)
    test = rows.where("role = 'test'")
    return test.select("key", "seq", "sub").join(network.predict_networks(test, fitted, "key", ["a", "b"]), "key").select("seq", "sub", F.round(F.get("pred", F.lit(0)), 5).alias("pred"))


@query()
def search_linear(spark, sf):
    """Penalties of ridge regression by a search that learns; each round's trials are scored by one job."""
    rows = table(spark, sf, "embeddings").select(F.lit("all").alias("task"), F.col("embedding").alias("features"), F.col("label").cast("double").alias("label"), (F.col("vec_id") % 3).alias("fold"))

    def score(trials: list[search.Trial]) -> list[float]:
        alphas = [10.0 ** t["log_alpha"] for t in trials]
        found = {r["alpha"]: r["mse"] for r in pertask.ridge_errors(rows, alphas).collect()}
        return [found[a] for a in alphas]

    past = search.search(search.SEARCH_SPACES["linear"], score, rounds=3, per_round=4, seed=5)
    return spark.createDataFrame([(k, t["log_alpha"], round(s, 6)) for k, (t, s) in enumerate(past)], "trial int, log_alpha int, mse double")


@query()
def search_network(spark, sf):
    """Hidden size, layers, dropout, decay and rate of a network; the networks of a round train in the same jobs."""
    rows = labelled_vectors(spark, sf)

    def score(trials: list[search.Trial]) -> list[float]:
        nets = [network.Network((64,), 10, hidden=t["hidden"], layers=t["layers"], dropout=t["dropout"], decay=t["decay"], rate=t["rate"], seed=1) for t in trials]
        return [min(f.history) for f in network.fit_networks(rows, nets, "key", ["features"], epochs=2, batches=2)]

    past = search.search(search.SEARCH_SPACES["network"], score, rounds=3, per_round=4, seed=5)
    return spark.createDataFrame([(k, t["hidden"], t["layers"], round(t["rate"], 8), round(s, 5)) for k, (t, s) in enumerate(past)], "trial int, hidden int, layers int, rate double, loss double")


def _kernel_tasks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("task", F.explode(F.array(F.lit(3), F.lit(7))))
    return e.select("task", F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("features"), F.when(F.col("label") == F.col("task"), 1.0).otherwise(0.0).alias("label"), (F.col("vec_id") % 5 == 0).alias("held"))


@query()
def gp_tasks(spark, sf):
    """Gaussian processes of two tasks, regression and classification, through 64 inducing points."""
    rows = _kernel_tasks(spark, sf)
    train, test = rows.where("not held"), rows.where("held")
    points = pertask.sample_points(train.where("task = 3"), "key", 64)
    r, c = pertask.gp_regression(train, test, points, noise=1e-2), pertask.gp_classification(train, test, points)
    return r.select("task", "key", F.round("pred", 5).alias("value")).join(c.select("task", "key", F.round("pred", 5).alias("probability")), ["task", "key"])


@query("""with v as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings), t as (select dim, avg(x) as m, stddev_pop(x) as d from v where vec_id % 5 <> 0 group by 1 having var_pop(x) > 0.0155)
  select vec_id, cast(row_number() over (partition by vec_id order by v.dim) - 1 as integer) as place, round((x - m) / d, 6) as x from v join t on t.dim = v.dim where vec_id % 5 = 0""")
def fitted_steps(spark, sf):
    """Selection and scaling fitted on training rows as one pipeline, saved, loaded, applied to the rest."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    path = shared_path(spark)
    chain = Pipeline(stages=[steps.DimensionSelector(threshold=0.0155), steps.VectorScaler(inputCol="selected")])
    chain.fit(e.where("vec_id % 5 <> 0")).save(path)
    out = PipelineModel.load(path).transform(e.where("vec_id % 5 = 0"))
    return out.select("vec_id", F.posexplode(vector_to_array("scaled")).alias("place", "x")).select("vec_id", "place", r6("x", "x"))


@query(MASKED + """, w as (select seq || ':' || sub as key, label, case label when 1 then 3 when 0 then 1 else 0 end as weight from facts),
  c as (select key, weight, sum(weight) over (order by md5('17:' || key), key rows unbounded preceding) as upto, sum(weight) over () as total from w where weight > 0)
  select key, cast(floor((upto * 5000 + 0.5 * total) / total) - floor(((upto - weight) * 5000 + 0.5 * total) / total) as bigint) as draws from c where floor((upto * 5000 + 0.5 * total) / total) > floor(((upto - weight) * 5000 + 0.5 * total) / total)""")
def sampler_draws(spark, sf):
    """5000 draws with replacement from the cells of the masked grid, positive ones three times as likely."""
    w = facts(spark, sf).select(F.concat_ws(":", "seq", "sub").alias("key"), F.when(F.col("label") == 1, 3).when(F.col("label") == 0, 1).otherwise(0).alias("weight"))
    return models.weighted_draws(w, "key", "weight", 5000, 17)


@query()
def outer_ridge(spark, sf):
    """Outer products of two selected vectors, projected, and a ridge regression of each task on them."""
    e = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    crossed = scaling.outer_features(e, "a", "b", "vec_id", "vec_id % 5 <> 0", 0.12, 8).select(F.col("vec_id").alias("key"), F.col("components").alias("features"))
    rows = crossed.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "label"), "key").withColumn("task", F.explode(F.array(F.lit(3), F.lit(7))))
    rows = rows.withColumn("label", F.when(F.col("label") == F.col("task"), 1.0).otherwise(0.0))
    return pertask.predict_ridge(rows.where("key % 5 = 0"), pertask.fit_ridge(rows.where("key % 5 <> 0"))).select("task", "key", F.round("pred", 6).alias("pred"))


@query()
def network_files(spark, sf):
    """Networks with their losses saved as tables, loaded again and applied; losses of each epoch beside."""
    rows = labelled_vectors(spark, sf)
    fitted = network.fit_networks(rows, [network.Network((64,), 10, hidden=16, layers=1, rate=1e-2, seed=9)], "key", ["features"], epochs=2)
    path = shared_path(spark)
    network.save_networks(fitted, spark, path)
    again = network.load_networks(spark, path)
    network.loss_history(again, spark).write.parquet(f"{path}-losses")
    best = spark.read.parquet(f"{path}-losses").where("best").select(F.col("epoch").alias("best_epoch"), F.round("loss", 6).alias("loss"))
    found = network.predict_networks(rows.where("role = 'test'"), again, "key", ["features"])
    return found.select("key", F.round(F.get("pred", F.lit(3)), 5).alias("pred")).crossJoin(F.broadcast(best))  # one row


@query(_RES + " select vec_id, cast(pos as integer) as pos, round(sum(x), 6) as total from r group by 1, 2")
def residue_cache(spark, sf):
    """Features of each residue, stored in a file named after the dataset and read again by the next call."""
    root = f"{shared_path(spark)}/{sf.rstrip('/').rsplit('/', 1)[-1]}_residue_features"
    build = lambda: residue_matrix(spark, sf).select("vec_id", F.posexplode("residues").alias("pos", "vector"))
    files.cached(spark, root, {"features": "residues"}, build)
    back = files.cached(spark, root, {"features": "residues"}, lambda: build().where("false"))
    return back.select("vec_id", "pos", r6(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), "total"))


@query(_ALIGNED + " select name, cast(pos as integer) as pos, upper(ch) as letter, 1 as x from p where pos in (0, 2, 4, 11) and ch <> '-'")
def msa_onehot(spark, sf):
    """One-hot rows of selected alignment columns in sparse form; gaps have no one."""
    picked = F.array(*map(F.lit, (0, 2, 4, 11)))
    rows = aligned(spark, sf).select("name", F.posexplode(tx.chars(tx.selected_columns(F.col("aligned"), picked))).alias("k", "letter"))
    return rows.where("letter <> '-'").select("name", F.get(picked, F.col("k")).alias("pos"), F.upper("letter").alias("letter"), F.lit(1).alias("x"))


@query(GRID + " select seq, sub, round(list_sum(embedding[1:4]::double[]), 6) as total from grid join embeddings on vec_id = seq % 100")
def precomputed_features(spark, sf):
    """Given features, stored beside the data, joined with the rows of their items; a missing item is an error."""
    path = shared_path(spark)
    table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.slice("embedding", 1, 4).cast("array<double>").alias("features")).write.parquet(path)
    known = spark.read.parquet(path)
    rows = grid(spark, sf).select("seq", "sub", (F.col("seq") % 100).alias("item")).join(known, "item", "left")
    found = F.coalesce("features", F.raise_error(F.concat(F.lit("no features of item "), F.col("item"))).cast("array<double>"))
    return rows.select("seq", "sub", r6(F.aggregate(found, F.lit(0.0), lambda s, x: s + x), "total"))


@query("""with e as (select distinct least(p_size, length(p_name)) as a, greatest(p_size, length(p_name)) as b, min(p_retailprice) as d from part group by 1, 2), s as (select a, b, d from e where a <> b union all select b, a, d from e where a <> b),
  n as (select a, count(*) as degree from s group by 1) select s.a, s.b, cast(d as double) as value, degree from s join n using (a) union all select a, a, 0, degree from n""")
def sparse_distances(spark, sf):
    """A symmetric sparse matrix of least distances with a zero diagonal, and the degree of each row."""
    p = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("x"), F.length("p_name").cast("long").alias("y"), F.col("p_retailprice").cast("double").alias("d"))
    both = neighbors.symmetric_minimum(p, "x", "y", "d")
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    return both.join(degree, "a").select("a", "b", F.col("d").alias("value"), "degree").union(degree.select("a", "a", F.lit(0.0), "degree"))


@query("select a.vec_id as a, b.vec_id as b, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) as dist from embeddings a join embeddings b on a.vec_id < b.vec_id where a.vec_id % 25 = 0 and b.vec_id % 25 = 0")
def test_pair_distances(spark, sf):
    """Distances between all test items, each pair once, beside their predictions."""
    test = table(spark, sf, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = neighbors.distances(test, test.withColumnRenamed("query", "ref"), "l2", digits=6)
    return found.where("query < ref").select(F.col("query").alias("a"), F.col("ref").alias("b"), "dist")


@query("select event_type, count(*) as n, max(strftime(ts, '%Y_%m_%d-%H%M%S')) as last from events group by 1")
def run_stamps(spark, sf):
    """times as they stand in the names of runs; the last of each kind."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max(F.date_format("ts", "yyyy_MM_dd-HHmmss")).alias("last"))
