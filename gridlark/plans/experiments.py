"""Registered queries of experiments: projections, result names and reports, features, files and caches.

Rows of part stand for result rows of experiments (see RESULTS)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.functions import text as tx
from gridlark.functions.rand import shuffle_key
from gridlark.operators import metrics, models, msa, naming, reshape
from gridlark.operators.ranges import numbered
from gridlark.plans.catalogue import _ALIGNED, _RES, BRANDS, FOLDS, GRID, MASKED, _shared, aligned, facts, grid, names, query, r6, residue_matrix
from gridlark.sources import files
from gridlark.sources.tables import table

RESULTS = """with res as (select cast(p_partkey as bigint) as id, ['linear', 'knn', 'ffn', 'ffndot', 'rf'][cast(p_size % 5 as integer) + 1] as model,
  ['levenshtein', 'hamming'][cast(p_partkey % 2 as integer) + 1] as dist, p_size % 3 = 0 as scaled, ['esm', 'bepler', 'msa', 'kmer', 'onehot', null][cast(p_partkey % 6 as integer) + 1] as feature,
  ['random', 'cat', 'morgan', null][cast(p_partkey % 4 as integer) + 1] as chem, ['mean', 'hard', null][cast(p_partkey % 3 as integer) + 1] as pool, cast(p_size % 7 as bigint) as pool_num,
  case when p_partkey % 5 <> 0 then 'refs/reference_' || cast(p_size as bigint) || '.txt' end as ref_file, case when p_size % 10 <> 0 then 'test' else 'train' end as split,
  cast(p_partkey % 3 as bigint) as seed, 'data/' || lower(p_type) || '.csv' as path, cast(p_retailprice as double) as score from part)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """(id, model, dist, scaled, feature, chem, pool, pool_num, ref_file, split, seed, path, score)."""
    key, size = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    pick = lambda n, *x: F.get(F.array(*(F.lit(v).cast("string") for v in x)), (n % len(x)).cast("int"))
    return table(spark, sf, "part").select(
        key.alias("id"), pick(size, "linear", "knn", "ffn", "ffndot", "rf").alias("model"), pick(key, "levenshtein", "hamming").alias("dist"), (size % 3 == 0).alias("scaled"),
        pick(key, "esm", "bepler", "msa", "kmer", "onehot", None).alias("feature"), pick(key, "random", "cat", "morgan", None).alias("chem"), pick(key, "mean", "hard", None).alias("pool"), (size % 7).alias("pool_num"),
        F.when(key % 5 != 0, F.concat(F.lit("refs/reference_"), size.cast("string"), F.lit(".txt"))).alias("ref_file"), F.when(size % 10 != 0, "test").otherwise("train").alias("split"),
        (key % 3).alias("seed"), F.concat(F.lit("data/"), F.lower("p_type"), F.lit(".csv")).alias("path"), F.col("p_retailprice").cast("double").alias("score"),
    )


# --- names and predicates of results ------------------------------------------------------------------------------


@query(RESULTS + """, m as (select *, case when model = 'knn' then dist || ' knn' || case when scaled then ' (Scaled)' else '' end
  when model like '%ffn%' then model || case when chem = 'random' then '(prot,randchem)' when chem = 'cat' then '(prot,catchem)' when chem is not null then '(prot,chem)' else '' end else model end as m from res)
  select id, trim(case when feature in ('esm', 'bepler', 'msa') and pool is not null then feature || '-' || pool else coalesce(feature, '') end || ' ' || m) as model_name from m""")
def protein_model_names(spark, sf):
    """Names of models over proteins."""
    return results(spark, sf).select("id", naming.protein_model_name().alias("model_name"))


@query(RESULTS + """ select id, coalesce(chem, 'none') || ' ' || case when model = 'knn' then model || '-' || dist
  when model like '%ffn%' then model || case when feature = 'random' then '(prot,randchem)' when feature = 'cat' then '(prot,catchem)' when feature is not null then '(prot,chem)' else '' end else model end as model_name from res""")
def substrate_model_names(spark, sf):
    """Names of models over substrates."""
    return results(spark, sf).select("id", naming.substrate_model_name().alias("model_name"))


@query(RESULTS + """ select id, model as model_name, feature as embedding, pool as pool_strat, pool_num,
  case when ref_file is not null and coalesce(pool, '') <> 'mean' then cast(regexp_extract(ref_file, 'reference_([0-9]*)\\.txt$', 1) as bigint) end as angstroms from res""")
def pooling_attributes(spark, sf):
    """Attributes of pooling, the radius from a file's name."""
    return results(spark, sf).select("id", F.col("model").alias("model_name"), F.col("feature").alias("embedding"), F.col("pool").alias("pool_strat"), "pool_num", naming.radius().alias("angstroms"))


@query(RESULTS + " select id, model as model_name, split_part(split_part(path, '/', -1), '.', 1) as dataset_name from res")
def simple_names(spark, sf):
    """The model's own name, and the dataset from the stem of its file."""
    return results(spark, sf).select("id", F.col("model").alias("model_name"), naming.stem("path").alias("dataset_name"))


@query(RESULTS + " select id, model, feature, chem from res where model = 'knn' and chem is null and feature = 'kmer' or model in ('ffn', 'ffndot') and feature is null and scaled")
def select_models(spark, sf):
    """Models by conjunctions with tests for null, and by a list."""
    r = results(spark, sf)
    return r.where((F.col("model") == "knn") & F.col("chem").isNull() & (F.col("feature") == "kmer") | F.col("model").isin("ffn", "ffndot") & F.col("feature").isNull() & F.col("scaled")).select("id", "model", "feature", "chem")


@query(RESULTS + " select id, model, score from res where split = 'test' and seed = 1")
def test_rows_of_seed(spark, sf):
    """Rows of the test split and of one seed."""
    return results(spark, sf).where("split = 'test' and seed = 1").select("id", "model", "score")


@query(MASKED + " select seq, sub, case when coalesce(label, 0) > 0.5 then 1 else 0 end as hit, case when pred > 0.52 then 1 else 0 end as high from facts")
def strict_binary(spark, sf):
    """P10: 1 where a value is strictly over the cut, 0 for missing ones."""
    over = lambda c, cut: F.when(F.nanvl(F.col(c), F.lit(None).cast("double")) > cut, 1).otherwise(0)
    return facts(spark, sf).select("seq", "sub", over("label", 0.5).alias("hit"), over("pred", 0.52).alias("high"))


@query(GRID + " select seq, sub, label from grid where sub = 'Brand#11'")
def one_substrate(spark, sf):
    """The rows of one substrate."""
    return grid(spark, sf).where("sub = 'Brand#11'").select("seq", "sub", "label")


# --- projections --------------------------------------------------------------------------------------------------


@query(GRID + " select name, row_number() over (order by name) as place from (select distinct 'label_' || sub as name from grid)")
def label_discovery(spark, sf):
    """Names of the label columns of the pivoted grid, in alphabetical order."""
    return numbered(grid(spark, sf).select(F.concat(F.lit("label_"), "sub").alias("name")).distinct(), ["name"], "place").withColumn("place", F.col("place") + 1)


@query("with m as (select vec_id, avg(cast(embedding[1] as double)) as f_0, avg(cast(embedding[2] as double)) as f_1, avg(cast(embedding[64] as double)) as f_63 from embeddings group by 1) select vec_id, round(f_0, 6) as f_0, round(f_1, 6) as f_1, round(f_63, 6) as f_63 from m")
def feature_projection(spark, sf):
    """The feature columns of a row and no others."""
    wide = table(spark, sf, "embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(f"f_{k}") for k in range(64)))
    return wide.select("vec_id", *(r6(c, c) for c in ("f_0", "f_1", "f_63")))


@query(GRID + " select seq as row_id, sub as task, label from grid")
def label_projection(spark, sf):
    """The label matrix in long form."""
    return grid(spark, sf).select(F.col("seq").alias("row_id"), F.col("sub").alias("task"), "label")


@query(GRID + " select count(distinct sub) as n_tasks, min(sub) as first_task, max(sub) as last_task, count(distinct seq) as n_seqs from grid")
def task_names(spark, sf):
    """Number of tasks and sequences, and the tasks' range of names."""
    return grid(spark, sf).agg(F.countDistinct("sub").alias("n_tasks"), F.min("sub").alias("first_task"), F.max("sub").alias("last_task"), F.countDistinct("seq").alias("n_seqs"))


@query(RESULTS + ", d as (select distinct model, split from res) select model, split from d where model not in (select model from res where pool_num = 3 and split = 'train')")
def distinct_difference(spark, sf):
    """Distinct rows less those whose label another set has."""
    r = results(spark, sf)
    return r.select("model", "split").distinct().join(r.where("pool_num = 3 and split = 'train'").select("model"), "model", "left_anti")


@query(RESULTS + " select id, cast(null as varchar) as sub, pool as strategy from res where pool is not null")
def null_axis(spark, sf):
    """The pivoted axis set to null, rows without a value left out, a column renamed."""
    return results(spark, sf).where("pool is not null").select("id", F.lit(None).cast("string").alias("sub"), F.col("pool").alias("strategy"))


@query(GRID + ", p as (select seq, sub, pred from grid), l as (select seq, sub, label from grid) select seq, sub, label, round(pred, 6) as pred, round(1 - pred, 6) as other from p join l using (seq, sub)")
def row_zip(spark, sf):
    """Predictions beside labels, by the row's key and not by place; a second prediction column is appended."""
    g = grid(spark, sf)
    both = g.select("seq", "sub", "pred").join(g.select("seq", "sub", "label"), ["seq", "sub"])
    return both.withColumn("other", r6(1 - F.col("pred"), "other")).select("seq", "sub", "label", r6("pred", "pred"), "other")


@query(MASKED + ", b as (select sub, avg(label) as balance from facts group by 1), m as (select sub, avg(pred) as mean from facts group by 1) select sub, round(balance, 6) as balance, round(mean, 6) as mean from b join m using (sub)")
def balance_by_metric(spark, sf):
    """Balance of each task beside its mean prediction; fails on a task without one."""
    f = facts(spark, sf)
    found = f.groupBy("sub").agg(F.avg("pred").alias("mean"))
    return reshape.lookup(f.groupBy("sub").agg(F.avg("label").alias("balance")), found, "sub", "mean").select("sub", r6("balance", "balance"), r6("mean", "mean"))


@query(RESULTS + " select split_part(split_part(path, '/', -1), '.', 1) as dataset, model, count(*) as n, round(avg(score), 4) as score from res group by 1, 2")
def by_dataset(spark, sf):
    """Results of models by dataset, a grouping in long form."""
    return results(spark, sf).groupBy(naming.stem("path").alias("dataset"), "model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("score"))


# --- reports ------------------------------------------------------------------------------------------------------


@query(RESULTS + ", s as (select pool_num, seed, avg(score) as m from res group by 1, 2) select pool_num, round(avg(m), 4) as mean, cast(row_number() over (order by pool_num) as bigint) as place from s group by pool_num")
def pooling_lines(spark, sf):
    """Mean by pool size and seed, then by pool size, in its order."""
    means = results(spark, sf).groupBy("pool_num", "seed").agg(F.avg("score").alias("m")).groupBy("pool_num").agg(F.round(F.avg("m"), 4).alias("mean"))
    # a row a pool size: few rows
    return means.withColumn("place", F.row_number().over(Window.orderBy("pool_num")).cast("long"))


@query(RESULTS + " select coalesce(pool, model) as baseline, round(avg(score), 4) as mean from res where pool = 'mean' or pool is null and model in ('linear', 'knn') group by 1")
def baseline_means(spark, sf):
    """A horizontal line for each baseline."""
    r = results(spark, sf).where("pool = 'mean' or pool is null and model in ('linear', 'knn')")
    return r.groupBy(F.coalesce("pool", "model").alias("baseline")).agg(F.round(F.avg("score"), 4).alias("mean"))


@query(RESULTS + ", m as (select model, path, round(avg(score), 4) as score from res group by 1, 2) select model, path, score, cast(row_number() over (order by model, path) as bigint) as place from m")
def sorted_results(spark, sf):
    """Summaries in the order of model and dataset."""
    m = results(spark, sf).groupBy("model", "path").agg(F.round(F.avg("score"), 4).alias("score"))
    return numbered(m, ["model", "path"], "place").withColumn("place", F.col("place") + 1)


_TUNED = MASKED + FOLDS + ", rows as (select f.*, fold, trial from facts f join folds using (seq) where label is not null)"


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    from gridlark.operators import splits

    return facts(spark, sf).where("label is not null").join(splits.kfold(grid(spark, sf), "seq", 5, 2), "seq")


@query(_TUNED + """, e as (select trial, fold, sub, sqrt(avg((label - pred) * (label - pred))) as rmse from rows group by 1, 2, 3)
  select trial, round(avg(rmse), 6) as objective from e group by 1""")
def tuning_by_task(spark, sf):
    """The objective of pivoted tuning, the mean over folds and tasks of the metric of each."""
    each = metrics.error_metrics(_folded(spark, sf), ["trial", "fold", "sub"])
    return each.groupBy("trial").agg(r6(F.avg("rmse"), "objective"))


@query(_TUNED + """, e as (select trial, sub, count(*) as n, sum(case when label = 1 then 1 else 0 end) as n_pos, sqrt(avg((label - pred) * (label - pred))) as rmse from rows group by 1, 2)
  select trial, round(avg(rmse), 6) as objective, count(*) as groups from e where not (n <= 2 or n_pos < 2 or n_pos / cast(n as double) > 0.9 or n_pos / cast(n as double) < 1.0::double - 0.9::double) group by 1""")
def tuning_by_group(spark, sf):
    """The objective of joint tuning: folds pooled, the metric of each group that is valid, their mean."""
    rows = _folded(spark, sf)
    group = F.concat_ws(":", F.col("trial").cast("string"), "sub")
    valid = reshape.task_validity(rows.withColumn("group", group), "group").where("not skip").select("group")
    each = metrics.error_metrics(rows.withColumn("group", group), ["trial", "group"]).join(valid, "group")
    return each.groupBy("trial").agg(r6(F.avg("rmse"), "objective"), F.count(F.lit(1)).alias("groups"))


# --- features -----------------------------------------------------------------------------------------------------


@query("select n_nationkey, s_suppkey, cast(len(concat([length(n_name), n_regionkey], [length(s_name), s_nationkey, 1])) as bigint) as size, cast(length(n_name) as double) as first, cast(s_nationkey as double) as fourth from nation join supplier on n_nationkey = s_nationkey")
def feature_concat(spark, sf):
    """Chemical features followed by protein features; fails where a block has another width."""
    chem = table(spark, sf, "nation").select("n_nationkey", F.array(F.length("n_name").cast("double"), F.col("n_regionkey").cast("double")).alias("chem"))
    prot = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.array(F.length("s_name").cast("double"), F.col("s_nationkey").cast("double"), F.lit(1.0)).alias("prot"))
    both = reshape.concat_features(prot.join(chem, F.col("s_nationkey") == F.col("n_nationkey")), {"chem": 2, "prot": 3})
    return both.select("n_nationkey", "s_suppkey", F.size("features").cast("long").alias("size"), F.get("features", F.lit(0)).alias("first"), F.get("features", F.lit(3)).alias("fourth"))


@query("select distinct p_name as name, replace(rpad(p_name, 12, '-'), '-', '') as seq, upper(trim(p_name)) as upper_name, md5(p_name) as digest, p_name as str from part")
def text_features(spark, sf):
    """Sequences without gaps, trimmed capitals, digests, and the text itself."""
    return aligned(spark, sf).select("name", tx.ungapped(F.col("aligned")).alias("seq"), F.upper(F.trim("name")).alias("upper_name"), F.md5("name").alias("digest"), F.col("name").alias("str"))


@query("""with o as (select p_brand, min(p_partkey) as k from part group by 1), c as (select p_brand, row_number() over (order by k) - 1 as code from o)
  select p_partkey, cast(code as bigint) as code, cast(i as bigint) as dim, case when i = code then 1.0::double else 0.0::double end as x from part join c using (p_brand), (select unnest(range(0, 25)) as i) where i < (select count(*) from o)""")
def first_seen_category(spark, sf):
    """One-hot categories, numbered in the order in which they are first seen; at most 499."""
    return reshape.category_one_hot(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand")


_HITS = "with h as (select o_custkey % 40 as a, o_orderkey % 30 as b, o_totalprice / 100.0 as e, cast(o_orderkey as bigint) as id from orders where o_orderkey % 7 = 0)"


@query(_HITS + """, best as (select a, b, min(e) as e, arg_min(id, (e, id)) as hit from h group by 1, 2)
  select cast(x as bigint) as a, cast(y as bigint) as b, round(coalesce(best.e, 9999), 4) as evalue, hit from (select unnest(range(0, 40)) as x) cross join (select unnest(range(0, 30)) as y) left join best on a = x and b = y""")
def best_alignment(spark, sf):
    """Least value of the alignments of each pair from a tab-separated file, 9999 without any."""
    path = _shared(spark)
    o = table(spark, sf, "orders").where("o_orderkey % 7 = 0")
    files.write_edges(o.select((F.col("o_custkey") % 40).alias("a"), (F.col("o_orderkey") % 30).alias("b"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice").cast("double") / 100).alias("e")), path)
    hits = files.read_edges(spark, path)
    axes = lambda n, c: spark.range(n).select(F.col("id").alias(c))
    best = hits.groupBy(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).agg(F.min("evalue").alias("evalue"), F.min_by(F.col("id").cast("long"), F.struct("evalue", F.col("id").cast("long"))).alias("hit"))
    pairs = axes(40, "a").join(axes(30, "b"))
    return pairs.join(best, ["a", "b"], "left").select("a", "b", F.round(F.coalesce(F.nanvl("evalue", F.lit(None).cast("double")), F.lit(9999.0)), 4).alias("evalue"), "hit")


@query("with n as (select distinct p_name as name from part), r as (select name, row_number() over (order by length(name), name) - 1 as k from n) select name, cast(length(name) as bigint) as size, cast(k // 8 as bigint) as batch from r")
def length_batches(spark, sf):
    """Sequences by length in batches of eight."""
    n = names(spark, sf).withColumn("size", F.length("name").cast("long"))
    return numbered(n, ["size", "name"], "k").select("name", "size", F.floor(F.col("k") / 8).cast("long").alias("batch"))


@query("with n as (select distinct p_name as name from part) select name, cast(length(name) as bigint) as size, rpad(name, (select max(length(name)) from n)::integer, '_') as padded from n")
def padded_batch(spark, sf):
    """Rows padded to the longest, with their lengths."""
    n = names(spark, sf).withColumn("size", F.length("name").cast("long"))
    longest = n.agg(F.max("size").cast("int").alias("longest"))
    return n.join(F.broadcast(longest)).select("name", "size", F.rpad("name", F.col("longest"), F.lit("_")).alias("padded"))


@query("select vec_id, round(1 / (1 + exp(-cast(embedding[1] as double))), 6) as p, round(least(greatest(cast(embedding[2] as double), 0), 0.1), 6) as clamped from embeddings")
def sigmoid_clamp(spark, sf):
    """sigmoid of an output; a value held within bounds."""
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", r6(1 / (1 + F.exp(-x[0])), "p"), r6(F.least(F.greatest(x[1], F.lit(0.0)), F.lit(0.1)), "clamped"))


_POOLED = _RES + ", sel as ({at}) select vec_id, cast(dim as integer) as dim, round(coalesce(avg(case when pos in (select pos from sel) then x end), 0), 6) as x from r group by 1, 2"


def _pooled(spark: SparkSession, sf: str, at: DataFrame) -> DataFrame:
    m = residue_matrix(spark, sf)
    return msa.pool_positions(m, m.select("vec_id").join(F.broadcast(at.select("pos").limit(8))), "vec_id").select("vec_id", "dim", r6("x", "x"))


@query(_POOLED.format(at="select pos from (select unnest(range(0, 8)) as pos) order by md5('5:' || pos) limit 3"))
def pool_random(spark, sf):
    """Mean over reference positions drawn by a seed."""
    return _pooled(spark, sf, spark.range(8).select(F.col("id").cast("int").alias("pos")).orderBy(shuffle_key(5, "pos")).limit(3))


@query(_POOLED.format(at="select distinct pos from (select i - 1 as pos from (select unnest(range(1, 9)) as i)) order by md5('6:' || pos) limit 4"))
def pool_random_columns(spark, sf):
    """Mean over alignment columns drawn by a seed."""
    columns = msa.residues(aligned(spark, sf)).where("pos < 8").select("pos").distinct()
    return _pooled(spark, sf, columns.orderBy(shuffle_key(6, "pos")).limit(4))


_COLUMNS = _ALIGNED.removeprefix("with ").replace("range(1, 13)", "range(1, 9)")


@query("with " + _COLUMNS + """, c as (select pos, sum(case when ch = '-' then 1 else 0 end) as gaps from p group by 1), sel as (select pos from c where gaps <= (select max(v) from (select gaps as v from c order by 1 limit 3)) order by md5('1:' || pos), pos limit 3), """ + _RES.removeprefix("with ") + " select vec_id, cast(dim as integer) as dim, round(coalesce(avg(case when pos in (select pos from sel) then x end), 0), 6) as x from r group by 1, 2")
def pool_covered_columns(spark, sf):
    """Mean over the best covered alignment columns."""
    return _pooled(spark, sf, msa.ranked_columns(names(spark, sf).withColumn("aligned", F.substring(F.rpad("name", 12, "-"), 1, 8)), 3, "coverage"))


@query("with " + _COLUMNS + """, h as (select pos, ch, count(*) as n from p group by 1, 2), c as (select pos, -coalesce(max(case when ch <> '-' then n end), 0) as v from h group by 1), sel as (select pos from c where v <= (select max(v) from (select v from c order by 1 limit 3)) order by md5('1:' || pos), pos limit 3), """ + _RES.removeprefix("with ") + " select vec_id, cast(dim as integer) as dim, round(coalesce(avg(case when pos in (select pos from sel) then x end), 0), 6) as x from r group by 1, 2")
def pool_conserved_columns(spark, sf):
    """Mean over the most conserved alignment columns."""
    return _pooled(spark, sf, msa.ranked_columns(names(spark, sf).withColumn("aligned", F.substring(F.rpad("name", 12, "-"), 1, 8)), 3, "conservation"))


@query(_RES + " select vec_id, cast(pos as integer) as pos, cast(dim as integer) as dim, round(x, 6) as x from r where pos < 1 + vec_id % 8")
def unpooled(spark, sf):
    """The residue matrix itself, trimmed to the sequence's length."""
    m = residue_matrix(spark, sf).select("vec_id", F.posexplode(F.slice("residues", F.lit(1), (1 + F.col("vec_id") % 8).cast("int"))).alias("pos", "row"))
    return m.select("vec_id", "pos", F.posexplode("row").alias("dim", "x")).withColumn("x", F.round("x", 6))


# --- files, caches, configurations --------------------------------------------------------------------------------


@query("select cast(row_number() over (order by s_suppkey) - 1 as bigint) as place, s_name as seq, cast(s_nationkey as varchar) as sub, case when s_suppkey % 4 <> 0 then cast(s_acctbal as double) end as activity from supplier")
def grid_csv(spark, sf):
    """A grid written as CSV with an index, blank and NaN cells, and read again; features are left out."""
    path = _shared(spark)
    key = F.col("s_suppkey")
    cell = F.when(key % 4 != 0, F.col("s_acctbal").cast("string")).when(key % 8 == 0, "NaN")
    rows = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("SEQ"), F.col("s_nationkey").cast("string").alias("SUBSTRATES"), cell.alias("activity"), F.lit("x").alias("seq_features"))
    files.export_rows(numbered(rows, ["s_suppkey"], "idx").select("idx", "SEQ", "SUBSTRATES", "activity", "seq_features"), path)
    back = files.read_grid(spark, path, ["activity"])
    return numbered(back, ["seq"], "place").select("place", "seq", "sub", "activity")


@query(GRID + FOLDS + " select trial, fold, seq from folds")
def split_files(spark, sf):
    """The assignment of folds written as a table and read again."""
    from gridlark.operators import splits

    path = _shared(spark)
    splits.kfold(grid(spark, sf), "seq", 5, 2).select("trial", "fold", "seq").write.parquet(path)
    return spark.read.parquet(path)


@query("select p_type as category, count(*) as n from part where p_type in ('PROMO', 'SMALL') and p_size <= 30 group by 1")
def category_files(spark, sf):
    """Categories and groups of items as tables instead of pickles, read by name."""
    path = _shared(spark)
    files.write_groups(table(spark, sf, "part").select(F.col("p_type").alias("group"), F.col("p_partkey").alias("item"), "p_size"), path)
    return files.read_groups(spark, path, ["PROMO", "SMALL"]).where("p_size <= 30").groupBy(F.col("group").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("select vec_id, round(list_sum(embedding::double[]), 6) as total from embeddings")
def feature_cache(spark, sf):
    """Features stored under a digest of their properties and the dataset's name, computed once."""
    root = _shared(spark)
    how = {"dataset": sf.rstrip("/").rsplit("/", 1)[-1], "features": "sum", "version": 1}
    build = lambda: table(spark, sf, "embeddings").select("vec_id", r6(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), "total"))
    files.cached(spark, root, how, build)
    return files.cached(spark, root, how, lambda: build().where("false"))  # the second call reads what the first one wrote


@query("with n as (select distinct p_name as name from part) select x.name as a, y.name as b, levenshtein(x.name, y.name) as dist from n x join n y on x.name < y.name")
def distance_cache(spark, sf):
    """Distances of pairs stored and read again."""
    from gridlark.plans.catalogue import name_pairs

    root = _shared(spark)
    build = lambda: name_pairs(spark, sf).select("a", "b", F.levenshtein("a", "b").cast("long").alias("dist"))
    files.cached(spark, root, {"distance": "levenshtein"}, build)
    return files.cached(spark, root, {"distance": "levenshtein"}, lambda: build().where("false"))


@query(RESULTS + ", m as (select model, round(avg(score), 2) as score from res group by 1) select cast(0 as bigint) as place, '\\begin{tabular}{ll}' as line union all select 1, 'model & score \\\\' union all select 1 + row_number() over (order by model), model || ' & ' || printf('%.2f', score) || ' \\\\' from m union all select 2 + (select count(*) from m), '\\end{tabular}'")
def latex_table(spark, sf):
    """A table of summaries as LaTeX."""
    m = results(spark, sf).groupBy("model").agg(F.round(F.avg("score"), 2).alias("score"))
    rows = sorted((r["model"], f"{r['score']:.2f}") for r in m.collect())  # a row a model
    from gridlark.operators.report import latex_lines

    return spark.createDataFrame(list(enumerate(latex_lines(["model", "score"], rows))), "place long, line string")


@query()
def svm(spark, sf):
    """A linear support-vector machine, fitted on four fifths of the embeddings, scores for the rest."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), (F.col("label") % 2).cast("double").alias("label"))
    return models.linear_svm(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0")).select("vec_id", "label", "pred")


@query()
def model_files(spark, sf):
    """A fitted model saved, loaded, and applied."""
    from pyspark.ml.classification import LinearSVCModel

    path = _shared(spark)
    e = models._vectors(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), (F.col("label") % 2).cast("double").alias("label")))
    models.save_model(models.fit_linear_svm(e.where("vec_id % 5 <> 0")), path)
    return models.load_model(LinearSVCModel, path).transform(e.where("vec_id % 5 = 0")).select("vec_id", F.col("prediction").alias("pred"))
