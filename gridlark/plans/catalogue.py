"""Registered queries of the evaluation engine on the star-schema tables, each with its DuckDB SQL where SQL can express it.

Roles of the tables: lineitem x part is the dense grid (supplier by brand), embeddings are item features and vectors of
residues, part names are short sequences, documents with labels are a sparse grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.functions import text as tx
from gridlark.functions import vectors as vx
from gridlark.functions.rand import shuffle_key
from gridlark.operators import cluster, metrics, models, msa, neighbors, report, reshape, scaling, splits
from gridlark.sources import files
from gridlark.sources.shared import shared_path as _shared
from gridlark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BRANDS = [f"Brand#{k}" for k in range(1, 26)]


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    """Rounded, so that the order of sums doesn't show."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


# --- grids --------------------------------------------------------------------------------------------------------

GRID = """with grid as (select l_suppkey as seq, p_brand as sub,
  cast(case when 3 * sum(case when l_returnflag = 'R' then 1 else 0 end) >= count(*) then 1 else 0 end as double) as label,
  cast(sum(cast(l_quantity as bigint)) as double) / cast(50 * count(*) as double) as pred
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""
#: The grid with a tenth of its labels missing.
MASKED = GRID + """, facts as (select seq, sub, case when cast(('0x' || substr(md5('7:' || seq || ':' || sub), 1, 8)) as bigint) / 4294967296.0 >= 0.1 then label end as label, pred from grid)"""
FOLDS = """, folds as (select trial, seq, ntile(5) over (partition by trial order by md5(trial || ':' || seq), seq) - 1 as fold
  from (select distinct seq from grid), (select unnest([0, 1]) as trial))"""


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, sub, label, pred): supplier by brand."""
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("sub"))
    lines = table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("seq"), "l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    cell = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("seq", "sub").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"), F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))
    return cell.select("seq", "sub", F.when(3 * F.col("r") >= F.col("n"), 1.0).otherwise(0.0).alias("label"), (F.col("q").cast("double") / (50 * F.col("n")).cast("double")).alias("pred"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.mask_labels(grid(spark, sf), 0.1, 7, ["seq", "sub"])


@query(GRID + " select seq, sub, label from grid")
def grid_build(spark, sf):
    """The long grid."""
    return grid(spark, sf).select("seq", "sub", "label")


@query(GRID + " select seq, " + ", ".join(f"max(case when sub = '{b}' then label end) as \"label_{b}\"" for b in BRANDS) + " from grid group by seq")
def grid_pivot(spark, sf):
    """One column per task."""
    return reshape.pivot(grid(spark, sf), "seq", "sub", BRANDS)


@query(GRID + " select seq, sub, 'label' as label_name, label from grid")
def grid_unpivot(spark, sf):
    """The pivoted grid back in long form."""
    return reshape.unpivot(reshape.pivot(grid(spark, sf), "seq", "sub", BRANDS), "seq", "sub")


_VALID = """select {t}, count(label) as n, coalesce(sum(case when label = 1 then 1 else 0 end), 0) as n_pos from facts group by {t}"""
_SKIP = "n <= 2 or n_pos < 2 or n_pos / cast(n as double) > 0.9 or n_pos / cast(n as double) < 1.0::double - 0.9::double"


@query(MASKED + f" select sub, n, cast(n_pos as bigint) as n_pos, ({_SKIP}) as skip from ({_VALID.format(t='sub')})")
def task_validity(spark, sf):
    """Which tasks have enough labels and balance."""
    return reshape.task_validity(facts(spark, sf), "sub")


@query(MASKED + f""" select count(*) as n_rows, count(distinct seq) as n_seq, count(distinct sub) as n_sub,
  (select cast(coalesce(sum(case when not ({_SKIP}) then 1 else 0 end), 0) as bigint) from ({_VALID.format(t='seq')})) as valid_seq,
  (select cast(coalesce(sum(case when not ({_SKIP}) then 1 else 0 end), 0) as bigint) from ({_VALID.format(t='sub')})) as valid_sub from facts""")
def dataset_summary(spark, sf):
    """A10: rows, distinct values and valid tasks of both axes."""
    return reshape.dataset_summary(facts(spark, sf))


@query("select l_suppkey as seq, l_partkey as sub, count(*) as n from lineitem where l_partkey in (select p_partkey from part where p_type = 'PROMO') group by 1, 2")
def category_semi(spark, sf):
    """Rows whose substrate is in a category."""
    items = table(spark, sf, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("sub"))
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("seq"), F.col("l_partkey").alias("sub"))
    return reshape.semi(rows, items, "sub").groupBy("seq", "sub").agg(F.count(F.lit(1)).alias("n"))


@query(GRID + FOLDS + " select case when fold = 0 then 'test' else 'train' end as role, count(*) as n, cast(sum(label) as bigint) as n_pos from grid join folds using (seq) where trial = 0 group by 1")
def leftout_semi_anti(spark, sf):
    """Held-out values by semi join, all others by anti join."""
    g = grid(spark, sf)
    out = splits.kfold(g, "seq", 5).where("fold = 0").select("seq")
    both = g.join(out, "seq", "left_semi").withColumn("role", F.lit("test")).union(g.join(out, "seq", "left_anti").withColumn("role", F.lit("train")))
    return both.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("n_pos"))


# --- splits -------------------------------------------------------------------------------------------------------


@query(GRID + FOLDS + " select trial, seq, fold, fold || '_' || trial as name from folds")
def kfold_assign(spark, sf):
    """Folds of distinct values for two trials."""
    return splits.kfold(grid(spark, sf), "seq", 5, 2).withColumn("name", splits.fold_name(F.col("fold"), F.col("trial")))


@query(GRID + " select f.sub as fold, case when g.sub = f.sub then 'test' else 'train' end as role, count(*) as n from grid g, (select distinct sub from grid) f group by 1, 2")
def loo_folds(spark, sf):
    """Each substrate held out in turn."""
    g = grid(spark, sf)
    folds = splits.leave_one_out(g, "sub")
    sizes = g.groupBy("sub").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy()))  # one row a value
    test = folds.join(sizes, "sub").select("fold", F.lit("test").alias("role"), "n")
    return test.union(folds.join(sizes, "sub").select("fold", F.lit("train"), F.col("all") - F.col("n")))


@query(GRID + """ select trial, seq, sub, case when r <= floor(n * 0.8::double) then 'train' when r <= floor(n * (0.8::double + 0.1::double)) then 'val' else 'test' end as role
  from (select trial, seq, sub, row_number() over (partition by trial order by md5(trial || ':' || seq || ':' || sub), seq, sub) as r, count(*) over (partition by trial) as n from grid, (select unnest([0, 1]) as trial))""")
def random_split(spark, sf):
    """Shuffled rows cut at shares, two trials."""
    return splits.random_split(grid(spark, sf), ["seq", "sub"], 0.8, 0.1, 0.1, 2)


_ROLES = GRID + FOLDS + """, roles as (select trial, fold, seq, sub, case when test then 'test' when row_number() over w <= floor((1 - 0.1::double) * count(*) over (partition by trial, fold, test)) then 'train' else 'val' end as role
  from (select t.trial, f.fold, seq, sub, t.fold = f.fold as test from grid join folds t using (seq) join (select distinct trial, fold from folds) f on f.trial = t.trial)
  window w as (partition by trial, fold, test order by md5(trial || ':' || seq || ':' || sub), seq, sub))"""


@query(_ROLES + " select trial, fold, seq, sub, role from roles")
def val_carve(spark, sf):
    """Roles of all rows in all folds, in one job."""
    g = grid(spark, sf)
    return splits.fold_roles(g, splits.kfold(g, "seq", 5, 2), "seq", ["seq", "sub"], 0.1)


@query("select s_nationkey as fold, count(*) as n from supplier group by 1")
def grouped_split(spark, sf):
    """Predefined groups of items as folds."""
    groups = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("item"))
    return splits.grouped(groups, "seq").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query(MASKED + " select seq, sub, label from facts")
def mask_labels(spark, sf):
    """A random share of labels masked."""
    return facts(spark, sf).select("seq", "sub", "label")


@query(GRID + " select seq, sub, label from grid where sub in (select sub from (select distinct sub from grid) order by md5('3:' || sub), sub limit 5)")
def task_subset(spark, sf):
    """Rows of five random tasks."""
    return reshape.task_subset(grid(spark, sf), "sub", 5, 3).select("seq", "sub", "label")


# --- metrics ------------------------------------------------------------------------------------------------------

_CONFUSION = MASKED + """, c as (select sub, sum(case when label = 1 and pred >= 0.5 then 1.0::double else 0 end) as tp, sum(case when label <> 1 and pred >= 0.5 then 1.0::double else 0 end) as fp,
  sum(case when label = 1 and pred < 0.5 then 1.0::double else 0 end) as fn, sum(case when label <> 1 and pred < 0.5 then 1.0::double else 0 end) as tn from facts where label is not null group by sub)"""
_BINARY = """select sub, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) as accuracy,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) as mcc from c"""


@query(_CONFUSION + _BINARY)
def metrics_binary(spark, sf):
    """Metrics at a cut, by task."""
    m = metrics.binary_metrics(facts(spark, sf), ["sub"])
    return m.select("sub", *(r6(c, c) for c in ("precision", "recall", "accuracy", "f1", "mcc")))


_AUC = """select sub, (sum(case when label = 1 then rk end) - p * (p + 1) / 2) / nullif(p * (n - p), 0) as auc from (
  select sub, label, rank() over (partition by sub order by pred) + (count(*) over (partition by sub, pred) - 1) / 2.0::double as rk, cast(sum(label) over (partition by sub) as double) as p, cast(count(*) over (partition by sub) as double) as n from facts where label is not null) group by sub, p, n"""
_AP = """select sub, sum(pos * prec) / nullif(sum(pos), 0) as ap from (select sub, pos, cast(sum(pos) over w as double) / cast(sum(n) over w as double) as prec from (select sub, pred, sum(label) as pos, count(*) as n from facts where label is not null group by 1, 2) window w as (partition by sub order by pred desc)) group by sub"""


@query(MASKED + f" select sub, round(auc, 6) as auc_roc from ({_AUC})")
def auc_roc(spark, sf):
    """Area under the ROC curve by task."""
    return metrics.roc_auc(facts(spark, sf), ["sub"]).select("sub", r6("auc_roc", "auc_roc"))


@query(MASKED + f" select sub, round(ap, 6) as avg_pr from ({_AP})")
def avg_precision(spark, sf):
    """Average precision by task."""
    return metrics.average_precision(facts(spark, sf), ["sub"]).select("sub", r6("avg_pr", "avg_pr"))


@query("""with f as (select l_suppkey as g, l_extendedprice as y, l_quantity as x from lineitem),
  r as (select g, rank() over (partition by g order by y) + (count(*) over (partition by g, y) - 1) / 2.0::double as a, rank() over (partition by g order by x) + (count(*) over (partition by g, x) - 1) / 2.0::double as b from f),
  s as (select g, cast(count(*) as double) as n, sum(a) as sa, sum(b) as sb, sum(a * b) as ab, sum(a * a) as aa, sum(b * b) as bb from r group by g)
  select g as seq, round((n * ab - sa * sb) / nullif(sqrt((n * aa - sa * sa) * (n * bb - sb * sb)), 0), 6) as spearman from s""")
def spearman(spark, sf):
    """Rank correlation of price and quantity by supplier."""
    f = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("seq"), F.col("l_extendedprice").alias("label"), F.col("l_quantity").alias("pred"))
    return metrics.spearman(f, ["seq"]).select("seq", r6("spearman", "spearman"))


@query(MASKED + " select sub, round(avg(abs(label - pred)), 6) as mae, round(sqrt(avg((label - pred) * (label - pred))), 6) as rmse from facts where label is not null group by sub")
def mae_rmse(spark, sf):
    """Errors by task."""
    return metrics.error_metrics(facts(spark, sf), ["sub"]).select("sub", r6("mae", "mae"), r6("rmse", "rmse"))


@query(MASKED + FOLDS + """, a as (select trial, fold, sub, avg(abs(label - pred)) as mae, sqrt(avg((label - pred) * (label - pred))) as rmse from facts join folds using (seq) where label is not null group by 1, 2, 3),
  b as (select trial, fold, avg(mae) as mae, avg(rmse) as rmse from a group by 1, 2) select trial, round(avg(mae), 6) as mae, round(avg(rmse), 6) as rmse from b group by 1""")
def metric_rollup_chain(spark, sf):
    """Metric per fold and task, then means of means."""
    f = facts(spark, sf)
    m = metrics.error_metrics(f.join(splits.kfold(grid(spark, sf), "seq", 5, 2), "seq"), ["trial", "fold", "sub"])
    return metrics.chained_means(m, ["trial", "fold", "sub"], ["mae", "rmse"]).select("trial", r6("mae", "mae"), r6("rmse", "rmse"))




@query("select 1 as run, p_brand as task, round(avg(p_retailprice), 4) as mae, round(max(p_retailprice), 4) as rmse from part group by p_brand")
def metric_melt(spark, sf):
    """Wide metric_task columns to a row per task."""
    part = table(spark, sf, "part")
    at = lambda b: F.when(F.col("p_brand") == b, F.col("p_retailprice"))
    wide = part.agg(*(x for b in BRANDS for x in (F.round(F.avg(at(b)), 4).alias(f"mae_{b}"), F.round(F.max(at(b)), 4).alias(f"rmse_{b}")))).withColumn("run", F.lit(1))
    return reshape.melt_metrics(wide, ["run"], ["mae", "rmse"])


@query(MASKED + " select 'label_' || sub as label_name, avg(label) as share from facts group by 1")
def eval_relabel(spark, sf):
    """Composite label names, and the class balance."""
    return facts(spark, sf).groupBy(F.concat_ws("_", F.lit("label"), "sub").alias("label_name")).agg(F.avg("label").alias("share"))


# --- sequences ----------------------------------------------------------------------------------------------------

_NAMES = "with names as (select distinct p_name as name from part)"


def names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()


def name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Unordered pairs of distinct short sequences (a bounded set of item names), each once."""
    n = names(spark, sf)
    return n.select(F.col("name").alias("a")).join(n.select(F.col("name").alias("b")), F.col("a") < F.col("b"))


@query(_NAMES + " select x.name as a, y.name as b, levenshtein(x.name, y.name) as dist from names x join names y on x.name < y.name")
def lev_pairs(spark, sf):
    """Edit distances of all pairs."""
    return name_pairs(spark, sf).select("a", "b", F.levenshtein("a", "b").cast("long").alias("dist"))


@query(_NAMES + " select round(avg(1 - levenshtein(x.name, y.name) / cast(greatest(length(x.name), length(y.name)) as double)), 6) as similarity from names x join names y on x.name < y.name")
def lev_mean_similarity(spark, sf):
    """Mean similarity over pairs."""
    return name_pairs(spark, sf).agg(r6(F.avg(tx.levenshtein_similarity(F.col("a"), F.col("b"))), "similarity"))


_ALIGNED = "with m as (select distinct p_name as name, rpad(p_name, 12, '-') as al from part), p as (select name, i - 1 as pos, substr(al, i, 1) as ch from m, (select unnest(range(1, 13)) as i))"


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).withColumn("aligned", F.rpad("name", 12, "-"))


def aligned_pairs(spark: SparkSession, sf: str) -> DataFrame:
    n = aligned(spark, sf)
    return n.toDF("a", "x").join(n.toDF("b", "y"), F.col("a") < F.col("b"))


@query(_ALIGNED + " select x.name as a, y.name as b, round(coalesce(cast(sum(case when x.ch <> '-' and y.ch <> '-' and x.ch <> y.ch then 1 else 0 end) as double) / nullif(sum(case when x.ch <> '-' and y.ch <> '-' then 1 else 0 end), 0), 1), 6) as dist from p x join p y on x.pos = y.pos and x.name < y.name group by 1, 2")
def hamming_pairs(spark, sf):
    """Gap-aware mismatch shares."""
    return aligned_pairs(spark, sf).select("a", "b", r6(tx.hamming_fraction(F.col("x"), F.col("y")), "dist"))


@query(_ALIGNED + " select x.name as a, y.name as b, round(cast(sum(case when x.ch = y.ch then 1 else 0 end) as double) / count(*), 6) as identity from p x join p y on x.pos = y.pos and x.name < y.name where x.ch <> '-' or y.ch <> '-' group by 1, 2")
def msa_identity(spark, sf):
    """identity of aligned rows."""
    return aligned_pairs(spark, sf).select("a", "b", r6(tx.aligned_identity(F.col("x"), F.col("y")), "identity"))


@query(_NAMES + """, k as (select name, substr(lower(name), i, n) as kmer from names, (select unnest(range(1, 64)) as i), (select unnest([2, 3]) as n) where i + n - 1 <= length(name))
  select name, kmer, round(cast(count(*) as double) / sum(count(*)) over (partition by name), 6) as freq from k group by 1, 2""")
def kmer_freq(spark, sf):
    """K-mer frequencies."""
    return scaling.kmer_frequencies(names(spark, sf), "name", tx.kmers(F.col("name"), 2, 3)).select("name", "kmer", r6("freq", "freq"))


_LETTER = "upper(ch)"
_CODE = "case " + "".join(f"when {_LETTER} = '{c}' then {k} " for c, k in tx.SHARED.items()) + f"when instr('{tx.ALPHABET}', {_LETTER}) > 0 then instr('{tx.ALPHABET}', {_LETTER}) - 1 else {tx.UNKNOWN} end"


@query(_ALIGNED + f" select name, pos, cast({_CODE} as integer) as code from p where ch <> '-'")
def alphabet_codes(spark, sf):
    """Codes of letters."""
    return names(spark, sf).select("name", F.posexplode(tx.alphabet_codes(F.col("name"))).alias("pos", "code"))


@query(_ALIGNED + f" select name, pos, i as dim, case when i = {_CODE} then 1 else 0 end as bit from p, (select unnest(range(0, 21)) as i) where ch <> '-'")
def onehot_seq(spark, sf):
    """One-hot rows."""
    rows = names(spark, sf).select("name", F.posexplode(tx.one_hot(tx.alphabet_codes(F.col("name")))).alias("pos", "row"))
    return rows.select("name", "pos", F.posexplode("row").alias("dim", "bit"))


@query("select p_brand, dense_rank() over (order by p_brand) - 1 as code, count(*) as n from part group by p_brand")
def category_codes(spark, sf):
    """Code of each category."""
    c = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return c.select("p_brand", (F.dense_rank().over(Window.orderBy("p_brand")) - 1).alias("code"), "n")  # one row a category


@query(_NAMES + ", i as (select unnest(range(0, 8)) as dim) select name, dim, round(cast(('0x' || substr(md5('5:' || name || ':' || dim), 1, 8)) as bigint) / 4294967296.0::double, 6) as x from names, i")
def random_features(spark, sf):
    """Random features by key."""
    from gridlark.functions.rand import uniform

    return names(spark, sf).withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("name", "dim", r6(uniform(5, "name", "dim"), "x"))


@query(_ALIGNED + " select pos, ch, count(*) as n from p group by 1, 2")
def msa_histogram(spark, sf):
    """Letters by column."""
    return msa.column_histogram(aligned(spark, sf))


@query(_ALIGNED + " select pos, round(avg(case when ch <> '-' then 1.0::double else 0 end), 6) as coverage, avg(case when ch <> '-' then 1.0::double else 0 end) > 0.4 as covered from p group by 1")
def msa_coverage(spark, sf):
    """Columns by share of letters."""
    return msa.column_coverage(aligned(spark, sf)).select("pos", r6("coverage", "coverage"), "covered")


@query(_ALIGNED + """, h as (select pos, ch, count(*) as n from p group by 1, 2), c as (select pos, coalesce(max(case when ch <> '-' then n end), 0) as most from h group by 1)
  select pos from (select pos, md5('1:' || pos) as k from c where -most <= (select max(v) from (select -most as v from c order by 1 limit 4))) order by k, pos limit 4""")
def msa_conservation(spark, sf):
    """Most conserved columns, ties drawn by seed."""
    return msa.ranked_columns(aligned(spark, sf), 4, "conservation")


@query(_ALIGNED + """, c as (select pos, sum(case when ch = '-' then 1 else 0 end) as gaps from p group by 1)
  select pos from (select pos, md5('1:' || pos) as k from c where gaps <= (select max(v) from (select gaps as v from c order by 1 limit 4))) order by k, pos limit 4""")
def msa_cover_columns(spark, sf):
    """Columns with fewest gaps, ties drawn by seed."""
    return msa.ranked_columns(aligned(spark, sf), 4, "coverage")


@query(_ALIGNED + " select name, pos, ch, case when ch <> '-' then cast(sum(case when ch <> '-' then 1 else 0 end) over (partition by name order by pos) - 1 as bigint) end as seq_pos from p")
def gap_maps(spark, sf):
    """Positions of columns in the ungapped sequences."""
    return msa.position_maps(aligned(spark, sf))


@query(_ALIGNED + " select name, string_agg(ch, '' order by pos) filter (where pos in (0, 2, 4, 11)) as picked from p group by 1")
def gapped_columns(spark, sf):
    """Letters of selected alignment columns."""
    return aligned(spark, sf).select("name", tx.selected_columns(F.col("aligned"), F.array(*map(F.lit, (0, 2, 4, 11)))).alias("picked"))


# --- vectors ------------------------------------------------------------------------------------------------------

_RES = "with r as (select vec_id, (i - 1) // 8 as pos, (i - 1) % 8 as dim, cast(embedding[i] as double) as x from embeddings, (select unnest(range(1, 65)) as i))"


def residue_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, residues): each embedding as 8 rows of 8."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(v, i * 8 + 1, F.lit(8))).alias("residues"))


@query(_RES + " select vec_id, cast(dim as integer) as dim, round(avg(x), 6) as x from r group by 1, 2")
def mean_pool(spark, sf):
    """Mean over residues."""
    return msa.pool_mean(residue_matrix(spark, sf), "vec_id").select("vec_id", "dim", r6("x", "x"))


@query(_RES + " select vec_id, cast(dim as integer) as dim, round(coalesce(avg(case when pos < vec_id % 4 then x end), 0), 6) as x from r group by 1, 2")
def pool_hard(spark, sf):
    """Mean over selected residues, zeros where there are none."""
    m = residue_matrix(spark, sf)
    at = m.select("vec_id", F.explode(F.expr("filter(sequence(0, 3), p -> p < vec_id % 4)")).alias("pos"))
    return msa.pool_positions(m, at, "vec_id").select("vec_id", "dim", r6("x", "x"))


@query("select vec_id, cast(i - 1 as integer) as dim, round(cast(embedding[case when i <= 8 then 8 + i else 40 + i - 8 end] as double), 6) as x from embeddings, (select unnest(range(1, 17)) as i)")
def pool_concat(spark, sf):
    """Selected residues one after the other."""
    return msa.concat_positions(residue_matrix(spark, sf), [1, 5], "vec_id").select("vec_id", F.posexplode("features").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("select vec_id, cast((i - 1) * 4 + j - 1 as integer) as dim, round(cast(embedding[i] as double) * cast(embedding[60 + j] as double), 6) + 0.0::double as x from embeddings, (select unnest(range(1, 5)) as i), (select unnest(range(1, 5)) as j)")
def outer_product(spark, sf):
    """Flattened outer product of two feature vectors."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(vx.outer(F.slice(v, 1, 4), F.slice(v, 61, 4))).alias("dim", "x")).withColumn("x", F.round("x", 6))


def split_embeddings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Queries (bucket 0 of 5) and references (the others)."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return e.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query"), e.where("vec_id % 5 <> 0").withColumnRenamed("vec_id", "ref")


_PAIRS = "from embeddings a join embeddings b on a.vec_id % 5 = 0 and b.vec_id % 5 <> 0"
_L2 = "list_distance(a.embedding::double[], b.embedding::double[])"


def _distance_query(metric: str, sql: str) -> None:
    def run(spark, sf):
        return neighbors.distances(*split_embeddings(spark, sf), metric, digits=6)

    run.__name__, run.__doc__ = f"{metric}_pairs", f"L04-L07, J06: {metric} distances of queries to references."
    query(f"select a.vec_id as query, b.vec_id as ref, round({sql}, 6) as dist {_PAIRS}")(run)


_distance_query("l1", "list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda x: abs(x[1] - x[2])))")
_distance_query("l2", _L2)
_distance_query("cosine", "greatest(0, 1 - list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])) + 1e-9))")


@query("""with b as (select vec_id, cast(sum(case when embedding[i] > 0 and i <= 60 then 1::bigint << (i - 1) else 0 end) as bigint) as bits from embeddings, (select unnest(range(1, 61)) as i) group by 1)
  select x.vec_id as query, y.vec_id as ref, round(case when (x.bits | y.bits) = 0 then null when (x.bits & y.bits) = 0 then 10000 else least(10000, cast(bit_count(x.bits | y.bits) as double) / bit_count(x.bits & y.bits)) end, 6) as dist
  from b x join b y on x.vec_id % 5 = 0 and y.vec_id % 5 <> 0""")
def tanimoto_pairs(spark, sf):
    """Union over intersection of sign bits."""
    q, r = split_embeddings(spark, sf)
    bits = lambda df: df.withColumn("vector", vx.sign_vector(F.slice("vector", 1, 60)))
    d = neighbors.distances(bits(q), bits(r), "tanimoto", digits=6)
    return d.select("query", "ref", F.nanvl("dist", F.lit(None).cast("double")).alias("dist"))


@query(f"""with d as (select a.vec_id as query, b.vec_id as ref, 1 - list_cosine_distance(a.embedding::double[], b.embedding::double[]) as s {_PAIRS}), k as (select query, s, row_number() over (partition by query order by s desc, ref) as r from d)
  select query, round(avg(s), 5) as top5_similarity from k where r <= 5 group by 1""")
def top5_similarity(spark, sf):
    """Mean of the five largest similarities."""
    near = neighbors.distances(*split_embeddings(spark, sf), "cosine", k=5)
    return near.withColumn("similarity", 1 - F.col("dist")).groupBy("query").agg(F.round(F.avg("similarity"), 5).alias("top5_similarity"))


_RANKED = f"""with d as (select a.vec_id as query, b.vec_id as ref, {_L2} as d, list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda x: abs(x[1] - x[2]))) as e {_PAIRS}),
  k as (select query, ref, d, row_number() over (partition by query order by d, ref) - 1 as r, row_number() over (partition by query order by e, ref) - 1 as s from d)"""


@query(_RANKED + " select query, ref, cast(case when r < 10 then r else 11 end as integer) as rank from k")
def rank_sparse(spark, sf):
    """Ranks of the ten nearest, all others alike."""
    return neighbors.ranked_pairs(*split_embeddings(spark, sf), ["l2"], 10)


@query(_RANKED + " select query, ref, cast(case when r < 10 then r else 11 end + case when s < 10 then s else 11 end as integer) as dist from k")
def rank_fusion(spark, sf):
    """Sum of two ranks."""
    return neighbors.ranked_pairs(*split_embeddings(spark, sf), ["l2", "l1"], 10).withColumnRenamed("rank", "dist")


_KNN = _RANKED + ", p as (select query, avg({label}) as pred from k join embeddings on vec_id = ref where r < 5 group by 1)"


def _knn(spark: SparkSession, sf: str, label) -> DataFrame:
    near = neighbors.distances(*split_embeddings(spark, sf), "l2", k=5)
    return neighbors.knn_predict(near, table(spark, sf, "embeddings").select(F.col("vec_id").alias("ref"), label.alias("label")))


@query(_KNN.format(label="case when label = 3 then 1.0::double else 0 end") + " select query, round(pred, 6) as pred from p")
def knn_classify(spark, sf):
    """Share of the five nearest in a class."""
    return _knn(spark, sf, F.when(F.col("label") == 3, 1.0).otherwise(0.0)).select("query", r6("pred", "pred"))


@query(_KNN.format(label="cast(label as double)") + " select query, round(pred, 6) as pred from p")
def knn_regress(spark, sf):
    """Mean label of the five nearest."""
    return _knn(spark, sf, F.col("label").cast("double")).select("query", r6("pred", "pred"))


_EVAL = _RANKED + """, n as (select query, q.label as own, e.label as near from k join embeddings e on e.vec_id = ref join embeddings q on q.vec_id = query where r < 5),
  facts as (select 'class_' || c as sub, query, case when own = c then 1.0::double else 0 end as label, avg(case when near = c then 1.0::double else 0 end) as pred from n, (select distinct label as c from embeddings) group by c, query, own)"""


@query(_EVAL + f", a as ({_AUC}), b as ({_AP}) select sub, round(auc, 6) as auc_roc, round(ap, 6) as avg_pr from a join b using (sub)")
def knn_eval(spark, sf):
    """One experiment end to end: nearest neighbours of a held-out fold, prediction facts, metrics per class."""
    near = neighbors.distances(*split_embeddings(spark, sf), "l2", k=5)
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    own = labels.select(F.col("vec_id").alias("query"), F.col("label").alias("own"))
    n = near.join(labels.select(F.col("vec_id").alias("ref"), F.col("label").alias("near")), "ref").join(own, "query")
    classes = labels.select(F.col("label").alias("c")).distinct()
    f = n.join(F.broadcast(classes), F.lit(True)).groupBy("c", "query", "own").agg(F.avg(F.when(F.col("near") == F.col("c"), 1.0).otherwise(0.0)).alias("pred"))
    f = f.select(F.concat_ws("_", F.lit("class"), "c").alias("sub"), F.when(F.col("own") == F.col("c"), 1.0).otherwise(0.0).alias("label"), "pred")
    return metrics.evaluate(f, ["sub"], ("auc_roc", "avg_pr")).select("sub", r6("auc_roc", "auc_roc"), r6("avg_pr", "avg_pr"))


@query(_RES + """, p as (select a.vec_id as a, b.vec_id as b, a.pos as i, b.pos as j, sum(abs(a.x - b.x)) as d from r a join r b on a.dim = b.dim and b.vec_id = a.vec_id + 1 group by 1, 2, 3, 4),
  s as (select a, b, d, exp(-d) / sum(exp(-d)) over (partition by a, b, i) as al, exp(-d) / sum(exp(-d)) over (partition by a, b, j) as be from p)
  select a, b, round(sum((al + be - al * be) * d) / sum(al + be - al * be), 6) as dist from s group by 1, 2""")
def soft_align(spark, sf):
    """Soft symmetric alignment of each item with the next."""
    m = residue_matrix(spark, sf).select("vec_id", F.posexplode("residues").alias("pos", "row"))
    a, b = m.toDF("a", "i", "x"), m.toDF("b", "j", "y")
    pairs = a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", "i", "j", vx.l1(F.col("x"), F.col("y")).alias("d"))
    return neighbors.soft_alignment(pairs).select("a", "b", r6("dist", "dist"))


# --- scaling and selection ----------------------------------------------------------------------------------------

_LONG = "with f as (select vec_id, cast(i - 1 as integer) as dim, cast(embedding[i] as double) as x, label from embeddings, (select unnest(range(1, 65)) as i))"


def long_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return scaling.long_form(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


@query(_LONG + " select vec_id, f.dim, round((x - m) / case when s > 0 then s else 1 end, 6) as x from f join (select dim, avg(x) as m, stddev_pop(x) as s from f where vec_id % 5 <> 0 group by 1) using (dim)")
def std_scale(spark, sf):
    """Standardised features, fitted on four buckets."""
    f = long_embeddings(spark, sf)
    return scaling.standard_scale(f, f.where("vec_id % 5 <> 0")).select("vec_id", "dim", r6("x", "x"))


@query("select p_partkey, p_brand, round((p_retailprice - m) / case when s > 0 then s else 1 end, 6) as y from part join (select p_brand, avg(p_retailprice) as m, stddev_pop(p_retailprice) as s from part where p_partkey % 5 <> 0 group by 1) using (p_brand)")
def target_scale(spark, sf):
    """Standardised targets by task."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("y"))
    return scaling.standard_scale(p, p.where("p_partkey % 5 <> 0"), ["p_brand"], "y").select("p_partkey", "p_brand", r6("y", "y"))


@query("select p_partkey, p_brand, round(p_retailprice, 4) as y from part")
def target_unscale(spark, sf):
    """Targets scaled and brought back."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("y"))
    scaled = scaling.standard_scale(p, p, ["p_brand"], "y")
    return scaling.inverse_scale(scaled, p, ["p_brand"], "y").select("p_partkey", "p_brand", F.round("y", 4).alias("y"))


@query(_LONG + " select dim, round(var_pop(x), 6) as variance from f group by 1 having var_pop(x) > 0.0155")
def var_select(spark, sf):
    """Dimensions of enough variance."""
    return scaling.variance_select(long_embeddings(spark, sf), 0.0155).select("dim", r6("variance", "variance"))


@query(_LONG + """, s as (select dim, label, sum(abs(x)) as seen from f group by 1, 2), c as (select label, count(*) / cast((select count(*) from embeddings) as double) as share from embeddings group by 1), t as (select dim, sum(abs(x)) as total from f group by 1)
  select dim, round(sum((seen - share * total) * (seen - share * total) / nullif(share * total, 0)), 6) as chi2 from s join c using (label) join t using (dim) group by 1 order by 2 desc, 1 limit 30""")
def chi2_select(spark, sf):
    """Dimensions that differ most by class."""
    f = long_embeddings(spark, sf).withColumn("x", F.abs("x"))
    return scaling.chi2_select(f, "label", 30).select("dim", r6("chi2", "chi2"))


@query()
def pca_project(spark, sf):
    """Centred projection on ten axes; signs are arbitrary, so variances by axis are returned."""
    p = scaling.pca(table(spark, sf, "embeddings"), "vec_id", "embedding", 10)
    return p.select(F.posexplode("components").alias("axis", "x")).groupBy("axis").agg(F.round(F.var_pop("x"), 6).alias("variance"))


# --- models -------------------------------------------------------------------------------------------------------


def model_rows(spark: SparkSession, sf: str, label) -> DataFrame:
    """(key, features, label, role): the embeddings; one bucket of five is test, one validation."""
    role = F.when(F.col("vec_id") % 5 == 0, "test").when(F.col("vec_id") % 5 == 1, "val").otherwise("train")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("features"), label.alias("label"), role.alias("role"))


def _fitted(name: str, doc: str, label, fit: Callable) -> None:
    def run(spark, sf):
        rows = model_rows(spark, sf, label())
        return fit(rows.where("role <> 'test'"), rows.where("role = 'test'")).select("key", F.round("pred", 6).alias("pred"))

    run.__name__, run.__doc__ = name, doc
    query()(run)


_is_three = lambda: F.when(F.col("label") == 3, 1.0).otherwise(0.0)
_fitted("ridge", "B01: ridge regression of one task by Spark ML (of all tasks: ridge_tasks).", lambda: F.col("label").cast("double"), models.ridge)
_fitted("logistic", "B02: balanced logistic regression of one task by Spark ML (of all tasks: logistic_tasks).", _is_three, models.logistic)
_fitted("rf", "B04: random forest of one task by Spark ML.", _is_three, lambda a, b: models.forest(a, b, trees=20, depth=5))


@query()
def mlp(spark, sf):
    """An ensemble of two networks for each of two tasks; a task has to fit a worker (see multitask_network)."""
    rows = model_rows(spark, sf, F.col("label").cast("double"))
    tasks = rows.withColumn("task", F.explode(F.array(F.lit(3), F.lit(7)))).withColumn("label", F.when(F.col("label") == F.col("task"), 1.0).otherwise(0.0))
    return models.network_per_task(tasks, "task", "key", members=2, epochs=3).select("task", "key", F.round("pred", 6).alias("pred"))


@query()
def gaussian_process(spark, sf):
    """Gaussian-process regression."""
    rows = model_rows(spark, sf, F.col("label").cast("double")).withColumn("task", F.lit("all"))
    return models.gaussian_process(rows, "task", "key").select("key", F.round("pred", 6).alias("pred"))


@query(_ROLES + ", x as (select g.seq, g.sub, label, role from grid g join roles r on r.seq = g.seq and r.sub = g.sub where trial = 0 and fold = 0) select seq, x.sub, round(coalesce(p, (select avg(label) from x where role = 'train')), 6) as pred from x left join (select sub, avg(label) as p from x where role = 'train' group by 1) t on t.sub = x.sub where role = 'test'")
def constant_rate(spark, sf):
    """Each task's training rate."""
    return models.constant(_with_roles(spark, sf), ["sub"]).where("role = 'test'").select("seq", "sub", r6("pred", "pred"))


def _with_roles(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf)
    roles = splits.fold_roles(g, splits.kfold(g, "seq", 5, 2), "seq", ["seq", "sub"], 0.1).where("trial = 0 and fold = 0")
    return g.select("seq", "sub", "label").join(roles.select("seq", "sub", "role"), ["seq", "sub"])


@query(_ROLES + ", x as (select g.seq, g.sub, label, role from grid g join roles r on r.seq = g.seq and r.sub = g.sub where trial = 0 and fold = 0) select seq, x.sub, case when cast(('0x' || substr(md5('9:' || seq || ':' || x.sub), 1, 8)) as bigint) / 4294967296.0::double < coalesce(p, 0) then 1.0::double else 0 end as pred from x left join (select sub, avg(case when label = 1 then 1.0::double else 0 end) as p from x where role = 'train' group by 1) t on t.sub = x.sub where role = 'test'")
def random_guess(spark, sf):
    """Draws with each task's training rate."""
    return models.random_guess(_with_roles(spark, sf), ["sub"], ["seq", "sub"], 9).where("role = 'test'").select("seq", "sub", "pred")


@query(_RANKED + """, g as (select kk, query, avg(cast(e.label as double)) as pred from k join embeddings e on e.vec_id = ref, (select unnest(range(1, 11)) as kk) where r < kk group by 1, 2)
  select kk as k, round(sqrt(avg((q.label - pred) * (q.label - pred))), 6) as rmse from g join embeddings q on q.vec_id = query group by 1""")
def tune_knn(spark, sf):
    """All k of a grid scored in one job from one ranked join."""
    near = neighbors.distances(*split_embeddings(spark, sf), "l2", k=10)
    labels = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"))
    grown = near.join(labels.select(F.col("vec_id").alias("ref"), "label"), "ref").withColumn("k", F.explode(F.sequence(F.col("rank"), F.lit(10))))
    pred = grown.groupBy("k", "query").agg(F.avg("label").alias("pred"))
    return metrics.error_metrics(pred.join(labels.select(F.col("vec_id").alias("query"), "label"), "query"), ["k"]).select("k", r6("rmse", "rmse"))


@query("""with x as (select 'a' as task, vec_id as key, case when vec_id % 7 <> 0 then label % 2 end as y from embeddings union all select 'b', vec_id, case when label > 6 then 1 else 0 end from embeddings),
  w as (select task, key, case when y is null then 0.0::double else 0.5::double / count(*) over (partition by task, y) end as w from x), v as (select key, w / nullif(sum(w) over (partition by task), 0) as w from w)
  select key, round(avg(w), 8) as weight from v group by 1""")
def sampler_weights(spark, sf):
    """Weights of a balanced sampler over two tasks."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), "label")
    a = e.select(F.lit("a").alias("task"), "key", F.when(F.col("key") % 7 != 0, F.col("label") % 2).alias("label"))
    b = e.select(F.lit("b").alias("task"), "key", F.when(F.col("label") > 6, 1).otherwise(0).alias("label"))
    return models.balanced_sampler_weights(a.union(b), "task", "key").select("key", F.round("weight", 8).alias("weight"))


@query(MASKED + f""", v as (select sub from (select sub, n, n_pos from ({_VALID.format(t='sub')})) where not ({_SKIP}))
  select 0 as trial, g.sub, cast(f.seq as varchar) as fold, g.seq, case when g.seq = f.seq then 'test' else 'train' end as role from facts g join v on v.sub = g.sub join facts f on f.sub = g.sub""")
def single_split(spark, sf):
    """Leave-one-out of one axis within each valid value of the other."""
    f = facts(spark, sf)
    return splits.within_values(f, "sub", "seq", reshape.task_validity(f, "sub"))


@query(_RES + """, c as (select vec_id, pos, list(x order by dim) as v from r where (vec_id + pos) % 4 <> 0 group by 1, 2)
  select a.vec_id as a, b.vec_id as b, round(avg(list_distance(a.v, b.v)), 6) as dist from c a join c b on b.vec_id = a.vec_id + 1 and a.pos = b.pos group by 1, 2""")
def aligned_distance(spark, sf):
    """Mean distance of residues in the same alignment columns, each item with the next."""
    r = residue_matrix(spark, sf).select(F.col("vec_id").alias("name"), F.posexplode("residues").alias("column", "vector")).where("(name + column) % 4 <> 0")
    ids = table(spark, sf, "embeddings").select("vec_id")
    pairs = ids.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return neighbors.aligned_distance(r, pairs).select("a", "b", r6("dist", "dist"))


@query(_RES + """, t as (select vec_id, pos, list(x order by dim) as v from r group by 1, 2), f as (select pos as ref, v as rv from t where vec_id = 0 and pos < 3),
  d as (select vec_id, pos, ref, v, exp(-list_sum(list_transform(list_zip(v, rv), lambda x: abs(x[1] - x[2])))) as e from t, f), w as (select *, e / sum(e) over (partition by vec_id, ref) as w from d),
  p as (select vec_id, ref, i - 1 as dim, sum(w * v[i]) as x from w, (select unnest(range(1, 9)) as i) group by 1, 2, 3)
  select vec_id as key, cast(dim as integer) as dim, round(avg(x), 6) as x from p group by 1, 2""")
def pool_soft(spark, sf):
    """Residues pooled by attention to the residues of a reference."""
    m = residue_matrix(spark, sf).select(F.col("vec_id").alias("key"), F.posexplode("residues").alias("pos", "vector"))
    ref = m.where("key = 0 and pos < 3").select(F.col("pos").alias("ref"), "vector")
    return neighbors.soft_pool(m, ref).select("key", "dim", r6("x", "x"))


@query(_RANKED + """, e as (select kk as member, query, avg(cast(label as double)) as pred from k join embeddings on vec_id = ref, (select unnest([3, 5, 7]) as kk) where r < kk group by 1, 2)
  select query, round(avg(pred), 6) as pred, round(stddev_pop(pred), 6) as spread from e group by 1""")
def ensemble(spark, sf):
    """Mean and deviation over the members of an ensemble."""
    near = neighbors.distances(*split_embeddings(spark, sf), "l2", k=7)
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ref"), F.col("label").cast("double").alias("label"))
    members = near.join(labels, "ref").withColumn("member", F.explode(F.array(F.lit(3), F.lit(5), F.lit(7)))).where(F.col("rank") <= F.col("member"))
    pred = members.groupBy("member", "query").agg(F.avg("label").alias("pred"))
    return models.ensemble(pred, ["query"]).select("query", r6("pred", "pred"), r6("spread", "spread"))


@query()
def outer_features(spark, sf):
    """Outer products of two selected feature vectors, projected; variances by axis."""
    e = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 16).alias("a"), F.slice("embedding", 17, 16).alias("b"))
    p = scaling.outer_features(e, "a", "b", "vec_id", "vec_id % 5 <> 0", 0.1, 5)
    return p.select(F.posexplode("components").alias("axis", "x")).groupBy("axis").agg(F.round(F.var_pop("x"), 8).alias("variance"))


@query()
def loss_curves(spark, sf):
    """Loss by epoch and the best epoch of each task."""
    rows = model_rows(spark, sf, _is_three()).withColumn("task", F.lit("three"))
    curve = models.loss_curve(rows, "task", epochs=4)
    return curve.join(models.best_epoch(curve, "task").withColumnRenamed("epoch", "best"), "task").withColumn("loss", F.round("loss", 6))


@query()
def tune_ridge(spark, sf):
    """A grid of penalties of ridge regression by mean squared error on two folds."""
    rows = model_rows(spark, sf, F.col("label").cast("double"))
    folds = [(rows.where(F.col("key") % 3 != f), rows.where(F.col("key") % 3 == f)) for f in (0, 1)]
    scores = models.tune_linear(folds, [-1, 0, 1, 2])
    return spark.createDataFrame([(p, round(s, 6)) for p, s in scores.items()], "power int, mse double")


# --- reports ------------------------------------------------------------------------------------------------------

_RUNS = "with runs as (select p_type as ds, p_brand as method, l_linenumber as seed, l_discount as v from lineitem join part on l_partkey = p_partkey)"
_CI = _RUNS + ", m as (select ds, method, seed, avg(v) as m from runs group by 1, 2, 3), ci as (select ds, method, avg(m) as mean, 1.96 * stddev_samp(m) / sqrt(count(m)) as half from m group by 1, 2)"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """(ds, method, seed, v): results of methods on data sets."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("ds"), F.col("p_brand").alias("method"))
    return table(spark, sf, "lineitem").select("l_partkey", F.col("l_linenumber").alias("seed"), F.col("l_discount").alias("v")).join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


@query(_CI + " select ds, method, round(mean, 6) as mean, round(half, 6) as half from ci")
def seed_ci(spark, sf):
    """Mean over seeds with half-width."""
    return report.seed_interval(runs(spark, sf), ["ds", "method"], "seed", "v").select("ds", "method", r6("mean", "mean"), r6("half", "half"))


@query(_CI + " select ci.ds, method, mean >= t.mean_top - t.half_top as best from ci join (select ds, max(mean) as mean_top, arg_max(coalesce(half, 0), mean) as half_top from ci group by 1) t on t.ds = ci.ds")
def best_flag(spark, sf):
    """Methods within the best one's half-width."""
    return report.best_flags(report.seed_interval(runs(spark, sf), ["ds", "method"], "seed", "v"), ["ds"]).select("ds", "method", "best")


@query("select p_type as ds, " + ", ".join(f"coalesce(string_agg(s, '' order by s) filter (where p_brand = '{b}'), '') as \"{b}\"" for b in BRANDS[:3]) + " from (select p_type, p_brand, cast(count(*) as varchar) || '|' as s from part group by 1, 2, p_size % 2) group by 1")
def string_pivot(spark, sf):
    """Strings joined in a pivot."""
    s = table(spark, sf, "part").groupBy(F.col("p_type").alias("ds"), "p_brand", (F.col("p_size") % 2).alias("odd")).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit("|")).alias("s"))
    t = report.string_table(s, "ds", "p_brand", BRANDS[:3], "s")
    return t.select("ds", *(F.coalesce(F.col(f"`{b}`"), F.lit("")).alias(b) for b in BRANDS[:3]))


@query(GRID + " select sub, round(b, 6) as share, case when b > 0 and b < 1 then round(-b * ln(b) - (1 - b) * ln(1 - b), 6) end as entropy from (select sub, avg(label) as b from grid group by 1)")
def class_entropy(spark, sf):
    """Balance and entropy of classes."""
    b = grid(spark, sf).groupBy("sub").agg(F.avg("label").alias("b"))
    return b.select("sub", r6("b", "share"), r6(vx.entropy(F.col("b")), "entropy"))


@query(_RUNS + " select ds, seed, round(avg(case when method = 'Brand#1' then v end) / nullif(avg(case when method = 'Brand#2' then v end), 0), 6) as ratio from runs group by 1, 2")
def paired_ratio(spark, sf):
    """Two methods side by side and their ratio."""
    wide = runs(spark, sf).groupBy("ds", "seed").pivot("method", ["Brand#1", "Brand#2"]).agg(F.avg("v"))
    return wide.select("ds", "seed", r6(F.try_divide(F.col("`Brand#1`"), F.col("`Brand#2`")), "ratio"))


@query("select l_suppkey as seq, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1")
def linregress(spark, sf):
    """Least-squares lines by group."""
    x = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("seq"), "l_quantity", "l_extendedprice")
    return report.linear_fit(x, ["seq"], "l_quantity", "l_extendedprice").select("seq", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), r6("r2", "r2"))


_WELCH = _RUNS + """, m as (select ds, method, seed, avg(v) as v from runs group by 1, 2, 3), s as (select ds, method, cast(count(*) as double) as n, avg(v) as m, var_samp(v) as va from m group by 1, 2),
  w as (select s.ds, s.method, c.va / c.n as a, s.va / s.n as b, c.m - s.m as d, c.n as cn, s.n as n from s join s c on c.ds = s.ds and c.method = 'Brand#1' and s.method <> 'Brand#1'),
  t as (select ds, method, d / sqrt(a + b) as t, (a + b) * (a + b) / (a * a / (cn - 1) + b * b / (n - 1)) as dof from w)"""


def seed_means(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).groupBy("ds", "method", "seed").agg(F.avg("v").alias("v"))


@query(_WELCH + " select ds, method, round(t, 4) as t, round(dof, 4) as dof from t")
def welch_stats(spark, sf):
    """Welch's statistic of a central method against the others."""
    return report.welch(seed_means(spark, sf), ["ds"], "method", "v", "Brand#1").select("ds", "method", F.round("t", 4).alias("t"), F.round("dof", 4).alias("dof"))


@query()
def welch_p(spark, sf):
    """One-sided p, adjusted, with stars."""
    w = report.welch(seed_means(spark, sf), ["ds"], "method", "v", "Brand#1").withColumn("p", F.coalesce(report.t_upper_tail("t", "dof"), F.lit(1.0)))
    a = report.benjamini_hochberg(w.select("ds", "method", "p"), ["ds"], "p")
    return a.select("ds", "method", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"), report.stars(F.col("adjusted")).alias("stars"))


@query()
def wilcoxon(spark, sf):
    """Signed-rank test of paired seeds."""
    m = seed_means(spark, sf)
    j = m.join(m.where("method = 'Brand#1'").select("ds", "seed", F.col("v").alias("c")), ["ds", "seed"]).where("method <> 'Brand#1'")
    d = j.groupBy("ds", "method").agg(F.array_sort(F.collect_list(F.col("c") - F.col("v"))).alias("d"))
    return d.select("ds", "method", F.round(report.wilcoxon_p("d"), 6).alias("p"))


_P = "with p as (select s_nationkey as fam, s_suppkey as id, cast(('0x' || substr(md5('2:' || s_suppkey), 1, 8)) as bigint) / 4294967296.0::double / 50 as p from supplier)"
_BH = _P + ", k as (select *, row_number() over (partition by fam order by p, id) as r, p * count(*) over (partition by fam) / row_number() over (partition by fam order by p, id) as q from p), a as (select fam, id, p, least(1.0, min(q) over (partition by fam order by r rows between current row and unbounded following)) as adjusted from k)"


def p_values(spark: SparkSession, sf: str) -> DataFrame:
    p = F.conv(F.substring(shuffle_key(2, "s_suppkey"), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) / 50
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("fam"), F.col("s_suppkey").alias("id"), p.alias("p"))


@query(_BH + " select fam, id, round(adjusted, 8) as adjusted from a")
def bh_adjust(spark, sf):
    """Step-up false discovery rates."""
    return report.benjamini_hochberg(p_values(spark, sf), ["fam"], "p").select("fam", "id", F.round("adjusted", 8).alias("adjusted"))


@query(_BH + " select fam, id, repeat('*', (adjusted <= 0.0001)::int + (adjusted <= 0.001)::int + (adjusted <= 0.01)::int + (adjusted <= 0.05)::int) as stars from a")
def stars(spark, sf):
    """A star for each cutoff."""
    return report.benjamini_hochberg(p_values(spark, sf), ["fam"], "p").select("fam", "id", report.stars(F.col("adjusted")).alias("stars"))


# --- graphs and clusters ------------------------------------------------------------------------------------------

_EDGES = "with e as (select least(o_custkey % 97, o_orderkey % 89) as a, greatest(o_custkey % 97, o_orderkey % 89) as b, min(o_totalprice) as v from orders where o_custkey % 97 <> o_orderkey % 89 group by 1, 2), s as (select a, b, v from e union all select b, a, v from e)"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select((F.col("o_custkey") % 97).alias("x"), (F.col("o_orderkey") % 89).alias("y"), F.col("o_totalprice").alias("v"))
    return neighbors.symmetric_minimum(raw, "x", "y", "v")


@query(_EDGES + " select a, b, v from s")
def sym_edges_min(spark, sf):
    """Least weight of each unordered pair, in both directions."""
    return edges(spark, sf)


_CORE_ROUNDS = 12
_CORE = "with recursive_start as (select distinct 'p' || l_partkey as x, 's' || l_suppkey as y from lineitem where l_quantity <= 3), e0 as (select x as a, y as b from recursive_start union all select y, x from recursive_start)" + "".join(
    f", k{n} as (select a from e{n - 1} group by 1 having count(*) >= 3), e{n} as (select a, b from e{n - 1} where a in (select a from k{n}) and b in (select a from k{n}))" for n in range(1, _CORE_ROUNDS + 1)
)


@query(_CORE + f" select a, b from e{_CORE_ROUNDS}")
def kcore(spark, sf):
    """Nodes with fewer than three neighbours dropped until none is left; the SQL has twelve rounds, more than these tables need."""
    raw = table(spark, sf, "lineitem").where("l_quantity <= 3").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")).distinct()
    _shared(spark)  # rounds are written there
    return neighbors.k_core(raw.union(raw.select("b", "a")), 3)


_POINTS = "with f as (select vec_id as key, label as cluster, i as dim, case when (vec_id + i) % 11 <> 0 then cast(embedding[i] as double) end as x from embeddings, (select unnest(range(1, 65)) as i)), m as (select cluster, dim, avg(x) as m from f group by 1, 2)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    """(key, cluster, dim, x) with missing values."""
    f = long_embeddings(spark, sf).select(F.col("vec_id").alias("key"), F.col("label").alias("cluster"), (F.col("dim") + 1).alias("dim"), "x")
    return f.withColumn("x", F.when((F.col("key") + F.col("dim")) % 11 != 0, F.col("x")))


@query(_POINTS + " select key, round(sqrt(64.0::double / count(*) * sum((x - m) * (x - m))), 6) as loss from f join m using (cluster, dim) where x is not null group by 1")
def cluster_mse(spark, sf):
    """Scaled Euclidean distance to the centroid."""
    return cluster.centroid_loss(points(spark, sf), 64).select("key", r6("loss", "loss"))


@query(_POINTS + " select key, round(64.0::double / count(*) * sum(abs(x - m)), 6) as loss from f join m using (cluster, dim) where x is not null group by 1")
def cluster_mae(spark, sf):
    """Scaled Manhattan distance to the centroid."""
    return cluster.centroid_loss(points(spark, sf), 64, squared=False).select("key", r6("loss", "loss"))


@query("""with d as (select a.vec_id as key, list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda x: abs(x[1] - x[2]))) as d from embeddings a join embeddings b on a.label = b.label)
  select key, round(avg(d), 6) as loss from d group by 1""")
def cluster_avg(spark, sf):
    """Mean distance to all members, by sorted sums and without pairs."""
    f = long_embeddings(spark, sf).select(F.col("vec_id").alias("key"), F.col("label").alias("cluster"), "dim", "x")
    return cluster.intra_cluster(f, 64).select("key", r6("loss", "loss"))


@query("""with d as (select a.vec_id as q, a.label as ca, b.label as cb, avg(list_distance(a.embedding::double[], b.embedding::double[])) as d from embeddings a join embeddings b on a.vec_id <> b.vec_id group by 1, 2, 3),
  s as (select q, max(case when ca = cb then d end) as a, min(case when ca <> cb then d end) as b from d group by 1)
  select q as key, round(case when a is null then 0 else (b - a) / nullif(greatest(a, b), 0) end, 6) as silhouette from s""")
def silhouette(spark, sf):
    """Silhouettes of all items, distances summed by cluster within the tasks."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), F.col("label").alias("cluster"))
    return cluster.silhouette(neighbors.distance_sums(e), e.select("key", "cluster")).select("key", r6("silhouette", "silhouette"))


@query("""with c as (select p_brand as a, p_type as b, cast(count(*) as double) as n from part group by 1, 2), j as (select sum(n * (n - 1) / 2) as j, sum(n) as n from c), l as (select sum(n * (n - 1) / 2) as l from (select sum(n) as n from c group by a)), r as (select sum(n * (n - 1) / 2) as r from (select sum(n) as n from c group by b))
  select round((j - l * r / (n * (n - 1) / 2)) / nullif((l + r) / 2 - l * r / (n * (n - 1) / 2), 0), 6) as ari from j, l, r""")
def rand_index(spark, sf):
    """Adjusted Rand index of two labellings."""
    return cluster.adjusted_rand(table(spark, sf, "part"), "p_brand", "p_type").select(r6("ari", "ari"))


@query("""with c as (select p_brand as a, p_type as b, cast(count(*) as double) as n from part group by 1, 2), l as (select a, sum(n) as p from c group by 1), r as (select b, sum(n) as q from c group by 1), t as (select sum(n) as t from c),
  mi as (select sum(n / t * ln(t * n / (p * q))) as mi from c join l using (a) join r using (b), t), h as (select (select -sum(p / t * ln(p / t)) from l, t) as ha, (select -sum(q / t * ln(q / t)) from r, t) as hb),
  e as (select sum(k / t * ln(t * k / (p * q)) * exp(lgamma(p + 1) + lgamma(q + 1) + lgamma(t - p + 1) + lgamma(t - q + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(p - k + 1) - lgamma(q - k + 1) - lgamma(t - p - q + k + 1))) as e
    from (select p, q, t, cast(unnest(range(cast(greatest(1, p + q - t) as bigint), cast(least(p, q) as bigint) + 1)) as double) as k from l, r, t))
  select round((mi - e) / ((ha + hb) / 2 - e), 6) as ami from mi, h, e""")
def mutual_information(spark, sf):
    """Adjusted mutual information of two labellings."""
    return cluster.adjusted_mutual_information(table(spark, sf, "part"), "p_brand", "p_type").select(F.round("ami", 6).alias("ami"))


# --- joins, sets, files -------------------------------------------------------------------------------------------


@query("select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def keyed_lookup(spark, sf):
    """Lookup that fails on a missing key."""
    found = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return reshape.lookup(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), found, "o_custkey", "c_mktsegment").select("o_orderkey", "c_mktsegment")


@query("select p_partkey, length(p_name) as size from part")
def distinct_featurize(spark, sf):
    """Computed once for each distinct input."""
    return reshape.for_distinct(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "size", F.length("p_name").cast("long")).select("p_partkey", "size")


@query("select n_name as name, null as brand from nation union all select null, p_brand from part")
def fuse(spark, sf):
    """Union by name, missing columns null."""
    return reshape.union_all(table(spark, sf, "nation").select(F.col("n_name").alias("name")), table(spark, sf, "part").select(F.col("p_brand").alias("brand")))


@query("select o_custkey % 50 as k from orders intersect select s_suppkey % 60 from supplier")
def label_intersection(spark, sf):
    """Labels that two frames share."""
    return table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("k")).intersect(table(spark, sf, "supplier").select(F.col("s_suppkey") % 60))


@query("select p_type as ds, p_brand as method, case when p_size > 25 then 'large' when p_name like 'red%' then 'red' else p_type || '-' || p_brand end as model_name, case when p_retailprice > 1500 then 1 else 0 end as hit from part")
def model_names(spark, sf):
    """P10: names and flags by cases."""
    name = F.when(F.col("p_size") > 25, "large").when(F.col("p_name").startswith("red"), "red").otherwise(F.concat_ws("-", "p_type", "p_brand"))
    return table(spark, sf, "part").select(F.col("p_type").alias("ds"), F.col("p_brand").alias("method"), name.alias("model_name"), F.when(F.col("p_retailprice") > 1500, 1).otherwise(0).alias("hit"))


@query("select distinct p_name as name, upper(rpad(p_name, 12, '-')) as aligned, upper(replace(rpad(p_name, 12, '-'), '-', '')) as seq from part")
def fasta_roundtrip(spark, sf):
    """Aligned names written as FASTA and read again."""
    path = _shared(spark)
    files.write_fasta(aligned(spark, sf), path, "name", "aligned")
    return files.read_fasta(spark, path)


@query()
def ref_parse(spark, sf):
    """Structure references written and parsed; positions start at 0."""
    path = _shared(spark)
    text = F.concat(F.lit("header\n"), F.upper(F.regexp_replace("name", "[^a-z]", "")), F.lit("\n(1,'"), F.upper(F.substring("name", 1, 1)), F.lit("')"))
    names(spark, sf).repartition(8, "name").select(text.alias("value")).where("value is not null").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_references(spark, path)


@query("select n_name, cast(null as varchar) as r_name, cast(null as varchar) as r_regionkey from nation union all select null, r_name, cast(r_regionkey as varchar) from region")
def result_merge(spark, sf):
    """Result files of different columns merged by name."""
    path = _shared(spark)
    files.write_results(table(spark, sf, "nation").select("n_name"), f"{path}/a")
    files.write_results(table(spark, sf, "region").select("r_name", "r_regionkey"), f"{path}/b/c")
    return files.merge_results(spark, [path])


@query(_ROLES + " select g.sub as SUBSTRATES, cast(g.seq as varchar) as SEQ, 'label' as label, label as val, 0.5::double as pred, role as split, '0_0' as split_name from grid g join roles r on r.seq = g.seq and r.sub = g.sub where trial = 0 and fold = 0 and role = 'test'")
def prediction_files(spark, sf):
    """Prediction facts as JSON lines; test rows read back."""
    path = _shared(spark)
    f = _with_roles(spark, sf).select(F.col("sub").alias("SUBSTRATES"), F.col("seq").cast("string").alias("SEQ"), F.lit("label").alias("label"), F.col("label").alias("val"), F.lit(0.5).alias("pred"), F.col("role").alias("split"), F.lit("0_0").alias("split_name"))
    files.write_predictions(f, path)
    return files.read_predictions(spark, path)
