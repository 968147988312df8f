"""Registered queries of alignments: by dynamic programming on proposed pairs, through references, pooled contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import align
from gridlark.plans.catalogue import _RES, names, query, r6, residue_matrix
from gridlark.sources.tables import table


@query("""with n as (select distinct p_name as s from part), k as (select distinct s, substr(s, i, 3) as x from (select s, unnest(range(1, greatest(length(s) - 2, 1) + 1)) as i from n)), c as (select s, count(*) as n from k group by 1)
  select x.s as a, y.s as b from k x join k y on x.x = y.x and x.s < y.s join c p on p.s = x.s join c q on q.s = y.s group by 1, 2 having 100 * count(*) >= 40 * max(greatest(p.n, q.n))""")
def kmer_proposals(spark, sf):
    """Pairs of names that share enough k-mers to be aligned; none is lost."""
    return align.kmer_pairs(names(spark, sf), "name", "name")


def _aligned(spark: SparkSession, sf: str, local: bool) -> DataFrame:
    n = names(spark, sf)
    found = align.align_pairs(align.kmer_pairs(n, "name", "name"), n, "name", "name", local=local)
    return found.select("a", "b", "score", "aligned_a", "aligned_b", F.round(align.identity(), 6).alias("identity"))


@query()
def global_alignment(spark, sf):
    """Global alignments with affine gaps of names that share k-mers."""
    return _aligned(spark, sf, False)


@query()
def local_alignment(spark, sf):
    """Local alignments with affine gaps of names that share k-mers."""
    return _aligned(spark, sf, True)


_BETA = """, rf as (select pos as ref, dim, x as rx from r where vec_id = 0 and pos in (0, 2, 5)), d as (select vec_id, pos, ref, exp(-sum(abs(x - rx))) as e from r join rf using (dim) group by 1, 2, 3),
  be as (select vec_id, pos, ref, e / sum(e) over (partition by vec_id, ref) as beta from d)"""
_CROSS = _RES + _BETA + """, p as (select a.vec_id as a, b.vec_id as b, a.pos as i, b.pos as j, sum(abs(a.x - b.x)) as d from r a join r b on a.dim = b.dim and b.vec_id = a.vec_id + 1 group by 1, 2, 3, 4),
  w as (select p.a, p.b, i, j, any_value(d) as d, sum(x.beta * y.beta) as w from p join be x on x.vec_id = p.a and x.pos = i join be y on y.vec_id = p.b and y.pos = j and y.ref = x.ref group by 1, 2, 3, 4)"""


def _residues(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Residues (key, pos, vector), those of the reference, and pairs of each item with the next."""
    r = residue_matrix(spark, sf).select(F.col("vec_id").alias("key"), F.posexplode("residues").alias("pos", "vector"))
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("a"))
    return r, r.where("key = 0 and pos in (0, 2, 5)").select(F.col("pos").alias("ref"), "vector"), ids.withColumn("b", F.col("a") + 1)


@query(_CROSS + " select a, b, round(sum(w * d) / sum(w), 6) as dist from w group by 1, 2")
def reference_alignment(spark, sf):
    """Distances through the residues of a reference."""
    return align.reference_alignment(*_residues(spark, sf)).select("a", "b", r6("dist", "dist"))


@query(_CROSS + """, g as (select *, exp(-d) / sum(exp(-d)) over (partition by a, b, i) as al, exp(-d) / sum(exp(-d)) over (partition by a, b, j) as be from w)
  select a, b, round(sum(w * (al + be - al * be) * d) / sum(w * (al + be - al * be)), 6) as dist from g group by 1, 2""")
def gated_reference_alignment(spark, sf):
    """The same, where soft symmetric alignment has to agree."""
    return align.reference_alignment(*_residues(spark, sf), gate=True).select("a", "b", r6("dist", "dist"))


@query((_CROSS + " select a, b, round(sum(w * d) / sum(w), 6) as dist from w group by 1, 2").replace(" and pos in (0, 2, 5)", ""))
def full_reference_alignment(spark, sf):
    """Distances through all residues of a reference."""
    r, _, pairs = _residues(spark, sf)
    return align.reference_alignment(r, r.where("key = 0").select(F.col("pos").alias("ref"), "vector"), pairs).select("a", "b", r6("dist", "dist"))


@query((_CROSS + " select a, b, round(sum(w * d) / sum(w), 6) as dist from w group by 1, 2").replace("pos in (0, 2, 5)", "pos in (select pos from (select distinct pos from r) order by md5('4:' || pos), pos limit 3)"))
def random_reference_alignment(spark, sf):
    """Distances through residues of a reference drawn at random."""
    from gridlark.functions.rand import shuffle_key

    r, _, pairs = _residues(spark, sf)
    drawn = r.where("key = 0").orderBy(shuffle_key(4, "pos"), "pos").limit(3)
    return align.reference_alignment(r, drawn.select(F.col("pos").alias("ref"), "vector"), pairs).select("a", "b", r6("dist", "dist"))


@query(_RES + _BETA + """, m as (select a.vec_id, a.pos as i, b.pos as j, sum(a.x * b.x) as m from r a join r b using (vec_id, dim) group by 1, 2, 3)
  select m.vec_id as key, cast(x.ref as integer) as ref, cast(y.ref as integer) as other, round(sum(x.beta * m * y.beta), 6) as x from m join be x on x.vec_id = m.vec_id and x.pos = i join be y on y.vec_id = m.vec_id and y.pos = j group by 1, 2, 3""")
def contact_pool(spark, sf):
    """Each item's residue-by-residue map, brought to the residues of a reference by attention."""
    r, ref, _ = _residues(spark, sf)
    a, b = r.toDF("key", "i", "x"), r.toDF("key", "j", "y")
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    contacts = a.join(b, "key").select("key", "i", "j", dot.alias("m"))
    return align.contact_pool(r, ref, contacts).select("key", "ref", "other", r6("x", "x"))
