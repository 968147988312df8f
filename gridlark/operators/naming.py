"""Names and attributes of result rows, as column expressions.

Rows have model, dist, scaled, feature, chem, pool, pool_num, ref_file and path; a missing featurizer is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Featurizers whose pooling is part of the name.
POOLED = ("esm", "bepler", "msa")


def _network(model: str, other: str) -> Column:
    """A network's name tells what it knows of the other axis."""
    kind = F.when(F.col(other) == "random", "(prot,randchem)").when(F.col(other) == "cat", "(prot,catchem)").when(F.col(other).isNotNull(), "(prot,chem)").otherwise("")
    return F.concat(model, kind)


def protein_model_name() -> Column:
    """Featurizer, with its pooling if it has one, then the model: distance and scaling of neighbours, chemistry of networks."""
    knn = F.concat("dist", F.lit(" knn"), F.when(F.col("scaled"), " (Scaled)").otherwise(""))
    model = F.when(F.col("model") == "knn", knn).when(F.col("model").contains("ffn"), _network("model", "chem")).otherwise(F.col("model"))
    pooled = F.when(F.col("feature").isin(*POOLED) & F.col("pool").isNotNull(), F.concat_ws("-", "feature", "pool")).otherwise(F.coalesce("feature", F.lit("")))
    return F.trim(F.concat_ws(" ", pooled, model))


def substrate_model_name() -> Column:
    """Chemical featurizer, then the model; neighbours with their distance."""
    model = F.when(F.col("model") == "knn", F.concat_ws("-", "model", "dist")).when(F.col("model").contains("ffn"), _network("model", "feature")).otherwise(F.col("model"))
    return F.concat_ws(" ", F.coalesce("chem", F.lit("none")), model)


def radius() -> Column:
    """Radius in the name of the reference file; null without a file or for mean pooling."""
    given = F.col("ref_file").isNotNull() & (F.coalesce("pool", F.lit("")) != "mean")
    return F.when(given, F.regexp_extract("ref_file", r"reference_([0-9]*)\.txt$", 1).try_cast("long"))


def stem(path: str) -> Column:
    """File name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)
