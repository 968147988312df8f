"""Corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents;
the last returns packed pieces. Between stages the rows are written as Parquet to the shared folder and read again, so
a lost executor costs one stage at most."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import scratch, table, without
from gridlark.llm.decontaminate import drop_contaminated
from gridlark.llm.line_dedup import drop_repeated_lines
from gridlark.llm.near_dedup import near_duplicates
from gridlark.llm.packing import pack
from gridlark.llm.toxicity import drop_toxic, graded_labels


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the ordinal model rejects.

    Null and empty texts stay; repeated rows are judged alike, null ids by their text. Empty in, empty out."""
    return drop_toxic(docs, graded_labels(table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; all rows stay, n_chars follows the text.

    Of similar lines the first of the smallest id stays. Null ids and blank lines are left as they are; a null text has
    null n_chars."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8) keeps the smallest id.

    Null, empty and blank texts and null ids are in no group and stay; rows that repeat an id stay or go together."""
    dropped = near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    return without(docs, "doc_id", scratch(dropped))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or a re-parameterised one.

    Null ids and null, empty or short texts stay; without items all rows stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences of 512 to 4096 tokens.

    A null or empty text is one end token; longer texts than a sequence are cut into pieces, none is left out."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the fitted and packing stages, so run() has none. Tests hold the operators against brute force and
#: the stages against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
