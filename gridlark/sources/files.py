"""Readers and writers of files: aligned sequences, structure references, grids, result tables, predictions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prediction facts.
PREDICTIONS = "SUBSTRATES string, SEQ string, label string, val double, pred double, split string, split_name string"


def read_grid(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """Long grid (seq, sub, label...) of a CSV whose first column is an index; NaN and blank labels are null."""
    schema = "idx int, SEQ string, SUBSTRATES string, " + ", ".join(f"`{x}` double" for x in labels)
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(F.col("SEQ").alias("seq"), F.col("SUBSTRATES").alias("sub"), *(F.nanvl(F.col(f"`{x}`"), F.lit(None).cast("double")).alias(x) for x in labels))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, aligned, seq): entries of FASTA files, lines joined; seq has no gaps."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    return raw.select(F.trim(F.get(lines, F.lit(0))).alias("name"), F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), F.trim), "").alias("aligned")).withColumn("seq", F.replace("aligned", F.lit("-"), F.lit("")))


def write_fasta(rows: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    """One entry a row, sequences trimmed and in upper case."""
    rows.select(F.concat(F.lit(">"), F.trim(name), F.lit("\n"), F.upper(F.trim(seq)))).write.text(path)


#: A place and the letter there, as (12, 'A').
_PLACE = r"\(([0-9]+),\s*'(.)'\)"


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(ref_seq, positions): sequence in the second line, then (place, 'letter') pairs counted from 1; fails if a letter
    is not that of the sequence."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.trim(F.get(F.split("value", r"\r?\n"), F.lit(1))).alias("ref_seq"), *(F.regexp_extract_all("value", F.lit(_PLACE), F.lit(k)).alias(c) for k, c in ((1, "place"), (2, "letter"))))
    right = F.forall(F.arrays_zip("place", "letter"), lambda p: F.substring(F.col("ref_seq"), p.place.cast("int"), F.lit(1)) == p.letter)
    return parsed.select("ref_seq", F.when(right, F.transform("place", lambda p: p.cast("int") - 1)).otherwise(F.raise_error(F.lit("a residue is not that of the sequence"))).alias("positions"))


def merge_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All CSV files of the folders, by column name, columns in alphabetical order; missing ones are null.

    Files are grouped by header, of which there are few, so that there is one scan for each header and not for each
    file; values stay strings, as the files may disagree on types."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(paths)
    rows = lines.select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    heads = rows.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("head")).groupBy("head").agg(F.collect_list("file").alias("files"))
    out = None
    for head, found in sorted(map(tuple, heads.collect())):
        df = spark.read.option("header", True).csv(found)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select(sorted(out.columns)) if out is not None else spark.createDataFrame([], "empty string")


def write_results(results: DataFrame, path: str) -> None:
    """CSV files with a header, columns in alphabetical order; a file for each partition."""
    results.select(sorted(results.columns)).write.option("header", True).csv(path)


def write_predictions(facts: DataFrame, path: str) -> None:
    facts.write.json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Test rows of a predictions file."""
    return spark.read.schema(PREDICTIONS).json(path).where("split = 'test'")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, id, evalue) of tab-separated alignment tables: the first three columns, and the last but one."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 4)
    return raw.select(*(F.get("c", F.lit(k)).alias(n) for k, n in enumerate(("a", "b", "id"))), F.get("c", F.size("c") - 2).cast("double").alias("evalue"))


def write_edges(rows: DataFrame, path: str) -> None:
    """Tab-separated alignments (a, b, id, evalue), with a score of 0 at the end."""
    columns = [F.col(c).cast("string") for c in rows.columns]
    rows.select(F.concat_ws("\t", *columns, F.lit("0"))).write.text(path)


def write_groups(rows: DataFrame, path: str) -> None:
    """Rows with `group` as a table with a folder for each group, so that reading some prunes the others."""
    rows.write.partitionBy("group").parquet(path)


def read_groups(spark: SparkSession, path: str, groups: list[str]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("group").isin(groups))


def cached(spark: SparkSession, root: str, properties: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table stored under a digest of its properties; built and written the first time.

    A table counts as stored when its writing was committed, so a run that broke off is made again."""
    path = f"{root}/{hashlib.md5(json.dumps(properties, sort_keys=True).encode()).hexdigest()}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json(spark: SparkSession, values: dict, path: str) -> None:
    """Arguments or parameters as one JSON object."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def flags(values: dict) -> str:
    """A command line: true gives a flag, false and None give nothing, any other value follows its name."""
    return " ".join(f"--{k}" if v is True else f"--{k} {v}" for k, v in sorted(values.items()) if v is not None and v is not False)


def expand_config(text: str) -> list[dict]:
    """Runs of an experiment file: for each iterative block all combinations of its lists over the universal ones."""
    from itertools import product

    config = json.loads(text)
    runs = []
    for block in config.get("iterative_args") or [{}]:
        merged = config.get("universal_args", {}) | block
        runs += [dict(zip(merged, values, strict=True)) for values in product(*merged.values())]
    return runs


def export_rows(rows: DataFrame, path: str) -> None:
    """All columns whose name lacks `features`."""
    rows.select([c for c in rows.columns if "features" not in c]).write.option("header", True).csv(path)
