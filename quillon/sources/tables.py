"""Tables in and out: scans with explicit columns, vectors as Parquet, manifests, texts and seed rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_vectors(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Dense, half, sparse and bit vectors round-trip as Parquet arrays and structs, NULLs included."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of acts, each with {value, verified} fields -> act_code, field, value, verified."""
    raw = spark.read.text(path, wholetext=True)
    acts = raw.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("act_code", "fields"))
    rows = acts.select("act_code", F.explode("fields").alias("field", "json"))
    cell = F.from_json("json", "value string, verified boolean")
    return rows.select("act_code", "field", F.coalesce(cell["value"], "json").alias("value"), F.coalesce(cell["verified"], F.lit(False)).alias("verified"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each file whole: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def seed(existing: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """existing and those rows whose key it lacks: nothing is overwritten."""
    return existing.unionByName(rows.join(existing.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def first_non_empty(*frames: DataFrame) -> DataFrame:
    """The first source that has a row, else the last."""
    for df in frames[:-1]:
        if not df.isEmpty():
            return df
    return frames[-1]


_scratch: list[str] = []


def release_scratch(spark: SparkSession) -> None:
    """Delete what was written to scratch paths so far. Call it only when no result that reads them is still to be computed."""
    while _scratch:
        p = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path, until release_scratch() is called, in the folder that the cluster shares; where none is set, in a temporary folder if all runs on this machine, else an error."""
    import tempfile
    import uuid

    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        place = tempfile.mkdtemp(prefix="quillon-")
    _scratch.append(f"{place.rstrip('/')}/quillon-{name}-{uuid.uuid4().hex}")
    return _scratch[-1]
