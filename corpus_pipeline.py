"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the
next one. All but the last return the columns of documents. A stage begins by deleting the scratch tables of stages before
it: their results are written by then.

Defined cases, of every stage: an empty table gives an empty one; other columns of docs, whatever their names, stay with their row;
texts are taken whole, however long.

- quality rules: a null or empty text has fewer than 20 words and goes; repeated rows are judged alike; a null doc_id is never trusted.
- MinHash near-dedup: null text counts as empty; of equal or near texts the row of least doc_id stays (null last), of rows with the same
  doc_id the one whose JSON has the least hash.
- substring dedup: a null text stays null; rows of one doc_id are one document; a null doc_id comes after all others; a text that is
  repeated whole becomes an empty one.
- benchmark decontamination: a null or empty text holds no item and stays; null or empty items match nothing.
- packing: null text counts as empty, of which only the closing token is packed; repeated rows are packed each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontamination, near_dup, packing, quality, substring_dedup
from quillon.llm.common import collect_garbage, delete, owned, release, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


OWNER = "pipeline"


def stage(f: Stage) -> Stage:
    """The stage, with the scratch tables of the one before it deleted first; those of other queries stay."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, OWNER)
        with owned(OWNER):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality.keep(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of least doc_id."""
    return near_dup.keep_one(docs)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words that start earlier in the corpus; a text that is repeated whole stays as an empty one."""
    return substring_dedup.without_repeats(docs)


@stage
def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_items),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what the last one returns is still to be computed."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
        collect_garbage(spark)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has neither the signatures nor the tokenizer.
ORACLE_SQL = None
