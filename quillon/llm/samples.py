"""Bounded, deterministic samples of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_by_label(docs: DataFrame, labels: DataFrame, label: str, per_label: int, most: int = 20_000) -> list[tuple]:
    """[(label, text)]: of each label at most per_label documents (those with the smallest hash of doc_id), `most` in all.

    labels(doc_id, label) may be the documents themselves. The ranking moves ids alone (Spark prunes it to per_label rows
    of a label in each task before the shuffle); texts are read for the chosen ids only, in the order of their hashes.
    """
    order: list[Column] = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("_label"))
    ids = ids.withColumn("_rank", F.row_number().over(Window.partitionBy("_label").orderBy(*order))).where(F.col("_rank") <= per_label)
    ids = ids.orderBy("_rank", "_label").limit(most).drop("_rank")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id").collect()
    return [(r["_label"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"], str(r["_label"])))]
