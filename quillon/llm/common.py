"""Shared helpers of the corpus operators: scratch tables, words, label folds."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

ROWS_IN_PART = 50_000

#: Scratch tables by who made them.
_scratch: dict[str, list[str]] = {}
_owner: ContextVar[str] = ContextVar("owner", default="query")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); where none is set, a temporary one if all runs on this machine, else an error."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        place = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(place)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; release() of its owner deletes it."""
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(_owner.get(), []).append(path)
    return path


def parts(rows: int, least: int = 2) -> int:
    """In how many files a table of `rows` short rows is written."""
    return max(least, -(-rows // ROWS_IN_PART))


def materialise(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it: what follows never computes it again, whatever executor is lost.

    In `most` files at most, where the number of rows is known: a small table in as many files as there are shuffle partitions
    costs more in files than in rows.
    """
    spark = df.sparkSession
    df = df.coalesce(most) if most else df
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Scratch tables made within belong to `owner`."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def release(spark: SparkSession, owner: str = "query") -> None:
    """Delete an owner's scratch tables. Call it only when no result that was built on them is still to be computed; results of
    queries read theirs until then, so they stay as long as the application unless this is called."""
    for path in _scratch.pop(owner, []):
        delete(spark, path)


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage: plans of finished jobs, which else pile up until its heap is full, however small they are."""
    gc.collect()  # what Python let go of is garbage to the JVM only after that
    spark._jvm.System.gc()


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs whose results are written: its cleaner waits for the JVM's collector."""
    for _ in range(2):
        tidy(spark)
        time.sleep(0.3)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; null text: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learnt from: crc32(doc_id as text) mod 4 is 2. A null doc_id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
