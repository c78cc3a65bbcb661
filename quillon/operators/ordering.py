"""The place of every row in a total order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.tables import scratch_path


def place(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with `place`: 1, 2, ... in the order of the columns.

    Rows are dealt by range and numbered within their range; a range's first place is the number of rows before it. The ranges
    are written before they are counted, so that both see the same ones. Equal rows may share a range, so give a key.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranges")
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("place", own).join(F.broadcast(starts), "_range").withColumn("place", F.col("_start") + F.col("place")).drop("_range", "_start")
