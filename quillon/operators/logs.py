"""Event logs: rate rules, flags, retention and listings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, DAYS = 30, 90


def over_rate(events: DataFrame, subject: str, now: datetime | Column, most: int = RATE, ts: str = "ts") -> DataFrame:
    """subject, n: who has more than `most` events in the hour before now."""
    end = now if isinstance(now, Column) else F.lit(now)
    recent = events.where((F.col(ts) > end - F.expr("interval 1 hour")) & (F.col(ts) <= end))
    return recent.groupBy(subject).agg(F.count("*").alias("n")).where(F.col("n") > most)


def hourly_over_rate(events: DataFrame, subject: str, most: int = RATE, ts: str = "ts") -> DataFrame:
    """subject, hour, n for every hour of the log."""
    return events.groupBy(subject, F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n")).where(F.col("n") > most)


def flag(events: DataFrame, flagged: DataFrame, subject: str, reason: str) -> DataFrame:
    """events with is_flagged and flag_reason for the subjects in flagged."""
    marks = flagged.select(subject).distinct().withColumn("_hit", F.lit(True))
    out = events.join(marks, subject, "left")
    return out.withColumn("is_flagged", F.coalesce("_hit", F.lit(False))).withColumn("flag_reason", F.when(F.col("_hit"), reason)).drop("_hit")


def retain(events: DataFrame, now: datetime | Column, days: int = DAYS, ts: str = "ts", flagged: str | None = None) -> DataFrame:
    """What is left after events older than `days` are deleted; flagged ones stay if their column is named."""
    end = now if isinstance(now, Column) else F.lit(now)
    young = F.col(ts) >= end - F.make_dt_interval(F.lit(days))
    return events.where(young | F.col(flagged) if flagged else young)


def listing(events: DataFrame, newest: str, page: int = 1, size: int = 20, where: Column | None = None, key: str | None = None) -> DataFrame:
    """One page, newest first."""
    out = events if where is None else events.where(where)
    return out.orderBy(F.col(newest).desc(), *([key] if key else [])).offset((page - 1) * size).limit(size)
