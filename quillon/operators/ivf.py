"""Approximate neighbours by inverted lists: a table laid out by list, of which a search reads the probed lists alone.

Centres are fitted on a bounded sample (max(10,000, 50 for each list) rows, see kmeans); every row goes to its nearest centre's list,
and a list of many rows is dealt to parts of PART_ROWS or so. With a partition column the layout is by that column, then by list, so
a search for one of its values reads nothing else; an index may also hold only the rows of a condition. NULL vectors and, for
cosine, zero vectors are left out. Half vectors are rounded floats; bits stay packed in words, as they are compared and averaged.

A batch of queries is a table of (query, list, part, place of the list in the query's order), joined with the rows of those lists in
cells of one list's part. A filtered search may probe on: each round only the queries that are still short of k rows, or for which the
last round found a nearer one, go to their next lists, twice as many as before, until none is left or max_probes is reached; so there
are few rounds whatever the filter, and recall does not fall as lists grow.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import bits_from_text, hamming_distance
from quillon.operators import kmeans
from quillon.operators.ann import LIMITS, check, indexable, prepared
from quillon.operators.knn import in_cells, nearest
from quillon.sources.tables import scratch_path

METRICS = {"vector": ("l2", "ip", "cosine"), "half": ("l2", "ip", "cosine"), "bit": ("hamming",)}
PART_ROWS = 100_000


@dataclass(frozen=True)
class IvfConfig:
    lists: int = 100
    probes: int = 1
    max_probes: int | None = None
    metric: str = "l2"
    seed: int = 0
    kind: str = "vector"

    def __post_init__(self):
        if not 1 <= self.lists <= 32768 or not 1 <= self.probes <= 32768:
            raise ValueError("lists and probes must be 1 to 32768")
        check(self.kind, self.metric, METRICS)

    @property
    def space(self) -> kmeans.Space:
        return kmeans.Bits() if self.kind == "bit" else kmeans.Dense(self.metric in ("ip", "cosine"))


def _stored(df: DataFrame, vec: str, config: IvfConfig) -> DataFrame:
    """The rows as the index holds them."""
    if config.kind != "bit":
        return indexable(prepared(df, vec, config.kind), vec, config.metric)
    size = F.col(vec)["len"]
    over = F.raise_error(F.lit(f"bit index takes {LIMITS['bit']} dimensions at most")).cast(df.schema[vec].dataType)
    return df.where(F.col(vec).isNotNull()).withColumn(vec, F.when(size > LIMITS["bit"], over).otherwise(F.col(vec)))


class IvfIndex:
    """Lists as partition folders of a Parquet table at `path`."""

    def __init__(self, spark: SparkSession, path: str, config: IvfConfig, centres: np.ndarray, parts: np.ndarray, vec: str, key: str, partition: str | None = None):
        self.spark, self.path, self.config, self.centres, self.parts, self.vec, self.key, self.partition = spark, path, config, centres, parts, vec, key, partition

    @classmethod
    def build(cls, df: DataFrame, path: str, config: IvfConfig = IvfConfig(), vec: str = "embedding", key: str = "vec_id", partition: str | None = None, where: Column | None = None, part_rows: int = PART_ROWS) -> IvfIndex:
        """An index of df, or of its rows that meet a condition; with `partition`, laid out by that column first."""
        spark = df.sparkSession
        rows = _stored(df if where is None else df.where(where), vec, config)
        most, sample = max(10_000, 50 * config.lists), f"{path}-sample"
        # rows are taken as they came and prepared then: only a condition on their length needs all of them prepared
        few = (rows if config.metric == "cosine" else (df if where is None else df.where(where)).where(F.col(vec).isNotNull())).orderBy(F.xxhash64(key, F.lit(config.seed))).limit(most)
        (few if config.metric == "cosine" else _stored(few, vec, config)).select(vec).write.mode("overwrite").parquet(sample)
        sampled = spark.read.schema(rows.select(vec).schema).parquet(sample)
        centres = kmeans.fit(sampled, vec, config.lists, config.space, config.seed)
        self = cls(spark, path, config, centres, np.ones(len(centres), np.int64), vec, key, partition)
        share = self._assign(sampled.withColumn(key, F.lit(0).cast("long"))).groupBy("list_id").count().collect()  # a number for each list
        total, seen = df.count(), sum(r["count"] for r in share)
        for r in share:
            self.parts[r["list_id"]] = -(-r["count"] * total // (seen * part_rows))
        self._write(self._assign(rows), path)
        return self

    def _write(self, rows: DataFrame, path: str, mode: str = "overwrite") -> None:
        rows.repartition("list_id", "part").write.mode(mode).partitionBy(*filter(None, [self.partition]), "list_id").parquet(path)

    def _assign(self, rows: DataFrame) -> DataFrame:
        """rows with list_id and part, the list's part that a row's key falls to."""
        centres, parts, vec, space, at = self.centres, self.parts, self.vec, self.config.space, rows.columns.index(self.vec)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = kmeans.nearest(space.matrix(b.column(at)), centres, space)[0] if len(b) else np.empty(0, np.int64)
                part = b.column(len(b.columns) - 1).to_numpy(zero_copy_only=False) % parts[ids]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.int32()), pa.array(part, pa.int32())], [*b.schema.names[:-1], "list_id", "part"])

        hashed = rows.withColumn("_hash", F.pmod(F.xxhash64(self.key), F.lit(1 << 31)))
        return hashed.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, list_id int, part int")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def insert(self, df: DataFrame) -> None:
        self._write(self._assign(_stored(df, self.vec, self.config)), self.path, "append")

    def delete(self, keys: DataFrame, path: str) -> None:
        """Write the index without these keys to a new path and use that."""
        self._write(self.rows().join(keys.select(self.key), self.key, "left_anti"), path)
        self.path = path

    def lists_near(self, q: Sequence[float] | str) -> list[int]:
        """All lists, nearest first; a bit vector is a text of 0 and 1."""
        if self.config.kind == "bit":
            bits = np.array([c == "1" for c in q] + [False] * (-len(q) % 64))
            x = np.packbits(bits).view(">u8").astype(np.uint64)[None]
        else:
            x = self.config.space.matrix(pa.array([q], pa.list_(pa.float64())))
        return np.argsort(self.config.space.distances(x, self.centres)[0], kind="stable").tolist()

    def search(self, q: Sequence[float] | str | None, k: int, probes: int | None = None, where: Column | None = None, iterative: bool = False) -> DataFrame:
        """The k nearest in the probed lists; iterative: more lists, up to max_probes, until k rows pass the filter and twice as many
        lists have none nearer."""
        rows = self.rows()
        if q is None:
            return (rows if where is None else rows.where(where)).withColumn("distance", F.lit(None).cast("double")).limit(k)
        order, n = self.lists_near(q), probes or self.config.probes
        most, before = min(self.config.max_probes or len(order), len(order)), None
        while True:
            probed = rows.where(F.col("list_id").isin(order[:n]))
            if self.config.kind == "bit":
                some = (probed if where is None else probed.where(where)).withColumn("distance", hamming_distance(self.vec, bits_from_text(F.lit(q))))
                out = some.orderBy(F.col("distance").asc_nulls_last(), self.key).limit(k)
            else:
                out = nearest(probed, q, k, self.config.metric, self.vec, self.key, where)
            if not iterative or n >= most:
                return out
            near = [r.distance for r in out.select("distance").collect()]  # k numbers
            if len(near) >= k and near == before:
                return out
            n, before = min(most, 2 * n), near

    def frontier(self, queries: DataFrame, most: int, *more: str) -> DataFrame:
        """query_id, q, more, list_id, part, place: the `most` nearest lists of each query, with all their parts."""
        centres, parts, space = self.centres, self.parts, self.config.space

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, len(whole), step := space.step(centres)):
                    b = whole.slice(lo, step)
                    order = np.argsort(space.distances(space.matrix(b.column(1)), centres), axis=1, kind="stable")[:, :most]
                    lists, place, row = order.ravel(), np.tile(np.arange(order.shape[1]), len(b)), np.repeat(np.arange(len(b)), order.shape[1])
                    times = parts[lists]
                    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    taken = pa.array(np.repeat(row, times))
                    made = [*(c.take(taken) for c in b.columns), *(pa.array(np.repeat(x, times), pa.int32()) for x in (lists, place)), pa.array(part, pa.int32())]
                    yield pa.RecordBatch.from_arrays(made, [*b.schema.names, "list_id", "place", "part"])

        asked = _stored(queries, self.vec, self.config).select(F.col(self.key).alias("query_id"), F.col(self.vec).alias("q"), *more)
        return asked.mapInArrow(probe, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in asked.schema)}, list_id int, place int, part int")

    def _found(self, frontier: DataFrame, k: int, where: Column | None, by: str | None) -> DataFrame:
        """The k best of each query in each cell. Only folders that the frontier names are read: there are no more of them than the
        index has, so their names are broadcast."""
        extra = [by] if by else []
        rows = self.rows() if where is None else self.rows().where(where)
        wanted = F.broadcast(frontier.select(*extra, "list_id").distinct())
        near = rows.join(wanted, [*extra, "list_id"], "left_semi").select(*extra, "list_id", "part", self.key, self.vec)
        return in_cells(near, frontier, [*extra, "list_id", "part"], k, self.config.metric, self.vec, self.key)

    def search_batch(self, queries: DataFrame, k: int, probes: int | None = None, where: Column | None = None, iterative: bool = False, by: str | None = None, relaxed: bool = False) -> DataFrame:
        """query_id, key, distance, rank: each query against its own probed lists.

        where: a filter on the index's rows; iterative: queries short of k rows, or whose last round found a nearer one, probe on,
        up to max_probes lists; relaxed: queries short of k rows probe on, and what an
        earlier round has found stands before what a later one finds, as a scan that goes on returns it (knn.strict_order() ranks by
        distance again); by: the partition
        column, which queries have too: each searches the rows of its own value.
        """
        if by and by != self.partition:
            raise ValueError("by must be the index's partition column")
        n = min(probes or self.config.probes, len(self.centres))
        first = [F.col("_round")] if relaxed and iterative else []
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*first, F.isnan("distance"), "distance", self.key))
        top = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k)
        more = [by] if by else []
        if not iterative:
            return top(self._found(self.frontier(queries, n, *more).where(F.col("place") < n), k, where, by))
        most = min(self.config.max_probes or len(self.centres), len(self.centres))
        path = scratch_path(self.spark, "frontier")
        self.frontier(queries, most, *more).write.parquet(path)
        frontier, best, done, number = self.spark.read.parquet(path), None, 0, 0
        active = frontier
        while True:
            found = self._found(active.where((F.col("place") >= done) & (F.col("place") < n)), k, where, by).withColumn("_round", F.lit(number))
            out = scratch_path(self.spark, f"best{number}")
            top(found if best is None else best.drop("rank").unionByName(found)).write.parquet(out)
            best, done, number = self.spark.read.parquet(out), n, number + 1
            if n >= most:
                return best.drop("_round")
            enough = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("_round").alias("last"))
            enough = enough.where((F.col("n") >= k) & (F.lit(relaxed) | (F.col("last") < number - 1))).select("query_id")
            active = frontier.join(enough, "query_id", "left_anti")
            if active.isEmpty():
                return best.drop("_round")
            n = min(most, 2 * n)
