"""Approximate neighbours by sharded layered graphs, and what they share with inverted lists (ivf).

Every shard of the table gets a graph of its own (a shard fits a Python worker, whatever the table's size), a search asks all
shards and merges exactly. NULL vectors and, for cosine, zero vectors are left out.

Half, bit and sparse vectors are indexed by their elements (prepared()): half ones rounded, bits as 0 and 1, sparse ones filled up.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import sparse
from quillon.functions.vectors import norm, to_half
from quillon.operators.knn import distances


#: How many dimensions an index takes (of sparse vectors: stored entries), and its metrics.
LIMITS = {"vector": 2000, "half": 4000, "bit": 64_000, "sparse": 1000}
HNSW_METRICS = {"vector": ("l2", "ip", "cosine", "l1"), "half": ("l2", "ip", "cosine", "l1"), "bit": ("hamming", "jaccard"), "sparse": ("l2", "ip", "cosine", "l1")}


def check(kind: str, metric: str, known: dict[str, tuple[str, ...]]) -> None:
    if metric not in known.get(kind, ()):
        raise ValueError(f"no such index: {kind} by {metric}")


@dataclass(frozen=True)
class HnswConfig:
    m: int = 16
    ef_construction: int = 64
    ef_search: int = 40
    max_scan: int = 20_000
    metric: str = "l2"
    seed: int = 0
    kind: str = "vector"

    def __post_init__(self):
        if not 2 <= self.m <= 100 or not 4 <= self.ef_construction <= 1000 or not 1 <= self.ef_search <= 1000:
            raise ValueError("m must be 2 to 100, ef_construction 4 to 1000, ef_search 1 to 1000")
        if self.ef_construction < 2 * self.m:
            raise ValueError("ef_construction must be 2 * m at least")
        check(self.kind, self.metric, HNSW_METRICS)


def prepared(df: DataFrame, vec: str, kind: str) -> DataFrame:
    """df with its vectors as arrays of numbers; those beyond the index's limit are an error."""
    v = F.col(vec)
    size = {"vector": F.size(v), "half": F.size(v), "bit": v["len"] if kind == "bit" else None, "sparse": F.size(v["values"]) if kind == "sparse" else None}[kind]
    if kind == "half":
        made = to_half(vec)
    elif kind == "bit":
        made = F.transform(F.sequence(F.lit(0), v["len"] - 1), lambda i: F.call_function("shiftrightunsigned", F.get(v["words"], F.floor(i / 64).cast("int")), 63 - i % 64).bitwiseAND(F.lit(1).cast("long")).cast("float"))
    elif kind == "sparse":
        made = sparse.to_dense(vec)
    else:
        made = v
    unit = "non-zero elements" if kind == "sparse" else "dimensions"
    over = F.raise_error(F.lit(f"{kind} index takes {LIMITS[kind]} {unit} at most")).cast("array<float>")
    return df.withColumn(vec, F.when(size > LIMITS[kind], over).otherwise(made))


def indexable(df: DataFrame, vec: str, metric: str) -> DataFrame:
    out = df.where(F.col(vec).isNotNull())
    return out.where(norm(vec) > 0) if metric == "cosine" else out


class Graph:
    """A layered proximity graph over the vectors of one shard."""

    def __init__(self, x: np.ndarray, config: HnswConfig):
        self.x, self.c = x, config
        rng = np.random.default_rng(config.seed)
        self.links: list[list[dict[int, list[int]]]] = []
        self.levels = np.minimum((-np.log(1 - rng.random(len(x))) / np.log(config.m)).astype(int), 30)
        self.layers: list[dict[int, list[int]]] = []
        self.entry = -1
        for i in range(len(x)):
            self._insert(i)

    def _dist(self, q: np.ndarray, ids: list[int]) -> np.ndarray:
        return distances(q[None], self.x[ids], self.c.metric)[0]

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest that a best-first walk from start meets, nearest first."""
        seen, todo = {i for _, i in start}, list(start)
        heapq.heapify(todo)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in self.layers[layer][i] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for dj, j in zip(self._dist(q, new).tolist(), new):
                if len(best) < ef or dj < -best[0][0]:
                    heapq.heappush(todo, (dj, j))
                    heapq.heappush(best, (-dj, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions first: nearer to the point than to one chosen; then the nearest of the rest."""
        chosen: list[int] = []
        rest: list[int] = []
        for d, i in found:
            if len(chosen) >= most:
                break
            (chosen if not chosen or (self._dist(self.x[i], chosen) > d).all() else rest).append(i)
        return chosen + rest[: most - len(chosen)]

    def _insert(self, i: int) -> None:
        top = int(self.levels[i])
        while len(self.layers) <= top:
            self.layers.append({})
        if self.entry < 0:
            self.entry = i
            for layer in range(top + 1):
                self.layers[layer][i] = []
            return
        q, high = self.x[i], int(self.levels[self.entry])
        near = [(float(self._dist(q, [self.entry])[0]), self.entry)]
        for layer in range(high, top, -1):
            near = self._search(q, near, 1, layer)
        for layer in range(min(top, high), -1, -1):
            near = self._search(q, near, self.c.ef_construction, layer)
            most = self.c.m * (2 if layer == 0 else 1)
            links = self.layers[layer]
            links[i] = self._choose(near, self.c.m)
            for j in links[i]:
                links[j].append(i)
                if len(links[j]) > most:
                    links[j] = self._choose(sorted(zip(self._dist(self.x[j], links[j]).tolist(), links[j])), most)
        for layer in range(high + 1, top + 1):
            self.layers[layer][i] = []
        if top > high:
            self.entry = i

    def extend(self, x: np.ndarray) -> None:
        """Insert more vectors."""
        n = len(self.x)
        rng = np.random.default_rng((self.c.seed, n))
        more = np.minimum((-np.log(1 - rng.random(len(x))) / np.log(self.c.m)).astype(int), 30)
        self.x, self.levels = np.vstack([self.x, x]), np.append(self.levels, more)
        for i in range(n, n + len(x)):
            self._insert(i)

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        near = [(float(self._dist(q, [self.entry])[0]), self.entry)]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            near = self._search(q, near, 1, layer)
        return self._search(q, near, ef, 0)


def _blocks(queries: DataFrame, key: str, vec: str, most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows = queries.select(key, vec).where(F.col(vec).isNotNull()).dropDuplicates([key])
    n = -(-rows.count() // most) or 1
    for k in range(n):
        part = (rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) if n > 1 else rows).toPandas()
        if len(part):
            yield part[key].to_numpy(), np.stack(part[vec].to_numpy()).astype(np.float64)


class HnswIndex:
    """Graphs of shards as rows of a Parquet table: shard, keys, graph (pickled)."""

    def __init__(self, spark: SparkSession, path: str, config: HnswConfig, key: str = "vec_id", shards: int = 8):
        self.spark, self.path, self.config, self.key, self.shards = spark, path, config, key, shards

    @classmethod
    def build(cls, df: DataFrame, path: str, config: HnswConfig = HnswConfig(), shards: int = 8, vec: str = "embedding", key: str = "vec_id") -> HnswIndex:
        """Choose as many shards as keep a shard within a worker's memory (about 50,000 vectors)."""
        rows = indexable(prepared(df, vec, config.kind), vec, config.metric).select(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(shards)).cast("int").alias("shard"), F.col(key).cast("long").alias("key"), F.col(vec).alias("vec"))

        def make(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("key")
            graph = Graph(np.stack(p["vec"].to_numpy()).astype(np.float64), config)
            return pd.DataFrame({"shard": [p["shard"].iloc[0]], "keys": [p["key"].tolist()], "graph": [pickle.dumps(graph)]})

        rows.groupBy("shard").applyInPandas(make, "shard int, keys array<long>, graph binary").write.mode("overwrite").parquet(path)
        return cls(df.sparkSession, path, config, key, shards)

    def insert(self, df: DataFrame, path: str, vec: str = "embedding") -> None:
        """Write the index with more vectors to a new path and use that: each shard's graph takes in its own."""
        key, shards, config = self.key, self.shards, self.config
        rows = indexable(prepared(df, vec, config.kind), vec, config.metric).select(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(shards)).cast("int").alias("shard"), F.col(key).cast("long").alias("key"), F.col(vec).alias("vec"))

        def add(shard: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            new = new.sort_values("key")
            keys, graph = (list(old["keys"].iloc[0]), pickle.loads(old["graph"].iloc[0])) if len(old) else ([], None)
            if len(new):
                x = np.stack(new["vec"].to_numpy()).astype(np.float64)
                graph = graph or Graph(x[:0], config)
                graph.x = graph.x.reshape(-1, x.shape[1])
                graph.extend(x)
            return pd.DataFrame({"shard": [shard[0]], "keys": [keys + new["key"].tolist()], "graph": [pickle.dumps(graph)]})

        both = self.spark.read.parquet(self.path).groupBy("shard").cogroup(rows.groupBy("shard"))
        both.applyInPandas(add, "shard int, keys array<long>, graph binary").write.mode("overwrite").parquet(path)
        self.path = path

    def search_batch(self, queries: DataFrame, k: int, ef: int | None = None, deleted: DataFrame | None = None, vec: str = "embedding") -> DataFrame:
        """query_id, key, distance, rank; deleted keys are skipped. A shard's walk starts with ef and is widened twice as far until that
        finds k others and none nearer than the walk before, or max_scan; so recall does not fall as shards grow."""
        from pyspark.sql import Window

        ef, key, most = max(ef or self.config.ef_search, k + 1), self.key, self.config.max_scan
        graphs = self.spark.read.parquet(self.path)
        if deleted is None:
            graphs = graphs.withColumn("gone", F.array().cast("array<long>"))
        else:  # each shard gets its own part of the tombstones; rebuild when they grow
            of = deleted.select(F.col(key).cast("long").alias("key")).distinct().groupBy(F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard"))
            graphs = graphs.join(of.agg(F.collect_list("key").alias("gone")), "shard", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<long>")))
        parts = []
        for ids, q in _blocks(indexable(prepared(queries, vec, self.config.kind), vec, self.config.metric), key, vec):

            def run(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for row in b.itertuples():
                        graph, keys, gone, out = pickle.loads(row.graph), row.keys, frozenset(row.gone), []
                        for i, v in zip(ids, q):
                            wide, before = ef, None
                            while True:
                                found = [(keys[j], d) for d, j in graph.search(v, wide) if keys[j] != i and keys[j] not in gone]
                                near = [d for _, d in found[:k]]
                                if wide >= min(most, len(keys)) or len(near) >= k and near == before:
                                    break
                                wide, before = 2 * wide, near
                            out += [(i, j, round(d, 9)) for j, d in found[:k]]
                        yield pd.DataFrame(out, columns=["query_id", key, "distance"])

            parts.append(graphs.mapInPandas(run, f"query_id long, {key} long, distance double"))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))).where(F.col("rank") <= k)
