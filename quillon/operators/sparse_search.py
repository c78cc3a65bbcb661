"""The rows of greatest inner product with sparse vectors, by postings with an upper bound for each list; any number of dimensions.

The index is three tables: `postings` (index, key, value) in folders by hash of the index, `lists` (index, how many, greatest and least
value, parts) and `vectors` (key, vec). No vector is ever filled up. A list of very many rows is dealt to parts by hash of the key.

A batch of queries runs in two steps. The rows of each query's list of greatest bound that are best there, a few times k, are scored
exactly; the k-th best of them is a bar that every result must reach. Then the query's lists are taken from the least bound up as long
as their bounds together stay under the bar: rows that occur in no other list cannot reach it, so those lists are not read. The
rows of the others have a score from these lists; if that and the bounds of the lists left out reach the bar, the rest of the score is
taken from the row's own vector. So long lists of small weight cost nothing, and nothing is missed.

Queries that ask for more than a SHARE of all postings each, on average, would make more pairs of postings than a scan has products: they
meet all vectors in cells of one block of either side, each vector read once for each block of queries, with the k-th score so far as a bar.

Results are rows with a positive product; ties go by key. NULL vectors, and rows without entries, are left out; cosine divides by
the norms first. Keys identify rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import sparse as S
from quillon.operators.knn import _first_k
from quillon.sources.tables import scratch_path

FOLDERS, FOLDER_ROWS = 4096, 1_000_000  # the most folders, and how many postings are worth one
FILE_ROWS = 5_000_000  # where folders have more, they get several files, each sorted
PART, MOST_LONG = 50_000, 10_000
SEEDS = 4  # times k
SHARE = 0.01
BLOCK, QUERIES = 2_000_000, 1024  # entries of a block of vectors, queries of a block
STEP, ENTRIES = 64, 1 << 15  # queries and entries that are multiplied at once


def _parts(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices, values, where each vector's begin and end)."""
    v = t[name].combine_chunks()
    at = pa.compute.list_value_length(v.field("indices")).to_numpy(zero_copy_only=False)
    flat = lambda f: v.field(f).flatten().to_numpy(zero_copy_only=False)
    return flat("indices"), flat("values").astype(np.float64), np.append(0, np.cumsum(at))


def _scan(x: pa.Table, q: pa.Table, key: str, vec: str, k: int, skip_self: bool) -> pa.Table:
    """query_id, key, score: each query's k rows of greatest positive product in one cell."""
    ids, mine, found = q["query_id"].to_numpy(), x[key].to_numpy(), []
    (index, value, at), (asked, weight, of) = _parts(x, vec), _parts(q, "q")
    for lo in range(0, len(ids), STEP):
        hi = min(lo + STEP, len(ids))
        known, place = np.unique(asked[of[lo] : of[hi]], return_inverse=True)
        if not len(known):
            continue
        table = np.zeros((len(known), hi - lo))
        table[place, np.repeat(np.arange(hi - lo), np.diff(of[lo : hi + 1]))] = weight[of[lo] : of[hi]]
        bars, some, held, a = np.zeros(hi - lo), [], 0, 0
        while a < len(mine):
            b = max(a + 1, int(np.searchsorted(at, at[a] + ENTRIES, side="right")) - 1)
            t = np.searchsorted(known, index[at[a] : at[b]])
            t[t == len(known)] = 0
            hit = np.flatnonzero(known[t] == index[at[a] : at[b]])
            row = np.repeat(np.arange(a, b), np.diff(at[a : b + 1]))[hit]
            if len(hit):
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                score = np.round(np.add.reduceat(table[t[hit]] * value[at[a] : at[b]][hit][:, None], first, axis=0), 9)
                i, j = np.nonzero((score > 0) & (score >= bars))
                r = row[first][i]
                keep = ids[lo + j] != mine[r] if skip_self else slice(None)
                some.append((j[keep], r[keep], -score[i, j][keep]))
                held += len(some[-1][0])
            a = b
            if some and (held > 4 * k * (hi - lo) or a == len(mine)):
                j, r, d = map(np.concatenate, zip(*some))
                best = _first_k(j, np.zeros(len(j), np.int64), d, mine[r], k)
                j, r, d = j[best], r[best], d[best]
                n = np.bincount(j, minlength=hi - lo)
                bars[n == k] = -d[np.cumsum(n)[n == k] - 1]
                some, held = [(j, r, d)], len(j)
        found += [(j + lo, r, d) for j, r, d in some]
    j, r, d = map(np.concatenate, zip(*found)) if found else (np.empty(0, np.int64),) * 3
    return pa.table([pa.array(ids[j]), pa.array(mine[r]), pa.array(-d, pa.float64())], names=["query_id", key, "score"])


def _entries(df: DataFrame, vec: str, *keep: Column | str) -> DataFrame:
    return df.select(*keep, F.explode(F.arrays_zip(F.col(f"{vec}.indices").alias("indices"), F.col(f"{vec}.values").alias("values"))).alias("_e")).select(
        *[c if isinstance(c, str) else c for c in keep], F.col("_e.indices").alias("index"), F.col("_e.values").cast("double").alias("value")
    )


class SparseIndex:
    """Postings of sparse vectors at a path."""

    def __init__(self, spark: SparkSession, path: str, vectors: DataFrame, metric: str, key: str, vec: str, folders: int):
        self.spark, self.metric, self.key, self.vec, self.vectors, self.folders = spark, metric, key, vec, vectors, folders
        kind = vectors.schema[key].dataType.simpleString()
        self.postings = spark.read.schema(f"index int, `{key}` {kind}, value double, part int, folder int").parquet(f"{path}/postings")
        self.lists = spark.read.schema("index int, n bigint, most double, least double, parts int").parquet(f"{path}/lists")

    @classmethod
    def build(cls, df: DataFrame, path: str, metric: str = "ip", key: str = "vec_id", vec: str = "embedding", part: int = PART) -> SparseIndex:
        if metric not in ("ip", "cosine"):
            raise ValueError("metric must be ip or cosine")
        spark = df.sparkSession
        rows = df.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(key, S.l2_normalize(vec).alias(vec) if metric == "cosine" else vec)
        rows.write.mode("overwrite").parquet(f"{path}/vectors")
        vectors = spark.read.schema(rows.schema).parquet(f"{path}/vectors")
        entries = _entries(vectors, vec, key)
        by = entries.groupBy("index").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.min("value").alias("least"))
        by.write.mode("overwrite").parquet(f"{path}/counts")
        by = spark.read.schema(by.schema).parquet(f"{path}/counts")
        total = by.agg(F.sum("n")).first()[0] or 0
        size, folders = max(part, total // MOST_LONG), min(FOLDERS, 1 + total // FOLDER_ROWS)
        parts = F.ceil(F.col("n") / size).cast("int")
        by.withColumn("parts", parts).write.mode("overwrite").parquet(f"{path}/lists")
        dealt = F.broadcast(by.where(F.col("n") > size).select("index", parts.alias("parts")))  # MOST_LONG at most
        dealt = entries.join(dealt, "index", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(key), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        dealt = dealt.withColumn("folder", F.pmod(F.xxhash64("index"), F.lit(folders)).cast("int"))
        files = F.pmod(F.xxhash64(key), F.lit(1 + total // (folders * FILE_ROWS)))
        dealt.repartition("folder", "part", files).sortWithinPartitions("index").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
        return cls(spark, path, vectors, metric, key, vec, folders)

    def _asked(self, queries: DataFrame) -> DataFrame:
        """query_id, index, weight, bound, place (1: the greatest bound), below: the sum of bounds up to this list, least first."""
        lists = _entries(queries, "q", "query_id").withColumnRenamed("value", "weight").join(self.lists, "index")
        lists = lists.withColumn("bound", F.greatest(F.col("weight") * F.col("most"), F.col("weight") * F.col("least"), F.lit(0.0)))
        up = Window.partitionBy("query_id").orderBy("bound", "index")
        down = Window.partitionBy("query_id").orderBy(F.desc("bound"), F.desc("index"))
        return lists.withColumn("below", F.sum("bound").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("place", F.row_number().over(down))

    def _met(self, asked: DataFrame) -> DataFrame:
        """query_id, key, part of the score: the rows of the asked lists."""
        wanted = asked.select("query_id", "index", "weight", F.pmod(F.xxhash64("index"), F.lit(self.folders)).cast("int").alias("folder"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return self.postings.join(wanted, ["folder", "index", "part"]).select("query_id", self.key, (F.col("weight") * F.col("value")).alias("share"))

    def _exact(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        scored = pairs.join(queries, "query_id").join(self.vectors, self.key)
        return scored.select("query_id", self.key, F.round(S.inner_product("q", self.vec), 9).alias("score")).where(F.col("score") > 0)

    def essential(self, queries: DataFrame, k: int, skip_self: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(queries as they are compared; the lists that may hold results; query_id, bar, left_out, the bounds of the other lists, and all_read,
        whether there are none)."""
        q = F.col(self.vec)
        asked = queries.where(q.isNotNull()).select(F.col(self.key).alias("query_id"), (S.l2_normalize(self.vec) if self.metric == "cosine" else q).alias("q")).dropDuplicates(["query_id"])
        path = scratch_path(self.spark, "sparse")
        self._asked(asked).write.parquet(path)
        lists = self.spark.read.parquet(path)
        found = self._met(lists.where("place = 1 and bound > 0"))
        found = found.where(F.col("query_id") != F.col(self.key)) if skip_self else found
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("share"), self.key))
        seeds = found.withColumn("_r", rank).where(F.col("_r") <= SEEDS * k).select("query_id", self.key)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), self.key))
        bar = self._exact(seeds, asked).withColumn("_r", place).where(F.col("_r") == k)
        bar = bar.select("query_id", (F.col("score") * (1 - 1e-6) - 1e-9).alias("bar"))  # products of single-precision values are rounded
        marked = lists.join(bar, "query_id", "left").withColumn("needed", (F.col("bound") > 0) & (F.col("bar").isNull() | (F.col("below") >= F.col("bar"))))
        path = scratch_path(self.spark, "lists")
        marked.write.parquet(path)
        marked = self.spark.read.parquet(path)
        rest = marked.groupBy("query_id").agg(F.max("bar").alias("bar"), F.coalesce(F.sum(F.when(~F.col("needed"), F.col("bound"))), F.lit(0.0)).alias("left_out"), F.bool_and("needed").alias("all_read"))
        return asked, marked.where("needed"), rest

    def search_batch(self, queries: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
        """queries(key, vec) -> query_id, key, score, rank: the k rows of greatest positive product with each query."""
        q = F.col(self.vec)
        asked = queries.where(q.isNotNull()).select(F.col(self.key).alias("query_id"), (S.l2_normalize(self.vec) if self.metric == "cosine" else q).alias("q")).dropDuplicates(["query_id"])
        total = self.lists.agg(F.sum("n")).first()[0] or 0
        wanted = _entries(asked, "q", "query_id").join(self.lists, "index").agg(F.sum("n").alias("n"), F.countDistinct("query_id").alias("m")).first()  # two numbers
        if (wanted["n"] or 0) > SHARE * total * wanted["m"]:
            return self._scanned(asked, k, total, wanted["m"], skip_self)
        asked, lists, rest = self.essential(queries, k, skip_self)
        met = self._met(lists).groupBy("query_id", self.key).agg(F.sum("share").alias("known"))
        met = met.where(F.col("query_id") != F.col(self.key)) if skip_self else met
        met = met.join(rest, "query_id").where(F.col("bar").isNull() | (F.col("known") + F.col("left_out") >= F.col("bar")))
        whole = met.where("all_read").select("query_id", self.key, F.round("known", 9).alias("score")).where("score > 0")
        parts = self._exact(met.where("not all_read").select("query_id", self.key), asked)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), self.key))
        return whole.unionByName(parts).withColumn("rank", rank).where(F.col("rank") <= k)

    def _scanned(self, asked: DataFrame, k: int, total: int, m: int, skip_self: bool) -> DataFrame:
        """search_batch() by products of whole vectors, in a grid of cells."""
        key, vec, high, wide = self.key, self.vec, -(-total // BLOCK), -(-m // QUERIES)
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = self.vectors.where(F.size(f"{vec}.indices") > 0).select(block(key, high).alias("_r"), every(wide).alias("_c"), key, vec)
        right = asked.select(every(high).alias("_r"), block("query_id", wide).alias("_c"), "query_id", "q")
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        met = left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c"))
        out = met.applyInArrow(lambda x, q: _scan(x, q, key, vec, k, skip_self), f"query_id {kind(asked, 'query_id')}, `{key}` {kind(left, key)}, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
        return out.withColumn("rank", rank).where(F.col("rank") <= k)
