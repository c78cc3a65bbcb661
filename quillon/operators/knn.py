"""Nearest neighbours by exact scan: one query vector, a batch of queries, filters, radius, re-ranking, fusion and recall.

A single query is a projection, a filter and a top-k that Spark keeps by task. A batch is a grid of cells: rows are dealt by their key to
as many row blocks as keep a block at CELL_NUMBERS numbers, queries to blocks of QUERIES; each cell is a task's group that holds one
block of either side, multiplies them piece by piece in numpy and keeps its k best of each query. The plan is of the same size
whatever the number of queries, and nothing but row counts comes to the driver. Each task merges its cells' rows before the
best k of all cells are ranked. Zero vectors have no cosine distance: they come last, as NaN.

For l2 and for packed bits by hamming a query's k-th distance so far is the bar that its next pairs must reach, so most pairs cost a
product or a count and one comparison. Vectors of few dimensions are laid out by halves along their widest dimension first: a query
starts with the piece nearest to it and meets only pieces whose box its bar reaches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import DISTANCES

QUERIES, STEP = 1 << 14, 4096  # in a block, and at once
CELL_NUMBERS, CELL_ROWS = 1 << 23, 1 << 20  # of a block of rows
SLICE = 2048  # rows at once
CELLS, PAIRS = 1 << 22, 1 << 16  # numbers and pairs at once in a task
CHUNK = 1 << 19  # pairs at once that are compared with bars
FEW = 16  # dimensions in which boxes tell pieces apart


def literal(q: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def nearest(df: DataFrame, q: Sequence[float], k: int, metric: str = "l2", vec: str = "embedding", key: str = "vec_id", where: Column | None = None, radius: float | None = None) -> DataFrame:
    """The k rows nearest to q (NULL vectors last, ties by key) with `distance`."""
    out = (df if where is None else df.where(where)).withColumn("distance", DISTANCES[metric](vec, literal(q)))
    if radius is not None:
        out = out.where(F.col("distance") < radius)
    return out.orderBy(F.col("distance").asc_nulls_last(), key).limit(k)


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """A row for each query, a column for each vector, in double precision; l1 and l2 by differences, in blocks of bounded size.

    Matrices of unsigned numbers are packed bits.
    """
    if x.dtype == np.uint64:
        both = lambda f: sum(np.bitwise_count(f(q[:, w, None], x[None, :, w])).astype(np.float64) for w in range(x.shape[1]))
        if metric == "hamming":
            return both(np.bitwise_xor)
        common, either = both(np.bitwise_and), both(np.bitwise_or)
        return np.where(common > 0, 1 - common / np.maximum(either, 1), 1.0)
    if metric == "ip":
        return -(q @ x.T)
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - np.clip((q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)), -1, 1)
    if metric == "jaccard":  # of vectors of 0 and 1
        both = q @ x.T
        either = q.sum(1)[:, None] + x.sum(1) - both
        return np.where(both > 0, 1 - both / np.maximum(either, 1), 1.0)
    out = np.empty((len(q), len(x)))
    step = max(1, CELLS // max(1, x.size))
    for at in range(0, len(q), step):
        diff = q[at : at + step, None, :] - x[None]
        out[at : at + step] = np.abs(diff).sum(2) if metric in ("l1", "hamming") else np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _l2_candidates(q: np.ndarray, x: np.ndarray, k: int, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that have all pairs among the k nearest: by the norms and products, whose rounding error is bounded."""
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    rough = qq[:, None] + xx - 2 * q @ x.T
    error = 4 * (q.shape[1] + 4) * np.finfo(float).eps * (qq + xx.max())
    rough[same] = np.inf
    bar = np.partition(rough, k - 1, axis=1)[:, k - 1]
    bar = bar + 2 * error + 4e-9 * np.sqrt(np.maximum(bar, 0) + error)  # the last term: ties to nine decimals
    return np.nonzero(rough <= bar[:, None])


def best(q: np.ndarray, x: np.ndarray, metric: str, k: int, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance to nine decimals) of each query's k nearest, the first vectors of equals; same: pairs to leave out.

    NaN is the greatest distance.
    """
    k = min(k, len(x))
    if metric == "l2" and np.isfinite(x).all() and np.isfinite(q).all():
        i, j = _l2_candidates(q, x, k, same)
        d = np.concatenate([np.sqrt(((q[i[a : a + PAIRS]] - x[j[a : a + PAIRS]]) ** 2).sum(1)) for a in range(0, len(i) or 1, PAIRS)])
    else:
        whole = distances(q, x, metric)
        low = np.where(np.isnan(whole) | same, np.inf, whole)
        bar = np.partition(low, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero(low <= bar[:, None] + 1e-9)
        d = whole[i, j]
    d = np.round(d, 9)
    order = np.lexsort((j, d, i))  # numpy sorts NaN last
    i, j, d = i[order], j[order], d[order]
    keep = ~same[i, j]
    i, j, d = i[keep], j[keep], d[keep]
    first = np.searchsorted(i, np.arange(len(q)))
    keep = np.arange(len(i)) - first[i] < k
    return i[keep], j[keep], d[keep]


def _first_k(query: np.ndarray, group: np.ndarray, distance: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """The places of the k first by (distance, key) of each query and group."""
    order = np.lexsort((key, distance, group, query))  # numpy sorts NaN last
    q, g = query[order], group[order]
    fresh = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (g[1:] != g[:-1])) if len(q) else [])
    return order[np.arange(len(q)) - np.repeat(fresh, np.diff(np.append(fresh, len(q)))) < k]


def _halved(x: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """order in pieces of SLICE rows at most, halved along the widest dimension of each."""
    todo, out = [order], []
    while todo:
        some = todo.pop()
        if len(some) <= SLICE:
            out.append(some)
            continue
        v = x[some]
        at, half = int(np.argmax(v.max(0) - v.min(0))), len(some) // 2
        by = np.argpartition(v[:, at], half)
        todo += [some[by[:half]], some[by[half:]]]
    return out


def _within(q: np.ndarray, x: np.ndarray, bars: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance to nine decimals) of the pairs within each query's bar, which is inclusive; where that is infinite, of
    the `most` nearest at least. By l2 or, of packed bits, by hamming."""
    open_ = np.isinf(bars)
    nth = min(most, len(x)) - 1
    if x.dtype == np.uint64:
        rough = np.bitwise_count(q[:, 0, None] ^ x[None, :, 0])
        for w in range(1, x.shape[1]):
            rough = rough.astype(np.int32) + np.bitwise_count(q[:, w, None] ^ x[None, :, w])
        limit = np.where(open_, 0, bars)
        if open_.any():
            limit[open_] = np.partition(rough[open_], nth, axis=1)[:, nth]
        at = np.flatnonzero(rough <= np.minimum(limit, np.iinfo(rough.dtype).max).astype(rough.dtype)[:, None] if (limit >= 0).all() else rough <= limit[:, None])
        i, j = np.divmod(at, len(x))
        return i, j, rough.ravel()[at].astype(float)
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    rough = q @ (-2 * x.T)
    rough += qq[:, None]
    rough += xx
    error = 4 * (q.shape[1] + 4) * np.finfo(float).eps * (qq + xx.max())
    limit = np.where(open_, 0, bars + 2e-9) ** 2 + 2 * error  # nine decimals round a tie apart by 1e-9 at most
    if open_.any():
        bar = np.partition(rough[open_], nth, axis=1)[:, nth]
        limit[open_] = bar + 2 * error[open_] + 4e-9 * np.sqrt(np.maximum(bar, 0) + error[open_])
    i, j = np.divmod(np.flatnonzero(rough <= limit[:, None]), len(x))
    d = np.concatenate([np.sqrt(((q[i[a : a + PAIRS]] - x[j[a : a + PAIRS]]) ** 2).sum(1)) for a in range(0, len(i) or 1, PAIRS)])
    return i, j, np.round(d, 9)


def _by_bars(q: np.ndarray, ids: np.ndarray, x: np.ndarray, mine: np.ndarray, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of each query's k nearest by (distance, key); x: finite numbers, by l2, or packed bits, by hamming."""
    order = np.argsort(mine, kind="stable")
    bits = x.dtype == np.uint64
    most = k + (int(np.unique(mine, return_counts=True)[1].max()) if skip_self else 0)  # a query's own rows may be among the nearest
    bars, found, held = np.full(len(q), np.inf), [], 0

    def settle() -> None:
        nonlocal found, held
        i, j, d = map(np.concatenate, zip(*found))
        keep = _first_k(i, np.zeros(len(i), np.int64), d, mine[j], k)
        i, j, d = i[keep], j[keep], d[keep]
        found, held = [(i, j, d)], len(i)
        n = np.bincount(i, minlength=len(q))
        full = n == k
        bars[full] = d[np.cumsum(n)[full] - 1] - (1 if bits else 0)  # bits go by key: of equals the first are there

    def meet(piece: np.ndarray, asked: np.ndarray) -> None:
        nonlocal held
        rows = x[piece]
        for lo in range(0, len(asked), step := max(1, CHUNK // len(piece))):
            some = asked[lo : lo + step]
            i, j, d = _within(q[some], rows, bars[some], most)
            i, j = some[i], piece[j]
            if skip_self:
                keep = ids[i] != mine[j]
                i, j, d = i[keep], j[keep], d[keep]
            found.append((i, j, d))
            held += len(i)
        if held > 2 * k * len(q):
            settle()

    everyone = np.arange(len(q))
    if bits or x.shape[1] > FEW or len(x) <= 2 * SLICE:
        for at in range(0, len(x), SLICE):
            meet(order[at : at + SLICE], everyone)
            if at == 0:
                settle()
    else:
        pieces = _halved(x, order)
        low, high = (np.stack([f(x[p], axis=0) for p in pieces]) for f in (np.min, np.max))
        away = np.empty((len(q), len(pieces)), np.float32)  # from the box, squared
        for lo in range(0, len(q), step := max(1, CELLS // low.size)):
            some = q[lo : lo + step, None]
            away[lo : lo + step] = (np.maximum(np.maximum(low - some, some - high), 0) ** 2).sum(2)
        first = away.argmin(1)
        for p, piece in enumerate(pieces):
            meet(piece, np.flatnonzero(first == p))
        settle()
        for p, piece in enumerate(pieces):
            reach = away[:, p] * (1 - 1e-6) <= (bars + 2e-9) ** 2
            meet(piece, np.flatnonzero(reach & (first != p)))
    settle()
    return found[0]


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    whole = column.combine_chunks()
    packed = pa.types.is_struct(whole.type)
    x = (whole.field("words") if packed else whole).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return x.view(np.uint64) if packed else x


def in_cells(left: DataFrame, right: DataFrame, on: Sequence[str], k: int, metric: str, vec: str = "embedding", key: str = "vec_id", groups: str | None = None, skip_self: bool = True) -> DataFrame:
    """left(on, key, vec, groups) and right(on, query_id, q) -> query_id, key, distance, groups: each query's k nearest (of each value of
    groups) among the rows of its cell. A cell's rows and queries meet in one task, so the caller bounds both; of queries with the same
    query_id one counts."""
    extra = [groups] if groups else []

    def run(x: pa.Table, q: pa.Table) -> pa.Table:
        ids, first = np.unique(q["query_id"].to_numpy(), return_index=True)
        q, found = q.take(first), []
        mine = x[key].to_numpy()
        of, names = np.zeros(len(x), np.int64), None
        if groups:
            coded = x[groups].combine_chunks().dictionary_encode()
            of, names = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        if len(x) and len(q):
            order = np.argsort(mine, kind="stable")
            exact = lambda m: m if m.dtype == np.uint64 else m.astype(np.float64)
            vectors, targets = _matrix(x[vec], len(x)), exact(_matrix(q["q"], len(q)))
            barred = metric == "hamming" if vectors.dtype == np.uint64 else metric == "l2" and np.isfinite(vectors).all() and np.isfinite(targets).all()
            for g in np.unique(of) if barred else ():
                some = np.flatnonzero(of == g)
                i, j, d = _by_bars(targets, ids, exact(vectors[some]), mine[some], k, skip_self)
                found.append((i, np.full(len(i), g), d, some[j]))
            for at in range(0, 0 if barred else len(x), SLICE):
                slice_ = order[at : at + SLICE]
                for lo in range(0, len(ids), STEP):
                    asked = slice(lo, lo + STEP)
                    for g in np.unique(of[slice_]):
                        some = slice_[of[slice_] == g]
                        same = ids[asked, None] == mine[some][None] if skip_self else np.zeros((len(ids[asked]), len(some)), bool)
                        i, j, d = best(targets[asked], exact(vectors[some]), metric, k, same)
                        found.append((i + lo, np.full(len(i), g), d, some[j]))
                if sum(len(f[0]) for f in found) > 2 * k * max(len(ids), 4 * STEP) * (len(names) + 1 if groups else 1):
                    i, g, d, j = map(np.concatenate, zip(*found))
                    keep = _first_k(i, g, d, mine[j], k)
                    found = [(i[keep], g[keep], d[keep], j[keep])]
        i, g, d, j = map(np.concatenate, zip(*found)) if found else (np.empty(0, np.int64),) * 4
        keep = _first_k(i, g, d, mine[j], k) if len(i) else np.empty(0, np.int64)
        columns = [pa.array(ids[i[keep]]), pa.array(mine[j[keep]]), pa.array(d[keep], pa.float64())]
        if groups:
            columns.append(names.take(pa.array(np.where(g[keep] < len(names), g[keep], 0), mask=g[keep] >= len(names))))
        return pa.table(columns, names=["query_id", key, "distance", *extra])

    types = {f.name: f.dataType.simpleString() for f in left.schema} | {"query_id": right.schema["query_id"].dataType.simpleString(), "distance": "double"}
    met = left.groupBy(*on).cogroup(right.select(*on, "query_id", "q").groupBy(*on))
    return met.applyInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in ("query_id", key, "distance", *extra)))


def nearest_batch(df: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", vec: str = "embedding", key: str = "vec_id", groups: str | None = None, skip_self: bool = True) -> DataFrame:
    """query_id, key, distance, rank: the k rows nearest to each query; NULL vectors are left out, ties go by key.

    Vectors may be packed bits, by hamming or jaccard. A row with the query's own key is left out unless skip_self is False. With `groups`, the k nearest of each value of that
    column. Keys identify rows; of queries with the same key one counts.
    """
    extra = [groups] if groups else []
    rows = df.where(F.col(vec).isNotNull()).select(key, vec, *extra)
    some = rows.select(F.size(f"{vec}.words" if rows.schema[vec].dataType.typeName() == "struct" else vec)).first()
    if some is None:
        return rows.select(F.lit(0).cast("long").alias("query_id"), key, F.lit(0.0).alias("distance"), *extra, F.lit(0).alias("rank")).limit(0)
    n, m = (r["n"] for r in df.agg(F.count("*").alias("n")).unionAll(queries.agg(F.count("*").alias("n"))).collect())
    high, wide = max(-(-n * some[0] // CELL_NUMBERS), -(-n // CELL_ROWS), 1), max(-(-m // QUERIES), -(-m * some[0] // CELL_NUMBERS), 1)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)
    left = rows.select(block(key, high).alias("_r"), every(wide).alias("_c"), key, vec, *extra)
    q = queries.where(F.col(vec).isNotNull()).select(F.col(key).alias("query_id"), F.col(vec).alias("q"))
    right = q.select(block("query_id", wide).alias("_c"), every(high).alias("_r"), "query_id", "q")

    out = in_cells(left, right, ["_r", "_c"], k, metric, vec, key, groups, skip_self)
    rank = F.row_number().over(Window.partitionBy("query_id", *extra).orderBy(F.isnan("distance"), "distance", key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def rerank(df: DataFrame, q: Sequence[float], coarse: Column, wide: int, k: int, metric: str = "cosine", vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The `wide` rows of least coarse distance, then the k nearest of them by the exact one."""
    first = df.withColumn("coarse", coarse).orderBy(F.col("coarse").asc_nulls_last(), key).limit(wide)
    return nearest(first, q, k, metric, vec, key)


def strict_order(found: DataFrame, key: str = "vec_id") -> DataFrame:
    """found(query_id, key, distance, rank) ranked by distance, whatever order it came in; the rows stay the same."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("distance"), "distance", key)))


def recall(approximate: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """query_id, recall: the share of each query's exact neighbours that the approximate ones have."""
    hits = exact.join(approximate.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def tied_recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of each query's neighbours that are no farther than its last exact one; for distances with many ties."""
    bar = exact.groupBy("query_id").agg(F.max("distance").alias("bar"), F.count("*").alias("n"))
    hits = bar.join(approximate.select("query_id", "distance"), "query_id", "left").groupBy("query_id", "n")
    near = F.count(F.when(F.col("distance") <= F.col("bar") + 1e-9, 1))
    return hits.agg((F.least(near, F.col("n")) / F.col("n")).alias("recall")).drop("n")


def reciprocal_rank_fusion(rankings: Sequence[DataFrame], key: str | Sequence[str], k: int = 60) -> DataFrame:
    """key, score: the sum of 1 / (k + rank) over rankings with a column `rank`; key may be several columns, such as a query and a row."""
    keys = [key] if isinstance(key, str) else list(key)
    parts = [r.select(*keys, (1 / (k + F.col("rank"))).alias("part")) for r in rankings]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.sum("part").alias("score"))
