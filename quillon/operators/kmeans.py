"""k-means over a table of vectors: seeds and rounds run on the executors, only centres come to the driver.

Samples of up to LOCAL numbers are fitted on the driver, from spread-out starts. Longer ones never leave the executors: seeding picks candidates
in SEED_ROUNDS passes, each row with a chance in proportion to its distance from the candidates so far, and keeps the k that most rows
are nearest to; then each round every task adds up its rows by nearest centre, and the sums of a centre meet in one group. Products
of rows and centres are made in blocks of CELLS numbers at most. Centres are means, unit means (spherical) or, of packed bits, the
majority of each bit. Equal rows have equal chances and count as one candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 22
LOCAL = 1 << 22
SEED_ROUNDS, ROUNDS, LOCAL_ROUNDS = 4, 10, 50
ENOUGH = 0.999  # a round that leaves more of the cost than this is the last


@dataclass(frozen=True)
class Dense:
    """Vectors of numbers; spherical: compared by direction."""

    spherical: bool = False

    def matrix(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        x = whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1).astype(np.float64) if len(whole) else np.empty((0, 1))
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) if self.spherical else x

    def distances(self, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 0)

    def step(self, centres: np.ndarray) -> int:
        return max(1, CELLS // max(1, len(centres)))

    def numbers(self, x: np.ndarray) -> np.ndarray:
        return x

    def centre(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        c = sums / n[:, None]
        return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30) if self.spherical else c


@dataclass(frozen=True)
class Bits:
    """Bits packed into 64-bit words (struct of len and words), compared by the number of different ones."""

    def matrix(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return whole.field("words").flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1).view(np.uint64) if len(whole) else np.empty((0, 1), np.uint64)

    def distances(self, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(centres)))
        for w in range(x.shape[1]):  # a word at a time: never more than one number for each pair
            out += np.bitwise_count(x[:, w, None] ^ centres[None, :, w])
        return out

    def step(self, centres: np.ndarray) -> int:
        return max(1, CELLS // max(1, len(centres)))

    def numbers(self, x: np.ndarray) -> np.ndarray:
        return np.unpackbits(x.astype(">u8").view(np.uint8).reshape(len(x), -1), axis=1)

    def centre(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.packbits(sums * 2 > n[:, None], axis=1).view(">u8").astype(np.uint64)


Space = Dense | Bits


def nearest(x: np.ndarray, centres: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centre of each row, its distance)."""
    at, low = np.empty(len(x), np.int64), np.empty(len(x))
    for k in range(0, len(x), step := space.step(centres)):
        d = space.distances(x[k : k + step], centres)
        at[k : k + step] = best = d.argmin(1)
        low[k : k + step] = d[np.arange(len(best)), best]
    return at, low


def _sums(x: np.ndarray, at: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres that have rows, how many, the sums of their rows' numbers)."""
    order = np.argsort(at, kind="stable")
    ids, first, n = np.unique(at[order], return_index=True, return_counts=True)
    return ids, n, np.add.reduceat(space.numbers(x)[order], first, axis=0, dtype=np.float64)


def fit_local(x: np.ndarray, k: int, space: Space, seed: int = 0) -> np.ndarray:
    """Centres of a matrix, from spread-out starts (each next one drawn with the distance to the nearest so far)."""
    if len(x) == 0:
        raise ValueError("no vectors to fit centres on")
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    near = space.distances(x, x[chosen])[:, 0]
    while len(chosen) < k and near.sum() > 0:
        chosen.append(int(rng.choice(len(x), p=near / near.sum())))
        near = np.minimum(near, space.distances(x, x[chosen[-1:]])[:, 0])
    centres, old = x[chosen].copy(), None
    for _ in range(LOCAL_ROUNDS):
        at, _ = nearest(x, centres, space)
        if old is not None and (at == old).all():
            break
        old = at
        ids, n, sums = _sums(x, at, space)
        centres[ids] = space.centre(sums, n)
    return centres


def _pass(sample: DataFrame, vec: str, centres: np.ndarray, space: Space, f, schema: str, *more: str) -> DataFrame:
    """f(batch, matrix, nearest, distance) for each batch of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = space.matrix(b.column(0))
                yield f(b, x, *nearest(x, centres, space))

    return sample.select(vec, *more).mapInArrow(run, schema)


def seeds(sample: DataFrame, vec: str, k: int, space: Space, seed: int = 0) -> np.ndarray:
    """At most k starts from SEED_ROUNDS passes that pick about 2 * k candidates."""
    chance = F.pmod(F.xxhash64(vec, F.lit(seed)), F.lit(1 << 50)) / float(1 << 50)
    centres = space.matrix(sample.select(vec).orderBy(F.xxhash64(vec, F.lit(seed))).limit(1).toArrow().column(0))
    for r in range(SEED_ROUNDS):
        cost = _pass(sample, vec, centres, space, lambda b, x, at, d: pa.RecordBatch.from_pydict({"cost": [float(d.sum())]}), "cost double").agg(F.sum("cost")).first()[0]
        if not cost:
            break
        rate = 2 * k / SEED_ROUNDS / cost

        def pick(b, x, at, d):
            return pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(b.column(1).to_numpy(zero_copy_only=False) < rate * d))], [vec])  # noqa: B023

        u = F.pmod(chance + r * 0.6180339887, F.lit(1.0))
        picked = _pass(sample.withColumn("_u", u), vec, centres, space, pick, f"`{vec}` {sample.schema[vec].dataType.simpleString()}", "_u").distinct().limit(4 * k)
        found = picked.toArrow().column(0)
        if len(found):
            centres = np.concatenate([centres, space.matrix(found)])
    weights = _pass(sample, vec, centres, space, lambda b, x, at, d: pa.RecordBatch.from_arrays(list(map(pa.array, np.unique(at, return_counts=True))), ["c", "n"]), "c long, n long")
    heavy = weights.groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(k).collect()  # k numbers
    return centres[sorted(r.c for r in heavy)]


def fit_spread(sample: DataFrame, vec: str, k: int, space: Space, seed: int = 0) -> np.ndarray:
    """Centres of a table that stays on the executors."""
    centres, before = seeds(sample, vec, k, space, seed), np.inf

    def partial(b, x, at, d):
        ids, n, sums = _sums(x, at, space)
        cost = np.bincount(at, d)[ids]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(cost), pa.array(list(sums), pa.list_(pa.float64()))], ["c", "n", "cost", "sums"])

    def total(t: pa.Table) -> pa.Table:
        sums = t["sums"].combine_chunks().flatten().to_numpy().reshape(len(t), -1).sum(0)
        return pa.table({"c": t["c"][:1], "n": [sum(t["n"].to_pylist())], "cost": [float(np.sum(t["cost"].to_numpy()))], "sums": [sums.tolist()]})

    schema = "c long, n long, cost double, sums array<double>"
    for _ in range(ROUNDS):
        made = _pass(sample, vec, centres, space, partial, schema).groupBy("c").applyInArrow(total, schema).toArrow()  # as many rows as centres
        sums = made["sums"].combine_chunks().flatten().to_numpy().reshape(len(made), -1)
        centres[made["c"].to_numpy()] = space.centre(sums, made["n"].to_numpy())
        cost = float(made["cost"].to_numpy().sum())
        if cost >= ENOUGH * before:
            break
        before = cost
    return centres


def fit(sample: DataFrame, vec: str, k: int, space: Space, seed: int = 0) -> np.ndarray:
    """At most k centres of the sample, a written table: by the driver if it has LOCAL numbers at most, else by the executors."""
    first = sample.select(vec).limit(1).toArrow().column(0)
    if not len(first):
        raise ValueError("no vectors to fit centres on")
    if sample.count() * space.numbers(space.matrix(first)).shape[1] <= LOCAL:
        return fit_local(space.matrix(sample.select(vec).toArrow().column(0)), k, space, seed)
    return fit_spread(sample, vec, k, space, seed)
