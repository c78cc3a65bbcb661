"""Whitening of embeddings by principal components, with the covariance from one aggregation of Spark SQL expressions.

A vector's entries become whole numbers, x = floor(1024 * entry) + 100000. Their sums give the means; one aggregation then sums
the centred products of every pair of dimensions of the upper triangle, each a generated SQL expression (d * (d + 1) / 2 of them for d
dimensions), which Spark adds up in every task before one row of sums comes to the driver. The covariance of d by d numbers is
decomposed there by LAPACK, and the first components are applied to each row as expressions with the weights as
literals. Nothing but sums of fixed size leaves the tasks, and no row is shuffled.

The covariance of the whitened values themselves is aggregated too (centred, over the same list), and its largest deviation from
the identity is reported with every row.

Defined cases: vectors that are null, empty, or hold null, NaN or infinite entries are dropped; of the others those of the most
frequent length count (of equally frequent ones the longest), vectors of another length are dropped as well; repeated rows and
null vec_ids are rows of their own; an empty table gives an empty one; a component without variance (all vectors alike, or fewer
vectors than dimensions) has whitened null and is left out of identity_error, and explained is 0 where nothing varies; extra
columns do not matter, as only vec_id and the vector are read; entries beyond 2 ** 50 count as 2 ** 50; a deviation that no long
holds is null.
The plan has d * (d + 1) / 2 expressions: meant for up to some 200 dimensions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table

SCALE, SHIFT = 1024, 100_000
MOST = float(1 << 60)  # of a scaled entry
COMPONENTS = 8
#: Eigenvalues below this share of the largest one, for each dimension, are rounding errors.
ROUNDING = 1e-15


@dataclass
class Fit:
    """What the fit list says: size, sums of each dimension, the spread of all numbers, unit components (a column each) and their
    eigenvalues, falling."""

    n: int
    sums: list[int]
    spread: int
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def whole_numbers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors(vec_id, column) -> vec_id, x (array of long), of rows with entries that are all finite numbers."""
    c = F.col(column)
    finite = F.forall(c, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    x = F.transform(c, lambda e: F.floor(F.greatest(F.least(e.cast("double") * SCALE, F.lit(MOST)), F.lit(-MOST))) + F.lit(SHIFT).cast("long"))
    return vectors.where(c.isNotNull() & (F.size(c) > 0) & finite).select("vec_id", x.alias("x"))


def of_one_length(x: DataFrame) -> tuple[DataFrame, int]:
    """The rows of the most frequent length, and that length (0: no rows)."""
    most = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (x.where(F.size("x") == most["d"]), most["d"]) if most else (x, 0)


def centred(x: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """vec_id, x and a double column y0, y1, ... for each dimension: x without its mean."""
    return x.select("vec_id", "x", *[(F.get("x", F.lit(i)).cast("double") - F.lit(s / n)).alias(f"y{i}") for i, s in enumerate(sums)])


def covariance(x: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance matrix, divisor n, of the upper triangle's column aggregates."""
    d = len(sums)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    got = centred(x, n, sums).agg(*[F.expr(f"sum(y{i} * y{j}) as c{i}_{j}") for i, j in pairs]).first()
    v = np.zeros((d, d))
    for (i, j), total in zip(pairs, got, strict=True):
        v[i, j] = v[j, i] = total / n
    return v


def fit(x: DataFrame, dimensions: int) -> Fit | None:
    """The components of rows of one length; None if there are no rows."""
    if not dimensions:
        return None
    total = [F.sum(F.get("x", F.lit(i)).cast("decimal(19,0)")) for i in range(dimensions)]
    n, least, most, *sums = x.agg(F.count("*"), F.min(F.array_min("x")), F.max(F.array_max("x")), *total).first()
    sums = list(map(int, sums))
    v = covariance(x, n, sums)
    values, vectors = np.linalg.eigh(v)
    return Fit(n, sums, most - least, vectors[:, ::-1], np.maximum(values[::-1], 0), float(np.trace(v)))


def project(x: DataFrame, f: Fit, components: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation (long), w0, w1, ...: whitened values, null where a component has no variance."""
    k = min(components, len(f.sums))
    floor = ROUNDING * len(f.sums) * max(float(f.eigenvalues[0]), 0.0)
    ws = []
    for c in range(k):
        e = float(f.eigenvalues[c])
        total = " + ".join(f"y{i} * {float(f.components[i, c])!r}D" for i in range(len(f.sums)))
        ws.append((F.expr(f"({total}) / {float(np.sqrt(e))!r}D") if e > floor else F.lit(None).cast("double")).alias(f"w{c}"))
    return centred(x, f.n, f.sums).select("vec_id", deviation(f).alias("deviation"), *ws)


def deviation(f: Fit) -> Column:
    """The sum over dimensions of (n * x - sum) ** 2: in longs where those hold it for certain, else in decimals."""
    if len(f.sums) * (f.n * f.spread) ** 2 < 1 << 63 and max(map(abs, f.sums)) + f.n * f.spread < 1 << 63:
        return F.expr(" + ".join(f"({f.n}L * x[{i}] - {s}L) * ({f.n}L * x[{i}] - {s}L)" for i, s in enumerate(f.sums)))
    apart = [f"try_subtract(try_multiply(cast(x[{i}] as decimal(19,0)), {f.n}BD), {s}BD)" for i, s in enumerate(f.sums)]
    return F.expr("try_cast(" + " + ".join(f"try_multiply({a}, {a})" for a in apart) + " as bigint)")


def identity_error(projected: DataFrame) -> float | None:
    """The largest absolute entry of the whitened values' covariance minus the identity; None without a component that varies."""
    names = [c for c in projected.columns if c.startswith("w")]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    got = projected.agg(*[F.covar_pop(a, b) for a, b in pairs]).first()
    errors = [abs(x - (a == b)) for (a, b), x in zip(pairs, got, strict=True) if x is not None]
    return max(errors) if errors else None


SCHEMA = "vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vectors(vec_id, column) -> a row for each vector and component, as SCHEMA says. Fits the components while it is called."""
    x, d = of_one_length(whole_numbers(vectors, column))
    f = fit(x, d)
    if f is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA.format(kind=vectors.schema["vec_id"].dataType.simpleString()))
    projected = project(x, f, components)
    error = identity_error(projected)
    k = min(components, d)
    share = [float(e) / f.trace if f.trace else 0.0 for e in f.eigenvalues[:k]]
    rows: Column = F.array(*[F.struct(F.lit(c + 1).alias("component"), F.col(f"w{c}").alias("whitened"), F.lit(share[c]).alias("explained")) for c in range(k)])
    out = projected.select("vec_id", "deviation", F.explode(rows).alias("r"))
    return out.select(
        "vec_id", F.col("r.component").alias("component"), F.lit(f.n).cast("long").alias("n"), "deviation",
        F.col("r.whitened").alias("whitened"), F.col("r.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All finite embeddings on their first 8 whitened components."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
