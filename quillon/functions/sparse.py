"""Sparse vectors: structs of dim, indices (0-based, ascending, distinct) and values (not zero), as Column expressions.

Distances merge the stored entries of both by index, so their cost follows those, not the dimension.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.vectors import _fold, let

TYPE = "struct<dim:int,indices:array<int>,values:array<float>>"
MAX_DIM, MAX_ENTRIES = 1_000_000_000, 16_000
Vec = Column | str


def _c(v: Vec) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _build(dim: Column, entries: Column) -> Column:
    """entries: array of struct(i, x), any order."""
    kept = F.array_sort(F.filter(entries, lambda e: e["x"] != 0))
    return F.struct(dim.cast("int").alias("dim"), F.transform(kept, lambda e: e["i"]).alias("indices"), F.transform(kept, lambda e: e["x"]).alias("values")).cast(TYPE)


def parse(text: Vec) -> Column:
    """'{1:1.5,3:2}/5' with 1-based indices; malformed text, repeated or outlying indices are errors."""
    t = F.regexp_replace(_c(text), r"\s", "")
    ok = t.rlike(r"^\{(?:[0-9]+:[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?(?:,[0-9]+:[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)*)?\}/[0-9]+$")
    dim = F.regexp_extract(t, r"/([0-9]+)$", 1).cast("int")
    parts = F.filter(F.split(F.regexp_extract(t, r"^\{(.*)\}", 1), ","), lambda p: p != "")
    entries = F.transform(parts, lambda p: F.struct((F.split_part(p, F.lit(":"), F.lit(1)).cast("int") - 1).alias("i"), F.split_part(p, F.lit(":"), F.lit(2)).cast("float").alias("x")))
    index = F.transform(entries, lambda e: e["i"])
    bad = (F.size(F.array_distinct(index)) != F.size(index)) | F.exists(index, lambda i: (i < 0) | (i >= dim)) | (dim < 1) | (dim > MAX_DIM) | (F.size(index) > MAX_ENTRIES)
    return F.when(_c(text).isNull(), F.lit(None).cast(TYPE)).when(~ok | bad, F.raise_error(F.concat(F.lit("invalid sparse vector: "), _c(text))).cast(TYPE)).otherwise(_build(dim, entries))


def format_(v: Vec) -> Column:
    v = _c(v)
    entries = F.zip_with(v["indices"], v["values"], lambda i, x: F.concat((i + 1).cast("string"), F.lit(":"), F.regexp_replace(x.cast("string"), r"\.0$", "")))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}/"), v["dim"].cast("string"))


def from_dense(v: Vec) -> Column:
    v = _c(v)
    entries = F.transform(v, lambda x, i: F.struct(i.alias("i"), x.cast("float").alias("x")))
    return F.when(v.isNotNull(), _build(F.size(v), entries))


def to_dense(v: Vec) -> Column:
    v = _c(v)
    by = F.map_from_arrays(v["indices"], v["values"])
    return F.when(v["dim"] > 16_000, F.raise_error(F.lit("vector cannot have more than 16000 dimensions")).cast("array<float>")).otherwise(F.transform(F.sequence(F.lit(0), v["dim"] - 1), lambda i: F.coalesce(F.try_element_at(by, i), F.lit(0.0).cast("float"))))


def _checked(a: Column, b: Column, result: Column) -> Column:
    return F.when(a["dim"] != b["dim"], F.raise_error(F.lit("different sparsevec dimensions")).cast("double")).otherwise(result)


def _merged(a: Column, b: Column) -> Column:
    """(i, x, y) by index: an entry of each, one after the other where both store the index; what is not stored is 0."""
    zero = F.lit(0.0)
    one = F.zip_with(a["indices"], a["values"], lambda i, x: F.struct(i.alias("i"), x.cast("double").alias("x"), zero.alias("y")))
    two = F.zip_with(b["indices"], b["values"], lambda i, y: F.struct(i.alias("i"), zero.alias("x"), y.cast("double").alias("y")))
    return F.array_sort(F.concat(one, two))


def _union(a: Vec, b: Vec, f) -> Column:
    """The sum of f(x, y) over the indices that either stores; f(0, 0) is 0."""
    a, b = _c(a), _c(b)
    state = lambda sum_, i, x, y: F.struct(sum_.alias("sum"), i.alias("i"), x.alias("x"), y.alias("y"))

    def step(s: Column, e: Column) -> Column:
        again = s["i"] == e["i"]
        return F.when(again, state(s["sum"], s["i"], s["x"] + e["x"], s["y"] + e["y"])).otherwise(state(s["sum"] + f(s["x"], s["y"]), e["i"], e["x"], e["y"]))

    start = state(F.lit(0.0), F.lit(-1), F.lit(0.0), F.lit(0.0))
    return _checked(a, b, F.aggregate(_merged(a, b), start, step, lambda s: s["sum"] + f(s["x"], s["y"])))


def inner_product(a: Vec, b: Vec) -> Column:
    return _union(a, b, lambda x, y: x * y)


def l2_squared_distance(a: Vec, b: Vec) -> Column:
    return _union(a, b, lambda x, y: (x - y) * (x - y))


def l2_distance(a: Vec, b: Vec) -> Column:
    return F.sqrt(l2_squared_distance(a, b))


def negative_inner_product(a: Vec, b: Vec) -> Column:
    return -inner_product(a, b)


def l1_distance(a: Vec, b: Vec) -> Column:
    return _union(a, b, lambda x, y: F.abs(x - y))


def norm(v: Vec) -> Column:
    return F.sqrt(_fold(F.transform(_c(v)["values"], lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Vec, b: Vec) -> Column:
    scale = norm(a) * norm(b)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b) / F.nullif(scale, F.lit(0.0))))
    return F.when(scale == 0, F.lit(float("nan"))).otherwise(1 - cosine)


def l2_normalize(v: Vec) -> Column:
    """Entries that become zero are dropped."""
    v, n = _c(v), norm(v)
    entries = F.zip_with(v["indices"], v["values"], lambda i, x: F.struct(i.alias("i"), (x / n).cast("float").alias("x")))
    return F.when(n > 0, _build(v["dim"], entries)).otherwise(v)


def compare(a: Vec, b: Vec) -> Column:
    """The order of the dense vectors: at the first index where they differ, then by dimension."""
    a, b = _c(a), _c(b)
    shared = F.least(a["dim"], b["dim"])

    def first(merged: Column) -> Column:
        at = lambda e, k, c: F.when(F.get(merged, k)["i"] == e["i"], F.get(merged, k)[c]).otherwise(0.0)
        sign = lambda e, k: F.signum(e["x"] + at(e, k - 1, "x") + at(e, k + 1, "x") - e["y"] - at(e, k - 1, "y") - at(e, k + 1, "y"))
        signs = F.transform(merged, lambda e, k: F.when(e["i"] < shared, F.coalesce(sign(e, k), F.lit(0.0))).otherwise(0.0))
        return F.get(F.filter(signs, lambda x: x != 0), F.lit(0)).cast("int")

    return F.coalesce(let(_merged(a, b), first), F.when(a["dim"] < b["dim"], -1).when(a["dim"] > b["dim"], 1).otherwise(0))
