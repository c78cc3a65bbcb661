"""Dense vectors as arrays: distances, arithmetic, order, parsing, casts, half precision and bits, all as Column expressions.

Every function gives NULL for a NULL argument. Sums run in double. Half-precision vectors are arrays of floats that were
rounded by to_half(); bit vectors are structs of a length and packed 64-bit words, first bit highest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DIMS = 16_000
HALF_MAX = 65_504.0
Vec = Column | str


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: a function's variable, not a copy of its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _c(v: Vec) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def same_dims(a: Vec, b: Vec, result: Column) -> Column:
    """`result`, or an error if the vectors' lengths differ."""
    a, b = _c(a), _c(b)
    message = F.concat(F.lit("different vector dimensions "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) != F.size(b), F.raise_error(message).cast("double")).otherwise(result)


def _pairs(a: Vec, b: Vec, f) -> Column:
    return _fold(F.zip_with(_c(a), _c(b), lambda x, y: f(x.cast("double"), y.cast("double"))))


def dims(v: Vec) -> Column:
    return F.when(_c(v).isNotNull(), F.size(_c(v)))


def inner_product(a: Vec, b: Vec) -> Column:
    return same_dims(a, b, _pairs(a, b, lambda x, y: x * y))


def negative_inner_product(a: Vec, b: Vec) -> Column:
    return -inner_product(a, b)


def l2_squared_distance(a: Vec, b: Vec) -> Column:
    return same_dims(a, b, _pairs(a, b, lambda x, y: (x - y) * (x - y)))


def l2_distance(a: Vec, b: Vec) -> Column:
    return F.sqrt(l2_squared_distance(a, b))


def l1_distance(a: Vec, b: Vec) -> Column:
    return same_dims(a, b, _pairs(a, b, lambda x, y: F.abs(x - y)))


def norm(v: Vec) -> Column:
    return F.sqrt(_fold(F.transform(_c(v), lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Vec, b: Vec) -> Column:
    """1 - cosine, clamped; NaN where a vector is zero."""
    square = lambda v: _fold(F.transform(_c(v), lambda x: x.cast("double") * x.cast("double")))
    scale = F.sqrt(square(a) * square(b))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _pairs(a, b, lambda x, y: x * y) / F.nullif(scale, F.lit(0.0))))
    return same_dims(a, b, F.when(scale == 0, F.lit(float("nan"))).otherwise(1 - cosine))


def spherical_distance(a: Vec, b: Vec) -> Column:
    """The angle between unit vectors over pi."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b)))) / F.lit(3.141592653589793)


DISTANCES = {"l2": l2_distance, "ip": negative_inner_product, "cosine": cosine_distance, "l1": l1_distance}


def l2_normalize(v: Vec) -> Column:
    """A zero vector stays as it is."""
    return let(_c(v), lambda w: let(norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: (x / n).cast("float"))).otherwise(w)))


def _finite(v: Column, what: str) -> Column:
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(bad, F.raise_error(F.lit(f"value out of range: {what}")).cast("array<float>")).otherwise(v)


def _elementwise(a: Vec, b: Vec, f) -> Column:
    made = F.zip_with(_c(a), _c(b), lambda x, y: f(x.cast("double"), y.cast("double")).cast("float"))
    return _finite(F.when(F.size(_c(a)) == F.size(_c(b)), made).when(_c(a).isNotNull() & _c(b).isNotNull(), F.raise_error(F.lit("different vector dimensions")).cast("array<float>")), "overflow")


def add(a: Vec, b: Vec) -> Column:
    return _elementwise(a, b, lambda x, y: x + y)


def subtract(a: Vec, b: Vec) -> Column:
    return _elementwise(a, b, lambda x, y: x - y)


def multiply(a: Vec, b: Vec) -> Column:
    """Products that vanish although neither factor is zero are an error, as overflow is."""
    lost = F.exists(F.arrays_zip(_c(a).alias("x"), _c(b).alias("y")), lambda p: (p["x"] != 0) & (p["y"] != 0) & ((p["x"].cast("double") * p["y"].cast("double")).cast("float") == 0))
    return F.when(lost, F.raise_error(F.lit("value out of range: underflow")).cast("array<float>")).otherwise(_elementwise(a, b, lambda x, y: x * y))


def concat(a: Vec, b: Vec) -> Column:
    both = F.concat(_c(a), _c(b))
    return F.when(F.size(both) > MAX_DIMS, F.raise_error(F.lit(f"vector cannot have more than {MAX_DIMS} dimensions")).cast("array<float>")).otherwise(both)


def subvector(v: Vec, start: int, count: int) -> Column:
    """`count` elements from 1-based `start`, as far as they exist; none is an error."""
    low = max(start, 1)
    n = F.least(F.lit(start + count), F.size(_c(v)) + 1) - low
    return F.when(_c(v).isNull(), F.lit(None)).when(n < 1, F.raise_error(F.lit("vector must have at least 1 dimension")).cast("array<float>")).otherwise(F.slice(_c(v), F.lit(low), F.greatest(n, F.lit(0))))


def compare(a: Vec, b: Vec) -> Column:
    """-1, 0 or 1: elementwise, a prefix before what it begins."""
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a < b, -1).when(a > b, 1).otherwise(0))


# Text and casts.

def parse(text: Vec) -> Column:
    """'[1,2,3]' (white space allowed) to a vector; malformed text, NaN, infinity and values beyond float are errors."""
    number = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    t = _c(text)
    ok = t.rlike(rf"^\s*\[\s*{number}\s*(?:,\s*{number}\s*)*\]\s*$")
    inner = F.regexp_replace(t, r"[\s\[\]]", "")
    made = F.transform(F.split(inner, ","), lambda x: x.cast("double").cast("float"))
    return F.when(ok, check_dims(_finite(made, "type vector"))).when(t.isNotNull(), F.raise_error(F.concat(F.lit("invalid input syntax for type vector: "), t)).cast("array<float>"))


def format_(v: Vec) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(_c(v), lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ","), F.lit("]"))


def check_dims(v: Vec, n: int | None = None) -> Column:
    """The vector, or an error if it has not n dimensions (or none, or more than MAX_DIMS)."""
    v = _c(v)
    bad = (F.size(v) < 1) | (F.size(v) > MAX_DIMS) if n is None else F.size(v) != n
    return F.when(bad, F.raise_error(F.lit("wrong number of dimensions") if n is None else F.concat(F.lit(f"expected {n} dimensions, not "), F.size(v).cast("string"))).cast("array<float>")).otherwise(v)


def from_array(v: Vec, n: int | None = None) -> Column:
    """An array of numbers to a vector: NULL elements, NaN and infinity are errors."""
    v = _c(v)
    null = F.exists(v, lambda x: x.isNull())
    made = F.transform(v, lambda x: x.cast("float"))
    return F.when(null, F.raise_error(F.lit("array must not contain nulls")).cast("array<float>")).otherwise(check_dims(_finite(made, "type vector"), n))


def to_array(v: Vec) -> Column:
    return _c(v).cast("array<float>")


def round_half(x: Column) -> Column:
    """A number rounded to the nearest half-precision value, ties to even: 11 significant bits, multiples of 2^-24 at least."""
    d = x.cast("double")
    wide = d * F.lit(2.0**42 + 1)  # what is left of 53 bits after the difference are the first 11, rounded
    return F.when(F.abs(d) < F.lit(2.0**-14), F.rint(d * F.lit(2.0**24)) * F.lit(2.0**-24)).otherwise(wide - (wide - d)).cast("float")


def to_half(v: Vec) -> Column:
    """Rounded to half precision; values that would be infinite are an error, tiny ones become zero."""
    made = F.transform(_c(v), round_half)
    big = F.exists(made, lambda x: F.abs(x) > HALF_MAX)
    return F.when(big, F.raise_error(F.lit("value out of range for type halfvec")).cast("array<float>")).otherwise(made)


# Bits.

def bits_from_text(text: Vec) -> Column:
    """'0101' to a bit vector."""
    return _pack(F.transform(F.split(_c(text), ""), lambda b: b == "1"))


def binary_quantize(v: Vec) -> Column:
    """A bit for each element: whether it is positive."""
    return _pack(F.transform(_c(v), lambda x: x > 0))


def _pack(flags: Column) -> Column:
    """Words of 64 flags, the first one in the highest bit, the last word filled up with zeros; NULL flags are 0."""
    n = F.size(flags)
    digits = F.array_join(F.transform(flags, lambda x: F.when(x, "1").otherwise("0")), "")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(n / 64).cast("int") - 1, F.lit(0)))
    words = F.transform(starts, lambda at: F.conv(F.rpad(F.substr(digits, at * 64 + 1, F.lit(64)), 64, "0"), 2, -10).cast("long"))
    return F.when(flags.isNotNull(), F.struct(n.alias("len"), words.alias("words")))


def _bits(a: Vec, b: Vec, f) -> Column:
    a, b = _c(a), _c(b)
    made = F.aggregate(F.zip_with(a["words"], b["words"], lambda x, y: F.bit_count(f(x, y))), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNotNull() & b.isNotNull() & (a["len"] != b["len"]), F.raise_error(F.lit("different bit lengths")).cast("int")).otherwise(made)


def hamming_distance(a: Vec, b: Vec) -> Column:
    return _bits(a, b, lambda x, y: x.bitwiseXOR(y)).cast("double")


def jaccard_distance(a: Vec, b: Vec) -> Column:
    """1 where no bit is common."""
    both, either = _bits(a, b, lambda x, y: x.bitwiseAND(y)), _bits(a, b, lambda x, y: x.bitwiseOR(y))
    return F.when(both == 0, F.lit(1.0)).otherwise(1 - both / F.nullif(either, F.lit(0)))


# Aggregates: an array of one sum for each dimension, which aggregates in part before the shuffle.

def vector_sum(v: str, n: int) -> Column:
    return F.when(F.count(v) > 0, _finite(F.array(*[F.sum(F.col(v)[i].cast("double")).cast("float") for i in range(n)]), "overflow"))


def vector_avg(v: str, n: int) -> Column:
    return F.when(F.count(v) > 0, F.array(*[F.avg(F.col(v)[i].cast("double")).cast("float") for i in range(n)]))
