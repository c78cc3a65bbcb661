import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import sparse as S
from quillon.functions import vectors as V


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def vec(*x):
    return F.array(*[F.lit(float(v)).cast("float") for v in x])


def test_distances_and_rules(spark):
    assert one(spark, V.l2_distance(vec(0, 0), vec(3, 4))) == 5
    assert one(spark, V.inner_product(vec(1, 2), vec(3, 4))) == 11 and one(spark, V.negative_inner_product(vec(1, 2), vec(3, 4))) == -11
    assert one(spark, V.cosine_distance(vec(1, 2), vec(2, 4))) == pytest.approx(0) and one(spark, V.cosine_distance(vec(1, 1), vec(-1, -1))) == 2
    assert np.isnan(one(spark, V.cosine_distance(vec(1, 2), vec(0, 0))))
    assert one(spark, V.l1_distance(vec(0, 0), vec(3, 4))) == 7
    assert one(spark, V.l2_distance(vec(1), F.lit(None).cast("array<float>"))) is None
    assert one(spark, V.spherical_distance(vec(1, 0), vec(0, 1))) == 0.5
    with pytest.raises(Exception, match="different vector dimensions 2 and 1"):
        one(spark, V.l2_distance(vec(1, 2), vec(3)))


def test_arithmetic_and_parts(spark):
    assert one(spark, V.add(vec(1, 2, 3), vec(4, 5, 6))) == [5, 7, 9]
    assert one(spark, V.subtract(vec(1, 2), vec(4, 5))) == [-3, -3] and one(spark, V.multiply(vec(1, 2), vec(4, 5))) == [4, 10]
    for bad in (V.add(vec(3e38), vec(3e38)), V.subtract(vec(-3e38), vec(3e38)), V.multiply(vec(1e37), vec(1e37)), V.multiply(vec(1e-37), vec(1e-37))):
        with pytest.raises(Exception, match="out of range"):
            one(spark, bad)
    assert one(spark, V.concat(vec(1), vec(2, 3))) == [1, 2, 3]
    assert one(spark, V.subvector(vec(1, 2, 3, 4, 5), 1, 3)) == [1, 2, 3] and one(spark, V.subvector(vec(1, 2, 3), -1, 3)) == [1] and one(spark, V.subvector(vec(1, 2, 3), 3, 9)) == [3]
    with pytest.raises(Exception, match="at least 1 dimension"):
        one(spark, V.subvector(vec(1, 2, 3), 4, 1))
    assert one(spark, V.l2_normalize(vec(3, 4))) == pytest.approx([0.6, 0.8]) and one(spark, V.l2_normalize(vec(0, 0))) == [0, 0]
    assert [one(spark, V.compare(*p)) for p in ((vec(1, 2), vec(1, 3)), (vec(1, 2), vec(1)), (vec(1), vec(1)))] == [-1, 1, 0]


def test_text(spark):
    assert one(spark, V.parse(F.lit(" [ 1, -2.5 ,3e2] "))) == [1, -2.5, 300] and one(spark, V.parse(F.lit("[1e-46]"))) == [0]
    for bad in ("", "[", "[]", "[1,]", "[,1]", "[1 2]", "1,2", "[NaN]", "[Infinity]", "[a]", "[4e38]", "[1,2]x"):
        with pytest.raises(Exception):
            one(spark, V.parse(F.lit(bad)))
    assert one(spark, V.format_(vec(1, 2.5))) == "[1,2.5]"
    for bad in (V.from_array(F.array(F.lit(1), F.lit(None).cast("int"))), V.from_array(F.array(F.lit(float("nan")))), V.from_array(F.array(F.lit(1e300))), V.from_array(F.array(F.lit(1.0)), 2), V.from_array(F.array().cast("array<int>"))):
        with pytest.raises(Exception):
            one(spark, bad)


def test_half_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=300) * 10.0 ** rng.integers(-9, 4, 300), 0, 65504, -65504, 2.0**-24, 2.0**-25, 1e-8, 2049, 2051]
    got = one(spark, V.to_half(F.array(*[F.lit(float(v)) for v in x])))
    assert np.array_equal(np.array(got), x.astype(np.float16).astype(np.float64))
    with pytest.raises(Exception, match="out of range"):
        one(spark, V.to_half(vec(65520)))


def test_bits(spark):
    b = lambda s: V.bits_from_text(F.lit(s))
    assert one(spark, V.hamming_distance(b("111"), b("110"))) == 1 and one(spark, V.hamming_distance(b("1" * 70), b("0" * 70))) == 70
    assert one(spark, V.jaccard_distance(b("1111"), b("1100"))) == 0.5 and one(spark, V.jaccard_distance(b("1111"), b("0000"))) == 1
    assert one(spark, V.hamming_distance(V.binary_quantize(vec(1, 0, -1)), b("100"))) == 0
    with pytest.raises(Exception, match="different bit lengths"):
        one(spark, V.hamming_distance(b("1"), b("11")))


def test_sparse_equals_dense(spark):
    rng = np.random.default_rng(3)
    pairs = [[np.where(rng.random(5) < 0.5, 0, rng.integers(-3, 4, 5)).astype(float).tolist() for _ in range(2)] for _ in range(40)]
    df = spark.createDataFrame(pairs, "a array<float>, b array<float>").select("a", "b", S.from_dense("a").alias("s"), S.from_dense("b").alias("t"))
    names = ("l2_distance", "inner_product", "l1_distance", "negative_inner_product", "l2_squared_distance", "cosine_distance", "compare")
    out = df.select(*[getattr(S, n)("s", "t").alias(n) for n in names], *[getattr(V, n)("a", "b").alias(f"d_{n}") for n in names], (S.to_dense("s") == F.col("a")).alias("back"), (S.parse(S.format_("s")) == F.col("s")).alias("text"))
    for r in out.collect():
        assert r.back and r.text
        for n in names:
            assert r[n] == pytest.approx(r[f"d_{n}"], nan_ok=True), n


def test_sparse_rules(spark):
    s = lambda t: S.parse(F.lit(t))
    r = one(spark, s("{3:2, 1:1.5,2:0}/5"))
    assert (r.dim, r.indices, r["values"]) == (5, [0, 2], [1.5, 2.0])
    for bad in ("{1:1,1:2}/3", "{0:1}/3", "{4:1}/3", "{1:1}", "{}/0", "1:1/2", "{a:1}/2"):
        with pytest.raises(Exception):
            one(spark, s(bad))
    assert one(spark, S.l2_distance(s("{}/3"), s("{1:3,3:4}/3"))) == 5
    with pytest.raises(Exception, match="different sparsevec dimensions"):
        one(spark, S.l2_distance(s("{}/3"), s("{}/4")))
    assert one(spark, S.norm(S.l2_normalize(s("{1:3,2:4}/2")))) == pytest.approx(1)


def test_aggregates(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 5.0]), (1, None), (2, None)], "g int, v array<float>")
    out = {r.g: (r.s, r.a) for r in df.groupBy("g").agg(V.vector_sum("v", 2).alias("s"), V.vector_avg("v", 2).alias("a")).collect()}
    assert out == {1: ([4, 7], [2, 3.5]), 2: (None, None)}
