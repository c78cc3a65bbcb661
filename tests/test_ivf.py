import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators import kmeans, knn
from quillon.operators.ivf import IvfConfig, IvfIndex


@pytest.fixture(scope="module")
def clusters(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(40, 6)) * 8
    x = np.concatenate([middle[rng.integers(40, size=4000)] + rng.normal(size=(4000, 6)), np.tile(middle[:1], (1500, 1))]).astype(np.float32)
    path = str(tmp_path_factory.mktemp("points") / "p")
    spark.createDataFrame([(i, v.tolist(), int(i % 5)) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(6).write.parquet(path)
    return spark.read.parquet(path), x


def cost(x, centres, space):
    return kmeans.nearest(x, centres, space)[1].mean()


def test_centres_from_executors_are_as_good_as_local_ones(clusters):
    df, x = clusters
    space = kmeans.Dense()
    local, spread = kmeans.fit_local(x.astype(float), 40, space), kmeans.fit_spread(df, "embedding", 40, space)
    assert len(spread) == 40 and cost(x, spread, space) < 1.6 * cost(x, local, space)
    unit = kmeans.fit_spread(df, "embedding", 10, kmeans.Dense(True))
    assert np.allclose(np.linalg.norm(unit, axis=1), 1)


def test_bit_centres_are_majorities(spark):
    rng = np.random.default_rng(2)
    groups = rng.integers(0, 2, size=(6, 100))
    bits = groups[rng.integers(6, size=900)] ^ (rng.random((900, 100)) < 0.08)
    df = spark.createDataFrame([(i, "".join(map(str, b))) for i, b in enumerate(bits)], "vec_id long, t string").select("vec_id", V.bits_from_text("t").alias("embedding"))
    space = kmeans.Bits()
    x = space.matrix(df.toArrow()["embedding"])
    assert (space.numbers(x)[:, :100] == bits).all() and not space.numbers(x)[:, 100:].any()
    for centres in (kmeans.fit_local(x, 6, space), kmeans.fit_spread(df, "embedding", 6, space)):
        assert cost(x, centres, space) < 14
        at, d = kmeans.nearest(x, centres, space)
        for c in np.unique(at):
            assert (space.numbers(space.centre(space.numbers(x)[at == c].sum(0, dtype=float)[None], np.array([(at == c).sum()])))[0, :100] == (bits[at == c].sum(0) * 2 > (at == c).sum())).all()
        assert (d == (space.numbers(x) != space.numbers(centres)[at]).sum(1)).all()


def test_a_fit_of_many_lists(spark, monkeypatch):
    """4,096 centres of a table that never comes to the driver; the largest product has CELLS numbers."""
    df = spark.range(40_000).select(F.array(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).cast("float") for i in range(8)]).alias("v"))
    monkeypatch.setattr(kmeans, "LOCAL", 1000)
    monkeypatch.setattr(kmeans, "SEED_ROUNDS", 2)
    monkeypatch.setattr(kmeans, "ROUNDS", 2)
    centres = kmeans.fit(df, "v", 4096, kmeans.Dense())
    assert 3000 < len(centres) <= 4096
    x = np.stack(df.toPandas()["v"])[:4000].astype(float)
    assert cost(x, centres, kmeans.Dense()) < 0.6 * cost(x, x[:4096:10], kmeans.Dense())
    step = kmeans.Dense().step(centres)
    assert step * len(centres) <= kmeans.CELLS


def test_filtered_search_probes_on(clusters, tmp_path):
    df, x = clusters
    index = IvfIndex.build(df, f"{tmp_path}/i", IvfConfig(lists=20), part_rows=300)
    assert index.parts.max() > 1 and index.rows().where("part > 0").count() > 0
    q = df.where("vec_id % 400 = 0")
    rare = (F.col("vec_id") % 97 == 5)
    exact = knn.nearest_batch(df.where(rare), q, 8, "l2")
    whole = index.search_batch(q, 8, 20, where=rare)
    assert knn.recall(whole, exact).agg(F.min("recall")).first()[0] == 1
    found = index.search_batch(q, 8, where=rare, iterative=True)
    assert {r["count"] for r in found.groupBy("query_id").count().collect()} == {8} and found.count() == exact.count()
    none = index.search_batch(q, 8, where=F.col("vec_id") < 0, iterative=True)
    assert none.count() == 0
    few = IvfIndex.build(df, f"{tmp_path}/m", IvfConfig(lists=20, max_probes=3))
    assert few.search_batch(q, 8, where=rare, iterative=True).count() < 8 * q.count()
    plain = index.search_batch(q, 8, 20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in plain) == sorted((r.query_id, r["rank"], r.vec_id) for r in knn.nearest_batch(df, q, 8, "l2").collect())


def test_partitions_are_pruned(clusters, tmp_path):
    df, x = clusters
    index = IvfIndex.build(df, f"{tmp_path}/i", IvfConfig(lists=10, probes=10), partition="label")
    q = df.where("vec_id in (3, 8, 13)")  # all of label 3
    found = index.search_batch(q, 5, by="label")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    want = knn.nearest_batch(df.where("label = 3"), q, 5, "l2")
    assert sorted(map(str, found.select("query_id", "vec_id").collect())) == sorted(map(str, want.select("query_id", "vec_id").collect()))
    one = index.search(x[3].tolist(), 4, where=F.col("label") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in one and "label#" in one.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError):
        index.search_batch(q, 5, by="vec_id")
    part = IvfIndex.build(df, f"{tmp_path}/p", IvfConfig(lists=5, probes=5), where=F.col("label") == 1)
    assert {r.label for r in part.rows().select("label").distinct().collect()} == {1}


def test_bits_stay_packed(spark, tmp_path):
    rng = np.random.default_rng(7)
    bits = rng.integers(0, 2, size=(500, 52))
    df = spark.createDataFrame([(i, "".join(map(str, b))) for i, b in enumerate(bits)] + [(900, None)], "vec_id long, t string").select("vec_id", V.bits_from_text("t").alias("embedding"))
    index = IvfIndex.build(df, f"{tmp_path}/b", IvfConfig(lists=12, probes=12, metric="hamming", kind="bit"))
    assert dict(index.rows().dtypes)["embedding"] == "struct<len:int,words:array<bigint>>" and index.rows().count() == 500
    found = index.search_batch(df.where("vec_id % 100 = 0"), 6).collect()
    for r in found:
        assert r.distance == (bits[r.query_id] != bits[r.vec_id]).sum()
    for i in range(0, 500, 100):
        d = (bits != bits[i]).sum(1)
        want = [int(j) for j in np.lexsort((np.arange(500), d)) if j != i][:6]
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == i] == want
        single = index.search("".join(map(str, bits[i])), 7)
        assert [r.vec_id for r in single.collect()][1:] == want or d[want[0]] == 0


def test_relaxed_then_strict(clusters, tmp_path):
    df, x = clusters
    index = IvfIndex.build(df, f"{tmp_path}/i", IvfConfig(lists=20))
    q, rare = df.where("vec_id % 500 = 0"), (F.col("vec_id") % 97 == 5)
    relaxed = index.search_batch(q, 8, where=rare, iterative=True, relaxed=True)
    strict = knn.strict_order(relaxed)
    by = lambda found: {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in found.collect()}
    a, b = by(relaxed), by(strict)
    assert {(i, v) for (i, _), v in a.items()} == {(i, v) for (i, _), v in b.items()} and a != b
    assert all(b[i, k][1] <= b[i, k + 1][1] for i, k in b if (i, k + 1) in b)
    assert not all(a[i, k][1] <= a[i, k + 1][1] for i, k in a if (i, k + 1) in a)


@pytest.mark.parametrize("dims", [3, 10, 20, None])
def test_bars_lose_nothing_and_spare_pairs(monkeypatch, dims):
    """The k nearest by bars are those of a scan, ties by key included, and few pairs are compared where boxes tell pieces apart."""
    rng = np.random.default_rng(8)
    n = 20_000
    x = rng.random((n, dims)).astype(np.float32).astype(float) if dims else rng.integers(0, 1 << 52, (n, 1)).astype(np.uint64)
    x[::9] = x[0]
    keys = rng.permutation(n) * 3
    ids = np.sort(keys[:60])
    at = {int(k): i for i, k in enumerate(keys)}
    q, asked, within = np.stack([x[at[int(i)]] for i in ids]), [], knn._within
    monkeypatch.setattr(knn, "_within", lambda q, x, *more: (asked.append(len(q) * len(x)), within(q, x, *more))[1])
    for skip in (True, False):
        i, j, d = knn._by_bars(q, ids, x, keys, 9, skip)
        for a in range(len(q)):
            whole = knn.distances(q[a : a + 1], x, "l2" if dims else "hamming")[0].round(9)
            want = [int(t) for t in np.lexsort((keys, whole)) if not (skip and keys[t] == ids[a])][:9]
            assert j[i == a].tolist() == want and d[i == a].tolist() == whole[want].tolist()
    if dims == 3:
        assert sum(asked) < 2 * len(q) * n / 3


def test_halves_are_rounded_to_even(spark):
    whole = np.arange(1 << 16).astype(np.uint16).view(np.float16).astype(np.float32)
    whole = whole[np.isfinite(whole)]
    between = ((whole[:-1].astype(float) + whole[1:]) / 2).astype(np.float32)
    x = np.concatenate([whole, between, np.nextafter(between, np.float32(1e9)), np.nextafter(between, np.float32(-1e9))])
    x = x[np.abs(x) < 65504]
    got = spark.createDataFrame([(x.tolist(),)], "v array<float>").select(V.to_half("v")).first()[0]
    assert (np.array(got, np.float32) == x.astype(np.float16).astype(np.float32)).all()


def test_probing_on_does_not_stop_at_the_first_list_that_has_enough(clusters, tmp_path):
    """A filter that many rows pass: one list has k of them, but not the nearest."""
    df, x = clusters
    rng = np.random.default_rng(9)
    spread = df.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 24)))], "vec_id long, embedding array<float>")
    index = IvfIndex.build(spread, f"{tmp_path}/i", IvfConfig(lists=16))
    q, half = spread.where("vec_id % 100 = 0"), F.col("vec_id") % 2 == 1
    exact = knn.nearest_batch(spread.where(half), q, 10, "l2")
    assert knn.recall(index.search_batch(q, 10, where=half, iterative=True), exact).agg(F.avg("recall")).first()[0] > 0.9
