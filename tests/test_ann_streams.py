import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import knn
from quillon.operators.ann import HnswConfig, HnswIndex
from quillon.operators.ivf import IvfConfig, IvfIndex
from quillon.sources import tables
from quillon.streaming.rates import stage_stream, windowed_over_rate


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 8)).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 8, 1)], "vec_id long, embedding array<float>, label int").cache()


def test_batch_equals_single(points):
    q = points.where("vec_id % 100 = 0 and embedding is not null")
    for metric in ("l2", "ip", "cosine", "l1"):
        got = {(r.query_id, r["rank"]): r.vec_id for r in knn.nearest_batch(points, q, 5, metric).collect()}
        for r in q.where("vec_id in (0, 300)").collect():
            want = [s.vec_id for s in knn.nearest(points.where(F.col("vec_id") != r.vec_id), r.embedding, 5, metric).collect()]
            assert [got[r.vec_id, k] for k in range(1, 6)] == want


def test_zero_vectors_come_last_and_lose_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (4, [0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    out = knn.nearest_batch(df, df.where("vec_id = 1"), 10, "cosine").orderBy("rank").collect()
    assert [r.vec_id for r in out] == [3, 2, 4, 4] and all(np.isnan(r.distance) for r in out[1:])
    assert [r.vec_id for r in knn.nearest_batch(df, df.where("vec_id = 4"), 2, "cosine").orderBy("query_id", "rank").collect()] == [1, 2]  # all are NaN: by key


def test_l2_of_long_vectors_close_to_each_other():
    rng = np.random.default_rng(5)
    x = (8e6 + rng.normal(size=(500, 16)) * 0.01)
    q = x[:20] + 0.001
    none = np.zeros((20, 500), bool)
    i, j, d = knn.best(q, x, "l2", 7, none)
    exact = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2)).round(9)
    for k in range(20):
        want = np.lexsort((np.arange(500), exact[k]))[:7]
        assert (j[i == k] == want).all() and np.allclose(d[i == k], exact[k][want], atol=1e-9, rtol=0)
    for metric in ("l1", "ip", "cosine"):
        whole = knn.distances(q, x, metric).round(9)
        i, j, d = knn.best(q, x, metric, 7, none)
        assert all((j[i == k] == np.lexsort((np.arange(500), whole[k]))[:7]).all() for k in range(20))


def test_blocks_of_l1_are_bounded(monkeypatch):
    monkeypatch.setattr(knn, "CELLS", 64)
    rng = np.random.default_rng(6)
    q, x = rng.normal(size=(9, 5)), rng.normal(size=(30, 5))
    assert np.allclose(knn.distances(q, x, "l1"), np.abs(q[:, None] - x[None]).sum(2)) and np.allclose(knn.distances(q, x, "l2"), np.sqrt(((q[:, None] - x[None]) ** 2).sum(2)))


def test_ivf(spark, points, tmp_path):
    q = points.where("vec_id % 50 = 0 and vec_id < 800")
    index = IvfIndex.build(points, f"{tmp_path}/a", IvfConfig(lists=10, probes=5, metric="l2"))
    assert not spark.read.parquet(index.path).where("vec_id = 900").count()
    exact = knn.nearest_batch(points, q, 10, "l2")
    some, whole = (knn.recall(index.search_batch(q, 10, p), exact).agg(F.avg("recall")).first()[0] for p in (5, 10))
    assert some > 0.85 and whole == 1
    first = points.where("vec_id = 0").first().embedding
    plan = index.search(first, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_id" in plan
    assert index.search(first, 20, 1, F.col("label") == 2, iterative=True).count() == 20
    index.insert(spark.createDataFrame([(1000, first, 0)], "vec_id long, embedding array<float>, label int"))
    assert {r.vec_id for r in index.search(first, 2).collect()} == {0, 1000}
    index.delete(spark.createDataFrame([(1000,)], "vec_id long"), f"{tmp_path}/b")
    assert 1000 not in {r.vec_id for r in index.search(first, 2).collect()}
    with pytest.raises(ValueError):
        IvfConfig(lists=0)


def test_hnsw(spark, points, tmp_path):
    q = points.where("vec_id % 50 = 0 and vec_id < 800")
    for metric in ("l2", "cosine", "l1"):
        index = HnswIndex.build(points, f"{tmp_path}/{metric}", HnswConfig(metric=metric), shards=2)
        exact = knn.nearest_batch(points, q, 10, metric)
        assert knn.recall(index.search_batch(q, 10), exact).agg(F.avg("recall")).first()[0] > 0.97
    gone = points.where("vec_id % 2 = 1").select("vec_id")
    out = index.search_batch(q, 10, deleted=gone)
    assert out.count() == 160 and not out.where("vec_id % 2 = 1").count()
    with pytest.raises(ValueError):
        HnswConfig(m=40)


def test_recall_does_not_fall_as_shards_grow(spark, tmp_path):
    rng = np.random.default_rng(4)
    wide = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 48)))], "vec_id long, embedding array<float>")
    index = HnswIndex.build(wide, f"{tmp_path}/w", HnswConfig(ef_search=10), shards=1)
    q = wide.where("vec_id % 50 = 0")
    assert knn.recall(index.search_batch(q, 20), knn.nearest_batch(wide, q, 20, "l2")).agg(F.avg("recall")).first()[0] > 0.98


def test_equal_vectors_are_all_found(spark, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 1.0, 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    index = HnswIndex.build(same, f"{tmp_path}/h", HnswConfig(ef_search=1), shards=1)
    assert index.search_batch(same.where("vec_id = 0"), 10).count() == 10


def test_tables(spark, points, tmp_path):
    tables.write_vectors(points, f"{tmp_path}/v", ["label"])
    assert spark.read.parquet(f"{tmp_path}/v").select("vec_id", "embedding").exceptAll(points.select("vec_id", "embedding")).count() == 0
    (tmp_path / "m.json").write_text(json.dumps({"A": {"document_type": {"value": "act", "verified": True}, "pages": 3}}))
    assert {(r.act_code, r.field, r.value, r.verified) for r in tables.read_manifest(spark, f"file://{tmp_path}/m.json").collect()} == {("A", "document_type", "act", True), ("A", "pages", "3", False)}
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, tables.seed(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]
    assert tables.delete_where(old, F.col("k") == 1).count() == 0 and tables.first_non_empty(old.limit(0), new).count() == 2


def test_scratch_paths_are_released(spark):
    path = tables.scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    tables.release_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path)
    tables.release_scratch(spark)


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 10:00:01"), (1, "2024-01-01 10:20:00"), (1, "2024-01-01 11:20:00"), (2, "2024-01-02 10:00:00")], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e.write.parquet(f"{tmp_path}/e")
    live = windowed_over_rate(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e"), "user_id", most=1)
    run = live.writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [(r.user_id, r.n) for r in spark.sql("select * from rates").collect()] == [(1, 2)] == [(r.user_id, r.n) for r in windowed_over_rate(e, "user_id", most=1).collect()]
    current = spark.createDataFrame([("A", "1", "old", None)], "act_code string, section_number string, section_text string, valid_to date")
    spark.createDataFrame([("A", "1", "new"), ("A", "2", "x")], "act_code string, section_number string, section_text string").write.parquet(f"{tmp_path}/f")
    fetched = spark.readStream.schema("act_code string, section_number string, section_text string").parquet(f"{tmp_path}/f")
    stage_stream(fetched, lambda: current, f"{tmp_path}/q", f"{tmp_path}/c2").awaitTermination(120)
    assert sorted(r.summary for r in spark.read.parquet(f"{tmp_path}/q").collect()) == ["3 -> 3 chars", "new section, 1 chars"]


def test_half_bit_and_sparse_indexes(spark, tmp_path):
    from quillon.functions import sparse as S
    from quillon.functions import vectors as V
    from quillon.operators.ann import prepared

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 52)).astype(np.float32)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    made = {"half": V.to_half("embedding"), "bit": V.binary_quantize("embedding"), "sparse": S.from_dense(F.transform("embedding", lambda y: F.when(F.abs(y) < 0.8, F.lit(0.0).cast("float")).otherwise(y)))}
    for kind, metric, floor in (("half", "l2", 0.98), ("bit", "hamming", 0.98), ("bit", "jaccard", 0.95), ("sparse", "l2", 0.98)):
        df = base.withColumn("embedding", made[kind])
        plain = prepared(df, "embedding", kind)
        exact = knn.nearest_batch(plain, plain.where("vec_id % 40 = 0"), 10, metric)
        index = HnswIndex.build(df.where("vec_id < 300"), f"{tmp_path}/{kind}{metric}", HnswConfig(metric=metric, kind=kind), shards=2)
        index.insert(df.where("vec_id >= 300"), f"{tmp_path}/{kind}{metric}2")
        got = index.search_batch(df.where("vec_id % 40 = 0"), 10)
        assert knn.tied_recall(got, exact).agg(F.avg("recall")).first()[0] >= floor, (kind, metric)
    bits = prepared(base.withColumn("embedding", made["bit"]), "embedding", "bit").orderBy("vec_id").limit(5).collect()
    assert [r.embedding for r in bits] == [[float(y > 0) for y in v.tolist()] for v in x[:5]]
    with pytest.raises(ValueError):
        IvfConfig(kind="bit", metric="jaccard")
    with pytest.raises(ValueError):
        IvfConfig(kind="sparse", metric="l2")
    wide = spark.createDataFrame([(1, [0.5] * 2001)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="2000 dimensions"):
        prepared(wide, "embedding", "vector").collect()
    assert prepared(wide, "embedding", "half").count() == 1
    ivf = IvfIndex.build(base, f"{tmp_path}/null", IvfConfig(lists=4))
    assert [r.distance for r in ivf.search(None, 3).collect()] == [None] * 3


def test_complaint_and_listings(spark):
    from quillon.operators import listings as L

    dates = {"on 3/12/2024 and 4/1/2024": "2024-03-12", "on 2024-02-30": None, "12-March-2024": "2024-03-12", "Mar 5, 2023.": "2023-03-05", "none": None, "": None}
    out = {r.t: r.d for r in spark.createDataFrame([(k,) for k in dates], "t string").select("t", L.first_date("t").alias("d")).collect()}
    assert out == dates
    s = spark.createDataFrame([("IPC", "12A", "a_b", None), ("ipc", "2", "axb", None), ("BNS", "2", None, "x")], "act_code string, section_number string, marginal_note string, valid_to string").selectExpr("*", "'t' as section_text", "cast(null as string) as category")
    assert [r.section_number for r in L.browse(s, "Ipc", "A_B").collect()] == ["12A"] and L.act_like(s, "i_c").count() == 2
    cited = spark.createDataFrame([("bns", "2"), ("ipc", "12"), (None, None)], "act string, number string")
    assert sorted((str(r.act), r.found) for r in L.check_citations(cited, s).collect()) == [("None", False), ("bns", True), ("ipc", False)]
