import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import fulltext, knn
from quillon.operators.fulltext import TextIndex

DOCS = [(1, "The cat sat. The CAT ran"), (2, "a dog ran"), (3, None), (4, ""), (5, "cat cat cat"), (6, "été 3 dogs"), (7, "the " * 50), (None, "cat without a key"), (5, "more of five")]
DOCS += [(100 + i, "the same line of copies") for i in range(40)]


def plain(docs, query, k):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    by = {}
    for i, t in docs:
        if i is not None:
            by.setdefault(i, []).extend(split(t))
    n, mean = len(by), sum(map(len, by.values())) / len(by)
    df = Counter(w for ws in by.values() for w in set(ws))
    score = {}
    for i, ws in by.items():
        tf = Counter(ws)
        for t in set(split(query)) & set(ws):
            score[i] = score.get(i, 0) + math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
    return sorted(((i, round(s, 9)) for i, s in score.items()), key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, term string").repartition(3)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(fulltext, "FOLDER_ROWS", 20)
        made = TextIndex.build(docs, str(tmp_path_factory.mktemp("text")), part=10)
    assert made.folders > 5
    return made


def test_scores_equal_plain_ones(spark, index):
    asked = [(0, "the cat"), (1, "dogs, ÉTÉ été"), (2, "nothing here"), (3, ""), (4, None), (5, "same the the copies")]
    got = {}
    for r in index.search_batch(spark.createDataFrame(asked, "query_id long, text string"), 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    for q, text in asked:
        want = plain(DOCS, text or "", 7)
        assert [(d, pytest.approx(s, abs=2e-9)) for _, d, s in sorted(got.get(q, []))] == want, text
        assert [(r.doc_id, pytest.approx(r.score, abs=2e-9)) for r in index.search(text or "", 7).collect()] == want


def test_frequent_terms_are_dealt(index):
    parts = index.postings.where("term = 'the'").groupBy("part").count().collect()
    assert len(parts) == 5 and index.terms.where("term = 'the'").first()["parts"] == 5 and index.terms.where("term = 'dog'").first()["parts"] == 1


def test_a_search_reads_its_terms_only(index):
    plan = index.search("the cat", 5)._jdf.queryExecution().explainString(index.postings.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = next(p for p in plan.split("\n\n") if "Scan parquet" in p and "tf" in p)
    assert re.search(r"PartitionFilters: \[.*folder#\d+ (IN|INSET|=)", scan) and re.search(r"PushedFilters: \[.*In\(term", scan)


def test_batch_reads_the_folders_of_its_terms(spark, index):
    plan = index.search_batch(spark.createDataFrame([(1, "cat")], "query_id long, text string").where("query_id > 0"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan or "folder" in plan


def test_empty_index(spark, tmp_path):
    empty = TextIndex.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"))
    assert empty.search("the", 3).count() == 0 and empty.search_batch(spark.createDataFrame([(1, "the")], "query_id long, text string"), 3).count() == 0


def test_hybrid(spark, index):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (200, [0.0, 1.0]), (201, None)], "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, "dog", [1.0, 0.0]), (2, "cat", None)], "query_id long, text string, embedding array<float>")
    out = {(r.query_id, r.doc_id): r.score for r in fulltext.hybrid_search(index, vectors, asked, 10).collect()}
    one = lambda *ranks: pytest.approx(sum(1 / (60 + r) for r in ranks), abs=1e-8)
    assert {d: s for (q, d), s in out.items() if q == 1} == {2: one(1, 2), 1: one(1), 200: one(3)}
    assert {d for q, d in out if q == 2} == {1, 5}


def test_cells_of_many_blocks_equal_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 6)).round(1).astype(np.float32)  # with ties
    rows = spark.createDataFrame([(i, v.tolist(), None if i % 7 == 0 else f"g{i % 3}") for i, v in enumerate(x)] + [(900, None, "g0")], "vec_id long, embedding array<float>, g string")
    def whole(**more):
        out = knn.nearest_batch(rows, rows.where("vec_id % 5 = 0"), 4, "l2", **more)
        return sorted(map(str, out.collect()))
    want = whole(), whole(groups="g"), whole(skip_self=False)
    monkeypatch.setattr(knn, "CELL_NUMBERS", 300)
    monkeypatch.setattr(knn, "QUERIES", 17)
    monkeypatch.setattr(knn, "SLICE", 9)
    assert (whole(), whole(groups="g"), whole(skip_self=False)) == want and len(want[1]) == 100 * 4 * 4
    q, d = x[::5], x
    exact = np.sqrt(((q[:, None].astype(float) - d[None]) ** 2).sum(2)).round(9)
    best = {i * 5: [int(j) for j in np.lexsort((np.arange(500), exact[i])) if j != i * 5][:4] for i in range(100)}
    out = knn.nearest_batch(rows, rows.where("vec_id % 5 = 0"), 4, "l2").collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == best


def test_plan_does_not_grow_with_queries(spark):
    vectors = lambda n: spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") * k % 97).cast("float") for k in (1, 3)]).alias("embedding"))
    sizes = [len(knn.nearest_batch(vectors(2000), vectors(n), 2, "l2")._jdf.queryExecution().optimizedPlan().toString()) for n in (10, 100_000)]
    assert abs(sizes[0] - sizes[1]) < 400
    assert knn.nearest_batch(vectors(2000), vectors(100_000), 1, "l2").count() == 100_000
