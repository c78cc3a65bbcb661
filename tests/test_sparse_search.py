import numpy as np
import pytest

from quillon.operators.sparse_search import SparseIndex

DIM = 1_000_000_000


def made(seed=3, n=400, common=6):
    """Vectors with a few entries that most rows share, of small weight, and some of many other dimensions."""
    rng = np.random.default_rng(seed)
    rare = rng.integers(0, DIM, size=80)
    rows = []
    for i in range(n):
        v = {int(d): float(np.float32(rng.choice([0.01, 0.02, -0.01]))) for d in range(common) if rng.random() < 0.9}
        v |= {int(d): float(np.float32(rng.normal())) for d in rng.choice(rare, size=rng.integers(0, 6), replace=False)}
        rows.append((i, v))
    return rows + [(n, {}), (n + 1, None), (n + 2, rows[0][1]), (n + 3, rows[0][1])]


def frame(spark, rows):
    vec = lambda v: None if v is None else (DIM, sorted(v), [v[d] for d in sorted(v)])
    return spark.createDataFrame([(i, vec(v), "x") for i, v in rows], "vec_id long, embedding struct<dim:int,indices:array<int>,values:array<float>>, value string")


def plain(rows, q, k, cosine, skip=True):
    norm = lambda v: sum(x * x for x in v.values()) ** 0.5 if cosine else 1.0
    qi, qv = q
    out = []
    for i, v in rows:
        if v and qv and not (skip and i == qi):
            s = sum(x * v[d] for d, x in qv.items() if d in v) / (norm(v) * norm(qv))
            if s > 1e-9:
                out.append((i, s))
    return sorted(out, key=lambda x: (-round(x[1], 6), x[0]))[:k]


@pytest.mark.parametrize("metric", ["ip", "cosine"])
def test_equals_a_scan(spark, tmp_path, metric):
    rows = made()
    df = frame(spark, rows).repartition(3)
    index = SparseIndex.build(df, f"{tmp_path}/i", metric, part=50)
    assert index.lists.where("parts > 1").count() >= 6
    got = {}
    for r in index.search_batch(df.where("vec_id % 20 = 0 or vec_id > 398"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in rows:
        if q[0] % 20 == 0 or q[0] > 398:
            want = plain(rows, q, 5, metric == "cosine")
            mine = [(i, s) for _, i, s in sorted(got.get(q[0], []))]
            assert [s for _, s in mine] == pytest.approx([s for _, s in want], abs=2e-6) and len({i for i, _ in mine}) == len(want)
            assert {i for i, s in mine if s > want[-1][1] + 1e-5} == {i for i, s in want if s > want[-1][1] + 1e-5}


def test_lists_of_small_weight_are_not_read(spark, tmp_path):
    rows = made(4, 300)
    df = frame(spark, rows)
    index = SparseIndex.build(df, f"{tmp_path}/i")
    q = df.where("vec_id < 60")
    _, lists, _ = index.essential(q, 3, True)
    common, asked = lists.where("index < 6").count(), sum(d < 6 for i, v in rows if i < 60 and v for d in v)
    assert common < asked * 0.6  # a query that has little but these reads them


def test_empty_and_refused(spark, tmp_path):
    df = frame(spark, made(1, 5))
    index = SparseIndex.build(df.limit(0), f"{tmp_path}/e")
    assert index.search_batch(df, 3).count() == 0
    with pytest.raises(ValueError):
        SparseIndex.build(df, f"{tmp_path}/x", "l2")


@pytest.mark.parametrize("share", [0, 2])
def test_scan_and_postings_agree(spark, tmp_path, monkeypatch, share):
    """Queries that share many lists with most rows, and a cap that each block keeps: by products of whole vectors, and by postings."""
    from quillon.operators import sparse_search

    monkeypatch.setattr(sparse_search, "SHARE", share)
    monkeypatch.setattr(sparse_search, "BLOCK", 300)
    monkeypatch.setattr(sparse_search, "ENTRIES", 40)
    met = []
    scanned = SparseIndex._scanned
    monkeypatch.setattr(SparseIndex, "_scanned", lambda *a: (met.append(1), scanned(*a))[1])
    rows = made(5, 200)
    df = frame(spark, rows)
    got = {}
    for r in SparseIndex.build(df, f"{tmp_path}/s").search_batch(df.where("vec_id % 10 = 0"), 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score))
    assert len(met) == (share == 0)
    for q in rows:
        if q[0] % 10 == 0 and q[1]:
            assert [s for _, s in sorted(got.get(q[0], []))] == pytest.approx([s for _, s in plain(rows, q, 4, False)], abs=2e-6)
