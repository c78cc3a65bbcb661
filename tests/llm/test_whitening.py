import math

import duckdb
import numpy as np
import pytest

from quillon.llm.whitening import op13_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>, n string, x int"


def plain(vectors, components=8):
    """n, deviations, whitened and explained by numpy, with exact integer sums."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]
    y = np.array((n * x - s).tolist(), float) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, deviation, y @ u / np.sqrt(e), e / np.trace(v)


def compare(rows, ids, vectors, components=8):
    n, deviation, w, share = plain(vectors, components)
    k = w.shape[1]
    assert len(rows) == len(ids) * k and {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error <= 1e-9
    at = {i: p for p, i in enumerate(ids)}
    got = np.zeros_like(w)
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[at[r.vec_id]] and r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
    sign = np.sign((got * w).sum(axis=0))
    assert np.abs(got * sign - w).max() < 1e-6


def test_equals_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.2 + rng.normal(size=12) * 50).astype(np.float32)
    odd = [(900, None), (901, []), (902, [1.0] * 11), (903, [None, *[1.0] * 11]), (904, [float("nan")] * 12), (905, [float("-inf"), *[0.0] * 11]), (906, [1.0] * 13)]
    rows = [(i, v.tolist(), "n", 1) for i, v in enumerate(vectors)] + [(i, v, "x", 2) for i, v in odd]
    out = whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    compare(out, list(range(300)), vectors)


def test_fewer_dimensions_than_components(spark):
    vectors = np.random.default_rng(1).normal(size=(40, 3)).astype(np.float32)
    compare(whiten(spark.createDataFrame([(i, v.tolist(), "", 0) for i, v in enumerate(vectors)], SCHEMA)).collect(), list(range(40)), vectors)


def test_components_without_variance(spark):
    rows = [(i % 3, [float(i % 7), float(2 * (i % 7)), 5.0], None, None) for i in range(30)] + [(None, [1.0, 2.0, 5.0], None, None)]
    out = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 31 * 3 and {r.component for r in out if r.whitened is None} == {2, 3} and all(r.whitened is not None for r in out if r.component == 1)
    assert out[0].identity_error <= 1e-9 and {round(r.explained, 9) for r in out if r.component == 1} == {1.0}
    alike = whiten(spark.createDataFrame([(1, [0.5, 0.5], None, None)] * 4, SCHEMA)).collect()
    assert len(alike) == 8 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in alike)


def test_very_large_entries(spark):
    for large in (3e4, 1e30):
        rows = [(i, [float(i), 0.5 * (i % 2), large if i == 7 else -float(i)], None, None) for i in range(30)]
        out = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(out) == 90 and out[0].identity_error < 1e-4
        if large == 3e4:
            assert sorted({(r.vec_id, r.deviation) for r in out}) == list(enumerate(plain([r[1] for r in rows])[1]))
        else:
            assert {r.deviation for r in out} == {None}


def test_empty_tables(spark):
    for rows in ([], [(1, None, None, None)]):
        out = whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    compare(op13_whitening(spark, sf).collect(), [r[0] for r in rows], [r[1] for r in rows])
