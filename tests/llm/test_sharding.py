import zlib

from pyspark.sql import functions as F

from quillon.llm.sharding import cut_cells, shard


def smallest(sizes, k):
    """Brute force over all contiguous partitions into at most k parts."""
    best = {(0, 0): 0}
    n = len(sizes)
    for parts in range(1, k + 1):
        for end in range(1, n + 1):
            best[parts, end] = min(
                (max(best[parts - 1, at], sum(sizes[at:end])) for at in range(end) if (parts - 1, at) in best), default=10**18
            )
    return min(best[p, n] for p in range(1, k + 1))


def test_capacity_is_the_smallest(spark):
    for sizes, k in (([3, 1, 4, 1, 5, 9, 2, 6], 3), ([100, 1, 1, 1, 1], 4), ([7], 16), ([1] * 20, 6), ([5, 5, 5, 40, 5, 5], 3)):
        cells = spark.createDataFrame([(i * 3, s) for i, s in enumerate(sizes)], "cell int, bytes long")
        rows = sorted(cut_cells(cells, k).join(cells, "cell").collect())
        fill = {}
        for r in rows:
            fill[r.shard] = fill.get(r.shard, 0) + r.bytes
        assert max(fill.values()) == smallest(sizes, k)
        assert [r.shard for r in rows] == sorted(r.shard for r in rows) and set(fill) == set(range(len(fill))) and len(fill) <= k


def test_rows_groups_and_odd_values(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}" * (1 + i % 7), "x", 1) for i in range(300)] + [(None, None, None, None), (1005, "", "x", 2), (1005, "", "x", 2), (999, "long " * 50_000, "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string, shard int")
    out = shard(docs, 4).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {r[0]: r[1] for r in rows}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in out)
    assert len({r.shard for r in out if text[r.doc_id] == "same"}) == 1


def test_empty(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert shard(spark.createDataFrame([(1, "a")], "doc_id long, text string")).select(F.max("slot")).first()[0] == 0
