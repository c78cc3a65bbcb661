import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import substring_dedup as S
from quillon.llm.common import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """rows: (doc_id, text) -> (n_words, kept) of each."""
    first = {}
    for i, t in rows:
        ws = WORD.findall(t or "")
        for s in range(len(ws) - 19):
            w, at = tuple(ws[s : s + 20]), (i is None, i or 0, s)
            first[w] = min(first.get(w, at), at)
    out = []
    for i, t in rows:
        ws, gone = WORD.findall(t or ""), set()
        for s in range(len(ws) - 19):
            if first[tuple(ws[s : s + 20])] < (i is None, i or 0, s):
                gone |= set(range(s, s + 20))
        out.append((len(ws), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(60)] + ["é", " x", "a b"]
    passages = [rng.choices(vocab, k=k) for k in (19, 20, 21, 35, 60)]
    rows = []
    for i in range(120):
        ws = rng.choices(vocab, k=rng.choice([0, 5, 19, 20, 40, 90]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = rng.choice(passages)
        rows.append((i * 3 % 119, rng.choice([" ", "\n", "\t "]).join(ws)))
    same = " ".join(rng.choices(vocab, k=50))
    rows += [(500 + i, same) for i in range(40)]
    rows += [(600, "x " * 500), (601, "x " * 400), (602, "p q r " * 30), (603, None), (604, ""), (None, same), (605, " ".join(rng.choices(vocab, k=20_000))), (606, " ".join(passages[3] * 3))]
    return rows


@pytest.mark.parametrize("batches", [1, 5])
def test_equals_brute_force(spark, batches):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, row int").repartition(5)
    out = S.remove_repeats(docs, batches).select("row.doc_id", "n_words", "n_removed", "kept").collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.kept) for r in out)
    assert got == sorted((i is None, i or 0, n, k) for (i, _), (n, k) in zip(rows, brute(rows)))
    assert all(r.n_removed == r.n_words - len(WORD.findall(r.kept)) for r in out)


def test_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "a", "b", "c"), (2, text + " z", "d", "e", "f")], "doc_id long, text string, _text string, _id string, _ string")
    assert sorted(map(tuple, S.without_repeats(docs).collect())) == [(1, text, "a", "b", "c"), (2, "z", "d", "e", "f")]


def test_repeated_rows_and_stage(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 9), (1, text, 9), (2, "head\n" + text, 9), (3, "short\ntext", 9)], "doc_id long, text string, n_chars long")
    out = S.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, text, 9), (1, text, 9), (2, "head", 4), (3, "short\ntext", 9)]
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_runs_are_sorted_compacted_and_joined_without_a_shuffle(spark):
    index = S.FingerprintIndex(spark, scratch_path(spark, "test"), buckets=4)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(60))) for i in range(20)], "_id long, text string")
    every = S.entries(docs)
    found = [{r.fp for r in index.add(every.where(F.col("_id") % 6 == k)).collect()} for k in range(6)]
    assert [len(x) for x in index.levels] == [2, 1] and len(index.runs()) == 3
    for run in index.runs():
        for part in spark.table(run).withColumn("p", F.input_file_name()).groupBy("p").agg(F.collect_list("fp").alias("f")).collect():
            assert part.f == sorted(set(part.f))
    many = {r.fp for r in every.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").collect()}
    assert set().union(*found) == many and many
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a, b = (spark.table(r).select("fp") for r in index.runs()[:2])
        plan = a.join(b, "fp", "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    index.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(index.name)]


def test_new_batches_against_a_kept_index(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    want = {i: k for (i, _), (_, k) in zip(rows, brute(rows))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index, got = S.FingerprintIndex(spark), {}
    for low, high in ((0, 60), (60, 61), (61, 130), (130, 1000)):
        out = S.deduplicate(docs.where(f"doc_id >= {low} and doc_id < {high}"), docs.where(f"doc_id < {low}"), index)
        got |= {r.doc_id: r.kept for r in out.select("row.doc_id", "kept").collect()}
    index.drop()
    assert got == want


def test_query_digest(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in S.op8_substring_dedup(spark, str(tmp_path)).collect()}
    assert out[1].n_removed == 0 and out[2].n_removed == 30
    assert out[2].kept_sha256 == hashlib.sha256(b"more").hexdigest()
