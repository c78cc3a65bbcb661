import random

import corpus_pipeline as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import near_dup
from quillon.llm.packing import TOKENIZER
from tests.llm.test_near_dup import bag, jaccard
from tests.llm.test_quality import base
from tests.llm.test_substring_dedup import brute


def tables(spark, folder):
    rng = random.Random(21)
    vocab = [f"w{i}{'abcd'[i % 4] * 2}" for i in range(500)] + ["the", "of"] * 60  # few endings: dense counts
    bench = [rng.choices(vocab, k=40) for _ in range(5)]
    passage = [f"p{i}{'abcd'[i * 7 % 4] * 2}" for i in range(60)]
    docs = []
    for i in range(120):
        ws = rng.choices(vocab, k=rng.randint(60, 150))
        if i % 10 == 3:
            ws[30:30] = passage
        if i % 10 == 5:
            ws[20:20] = bench[i % 5]
        docs.append((i, " ".join(ws)))
    docs += [(200 + i, docs[i][1] + f" tail{i}aa") for i in range(0, 40, 4)] + [(300 + i, docs[2][1]) for i in range(9)]
    docs += [(400 + i, " ".join(f"{w}$$$" for w in rng.choices(vocab, k=80))) for i in range(15)] + [(500, "too short"), (501, None), (502, "again and again " * 30)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    # Half of the clean documents are trusted, some of each kind but the exact copies, which nobody has labelled.
    spark.createDataFrame([(i, 1, 0) for i in range(120) if i % 4 < 2], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, bench


def test_stages_and_rows(spark, tmp_path):
    docs, bench = tables(spark, tmp_path)
    # Brute force.
    rows = [(i, t) for i, t in docs if base(t)[0] >= 20 and 100 * base(t)[4] <= 30 * base(t)[0] and "$$$" not in t]
    kept = []
    for i, t in rows:
        if all(jaccard(bag(t), bag(x)) < 0.8 for _, x in kept):
            kept.append((i, t))
    lean = [(i, t if n == len(k.split()) else k) for (i, t), (n, k) in zip(kept, brute(kept))]
    final = {i: t for i, t in lean if not any(" ".join(b) in t for b in bench)}
    out = P.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(TOKENIZER)
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in final.items()}
    assert {r.doc_id: r.doc_tokens for r in out} == want
    at = 0
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 4096 + r.offset == at
        at += r.length
    assert at == sum(want.values())


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = docs.withColumn("row", F.lit(1)).withColumn("quality", F.lit("x"))
    for k, (_, stage) in enumerate(P.STAGES):
        got = stage(spark, extra, str(tmp_path))
        assert got.count() == 0 and (k == len(P.STAGES) - 1 or got.columns == extra.columns)


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows and columns with the operators' own names in every stage."""
    cols = "doc_id long, text string, lang string, _id string, _text string, id int, mark string, row string, matches int, n_chars long"
    long = " ".join(f"word{i}" for i in range(5000))
    one = " ".join(f"w{i}" for i in range(60))
    rows = [(1, one, "en", "a", "b", 1, "m", "r", 2, 1), (1, one, "en", "a", "b", 1, "m", "r", 2, 1), (None, one + " z", "de", "c", "d", 3, "n", "s", 4, 2), (None, None, None, None, None, None, None, None, None, None), (2, "", "en", "e", "f", 5, "o", "t", 6, 3), (3, long, "fr", "g", "h", 7, "p", "u", 8, 4)]
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, ""), (2, "not here at all in any of the texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, cols)
    kept = {"quality rules": 4, "MinHash near-dedup": 3, "substring dedup": 6, "benchmark decontamination": 6}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert out.select("doc_id").count() >= 6
            continue
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert len(got) == kept[name], (name, got)
        free = lambda r: tuple(x for c, x in zip(docs.columns, r) if c not in ("text", "n_chars"))
        assert {free(r) for r in got} <= {free(r) for r in rows}


def test_scratch_tables_of_queries_stay(spark, tmp_path):
    """A result that is not computed yet keeps its tables while the pipeline's stages release theirs."""
    docs, _ = tables(spark, tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    waiting = near_dup.classify(frame)
    for _, stage in P.STAGES[:3]:
        stage(spark, frame, str(tmp_path)).count()
    assert waiting.count() == len(docs)
