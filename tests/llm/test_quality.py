import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quillon.llm import near_dup
from quillon.llm.quality import PIECE, SMOOTHING, THRESHOLD, UNIT, annotate, judge, keep, trusted_ids, trusted_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    ws = WORD.findall(text)
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    seen, covered = Counter(wins), set()
    for i, w in enumerate(wins):
        if seen[w] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def grams(text):
    code = [zlib.crc32(w.encode()) for w in WORD.findall(text or "")]
    return [u % 65536 for u in code] + [(u * 31 + v) % 65536 for u, v in zip(code, code[1:])]


def texts():
    rng = random.Random(3)
    vocab = ["the", "of", "ééç", "a", "\U0001f600x", "word", "b|", "zzz", "é"] + [f"w{i}" for i in range(40)]
    out = [" ".join(rng.choices(vocab, k=rng.choice([0, 1, 7, 8, 9, 19, 20, 60, 300]))) for _ in range(60)]
    out += ["one two three four five six seven eight " * 5, "x " * 30, "a b\n\nc d\na b\r\n a b\na b", "\x0b\x0c\t", "", None, "l\n" * 50, "   nbsp"]
    out += [" ".join(rng.choices(vocab, k=50)) + " " + " ".join(f"r{i}" for i in range(9)) + " mid " + " ".join(f"r{i}" for i in range(9)), " ".join(f"u{i % 7000}" for i in range(20_000)), "y" * 100_000]
    return out


def test_counts_scores_and_verdicts(spark):
    made = texts()
    rows = [(i, t, "clash", 1) for i, t in enumerate(made)] + [(0, made[0], "clash", 1), (None, "lone words here", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, ratios int")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(40)] + [(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    out = annotate(docs, trusted_ids(labels)).collect()
    assert len(out) == len(rows) and out[0].n_words == "clash"
    raw, target = Counter(), Counter()
    good = {t or "" for i, t, *_ in rows if i is not None and i < 40 and i % 3}
    for t in {t or "" for _, t, *_ in rows}:
        raw.update(grams(t))
        if t in good:
            target.update(grams(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = {(b, own): round(UNIT * math.log((max(target[b] - own, 0) + SMOOTHING) / ((raw[b] - 1) * n_target / n_raw + SMOOTHING))) for b in raw for own in (0, 1)}
    for r in out:
        q, g = r.quality, grams(r.text)
        want = base(r.text)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want, r.text[:80]
        assert q.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        score = sum(ratio[b, int((r.text or "") in good)] for b in g) / len(g) / UNIT if g else 0.0
        assert abs(q.score - score) < 1e-9 and q.kept == (not q.base_failed and score >= THRESHOLD)


def test_without_trusted_or_rows(spark):
    docs = spark.createDataFrame([(1, "some words " * 30 + " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    none = trusted_ids(spark.createDataFrame([], "doc_id long, quality int"))
    assert annotate(docs, none).first().quality.score == 0.0
    assert annotate(docs.limit(0), none).count() == 0


def test_clean_documents_stay_where_counts_are_thin(spark):
    """Words that no trusted document has are no reason to drop a text; words of many bad ones are."""
    rng = random.Random(8)
    common = ["the", "of", "and", "to", "in"]
    clean = lambda k: " ".join(rng.choice(common) if rng.random() < 0.5 else f"n{k}w{rng.random():.9f}" for _ in range(60))
    docs = [(i, clean(i)) for i in range(300)] + [(1000 + i, " ".join(f"{w}###" if w in common else w for w in clean(i).split())) for i in range(100)]
    docs += [(2000 + i, docs[0][1]) for i in range(5)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(1000, 0)], "doc_id long, quality int")
    out = {r.doc_id: r.quality.kept for r in annotate(spark.createDataFrame(docs, "doc_id long, text string"), trusted_ids(labels)).collect()}
    assert all(out[i] for i in range(300)) and all(out[2000 + i] for i in range(5)) and not any(out[1000 + i] for i in range(100))


def test_copies_of_a_clean_text_stay(spark):
    """A text that nobody has labelled is judged alike alone and in groups of 1 % and of 30 % of the corpus; bad texts go all the same."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    clean = lambda: " ".join(rng.choices(vocab, k=80))
    docs = [(i, clean()) for i in range(500)] + [(1000 + i, " ".join(f"{w}###" for w in clean().split())) for i in range(60)]
    labels = trusted_ids(spark.createDataFrame([(i, 1) for i in range(0, 500, 2)], "doc_id long, quality int"))
    scores = set()
    for copies in (1, 6, 240):
        some = docs + [(5000 + i, docs[1][1]) for i in range(copies - 1)]
        out = {r.doc_id: r.quality for r in annotate(spark.createDataFrame(some, "doc_id long, text string").repartition(4), labels).collect()}
        assert out[1].kept and all(out[5000 + i].kept for i in range(copies - 1)) and not any(out[1000 + i].kept for i in range(60))
        scores |= {out[1].score, *(out[5000 + i].score for i in range(copies - 1))}
    assert len(scores) == 1
    found = near_dup.keep_one(keep(spark.createDataFrame(some, "doc_id long, text string"), labels)).where("doc_id = 1 or doc_id >= 5000").collect()
    assert [r.doc_id for r in found] == [1]


def test_ratios_do_not_grow_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    plan = keep(docs, trusted_ids(spark.createDataFrame([(1, 1)], "doc_id long, quality int")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 30_000


def test_every_trusted_document_counts(spark):
    """More trusted ids than 20,000, in few texts: each of the 25,000 gives its text, whatever the hash of its id."""
    texts = [" ".join(f"t{k}w{i % 30}" for i in range(60)) for k in range(50)]
    ids = spark.range(25_000)
    assert trusted_ids(ids.selectExpr("id as doc_id", "1 as quality")).count() == 25_000
    # The ids behind the first 20,000 in the old order, pmod(id * 7919, 1000003), alone have the text of `late`.
    late = [r.id for r in ids.orderBy(F.expr("pmod(id * 7919, 1000003)").desc()).limit(3000).collect()]
    docs = [(i, texts[i % 49]) for i in range(25_000)]
    for i in late:
        docs[i] = (i, texts[49])
    out = judge(spark.createDataFrame(docs, "doc_id long, text string"), trusted_ids(ids.selectExpr("id as doc_id", "1 as quality")))
    # All texts are trusted, so the target's counts are the raw ones, less this text's own in both.
    assert {r.score for r in out.select("quality.score").distinct().collect()} == {0.0}
    assert trusted_texts(spark.createDataFrame(docs, "doc_id long, text string"), ids.withColumnRenamed("id", "doc_id")).count() == 50


def test_texts_of_several_pieces(spark):
    """Scores of texts at and beyond the number of words that are summed at once, trusted and not."""
    rng = random.Random(6)
    made = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (PIECE - 1, PIECE, PIECE + 1, 2 * PIECE + 5, 40, 40)]
    trusted = {made[0], made[2], made[4]}
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    out = annotate(docs, trusted_ids(spark.createDataFrame([(i, 1) for i in (0, 2, 4)], "doc_id long, quality int"))).collect()
    raw, target = Counter(), Counter()
    for t in made:
        raw.update(grams(t))
        if t in trusted:
            target.update(grams(t))
    scale = sum(target.values()) / sum(raw.values())
    for r in out:
        own, g = int(r.text in trusted), grams(r.text)
        ratio = {b: round(UNIT * math.log((max(target[b] - own, 0) + SMOOTHING) / ((raw[b] - 1) * scale + SMOOTHING))) for b in set(g)}
        assert abs(r.quality.score - sum(ratio[b] for b in g) / len(g) / UNIT) < 1e-9
