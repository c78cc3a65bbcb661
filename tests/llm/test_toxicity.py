import random
import zlib

from quillon.llm.samples import sample_by_label
from quillon.llm.toxicity import CUT, score, train

BAD = ["idiot", "scum", "moron"]


def corpus(n=260, seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices(["th", "on", "er", "ed", "an", "ti", "re"], k=rng.randint(1, 4))) for _ in range(900)]
    out = []
    for i in range(n):
        ws = rng.choices(vocab, k=rng.randint(30, 120))
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            ws[rng.randrange(len(ws))] = rng.choice(BAD) + rng.choice(["", ",", "."])
        out.append((i, " ".join(ws), int(toxic)))
    return out


def test_held_out_accuracy_and_odd_values(spark):
    made = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in made] + [(None, None, None, None), (900, "", "x", 1.0), (901, " \n", "x", 1.0), (902, "thon erti " * 60_000 + "idiot moron scum", "x", 1.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in made if zlib.crc32(str(i).encode()) % 4 != 2] + [(None, 1), (3, None)], "doc_id long, toxic int").distinct()
    rows = sample_by_label(docs, labels, "toxic", 400)
    assert len(rows) == len({i for i, *_ in made if zlib.crc32(str(i).encode()) % 4 != 2})
    model = train(rows)
    out = {r.doc_id: r for r in score(docs, model).collect()}
    assert len(out) == len(made) + 4
    y = {i: t for i, _, t in made}
    held = [r for i, r in out.items() if i in y and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items() if i is not None)
    right = sum((r.score >= CUT) == y[r.doc_id] for r in held)
    assert len(held) > 40 and right / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    assert out[None].score == out[900].score == out[901].score < CUT


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    rows = sample_by_label(docs, labels, "toxic", 5)
    assert len(rows) == 10 and rows == sample_by_label(docs, labels, "toxic", 5)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert train([]) is None and train([(1, "a")]) is None
    assert [r.score for r in score(docs, None).collect()] == [0.0, 0.0]
    assert score(docs.limit(0), None).count() == 0
