import random

import numpy as np

from quillon.llm.language import Scores, identify, subwords, train

PARTS = {"aa": ["th", "er", "on", "ing"], "bb": ["sch", "ung", "ein", "ü"], "cc": ["ción", "os", "que", "ñ"]}


def corpus(n=150):
    rng = random.Random(4)
    out = []
    for i in range(n):
        lang = sorted(PARTS)[i % 3]
        out.append((i, " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(15, 80))), lang))
    return out


def test_accuracy_and_odd_values(spark):
    made = corpus()
    model = train([(lang, t) for _, t, lang in made[:90]])
    odd = [(900, None), (901, ""), (902, "12 34 !?"), (None, made[0][1]), (903, "thing" * 40_000), (904, "é"), (905, "theron " * 60_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in made[90:]] + [(i, t, "x", 1) for i, t in odd], "doc_id long, text string, lang_pred string, score int")
    out = {r.doc_id: r for r in identify(docs, model).collect()}
    want = {i: lang for i, _, lang in made}
    assert np.mean([out[i].lang_pred == want[i] for i, *_ in made[90:]]) >= 0.97
    assert all((out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True) for i in (900, 901, 902))
    assert out[None].lang_pred == out[905].lang_pred == "aa" and out[904].lang_pred in PARTS
    assert np.mean([out[i].rejected for i, *_ in made[90:]]) < 0.5


def test_cached_sums_equal_plain_ones():
    table = np.random.default_rng(0).normal(size=(1 << 15, 3)).astype(np.float32)
    scores = Scores(table)
    for text in ("one two one", "", "ÉÉ x " * 50 + "one"):
        plain = np.zeros(4)
        for w in text.lower().split():
            b, n = subwords([w])
            plain += np.append(table[b].sum(axis=0), n)
        assert np.allclose(scores.total(text), plain, rtol=1e-4, atol=1e-3)


def test_subwords_of_many_words_equal_those_of_each():
    words = ["a", "the", "ción", "\U0001f600x"]
    b, n = subwords(words)
    assert [list(x) for x in np.split(b, np.cumsum(n)[:-1])] == [list(subwords([w])[0]) for w in words]


def test_without_training_or_rows(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert train([]) is None and identify(docs, None).first().lang_pred == "und"
    assert identify(docs.limit(0), None).count() == 0
