import random
from collections import Counter

import numpy as np

from quillon.llm.components import components
from quillon.llm import near_dup
from quillon.llm.near_dup import classify, difference, keep_one, shingles, signatures, similarity


def bag(text):
    ws = (text or "").split()
    k = min(5, len(ws))
    return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if ws else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(texts):
    """Class of each text by all pairs."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [bag(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def corpus():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = rng.choices(vocab, k=rng.choice([3, 12, 60, 200]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 6])):
            ws = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            texts.append(" ".join(ws))
    texts += [None, "", "a", "a", "b", "x " * 3000, "x " * 2900, "x " * 2000, "u v " * 40, texts[0], "  " + texts[0].replace(" ", "\n")]
    return texts


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    for shared, only, heavy in ((40, 10, 1), (5, 5, 30), (100, 400, 2)):
        keys = rng.integers(0, 1 << 63, shared + 2 * only).astype(np.uint64)
        counts = rng.integers(1, heavy + 1, (2, len(keys)))
        a = (keys[: shared + only], counts[0, : shared + only])
        b = (np.r_[keys[:shared], keys[shared + only :]], counts[1, : shared + only])
        order = [np.argsort(x[0]) for x in (a, b)]
        a, b = (a[0][order[0]], a[1][order[0]]), (b[0][order[1]], b[1][order[1]])
        s = signatures([a, b], 4000)
        assert abs((s[0] == s[1]).mean() - similarity(a, b)) < 0.04


def test_similarity_equals_the_plain_one():
    t = corpus()
    for i in range(0, len(t), 3):
        for j in range(0, len(t), 5):
            if bag(t[i]) or bag(t[j]):
                assert abs(similarity(shingles(t[i]), shingles(t[j])) - jaccard(bag(t[i]), bag(t[j]))) < 1e-12


def test_classes_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(10 + i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, node string, root string")
    out = {r.doc_id: r.class_id for r in classify(docs).collect()}
    assert [out[10 + i] - 10 for i in range(len(texts))] == brute(texts)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id - 10 for r in kept.collect()) == sorted(set(brute(texts)))


def test_null_ids_repeated_rows_and_none(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (None, "other"), (None, "other")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.class_id)) for r in classify(docs).collect()) == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in keep_one(docs).collect()) == ["7", "None"]
    assert classify(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(5, 5)]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[100 + i] == 100 for i in range(30)) and len(out) == 71


def variants(rng, n, edits, length=150):
    """n copies of a text, each with up to `edits` of its words replaced, and some words cut off its end."""
    base = [f"b{rng.random():.6f}" for _ in range(length)]
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randint(0, edits)):
            ws[rng.randrange(length)] = f"e{rng.random():.6f}"
        yield " ".join(ws[: length - rng.choice([0, 0, 0, 5, 40])])


def test_no_link_of_a_large_bucket_is_lost(spark):
    """Near copies on both sides of the bound: classes by all pairs, and links that no centre has part of the time."""
    rng = random.Random(4)
    texts = [t for edits in (5, 9, 14) for t in variants(rng, 60, edits)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.class_id for r in classify(docs).collect()}
    assert [out[i] for i in range(len(texts))] == brute(texts)


def test_prefixes_find_what_one_centre_leaves(spark, monkeypatch):
    """With one centre a bucket, links between nodes that are far from it are left to the prefixes of differences."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for g in range(6):  # groups that differ from the base by more than the bound, each with copies of its own
        other = list(base)
        for k in range(6 + g):
            other[(k * 17 + g * 5) % 200] = f"g{g}x{k}"
        texts += [" ".join(w if rng.random() > 0.005 else f"e{rng.random():.6f}" for w in other) for _ in range(12)]
    monkeypatch.setattr(near_dup, "ROUNDS", 1)
    out = {r.doc_id: r.class_id for r in classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i] for i in range(len(texts))] == brute(texts)


def test_differences_keep_the_distance():
    rng = random.Random(2)
    bags = [shingles(" ".join(rng.choices("abc", k=rng.randint(5, 400)))) for _ in range(12)]
    l1 = lambda a, b: sum(abs(dict(zip(*map(np.ndarray.tolist, a))).get(k, 0) - dict(zip(*map(np.ndarray.tolist, b))).get(k, 0)) for k in {*a[0].tolist(), *b[0].tolist()})
    for a in bags:
        for b in bags:
            x, y = difference(a, bags[0]), difference(b, bags[0])
            assert len(set(x.tolist())) == len(x) == l1(a, bags[0])
            assert len(x) + len(y) - 2 * len(np.intersect1d(x, y)) == l1(a, b)


def test_very_long_texts(spark):
    rng = random.Random(6)
    long = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    near = [w if rng.random() > 0.01 else "x" for w in long]
    far = [w if rng.random() > 0.3 else "x" for w in long]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([far, long, near])], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in classify(docs).collect()} == {0: 0, 1: 1, 2: 1}


def test_clashing_columns_and_repeated_rows_stay_defined(spark):
    text = " ".join(f"w{i}" for i in range(30))
    cols = "doc_id long, text string, _id string, _node string, id string, mark string, row string, node string"
    rows = [(7, text, *f"A{k} B C D E F".split()) for k in range(5)] + [(8, text + " tail", *"u v w x y z".split()), (9, "alone", None, None, None, None, None, None)]
    first = sorted(keep_one(spark.createDataFrame(rows, cols)).collect(), key=str)
    again = sorted(keep_one(spark.createDataFrame(rows[::-1], cols).repartition(3)).collect(), key=str)
    assert first == again and len(first) == 2 and {tuple(r) for r in first} <= set(rows) and {r.doc_id for r in first} == {7, 9}
