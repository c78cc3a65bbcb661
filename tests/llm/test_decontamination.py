import random

import numpy as np

from quillon.llm import decontamination as D
from quillon.llm.decontamination import Items, annotate, best_match, clean


def plain_distance(item, text):
    rows = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(rows[j - 1] + (a != b), rows[j] + 1, new[-1] + 1))
        rows = new
    return min(rows)


def made(seed=1, items=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of"] * 60
    bench = [rng.choices(vocab, k=rng.randint(16, 60)) for _ in range(items)]
    return rng, vocab, bench


def edited(rng, ws, rate):
    ws = list(ws)
    for _ in range(int(rate * len(ws))):
        at = rng.randrange(len(ws))
        kind = rng.randrange(3)
        if kind == 0:
            ws[at] = f"e{rng.random()}"
        elif kind == 1:
            del ws[at]
        else:
            ws.insert(at, f"e{rng.random()}")
    return ws


def test_distance_equals_the_plain_one():
    rng = random.Random(2)
    for _ in range(200):
        item, text = (np.array(rng.choices(range(5), k=rng.randint(1, 12)), np.uint64) for _ in range(2))
        edits, start = best_match(item, text)
        assert edits == plain_distance(list(item), list(text)) == min(plain_distance(list(item), list(text[start:])), edits)


def test_recall_and_precision():
    rng, vocab, bench = made()
    items = Items([(i, " ".join(w)) for i, w in enumerate(bench)])
    for rate, least in ((0.0, 1.0), (0.05, 0.97), (0.1, 0.95)):
        hit = total = 0
        for i, w in enumerate(bench * 4):
            noise = [rng.choices(vocab, k=rng.randint(0, 200)) for _ in range(2)]
            found = items.find([" ".join([*noise[0], *edited(rng, w, rate), *noise[1]])])[0]
            hit += any(m["item_id"] == i % len(bench) for m in found)
            assert all(m["item_id"] == i % len(bench) for m in found)
            total += 1
        assert hit / total >= least, (rate, hit / total)
    assert not any(items.find([" ".join(rng.choices(vocab, k=5000)) for _ in range(20)]))


def test_matches_hold_and_stage(spark, monkeypatch):
    rng, vocab, bench = made(3)
    texts = []
    for i in range(80):
        ws = rng.choices(vocab, k=rng.randint(0, 150))
        if i % 4 == 0:
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = edited(rng, bench[i % len(bench)], rng.choice([0, 0.1, 0.15]))
        texts.append(rng.choice([" ", "\n"]).join(w.upper() + "," if i % 8 == 0 else w for w in ws))
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(900, None, "x", 1), (901, "", "x", 1), (None, " ".join(bench[0]), "x", 1), (902, " ".join(vocab * 90 + bench[1]), "x", 1), (0, texts[0], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string, row int")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bench)] + [(99, None), (98, "too short"), (None, "n1 n2 n3 n4 n5 n6 n7 n8 n9")], "item_id long, text string")
    out = annotate(docs, b).collect()
    assert len(out) == len(rows)
    exact = 0
    for r in out:
        plain = [w.strip(",").lower() for w in (r.row.text or "").split()]
        held = {i for i, w in enumerate(bench) if plain_distance(w, plain) <= int(D.EDIT_RATE * len(w))}
        got = {m.item_id for m in r.matches}
        assert got <= held
        unchanged = {i for i, w in enumerate(bench) if " ".join(w) in " ".join(plain)}
        assert unchanged <= got
        exact += len(unchanged)
        for m in r.matches:
            w = bench[m.item_id]
            assert plain_distance(w, plain[m.start : m.start + len(w) + m.edits]) == m.edits
    assert exact >= 8
    kept = clean(docs, b)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.row.doc_id) for r in out if not r.matches)
    monkeypatch.setattr(D, "MAX_ITEMS", 15)
    again = {str(r.row.doc_id): {m.item_id for m in r.matches} for r in annotate(docs, b).collect()}
    assert again.keys() == {str(r.row.doc_id) for r in out} and all({i for i, w in enumerate(bench) if " ".join(w) in " ".join(x.strip(",").lower() for x in (r.row.text or "").split())} <= again[str(r.row.doc_id)] for r in out)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert annotate(docs, none).first().matches == [] and clean(docs, none).count() == 1
    assert annotate(docs.limit(0), none).count() == 0


def test_items_without_their_head():
    rng, vocab, _ = made(5)
    for n in (40, 60, 100, 200):
        bench = [rng.choices(vocab, k=n) for _ in range(20)]
        items = Items([(i, " ".join(w)) for i, w in enumerate(bench)])
        for head in ([], [f"h{j}" for j in range(n // 5)]):
            docs = [" ".join([*rng.choices(vocab, k=50), *head, *w[n // 5 :], *rng.choices(vocab, k=50)]) for w in bench]
            assert [[m["item_id"] for m in found] for found in items.find(docs)] == [[i] for i in range(len(bench))]


def test_recall_at_the_edit_rate():
    rng, vocab, _ = made(6)
    for n in (8, 10, 11, 15, 20, 40, 60, 100):
        bench = [rng.choices(vocab, k=n) for _ in range(20)]
        items = Items([(i, " ".join(w)) for i, w in enumerate(bench)])
        changed = [edited(rng, w, D.EDIT_RATE) for w in bench]
        changed += [[f"e{j}" if j % 5 == 4 else x for j, x in enumerate(w)] for w in bench]  # evenly, so that runs are short
        docs = [[*rng.choices(vocab, k=rng.randint(0, 40)), *c, *rng.choices(vocab, k=rng.randint(0, 40))] for c in changed]
        for doc, found in zip(docs, items.find([" ".join(d) for d in docs])):
            held = {i: e for i, w in enumerate(bench) if (e := plain_distance(w, doc)) <= int(D.EDIT_RATE * n)}
            assert {m["item_id"]: m["edits"] for m in found} == held


def test_short_items_keep_to_the_same_rate():
    rng, vocab, _ = made(7)
    bench = [rng.choices(vocab, k=n) for n in range(1, 10) for _ in range(6)]
    items = Items([(i, " ".join(w)) for i, w in enumerate(bench)] + [(90, ""), (91, None)])
    docs = [[*rng.choices(vocab, k=rng.randint(0, 30)), *edited(rng, w, rate), *rng.choices(vocab, k=rng.randint(0, 30))] for w in bench for rate in (0, 0.2)]
    docs += [w[1:] for w in bench] + [w[:-1] for w in bench] + [[*w[: len(w) // 2], "new", *w[len(w) // 2 :]] for w in bench]
    for doc, found in zip(docs, items.find([" ".join(d) for d in docs])):
        held = {i: e for i, w in enumerate(bench) if (e := plain_distance(w, doc)) <= int(D.EDIT_RATE * len(w))}
        assert {m["item_id"]: m["edits"] for m in found} == held
    assert items.find(["", None, " \n"]) == [[], [], []]


def test_long_items_and_long_texts():
    rng, vocab, _ = made(8)
    vocab = vocab + [f"x{i}" for i in range(5000)]
    bench = [rng.choices(vocab, k=n) for n in (25, 49, 73, 400)]
    items = Items([(i, " ".join(w)) for i, w in enumerate(bench)])
    text = rng.choices(vocab, k=60_000)
    want = {}
    for i, w in enumerate(bench):
        at = 10_000 * (i + 1)
        text[at:at] = edited(rng, w, 0.18)
        want[i] = at
    found = {m["item_id"]: m for m in items.find(["", " ".join(text), None])[1]}
    assert found.keys() == want.keys()
    assert all(abs(found[i]["start"] - at) <= int(0.2 * len(bench[i])) and found[i]["edits"] <= int(0.2 * len(bench[i])) for i, at in want.items())


def test_a_phrase_of_all_items_makes_no_candidates():
    rng, vocab, _ = made(9)
    vocab = [f"x{i}" for i in range(4000)]
    phrase = "which of the following".split()
    bench = [[*rng.choices(vocab, k=10), *phrase, *rng.choices(vocab, k=10)] for _ in range(1500)]
    items = Items([(i, " ".join(w)) for i, w in enumerate(bench)])
    docs = [[*rng.choices(vocab, k=50), *phrase, *rng.choices(vocab, k=50)] for _ in range(50)]
    hashed = [D._hashes().of([w.encode() for w in d]) for d in docs]
    edge = np.cumsum([0, *map(len, hashed)])
    assert len(items.candidates(np.concatenate(hashed), edge)[0]) == 0
    assert [[m["item_id"] for m in f] for f in items.find([" ".join(d[:50] + bench[i] + d[50:]) for i, d in enumerate(docs)])] == [[i] for i in range(50)]


def test_equal_windows_always_meet():
    rng = random.Random(10)
    for n in [*range(1, 30), 47, 48, 49, 100]:
        w = [f"v{rng.randrange(30)}" for _ in range(n)]
        items = Items([(1, " ".join(w)), (2, " ".join(w))])
        found = items.find([" ".join([*x, *w, *y]) for x, y in (([], []), (["a", "b"], ["c"]), (w, w))])
        assert [[m["item_id"] for m in f if m["edits"] == 0] for f in found] == [[1, 2]] * 3
