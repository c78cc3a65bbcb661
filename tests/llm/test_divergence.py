import random
import re
from collections import Counter, defaultdict

import duckdb

from quillon.llm.divergence import ORACLES, audit, op11_divergence, terms

SCHEMA = "doc_id long, text string, lang string, source string, n long, value string"


def plain(rows, min_docs=30, ranks=50):
    docs = [(t or "", la or "", so or "") for _, t, la, so, *_ in rows]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t)), la, so) for t, la, so in docs]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for ws, la, so in found:
        df[la].update(set(ws))
        count[la, so].update(ws)
    out = set()
    for la in {la for _, la, _ in found}:
        kept = [t for t, c in df[la].items() if c >= min_docs]
        v, sources = len(kept), sorted({so for _, l2, so in found if l2 == la})
        whole = sum((count[la, so] for so in sources), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * v) for t in kept}  # noqa: B023, E731
        shares, q = {so: p(count[la, so]) for so in sources}, p(whole)
        for so in sources:
            pairs = [(o, sum(abs(shares[so][t] - shares[o][t]) for t in kept)) for o in sources if o != so]
            over = [(t, shares[so][t] - q[t]) for t in kept if count[la, so][t] and shares[so][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", over, ranks)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((la, so, part, item, value, k))
    return out


def made(rng, n):
    vocabulary = [*"alpha beta gamma Delta éa été ÉTÉ 中文 x y".split(), *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "s1", "s2", "é", "", None, "tiny" if i % 40 == 0 else "s3"])
        words = rng.choices(vocabulary, weights=[rng.random() ** (3 if source == "hot" else 1) for _ in vocabulary], k=rng.randint(0, 60))
        rows.append((i, rng.choice([" ", ", ", "_1\n"]).join(words), rng.choice(["en", "en", None, "few"]) if i % 5 else "en", source, i, "x"))
    return rows


def test_terms_are_the_pattern():
    text = "Ab-CD_e9 Éa ÉA z\x7f\x85q `~[]{}@İ"
    assert [t.decode() for t in terms(text)] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_equals_brute_force(spark):
    rows = [*made(random.Random(7), 500), (0, None, "en", "null text", None, None), (0, "", "xx", "a", 1, "v"), (0, "", "xx", "b", 1, "v"), (None, "alpha " * 20_000, "en", "long", 1, "v")]
    rows += [(1, "alpha beta alpha", "en", "copies", 0, "c")] * 300
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for min_docs, ranks in ((30, 5), (1, 50), (10_000, 50)):
        got = audit(docs, min_docs, ranks).collect()
        assert len(got) == len({*map(tuple, got)}) and {*map(tuple, got)} == plain(rows, min_docs, ranks)


def test_counts_flushed_early_add_up(spark, monkeypatch):
    monkeypatch.setattr("quillon.llm.divergence.FLUSH", 3)
    rows = made(random.Random(2), 120)
    assert {*map(tuple, audit(spark.createDataFrame(rows, SCHEMA), 5).collect())} == plain(rows, 5)


def test_empty_table(spark):
    assert audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equals_sql_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    want = duckdb.sql(ORACLES["op11_divergence"].replace("from documents", f"from '{sf}/documents.parquet'")).fetchall()
    got = op11_divergence(spark, sf).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 2000
