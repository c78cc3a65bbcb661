import hashlib
import hmac
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import corpus, ingest, logs


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


SECTION = "act_code string, section_number string, version_no int, section_text string, marginal_note string, category string, valid_from date, valid_to date, embedding array<float>"


def test_screen(spark):
    for t, hit in (("How to k1ll someone", "how to kill"), ("HOW to m@ke a b0mb", "how to make a bomb"), ("h o w  t o  k1ll", None), ("what is the punishment for theft", None), ("hire hitman", "hire hitman")):
        assert one(spark, X.harm_match(F.lit(t))) == hit
    assert one(spark, X.dark_match(F.lit("x How to Poison y"))) == "how to poison"


def test_words_topics_and_json(spark):
    assert one(spark, X.query_words(F.lit("What is the Punishment, for THEFT?? by gang of five thieves today again"))) == ["punishment", "theft", "gang", "five", "thieves", "today"]
    assert one(spark, X.crime_terms(F.lit("My phone was stolen! Theft."))) == ["theft"]
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    for now, before, turns, new, old in ((("theft",), ("theft",), 2, False, False), (("bail",), ("theft",), 4, True, True), ((), (), 4, False, False), ((), ("theft",), 4, True, False), (("theft",), ("theft",), 0, True, True)):
        assert one(spark, X.topic_changed(words(*now), words(*before), F.lit(turns))) is new
        assert one(spark, X.topic_changed(words(*now), words(*before), F.lit(turns), old=True)) is old
    assert one(spark, X.fenced_json(F.lit('x\n```json\n{"a": 1}\n```\ny'))) == '{"a": 1}' and one(spark, X.fenced_json(F.lit(' {"b":2} '))) == '{"b":2}'
    assert one(spark, X.clean_response(F.lit("a ⚠️ b ⚠️ c "))) == "a ⚠️ b" and one(spark, X.clean_response(F.lit('{"filtered_text": "hi "}'))) == "hi"
    assert one(spark, X.confidence(F.lit(0.5))) == 0.75


def test_embedder_and_hash(spark):
    for dim in (768, 10):
        v = one(spark, X.embed(F.lit("The cat the कानून"), dim))
        want = [0.0] * dim
        for w in "the cat the कानून".split():
            want[int(hashlib.md5(w.encode()).hexdigest(), 16) % dim] += 1
        norm = sum(x * x for x in want) ** 0.5
        assert v == pytest.approx([x / norm for x in want], abs=1e-6)
    assert set(one(spark, X.embed(F.lit("  "), 4))) == {0.0}
    assert one(spark, X.ip_hash(F.lit("1.2.3.4"), "key")) == hmac.new(b"key", b"1.2.3.4", hashlib.sha256).hexdigest()[:40] and one(spark, X.ip_hash(F.lit(""), "key")) is None


def test_small_functions(spark):
    assert one(spark, X.action_of(F.lit("/api/v1/legal/query"))) == "legal_query" and one(spark, X.is_audited(F.lit("/api/docs/x"))) is False and one(spark, X.is_audited(F.lit("/api/v1"))) is True
    assert one(spark, X.citations(F.lit("bns  303 and Section 12A of IPC, BNS 303, IPC 420, BNSS Section 7"))) == "bns 303, BNS 303, BNSS Section 7"
    assert one(spark, X.place_hint(F.lit("It happened near the old market, yesterday"))) == "the old market"
    assert one(spark, X.category(F.lit("Hurt and property"))) == "Offences Against Person" and one(spark, X.is_phone(F.lit("9876543210"))) and not one(spark, X.is_email(F.lit("a@b")))
    assert one(spark, X.timestamp_or(F.lit("2024-01-02T03:04:05Z"), F.current_timestamp())) == datetime(2024, 1, 2, 3, 4, 5)


def sections(spark):
    d = date
    return spark.createDataFrame([
        ("IPC", "1", 1, "theft of goods", "Theft", "en", d(2020, 1, 1), d(2022, 1, 1), [1.0, 0.0]), ("IPC", "1", 2, "theft of all goods", "Theft", "en", d(2022, 1, 1), None, [1.0, 0.1]),
        ("BNS", "2", 1, "struck text theft", "Gone", "en", d(2020, 1, 1), None, [1.0, 0.0]), ("BNS", "10", 1, "read text", "Cut", "en", d(2020, 1, 1), None, [0.0, 1.0]),
    ], SECTION)


def test_retrieval(spark):
    s = sections(spark)
    js = spark.createDataFrame([("BNS", "2", "stayed", date(2020, 1, 1)), ("BNS", "2", "struck_down", date(2021, 1, 1)), ("BNS", "10", "read_down", date(2021, 1, 1))], "act_code string, section_number string, status string, decided_on date")
    near = corpus.semantic_search(s, js, [1.0, 0.0], date(2022, 6, 1), "theft").collect()
    assert [(r.act_code, r.version_no, r.recently_amended) for r in near] == [("IPC", 2, True)]
    fallback = corpus.semantic_search(s, js, [-1.0, -1.0], date(2021, 6, 1), "the theft case").collect()
    assert [(r.act_code, r.version_no, r.similarity) for r in fallback] == [("IPC", 1, None)]
    assert corpus.standing(s, js, date(2022, 6, 1), struck_down=True).count() == 3 and corpus.standing(s, js, date(2022, 6, 1), date(2024, 7, 1)).count() == 1
    text = corpus.context(corpus.keyword_search(s, js, "read text", date(2022, 6, 1))).first().context
    assert "BNS Section 10 — Cut:\nread text\n[JUDICIAL NOTE: read down by" in text and text.endswith("--- END RETRIEVED SECTIONS ---")
    assert [r.section_number for r in ingest.in_section_order(s.select("act_code", "section_number").distinct()).collect()] == ["2", "10", "1"]


def test_upsert_and_review(spark):
    s = sections(spark)
    new = spark.createDataFrame([("IPC", "1", "newer", None, date(2023, 1, 1)), ("BNS", "2", "edited", None, date(2020, 1, 1)), ("BNS", "10", "late", None, date(2019, 1, 1)), ("BSA", "9", "first", "T", date(2023, 1, 1))], "act_code string, section_number string, section_text string, marginal_note string, new_valid_from date")
    got = sorted((r.act_code, r.section_number, r.version_no, r.action, r.valid_to) for r in corpus.upsert(s, new).collect())
    assert got == [("BNS", "10", 1, "reject", None), ("BNS", "2", 1, "update", None), ("BSA", "9", 1, "insert", None), ("IPC", "1", 1, "keep", date(2022, 1, 1)), ("IPC", "1", 2, "close", date(2023, 1, 1)), ("IPC", "1", 3, "version", None)]
    staged = corpus.stage_changes(s, new)
    assert staged.count() == 4
    kept = corpus.reject_changes(staged, spark.createDataFrame([("BSA", "9", "no")], "act_code string, section_number string, reason string"))
    after = corpus.approve_changes(s, kept, date(2024, 1, 1))
    assert after.where("action = 'version'").count() == 3 and after.where("act_code = 'BSA'").count() == 0
    lines = sorted(f"{a}:{n}:{v}:{hashlib.sha256(t.encode()).hexdigest()}" for a, n, v, t in (("IPC", "1", 2, "theft of all goods"), ("BNS", "2", 1, "struck text theft"), ("BNS", "10", 1, "read text")))
    snap = corpus.snapshot(s, "x").first()
    assert (snap.section_count, snap.checksum) == (3, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert corpus.snapshot_tree(s, "x").first().checksum == corpus.snapshot_tree(s.repartition(3), "x").first().checksum


LAW = """ARRANGEMENT OF SECTIONS
CHAPTER I
1. Short title.
2. Definitions.
3. Old rule.
CHAPTER I
1. This Act may be called the Sample Act and it extends to the
1. Ins. by Act 21 of 2000, s. 3.
whole of the country for all purposes stated.
2. In this Act unless the context otherwise requires words have their meaning.
3. [Repealed.] Rep. by the Act 4.
STATE AMENDMENT

Tripura.--
2B. Whoever in that state does this or that shall be punished for it duly.
"""


def test_statute(spark):
    docs = spark.createDataFrame([("IPC", "legacy", LAW)], "act_code string, family string, text string")
    cand = ingest.segment(docs)
    best = ingest.longest(cand)
    by = {r.section_number: r for r in best.collect()}
    assert set(by) == {"1", "2", "3", "2B"} and "Ins. by" not in by["1"].section_text and by["1"].section_text.endswith("purposes stated.") and by["3"].is_repealed
    toc = ingest.contents(docs)
    assert sorted(toc.first().expected) == ["1", "2", "3"]
    marked = ingest.state_amendments(best, ingest.amendment_headings(docs), toc)
    assert {r.section_number: r.amendment_of for r in marked.collect()} == {"1": None, "2": None, "3": None, "2B": "Tripura"}
    judged = ingest.verdicts(marked.where("amendment_of is null").drop("amendment_of"))
    assert {r.section_number: r.verdict for r in judged.collect()} == {"1": "accepted", "2": "accepted", "3": "repealed"}
    report = ingest.coverage(judged, toc)
    r = ingest.gate(report).first()
    assert (r.accepted, r.repealed, r.missing, r.unexpected, r.error) == (2, 1, [], [], None)
    ingest.enforce(report)
    with pytest.raises(ingest.GateError):
        ingest.enforce(ingest.coverage(judged.where("section_number <> '2'"), toc))


def test_verdicts(spark):
    rows = [("A", "1", None, "x" * 200, False, 0), ("A", "1", None, "y" * 200, False, 9), ("A", "2", None, "Ins. by Act 3 of the year and more", False, 1), ("A", "3", None, "short", False, 2), ("A", "4", "A long enough title here", "A long, enough TITLE (here).", False, 3), ("A", "5", None, "between twenty and 150 characters", False, 4), ("A", "6", None, "gone", True, 5)]
    out = ingest.verdicts(spark.createDataFrame(rows, ingest.SECTIONS))
    assert {(r.section_number, r.char_start): (r.verdict, r.short) for r in out.collect()} == {("1", 0): ("accepted", False), ("1", 9): ("duplicate", False), ("2", 1): ("footnote_shaped", False), ("3", 2): ("near_empty", False), ("4", 3): ("title_echo", False), ("5", 4): ("accepted", True), ("6", 5): ("repealed", False)}
    highest = spark.createDataFrame([("A", 7)], "act_code string, highest int")
    none = spark.createDataFrame([("A", None)], "act_code string, expected array<string>")
    r = ingest.gate(ingest.coverage(out, none, highest)).first()
    assert r.expected_source == "range_fallback" and r.missing == ["2", "3", "4", "7"] and r.rejection_rate == pytest.approx(4 / 7) and "rate" in r.error


def test_provenance_and_dates(spark):
    docs = spark.createDataFrame([("A", "t"), ("B", "t"), ("C", "t"), ("D", "t")], "act_code string, text string")
    m = spark.createDataFrame([("A", "act", hashlib.sha256(b"t").hexdigest()), ("B", "bill", None), ("C", "act", "00")], "act_code string, document_type string, sha256 string")
    assert {r.act_code: r.provenance for r in ingest.provenance(docs, m).collect()} == {"A": "ok", "B": "not an act", "C": "checksum differs", "D": "unknown act"}
    d = F.lit(None).cast("date")
    assert one(spark, ingest.resolve_valid_from(d, F.lit(date(2020, 1, 1)))) == date(2020, 1, 1)
    with pytest.raises(Exception, match="valid_from"):
        one(spark, ingest.resolve_valid_from(d, d))


def test_logs(spark):
    t = datetime(2024, 1, 1, 12)
    e = spark.createDataFrame([(1, t - timedelta(minutes=i)) for i in range(5)] + [(2, t), (3, t - timedelta(days=99))], "user_id int, ts timestamp")
    assert [tuple(r) for r in logs.over_rate(e, "user_id", t, 3).collect()] == [(1, 5)]
    assert logs.retain(e, t).count() == 6 and logs.listing(e, "ts", 2, 4).count() == 3
    assert logs.flag(e, logs.over_rate(e, "user_id", t, 3), "user_id", "r").where("is_flagged").count() == 5


def test_bulk_ingest_keeps_failures_apart(spark):
    import hashlib
    from datetime import date

    from quillon.operators import corpus, ingest

    body = "Whoever does a thing that this section names shall be punished with a fine. "
    text = lambda gap: "ARRANGEMENT OF SECTIONS\nCHAPTER I\n" + "\n".join(f"{i}. Title" for i in range(1, 21)) + "\nCHAPTER I\n" + "\n".join(f"{i}. {body}" for i in range(1, 21) if i != gap)
    acts = [("A", "gazette", text(0)), ("B", "gazette", text(0)), ("C", "gazette", ""), ("D", "gazette", text(0)), ("E", "gazette", text(0))]
    docs = spark.createDataFrame(acts, "act_code string, family string, text string")
    known = spark.createDataFrame([("A", "act", hashlib.sha256(acts[0][2].encode()).hexdigest()), ("B", "rule", None), ("C", "act", None), ("D", "act", "00")], "act_code string, document_type string, sha256 string")
    sections, outcome = ingest.bulk_ingest(docs, known, date(2024, 1, 1))
    got = {r.act_code: r.error for r in outcome.collect()}
    assert got["B"] == "not an act" and got["C"] == "no sections" and got["D"] == "checksum differs" and got["E"] == "unknown act"
    # The contents' own lines are candidates of their numbers, too, so act A is rejected for its share of rejected rows.
    assert got["A"] == "rejection rate over the limit" and sections.count() == 0
    loose = spark.createDataFrame([("A", "gazette", "\n".join(f"{i}. {body}" for i in range(1, 21)))], "act_code string, family string, text string")
    highest = spark.createDataFrame([("A", 20)], "act_code string, highest int")
    sections, outcome = ingest.bulk_ingest(loose, spark.createDataFrame([("A", "act", None)], "act_code string, document_type string, sha256 string"), date(2024, 1, 1), highest)
    assert [tuple(r) for r in outcome.collect()] == [("A", None)] and sections.count() == 20
    none = spark.createDataFrame([], "act_code string, section_number string, version_no int, section_text string, marginal_note string, valid_from date, valid_to date")
    assert corpus.upsert(none, sections).where("action = 'insert'").count() == 20


def test_place_numbers_all_rows_in_order(spark):
    from quillon.operators.ordering import place

    rows = [(k * 7919 % 1009, [float(k % 13), 1.0]) for k in range(1009)]
    out = place(spark.createDataFrame(rows, "id long, v array<float>").repartition(7), "v", "id").collect()
    want = {i: n for n, (_, i) in enumerate(sorted((v, i) for i, v in rows), 1)}
    assert {r.id: r.place for r in out} == want
    assert place(spark.createDataFrame([], "id long"), "id").count() == 0


def test_embedder_equals_a_plain_one(spark):
    import hashlib

    from quillon.functions import text as X

    texts = ["the cat the hat", "", "  ", None, "one", "A a A b\tc\nd " * 300]
    for dim in (7, 768):
        out = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.embed("t", dim).alias("v")).orderBy("i").collect()]
        for t, v in zip(texts, out):
            want = [0.0] * dim
            for w in (t or "").lower().split():
                want[int(hashlib.md5(w.encode()).hexdigest(), 16) % dim] += 1
            norm = sum(x * x for x in want) ** 0.5
            assert v is None if t is None else all(abs(a - (b / norm if norm else 0)) < 1e-6 for a, b in zip(v, want)) and len(v) == dim
