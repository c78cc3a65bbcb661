from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.operators import corpus, ingest
from quillon.sources.ledger import Conflict, Ledger
from quillon.streaming.rates import rates_from_files, review_from_files

SECTION = "act_code string, section_number string, version_no int, section_text string, marginal_note string, valid_from date, valid_to date"


def test_publications_are_whole(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/l")
    assert ledger.read("a") is None and ledger.versions() == []
    one = ledger.publish({"a": spark.range(2).toDF("x"), "b": spark.range(1).toDF("y")}, "first")
    two = ledger.publish({"a": spark.range(5).toDF("x")}, "second", one)
    assert (one, two) == (1, 2) and ledger.read("a").count() == 5 and ledger.read("a", 1).count() == 2 and ledger.read("b").count() == 1
    with pytest.raises(Exception):
        ledger.publish({"a": spark.range(9).toDF("x"), "b": spark.range(3).select(F.raise_error(F.lit("broken")).alias("y"))}, "broken")
    assert ledger.read("a").count() == 5 and ledger.manifest()["note"] == "second"
    with pytest.raises(Conflict):
        ledger.publish({"a": spark.range(1).toDF("x")}, "late", one)
    assert ledger.publish({"c": spark.range(3).where("id > 5").toDF("z")}) == 3 and ledger.read("c").count() == 0


LAW = "ARRANGEMENT OF SECTIONS\nCHAPTER I\n1. Title\n2. Title\nCHAPTER I\n1. Whoever does this is liable under this act.\n2. Whoever does that is liable under this act as well."


def test_acts_that_fail_hold_up_no_others(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/l")
    docs = lambda *rows: spark.createDataFrame([(a, "legacy", t) for a, t in rows], "act_code string, family string, text string")
    known = spark.createDataFrame([(a, "act", None) for a in ("A", "B", "C")], "act_code string, document_type string, sha256 string")
    bad = LAW.replace("CHAPTER I\n1. Whoever", "3. Los\nCHAPTER I\n1. Whoever")
    run = lambda label, *rows, day=date(2024, 1, 1): ingest.ingest_into(ledger, docs(*rows), known, day, label)
    assert run("one", ("A", LAW), ("B", bad), ("X", LAW)) == 1
    errors = lambda: {r.act_code: r.error for r in ledger.read("ingested").collect()}
    assert errors() == {"A": None, "B": "1 sections missing", "X": "unknown act"} and ledger.read("sections").count() == 2
    assert run("again", ("A", LAW), ("B", bad), ("X", LAW)) == 1  # nothing new
    assert run("mended", ("A", LAW), ("B", LAW), ("C", LAW)) == 2 and errors()["B"] is None and ledger.read("sections").count() == 6
    assert run("amended", ("A", LAW.replace("this act.", "this new act.")), day=date(2025, 1, 1)) == 3
    rows = {(r.section_number, r.version_no): r.valid_to for r in ledger.read("sections").where("act_code = 'A'").collect()}
    assert rows == {("1", 1): date(2025, 1, 1), ("1", 2): None, ("2", 1): date(2025, 1, 1), ("2", 2): None}
    shots = {r.label: r.section_count for r in ledger.read("snapshots").collect()}
    assert shots == {"one": 2, "mended": 6, "amended": 6}


def test_linked_approvals(spark):
    d = date
    cols = SECTION + ", version_id string, superseded_by string, amended_by string"
    current = spark.createDataFrame([("A", "1", 1, "old", "n", d(2020, 1, 1), d(2021, 1, 1), "A:1:1", "A:1:2", None), ("A", "1", 2, "now", "n", d(2021, 1, 1), None, "A:1:2", None, None), ("A", "2", 1, "x", None, d(2023, 1, 1), None, "A:2:1", None, None), ("A", "4", 3, "gone", None, d(2020, 1, 1), d(2021, 1, 1), "A:4:3", None, None)], cols)
    none = spark.createDataFrame([], "amendment_id string, amending_act string, gazette_ref string, effective_from date, summary string")
    staged = spark.createDataFrame([("A", n, f"new {n}", "s", "pending") for n in "1234"] + [("A", "5", "no", "s", "rejected")], "act_code string, section_number string, staged_text string, summary string, status string")
    say = spark.createDataFrame([("A", "1", d(2024, 1, 1), "Act 9", "G"), ("A", "2", d(2022, 1, 1), "Act 9", "G"), ("A", "3", d(2024, 1, 1), "Act 9", "G"), ("A", "4", d(2024, 1, 1), None, None), ("A", "5", d(2024, 1, 1), None, None)], "act_code string, section_number string, effective_from date, amending_act string, gazette_ref string")
    versions, amendments, after = corpus.approve_linked(current, none, staged, say)
    got = {r.version_id: (r.valid_to, r.superseded_by, r.amended_by is not None, r.marginal_note, r.section_text) for r in versions.collect()}
    assert got == {
        "A:1:1": (d(2021, 1, 1), "A:1:2", False, "n", "old"), "A:1:2": (d(2024, 1, 1), "A:1:3", False, "n", "now"), "A:1:3": (None, None, True, "n", "new 1"), "A:2:1": (None, None, False, None, "x"),
        "A:3:1": (None, None, True, None, "new 3"), "A:4:3": (d(2021, 1, 1), None, False, None, "gone"), "A:4:4": (None, None, False, None, "new 4"),
    }
    assert [(r.amending_act, r.summary) for r in amendments.collect()] == [("Act 9", "2 sections")]
    assert {r.section_number: r.status for r in after.collect()} == {"1": "approved", "2": "pending", "3": "approved", "4": "approved", "5": "rejected"}
    again = corpus.approve_linked(versions, amendments, after, say)
    assert again[0].count() == 7 and again[1].count() == 1


def test_as_of_merge_of_hot_sections(spark):
    base = date(2020, 1, 1)
    day = lambda n: base + timedelta(days=n)
    versions = [("A", "1", k + 1, f"t{k}", None, day(50 * k), day(50 * k + 50) if k < 5 else None) for k in range(6) if k != 2] + [("A", "2", 1, "u", None, day(10), day(20)), ("B", "1", 1, "w", None, day(0), None), (None, "1", 1, "null", None, day(0), None), ("A", "9", 1, "no start", None, None, None)]
    events = [(i, "A", "1", day(i * 7 % 400 - 20), "x") for i in range(600)] + [(1000 + i, "A", "1", day(77), "x") for i in range(300)] + [(2000 + i, "A", "2", day(i), "y") for i in range(30)]
    events += [(3000, None, "1", day(5), ""), (3001, "A", None, day(5), ""), (3002, "A", "1", None, ""), (3003, "C", "1", day(5), ""), (3004, "A", "9", day(5), "")]
    e = spark.createDataFrame(events, "event int, act_code string, section_number string, day date, note string").repartition(3)
    s = spark.createDataFrame(versions, SECTION)
    want = sorted((i, next((v[2] for v in versions if v[0] is not None and (v[0], v[1]) == (a, n) and at is not None and v[5] is not None and v[5] <= at and (v[6] is None or at < v[6])), None)) for i, a, n, at, _ in events)
    for rows in (50_000, 100, 20):
        out = corpus.as_of_join(e, s, "day", rows)
        assert out.columns == ["event", "act_code", "section_number", "day", "note", "version_no", "section_text", "marginal_note", "valid_from", "valid_to"]
        assert sorted((r.event, r.version_no) for r in out.collect()) == want or sorted(((r.event, r.version_no) for r in out.collect()), key=str) == sorted(want, key=str)
    assert corpus.as_of_join(e.limit(0), s, "day").count() == 0 and corpus.as_of_join(e, s.limit(0), "day").where("version_no is null").count() == len(events)


def test_as_of_merge_cuts_hot_sections(spark):
    e = spark.range(5000).select(F.lit("A").alias("act_code"), F.lit("1").alias("section_number"), F.expr("date_add(date'2020-01-01', if(id < 2500, 5, cast(id % 300 as int)))").alias("day"), "id")
    s = spark.createDataFrame([("A", "1", 1, "t", None, date(2020, 1, 3), None)], SECTION)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = corpus.as_of_join(e, s, "day", 200).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in sizes) == 5000 and max(r["count"] for r in sizes) < 1500


def test_flat_ingest(spark):
    good = "preface\n1. (1) On theft of things\nand more of it\n\n 2.  On bail  and   fine\n text\n3. Short\n1. Again on number one here"
    lines = "x\n7. Hurt\n a line \n\n8. On\nend"
    docs = spark.createDataFrame([("A", good), ("B", lines), ("C", None), ("D", ""), ("E", "no header at all")], "act_code string, text string")
    old = spark.createDataFrame([("A", "2", "kept", "kept", ["k"], "c")], "act_code string, section_number string, title string, section_text string, keywords array<string>, category string")
    out = {(r.act_code, r.section_number): r for r in ingest.flat_ingest(docs, old).collect()}
    assert set(out) == {("A", "1"), ("A", "2"), ("B", "7"), ("B", "8")}
    a = out["A", "1"]
    assert (a.title, a.section_text, a.keywords, a.category) == ("On theft of things", "1. (1) On theft of things and more of it", ["theft"], "Offences Against Property")
    assert out["A", "2"].title == "kept" and (out["B", "7"].section_text, out["B", "7"].category) == ("7. Hurt a line", "Offences Against Person") and out["B", "8"].section_text == "8. On end"


def test_rates_of_a_stream_with_late_rows(spark, tmp_path):
    schema = "user_id int, ts timestamp_ntz"

    def add(name, *rows):
        spark.createDataFrame(rows, "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")

    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(schema)
    run = lambda: {(r.user_id, str(r.start)[:16], r.n) for r in rates_from_files(spark, f"{tmp_path}/in/*", schema, "user_id", f"{tmp_path}/out", most=1, files=1).collect()}
    add("a", (1, "2024-01-01 10:05:00"), (1, "2024-01-01 10:50:00"), (2, "2024-01-01 10:10:00"))
    assert run() == set()  # the hour is still open
    add("b", (2, "2024-01-01 10:59:00"), (3, "2024-01-01 11:05:00"))  # late, but within the ten minutes
    add("c", (9, "2024-01-01 13:00:00"))
    assert run() == {(1, "2024-01-01 10:00", 2), (2, "2024-01-01 10:00", 2)}
    add("d", (1, "2024-01-01 10:20:00"), (3, "2024-01-01 11:10:00"), (9, "2024-01-01 13:01:00"), (9, "2024-01-01 18:00:00"))  # windows that are closed
    assert run() == {(1, "2024-01-01 10:00", 2), (2, "2024-01-01 10:00", 2), (9, "2024-01-01 13:00", 2)}


def test_review_of_a_stream(spark, tmp_path):
    current = spark.createDataFrame([("A", "1", "old", None)], "act_code string, section_number string, section_text string, valid_to date")
    fetch = lambda *rows: spark.createDataFrame(rows, "act_code string, section_number string, section_text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/f")
    run = lambda: sorted((r.section_number, r.staged_text) for r in review_from_files(spark, f"{tmp_path}/f", lambda: current, f"{tmp_path}/q", 1).collect())
    fetch(("A", "1", "old"), ("A", "2", "x"))
    assert run() == [("2", "x")]
    fetch(("A", "1", "new"))
    assert run() == [("1", "new"), ("2", "x")] == run()


def test_rejections_keep_their_reason(spark):
    staged = spark.createDataFrame([("A", "1", "t", "s", "pending"), ("A", "2", "t", "s", "pending"), ("A", "3", "t", "s", "approved")], "act_code string, section_number string, staged_text string, summary string, status string")
    out = corpus.reject_changes(staged, spark.createDataFrame([("A", "1", "no"), ("A", "3", "late")], "act_code string, section_number string, reason string"))
    assert sorted((r.section_number, r.status, r.reason) for r in out.collect()) == [("1", "rejected", "no"), ("2", "pending", None), ("3", "approved", None)]
