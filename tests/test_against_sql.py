"""Queries over odd tables against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

#: Texts of no word, of one, of four short lines: in every class of ids that the queries tell apart.
ODD = ["", None, " ", "A", "A.", "Re.", "One.\nTwo.\nThree.\nFour.", "x, ibid", "Abcde fgh.\n" * 30]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(k * 10 + i + 3 * (k % 2), t) for k in range(45) for i, t in enumerate(ODD)]
    rows = list({i: (i, t) for i, t in rows}.values())
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def same(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    want = sorted(map(repr, con.execute(entry.oracle_sql()[name]).fetchall()))
    assert sorted(repr(tuple(r)) for r in entry.queries()[name](spark, folder).collect()) == want


def test_statute_contents(spark, odd):
    same(spark, odd, "statute_contents")


def test_statute_ingest(spark, odd):
    same(spark, odd, "statute_ingest")


def test_section_gate(spark, odd):
    same(spark, odd, "section_gate")


def test_section_verdicts(spark, odd):
    same(spark, odd, "section_verdicts")
