"""From statute texts to validated sections: segmentation, contents, verdicts, coverage and the gate."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quillon.functions.text import category, keywords, section_order
from quillon.operators.corpus import snapshot_tree, upsert
from quillon.sources.ledger import Ledger
from quillon.sources.tables import seed

# Fixed values.
HEADER_GAZETTE = r"(?:^|\n)(?:[A-Z][^\n]{0,80}\s)?(\d{1,3}[A-Z]{0,2})\.(?=[\sA-Z(])"
HEADER_LEGACY = r"(?:^|\n)\s*(\d{1,3}[A-Z]{0,2})(?:\.\s+(?:\(1\)\s+)?|\s+(?=[“\"'―]))([^\n]{5,200})"
FOOTNOTE = (
    r"(?i)\b(?:Ins|Subs|Rep|Repealed|Omitted|Added)\b\.?[^\n]{0,40}?\bby\s+(?:Act\s+\d|the\s+A\.?\s*O\.?|s\.?\s*\d)|,\s*ibid\b",
    r"(?i)\bvide notification\b|\bw\.e\.f\.?\b|\bsee Gazette of India\b|\bS\.O\.\s*\d|\bG\.S\.R\.\s*\d",
    r"(?i)\bhas been (?:extended|declared)\b|\b(?:extended|declared) under s\.\s*\d",
)
REPEALED = r"(?i)^\d{1,3}[A-Z]{0,2}\.?\s*(?:to\s+\d{1,3}[A-Z]?\.?\s*)?(?:\[[^\]\n]{0,60}\]\.?\s*(?:Rep\.|Repealed|Omitted)|\[?\s*(?:Rep\.|Repealed|Omitted))"
FOOTNOTE_START = ("Ins. by", "Subs. by", "Rep. by", "Added by", "Omitted by", "Omitted,")
CONTENTS = r"(?i)ARRANGEMENT OF (?:SECTIONS|CLAUSES)"
CONTENTS_ENTRY = r"(?:^|\n)\s*(\d{1,3}[A-Z]{0,2})\.\s*\S"
REPEALED_RANGE = r"(\d{1,3}[A-Z]{0,2})\.\s+to\s+(\d{1,3}[A-Z]?)\."
NEAR_EMPTY, SHORT, SCAN, LONGEST, REJECTED_SHARE = 20, 150, 220, 5000, 0.05

SECTIONS = "act_code string, section_number string, section_title string, section_text string, is_repealed boolean, char_start long"


def is_footnote(prefix: Column | str) -> Column:
    """Whether the first 220 characters read like an editorial note."""
    t = F.substring(prefix, 1, SCAN)
    return t.rlike(FOOTNOTE[0]) | t.rlike(FOOTNOTE[1]) | t.rlike(FOOTNOTE[2])


def cut(text: str, legacy: bool) -> Iterator[tuple[str, str | None, str, bool, int]]:
    """The sections of one text: (number, title, body, repealed, place of the header).

    Editorial notes that look like headers end no section: their line is left out of the section around them.
    """
    if legacy:
        text = re.sub(r"(?<=\n)\d{1,2}\[", "", text)
    heads = list(re.finditer(HEADER_LEGACY if legacy else HEADER_GAZETTE, text))
    note = lambda m: any(re.search(p, (m.group(2) if legacy else text[m.start() : m.start() + 260])[:SCAN]) for p in FOOTNOTE)
    marked = [(m, note(m)) for m in heads]
    starts = [m.start() for m in heads] + [len(text)]
    current: re.Match | None = None
    kept: list[str] = []

    def section():
        body = re.sub(r"\s+", " ", "".join(kept)).strip()[:LONGEST]
        if current is not None and body:
            title = re.sub(r"\s+", " ", current.group(2)).strip()[:500] if legacy else None
            yield current.group(1), title, body, legacy and bool(re.match(REPEALED, body)), current.start()

    for (m, is_note), stop in zip(marked, starts[1:]):
        if is_note:
            line_end = text.find("\n", m.end())
            kept.append(text[min(line_end if line_end >= 0 else len(text), stop) : stop])
        else:
            yield from section()
            current, kept = m, [text[m.start() : stop]]
    yield from section()


def segment(documents: DataFrame) -> DataFrame:
    """documents(act_code, family ('gazette' or 'legacy'), text) -> candidate sections in order of place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d.act_code, *s) for d in b.itertuples() for s in cut(d.text or "", d.family == "legacy")]
            yield pd.DataFrame(rows, columns=["act_code", "section_number", "section_title", "section_text", "is_repealed", "char_start"])

    return documents.select("act_code", "family", "text").mapInPandas(run, SECTIONS)


def longest(candidates: DataFrame) -> DataFrame:
    """One candidate for each number: the longest text, the first of equals."""
    w = Window.partitionBy("act_code", "section_number").orderBy(F.length("section_text").desc(), "char_start")
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def contents_text(text: Column | str) -> Column:
    """What stands between the contents' heading and the second CHAPTER I behind it, also if nothing follows that; NULL if that has no end."""
    t = F.col(text) if isinstance(text, str) else text
    rest = F.regexp_extract(t, rf"(?s){CONTENTS}(.*)$", 1)
    parts = F.split(rest, r"\nCHAPTER I(?=\n|\z)")
    return F.when(t.rlike(CONTENTS) & (F.size(parts) > 2), F.concat_ws("\nCHAPTER I", parts[0], parts[1]))


def contents(documents: DataFrame) -> DataFrame:
    """act_code, expected (numbers in the document's own contents, or NULL), repealed_ranges."""
    numbers = F.array_distinct(F.regexp_extract_all(contents_text("text"), F.lit(CONTENTS_ENTRY), F.lit(1)))
    ranges = F.arrays_zip(F.regexp_extract_all("text", F.lit(REPEALED_RANGE), F.lit(1)).alias("first"), F.regexp_extract_all("text", F.lit(REPEALED_RANGE), F.lit(2)).alias("last"))
    return documents.select("act_code", numbers.alias("expected"), ranges.alias("repealed_ranges"))


def amendment_headings(documents: DataFrame) -> DataFrame:
    """act_code, pos, heading: where a state amendment begins and whose it is (the next line that is not blank)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d in b.itertuples():
                for m in re.finditer(r"(?m)^[ \t]*STATE AMENDMENT[ \t]*$", d.text or ""):
                    lines = [x.strip() for x in d.text[m.end() : m.end() + 200].splitlines() if x.strip()]
                    rows.append((d.act_code, m.start(), lines[0].rstrip(".—–- ").strip() if lines else ""))
            yield pd.DataFrame(rows, columns=["act_code", "pos", "heading"])

    return documents.select("act_code", "text").mapInPandas(run, "act_code string, pos long, heading string")


def state_amendments(sections: DataFrame, headings: DataFrame, expected: DataFrame) -> DataFrame:
    """sections with `amendment_of`: the heading between an unlisted section and the nearest listed one before it, else NULL.

    One pass over headings and sections in order of place: the last listed section and the last heading so far.
    """
    listed = sections.join(expected.select("act_code", "expected"), "act_code", "left").withColumn("_listed", F.coalesce(F.array_contains("expected", F.col("section_number")), F.col("expected").isNull()))
    line = listed.withColumn("_at", F.col("char_start")).withColumn("_kind", F.lit(1)).unionByName(headings.select("act_code", F.col("pos").alias("_at"), F.lit(0).alias("_kind"), F.col("heading").alias("_heading")), allowMissingColumns=True)
    w = Window.partitionBy("act_code").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn("_real", F.max(F.when(F.col("_listed"), F.col("_at"))).over(w)).withColumn("_head", F.max(F.when(F.col("_kind") == 0, F.struct("_at", "_heading"))).over(w))
    inside = ~F.col("_listed") & (F.col("_head._at") > F.coalesce("_real", F.lit(-1)))
    return line.where("_kind = 1").withColumn("amendment_of", F.when(inside, F.col("_head._heading"))).select(*sections.columns, "amendment_of")


def bare(t: Column | str) -> Column:
    """Letters, digits and underscores of a text, lower case."""
    return F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}_]+", ""))


def verdicts(sections: DataFrame) -> DataFrame:
    """sections with verdict (accepted, repealed, duplicate, footnote_shaped, near_empty or title_echo) and short.

    A number is taken by its first accepted or repealed row; later rows of it are duplicates.
    """
    footnote = F.exists(F.array(*map(F.lit, FOOTNOTE_START)), lambda p: F.startswith(F.ltrim("section_text"), p))
    echo = (bare("section_title") != "") & (bare("section_title") == bare("section_text"))
    alone = F.when(footnote, "footnote_shaped").when(F.col("is_repealed"), "repealed").when(F.length("section_text") < NEAR_EMPTY, "near_empty").when(F.coalesce(echo, F.lit(False)), "title_echo").otherwise("accepted")
    before = Window.partitionBy("act_code", "section_number").orderBy("char_start").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.max(F.col("_alone").isin("accepted", "repealed").cast("int")).over(before), F.lit(0))
    out = sections.withColumn("_alone", alone)
    verdict = F.when(taken == 1, "duplicate").otherwise(F.col("_alone"))
    return out.withColumn("verdict", verdict).withColumn("short", (F.col("verdict") == "accepted") & (F.length("section_text") < SHORT)).drop("_alone")


def coverage(judged: DataFrame, expected: DataFrame, highest: DataFrame | None = None) -> DataFrame:
    """For each act: counts, rejected share, what the expected numbers come from, and what is missing or unexpected.

    highest(act_code, highest): the greatest known number, for acts without contents.
    """
    num = lambda kind: F.collect_set(F.when(kind, F.col("section_number")))
    acc, rep = F.col("verdict") == "accepted", F.col("verdict") == "repealed"
    by = judged.groupBy("act_code").agg(F.count_if(acc).alias("accepted"), F.count_if(rep).alias("repealed"), F.count_if(~(acc | rep)).alias("rejected"), num(acc).alias("_acc"), num(rep).alias("_rep"))
    out = by.join(expected.select("act_code", F.col("expected").alias("_toc")), "act_code", "left")
    out = out.join(highest, "act_code", "left") if highest is not None else out.withColumn("highest", F.lit(None).cast("int"))
    range_ = F.transform(F.sequence(F.lit(1), F.col("highest")), lambda i: i.cast("string"))
    out = out.withColumn("_exp", F.coalesce("_toc", F.when(F.col("highest") > 0, range_)))
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(F.coalesce(F.regexp_extract(s, r"^(\d+)", 1).try_cast("int"), F.lit(0)).alias("n"), s.alias("s")))), lambda x: x["s"])
    total = F.col("accepted") + F.col("repealed") + F.col("rejected")
    return out.select(
        "act_code", "accepted", "repealed", "rejected", F.coalesce(F.try_divide("rejected", total), F.lit(0.0)).alias("rejection_rate"),
        F.when(F.col("_toc").isNotNull(), "toc").when(F.col("_exp").isNotNull(), "range_fallback").otherwise("unavailable").alias("expected_source"),
        order(F.array_except(F.array_except("_exp", "_acc"), "_rep")).alias("missing"), order(F.array_except("_acc", "_exp")).alias("unexpected"),
    )


class GateError(Exception):
    """An act does not pass."""


def gate(report: DataFrame) -> DataFrame:
    """The report with `error`: why an act must not be stored, or NULL. Unexpected numbers are no reason."""
    rate = F.when(F.col("rejection_rate") > REJECTED_SHARE, F.lit("rejection rate over the limit"))
    unknown = F.when(F.col("expected_source") == "unavailable", F.lit("expected numbers unknown"))
    gap = F.when(F.size("missing") > 0, F.concat(F.size("missing").cast("string"), F.lit(" sections missing")))
    return report.withColumn("error", F.coalesce(rate, unknown, gap))


def enforce(report: DataFrame) -> None:
    """Raise GateError for the first act, by code, that has an error."""
    bad = gate(report).where("error is not null").orderBy("act_code").first()
    if bad:
        raise GateError(f"{bad.act_code}: {bad.error}")


def provenance(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """documents(act_code, text) with `provenance`: ok, or why not. manifest(act_code, document_type, sha256 or NULL)."""
    m = manifest.select("act_code", F.col("document_type").alias("_type"), F.col("sha256").alias("_sha"), F.lit(True).alias("_known"))
    out = documents.join(m, "act_code", "left")
    differs = F.col("_sha").isNotNull() & (F.col("_sha") != F.sha2(F.col("text").cast("binary"), 256))
    return out.withColumn("provenance", F.when(F.col("_known").isNull(), "unknown act").when(~F.col("_type").eqNullSafe("act"), "not an act").when(differs, "checksum differs").otherwise("ok")).drop("_type", "_sha", "_known")


def bulk_ingest(documents: DataFrame, manifest: DataFrame, valid_from: date, highest: DataFrame | None = None, keep_longest: bool = False, stage: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All acts at once: provenance, segmentation, verdicts, coverage and the gate.

    keep_longest: of the candidates for a number only the longest is judged, so entries of the contents do not stand against sections.
    stage: a new path where the judged sections are written, so that texts are parsed once.

    Returns the sections to upsert (act_code, section_number, section_text, marginal_note, new_valid_from) of the acts that pass, and
    for every act its error or NULL: one that fails keeps no other from being stored.
    """
    known = provenance(documents, manifest)
    ok = known.where("provenance = 'ok'").drop("provenance")
    judged = verdicts(longest(segment(ok)) if keep_longest else segment(ok))
    if stage:
        judged.write.parquet(stage)
        judged = documents.sparkSession.read.schema(judged.schema).parquet(stage)
    passed = gate(coverage(judged, contents(ok), highest)).select("act_code", F.col("error").alias("_gate"), F.lit(True).alias("_any"))
    out = known.select("act_code", "provenance").join(passed, "act_code", "left")
    error = F.when(F.col("provenance") != "ok", F.col("provenance")).when(F.col("_any").isNull(), "no sections").otherwise(F.col("_gate"))
    sections = judged.where("verdict = 'accepted'").join(passed.where("_gate is null").select("act_code"), "act_code", "left_semi")
    rows = sections.select("act_code", "section_number", "section_text", F.col("section_title").alias("marginal_note"), F.lit(valid_from).alias("new_valid_from"))
    return rows, out.select("act_code", error.alias("error"))


VERSIONS = "act_code string, section_number string, version_no int, section_text string, marginal_note string, valid_from date, valid_to date"


def ingest_into(ledger: Ledger, documents: DataFrame, manifest: DataFrame, valid_from: date, label: str, highest: DataFrame | None = None) -> int:
    """Bulk ingestion into the ledger's tables: sections, snapshots (label, section_count, checksum) and ingested (act_code, text_sha256, error).

    Acts whose text was stored before are left out, so a rerun, or a run after one that broke off, takes up what is left; one that
    is stored changes nothing. Acts that fail are noted with their error and tried again next time (without a publication if all
    fail as they did), and keep no other from being published. All tables appear at once, with a snapshot of the open versions. Returns the number of the publication; that of
    the last one if there was nothing to do.
    """
    spark, base = documents.sparkSession, ledger.manifest()["number"]
    old = ledger.read("sections")
    current = old if old is not None else spark.createDataFrame([], VERSIONS)
    done = ledger.read("ingested")
    done = done if done is not None else spark.createDataFrame([], "act_code string, text_sha256 string, error string")
    hashed = documents.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    todo = hashed.join(done.where("error is null").select("act_code", "text_sha256"), ["act_code", "text_sha256"], "left_anti")
    if todo.isEmpty():
        return base
    new, outcome = bulk_ingest(todo.drop("text_sha256"), manifest, valid_from, highest, keep_longest=True, stage=f"{ledger.path}/data/judged-{uuid.uuid4().hex}")
    noted = todo.select("act_code", "text_sha256").join(outcome, "act_code").select(*done.columns)
    if noted.exceptAll(done).isEmpty():
        return base
    kept = done.join(noted.select("act_code"), "act_code", "left_anti").unionByName(noted.select("act_code", "text_sha256", "error"))
    staged = f"{ledger.path}/data/staged-{uuid.uuid4().hex}"  # the snapshot is taken of what is stored
    upsert(current, new).drop("action").write.parquet(staged)
    after = spark.read.parquet(staged)
    shots = ledger.read("snapshots")
    shot = snapshot_tree(after, label)
    return ledger.publish({"sections": after, "ingested": kept, "snapshots": shot if shots is None else shots.unionByName(shot)}, label, base)


#: Fixed values.
FLAT_HEADER = r"(?:^|\n)\s*(\d{1,3}[A-Z]?)\.\s+(?:\(1\)\s+)?([^\n]{5,200})"
LINE_HEADER = r"^(\d{1,3}[A-Z]?)\.\s+(.+)"
FLAT_LEAST, FLAT_TITLE, FLAT_TEXT, FLAT_KEYWORDS = 20, 500, 5000, 10


@udtf(returnType="section_number string, title string, section_text string, place int")
class FlatSections:
    """The sections of a text by the pattern of their headers: a table function for a lateral join."""

    def eval(self, text: str):
        heads = list(re.finditer(FLAT_HEADER, text or "", re.MULTILINE))
        for i, (head, end) in enumerate(zip(heads, [*(m.start() for m in heads[1:]), len(text or "")])):
            body = re.sub(r"\s+", " ", text[head.start() : end].strip())
            if len(body) > FLAT_LEAST:
                yield head.group(1), re.sub(r"\s+", " ", head.group(2).strip())[:FLAT_TITLE], body[:FLAT_TEXT], i


def by_lines(documents: DataFrame) -> DataFrame:
    """act_code, section_number, title, section_text, place: a running header over the lines that are not blank."""
    lines = documents.select("act_code", F.posexplode(F.split("text", "\n")).alias("at", "raw")).select("act_code", "at", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("line")).where("line <> ''")
    head = F.col("line").rlike(LINE_HEADER)
    so_far = Window.partitionBy("act_code").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("place", F.sum(head.cast("int")).over(so_far) - 1).where("place >= 0")
    by = lines.groupBy("act_code", "place").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("l"))
    first = F.col("l")[0]["line"]
    body = F.array_join(F.transform("l", lambda x: x["line"]), " ")
    return by.select("act_code", F.regexp_extract(first, LINE_HEADER, 1).alias("section_number"), F.substring(F.regexp_extract(first, LINE_HEADER, 2), 1, FLAT_TITLE).alias("title"), body.alias("section_text"), F.col("place").cast("int"))


def flat_ingest(documents: DataFrame, existing: DataFrame) -> DataFrame:
    """existing(act_code, section_number, title, section_text, keywords, category) and the sections of documents(act_code, text) that it lacks.

    Texts go through the header pattern; those in which it finds nothing through the line parser. Of a number that an act has
    several times the first counts; what exists is never overwritten. NULL and empty texts have no sections.
    """
    parsed = documents.select("act_code", "text").lateralJoin(FlatSections(F.col("text").outer())).select("act_code", "section_number", "title", "section_text", "place")
    rest = documents.join(parsed.select("act_code").distinct(), "act_code", "left_anti")
    found = parsed.withColumn("_said", F.concat("title", F.lit(" "), F.substring("section_text", 1, 200)))
    found = found.unionByName(by_lines(rest).withColumn("_said", F.substring("section_text", 1, 300)).withColumn("section_text", F.substring("section_text", 1, FLAT_TEXT)))
    first = Window.partitionBy("act_code", "section_number").orderBy("place")
    found = found.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    made = found.select("act_code", "section_number", "title", "section_text", F.slice(keywords("_said"), 1, FLAT_KEYWORDS).alias("keywords"), category("title").alias("category"))
    return seed(existing, made, ["act_code", "section_number"])


def resolve_valid_from(as_on: Column | str, commenced: Column | str) -> Column:
    """The text's own date, else the act's commencement, else an error: never today."""
    return F.coalesce(F.col(as_on) if isinstance(as_on, str) else as_on, F.col(commenced) if isinstance(commenced, str) else commenced, F.raise_error(F.lit("no date to take valid_from from")).cast("date"))


def in_section_order(sections: DataFrame) -> DataFrame:
    return sections.orderBy("act_code", *section_order("section_number"))
