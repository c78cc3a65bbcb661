"""Versioned documents: validity, judicial status, retrieval, history, upsert, review and snapshots.

Sections are rows of (act_code, section_number, version_no, section_text, marginal_note, category, valid_from, valid_to,
embedding); a version holds from valid_from up to, not including, valid_to (NULL: open).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import query_words
from quillon.functions.vectors import cosine_distance
from quillon.operators.knn import literal

KEY = ["act_code", "section_number"]
CUTOVER = date(2024, 7, 1)
OLD_ACTS, NEW_ACTS = ("IPC", "CrPC"), ("BNS", "BNSS", "BSA")
TOP_K, FLOOR = 6, 0.25


def in_force(as_of: Column | date) -> Column:
    d = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return (F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (F.col("valid_to") > d))


def acts_for(incident: date) -> tuple[str, ...]:
    return OLD_ACTS if incident < CUTOVER else NEW_ACTS


def recently_amended(as_of: date) -> Column:
    return (F.col("version_no") > 1) & (F.datediff(F.lit(as_of), "valid_from") <= 365)


def latest_status(status: DataFrame) -> DataFrame:
    """One status row for each section: the latest decision."""
    order = [F.col("decided_on").desc_nulls_last(), F.col("status")] if "decided_on" in status.columns else [F.col("status").desc()]
    return status.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where("_r = 1").drop("_r")


def standing(sections: DataFrame, status: DataFrame, as_of: date, incident: date | None = None, struck_down: bool = False) -> DataFrame:
    """Sections in force with their status; those struck down only on demand."""
    out = sections.where(in_force(as_of))
    if incident is not None:
        out = out.where(F.col("act_code").isin(*acts_for(incident)))
    out = out.join(latest_status(status), KEY, "left")
    if not struck_down:
        out = out.where(F.col("status").isNull() | (F.col("status") != "struck_down"))
    return out.withColumn("recently_amended", recently_amended(as_of))


def _listing(df: DataFrame, similarity: Column) -> DataFrame:
    return df.select("act_code", "section_number", "marginal_note", F.substring("section_text", 1, 300).alias("snippet"), "category", similarity.alias("similarity"), "version_no", "valid_from", "valid_to", "recently_amended", "status")


def semantic_search(sections: DataFrame, status: DataFrame, q: Sequence[float], as_of: date, query: str = "", k: int = TOP_K, incident: date | None = None) -> DataFrame:
    """The k nearest standing sections, less those under the floor; if none is left, keyword search.

    The k rows are computed here, so that keywords are looked for only if there is none.
    """
    near = standing(sections, status, as_of, incident).where(F.col("embedding").isNotNull()).withColumn("distance", cosine_distance("embedding", literal(q)))
    top = near.orderBy(F.col("distance").asc_nulls_last(), *KEY).limit(k).where(1 - F.col("distance") >= FLOOR)
    found = _listing(top, F.round(1 - F.col("distance"), 4))
    rows = found.collect()
    if not rows:
        return keyword_search(sections, status, query, as_of, k, incident)
    return sections.sparkSession.createDataFrame(rows, found.schema)


def keyword_search(sections: DataFrame, status: DataFrame, query: str, as_of: date, k: int = TOP_K, incident: date | None = None) -> DataFrame:
    """Standing sections in whose title, text or category one of the query's words occurs, in order of act and number."""
    rows = standing(sections, status, as_of, incident).withColumn("_words", query_words(F.lit(query)))
    like = lambda c: F.exists("_words", lambda w: F.ilike(F.col(c), F.concat(F.lit("%"), w, F.lit("%"))))
    hit = rows.where(F.coalesce(like("marginal_note"), F.lit(False)) | F.coalesce(like("section_text"), F.lit(False)) | F.coalesce(like("category"), F.lit(False)))
    return _listing(hit.orderBy(*KEY, "version_no").limit(k), F.lit(None).cast("double"))


def with_previous(sections: DataFrame) -> DataFrame:
    """Each version with the text and start of the one before it."""
    w = Window.partitionBy(*KEY).orderBy("version_no")
    return sections.withColumn("previous_text", F.lag("section_text").over(w)).withColumn("previous_valid_from", F.lag("valid_from").over(w))


def as_of_join(events: DataFrame, sections: DataFrame, at: str, part_rows: int = 50_000) -> DataFrame:
    """Each event with the columns of the version of its section that was in force on its day, NULL if there was none.

    One sorted merge of events and versions: a running last version for each section, in order of day, so the work grows with
    events and versions, not with their product. Versions of a section do not overlap; of several with the same start the
    greatest version_no counts. A section of more than part_rows events is cut into ranges of days, and a range that still has
    more (a day with most of them) by place in the input; each piece gets the versions that hold in its range. The list of such
    sections and ranges has 20,000 rows or so at most, as part_rows grows with the events, and is broadcast. Events without a day or
    key take no part in the merge.
    """
    size = max(part_rows, events.count() // 10_000)
    names, own = events.columns, [c for c in sections.columns if c not in KEY]
    row = events.select(*KEY, F.col(at).cast("date").alias("_at"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_e"))
    known = F.col("_at").isNotNull() & F.col("act_code").isNotNull() & F.col("section_number").isNotNull()
    live = row.where(known)
    big = live.groupBy(*KEY).agg(F.count("*").alias("_n"), F.min("_at").alias("_lo"), F.max("_at").alias("_hi")).where(F.col("_n") > size)
    width = F.ceil((F.datediff("_hi", "_lo") + 1) / F.ceil(F.col("_n") / size))
    big = F.broadcast(big.select(*KEY, "_lo", "_hi", width.alias("_width")))
    piece = lambda day: F.coalesce(F.floor(F.datediff(day, F.col("_lo")) / F.col("_width")), F.lit(0)).cast("long")
    live = live.join(big, KEY, "left").withColumn("_range", piece(F.col("_at")))
    dense = live.where(F.col("_width").isNotNull()).groupBy(*KEY, "_range").agg(F.ceil(F.count("*") / size).alias("_salts")).where(F.col("_salts") > 1)
    dense = F.broadcast(dense)
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")), F.lit(0)).cast("long")
    live = live.join(dense, [*KEY, "_range"], "left").select(*KEY, "_range", salt.alias("_salt"), "_at", "_e", F.lit(1).alias("_kind"))
    kept = sections.where(F.col("valid_from").isNotNull()).select(*KEY, F.col("valid_from").alias("_at"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("_v"))
    kept = kept.join(big, KEY, "left")
    last = F.least(F.coalesce(F.date_sub(F.col("_v.valid_to"), 1), F.col("_hi")), F.col("_hi"))
    ranges = F.when(F.col("_width").isNull(), F.array(F.lit(0).cast("long"))).when((F.col("_at") <= F.col("_hi")) & (last >= F.col("_lo")), F.sequence(piece(F.greatest("_at", "_lo")), F.greatest(piece(last), piece(F.greatest("_at", "_lo")))))
    kept = kept.withColumn("_range", F.explode(ranges)).join(dense, [*KEY, "_range"], "left")
    kept = kept.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts") - 1, F.lit(0)).cast("long")))).select(*KEY, "_range", "_salt", "_at", "_v", F.lit(0).alias("_kind"))
    both = live.unionByName(kept, allowMissingColumns=True)
    order = Window.partitionBy(*KEY, "_range", "_salt").orderBy("_at", "_kind", "_v.version_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where(F.col("_kind") == 1)
    holds = F.col("_last.valid_to").isNull() | (F.col("_last.valid_to") > F.col("_at"))
    found = met.select("_e", F.when(holds, F.col("_last")).alias("_v")).unionByName(row.where(~known).select("_e"), allowMissingColumns=True)
    return found.select(*[F.col(f"_e.`{c}`") for c in names], *[F.col(f"_v.`{c}`") for c in own])


def context(found: DataFrame) -> DataFrame:
    """One row: the retrieved sections as the text block of a prompt, in order of similarity."""
    note = F.when(F.col("status") == "read_down", F.concat(F.lit("\n[JUDICIAL NOTE: read down by "), F.coalesce("case_name", F.lit("None")), F.lit(" ("), F.coalesce("citation", F.lit("None")), F.lit(") -- "), F.coalesce("scope_note", F.lit("None")), F.lit("]"))).otherwise("")
    have = set(found.columns)
    for c in ("case_name", "citation", "scope_note"):
        if c not in have:
            found = found.withColumn(c, F.lit(None).cast("string"))
    line = F.concat("act_code", F.lit(" Section "), "section_number", F.lit(" — "), "marginal_note", F.lit(":\n"), "snippet", note)
    lines = F.transform(F.sort_array(F.collect_list(F.struct(-F.coalesce("similarity", F.lit(0.0)), "act_code", "section_number", line.alias("line")))), lambda x: x["line"])
    head, foot = F.lit("--- RETRIEVED LEGAL SECTIONS (authoritative reference) ---"), F.lit("--- END RETRIEVED SECTIONS ---")
    return found.agg(lines.alias("l")).select(F.when(F.size("l") == 0, "").otherwise(F.array_join(F.concat(F.array(head), "l", F.array(foot)), "\n\n")).alias("context"))


def upsert(current: DataFrame, new: DataFrame, valid_from: str = "new_valid_from") -> DataFrame:
    """All versions after a batch: new(act_code, section_number, section_text, marginal_note, new_valid_from).

    action: insert (first version), update (same start: text in place), skip (nothing changed), close and version (a later
    start closes the open version and opens the next), reject (an earlier start), keep.
    """
    open_ = current.where(F.col("valid_to").isNull()).select(*KEY, F.col("version_no").alias("_no"), F.col("valid_from").alias("_from"), F.col("section_text").alias("_text"), F.col("marginal_note").alias("_note"))
    n = new.select(*KEY, F.col("section_text").alias("_new_text"), F.col("marginal_note").alias("_new_note"), F.col(valid_from).alias("_new_from"))
    both = open_.join(n, KEY, "full_outer")
    same = (F.col("_text") == F.col("_new_text")) & (F.coalesce("_new_note", "_note").eqNullSafe(F.col("_note")))
    action = F.when(F.col("_new_from").isNull(), "keep").when(F.col("_no").isNull(), "insert").when(F.col("_new_from") < F.col("_from"), "reject").when(F.col("_new_from") > F.col("_from"), "version").when(same, "skip").otherwise("update")
    both = both.withColumn("_action", action)
    row = lambda no, text, note, start, end, act: F.struct(no.cast("int").alias("version_no"), text.alias("section_text"), note.alias("marginal_note"), start.alias("valid_from"), end.cast("date").alias("valid_to"), F.lit(act).alias("action") if isinstance(act, str) else act.alias("action"))
    c = F.col
    old = row(c("_no"), c("_text"), c("_note"), c("_from"), F.lit(None), c("_action"))
    note = F.coalesce("_new_note", "_note")
    made = (
        F.when(c("_action") == "insert", F.array(row(F.lit(1), c("_new_text"), c("_new_note"), c("_new_from"), F.lit(None), "insert")))
        .when(c("_action") == "update", F.array(row(c("_no"), c("_new_text"), note, c("_from"), F.lit(None), "update")))
        .when(c("_action") == "version", F.array(row(c("_no"), c("_text"), c("_note"), c("_from"), c("_new_from"), "close"), row(c("_no") + 1, c("_new_text"), note, c("_new_from"), F.lit(None), "version")))
        .otherwise(F.array(old))
    )
    live = both.select(*KEY, F.inline(made))
    closed = current.where(F.col("valid_to").isNotNull()).select(*KEY, "version_no", "section_text", "marginal_note", "valid_from", "valid_to", F.lit("keep").alias("action"))
    return live.unionByName(closed)


def stage_changes(current: DataFrame, fetched: DataFrame) -> DataFrame:
    """Pending changes: fetched(act_code, section_number, section_text) that differs from the open version, with a summary of lengths."""
    open_ = current.where(F.col("valid_to").isNull()).select(*KEY, F.col("section_text").alias("_old"))
    diff = fetched.join(open_, KEY, "left").where(F.col("_old").isNull() | (F.sha2(F.col("section_text").cast("binary"), 256) != F.sha2(F.col("_old").cast("binary"), 256)))
    summary = F.when(F.col("_old").isNull(), F.concat(F.lit("new section, "), F.length("section_text").cast("string"), F.lit(" chars"))).otherwise(F.concat(F.length("_old").cast("string"), F.lit(" -> "), F.length("section_text").cast("string"), F.lit(" chars")))
    return diff.select(*KEY, F.col("section_text").alias("staged_text"), summary.alias("summary"), F.lit("pending").alias("status"))


def reject_changes(staged: DataFrame, rejected: DataFrame) -> DataFrame:
    """rejected(act_code, section_number, reason): pending changes among them become rejected."""
    out = staged.join(rejected, KEY, "left")
    hit = F.col("reason").isNotNull() & (F.col("status") == "pending")
    return out.withColumns({"status": F.when(hit, "rejected").otherwise(F.col("status")), "reason": F.when(hit, F.col("reason"))})


def approve_changes(current: DataFrame, staged: DataFrame, effective: date) -> DataFrame:
    """All versions after the pending changes took effect."""
    new = staged.where(F.col("status") == "pending").select(*KEY, F.col("staged_text").alias("section_text"), F.lit(None).cast("string").alias("marginal_note"), F.lit(effective).alias("new_valid_from"))
    return upsert(current, new)


def approve_linked(current: DataFrame, amendments: DataFrame, staged: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pending changes take effect, each with a link from the version that it replaces and, if an amending act is named, a row for that.

    current: versions with version_id (act:section:version), superseded_by and amended_by; amendments(amendment_id, amending_act, gazette_ref,
    effective_from, summary); decisions(act_code, section_number, effective_from, amending_act, gazette_ref). A change whose
    decision names no day, or one not after the open version's start, stays pending. Returns (versions, amendments, staged).
    """
    d = decisions.select(*KEY, F.col("effective_from").alias("_from"), F.col("amending_act").alias("_by"), F.col("gazette_ref").alias("_ref"))
    is_open = F.col("valid_to").isNull()
    open_ = current.groupBy(*KEY).agg(F.max(F.when(is_open, F.col("valid_from"))).alias("_start"), F.max("version_no").alias("_no"), F.max(F.when(is_open, F.col("marginal_note"))).alias("_note"))
    chosen = staged.join(d, KEY).where((F.col("status") == "pending") & F.col("_from").isNotNull()).join(open_, KEY, "left")
    chosen = chosen.where(F.col("_start").isNull() | (F.col("_from") > F.col("_start")))
    number = F.coalesce(F.col("_no"), F.lit(0)) + 1
    made_id = F.concat_ws(":", *KEY, number.cast("string"))
    amendment = F.when(F.col("_by").isNotNull(), F.substring(F.sha2(F.concat_ws("|", "_by", "_ref", F.col("_from").cast("string")).cast("binary"), 256), 1, 16))
    chosen = chosen.withColumn("_id", made_id).withColumn("_amendment", amendment)
    fresh = chosen.select(
        *KEY, number.cast("int").alias("version_no"), F.col("staged_text").alias("section_text"), F.col("_note").alias("marginal_note"), F.col("_from").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"), F.col("_id").alias("version_id"), F.lit(None).cast("string").alias("superseded_by"), F.col("_amendment").alias("amended_by"),
    )
    ends = chosen.select(*KEY, F.col("_from"), F.col("_id"))
    hit = F.col("valid_to").isNull() & F.col("_from").isNotNull()
    linked = current.join(ends, KEY, "left").withColumn("superseded_by", F.when(hit, F.col("_id")).otherwise(F.col("superseded_by"))).withColumn("valid_to", F.when(hit, F.col("_from")).otherwise(F.col("valid_to")))
    versions = linked.select(*current.columns).unionByName(fresh, allowMissingColumns=True)
    rows = chosen.where(F.col("_amendment").isNotNull()).groupBy(F.col("_amendment").alias("amendment_id")).agg(
        F.first("_by").alias("amending_act"), F.first("_ref").alias("gazette_ref"), F.first("_from").alias("effective_from"), F.concat(F.count("*").cast("string"), F.lit(" sections")).alias("summary")
    )
    rows = amendments.unionByName(rows.join(amendments.select("amendment_id"), "amendment_id", "left_anti"))
    done = chosen.select(*KEY, F.lit(True).alias("_done"))
    after = staged.join(done, KEY, "left").withColumn("status", F.when(F.col("_done") & (F.col("status") == "pending"), "approved").otherwise(F.col("status"))).drop("_done")
    return versions, rows, after


def snapshot(sections: DataFrame, label: str) -> DataFrame:
    """One row: how many versions are open, and the SHA-256 of their sorted act:section:version:sha256(text) lines.

    The lines meet in one row, 80 bytes for each open section; a corpus of statutes is small by nature. snapshot_tree() has no
    such limit.
    """
    line = F.concat_ws(":", "act_code", "section_number", F.col("version_no").cast("string"), F.sha2(F.col("section_text").cast("binary"), 256))
    return sections.where(F.col("valid_to").isNull()).agg(F.count("*").alias("section_count"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n").cast("binary"), 256).alias("checksum")).select(F.lit(label).alias("label"), "section_count", "checksum")


def snapshot_tree(sections: DataFrame, label: str) -> DataFrame:
    """As snapshot() for any number of sections: 4096 partial checksums by hash of the line, then one of those."""
    line = F.concat_ws(":", "act_code", "section_number", F.col("version_no").cast("string"), F.sha2(F.col("section_text").cast("binary"), 256))
    rows = sections.where(F.col("valid_to").isNull()).select(line.alias("line"), F.substring(F.sha2(line.cast("binary"), 256), 1, 3).alias("part"))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n").cast("binary"), 256).alias("c"))
    return parts.agg(F.sum("n").alias("section_count"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "c"))), lambda x: x["c"]), "\n").cast("binary"), 256).alias("checksum")).select(F.lit(label).alias("label"), F.coalesce("section_count", F.lit(0)).alias("section_count"), "checksum")


def news_normalise(items: DataFrame, existing: DataFrame, tag_words: int = 3) -> DataFrame:
    """items(position, query, title, summary, published): trimmed, without empty or removed titles, first of a title, not yet stored."""
    rows = items.withColumn("title", F.trim("title")).withColumn("summary", F.trim("summary")).where((F.col("title") != "") & (F.col("title") != "[Removed]"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("title").orderBy("position"))).where("_r = 1").drop("_r")
    rows = rows.join(existing.select("title"), "title", "left_anti")
    return rows.select("position", "title", "summary", F.slice(F.split("query", r"\s+"), 1, tag_words).alias("tags"), F.lit(0.8).alias("relevance_score"), "published")
