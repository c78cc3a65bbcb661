"""Removal of repeated passages with a log-structured fingerprint index.

A window is WINDOW consecutive words. A word is removed if a window that covers it has the same words as a window that
starts earlier: in a document of smaller doc_id, or in the same one further to the front.

Index. Of each window the least hash of its KGRAM-word parts is its fingerprint: equal windows have equal fingerprints,
and neighbouring windows mostly share one, so a document has one entry for about seven words. A batch's distinct fingerprints,
with the number of their occurrences, are an immutable run: a table dealt into buckets by fingerprint and sorted by it.
A new batch becomes a run, and that is merge-joined with every run before it, bucket by bucket, without a shuffle:
what both have, or what the batch has twice, is repeated. FANOUT runs of a level are compacted into one of the next. A run has one
row for a fingerprint, however many documents have it. An index can be kept between calls: deduplicate() takes a new batch
against what was added before. The query deals its documents into BATCHES batches, so that its last one meets a compacted run.

Verification. Only windows with a repeated fingerprint can be repeated; their documents are found by their entries. They are
hashed whole, and compared by fingerprint and hash together (128 bits of the 20 words; words themselves are not compared again);
neighbouring windows with one fingerprint travel in one row. The least (doc_id, start) of each is its first occurrence and stays,
every other is removed. First occurrences go back by document, so no copy is joined with its copies; equal rows of a
task are reduced to one before they are dealt, so that a passage of very many documents is a few rows. Texts are dealt once by
doc_id for both uses.

Defined cases: null text has no words and stays null; very long texts are taken whole; a text of fewer than WINDOW words loses nothing; null doc_id counts
as greater than all others; rows of the same doc_id are one document, of which windows at the same start do not precede
each other, so repeated rows get the same result; empty tables give no rows; extra columns stay, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import collect_garbage, delete, materialise, parts, scratch_path, shuffle_partitions, table
from quillon.llm.wordhash import hashes, split, windows

WINDOW = 20
KGRAM = 8
FANOUT = 4
BATCHES = 5  # of the query; an index takes any number
MOST_BUCKETS = 20_000  # Spark takes five times as many
KEPT = 200_000  # rows that a task holds to reduce equal ones
LAST = (1 << 63) - 1  # stands for a null doc_id
STEP = 500


def fingerprints(words: np.ndarray) -> np.ndarray:
    """The fingerprint of each window of an array of word hashes."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    low, span, want = windows(words, KGRAM, 1), 1, WINDOW - KGRAM + 1
    while span < want:  # the least of `span` values, span doubling as far as it fits
        step = min(span, want - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    return low


def entries(docs: DataFrame) -> DataFrame:
    """docs(_id, text) -> fp, _id, n: the distinct fingerprints of each document; n is 2 where its part occurs again in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), STEP):
                b = whole.slice(at, STEP)
                fps, ns, sizes = [], [], []
                for t in b.column("text"):
                    words = hashes().of(split(t.as_py()))
                    fp = np.unique(fingerprints(words))
                    part, count = np.unique(windows(words, KGRAM, 1), return_counts=True) if len(fp) else (fp, fp)
                    fps.append(fp)
                    ns.append(np.minimum(count[np.searchsorted(part, fp)], 2).astype(np.int32))
                    sizes.append(len(fp))
                ids = np.repeat(b.column("_id").to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps).view(np.int64)), pa.array(ids), pa.array(np.concatenate(ns))], ["fp", "_id", "n"])

    return docs.select("_id", "text").mapInArrow(run, "fp long, _id long, n int")


class FingerprintIndex:
    """Sorted immutable runs of distinct fingerprints, in buckets, in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "index")
        self.buckets = buckets  # else chosen by the first batch
        self.levels: list[list[str]] = []
        self.name = f"quillon_run_{uuid.uuid4().hex}"
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> str:
        """A run: a table of fp and n."""
        run = f"{self.name}_{self.made}"
        self.made += 1
        rows.coalesce(self.buckets).write.bucketBy(self.buckets, "fp").sortBy("fp").option("compression", "zstd").option("path", f"{self.path}/{run}").format("parquet").saveAsTable(run)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        return run

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch of entries(fp, n, ...); its fingerprints (fp) that occur twice or more, in the batch and all before it."""
        before = self.runs()
        if not self.buckets:
            self.buckets = min(parts(batch.count() // 10, 4), MOST_BUCKETS)
        new = self.spark.table(self._write(batch.groupBy("fp").agg(F.sum("n").alias("n")), 0))
        found = new.where(F.col("n") > 1).select("fp")
        for run in before:
            found = found.union(new.select("fp").join(self.spark.table(run).select("fp"), "fp", "left_semi"))
        with _sorted_buckets(self.spark):
            found = materialise(found, "hits", self.buckets)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= FANOUT:
                self.compact(level)
        return found.distinct()

    def compact(self, level: int) -> None:
        """Merge the runs of a level into one of the next; they are deleted when it is written."""
        old, self.levels[level] = self.levels[level], []
        rows = self.spark.table(old[0])
        for run in old[1:]:
            rows = rows.union(self.spark.table(run))
        self._write(rows.groupBy("fp").agg(F.sum("n").alias("n")), level + 1)
        for run in old:
            self._drop(run)

    def _drop(self, run: str) -> None:
        self.spark.sql(f"drop table {run}")
        delete(self.spark, f"{self.path}/{run}")

    def drop(self) -> None:
        for run in self.runs():
            self._drop(run)
        self.levels = []
        delete(self.spark, self.path)


@contextmanager
def _sorted_buckets(spark: SparkSession):
    """Let scans of buckets of one file say that they are sorted, so that joins do not sort them again."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _candidates(text: str | None, fps: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A text's words, their hashes, and the starts of its windows whose fingerprint is repeated."""
    words = split(text)
    if not len(fps):
        return words, np.empty(0, np.uint64), np.empty(0, np.int64)
    hashed = hashes().of(words)
    return words, hashed, np.flatnonzero(np.isin(fingerprints(hashed), fps))


def _array(x: pa.Scalar, dtype) -> np.ndarray:
    return np.empty(0, dtype) if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def _fps(x: pa.Scalar) -> np.ndarray:
    return _array(x, np.int64).view(np.uint64)


def _hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, text, fps) -> (fp, _id, start, hs): a row for each run of windows with the same fingerprint, hs their hashes.

    Of equal rows only that of least (_id, start) is sent, once for KEPT different ones: copies in a task cost as much as one.
    """
    seen: dict[tuple[int, bytes], tuple[int, int]] = {}
    for whole in batches:
        ids = whole.column("_id").to_numpy()
        for i in range(len(whole)):
            fps = _fps(whole.column("fps")[i])
            _, hashed, starts = _candidates(whole.column("text")[i].as_py(), fps)
            if not len(starts):
                continue
            mine, h = fingerprints(hashed)[starts].view(np.int64), windows(hashed, WINDOW, 2)[starts].view(np.int64)
            cut = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(mine) != 0)])
            for at, to in zip(cut.tolist(), [*cut[1:].tolist(), len(starts)]):
                key, place = (int(mine[at]), h[at:to].tobytes()), (int(ids[i]), int(starts[at]))
                if place < seen.get(key, (LAST, LAST + 1)):
                    seen[key] = place
        if len(seen) >= KEPT:
            yield _rows(seen)
            seen = {}
    if seen:
        yield _rows(seen)


def _rows(seen: dict[tuple[int, bytes], tuple[int, int]]) -> pa.RecordBatch:
    hs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(h) // 8 for _, h in seen)]), pa.int32()), pa.array(np.frombuffer(b"".join(h for _, h in seen), np.int64)))
    place = np.array(list(seen.values()), np.int64)
    return pa.RecordBatch.from_arrays([pa.array([fp for fp, _ in seen], pa.int64()), pa.array(place[:, 0]), pa.array(place[:, 1].astype(np.int32)), hs], ["fp", "_id", "start", "hs"])


def _remove(batches: Iterator[pa.RecordBatch], as_is: bool) -> Iterator[pa.RecordBatch]:
    """(row, text, fps, firsts) -> (row, n_words, n_removed, kept); as_is: a text that loses nothing as it was, not as its words."""
    for whole in batches:
        for at in range(0, len(whole), STEP):
            b = whole.slice(at, STEP)
            n_words, n_removed, kept = [], [], []
            for text, fps, firsts in zip(b.column("text"), b.column("fps"), b.column("firsts")):
                words, _, starts = _candidates(text.as_py(), _fps(fps))
                later = starts[~np.isin(starts, _array(firsts, np.int64))] if len(starts) else starts
                if not len(later):
                    n_words.append(len(words))
                    n_removed.append(0)
                    kept.append(text.as_py() if as_is else b" ".join(words).decode("utf-8", "surrogatepass"))
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, later, 1)
                np.add.at(edge, later + WINDOW, -1)
                stay = np.cumsum(edge[:-1]) == 0
                n_words.append(len(words))
                n_removed.append(int((~stay).sum()))
                kept.append(b" ".join(w for w, s in zip(words, stay) if s).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"])


def _whole(docs: DataFrame) -> DataFrame:
    """_id, text, row (struct of the other columns of docs)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.col("text"), row.alias("row"))


def _occurring(entries_: DataFrame, hits: DataFrame) -> DataFrame:
    """(_id, fps): each document's fingerprints that are among hits(fp)."""
    n = entries_.count()
    return materialise(entries_.join(hits, "fp", "left_semi").groupBy("_id").agg(F.collect_set("fp").alias("fps")), "repeated", parts(n))


def _without(whole: DataFrame, repeated: DataFrame, as_is: bool) -> DataFrame:
    """row, n_words, n_removed, kept of every document of whole, of which repeated(_id, fps) has all that can repeat."""
    n = shuffle_partitions(whole.sparkSession)
    seen = whole.repartition(n, "_id").join(repeated, "_id", "left")
    found = seen.where(F.col("fps").isNotNull()).select("_id", "text", "fps").mapInArrow(_hash_windows, "fp long, _id long, start int, hs array<long>")
    each = found.repartition(n, "fp").select("fp", "_id", "start", F.posexplode("hs").alias("k", "h"))
    firsts = each.groupBy("fp", "h").agg(F.min(F.struct("_id", (F.col("start") + F.col("k")).alias("start"))).alias("f")).groupBy(F.col("f._id").alias("_id")).agg(F.collect_list("f.start").alias("firsts"))
    row = seen.join(firsts, "_id", "left").select("row", "text", "fps", "firsts")
    return row.mapInArrow(lambda batches: _remove(batches, as_is), row.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string"))


def remove_repeats(docs: DataFrame, batches: int = BATCHES, as_is: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> row (struct of the columns of docs but text), n_words, n_removed, kept (words joined by a space; with as_is
    an unchanged text as it was)."""
    spark, whole = docs.sparkSession, _whole(docs)
    # Batches as they might arrive, from one pass over the texts; their order does not matter to what is repeated. Files are sorted
    # by batch, so that a batch reads its own pages of them.
    path = scratch_path(spark, "entries")
    made = entries(whole).withColumn("batch", F.pmod(F.xxhash64("_id"), F.lit(batches)).cast("int"))
    made.sortWithinPartitions("batch").write.option("compression", "zstd").parquet(path)
    all_ = spark.read.schema("fp long, _id long, n int, batch int").parquet(path)
    index = FingerprintIndex(spark)
    hits = index.add(all_.where("batch = 0"))
    for k in range(1, batches):
        hits = hits.union(index.add(all_.where(F.col("batch") == k)))
    repeated = _occurring(all_.select("fp", "_id"), hits.distinct())
    index.drop()
    delete(spark, path)
    collect_garbage(spark)
    return _without(whole, repeated, as_is)


def deduplicate(batch: DataFrame, history: DataFrame, index: FingerprintIndex) -> DataFrame:
    """A new batch against all that was added before: row, n_words, n_removed, kept of the batch's documents.

    history: the documents of the batches before, as they were, in the same columns; of them only those that share a fingerprint with
    the batch are hashed. The index takes the batch in. What is removed from earlier documents (where the batch has smaller
    doc_ids) is not returned.
    """
    new, old = _whole(batch), _whole(history)
    mine = materialise(entries(new), "entries")
    hits = index.add(mine).persist()
    theirs = entries(old).join(hits, "fp", "left_semi").select("fp", "_id")
    repeated = _occurring(mine.select("fp", "_id").union(theirs), hits)
    hits.unpersist()
    both = new.withColumn("new", F.lit(True)).union(old.join(repeated.select("_id"), "_id", "left_semi").select("_id", "text", "row", F.lit(False)))
    both = both.select("_id", "text", F.struct("new", "row").alias("row"))
    return _without(both, repeated, False).where("row.new").select("row.row", "n_words", "n_removed", "kept")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages taken out of their texts; texts that lose nothing stay as they are."""
    out = remove_repeats(docs, as_is=True)
    length = F.when(F.col("n_removed") > 0, F.length("kept").cast("long"))
    known = {"text": F.col("kept").alias("text")}
    if "n_chars" in docs.columns:
        known["n_chars"] = F.coalesce(length, F.col("row.n_chars")).alias("n_chars")
    return out.select(*[known.get(c, F.col(f"row.`{c}`")) for c in docs.columns])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of it."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_SQL = """
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as ws from documents),
u as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
win as (select doc_id, i, list(word) over (partition by doc_id order by i rows between current row and 19 following) as g from u),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as r from win where len(g) = 20) where r > 1),
cov as (select distinct doc_id, i + k as i from later, range(20) t(k)),
kept as (select u.doc_id, count(cov.i) as n_removed, string_agg(word, ' ' order by u.i) filter (cov.i is null) as t from u left join cov using (doc_id, i) group by 1)
select w.doc_id, len(ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)
"""

QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES = {"op8_substring_dedup": _SQL}
