"""Quality rules: counts of a text's words, lines and repeats, and a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Base rules count words `[^\\x20\\x09-\\x0D]+`, symbols, repeated lines and words in repeated 8-word windows. Windows are
compared by 64-bit hashes within one text (a false repeat takes two unequal windows of one text with the same hash).

The ratio: features of a text are its words and its pairs of neighbouring words, whole and with their marks, by the low bits of
the CRC-32 of each word hashed into BUCKETS buckets. Two multinomials over the buckets are estimated: `raw` from all distinct
texts, its counts scaled to the target's total, and `target` from trusted ones, with SMOOTHING added to each count of both. A text
counts once, however many documents have it (texts are told apart by 128 bits of hash), and is judged by the counts without
itself: 1 is taken off the raw count of each of its n-grams and, if it is trusted, off its target count. So copies of a
clean text count neither for nor against it, trusted texts get no better scores than clean ones that nobody has labelled, and
n-grams that are rare, or seen in this text alone, count for nothing: where the corpus is thin, scores are near 0 and the base
rules decide. A text's score is the sum of log(target) - log(raw) over its n-grams, divided by their number: nats for each
n-gram, comparable over lengths. A document is kept if it passes the base rules and its score is at least the threshold. Trusted
are the texts of all documents labelled quality = 1, however many; their ids and hashes are joined, never cut. Each row is scored as a trusted
text and as another, and the join of its hash chooses: so it moves counts and scores, and the texts of rows only where they are returned. The
table of ratios has a fixed size and is read as a scalar subquery, so that plans stay small. Corpus counts cover every text.

Each task merges its copies before texts are shuffled by their hash, as 16 bits a word; so a text that a third of all documents have
is one row of each task.

Defined cases: null text has no words, fails the base rules and scores 0; a text without words scores 0; very long texts count whole; without any
trusted document, or an empty corpus, every score is 0, so the base rules alone decide; a label repeated, or null, counts
once, or not; rows repeated, and equal texts, are judged alike; extra columns stay with annotate() and keep() and never clash
while they work, as docs travels in one struct; a column `quality` of docs stands twice in what annotate() returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import SPACES, materialise, table, words

BUCKETS = 65536
SMOOTHING = 10.0
THRESHOLD = -0.1
UNIT = 10_000  # parts of a nat
LOSS_BITS, PIECE = 27, 65_536  # an n-gram loses 954 units at most; the loss of the n-grams at PIECE words has LOSS_BITS bits
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


#: SQL for the buckets of the word at i and of the pair that starts there, from the column of word codes.
_WORD, _PAIR = f"(codes[i] & {BUCKETS - 1})", f"((codes[i] * 31 + codes[i + 1]) & {BUCKETS - 1})"
_TEXT = ("_h1", "_h2")  # what tells texts apart


def word_codes(ws: Column) -> Column:
    """The low 16 bits of each word's CRC-32, as a whole number."""
    return F.transform(ws, lambda w: F.crc32(w.cast("binary")).bitwiseAND(BUCKETS - 1).cast("int"))


def _hashed(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2")]


def trusted_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The hashes of the texts of all trusted documents."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("_id")).where(F.col("_id").isNotNull()).distinct()
    found = docs.select(F.col("doc_id").cast("long").alias("_id"), *_hashed(F.coalesce(F.col("text"), F.lit("")))).join(ids, "_id", "left_semi")
    return materialise(found.select(*_TEXT).distinct(), "trusted")


def _flagged(df: DataFrame, texts: DataFrame) -> DataFrame:
    """df with `trusted` (1 or null) by the hashes of its texts."""
    return df.join(texts.withColumn("trusted", F.lit(1)), list(_TEXT), "left")


def log_ratios(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: an array by bucket of log(target) - log(raw) without one n-gram of a text that is not trusted, in UNITs (whole numbers
    add up alike in any order), shifted by LOSS_BITS, and below that what it is less for a trusted one."""
    t = F.coalesce(F.col("text"), F.lit(""))
    coded = docs.select(*_hashed(t), F.transform(word_codes(words(t)), lambda c: (c - BUCKETS // 2).cast("short")).alias("short"))
    coded = coded.where(F.size("short") > 0).groupBy(*_TEXT).agg(F.first("short").alias("short"))
    coded = _flagged(coded, texts).withColumn("codes", F.transform("short", lambda c: c.cast("int") + BUCKETS // 2))
    grams = F.expr(f"concat(transform(sequence(0, size(codes) - 1), i -> {_WORD}), if(size(codes) > 1, transform(sequence(0, size(codes) - 2), i -> {_PAIR}), array()))")
    counts = coded.select("trusted", F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    by = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("by"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))

    def ratio(c: Column, own: int) -> Column:
        one = F.log((F.greatest(c["target"] - own, F.lit(0)) + SMOOTHING) / (F.greatest(c["raw"] - 1, F.lit(0)) * F.col("target") / F.col("raw") + SMOOTHING))
        return F.round(one * UNIT).cast("long")

    both = F.transform("by", lambda c: F.shiftleft(ratio(c, 0), LOSS_BITS) + ratio(c, 0) - ratio(c, 1))
    return by.select(F.when(F.col("target") > 0, both).otherwise(F.array_repeat(F.lit(0).cast("long"), BUCKETS)).alias("ratios"))


def annotate(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with doc_id and text (other columns stay as they are) -> docs and a struct `quality` of COLUMNS."""
    return judge(docs, trusted, threshold).select("row.*", "quality")


def keep(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with the columns that they came with, whatever their names."""
    return judge(docs, trusted, threshold, passing=True).select("row.*")


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, columns: list[str] | None = None, passing: bool = False) -> DataFrame:
    """row (struct of `columns` of docs, else of all), quality (struct of COLUMNS); `passing`: only of documents that pass."""
    text, texts = F.coalesce(F.col("text"), F.lit("")), trusted_texts(docs, trusted)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"), text.alias("t"), *_hashed(text))
    d = d.withColumn("ws", words(F.col("t"))).withColumn("n", F.size("ws"))
    d = d.withColumn("h1", F.transform("ws", lambda w: F.xxhash64(w))).withColumn("codes", word_codes(F.col("ws"))).withColumn("word_chars", F.length(F.array_join("ws", "")).cast("long")).drop("ws")
    for size in (1, 2):
        pair = F.expr(f"transform(sequence(0, n - {2 * size}), i -> xxhash64(h{size}[i], h{size}[i + {size}]))")
        d = d.withColumn(f"h{2 * size}", F.when(F.col("n") >= 2 * size, pair))
    # A repeated 8-window repeats 5 windows of 4 words; few texts have so many.
    maybe = (F.col("n") >= 8) & (F.size("h4") - F.size(F.array_distinct("h4")) >= 5)
    d = d.withColumn("h8", F.when(maybe, F.expr("transform(sequence(0, n - 8), i -> xxhash64(h4[i], h4[i + 4]))")))
    repeats = F.size(F.array_distinct("h8")) < F.size("h8")
    d = d.withColumn("by_hash", F.when(repeats, F.expr("array_sort(transform(h8, (h, i) -> struct(h, i)), (a, b) -> if(a.h != b.h, if(a.h < b.h, -1, 1), a.i - b.i))")))
    d = d.withColumn("again", F.expr("filter(by_hash, (x, j) -> coalesce(get(by_hash, j - 1).h = x.h, false) or coalesce(get(by_hash, j + 1).h = x.h, false))"))
    covered = F.expr("""aggregate(array_sort(transform(again, x -> x.i)), named_struct('end', 0, 'n', 0L),
        (a, i) -> named_struct('end', i + 8, 'n', a.n + i + 8 - greatest(a.end, i)), a -> a.n)""")
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    ratios = materialise(log_ratios(docs, texts), "ratios", 1).scalar()
    d = d.withColumn("lines", lines).withColumn("ratios", ratios).withColumn("repeat", F.coalesce(covered, F.lit(0).cast("long")))
    # The row's table is a variable, r: written out, it would stand in the plan for each of its uses.
    sums = F.expr(f"""get(transform(array(ratios), r -> transform(sequence(0, n - 1, {PIECE}), at ->
        aggregate(sequence(at, least(at + {PIECE}, n) - 1), 0L, (a, i) -> a + r[{_WORD}] + if(i < n - 1, r[{_PAIR}], 0L)))), 0)""")
    d = d.withColumn("sums", F.when(F.col("n") > 0, sums)).drop("ratios")
    other = F.expr(f"aggregate(sums, 0L, (a, x) -> a + shiftright(x, {LOSS_BITS}))")
    loss = F.expr(f"aggregate(sums, 0L, (a, x) -> a + (x & {(1 << LOSS_BITS) - 1}))")
    score = lambda total: F.coalesce(total / (F.col("n") * 2 - 1) / UNIT, F.lit(0.0))
    failed = (F.col("n") < MIN_WORDS) | (F.col("repeat") * 100 > F.col("n") * MAX_REPEAT_PERCENT)
    # The optimizer moves a filter on the verdict below these projections, and there writes every column out within the
    # lambdas that use it, to be computed for each word. A condition that it cannot foresee, though always true, keeps it above.
    d = d.select("row", *_TEXT, F.when(F.monotonically_increasing_id() >= 0, F.struct(
        F.col("n").cast("long").alias("n_words"),
        F.col("word_chars"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("repeat").alias("n_repeat_words"), failed.alias("base_failed"), score(other).alias("as_other"), score(other - loss).alias("as_trusted"),
    )).alias("q"))
    q = F.col("q")
    if passing:  # a text scores no better as a trusted one
        d = d.where(~q["base_failed"] & (q["as_other"] >= threshold))
    chosen = F.when(F.col("trusted") == 1, q["as_trusted"]).otherwise(q["as_other"])
    kept = ~q["base_failed"] & (chosen >= threshold)
    out = _flagged(d, texts).select("row", F.struct(*[q[c].alias(c) for c in COLUMNS[:6]], chosen.alias("score"), kept.alias("kept")).alias("quality"))
    return out.where(F.col("quality.kept")) if passing else out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled quality = 1."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, trusted_ids(table(spark, sf_dir, "labels")), columns=["doc_id"])
    q = F.col("quality")
    return out.select("row.doc_id", *[q[c].alias(c) for c in COLUMNS if c != "score"], (F.round(q["score"], 6) + 0.0).alias("score"))  # no negative zero


_CHARS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SQL = f"""
with d as (select row_number() over () as r, dense_rank() over (order by coalesce(text, '')) as x, doc_id, coalesce(text, '') as t from documents),
w as (select r, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as ws from d),
u as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
win as (select r, i, list(word) over (partition by r order by i rows between current row and 7 following) as g from u),
rep as (select r, i, count(*) over (partition by r, g) as c from win where len(g) = 8),
cov as (select distinct r, i + k as i from rep, range(8) t(k) where c > 1),
reps as (select r, count(*) as n_repeat_words from cov group by r),
table_ as (with recursive t as (select i, i::ubigint as c, 0 as k from range(256) r(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from t where k < 8)
    select list(c order by i) as t from t where k = 8),
crc as (select word, xor(list_reduce(list_transform(range(0, octet_length(encode(word))), lambda j: ('0x' || substr(hex(encode(word)), 2 * j + 1, 2))::ubigint), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)::bigint]), 4294967295::ubigint), 4294967295::ubigint)::bigint as u
    from (select distinct word from u), table_),
code as (select r, i, crc.u from u join crc using (word)),
nxt as (select r, u, lead(u) over (partition by r order by i) as v from code),
feat as (select r, u & {BUCKETS - 1} as b from nxt union all
    select r, (u * 31 + v) & {BUCKETS - 1} as b from nxt where v is not null),
trusted as (select doc_id from (select distinct doc_id from labels where quality = 1 and doc_id is not null) order by (doc_id * 7919) % 1000003, doc_id limit 20000),
good as (select r from d where x in (select x from d where doc_id in (select doc_id from trusted))),
once as (select min(r) as r from d group by x),
counts as (select b, count(*) as raw, count(*) filter (r in (select r from good)) as target from feat where r in (select r from once) group by b),
sums as (select sum(raw)::double as raw, sum(target)::double as target from counts),
lr as (select b, own, round(10000 * ln((greatest(c.target - own, 0) + {SMOOTHING}) / ((c.raw - 1) * s.target / s.raw + {SMOOTHING})))::bigint as x from counts c, sums s, range(2) o(own) where s.target > 0),
sc as (select r, sum(x)::double / count(*) / 10000 as score from (select r, b, (r in (select r from good))::bigint as own from feat) join lr using (b, own) group by r),
lines as (select r, count(*) - count(distinct l) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as l from d) where translate(l, {_CHARS}, '') != '' group by r),
c as (select doc_id, len(ws) as n_words, length(translate(t, {_CHARS}, '')) as word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(score, 0) as score
    from d join w using (r) left join reps using (r) left join sc using (r) left join lines using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and score >= {THRESHOLD} as kept, round(score, 6) + 0.0 as score from c
"""

QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {"op3_quality_rules": _SQL}
