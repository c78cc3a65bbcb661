"""Source divergence audit: how far the sources of a language differ in their words, by an inverted index with corrected baselines.

Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII. A language keeps the V terms that at least MIN_DOCS of its
documents hold. A source gives a kept term that occurs c times there the share p(c) = 1 + floor(10 ** 9 * (c + 5) / (N + 5 * V)), N being the
occurrences of all kept terms; so does the language as a whole. The difference of two sources is the sum of |p - q| over all
kept terms, most of which one or both of them lack. So each pair starts at V * |p(0) - q(0)|, and only what occurs corrects that:

- a term of one source changes the difference to any other source as if that one lacked the term; this depends on the term's share
  alone, so it is added up from each source's counts of equal shares;
- a term of both is corrected once more, from the term's postings joined with themselves; corrections of zero are left out.

Documents are counted in each task before anything is shuffled (at most FLUSH terms at a time), so a source that holds a third of all
rows, or a word that every document holds, is a few rows for each task. Joins are on terms, sources and languages of these counts.
All arithmetic is exact: decimals where products may exceed a long.

Defined cases: null text has no terms; null lang and source are ''; rows with the same doc_id are documents of their own; texts count whole,
however long; a source without terms, or of a language that keeps none, has its pairs all the same (value 0 if V = 0); ties are
ordered by item; an empty table gives an empty result; extra columns do not matter, as only text, lang and source are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialise, table

MIN_DOCS = 30
UNIT, PRIOR = 1_000_000_000, 5
TERM_RANKS = 50
FLUSH = 200_000
OUT = 20_000

#: ASCII letters lower-cased, other ASCII to blanks, bytes of other characters as they are.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or "").encode().translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(text, lang, source) -> lang, source, term, n (occurrences), docs (documents that hold it); a row with term null
    for each lang and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_) in found.items():
                rows = iter([(None, 0, 0), *((t.decode(), c, docs_[t]) for t, c in n.items())])
                while some := list(islice(rows, OUT)):
                    names, counts, held = zip(*some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(held, pa.int64())],
                        ["lang", "source", "term", "n", "docs"],
                    )
            found.clear()

        size = 0
        for b in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns)):
                n, docs_ = found.setdefault((lang, source), (Counter(), Counter()))
                ws = terms(text)
                size -= len(n)
                n.update(ws)
                docs_.update(set(ws))
                size += len(n)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    partial = docs.select("text", *named).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a term that occurs `count` times; null if no term is kept."""
    top = (count + PRIOR).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    bottom = total.cast("decimal(19,0)") + kept.cast("decimal(19,0)") * PRIOR
    return F.when(kept > 0, F.call_function("div", top, bottom) + 1)


class Index:
    """Postings (lang, source, term, n, total, p, q, z) of kept terms and groups (lang, source, total, kept, z), as tables in the shared
    folder. p and z are the source's shares of the term and of a term that it lacks, q is the language's share."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS):
        counts = materialise(term_counts(docs), "counts")
        held = counts.where(F.col("term").isNotNull())
        kept = held.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("overall")).where(F.col("docs") >= min_docs).drop("docs")
        found = materialise(held.join(kept, ["lang", "term"]).drop("docs"), "postings")
        langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("overall").alias("lang_total"))
        of_source = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where(F.col("term").isNull()).select("lang", "source").join(langs, "lang", "left").join(of_source, ["lang", "source"], "left")
        groups = groups.fillna(0, ["kept", "lang_total", "total"])
        self.groups = materialise(groups.withColumn("z", F.coalesce(share(F.lit(0), F.col("total"), F.col("kept")), F.lit(0))), "groups")
        posted = found.join(self.groups, ["lang", "source"])
        p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("overall"), F.col("lang_total"), F.col("kept"))
        self.postings = materialise(posted.select("lang", "source", "term", p.alias("p"), q.alias("q"), "z"), "shares")


def lone(p: Column, z: Column, other: Column) -> Column:
    """What a term of share p adds to |z - other| if the other source, of share `other` for terms that it lacks, lacks it."""
    return p + z - 2 * F.least(F.greatest(other, z), p)


def differences(index: Index) -> DataFrame:
    """lang, a, b (a < b), value: the difference of each pair of sources of a language."""
    g, t = index.groups, index.postings
    a, b = (g.select("lang", F.col("source").alias(s), F.col("z").alias(f"z{s}"), F.col("kept").alias(f"v{s}")) for s in "ab")
    pairs = a.join(b, "lang").where(F.col("a") < F.col("b"))
    base = pairs.select("lang", "a", "b", (F.col("va") * F.abs(F.col("za") - F.col("zb"))).alias("value"))

    alike = t.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("k"))
    others = g.select("lang", F.col("source").alias("other"), F.col("z").alias("zo"))
    ends = [f("source", "other").alias(s) for f, s in ((F.least, "a"), (F.greatest, "b"))]
    one = alike.join(others, "lang").where(F.col("source") != F.col("other"))
    one = one.select("lang", *ends, (F.col("k") * lone(F.col("p"), F.col("z"), F.col("zo"))).alias("value"))

    x, y = (t.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p{s}"), F.col("z").alias(f"z{s}")) for s in "ab")
    both = x.join(y, ["lang", "term"]).where(F.col("a") < F.col("b"))
    pa_, pb, za, zb = (F.col(c) for c in ("pa", "pb", "za", "zb"))
    more = F.abs(pa_ - pb) - F.abs(za - zb) - lone(pa_, za, zb) - lone(pb, zb, za)
    both = both.select("lang", "a", "b", more.alias("value")).where(F.col("value") != 0)

    summed = [df.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for df in (one, both)]
    return base.unionByName(summed[0]).unionByName(summed[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """docs(text, lang, source) -> lang, source, part, item, value, rank: each source's distance from every other one, and the terms
    that it uses more than its language does."""
    index = Index(docs, min_docs)
    d = differences(index)
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = d.select("lang", sides.alias("s"), "value").select("lang", "s.source", "s.item", "value")
    over = index.postings.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair"))
    over = over.withColumn("rank", rank).where(F.col("rank") <= term_ranks).withColumn("part", F.lit("term"))
    return pairs.unionByName(over).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all documents against the others of their language, and their 50 most over-used terms."""
    return audit(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _share(c: str, n: str) -> str:
    return f"(1 + ({UNIT}::hugeint * ({c} + {PRIOR})) // ({n} + {PRIOR} * v))::bigint"


_SQL = f"""
with d as (select row_number() over () as r, coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(t, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term, count(*) as c from w group by lang, term having count(distinct r) >= {MIN_DOCS}),
l as (select lang, count(*) as v, sum(c) as nl from kept group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as c from w join kept k using (lang, term) group by all),
n as (select lang, source, sum(c) as n from c group by all),
s as (select lang, source, coalesce(n, 0) as n, v, nl from g join l using (lang) left join n using (lang, source)),
p as (select lang, source, term, coalesce(c.c, 0) as c, {_share("coalesce(c.c, 0)", "n")} as p, {_share("k.c", "nl")} as q
    from s join kept k using (lang) left join c using (lang, source, term)),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source != b.source
    left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
o as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', term, p - q from p where c > 0 and p > q),
ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from o)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TERM_RANKS}
"""

QUERIES = {"op11_divergence": op11_divergence}
ORACLES = {"op11_divergence": _SQL}
