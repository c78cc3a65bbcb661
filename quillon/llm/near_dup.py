"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of word shingles, banded, then verified as multisets.

A text is the multiset of its windows of SHINGLE words (a shorter text: one window of all its words). The similarity of two
texts is the multiset Jaccard: the sum of the lesser counts over the sum of the greater; SIMILARITY or more is a link.

Signature (BagMinHash with dyadic weight levels): the counts of a shingle are cut into the intervals [0, 1), [1, 2),
[2, 4), [4, 8), ... Each interval has a Poisson process of its own whose rate is its width times the number of signature
components; each point has a component and a level within the interval, and belongs to the texts whose count reaches that
level. A component's value is the first point that belongs to the text, so two texts agree in it with the probability of
their multiset Jaccard. Points are drawn in order of time and only up to a time by which all components are likely
filled, so a text needs about m ln m points besides one for each shingle; where a component is still open, the time is
doubled. All texts of a batch are drawn at once in numpy.

BANDS bands of ROWS components (a pair at 0.8 shares a band with probability 0.99993) give buckets. Equal texts are one
node, identified by the MD5 of the text, so copies cost nothing here. Links within buckets are found without all pairs, and
none is left out:

1. Every node of a bucket is compared with the bucket's centre, the node that meets most others over all bands. In a bucket
   of near copies that links nearly all. ROUNDS - 1 more centres, each from the nodes that are still apart, link
   groups of their own.
2. What is left are pairs in different components. Let x, y and c be the vectors of shingle counts of two nodes and their
   centre. L1(x, y) is the distance between the differences x - c and y - c, and a link means that it is at most (|x| + |y|) / 9
   (for 0.8). So both differences must share at least (|x - c| + |y - c| - (|x| + |y|) / 9) / 2 of their units, which is 1
   or more unless both are linked to c. By the prefix filter for set joins, two nodes that share s of their units share one
   within the first n - s + 1 of each in any fixed order: the rarest of the centre's nodes first, as independent edits have
   units of their own. Only those prefixes (a quarter of a text at most) are joined, without units that one node alone has.

The texts of the pairs that this leaves are compared, too. Every table is as long as the members of buckets, or shorter than
their texts; no key but a centre's own has more than one row a member.

Defined cases: null text counts as empty; texts without a word are near-duplicates of their equals only; very long texts are
taken whole; class_id is the least doc_id of the class (null only if all are); repeated rows are copies; an empty table gives
no rows; extra columns, whatever their names, do not matter to classify() and stay with keep_one(), which keeps of rows with the
same doc_id in one class the one whose JSON has the least hash, so that order and partitions do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialise, parts, table
from quillon.llm.components import components
from quillon.llm.wordhash import MULTIPLIER, hashes, mix, split, times, windows

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
SIZE = BANDS * ROWS
ROUNDS = 2
STEP = 256  # texts drawn at once


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, sorted, and their counts."""
    words = hashes().of(split(text))
    return np.unique(windows(words, min(SHINGLE, len(words))) if len(words) else words, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Multiset Jaccard."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - shared
    return shared / whole if whole else 1.0


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """A row of `size` 64-bit values for each bag (distinct hashes, counts); rows of zeros for empty bags."""
    out = np.zeros((len(bags), size), np.uint64)
    weight = np.array([c.sum() for _, c in bags], np.float64)
    todo, factor = np.flatnonzero(weight > 0), 1.0
    while len(todo):
        keys = np.concatenate([bags[i][0] for i in todo])
        counts = np.concatenate([bags[i][1] for i in todo])
        doc = np.repeat(np.arange(len(todo)), [len(bags[i][0]) for i in todo])
        until = factor * (np.log(size) + 4) / weight[todo]
        first = np.full(len(todo) * size, np.inf)
        value = np.zeros(len(todo) * size, np.uint64)
        low, width = 0, 1  # the interval of counts [low, low + width)
        while len(keys):
            _draw(keys + times(low), counts, doc, low, width, until, first, value, size)
            low, width = low + width, max(1, low + width)
            more = counts > low
            keys, counts, doc = keys[more], counts[more], doc[more]
        full = np.isfinite(first).reshape(len(todo), size).all(axis=1)
        out[todo[full]] = value.reshape(len(todo), size)[full]
        todo, factor = todo[~full], factor * 2
    return out


def _draw(seeds, counts, doc, low, width, until, first, value, size) -> None:
    """The points of one interval's process for each key up to its text's time, into first (times) and value."""
    seeds, time, number = mix(seeds), np.zeros(len(seeds)), 0
    while len(seeds):
        number += 1
        point = mix(seeds + times(number))
        time = time - np.log(_uniform(point)) / (width * size)
        alive = time < until[doc]
        if not alive.all():
            seeds, time, doc, counts, point = seeds[alive], time[alive], doc[alive], counts[alive], point[alive]
        where = mix(point)
        at = doc * size + ((where >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        own = slice(None)
        if width > 1:
            own = low + (_uniform(mix(where)) * width).astype(np.int64) < counts
        np.minimum.at(first, at[own], time[own])
        hit = first[at[own]] == time[own]
        value[at[own][hit]] = point[own][hit]


def node(text: Column) -> Column:
    """The identity of a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sign(docs: DataFrame, *keep: str) -> DataFrame:
    """docs(doc_id, text, keep) -> doc_id, keep (longs), node, bands (BANDS 64-bit keys as bytes)."""
    same = ["doc_id", *keep, "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * MULTIPLIER
        for whole in batches:
            for at in range(0, len(whole), STEP):
                b = whole.slice(at, STEP)
                bags = [shingles(t.as_py()) for t in b.column("text")]
                parts = signatures(bags).reshape(len(bags), BANDS, ROWS)
                key = np.zeros((len(bags), BANDS), np.uint64) + salt
                for k in range(ROWS):
                    key = mix(key * MULTIPLIER + parts[:, :, k])
                bands = [row.tobytes() if len(bag[0]) else b"" for row, bag in zip(key, bags)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in same), pa.array(bands, pa.binary())], [*same, "bands"])

    schema = "".join(f"{c} long, " for c in ("doc_id", *keep)) + "node binary, bands binary"
    return docs.select("doc_id", *keep, node(F.col("text")).alias("node"), "text").mapInArrow(run, schema)


def _buckets(signed: DataFrame) -> DataFrame:
    """(band, node, size): the buckets with two nodes or more."""
    nodes = signed.groupBy("node").agg(F.first("bands").alias("bands"))
    part = F.expr("transform(sequence(0, length(bands) div 8 - 1), i -> xxhash64(i, substring(bands, i * 8 + 1, 8)))")
    members = nodes.where(F.length("bands") > 0).select(F.explode(part).alias("band"), "node")
    sizes = members.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    return members.join(sizes, "band")


def slack(least: float) -> Fraction:
    """Two bags are linked if their L1 distance is at most this share of their sizes' sum."""
    least = Fraction(least).limit_denominator(10**6)
    return (1 - least) / (1 + least)


def difference(a: tuple[np.ndarray, np.ndarray], c: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The units of a - c as hashes: a shingle that a has k times more, or less, often than c gives k of one kind."""
    keys = np.union1d(a[0], c[0])
    count = np.zeros(len(keys), np.int64)
    count[np.searchsorted(keys, a[0])] += a[1]
    count[np.searchsorted(keys, c[0])] -= c[1]
    n = np.abs(count)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mix(np.repeat(keys * np.uint64(2) + (count > 0), n) + number.astype(np.uint64) * MULTIPLIER)


def prefix(n: Column, weight: Column, linked: Column, least: float) -> Column:
    """How many units of a difference of n, of a bag of `weight`, can be the first that it shares with a bag that it is linked to
    but that is in another component: that bag has at most weight * (1 + slack) / (1 - slack) shingles, and a difference of n less
    the bound of their distance at least; if this bag is linked to the centre, that one is not."""
    share = slack(least)
    far, half = share * 2 / (1 - share), (1 - share) / 2
    some = F.greatest(F.lit(1), n - F.floor(weight * far.numerator / far.denominator + 1e-6))
    return n + 1 - F.when(linked, F.greatest(some, F.floor(n * half.numerator / half.denominator - 1e-6) + 1)).otherwise(some)


def _compared(pairs: DataFrame, texts: DataFrame, least: float, units: bool) -> DataFrame:
    """pairs(a, b) -> a, b, linked; with units also weight (of a) and the units of the difference to b."""
    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, None
        for whole in batches:
            for at in range(0, len(whole), STEP):
                b = whole.slice(at, STEP)
                linked, weight, units_ = [], [], []
                for x, y, key in zip(b.column("text_a"), b.column("text_b"), b.column("b")):
                    if key.as_py() != last:  # rows of one centre follow each other
                        last, centre = key.as_py(), shingles(y.as_py())
                    bag = shingles(x.as_py())
                    linked.append(similarity(bag, centre) >= least)
                    if units:
                        weight.append(int(bag[1].sum()))
                        units_.append(difference(bag, centre).view(np.int64))
                made = [b.column("a"), b.column("b"), pa.array(linked, pa.bool_())]
                if units:
                    ends = pa.array(np.cumsum([0, *map(len, units_)]), pa.int32())
                    made += [pa.array(weight, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(units_) if units_ else np.empty(0, np.int64)))]
                yield pa.RecordBatch.from_arrays(made, ["a", "b", "linked", "weight", "units"][: len(made)])

    schema = "a binary, b binary, linked boolean" + ", weight long, units array<long>" * units
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def _with_root(rows: DataFrame, roots: DataFrame, node_: str, root: str) -> DataFrame:
    """rows and the root of the node in column node_: itself where it has no link."""
    named = roots.select(F.col("node").alias(node_), F.col("root").alias(root))
    return rows.join(named, node_, "left").withColumn(root, F.coalesce(root, node_))


def _sharing(stars: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(a, b): nodes of one centre and different components whose differences to it share a unit of their prefixes."""
    rows = _with_root(_with_root(stars, roots, "a", "root"), roots, "b", "root_b").withColumn("odd", F.col("root") != F.col("root_b"))
    rows = rows.join(rows.where("odd").select("b").distinct(), "b", "left_semi")
    each = rows.select("b", "a", F.explode("units").alias("unit"))
    common = each.groupBy("b", "unit").agg(F.count("*").alias("times")).where(F.col("times") > 1)
    common = each.join(common, ["b", "unit"]).groupBy("b", "a").agg(F.sort_array(F.collect_list(F.struct("times", "unit"))).alias("common"))
    n = F.size("units").cast("long")
    rows = rows.select("b", "a", F.xxhash64("root").alias("root"), "odd", "weight", n.alias("n"), prefix(n, F.col("weight"), F.col("linked"), least).alias("prefix"))
    rows = rows.join(common, ["b", "a"]).withColumn("alone", F.col("n") - F.size("common"))  # units without a partner come first
    rows = rows.withColumn("common", F.slice("common", F.lit(1), F.greatest(F.col("prefix") - F.col("alone"), F.lit(0)).cast("int")))
    rows = rows.select("b", "a", "root", "odd", "weight", "n", "alone", F.posexplode("common").alias("at", "unit"))
    rows = rows.select(F.xxhash64("b", "unit.unit").alias("key"), F.col("a").alias("node"), "root", "odd", "weight", "n", (F.col("alone") + F.col("at")).alias("at"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("odd").alias("any")).where(F.col("any") & (F.col("low") != F.col("high"))).select("key")
    rows = rows.join(mixed, "key", "left_semi")
    x, y = rows.where("odd").alias("x"), rows.alias("y")
    share = slack(least)
    reach = (F.col("x.weight") + F.col("y.weight")) * F.lit(share.numerator) / F.lit(share.denominator)
    both = F.ceil((F.col("x.n") + F.col("y.n") - reach) / 2 - 1e-6)  # units that a link would share
    near = (F.col("x.root") != F.col("y.root")) & (~F.col("y.odd") | (F.col("x.node") < F.col("y.node"))) & (F.abs(F.col("x.n") - F.col("y.n")) <= reach + 1e-6)
    near = near & (F.col("x.at") <= F.col("x.n") - both) & (F.col("y.at") <= F.col("y.n") - both)
    return x.join(y, (F.col("x.key") == F.col("y.key")) & near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def classify(docs: DataFrame, least: float = SIMILARITY, *keep: str) -> DataFrame:
    """docs(doc_id, text, keep) -> doc_id, keep (longs), node, root (a node of the class), class_id (least doc_id of the class)."""
    signed = materialise(sign(docs, *keep), "signed")
    n = signed.count()
    members = materialise(_buckets(signed), "buckets", parts(BANDS * n))
    n_members = members.count()
    rank = members.groupBy("node").agg(F.sum("size").alias("meets"))
    texts = docs.select(node(F.col("text")).alias("node"), "text").join(rank.select("node"), "node", "left_semi").dropDuplicates(["node"])
    texts = materialise(texts, "texts", parts(BANDS * n))
    open_ = materialise(members.join(rank, "node").select("band", "node", "meets"), "open", parts(n_members))
    links, roots, stars = None, None, None
    for k in range(ROUNDS):
        centres = open_.groupBy("band").agg(F.max(F.struct("meets", "node"))["node"].alias("centre"))
        met = open_.join(centres, "band").where(F.col("node") != F.col("centre"))
        found = materialise(_compared(met.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), texts, least, units=not k), "compared", parts(BANDS * n_members))
        stars = stars or found
        new = found.where("linked").select("a", "b")
        links = new if links is None else links.union(new)
        roots = components(links)
        if k < ROUNDS - 1:
            apart = _with_root(_with_root(met, roots, "node", "root"), roots, "centre", "root_c").where(F.col("root") != F.col("root_c"))
            open_ = materialise(apart.select("band", "node", "meets"), "open", parts(n_members))
    late = materialise(_compared(_sharing(stars, roots, least).distinct(), texts, least, units=False).where("linked").select("a", "b"), "late", parts(BANDS * n_members))
    if not late.isEmpty():
        roots = components(links.union(late))
    rooted = _with_root(signed.drop("bands"), roots, "node", "root")
    classes = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rooted.join(classes, "root").select("doc_id", *keep, "node", "root", "class_id")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents without their near-duplicates: of each class one with the least doc_id stays."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row")).select(F.col("row"), F.coalesce(F.col("row.doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(F.to_json("row")).alias("mark"))
    classes = classify(rows.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text"), "mark"), least, "mark")
    best = classes.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.mark").alias("mark"))
    return rows.join(best, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"]).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class."""
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


QUERIES = {"op9_near_duplicates": op9_near_duplicates}
ORACLES: dict[str, str] = {}
