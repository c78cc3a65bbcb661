"""Queries that search: texts by an inverted index, texts and vectors together, many vectors at once."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators import fulltext, knn
from quillon.operators.fulltext import B, K1, UPPER, TextIndex
from quillon.operators.ivf import IvfConfig, IvfIndex
from quillon.operators.sparse_search import SparseIndex
from quillon.plans.catalog import _KNN, query
from quillon.sources.tables import scratch_path, table


def _index(spark, sf) -> TextIndex:
    return TextIndex.build(table(spark, sf, "documents"), scratch_path(spark, "text"))


def _terms(t: str) -> str:
    return f"regexp_extract_all(translate(coalesce({t}, ''), '{UPPER}', '{UPPER.lower()}'), '[\\p{{L}}\\p{{N}}]+')"


#: Every document's score for every benchmark item, from all terms of both.
_BM25 = f"""w as (select doc_id, unnest({_terms('text')}) as term from documents where doc_id is not null),
tf as (select doc_id, term, count(*) as tf from w group by all), df as (select term, count(*) as df from tf group by 1),
len_ as (select d.doc_id, count(term) as length from (select distinct doc_id from documents where doc_id is not null) d left join w using (doc_id) group by 1),
stat as (select count(*) as n, avg(length) as mean from len_),
asked as (select distinct item_id as query_id, unnest({_terms('text')}) as term from benchmark),
bm as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * length / mean))), 9) as score from asked join tf using (term) join df using (term) join len_ using (doc_id), stat group by 1, 2),
text_rank as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from bm)"""


@query("text_search", f"with {_BM25} select query_id, doc_id, round(score, 6) as score, rank from text_rank where rank <= 10")
def text_search(spark, sf):
    """The ten best of all documents for each benchmark item."""
    queries = table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    return _index(spark, sf).search_batch(queries, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("text_search_single", f"with {_BM25} select doc_id, round(score, 6) as score from text_rank where query_id = (select min(item_id) from benchmark) and rank <= 10")
def text_search_single(spark, sf):
    """The ten best of all documents for the first benchmark item."""
    first = table(spark, sf, "benchmark").orderBy("item_id").first()
    return _index(spark, sf).search(first["text"] if first else "", 10).select("doc_id", F.round("score", 6).alias("score"))


@query("hybrid_search", f"""with {_BM25}, e as (select vec_id, embedding::double[] as x from embeddings),
    d as (select q.vec_id as query_id, e.vec_id as doc_id, round({_KNN['cosine']}, 9) as d from e q join e on q.vec_id in (select item_id from benchmark)),
    vector_rank as (select *, row_number() over (partition by query_id order by d, doc_id) as rank from d),
    f as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as score from (select query_id, doc_id, rank from text_rank where rank <= 20 union all select query_id, doc_id, rank from vector_rank where rank <= 20) group by 1, 2)
    select query_id, doc_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from f) where rank <= 10""")
def hybrid_search(spark, sf):
    """All documents by text and by vector; a benchmark item's vector is the one with its number."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    items = table(spark, sf, "benchmark").join(vectors.withColumnRenamed("doc_id", "item_id"), "item_id", "left").withColumnRenamed("item_id", "query_id")
    return fulltext.hybrid_search(_index(spark, sf), vectors, items, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("knn_many", f"""with e as (select vec_id, embedding::double[] as x from embeddings), d as (select q.vec_id as query_id, e.vec_id, round({_KNN['l2']}, 9) as d from e q join e on e.vec_id <> q.vec_id)
    select query_id, vec_id, round(d, 6) as distance, rank from (select *, row_number() over (partition by query_id order by d, vec_id)::int as rank from d) where rank <= 3""")
def knn_many(spark, sf):
    """The three nearest of every vector."""
    e = table(spark, sf, "embeddings")
    return knn.nearest_batch(e, e, 3, "l2").select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


# Inverted lists.

def _points(spark, sf, dims: int):
    """A point of the unit cube for each line item, from hashes of its key."""
    unit = lambda i: (F.pmod(F.xxhash64("vec_id", F.lit(i)), F.lit(1 << 30)) / float(1 << 30)).cast("float")
    lines = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("vec_id")).distinct()
    return lines.select("vec_id", F.array(*[unit(i) for i in range(dims)]).alias("embedding"))


#: kind, dimensions, metric and the recall that so many probed lists of 100 must reach for 20 neighbours.
FLOORS = (
    ("vector", 3, "l2", ((1, 0.71), (10, 0.95), (100, 1.0))),
    ("half", 10, "l2", ((1, 0.33), (10, 0.93), (100, 1.0))),
    ("bit", 52, "hamming", ((1, 0.08), (10, 0.5), (100, 1.0))),
)


def _floors(spark, sf, kind, dims, metric, floors):
    """Recall of the neighbours of every line item of an order whose number is divisible by 3,000."""
    made = {"vector": F.col("embedding"), "half": V.to_half("embedding"), "bit": V.binary_quantize(F.transform("embedding", lambda x: x - 0.5))}[kind]
    path = scratch_path(spark, "points")
    _points(spark, sf, dims).withColumn("embedding", made).write.parquet(path)
    e = spark.read.parquet(path)
    q = e.where("vec_id div 8 % 3000 = 0")
    index = IvfIndex.build(e, scratch_path(spark, "ivf"), IvfConfig(lists=100, metric=metric, kind=kind))
    truth = scratch_path(spark, "exact")
    knn.nearest_batch(e, q, 20, metric).write.parquet(truth)
    out = None
    for probes, floor in floors:
        met = knn.tied_recall(index.search_batch(q, 20, probes), spark.read.parquet(truth))
        one = met.agg(F.lit(probes).alias("probes"), F.count("*").alias("queries"), (F.avg("recall") >= floor).alias("reached"))
        out = one if out is None else out.union(one)
    return out


for _kind, _dims, _metric, _list in FLOORS:
    query(f"ivf_{_kind}_floors", f"select unnest({[p for p, _ in _list]})::int as probes, count(distinct l_orderkey * 8 + l_linenumber) as queries, true as reached from lineitem where l_orderkey % 3000 = 0")(
        lambda spark, sf, a=(_kind, _dims, _metric, _list): _floors(spark, sf, *a)
    )


_FILTERED = f"""with e as (select vec_id, label, embedding::double[] as x from embeddings), d as (select q.vec_id as query_id, e.vec_id, e.label, q.label as own, round({_KNN['l2']}, 9) as d from e q join e on q.vec_id % 100 = 0 and e.vec_id <> q.vec_id)"""


@query("ivf_filtered", f"{_FILTERED} select query_id, vec_id, round(d, 6) as distance, rank from (select *, row_number() over (partition by query_id order by d, vec_id)::int as rank from d where label = 3) where rank <= 10")
def ivf_filtered(spark, sf):
    """A filter that few rows pass: queries probe on until they have ten, and up to all lists there is nothing to miss."""
    e = table(spark, sf, "embeddings")
    index = IvfIndex.build(e, scratch_path(spark, "ivf"), IvfConfig(lists=16, probes=16))
    return index.search_batch(e.where("vec_id % 100 = 0"), 10, where=F.col("label") == 3, iterative=True).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query("ivf_filtered_rounds", "select count(*) as queries, 10 as least, true as reached from embeddings where vec_id % 100 = 0")
def ivf_filtered_rounds(spark, sf):
    """From one list on: every query gets its ten rows, in rounds of twice as many lists."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0")
    index = IvfIndex.build(e, scratch_path(spark, "ivf"), IvfConfig(lists=16))
    found = index.search_batch(q, 10, where=F.col("label") == 3, iterative=True)
    held = found.groupBy("query_id").count().agg(F.count("*").alias("queries"), F.min("count").cast("int").alias("least"))
    recall = knn.recall(found, knn.nearest_batch(e.where("label = 3"), q, 10, "l2")).agg((F.avg("recall") >= 0.3).alias("reached"))
    return held.withColumn("reached", recall.scalar())


@query("ivf_relaxed_strict", "select vec_id as query_id, 10::bigint as n, true as same, true as ordered from embeddings where vec_id % 100 = 0")
def ivf_relaxed_strict(spark, sf):
    """The rows of a relaxed search in strict order: as many, the same ones, none nearer than the one before it."""
    e = table(spark, sf, "embeddings")
    index = IvfIndex.build(e, scratch_path(spark, "ivf"), IvfConfig(lists=16))
    path = scratch_path(spark, "relaxed")
    index.search_batch(e.where("vec_id % 100 = 0"), 10, where=F.col("label") == 3, iterative=True, relaxed=True).write.parquet(path)
    relaxed = spark.read.parquet(path)
    strict = knn.strict_order(relaxed).withColumn("before", F.lag("distance").over(Window.partitionBy("query_id").orderBy("rank")))
    both = strict.join(relaxed.select("query_id", "vec_id", F.col("rank").alias("place")), ["query_id", "vec_id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("n"), (F.count("place") == 10).alias("same"), F.every(F.coalesce(F.col("distance") >= F.col("before"), F.col("rank") == 1)).alias("ordered"))


@query("ivf_partitioned", f"{_FILTERED} select query_id, vec_id, round(d, 6) as distance, rank from (select *, row_number() over (partition by query_id order by d, vec_id)::int as rank from d where label = own) where rank <= 10")
def ivf_partitioned(spark, sf):
    """An index laid out by label: each query reads the folders of its own label."""
    e = table(spark, sf, "embeddings")
    index = IvfIndex.build(e, scratch_path(spark, "ivf"), IvfConfig(lists=8, probes=8), partition="label")
    return index.search_batch(e.where("vec_id % 100 = 0"), 10, by="label").select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query("ivf_partial", f"{_FILTERED} select query_id, vec_id, round(d, 6) as distance, rank from (select *, row_number() over (partition by query_id order by d, vec_id)::int as rank from d where label in (1, 2)) where rank <= 5")
def ivf_partial(spark, sf):
    """An index of the rows of two labels."""
    e = table(spark, sf, "embeddings")
    index = IvfIndex.build(e, scratch_path(spark, "ivf"), IvfConfig(lists=8, probes=8), where=F.col("label").isin(1, 2))
    return index.search_batch(e.where("vec_id % 100 = 0"), 5).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


# Sparse vectors of many dimensions.

def _term_vectors(spark, sf):
    """How often each document has each term, in 2 ** 28 dimensions."""
    words = table(spark, sf, "documents").where("doc_id is not null").select(F.col("doc_id").alias("vec_id"), F.explode(fulltext.terms("text")).alias("term"))
    index = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 7), 16, 10).cast("int")
    by = words.groupBy("vec_id", index.alias("index")).agg(F.count("*").cast("float").alias("value"))
    e = F.sort_array(F.collect_list(F.struct("index", "value")))
    vector = F.struct(F.lit(1 << 28).alias("dim"), F.transform(e, lambda x: x["index"]).alias("indices"), F.transform(e, lambda x: x["value"]).alias("values"))
    return by.groupBy("vec_id").agg(vector.alias("embedding"))


@query("sparse_top", f"""with w as (select doc_id, unnest({_terms('text')}) as term from documents where doc_id is not null), v as (select doc_id, ('0x' || substr(md5(term), 1, 7))::bigint as i, count(*)::double as x from w group by 1, 2),
    s as (select q.doc_id as query_id, e.doc_id as vec_id, sum(q.x * e.x) as score from v q join v e on e.i = q.i and e.doc_id <> q.doc_id where q.doc_id % 100 = 0 group by 1, 2)
    select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 10""")
def sparse_top(spark, sf):
    """The ten documents that share most with each whose number is divisible by 100."""
    path = scratch_path(spark, "terms")
    _term_vectors(spark, sf).write.parquet(path)
    e = spark.read.parquet(path)
    return SparseIndex.build(e, scratch_path(spark, "sparse")).search_batch(e.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", "score", "rank")
