"""Registered queries over the star-schema tables and their SQL counterparts in DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import sparse as S
from quillon.functions import text as X
from quillon.functions import vectors as V
from quillon.operators import corpus, knn, logs
from quillon.operators.ordering import place
from quillon.sources.tables import table
from quillon.streaming.rates import sessions as event_sessions
from quillon.streaming.rates import windowed_over_rate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


DIMS = 64
r6 = lambda c, name: F.round(c, 6).alias(name)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector and the next one by id, both kept as a and b."""
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.select("vec_id", "label", F.col("embedding").alias("a")).join(nxt, "vec_id")


_P = """with e as (select vec_id, label, embedding::double[] as x from embeddings), p as (select e.vec_id, e.label, e.x as a, n.x as b from e join e n on n.vec_id = e.vec_id + 1)
"""
_dot = "list_inner_product(a, b)"

# Vectors: scalar functions.

for _name, _f, _sql in (
    ("l2_distance", V.l2_distance, "sqrt(list_sum([(a[i] - b[i]) * (a[i] - b[i]) for i in range(1, 65)]))"),
    ("l2_squared_distance", V.l2_squared_distance, "list_sum([(a[i] - b[i]) * (a[i] - b[i]) for i in range(1, 65)])"),
    ("inner_product", V.inner_product, _dot),
    ("negative_inner_product", V.negative_inner_product, f"-{_dot}"),
    ("cosine_distance", V.cosine_distance, f"1 - greatest(-1, least(1, {_dot} / sqrt(list_inner_product(a, a) * list_inner_product(b, b))))"),
    ("l1_distance", V.l1_distance, "list_sum([abs(a[i] - b[i]) for i in range(1, 65)])"),
    ("spherical_distance", V.spherical_distance, f"acos(greatest(-1, least(1, {_dot}))) / pi()"),
):
    query(f"vector_{_name}", f"{_P}select vec_id, round({_sql}, 6) as v from p")(lambda spark, sf, f=_f: _pairs(spark, sf).select("vec_id", r6(f("a", "b"), "v")))
    if _name != "spherical_distance":
        _g = getattr(S, _name, None)
        if _g:
            cut = lambda c: S.from_dense(F.transform(c, lambda x: F.when(F.abs(x) < 0.1, F.lit(0.0).cast("float")).otherwise(x)))
            query(f"sparse_{_name}", _P.replace("embedding::double[] as x", "[case when abs(y) < 0.1 then 0 else y end for y in embedding::double[]] as x") + f"select vec_id, round({_sql}, 6) as v from p")(
                lambda spark, sf, f=_g: _pairs(spark, sf).select("vec_id", cut(F.col("a")).alias("a"), cut(F.col("b")).alias("b")).select("vec_id", r6(f("a", "b"), "v"))
            )


@query("vector_norm_dims", "select vec_id, len(embedding) as dims, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as norm from embeddings")
def vector_norm_dims(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.dims("embedding").alias("dims"), r6(V.norm("embedding"), "norm"))


@query("vector_normalize", """
with e as (select vec_id, embedding::double[] as x from embeddings)
select vec_id, round(list_sum([x[i] * i for i in range(1, 65)]) / sqrt(list_inner_product(x, x)), 3) as v from e""")
def vector_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.l2_normalize("embedding").alias("u"))
    return e.select("vec_id", F.round(F.aggregate(F.transform("u", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x), 3).alias("v"))


for _name, _f, _op in (("add", V.add, "+"), ("subtract", V.subtract, "-"), ("multiply", V.multiply, "*")):
    query(f"vector_{_name}", f"{_P}select vec_id, round(list_sum([((a[i] {_op} b[i])::float)::double * i for i in range(1, 65)]), 4) as v from p")(
        lambda spark, sf, f=_f: _pairs(spark, sf).select("vec_id", f("a", "b").alias("u")).select("vec_id", F.round(F.aggregate(F.transform("u", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias("v"))
    )


@query("vector_concat_subvector", f"{_P}select vec_id, len(a || b)::int as n, round(list_sum((a || b)[60:69]), 6) as v, least(64 - 60 + 1, 10)::int as tail from p")
def vector_concat_subvector(spark, sf):
    p = _pairs(spark, sf).select("vec_id", "a", V.concat("a", "b").alias("ab"))
    return p.select("vec_id", F.size("ab").alias("n"), r6(F.aggregate(V.subvector("ab", 60, 10), F.lit(0.0), lambda s, x: s + x.cast("double")), "v"), F.size(V.subvector("a", 60, 10)).alias("tail"))


@query("vector_compare", f"{_P}select vec_id, case when a < b then -1 when a > b then 1 else 0 end as cmp, a < b as lt, a <= b as le, a = b as eq, a <> b as ne, a >= b as ge, a > b as gt from p")
def vector_compare(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf).select("vec_id", V.compare("a", "b").alias("cmp"), (a < b).alias("lt"), (a <= b).alias("le"), (a == b).alias("eq"), (a != b).alias("ne"), (a >= b).alias("ge"), (a > b).alias("gt"))


@query("vector_order", "select vec_id, row_number() over (order by embedding, vec_id) as place from embeddings")
def vector_order(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return place(e, "embedding", "vec_id").select("vec_id", "place")


@query("vector_text_round_trip", "select vec_id, len(embedding)::int as n, true as same from embeddings")
def vector_text_round_trip(spark, sf):
    back = V.parse(V.format_("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.size(back).alias("n"), (back == F.col("embedding")).alias("same"))


@query("vector_casts", "select o_orderkey, o_custkey::double + 2 * round(o_totalprice)::double as v, 2 as dims from orders")
def vector_casts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", V.from_array(F.array(F.col("o_custkey").cast("double"), F.round("o_totalprice")), 2).alias("v"))
    return o.select("o_orderkey", (V.to_array("v")[0].cast("double") + 2 * V.to_array("v")[1].cast("double")).alias("v"), V.dims("v").alias("dims"))


@query("half_l2_distance", """
with h as (select vec_id, [case when y = 0 then 0 else round_even(y / pow(2, greatest(floor(log2(abs(y))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(y))), -14) - 10) end for y in embedding::double[]] as x from embeddings)
select e.vec_id, round(sqrt(list_sum([(e.x[i] - n.x[i]) * (e.x[i] - n.x[i]) for i in range(1, 65)])), 6) as v from h e join h n on n.vec_id = e.vec_id + 1""")
def half_l2_distance(spark, sf):
    p = _pairs(spark, sf).select("vec_id", V.to_half("a").alias("a"), V.to_half("b").alias("b"))
    return p.select("vec_id", r6(V.l2_distance("a", "b"), "v"))


@query("bit_distances", f"""{_P}, q as (select vec_id, [y > 0 for y in a] as a, [y > 0 for y in b] as b from p)
select vec_id, len([1 for i in range(1, 65) if a[i] <> b[i]])::double as hamming,
    round(case when len([1 for i in range(1, 65) if a[i] and b[i]]) = 0 then 1 else 1 - len([1 for i in range(1, 65) if a[i] and b[i]])::double / len([1 for i in range(1, 65) if a[i] or b[i]]) end, 6) as jaccard from q""")
def bit_distances(spark, sf):
    p = _pairs(spark, sf).select("vec_id", V.binary_quantize("a").alias("a"), V.binary_quantize("b").alias("b"))
    return p.select("vec_id", V.hamming_distance("a", "b").alias("hamming"), r6(V.jaccard_distance("a", "b"), "jaccard"))


@query("sparse_round_trip", "select vec_id, len([1 for y in embedding if abs(y) >= 0.1])::int as entries, round(sqrt(list_sum([y::double * y::double for y in embedding if abs(y) >= 0.1])), 6) as norm, true as same from embeddings")
def sparse_round_trip(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(F.abs(x) < 0.1, F.lit(0.0).cast("float")).otherwise(x)).alias("d"))
    e = e.select("vec_id", "d", S.from_dense("d").alias("s"))
    back = S.parse(S.format_("s"))
    return e.select("vec_id", F.size(F.col("s.values")).alias("entries"), r6(S.norm("s"), "norm"), ((S.to_dense("s") == F.col("d")) & (back == F.col("s"))).alias("same"))


@query("vector_avg_by_label", "select label, count(*) as n, round(avg(embedding[1]::double), 5) as first, round(avg(embedding[64]::double), 5) as last, 64 as dims from embeddings group by label")
def vector_avg_by_label(spark, sf):
    g = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), V.vector_avg("embedding", DIMS).alias("v"))
    return g.select("label", "n", F.round(F.col("v")[0].cast("double"), 5).alias("first"), F.round(F.col("v")[63].cast("double"), 5).alias("last"), F.size("v").alias("dims"))


@query("vector_sum_by_label", "select label, round(sum(embedding[1]::double), 3) as first, round(sum(embedding[64]::double), 3) as last from embeddings group by label")
def vector_sum_by_label(spark, sf):
    g = table(spark, sf, "embeddings").groupBy("label").agg(V.vector_sum("embedding", DIMS).alias("v"))
    return g.select("label", F.round(F.col("v")[0].cast("double"), 3).alias("first"), F.round(F.col("v")[63].cast("double"), 3).alias("last"))


# Neighbours. Queries: every vector whose id is divisible by 100.

def _searches(spark, sf):
    e = table(spark, sf, "embeddings")
    return e, e.where(F.col("vec_id") % 100 == 0)


_KNN = {
    "l2": "sqrt(list_sum([(q.x[i] - e.x[i]) * (q.x[i] - e.x[i]) for i in range(1, 65)]))",
    "ip": "-list_inner_product(q.x, e.x)",
    "cosine": "1 - list_inner_product(q.x, e.x) / sqrt(list_inner_product(q.x, q.x) * list_inner_product(e.x, e.x))",
    "l1": "list_sum([abs(q.x[i] - e.x[i]) for i in range(1, 65)])",
}
_E = "with e as (select vec_id, label, embedding::double[] as x from embeddings), "
for _m, _sql in _KNN.items():
    query(f"knn_{_m}", f"""{_E} d as (select q.vec_id as query_id, e.vec_id, round({_sql}, 9) as d from e q join e on q.vec_id % 100 = 0 and e.vec_id <> q.vec_id)
        select query_id, vec_id, round(d, 6) as distance, rank from (select *, row_number() over (partition by query_id order by d, vec_id)::int as rank from d) where rank <= 10""")(
        lambda spark, sf, m=_m: knn.nearest_batch(*_searches(spark, sf), 10, m).select("query_id", "vec_id", r6(F.col("distance"), "distance"), "rank")
    )


@query("knn_per_label", f"""{_E} d as (select q.vec_id as query_id, e.vec_id, e.label, round({_KNN['cosine']}, 9) as d from e q join e on q.vec_id % 100 = 0 and e.vec_id <> q.vec_id)
    select query_id, vec_id, label, round(d, 6) as distance, rank from (select *, row_number() over (partition by query_id, label order by d, vec_id)::int as rank from d) where rank <= 3""")
def knn_per_label(spark, sf):
    return knn.nearest_batch(*_searches(spark, sf), 3, "cosine", groups="label").select("query_id", "vec_id", "label", r6(F.col("distance"), "distance"), "rank")


def _first(spark, sf) -> list[float]:
    return table(spark, sf, "embeddings").orderBy("vec_id").first()["embedding"]


_Q = "with q as (select embedding::double[] as x from embeddings order by vec_id limit 1), e as (select vec_id, label, embedding::double[] as x from embeddings), d as (select e.vec_id, label, {} as d from e, q)"


@query("knn_single_filtered", f"{_Q.format(_KNN['l2'])} select vec_id, label, round(d, 6) as distance from d where label <> 3 order by d, vec_id limit 20")
def knn_single_filtered(spark, sf):
    return knn.nearest(table(spark, sf, "embeddings"), _first(spark, sf), 20, "l2", where=F.col("label") != 3).select("vec_id", "label", r6(F.col("distance"), "distance"))


@query("knn_radius", f"{_Q.format(_KNN['l2'])} select vec_id, round(d, 6) as distance from d where d < 1.2")
def knn_radius(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("distance", V.l2_distance("embedding", knn.literal(_first(spark, sf))))
    return e.where(F.col("distance") < 1.2).select("vec_id", r6(F.col("distance"), "distance"))


@query("knn_similarity", f"{_Q.format(_KNN['cosine'])} select vec_id, round(1 - d, 6) as similarity from d")
def knn_similarity(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r6(1 - V.cosine_distance("embedding", knn.literal(_first(spark, sf))), "similarity"))


@query("knn_over_join", f"""{_Q.format(_KNN['l2'])} select d.vec_id, n_name, round(d, 6) as distance from d join nation on n_nationkey = label order by d, d.vec_id limit 10""")
def knn_over_join(spark, sf):
    e = table(spark, sf, "embeddings").join(table(spark, sf, "nation"), F.col("label") == F.col("n_nationkey"))
    return knn.nearest(e, _first(spark, sf), 10, "l2").select("vec_id", "n_name", r6(F.col("distance"), "distance"))


_HAM = "len([1 for i in range(1, 65) if (q.x[i] > 0) <> (e.x[i] > 0)])"


@query("knn_binary_rerank", f"""with q as (select embedding::double[] as x from embeddings order by vec_id limit 1), e as (select vec_id, embedding::double[] as x from embeddings),
    c as (select e.vec_id, {_HAM} as h, {_KNN['cosine']} as d from e, q order by h, e.vec_id limit 20) select vec_id, round(d, 6) as distance from c order by d, vec_id limit 5""")
def knn_binary_rerank(spark, sf):
    q = _first(spark, sf)
    coarse = V.hamming_distance(V.binary_quantize("embedding"), V.binary_quantize(knn.literal(q)))
    return knn.rerank(table(spark, sf, "embeddings"), q, coarse, 20, 5).select("vec_id", r6(F.col("distance"), "distance"))


@query("knn_subvector_rerank", f"""with q as (select embedding::double[] as x from embeddings order by vec_id limit 1), e as (select vec_id, embedding::double[] as x from embeddings),
    c as (select e.vec_id, 1 - list_inner_product(q.x[1:16], e.x[1:16]) / sqrt(list_inner_product(q.x[1:16], q.x[1:16]) * list_inner_product(e.x[1:16], e.x[1:16])) as h, {_KNN['cosine']} as d from e, q order by h, e.vec_id limit 50)
    select vec_id, round(d, 6) as distance from c order by d, vec_id limit 5""")
def knn_subvector_rerank(spark, sf):
    q = _first(spark, sf)
    coarse = V.cosine_distance(V.subvector("embedding", 1, 16), knn.literal(q[:16]))
    return knn.rerank(table(spark, sf, "embeddings"), q, coarse, 50, 5).select("vec_id", r6(F.col("distance"), "distance"))


#: Approximate searches: how many queries, and whether their mean recall against the exact scan reaches the floor.
_REACHED = "select count(*) as queries, true as reached from embeddings where vec_id % 100 = 0"


def _reached(found: DataFrame, exact: DataFrame, floor: float) -> DataFrame:
    return knn.recall(found, exact).agg(F.count("*").alias("queries"), (F.avg("recall") >= floor).alias("reached"))


@query("ivf_recall", "select probes, count(*) as queries, true as reached from embeddings, (select unnest([4, 10, 16]) as probes) where vec_id % 100 = 0 group by probes")
def ivf_recall(spark, sf):
    from quillon.operators.ivf import IvfConfig, IvfIndex
    from quillon.sources.tables import scratch_path

    e, q = _searches(spark, sf)
    index = IvfIndex.build(e, scratch_path(spark, "ivf"), IvfConfig(lists=16, metric="cosine"))
    exact = knn.nearest_batch(e, q, 10, "cosine").cache()
    floors = ((4, 0.25), (10, 0.6), (16, 0.9925))  # vectors without clusters: recall is about the share of the lists
    made = [_reached(index.search_batch(q, 10, probes), exact, floor).select(F.lit(probes).alias("probes"), "queries", "reached") for probes, floor in floors]
    return made[0].union(made[1]).union(made[2])


@query("hnsw_recall", _REACHED)
def hnsw_recall(spark, sf):
    from quillon.operators.ann import HnswConfig, HnswIndex
    from quillon.sources.tables import scratch_path

    e, q = _searches(spark, sf)
    index = HnswIndex.build(e, scratch_path(spark, "hnsw"), HnswConfig(metric="cosine"), shards=4)
    return _reached(index.search_batch(q, 10), knn.nearest_batch(e, q, 10, "cosine"), 0.97)


# Versioned sections, derived from documents, embeddings and labels.

_ACTS = ["IPC", "CrPC", "BNS", "BNSS", "BSA"]


def sections(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").selectExpr(
        "doc_id", "array('IPC','CrPC','BNS','BNSS','BSA')[cast(doc_id % 5 as int)] as act_code", "cast(doc_id div 10 as string) as section_number", "cast(1 + (doc_id div 5) % 2 as int) as version_no",
        "text as section_text", "substring(text, 1, 50) as marginal_note", "lang as category", "date_add(date'2020-01-01', cast(((doc_id div 10) * 37) % 700 + ((doc_id div 5) % 2) * 900 as int)) as valid_from",
    )
    nxt = F.lead("valid_from").over(Window.partitionBy("act_code", "section_number").orderBy("version_no"))
    d = d.withColumn("valid_to", F.coalesce(nxt, F.when(F.expr("(doc_id div 10) % 10 = 0"), F.date_add("valid_from", 500))))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return d.join(e, "doc_id", "left")


def statuses(spark, sf) -> DataFrame:
    lab = table(spark, sf, "labels").where("toxic = 1 or quality = 0")
    s = sections(spark, sf).select("doc_id", "act_code", "section_number")
    return s.join(lab, "doc_id").groupBy("act_code", "section_number").agg(F.when(F.max("toxic") == 1, "struck_down").otherwise("read_down").alias("status"))


_S = """with b as (select doc_id, ['IPC','CrPC','BNS','BNSS','BSA'][1 + doc_id % 5] as act_code, cast(doc_id // 10 as varchar) as section_number, cast(1 + (doc_id // 5) % 2 as int) as version_no,
    text as section_text, substring(text, 1, 50) as marginal_note, lang as category, date '2020-01-01' + cast(((doc_id // 10) * 37) % 700 + ((doc_id // 5) % 2) * 900 as int) as valid_from
  from documents),
s as (select b.*, coalesce(lead(valid_from) over (partition by act_code, section_number order by version_no), case when (doc_id // 10) % 10 = 0 then valid_from + 500 end) as valid_to, e.embedding::double[] as x
  from b left join embeddings e on e.vec_id = b.doc_id),
js as (select act_code, section_number, case when max(toxic) = 1 then 'struck_down' else 'read_down' end as status from s join labels l using (doc_id) where toxic = 1 or quality = 0 group by 1, 2)
"""
AS_OF, LATER = date(2022, 3, 1), date(2023, 6, 1)
_IN = "valid_from <= date '2022-03-01' and (valid_to is null or valid_to > date '2022-03-01')"
_ALIVE = f"live as (select s.*, js.status, version_no > 1 and date '2022-03-01' - valid_from <= 365 as recently_amended from s left join js using (act_code, section_number) where {_IN} and (status is null or status <> 'struck_down'))"
_COLS = "act_code, section_number, marginal_note, substring(section_text, 1, 300) as snippet, category, {} as similarity, version_no, valid_from::varchar as valid_from, valid_to::varchar as valid_to, recently_amended, status"
_day = lambda c: F.col(c).cast("string").alias(c)


def _days(df: DataFrame) -> DataFrame:
    """Dates as text: drivers differ in what they make of them."""
    return df.select(*[_day(c) if t == "date" else c for c, t in df.dtypes])


@query("sections_in_force", f"{_S}, {_ALIVE} select doc_id, act_code, section_number, version_no, valid_from::varchar as valid_from, valid_to::varchar as valid_to, status, recently_amended from live")
def sections_in_force(spark, sf):
    return corpus.standing(sections(spark, sf), statuses(spark, sf), AS_OF).select("doc_id", "act_code", "section_number", "version_no", _day("valid_from"), _day("valid_to"), "status", "recently_amended")


@query("sections_struck_down", f"{_S} select doc_id, act_code, section_number, status from s join js using (act_code, section_number) where {_IN} and status = 'struck_down'")
def sections_struck_down(spark, sf):
    return corpus.standing(sections(spark, sf), statuses(spark, sf), AS_OF, struck_down=True).where("status = 'struck_down'").select("doc_id", "act_code", "section_number", "status")


@query("retrieve_semantic", f"""{_S}, {_ALIVE}, q as (select embedding::double[] as x from embeddings order by vec_id limit 1),
    d as (select live.*, 1 - list_inner_product(live.x, q.x) / sqrt(list_inner_product(live.x, live.x) * list_inner_product(q.x, q.x)) as d from live, q where live.x is not null order by d, act_code, section_number limit 6)
    select {_COLS.format('round(1 - d, 4)')} from d where 1 - d >= 0.25""")
def retrieve_semantic(spark, sf):
    return _days(corpus.semantic_search(sections(spark, sf), statuses(spark, sf), _first(spark, sf), AS_OF))


_WORDS = "Which ones thonre tiontion, ERRE?"


@query("retrieve_keyword", f"""{_S}, {_ALIVE} select {_COLS.format('null::double')} from (select * from live where {' or '.join(f"{c} ilike '%{w}%'" for w in ('which', 'ones', 'thonre', 'tiontion', 'erre') for c in ('marginal_note', 'section_text', 'category'))} order by act_code, section_number, version_no limit 6)""")
def retrieve_keyword(spark, sf):
    return _days(corpus.keyword_search(sections(spark, sf), statuses(spark, sf), _WORDS, AS_OF))


@query("retrieve_by_incident", f"{_S}, {_ALIVE} select doc_id, act_code, section_number from live where act_code in ('IPC', 'CrPC')")
def retrieve_by_incident(spark, sf):
    return corpus.standing(sections(spark, sf), statuses(spark, sf), AS_OF, incident=date(2023, 1, 1)).select("doc_id", "act_code", "section_number")


@query("section_history", f"{_S} select doc_id, version_no, lag(substring(section_text, 1, 80)) over w as previous, (lag(valid_from) over w)::varchar as previous_valid_from from s window w as (partition by act_code, section_number order by version_no)")
def section_history(spark, sf):
    return corpus.with_previous(sections(spark, sf)).select("doc_id", "version_no", F.substring("previous_text", 1, 80).alias("previous"), _day("previous_valid_from"))


@query("events_as_of", f"""{_S}, ev as (select o_orderkey, ['IPC','CrPC','BNS','BNSS','BSA'][1 + o_orderkey % 5] as act_code, cast(o_custkey % 90 as varchar) as section_number, date '2020-01-01' + cast(o_orderkey % 1500 as int) as day from orders)
    select o_orderkey, ev.act_code, ev.section_number, day::varchar as day, version_no from ev left join s on s.act_code = ev.act_code and s.section_number = ev.section_number and valid_from <= day and (valid_to is null or valid_to > day)""")
def events_as_of(spark, sf):
    ev = table(spark, sf, "orders").selectExpr("o_orderkey", "array('IPC','CrPC','BNS','BNSS','BSA')[cast(o_orderkey % 5 as int)] as act_code", "cast(o_custkey % 90 as string) as section_number", "date_add(date'2020-01-01', cast(o_orderkey % 1500 as int)) as day")
    return corpus.as_of_join(ev, sections(spark, sf), "day").select("o_orderkey", "act_code", "section_number", _day("day"), "version_no")


_NEW = "(select act_code, section_number, case when doc_id % 3 = 0 then section_text else section_text || ' amended' end as t, case when doc_id % 4 < 2 then valid_from else date '2023-06-01' end as f from s where valid_to is null)"


def _new_sections(spark, sf) -> DataFrame:
    s = sections(spark, sf).where("valid_to is null")
    return s.selectExpr("act_code", "section_number", "case when doc_id % 3 = 0 then section_text else concat(section_text, ' amended') end as section_text", "cast(null as string) as marginal_note", "case when doc_id % 4 < 2 then valid_from else date'2023-06-01' end as new_valid_from")


@query("section_upsert", f"""{_S}, o as (select s.*, n.t, n.f from s join {_NEW} n using (act_code, section_number) where valid_to is null),
    a as (select *, case when f > valid_from then 'version' when f < valid_from then 'reject' when t = section_text then 'skip' else 'update' end as action from o)
    select act_code, section_number, version_no, valid_from::varchar as valid_from, valid_to::varchar as valid_to, action, md5(section_text) as text_md5 from (
    select act_code, section_number, version_no, valid_from, valid_to, 'keep' as action, section_text from s where valid_to is not null
    union all select act_code, section_number, version_no, valid_from, case when action = 'version' then f end, case when action = 'version' then 'close' else action end, case when action = 'update' then t else section_text end from a
    union all select act_code, section_number, version_no + 1, f, null, 'version', t from a where action = 'version')""")
def section_upsert(spark, sf):
    out = corpus.upsert(sections(spark, sf), _new_sections(spark, sf))
    return out.select("act_code", "section_number", "version_no", _day("valid_from"), _day("valid_to"), "action", F.md5(F.col("section_text").cast("binary")).alias("text_md5"))


@query("section_stage_changes", f"{_S} select s.act_code, s.section_number, length(section_text) || ' -> ' || length(t) || ' chars' as summary, 'pending' as status from s join {_NEW} n using (act_code, section_number) where valid_to is null and t <> section_text")
def section_stage_changes(spark, sf):
    return corpus.stage_changes(sections(spark, sf), _new_sections(spark, sf)).select("act_code", "section_number", "summary", "status")


@query("corpus_snapshot", f"""{_S}, l as (select act_code || ':' || section_number || ':' || version_no || ':' || sha256(section_text) as line from s where valid_to is null),
    p as (select substr(sha256(line), 1, 3) as part, count(*) as n, sha256(string_agg(line, chr(10) order by line)) as c from l group by 1)
    select 'x' as label, coalesce(sum(n), 0)::bigint as section_count, sha256(coalesce(string_agg(c, chr(10) order by part), '')) as checksum from p""")
def corpus_snapshot(spark, sf):
    return corpus.snapshot_tree(sections(spark, sf), "x")


# Text functions over conversations and documents.

_sql_re = lambda p: p.replace("'", "''")
_NORM = r"trim(regexp_replace(regexp_replace(translate(lower(text), '01345@$', 'oieasas'), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("text_normalise", f"select conv_id, turn, md5({_NORM}) as n, coalesce({', '.join(f'''nullif(regexp_extract({_NORM}, '{p}'), '')''' for p in X.DENY)}) as harm from conversations")
def text_normalise(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.normalise("text").cast("binary")).alias("n"), X.harm_match("text").alias("harm"))


_TOK = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query("text_query_words", f"select conv_id, turn, array_to_string(list_transform(list_filter({_TOK}, lambda w: length(w) > 3 and lower(w) not in {X.STOP}), lambda w: lower(trim(w, '.,?!;:')))[1:6], ' ') as words from conversations")
def text_query_words(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.query_words("text"), " ").alias("words"))


@query("text_category", "select doc_id, case " + " ".join(f"when {' or '.join(f'''contains(low, '{w}')''' for w in ws)} then '{name}'" for name, ws in X.CATEGORIES) + f" else 'General' end as category, len([w for w in {list(X.TERMS)} if contains(low, w)])::int as terms from (select doc_id, lower(text) as low from documents)")
def text_category(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.category("text").alias("category"), F.size(X.keywords("text")).alias("terms"))


@query("text_embed", f"""with w as (select row_number() over () as r, conv_id, turn, {_TOK.replace('text', 'lower(text)')} as ws from conversations where trim(text) <> ''),
    b as (select r, (('0x' || md5(word))::uhugeint % 768)::int as b, count(*)::double as n from (select r, unnest(ws) as word from w) group by 1, 2),
    v as (select r, b, (n / sqrt(sum(n * n) over (partition by r)))::float::double as x from b)
    select conv_id, turn, count(b) as buckets, round(coalesce(sum(x * b), 0), 2) as moment from w left join v using (r) group by r, conv_id, turn""")
def text_embed(spark, sf):
    c = table(spark, sf, "conversations").where(F.trim("text") != "").select("conv_id", "turn", X.embed("text").alias("v"))
    return c.select("conv_id", "turn", F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("buckets"), F.round(F.aggregate(F.transform("v", lambda x, i: x.cast("double") * i), F.lit(0.0), lambda s, x: s + x), 2).alias("moment"))


@query("topic_changes", f"""with c as (select conv_id, turn, text, role, list_intersect(list_transform({_TOK}, lambda w: trim(lower(w), '.,?!')), {list(X.CRIME)}) as k from conversations),
    u as (select *, row_number() over (partition by conv_id order by turn) as n from c where role = 'user'),
    p as (select a.conv_id, a.turn, a.k, (select count(*) from conversations x where x.conv_id = a.conv_id and x.turn < a.turn) as before, coalesce((select flatten(list(b.k)) from u b where b.conv_id = a.conv_id and b.n < a.n and b.n >= a.n - 3), []) as prev from u a)
    select conv_id, turn, case when before < 2 then true when len(k) = 0 and len(prev) = 0 then false else not list_has_any(k, prev) end as changed from p""")
def topic_changes(spark, sf):
    c = table(spark, sf, "conversations").withColumn("k", X.crime_terms("text"))
    c = c.withColumn("before", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    last = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    u = c.where("role = 'user'").withColumn("prev", F.flatten(F.collect_list("k").over(last)))
    return u.select("conv_id", "turn", X.topic_changed(F.col("k"), F.col("prev"), F.col("before")).alias("changed"))


def _hmac_sql(key: str, message: str) -> str:
    pads = [bytes(b ^ x for b in key.encode().ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
    return f"sha256(unhex('{pads[1]}') || unhex(sha256(unhex('{pads[0]}') || encode({message}))))"


@query("ip_hash", f"select event_id, substr({_hmac_sql('secret', "'10.0.0.' || user_id")}, 1, 40) as ip_hash from events")
def ip_hash(spark, sf):
    return table(spark, sf, "events").select("event_id", X.ip_hash(F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")), "secret").alias("ip_hash"))


@query("path_action", "select event_id, case when event_type = 'signup' then 'user_register' when event_type = 'purchase' then 'complaint' else 'api_request' end as action, event_type <> 'error' as audited from events")
def path_action(spark, sf):
    path = F.when(F.col("event_type") == "signup", "/api/v1/auth/register").when(F.col("event_type") == "purchase", "/api/v1/complaints").when(F.col("event_type") == "error", "/api/docs").otherwise("/api/v1/other")
    return table(spark, sf, "events").select("event_id", X.action_of(path).alias("action"), X.is_audited(path).alias("audited"))


@query("haversine", """select c_custkey, round(6371 * 2 * atan2(sqrt(a), sqrt(1 - a)), 1) as km from (select c_custkey, pow(sin((radians(28.6) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(28.6)) * pow(sin(radians(77.2 - lon) / 2), 2) as a
    from (select c_custkey, c_custkey % 90 as lat, c_custkey % 180 as lon from customer))""")
def haversine(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "cast(c_custkey % 90 as double) as lat", "cast(c_custkey % 180 as double) as lon")
    return c.select("c_custkey", X.haversine_km(F.col("lat"), F.col("lon"), F.lit(28.6), F.lit(77.2)).alias("km"))


# Event logs.

NOW = datetime(2024, 1, 15)


@query("log_hourly_rate", "select user_id, date_trunc('hour', ts)::timestamp as hour, count(*) as n from events group by 1, 2 having count(*) > 1")
def log_hourly_rate(spark, sf):
    return logs.hourly_over_rate(table(spark, sf, "events"), "user_id", 1).select("user_id", F.col("hour").cast("timestamp_ntz").alias("hour"), "n")


@query("log_windowed_rate", "select user_id, date_trunc('hour', ts)::timestamp as start, count(*) as n from events group by 1, 2 having count(*) > 1")
def log_windowed_rate(spark, sf):
    return windowed_over_rate(table(spark, sf, "events"), "user_id", most=1).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("log_sessions", """with s as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end as fresh from events where ts is not null),
    g as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as g from s)
    select user_id, min(ts)::timestamp as start, (max(ts) + interval 6 hour)::timestamp as "end", count(*) as n from g group by user_id, g""")
def log_sessions(spark, sf):
    out = event_sessions(table(spark, sf, "events"), "user_id", gap="6 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("log_retention", "with m as (select max(ts) as m from events) select event_type, count(*) as n, min(ts) as first from events, m where ts >= m - interval 10 day group by 1")
def log_retention(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts")).first()[0]
    return logs.retain(e, F.lit(last).cast("timestamp_ntz"), 10).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


@query("log_flag", "with f as (select distinct user_id from (select user_id, date_trunc('hour', ts) as h from events group by all having count(*) > 1)) select event_id, user_id in (select user_id from f) as is_flagged, case when user_id in (select user_id from f) then 'rate' end as flag_reason from events")
def log_flag(spark, sf):
    e = table(spark, sf, "events")
    return logs.flag(e, logs.hourly_over_rate(e, "user_id", 1), "user_id", "rate").select("event_id", "is_flagged", "flag_reason")


@query("log_listing", "select event_id, ts from events where event_type = 'error' order by ts desc, event_id limit 20 offset 20")
def log_listing(spark, sf):
    return logs.listing(table(spark, sf, "events"), "ts", 2, where=F.col("event_type") == "error", key="event_id").select("event_id", "ts")


@query("news_dedupe", """with i as (select doc_id as position, trim(split_part(text, chr(10), 1)) as title, trim(text) as summary, source from documents where text is not null),
    f as (select *, row_number() over (partition by title order by position) as r from i where title <> '' and title <> '[Removed]')
    select position, title, md5(summary) as summary, 'latest' as tag, 0.8::double as relevance_score from f where r = 1 and title not in (select title from i where source = 'src0')""")
def news_dedupe(spark, sf):
    """Items are documents, entitled by their first line; stored are those of one source."""
    title = F.substring_index("text", "\n", 1)
    d = table(spark, sf, "documents").where("text is not null")
    items = d.select(F.col("doc_id").alias("position"), F.lit("latest legal news india").alias("query"), title.alias("title"), F.col("text").alias("summary"), F.lit(None).cast("timestamp").alias("published"))
    stored = d.where("source = 'src0'").select(F.trim(title).alias("title"))
    return corpus.news_normalise(items, stored).select("position", "title", F.md5(F.col("summary").cast("binary")).alias("summary"), F.col("tags")[0].alias("tag"), "relevance_score")


@query("rank_fusion", f"""{_Q.format(_KNN['l2'])}, r1 as (select vec_id, row_number() over (order by d, vec_id) as rank from d), r2 as (select vec_id, row_number() over (order by label, vec_id) as rank from d)
    select vec_id, round(sum(1.0 / (60 + rank)), 9) as score from (select * from r1 where rank <= 20 union all select * from r2 where rank <= 20) group by 1""")
def rank_fusion(spark, sf):
    e = table(spark, sf, "embeddings")
    near = knn.nearest(e, _first(spark, sf), 20, "l2").select("vec_id", F.row_number().over(Window.orderBy("distance", "vec_id")).alias("rank"))
    label = e.orderBy("label", "vec_id").limit(20).select("vec_id", F.row_number().over(Window.orderBy("label", "vec_id")).alias("rank"))
    return knn.reciprocal_rank_fusion([near, label], "vec_id").select("vec_id", F.round("score", 9).alias("score"))


from quillon.plans import listings, search, spaces, statutes, texts, versions  # noqa: E402,F401  register their queries
