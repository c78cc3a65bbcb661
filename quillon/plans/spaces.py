"""Queries over half, sparse and bit vectors: arithmetic, order, casts, aggregates and approximate indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import sparse as S
from quillon.functions import vectors as V
from quillon.operators import knn
from quillon.operators.ann import HnswConfig, HnswIndex, prepared
from quillon.operators.ivf import IvfConfig, IvfIndex
from quillon.plans.catalog import _REACHED, DIMS, _first, _pairs, query, r6
from quillon.sources.tables import scratch_path, table

#: A number as the nearest half-precision one, in SQL.
_half = lambda y: f"(case when {y} = 0 then 0 else round_even({y} / pow(2, greatest(floor(log2(abs({y}))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs({y}))), -14) - 10) end)"
_HALF = f"""with e as (select vec_id, label, [{_half('y')} for y in embedding::double[]] as x from embeddings),
p as (select e.vec_id, e.label, e.x as a, n.x as b from e join e n on n.vec_id = e.vec_id + 1)
"""
_moment = lambda v: F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)


def _halves(spark, sf) -> DataFrame:
    return _pairs(spark, sf).select("vec_id", "label", V.to_half("a").alias("a"), V.to_half("b").alias("b"))


for _name, _f, _op in (("add", V.add, "+"), ("subtract", V.subtract, "-"), ("multiply", V.multiply, "*")):
    query(f"half_{_name}", f"{_HALF} select vec_id, round(list_sum([{_half(f'(a[i] {_op} b[i])')} * i for i in range(1, 65)]), 4) as v from p")(
        lambda spark, sf, f=_f: _halves(spark, sf).select("vec_id", F.round(_moment(V.to_half(f("a", "b"))), 4).alias("v"))
    )

for _name, _f, _sql in (
    ("inner_product", V.inner_product, "list_inner_product(a, b)"),
    ("cosine_distance", V.cosine_distance, "1 - greatest(-1, least(1, list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b))))"),
    ("l1_distance", V.l1_distance, "list_sum([abs(a[i] - b[i]) for i in range(1, 65)])"),
    ("l2_squared_distance", V.l2_squared_distance, "list_sum([(a[i] - b[i]) * (a[i] - b[i]) for i in range(1, 65)])"),
):
    query(f"half_{_name}", f"{_HALF} select vec_id, round({_sql}, 6) as v from p")(lambda spark, sf, f=_f: _halves(spark, sf).select("vec_id", r6(f("a", "b"), "v")))


@query("half_norm_dims", f"{_HALF} select vec_id, len(x) as dims, round(sqrt(list_inner_product(x, x)), 6) as norm from e")
def half_norm_dims(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.to_half("embedding").alias("h"))
    return e.select("vec_id", V.dims("h").alias("dims"), r6(V.norm("h"), "norm"))


@query("half_normalize", f"{_HALF}, u as (select vec_id, [{_half('(y / n)::float')} for y in x] as x from (select vec_id, x, sqrt(list_inner_product(x, x)) as n from e)) select vec_id, round(list_sum([x[i] * i for i in range(1, 65)]), 2) as v from u")
def half_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.to_half(V.l2_normalize(V.to_half("embedding"))).alias("u"))
    return e.select("vec_id", F.round(_moment("u"), 2).alias("v"))


@query("half_compare", f"{_HALF} select vec_id, case when a < b then -1 when a > b then 1 else 0 end as cmp, a = b as eq from p")
def half_compare(spark, sf):
    return _halves(spark, sf).select("vec_id", V.compare("a", "b").alias("cmp"), (F.col("a") == F.col("b")).alias("eq"))


@query("half_concat_subvector", f"{_HALF} select vec_id, len(a || b)::int as n, round(list_sum((a || b)[60:69]), 6) as v from p")
def half_concat_subvector(spark, sf):
    p = _halves(spark, sf).select("vec_id", V.concat("a", "b").alias("ab"))
    return p.select("vec_id", F.size("ab").alias("n"), r6(F.aggregate(V.subvector("ab", 60, 10), F.lit(0.0), lambda s, x: s + x.cast("double")), "v"))


@query("half_avg_by_label", f"{_HALF}, u as (select label, i, avg(x[i]) as m from e, range(1, 65) t(i) group by all) select label, round(sum({_half('m')} * i), 3) as v from u group by 1")
def half_avg_by_label(spark, sf):
    e = table(spark, sf, "embeddings").select("label", V.to_half("embedding").alias("h"))
    return e.groupBy("label").agg(V.vector_avg("h", DIMS).alias("v")).select("label", F.round(_moment(V.to_half("v")), 3).alias("v"))


@query("vector_casts_from_numbers", "select o_orderkey, (o_custkey + 2 * (o_orderkey % 7))::double as whole, (o_custkey::float + 0.5::float)::double as real_, round(round(o_totalprice, 2)::float::double, 2) as exact from orders")
def vector_casts_from_numbers(spark, sf):
    """int[], real[] and numeric[] to vectors and back."""
    o = table(spark, sf, "orders")
    whole = V.from_array(F.array(F.col("o_custkey").cast("int"), (F.col("o_orderkey") % 7).cast("int")), 2)
    real_ = V.from_array(F.array(F.col("o_custkey").cast("float"), F.lit(0.5).cast("float")), 2)
    exact = V.from_array(F.array(F.round("o_totalprice", 2).cast("decimal(15,2)")), 1)
    o = o.select("o_orderkey", whole.alias("w"), real_.alias("r"), exact.alias("e"))
    at = lambda c, i: V.to_array(c)[i].cast("double")
    return o.select("o_orderkey", (at("w", 0) + 2 * at("w", 1)).alias("whole"), (at("r", 0) + at("r", 1)).alias("real_"), F.round(at("e", 0), 2).alias("exact"))


# Sparse.

_cut = lambda c: S.from_dense(F.transform(c, lambda x: F.when(F.abs(x) < 0.1, F.lit(0.0).cast("float")).otherwise(x)))
_SPARSE = """with e as (select vec_id, [case when abs(y) < 0.1 then 0 else y end for y in embedding::double[]] as x from embeddings), p as (select e.vec_id, e.x as a, n.x as b from e join e n on n.vec_id = e.vec_id + 1)
"""


@query("sparse_normalize", f"{_SPARSE} select vec_id, len(list_filter(x, lambda y: y <> 0))::int as entries, round(coalesce(list_sum([x[i] * i for i in range(1, 65)]) / sqrt(list_inner_product(x, x)), 0), 3) as v from e")
def sparse_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", S.l2_normalize(_cut(F.col("embedding"))).alias("s"))
    return e.select("vec_id", F.size("s.values").alias("entries"), F.round(_moment(S.to_dense("s")), 3).alias("v"))


@query("sparse_compare", f"{_SPARSE} select vec_id, case when a < b then -1 when a > b then 1 else 0 end as cmp, 1 as longer, -1 as shorter, 0 as same from p")
def sparse_compare(spark, sf):
    """Also against the same entries in one dimension fewer or more."""
    p = _pairs(spark, sf).select("vec_id", _cut(F.col("a")).alias("a"), _cut(F.col("b")).alias("b"))
    wide = F.struct((F.col("a.dim") + 1).alias("dim"), F.col("a.indices").alias("indices"), F.col("a.values").alias("values"))
    return p.select("vec_id", S.compare("a", "b").alias("cmp"), S.compare(wide, "a").alias("longer"), S.compare("a", wide).alias("shorter"), S.compare("a", "a").alias("same"))


@query("sparse_half_casts", f"""with e as (select vec_id, [case when abs(y) < 0.1 then 0 else {_half('y')} end for y in embedding::double[]] as x from embeddings)
    select vec_id, len(list_filter(x, lambda y: y <> 0))::int as entries, round(list_sum([x[i] * i for i in range(1, 65)]), 4) as v from e""")
def sparse_half_casts(spark, sf):
    """Half to sparse and back."""
    half = V.to_half(F.transform("embedding", lambda x: F.when(F.abs(x) < 0.1, F.lit(0.0).cast("float")).otherwise(x)))
    e = table(spark, sf, "embeddings").select("vec_id", S.from_dense(half).alias("s"))
    return e.select("vec_id", F.size("s.values").alias("entries"), F.round(_moment(V.to_half(S.to_dense("s"))), 4).alias("v"))


# Searches and indexes.

@query("knn_half_rerank", f"""with h as (select vec_id, embedding::double[] as x, [{_half('y')} for y in embedding::double[]] as hx from embeddings), q as (select * from h order by vec_id limit 1),
    c as (select h.vec_id, sqrt(list_sum([(h.hx[i] - q.hx[i]) * (h.hx[i] - q.hx[i]) for i in range(1, 65)])) as coarse, 1 - list_inner_product(h.x, q.x) / sqrt(list_inner_product(h.x, h.x) * list_inner_product(q.x, q.x)) as d from h, q order by coarse, h.vec_id limit 30)
    select vec_id, round(d, 6) as distance from c order by d, vec_id limit 5""")
def knn_half_rerank(spark, sf):
    """Half precision for a wide first choice, full precision for the last."""
    q = _first(spark, sf)
    coarse = V.l2_distance(V.to_half("embedding"), V.to_half(knn.literal(q).cast("array<float>")))
    return knn.rerank(table(spark, sf, "embeddings"), q, coarse, 30, 5).select("vec_id", r6(F.col("distance"), "distance"))


_Z = "with e as (select vec_id, case when vec_id % 5 = 0 and vec_id % 100 <> 0 then [0::double for y in embedding] else embedding::double[] end as x from embeddings), q as (select * from e where vec_id % 100 = 0)"


@query("knn_cosine_zero_vectors", f"""{_Z}, d as (select q.vec_id as query_id, e.vec_id, round(1 - list_inner_product(q.x, e.x) / nullif(sqrt(list_inner_product(q.x, q.x) * list_inner_product(e.x, e.x)), 0), 9) as d from e, q where e.vec_id <> q.vec_id),
    r as (select *, row_number() over (partition by query_id order by d nulls last, vec_id)::int as rank from d) select query_id, vec_id, round(coalesce(d, -1), 6) as distance, rank from r where rank <= 450""")
def knn_cosine_zero_vectors(spark, sf):
    """450 neighbours where every fifth vector is zero: those come last, without a distance."""
    e = table(spark, sf, "embeddings")
    e = e.withColumn("embedding", F.when((F.col("vec_id") % 5 == 0) & (F.col("vec_id") % 100 != 0), F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")))
    out = knn.nearest_batch(e, e.where("vec_id % 100 = 0"), 450, "cosine")
    return out.select("query_id", "vec_id", F.round(F.when(F.isnan("distance"), -1.0).otherwise(F.col("distance")), 6).alias("distance"), "rank")


def _as(kind: str, e: DataFrame) -> DataFrame:
    made = {"half": V.to_half("embedding"), "bit": V.binary_quantize("embedding"), "sparse": _cut(F.col("embedding"))}[kind]
    return e.withColumn("embedding", made)


def _recall(spark, sf, kind: str, metric: str, floor: float, index) -> DataFrame:
    e = _as(kind, table(spark, sf, "embeddings"))
    q = e.where("vec_id % 100 = 0")
    plain = prepared(e, "embedding", kind)
    exact = knn.nearest_batch(plain, plain.where("vec_id % 100 = 0"), 20, metric)
    return knn.tied_recall(index(spark, e).search_batch(q, 20), exact).agg(F.count("*").alias("queries"), (F.avg("recall") >= floor).alias("reached"))


for _kind, _metric, _floor in (("half", "l2", 0.98), ("bit", "hamming", 0.98), ("bit", "jaccard", 0.95), ("sparse", "l2", 0.99), ("sparse", "ip", 0.97)):
    query(f"hnsw_{_kind}_{_metric}_recall", _REACHED)(lambda spark, sf, k=_kind, m=_metric, f=_floor: _recall(spark, sf, k, m, f, lambda s, e: HnswIndex.build(e, scratch_path(s, "hnsw"), HnswConfig(metric=m, kind=k), shards=4)))
for _kind, _metric, _floor in (("half", "cosine", 0.9925), ("bit", "hamming", 1.0)):
    query(f"ivf_{_kind}_{_metric}_recall", _REACHED)(lambda spark, sf, k=_kind, m=_metric, f=_floor: _recall(spark, sf, k, m, f, lambda s, e: IvfIndex.build(e, scratch_path(s, "ivf"), IvfConfig(lists=8, probes=8, metric=m, kind=k))))
