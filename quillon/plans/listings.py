"""Queries over the application's listings, checks and turn lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import listings as L
from quillon.plans.catalog import _S, _TOK, _day, query, sections
from quillon.plans.statutes import _BASE, judged
from quillon.sources.tables import table


@query("list_act_like", f"{_S} select doc_id, act_code from s where act_code ilike 'b_s%'")
def list_act_like(spark, sf):
    return L.act_like(sections(spark, sf), "b_s%").select("doc_id", "act_code")


@query("list_browse", f"""{_S} select act_code, section_number, version_no from s where valid_to is null and lower(act_code) = 'bnss' and (contains(lower(section_number), 'the') or contains(lower(coalesce(marginal_note, '')), 'the') or contains(lower(coalesce(section_text, '')), 'the') or contains(lower(coalesce(category, '')), 'the'))
    order by act_code, section_number::int, section_number limit 20 offset 20""")
def list_browse(spark, sf):
    return L.browse(sections(spark, sf), "bnss", "the", 2).select("act_code", "section_number", "version_no")


_FEED = "with n as (select doc_id as id, doc_id % 11 = 0 as featured, lang as language, split_part(text, chr(10), 1) as title, text as summary, date '2024-01-01' + cast(doc_id % 300 as int) as published from documents)"


def _items(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 11 == 0).alias("featured"), F.col("lang").alias("language"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("summary"), F.expr("date_add(date'2024-01-01', cast(doc_id % 300 as int))").alias("published"))


@query("list_feed", f"{_FEED} select id, published::varchar as published from n where not featured and language = 'en' and (contains(lower(coalesce(title, '')), 'the') or contains(lower(coalesce(summary, '')), 'the')) order by n.published desc, id limit 20")
def list_feed(spark, sf):
    return L.feed(_items(spark, sf), False, "en", "The").select("id", _day("published"))


@query("list_feed_split", f"{_FEED} select featured, count(*) as n, max(published)::varchar as newest from n where contains(lower(coalesce(title, '')), 'an') or contains(lower(coalesce(summary, '')), 'an') group by 1")
def list_feed_split(spark, sf):
    out = _items(spark, sf).where(L.contains("an", "title", "summary"))
    return out.groupBy("featured").agg(F.count("*").alias("n"), F.max("published").cast("string").alias("newest"))


@query("list_education", "select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0 and contains(lower(c_name), '01') order by c_acctbal desc, c_custkey limit 20")
def list_education(spark, sf):
    """Published items of a type, by a text, best first."""
    c = table(spark, sf, "customer").where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0) & L.contains("01", "c_name"))
    return L.page(c, [F.col("c_acctbal").desc(), "c_custkey"]).select("c_custkey")


@query("list_users", "select c_custkey, c_mktsegment as role from customer where c_mktsegment in ('MACHINERY', 'FURNITURE') and not c_acctbal < 0 and (contains(lower(c_name), '5') or contains(lower(c_mktsegment), 'x'))")
def list_users(spark, sf):
    c = table(spark, sf, "customer")
    return c.where(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE") & ~(F.col("c_acctbal") < 0) & L.contains("5", "c_name")).select("c_custkey", F.col("c_mktsegment").alias("role"))


@query("list_distinct_search", f"{_S} select distinct act_code, section_number from s where contains(lower(coalesce(section_text, '')), 'the') or contains(lower(coalesce(category, '')), 'd')")
def list_distinct_search(spark, sf):
    return sections(spark, sf).where(L.contains("the", "section_text") | L.contains("d", "category")).select("act_code", "section_number").distinct()


@query("citation_check", f"{_S} select o_orderkey, k.n is not null as found from (select o_orderkey, ['ipc', 'Bns', 'XYZ'][1 + o_orderkey % 3] as act, (o_custkey % 200)::varchar as number from orders) o left join (select distinct lower(act_code) as a, section_number as n from s) k on lower(o.act) = k.a and o.number = k.n")
def citation_check(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "array('ipc', 'Bns', 'XYZ')[cast(o_orderkey % 3 as int)] as act", "cast(o_custkey % 200 as string) as number")
    return L.check_citations(o, sections(spark, sf)).select("o_orderkey", "found")


@query("session_history", "select conv_id, turn, row_number() over (partition by conv_id order by turn)::int as place from conversations where role = 'assistant'")
def session_history(spark, sf):
    return L.history(table(spark, sf, "conversations"), "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", "place")


@query("query_responses", "select conv_id, turn, md5(case when r = 'assistant' then t end) as response from (select conv_id, turn, role, lead(role) over w as r, lead(text) over w as t from conversations window w as (partition by conv_id order by turn)) where role = 'user'")
def query_responses(spark, sf):
    return L.with_response(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.md5(F.col("response").cast("binary")).alias("response"))


@query("user_turns", "select conv_id, count(*) filter (role = 'user') as turns from conversations group by 1")
def user_turns(spark, sf):
    return L.user_turns(table(spark, sf, "conversations"), "conv_id")


@query("category_parents", "select c.n_nationkey, p.n_name as parent_name from nation c left join nation p on p.n_nationkey = case when c.n_nationkey % 5 = 0 then null else c.n_nationkey - c.n_nationkey % 5 end")
def category_parents(spark, sf):
    n = table(spark, sf, "nation").selectExpr("n_nationkey", "n_name", "case when n_nationkey % 5 = 0 then null else n_nationkey - n_nationkey % 5 end as parent")
    return L.with_parent(n, "n_nationkey", "parent", "n_name").select("n_nationkey", "parent_name")


@query("highest_number", f"{_S} select act_code, max(section_number::int) as highest from s group by 1")
def highest_number(spark, sf):
    s = sections(spark, sf).withColumn("section_number", F.concat("section_number", F.lit("A")))
    return L.highest_number(s)


@query("reject_reasons", f"{_BASE} select verdict as reason, count(*) as n from ver where verdict not in ('accepted', 'repealed') group by 1")
def reject_reasons(spark, sf):
    return judged(spark, sf).where(~F.col("verdict").isin("accepted", "repealed")).groupBy(F.col("verdict").alias("reason")).agg(F.count("*").alias("n"))


@query("best_confidence", f"{_S}, q as (select embedding::double[] as x from embeddings order by vec_id limit 1) select act_code, round(0.55 + 0.4 * least(max(list_inner_product(s.x, q.x) / sqrt(list_inner_product(s.x, s.x) * list_inner_product(q.x, q.x))), 1), 3) as confidence from s, q where s.x is not null group by 1")
def best_confidence(spark, sf):
    from quillon.functions.vectors import cosine_distance
    from quillon.operators.knn import literal
    from quillon.plans.catalog import _first

    s = sections(spark, sf).where("embedding is not null").withColumn("similarity", 1 - cosine_distance("embedding", literal(_first(spark, sf))))
    return s.groupBy("act_code").agg(F.max("similarity").alias("m")).select("act_code", X.confidence("m").alias("confidence"))


@query("embedding_backfill", f"""{_S}, n as (select doc_id, lower(coalesce(marginal_note, '') || '. ' || substr(section_text, 1, 2000)) as t from s where x is null and section_text is not null),
    w as (select doc_id, unnest({_TOK.replace('text', 't')}) as word from n), bk as (select doc_id, (('0x' || md5(word))::uhugeint % 64)::int as b, count(*)::double as c from w group by 1, 2),
    v as (select doc_id, b, (c / sqrt(sum(c * c) over (partition by doc_id)))::float::double as y from bk)
    select doc_id, count(*) as buckets, round(sum(y * b), 2) as moment from v group by 1""")
def embedding_backfill(spark, sf):
    s = sections(spark, sf)
    made = L.backfill(s.where("embedding is null and section_text is not null"), 64)
    return made.select("doc_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("buckets"), F.round(F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * i), F.lit(0.0), lambda a, x: a + x), 2).alias("moment"))


@query("text_dark_match", "select conv_id, turn, case " + " ".join(f"when contains(lower(text), '{p}') then '{p}'" for p in X.DARK) + " end as phrase from (select conv_id, turn, case when conv_id % 5 = 0 then 'How To Poison a well. ' when conv_id % 5 = 1 then 'contract killing; ' else '' end || text as text from conversations)")
def text_dark_match(spark, sf):
    head = F.when(F.col("conv_id") % 5 == 0, "How To Poison a well. ").when(F.col("conv_id") % 5 == 1, "contract killing; ").otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.dark_match(F.concat(head, F.col("text"))).alias("phrase"))


@query("text_contacts", "select c_custkey, regexp_matches(mail, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') as is_email, regexp_matches(phone, '^[6-9][0-9]{9}$') as is_phone, ceil(c_custkey / 20.0)::bigint as pages from (select c_custkey, case when c_custkey % 3 = 0 then 'a b@c.de' when c_custkey % 3 = 1 then 'u' || c_custkey || '@mail.example' else 'u@mail' end as mail, (c_custkey % 10 * 1000000000 + c_custkey)::varchar as phone from customer)")
def text_contacts(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "case when c_custkey % 3 = 0 then 'a b@c.de' when c_custkey % 3 = 1 then concat('u', c_custkey, '@mail.example') else 'u@mail' end as mail", "cast(c_custkey % 10 * 1000000000L + c_custkey as string) as phone")
    return c.select("c_custkey", X.is_email("mail").alias("is_email"), X.is_phone("phone").alias("is_phone"), X.page_count("c_custkey").alias("pages"))


@query("complaint_prefill", """with t as (select conv_id, turn, role, case when role = 'user' then case when conv_id % 3 = 0 then 'It was on 12 March 2024 near the Old Bridge, at night. ' when conv_id % 3 = 1 then 'On 03/15/2023 in a very quiet street! ' else 'Nothing here. ' end else case when conv_id % 2 = 0 then 'See BNS Section 303 and IPC 379, a non-cognizable case. ' else 'Look at Section 12A of BNSS. ' end end || text as text from conversations),
    c as (select conv_id, substr(string_agg(text, ' ' order by turn) filter (role = 'user'), 1, 800) as description, count(*) filter (role = 'user') as messages, count(*) filter (role = 'assistant') > 0 as answered from t group by 1)
    select conv_id, md5(coalesce(description, '')) as description, messages::int as messages, case when messages = 0 then null when conv_id % 3 = 0 then '2024-03-12' when conv_id % 3 = 1 then '2023-03-15' end as incident_date,
        case when not answered then '' when conv_id % 2 = 0 then 'BNS Section 303, IPC 379' else 'Section 12A of BNS' end as sections, case when answered and conv_id % 2 = 0 then 'Non-Cognizable' else 'Cognizable' end as fir_type from c""")
def complaint_prefill(spark, sf):
    user = F.when(F.col("conv_id") % 3 == 0, "It was on 12 March 2024 near the Old Bridge, at night. ").when(F.col("conv_id") % 3 == 1, "On 03/15/2023 in a very quiet street! ").otherwise("Nothing here. ")
    answer = F.when(F.col("conv_id") % 2 == 0, "See BNS Section 303 and IPC 379, a non-cognizable case. ").otherwise("Look at Section 12A of BNSS. ")
    t = table(spark, sf, "conversations").withColumn("text", F.concat(F.when(F.col("role") == "user", user).otherwise(answer), F.col("text")))
    out = L.complaint(t, "conv_id", "turn")
    return out.select("conv_id", F.md5(F.col("description").cast("binary")).alias("description"), "messages", "incident_date", "sections", "fir_type")
