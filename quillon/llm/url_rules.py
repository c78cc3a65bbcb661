"""URL filter: nested host and path rules against urls by a sort-merge range join, with DataFrame functions only.

A host becomes the key of its labels in reverse order, each with a dot behind it ("com.example."): a rule for a host and
all its subdomains is then the interval of keys from "com.example." up to, not including, "com.example/" ("/" follows ".").
Such intervals nest or are apart. Sorted, their ends are events; a stack of open rules is kept while they pass, and each
event is noted with the stack that holds from it on. Urls are merged into that order by one sort of keys: the last event
before a url has its stack, from which the longest rule whose path starts the url's path decides.

Urls are dealt over salts by row number, not by host, so a host with a third of all urls is as evenly dealt as any; each
salt gets all events (two for a rule's host). Rules are swept in blocks of MAX_RULES, so what a salt sorts besides its
urls is bounded; the longest rule over the blocks decides.

Defined cases: null url or no "://" gives empty host and path, which no rule fits; ties in length go to the longer host,
then to the greater rule string; very long urls are taken whole; repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import shuffle_partitions, table

Rule = tuple[str, str, str]  # host, path, verdict

#: The rules of the query, fixed values.
RULES: tuple[Rule, ...] = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
MAX_RULES = 2000
SALTS_PER_PARTITION = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CLOSE, OPEN, URL = 0, 1, 2  # in this order at the same key

_STACK = "array<struct<size:int,host_size:int,rule:string,path:string,verdict:string>>"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_key(host: Column) -> Column:
    """The labels in reverse order, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def events(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(key, stack): the rules that are open from each key on, innermost host last."""
    rows = spark.createDataFrame([(h.translate(str.maketrans(UPPER, LOWER)), p, v) for h, p, v in rules], "host string, path string, verdict string")
    entry = F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "path", "verdict"
    )
    hosts = rows.groupBy(host_key(F.col("host")).alias("key")).agg(F.sort_array(F.collect_set(entry)).alias("own"))
    ends = hosts.select(F.explode(F.array(
        F.struct("key", F.lit(OPEN).alias("kind"), "own"),
        F.struct(F.expr("concat(left(key, length(key) - 1), '/')").alias("key"), F.lit(CLOSE).alias("kind"), F.expr("filter(own, x -> false)").alias("own")),
    )).alias("e")).agg(F.sort_array(F.collect_list("e")).alias("ends"))
    swept = F.expr(f"""aggregate(ends,
        named_struct('open', cast(array() as array<{_STACK}>), 'out', cast(array() as array<struct<key:string,kind:int,stack:{_STACK}>>)),
        (a, e) -> named_struct(
            'open', if(e.kind = {OPEN}, concat(a.open, array(e.own)), slice(a.open, 1, size(a.open) - 1)),
            'out', concat(a.out, array(named_struct('key', e.key, 'kind', e.kind, 'stack',
                flatten(if(e.kind = {OPEN}, concat(a.open, array(e.own)), slice(a.open, 1, size(a.open) - 1))))))),
        a -> a.out)""")
    return ends.select(F.explode(swept).alias("e")).select("e.*")


def judge(urls: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """urls(url, and the columns to keep) -> those, host, path, rule (or null), verdict."""
    spark = urls.sparkSession
    salts = SALTS_PER_PARTITION * shuffle_partitions(spark)
    out = urls.select(*keep, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(None).cast("struct<size:int,host_size:int,rule:string,path:string,verdict:string>").alias("best"))
    out = out.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("path", F.coalesce("path", F.lit("")))
    out = out.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    for at in range(0, len(rules), MAX_RULES):
        block = events(spark, rules[at : at + MAX_RULES]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        points = out.withColumn("key", host_key(F.col("host"))).withColumn("kind", F.lit(URL))
        merged = points.unionByName(block, allowMissingColumns=True)
        sweep = Window.partitionBy("salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        merged = merged.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where(F.col("kind") == URL)
        fits = F.array_max(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])))
        out = merged.withColumn("best", F.greatest(F.col("best"), fits) if at else fits).drop("key", "kind", "stack")
    return out.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages."""
    return judge(table(spark, sf_dir, "pages"))


_SQL = """
with rules(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                               ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
best as (select page_id, host, path, arg_max(h || p, length(h || p) * 1000 + length(h)) as rule, arg_max(v, length(h || p) * 1000 + length(h)) as v
         from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from best
"""

QUERIES = {"op10_url_rules": op10_url_rules}
ORACLES = {"op10_url_rules": _SQL}
