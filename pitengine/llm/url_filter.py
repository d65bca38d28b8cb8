"""URL filters by a sort-merge range join, in DataFrame functions only.

A host is written with its labels reversed and each followed by a dot (www.example.com: com.example.www.),
so a host and all its subdomains are one interval of keys, and so are all urls below a path. Rules and
urls are sorted together by key. Walking up the order, each rule that starts puts itself and the rules it
lies in on a stack; a url takes the last stack before it and drops the rules whose interval has ended,
which are those that are no prefix of its key. As prefixes nest, no rule that holds the url can be missing.

There are two sweeps of this kind: over hosts, which gives each url the stack of rule hosts that hold it,
and over host and path, which gives the rule of the longest path for each host of the stack. The longest
rule (host and path together; of equal ones that with the longer host) decides. Rules that
are equal in host and path with different verdicts count as block.

Sorting is by range partitions whose order continues from one to the next: urls with the same key may lie
in several partitions, so a hot host or page does not load one task, and each partition starts with the
last stack of those before it (one row per partition). The dealt rows are a written table, so a lost
executor cannot change the bounds.

Defined cases: null urls and urls without ``://`` have an empty host and path, match no rule and get the
default verdict. A null page_id is a page like any other, and so are rows that repeat one. Empty tables of
pages or rules work; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitengine.llm._shared import ascii_lower, materialize, shuffle_partitions, table

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels in reverse, each followed by a dot; the empty host has the empty key, which no rule is a prefix of."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _sweep(rules: DataFrame, urls: DataFrame, name: str) -> DataFrame:
    """rules: key, stack (array of structs with a field prefix); urls: key and other columns.

    Returns urls with stack: of the last rule at or before the key, what still holds it.
    """
    spark, columns = urls.sparkSession, [c for c in urls.columns if c != "key"]
    both = urls.withColumn("stack", F.lit(None)).unionByName(rules.select("key", "stack"), allowMissingColumns=True)
    both = both.withColumn("_url", F.col("stack").isNull())
    dealt = both.repartitionByRange(shuffle_partitions(spark), "key", "_url", *(F.xxhash64(*columns),) if columns else ())
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), name)
    ends = dealt.where(~F.col("_url")).groupBy("_part").agg(F.max_by("stack", "key").alias("_last"))
    parts = dealt.groupBy("_part").agg(F.count("*")).select("_part").join(ends, "_part", "left")
    before = F.last("_last", True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select("_part", before.alias("_carried"))  # one row per partition
    here = F.last("stack", True).over(Window.partitionBy("_part").orderBy("key", "_url").rowsBetween(Window.unboundedPreceding, 0))
    swept = dealt.withColumn("_here", here).where("_url").join(carried, "_part")
    stack = F.coalesce("_here", "_carried", F.array().cast(dealt.schema["stack"].dataType))
    return swept.select("key", *columns, F.filter(stack, lambda r: F.startswith(F.col("key"), r["prefix"])).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages' ids with host, path, rule and verdict. rules: host, path, verdict (allow or block); a rule path is the text that paths start with."""
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = materialize(rules.withColumn("prefix", reversed_host(F.col("host"))), "url_rules")

    # Host intervals: each rule host with the rule hosts it lies in, itself included.
    hosts = rules.select("host", "prefix").distinct()
    above = F.expr("transform(sequence(1, size(split(prefix, '[.]')) - 1), k -> concat(substring_index(prefix, '.', k), '.'))")
    chain = hosts.select(F.col("prefix").alias("key"), F.explode(above).alias("prefix")).join(hosts, "prefix")
    chain = chain.groupBy("key").agg(F.collect_list(F.struct("prefix", "host")).alias("stack"))

    # Path intervals below a host: each rule with those of the same host whose path its own starts with.
    full = rules.withColumn("key", F.concat("prefix", "path"))
    starts = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.concat(F.col("prefix"), F.substring(F.col("path"), F.lit(1), n)))
    inside = full.select("key", F.explode(starts).alias("prefix"))
    known = full.select(F.col("key").alias("prefix"), F.struct("host", "path", "verdict").alias("rule"))
    paths = inside.join(known, "prefix").groupBy("key").agg(F.collect_list(F.struct("prefix", "rule")).alias("stack"))

    url = F.col(url_col).cast("string")
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.monotonically_increasing_id().alias("row"))
    urls = urls.withColumn("key", reversed_host(F.col("host")))
    held = materialize(_sweep(chain, urls, "url_hosts").withColumn("stack", F.col("stack.prefix")), "url_stacks")
    probes = held.select("row", F.explode("stack").alias("base"), "path").select("row", F.concat("base", "path").alias("key"))
    found = _sweep(paths, probes, "url_paths").where(F.size("stack") > 0)
    # the stack's longest path is the one rule that may win for this host
    deepest = F.array_max(F.transform("stack", lambda r: F.struct((F.length(r["rule"]["host"]) + F.length(r["rule"]["path"])).alias("n"), F.length(r["rule"]["host"]).alias("m"), r["rule"].alias("rule"))))
    best = found.select("row", deepest.alias("best")).groupBy("row").agg(F.max("best").alias("best"))
    rule = F.concat("best.rule.host", "best.rule.path")
    return held.join(best, "row", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce("best.rule.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


ORACLE = r"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') AS raw_host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
urls AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits AS (
  SELECT page_id, host, path, rh || rp AS rule, v, length(rh || rp) AS n FROM urls
  LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, arg_max(rule, n) AS rule, coalesce(arg_max(v, n), 'allow') AS verdict
FROM hits GROUP BY page_id, host, path
"""
