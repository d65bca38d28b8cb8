"""Queries on coverage, splits, sets, resolution, read models, quality, text, JSON, models, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitengine.functions import text as T
from pitengine.functions.stats import competition_rank, ratio_or_zero, safe_ratio
from pitengine.operators import models as M
from pitengine.operators import resolve as R
from pitengine.operators.pit import waterfall
from pitengine.sources import warehouse
from pitengine.sources.tables import ENGAGEMENTS_SQL as ENG
from pitengine.sources.tables import SNAPSHOTS_SQL as SNAP
from pitengine.sources.tables import engagements, snapshots, table


def diversity_report(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values, top share and upper median of counts for four dimensions of the engagements."""
    eng = engagements(spark, d)
    dims = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in ("entity", "place", "market", "series")))).alias("s")
    counts = eng.select(dims).where("s.value IS NOT NULL").groupBy("s.dimension", "s.value").agg(F.count("*").alias("n"))
    own = Window.partitionBy("dimension")
    ranked = counts.withColumn("k", F.row_number().over(own.orderBy("n", "value"))).withColumn("m", F.count("*").over(own))
    return ranked.groupBy("dimension").agg(F.count("*").alias("categories"), F.sum("n").alias("rows"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"), F.max(F.when(F.col("k") == F.floor(F.col("m") / 2) + 1, F.col("n"))).alias("upper_median"), F.count_if(F.col("n") == 1).alias("singletons"))


DIVERSITY_REPORT = ENG + """,
s AS (SELECT unnest([{'d': 'entity', 'v': entity::varchar}, {'d': 'place', 'v': place::varchar}, {'d': 'market', 'v': market::varchar}, {'d': 'series', 'v': series}]) AS s FROM eng),
c AS (SELECT s.d AS dimension, s.v AS value, count(*) AS n FROM s WHERE s.v IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n, value) AS k, count(*) OVER (PARTITION BY dimension) AS m FROM c)
SELECT dimension, count(*) AS categories, sum(n)::bigint AS rows, round(max(n) / sum(n)::double, 6) AS top_share, max(n) FILTER (k = m // 2 + 1) AS upper_median, count(*) FILTER (n = 1) AS singletons FROM r GROUP BY dimension
"""


def size_bins(spark: SparkSession, d: str) -> DataFrame:
    """Engagements by half-open bins of headcount; unknown and multi-show apart."""
    h = F.col("headcount")
    label = F.when(h.isNull(), "UNKNOWN").when(F.col("shows") > 5, "MULTI_SHOW")
    for low, high in ((0, 50), (50, 100), (100, 200)):
        label = label.when((h >= low) & (h < high), f"{low}-{high}")
    return engagements(spark, d).groupBy(label.otherwise("200+").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("gross"), 4).alias("mean_gross"))


SIZE_BINS = ENG + """SELECT CASE WHEN headcount IS NULL THEN 'UNKNOWN' WHEN shows > 5 THEN 'MULTI_SHOW' WHEN headcount < 50 THEN '0-50' WHEN headcount < 100 THEN '50-100' WHEN headcount < 200 THEN '100-200' ELSE '200+' END AS bin, count(*) AS n, round(avg(gross), 4) AS mean_gross FROM eng GROUP BY 1"""


def temporal_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Engagements by year and series with subtotals, first and last day."""
    eng = engagements(spark, d).select(F.year("start_date").alias("year"), "series", "start_date", "entity")
    out = eng.rollup("year", "series").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"), F.min("start_date").alias("first_day"), F.max("start_date").alias("last_day"))
    return out.select(F.coalesce(F.col("year").cast("string"), F.lit("ALL")).alias("year"), F.coalesce("series", F.lit("ALL")).alias("series"), "n", "entities", "first_day", "last_day")


TEMPORAL_COVERAGE = ENG + "SELECT coalesce(year(start_date)::varchar, 'ALL') AS year, coalesce(series, 'ALL') AS series, count(*) AS n, count(DISTINCT entity) AS entities, min(start_date) AS first_day, max(start_date) AS last_day FROM eng GROUP BY ROLLUP (year(start_date), series)"


def readiness_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Markets as ready or not for a model, with the first floor that they miss."""
    g = engagements(spark, d).where("headcount IS NOT NULL").groupBy("market").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"), F.count_distinct("place").alias("places"))
    rows = waterfall(g, [("TOO_FEW_ROWS", F.col("n") < 500), ("TOO_FEW_ENTITIES", F.col("entities") < 60), ("TOO_FEW_PLACES", F.col("places") < 30)])
    return rows.select("market", "n", "entities", "places", F.when(F.col("reason").isNull(), "READY").otherwise("NOT_READY").alias("verdict"), "reason")


READINESS_VERDICT = ENG + ", g AS (SELECT market, count(*) AS n, count(DISTINCT entity) AS entities, count(DISTINCT place) AS places FROM eng WHERE headcount IS NOT NULL GROUP BY market) SELECT *, CASE WHEN n < 500 OR entities < 60 OR places < 30 THEN 'NOT_READY' ELSE 'READY' END AS verdict, CASE WHEN n < 500 THEN 'TOO_FEW_ROWS' WHEN entities < 60 THEN 'TOO_FEW_ENTITIES' WHEN places < 30 THEN 'TOO_FEW_PLACES' END AS reason FROM g"

_KPIS = (("engagements", "count(*)", 10000), ("with_result", "count(pub_date)", 14000), ("sold_out", "count_if(sold_out)", 7000), ("entities", "count(DISTINCT entity)", 2000), ("places", "count(DISTINCT place)", 50), ("single_show", "count_if(shows = 1)", 1000))


def coverage_kpis(spark: SparkSession, d: str) -> DataFrame:
    """Counts against objectives in one pass, as rows: BELOW, AT or ABOVE."""
    wide = engagements(spark, d).agg(*(F.expr(e).alias(n) for n, e, _ in _KPIS))
    long = wide.unpivot([], [n for n, _, _ in _KPIS], "kpi", "value")
    goal = F.create_map(*(F.lit(x) for n, _, g in _KPIS for x in (n, g)))[F.col("kpi")].cast("long")
    return long.select("kpi", "value", goal.alias("objective"), F.round(ratio_or_zero(F.col("value"), goal), 6).alias("ratio"), F.when(F.col("value") < goal, "BELOW").when(F.col("value") == goal, "AT").otherwise("ABOVE").alias("status"))


COVERAGE_KPIS = ENG + ", k AS (" + " UNION ALL ".join(f"SELECT '{n}' AS kpi, {e} AS value, {g}::bigint AS objective FROM eng" for n, e, g in _KPIS) + ") SELECT *, round(coalesce(value / nullif(objective, 0)::double, 0), 6) AS ratio, CASE WHEN value < objective THEN 'BELOW' WHEN value = objective THEN 'AT' ELSE 'ABOVE' END AS status FROM k"


def coverage_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Labels per source and language of the documents: an empty denominator is 0.0 in coverage and NULL in yield."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    rows = docs.join(table(spark, d, "labels"), "doc_id", "left").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return rows.select("source", "lang", "docs", "labelled", F.round(ratio_or_zero(F.col("labelled"), F.col("docs")), 6).alias("coverage"), F.round(safe_ratio(F.col("toxic"), F.col("labelled")), 6).alias("toxic_yield"))


COVERAGE_RATIOS = "SELECT source, lang, count(*) AS docs, count(quality) AS labelled, round(coalesce(count(quality) / nullif(count(*), 0)::double, 0), 6) AS coverage, round(count(*) FILTER (toxic = 1) / nullif(count(quality), 0)::double, 6) AS toxic_yield FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang"


def voi_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Parts by value of information: importance times gain over cost, 0 where the cost is not positive."""
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("uses"), F.count_distinct("l_suppkey").alias("suppliers"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice").join(lines, "l_partkey", "left").na.fill(0, ["uses", "suppliers"])
    voi = F.when(F.col("p_retailprice") > 0, F.round(F.col("uses") * F.col("suppliers") * 100 / F.col("p_retailprice"), 3)).otherwise(0.0)
    ranked = parts.withColumn("voi", voi)
    return ranked.select(F.col("l_partkey").alias("part"), "p_brand", "uses", "suppliers", "voi", competition_rank(["p_brand"], F.desc("voi")).cast("long").alias("place"))


VOI_RANKING = """
WITH u AS (SELECT l_partkey, count(*) AS uses, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1),
v AS (SELECT p_partkey AS part, p_brand, coalesce(uses, 0) AS uses, coalesce(suppliers, 0) AS suppliers, CASE WHEN p_retailprice > 0 THEN round(coalesce(uses, 0) * coalesce(suppliers, 0) * 100 / p_retailprice, 3) ELSE 0 END AS voi FROM part LEFT JOIN u ON l_partkey = p_partkey)
SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY voi DESC) AS place FROM v
"""


def time_split(spark: SparkSession, d: str) -> DataFrame:
    """TRAIN up to the day at 80 % of the distinct days, TEST after it; days are ordered, not rows."""
    eng = engagements(spark, d)
    days = eng.select("start_date").where("start_date IS NOT NULL").distinct()
    ranked = days.withColumn("k", F.row_number().over(Window.orderBy("start_date"))).withColumn("m", F.count("*").over(Window.partitionBy()))
    cut = ranked.agg(F.max(F.when(F.col("k") <= F.greatest(F.floor(F.col("m") * 0.8), F.lit(1)), F.col("start_date"))).alias("cut"))
    fold = F.when(F.col("start_date") <= F.col("cut"), "TRAIN").otherwise("TEST")
    return eng.crossJoin(F.broadcast(cut)).select("id", "series", fold.alias("fold")).groupBy("series", "fold").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))  # cut is one row


TIME_SPLIT = ENG + """,
r AS (SELECT start_date, row_number() OVER (ORDER BY start_date) AS k, count(*) OVER () AS m FROM (SELECT DISTINCT start_date FROM eng WHERE start_date IS NOT NULL)),
c AS (SELECT max(start_date) FILTER (k <= greatest(floor(m * 0.8), 1)) AS cut FROM r)
SELECT series, CASE WHEN start_date <= cut THEN 'TRAIN' ELSE 'TEST' END AS fold, count(*) AS n, min(id) AS first_id FROM eng, c GROUP BY ALL
"""


def hash_group_split(spark: SparkSession, d: str) -> DataFrame:
    """Folds by the parity of a digest of the group: rows of one entity are never on both sides."""
    digit = F.conv(F.substring(F.sha2(F.concat(F.lit("entity:"), F.col("entity").cast("string")), 256), 1, 2), 16, 10).cast("int")
    return engagements(spark, d).select("id", "entity", F.when(digit % 2 == 0, "TRAIN").otherwise("TEST").alias("fold"))


HASH_GROUP_SPLIT = ENG + "SELECT id, entity, CASE WHEN ('0x' || sha256('entity:' || entity)[1:2])::int % 2 = 0 THEN 'TRAIN' ELSE 'TEST' END AS fold FROM eng"


def stable_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 100 documents that does not change between runs: the smallest digests of the id."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2(F.col("doc_id").cast("string"), 256).alias("digest"))
    return docs.orderBy("digest", "doc_id").limit(100)


STABLE_SAMPLE = "SELECT doc_id, lang, sha256(doc_id::varchar) AS digest FROM documents ORDER BY digest, doc_id LIMIT 100"


def bootstrap_delta(spark: SparkSession, d: str) -> DataFrame:
    """90 % interval of the difference of two errors over 200 draws of entities; an entity drawn twice counts once.

    A draw keeps about 63 % of the entities, decided by a digest, so a draw is a filter and not a sample on the driver.
    """
    eng = engagements(spark, d).where("headcount IS NOT NULL AND gross IS NOT NULL")
    per = eng.groupBy("entity").agg(F.sum(F.abs(F.col("headcount") - 100)).alias("a"), F.sum(F.abs(F.col("gross") / 1500 - 100)).alias("b"), F.count("*").alias("n"))
    draws = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(199))))
    digit = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("draw").cast("string"), F.col("entity").cast("string")), 256), 1, 4), 16, 10).cast("int")
    deltas = draws.where(digit < int(0.632 * 65536)).groupBy("draw").agg(((F.sum("a") - F.sum("b")) / F.sum("n")).alias("delta"))
    return deltas.agg(F.count("*").alias("draws"), F.round(F.avg("delta"), 4).alias("mean"), F.round(F.percentile("delta", 0.05), 4).alias("low"), F.round(F.percentile("delta", 0.95), 4).alias("high"))


BOOTSTRAP_DELTA = ENG + """,
p AS (SELECT entity, sum(abs(headcount - 100)) AS a, sum(abs(gross / 1500 - 100)) AS b, count(*) AS n FROM eng WHERE headcount IS NOT NULL AND gross IS NOT NULL GROUP BY entity),
x AS (SELECT draw, (sum(a) - sum(b)) / sum(n) AS delta FROM p, range(200) r(draw) WHERE ('0x' || sha256(draw || '|' || entity)[1:4])::int < 41418 GROUP BY draw)
SELECT count(*) AS draws, round(avg(delta), 4) AS mean, round(quantile_cont(delta, 0.05), 4) AS low, round(quantile_cont(delta, 0.95), 4) AS high FROM x
"""


def jaccard_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Shared inventory of nation pairs by the part brands that their suppliers deliver; pairs meet through brands."""
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    brand = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", "p_size").alias("item"))
    items = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(sup, "l_suppkey").join(brand, "l_partkey").select("nation", "item").distinct()
    size = items.groupBy("nation").agg(F.count("*").alias("n"))
    a, b = items.alias("a"), items.alias("b")
    shared = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("a.nation") < F.col("b.nation"))).groupBy(F.col("a.nation").alias("left"), F.col("b.nation").alias("right")).agg(F.count("*").alias("shared"))
    out = shared.join(size.select(F.col("nation").alias("left"), F.col("n").alias("nl")), "left").join(size.select(F.col("nation").alias("right"), F.col("n").alias("nr")), "right")
    return out.select("left", "right", "shared", F.round(F.col("shared") / (F.col("nl") + F.col("nr") - F.col("shared")), 6).alias("jaccard"))


JACCARD_INVENTORY = """
WITH i AS (SELECT DISTINCT s_nationkey AS nation, p_brand || '/' || p_size AS item FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
n AS (SELECT nation, count(*) AS n FROM i GROUP BY 1), s AS (SELECT a.nation AS l, b.nation AS r, count(*) AS shared FROM i a JOIN i b ON a.item = b.item AND a.nation < b.nation GROUP BY ALL)
SELECT l AS left, r AS right, shared, round(shared / (nl.n + nr.n - shared)::double, 6) AS jaccard FROM s JOIN n nl ON nl.nation = l JOIN n nr ON nr.nation = r
"""


def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """Brand pairs that share orders: how many, in the first and last year."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    seen = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey").select("l_orderkey", "brand").distinct()
    # an order has few lines, so its pairs are few; brands are a closed list
    pairs = seen.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("brand")).alias("b")).join(orders, "l_orderkey")
    left = pairs.select("year", F.posexplode("b").alias("i", "left"), "b").select("year", "left", F.explode(F.slice("b", F.col("i") + 2, F.size("b"))).alias("right"))
    return left.groupBy("left", "right").agg(F.count("*").alias("orders"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


CO_OCCURRENCE = """
WITH s AS (SELECT DISTINCT l_orderkey, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT a.brand AS left, b.brand AS right, count(*) AS orders, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.brand < b.brand JOIN orders ON o_orderkey = a.l_orderkey GROUP BY ALL
"""


def billing_arbitrage(spark: SparkSession, d: str) -> DataFrame:
    """Per series: mean difference of the ranks by gross and by headcount of its entities."""
    g = engagements(spark, d).groupBy("series", "entity").agg(F.round(F.sum("gross"), 2).alias("gross"), F.sum("headcount").alias("headcount")).where("gross IS NOT NULL AND headcount IS NOT NULL")
    rows = g.withColumn("a", competition_rank(["series"], F.desc("headcount"))).withColumn("b", competition_rank(["series"], F.desc("gross")))
    return rows.groupBy("series").agg(F.count("*").alias("n"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("arbitrage"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("distance"))


BILLING_ARBITRAGE = ENG + """,
g AS (SELECT series, entity, round(sum(gross), 2) AS gross, sum(headcount) AS headcount FROM eng GROUP BY ALL HAVING sum(gross) IS NOT NULL AND sum(headcount) IS NOT NULL),
r AS (SELECT series, rank() OVER (PARTITION BY series ORDER BY headcount DESC) AS a, rank() OVER (PARTITION BY series ORDER BY gross DESC) AS b FROM g)
SELECT series, count(*) AS n, round(avg(a - b), 6) AS arbitrage, round(avg(abs(a - b)), 6) AS distance FROM r GROUP BY series
"""


def attention_share(spark: SparkSession, d: str) -> DataFrame:
    """Shares of each key in the attention of its day, and the day's concentration; NULL where nothing was seen."""
    rows = snapshots(spark, d).groupBy(F.to_date("seen_at").alias("day"), "key").agg(F.sum("price").alias("v"))
    days = rows.groupBy("day").agg(F.count("v").alias("covered"), F.count("*").alias("keys"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"), F.max("v").alias("top"))
    return days.select("day", "keys", F.round(F.col("covered") / F.col("keys"), 6).alias("coverage"), F.round(F.try_divide(F.col("squares"), F.col("total") * F.col("total")), 6).alias("hhi"), F.round(F.try_divide(F.col("top"), F.col("total")), 6).alias("top_share"))


ATTENTION_SHARE = SNAP + ", r AS (SELECT seen_at::date AS day, key, sum(price) AS v FROM snap GROUP BY ALL) SELECT day, count(*) AS keys, round(count(v) / count(*)::double, 6) AS coverage, round(sum(v * v) / nullif(sum(v) * sum(v), 0), 6) AS hhi, round(max(v) / nullif(sum(v), 0), 6) AS top_share FROM r GROUP BY day"


def _ladder(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers against customers: by exact digits of the name, nation and balance, or nation and near balance."""
    sup = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.floor("s_acctbal").alias("sb"), F.substring("s_name", -6, 6).alias("sn"))
    cus = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.floor("c_acctbal").alias("cb"), F.substring("c_name", -6, 6).alias("cn"))
    by_name = sup.join(cus, (F.col("sn") == F.col("cn")))
    by_balance = sup.join(cus, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.floor(F.col("sb") / 50) == F.floor(F.col("cb") / 50)))
    none = sup.withColumn("c_custkey", F.lit(None).cast("long"))
    pairs = by_name.unionByName(by_balance).unionByName(none, allowMissingColumns=True)
    same_nation = F.col("s_nationkey") == F.col("c_nationkey")
    steps = [("NAME_AND_NATION", (F.col("sn") == F.col("cn")) & same_nation), ("BALANCE", (F.col("sb") == F.col("cb")) & same_nation), ("NEAR_BALANCE", same_nation & (F.floor(F.col("sb") / 50) == F.floor(F.col("cb") / 50)))]
    return R.ladder(pairs, "s_suppkey", "c_custkey", steps)


def resolve_ladder(spark: SparkSession, d: str) -> DataFrame:
    return _ladder(spark, d)


RESOLVE_LADDER = """
WITH c AS (
  SELECT s_suppkey, c_custkey, CASE WHEN s_name[-6:] = c_name[-6:] AND s_nationkey = c_nationkey THEN 0 WHEN floor(s_acctbal) = floor(c_acctbal) AND s_nationkey = c_nationkey THEN 1
    WHEN s_nationkey = c_nationkey AND floor(floor(s_acctbal) / 50) = floor(floor(c_acctbal) / 50) THEN 2 END AS step
  FROM supplier JOIN customer ON s_name[-6:] = c_name[-6:] OR s_nationkey = c_nationkey),
b AS (SELECT s_suppkey, min(step) AS step FROM c GROUP BY 1),
h AS (SELECT c.s_suppkey, c.step, count(DISTINCT c_custkey) AS n, min(c_custkey) AS m FROM c JOIN b ON b.s_suppkey = c.s_suppkey AND b.step = c.step GROUP BY ALL)
SELECT s.s_suppkey, CASE WHEN n IS NULL THEN 'NO_MATCH' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS status, ['NAME_AND_NATION', 'BALANCE', 'NEAR_BALANCE'][step + 1] AS method, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN m END AS match
FROM supplier s LEFT JOIN h USING (s_suppkey)
"""


def resolve_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    return _ladder(spark, d).groupBy("status", "method").agg(F.count("*").alias("n"), F.max("candidates").alias("most"))


RESOLVE_AMBIGUITY = "SELECT status, method, count(*) AS n, max(candidates) AS most FROM (" + RESOLVE_LADDER + ") GROUP BY ALL"


def cluster_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Engagements of an entity whose start falls into the running anchor's span, clustered greedily in date order."""
    eng = engagements(spark, d).select("id", "entity", "start_date", "pub_date")
    return R.anchor_clusters(eng, ["entity"], "start_date", "pub_date", "id").select("id", "entity", "anchor")


def cross_source_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sources on a part: how far their discounts, taxes and quantities agree."""
    lines = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("l_quantity", "l_discount", "l_tax")))
    out = R.agreement(lines, "l_partkey", "l_suppkey", ["l_quantity", "l_discount", "l_tax"])
    return out.select("field", "compared", "exact", F.round("mean_spread", 5).alias("mean_spread"), F.round("max_part", 5).alias("max_part"))


CROSS_SOURCE_AGREEMENT = """
WITH l AS (SELECT l_partkey, l_suppkey, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY ALL),
u AS (FROM l UNPIVOT (value FOR field IN (l_quantity, l_discount, l_tax))),
p AS (SELECT l_partkey, field, count(DISTINCT l_suppkey) AS sources, min(value) AS low, max(value) AS high FROM u GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1)
SELECT field, count(*) AS compared, count(*) FILTER (low = high) AS exact, round(avg(high - low), 5) AS mean_spread, round(max((high - low) / nullif(abs(high), 0)), 5) AS max_part FROM p GROUP BY field
"""


def external_id_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Values of a property that several keys carry: a row per value and key, with how many keys the value has."""
    pairs = snapshots(spark, d).where("level IS NOT NULL").select("level", "key").distinct()
    several = pairs.groupBy("level").agg(F.count("*").alias("n")).where("n > 1")
    return pairs.join(several, "level").select("level", "key", "n")


EXTERNAL_ID_COLLISIONS = SNAP + "SELECT DISTINCT s.level, key, n FROM snap s JOIN (SELECT level, count(DISTINCT key) AS n FROM snap WHERE level IS NOT NULL GROUP BY level HAVING count(DISTINCT key) > 1) c ON c.level = s.level"


def search_layers(spark: SparkSession, d: str) -> DataFrame:
    """Names and aliases searched for a text: exact before prefix before substring, one row per entity."""
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("term"), F.col("n_name").alias("name"))
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("term"), F.col("r_name").alias("name"))
    part = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_type").alias("term"), F.col("p_name").alias("name"))
    return R.search(nation.unionByName(region).unionByName(part), "id", "term", "an", "name").select("id", F.col("layer").cast("long").alias("layer"), "name")


SEARCH_LAYERS = """
WITH t AS (SELECT 'n' || n_nationkey AS id, n_name AS term, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, r_name FROM region UNION ALL SELECT 'p' || p_partkey, p_type, p_name FROM part),
l AS (SELECT id, name, CASE WHEN lower(term) = 'an' THEN 1 WHEN starts_with(lower(term), 'an') THEN 2 WHEN contains(lower(term), 'an') THEN 3 END AS layer FROM t)
SELECT id, min(layer)::bigint AS layer, min(name) AS name FROM l WHERE layer IS NOT NULL GROUP BY id
"""


def entity_card(spark: SparkSession, d: str) -> DataFrame:
    """A wide row per entity: history, last result, markets' names, and the state of each section."""
    eng = engagements(spark, d)
    history = eng.groupBy("entity").agg(F.count("*").alias("engagements"), F.count_distinct("place").alias("places"), F.max("start_date").alias("last_start"), F.round(F.sum("gross"), 2).alias("gross"), F.max_by("headcount", F.when(F.col("headcount").isNotNull(), F.struct("start_date", "id"))).alias("last_headcount"))
    cus = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), "c_nationkey")
    nat = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("market"))
    card = cus.join(nat, "c_nationkey", "left").join(history, "entity", "left")
    return card.select("entity", "name", "market", F.coalesce("engagements", F.lit(0).cast("long")).alias("engagements"), "places", "last_start", "gross", "last_headcount", F.when(F.col("engagements") > 0, "OBSERVED").otherwise("UNKNOWN").alias("state"))


ENTITY_CARD = ENG + """,
h AS (SELECT entity, count(*) AS engagements, count(DISTINCT place) AS places, max(start_date) AS last_start, round(sum(gross), 2) AS gross, arg_max(headcount, (start_date, id)) AS last_headcount FROM eng GROUP BY entity)
SELECT c_custkey AS entity, c_name AS name, n_name AS market, coalesce(engagements, 0) AS engagements, places, last_start, gross, last_headcount, CASE WHEN engagements > 0 THEN 'OBSERVED' ELSE 'UNKNOWN' END AS state
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN h ON h.entity = c_custkey
"""


def evidence_union_all(spark: SparkSession, d: str) -> DataFrame:
    """Texts of three tables as one tagged evidence list, counted by kind and length class."""
    parts = [table(spark, d, t).select(F.lit(t).alias("kind"), F.col(c).alias("text")) for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"))]
    long = F.when(F.length("text") >= 1000, "LONG").when(F.length("text") > 0, "SHORT").otherwise("EMPTY")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind", long.alias("size")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


EVIDENCE_UNION_ALL = "WITH e AS (SELECT 'documents' AS kind, text FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'conversations', text FROM conversations) SELECT kind, CASE WHEN length(text) >= 1000 THEN 'LONG' WHEN length(text) > 0 THEN 'SHORT' ELSE 'EMPTY' END AS size, count(*) AS n, sum(length(text))::bigint AS chars FROM e GROUP BY ALL"


def markets_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Nations of customers and suppliers, and whether both, in one list."""
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit(1).alias("side"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit(2).alias("side"))
    return a.union(b).distinct().groupBy("nation").agg((F.count("*") == 2).alias("both"))


MARKETS_UNION_DISTINCT = "SELECT nation, count(*) = 2 AS both FROM (SELECT c_nationkey AS nation, 1 AS side FROM customer UNION SELECT s_nationkey, 2 FROM supplier) GROUP BY nation"


def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    """Row checks that each row may fail several of, and one on the data set."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey", "left")
    checks = {"QUANTITY_NOT_POSITIVE": F.col("l_quantity") <= 0, "DISCOUNT_OUT_OF_RANGE": ~F.col("l_discount").between(0, 0.1), "SHIPPED_BEFORE_ORDER": F.col("l_shipdate") < F.col("o_orderdate"), "NO_ORDER": F.col("o_orderdate").isNull(), "HIGH_TAX": F.col("l_tax") > 0.07}
    failed = lines.select("l_orderkey", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in checks.items())))).alias("check"))
    return failed.groupBy("check").agg(F.count("*").alias("rows"), F.count_distinct("l_orderkey").alias("orders"))


QUALITY_CHECKS = """
WITH j AS (SELECT l_orderkey, l_quantity, l_discount, l_tax, l_shipdate, o_orderdate FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT l_orderkey, unnest(list_filter([CASE WHEN l_quantity <= 0 THEN 'QUANTITY_NOT_POSITIVE' END, CASE WHEN NOT l_discount BETWEEN 0 AND 0.1 THEN 'DISCOUNT_OUT_OF_RANGE' END, CASE WHEN l_shipdate < o_orderdate THEN 'SHIPPED_BEFORE_ORDER' END,
  CASE WHEN o_orderdate IS NULL THEN 'NO_ORDER' END, CASE WHEN l_tax > 0.07 THEN 'HIGH_TAX' END], lambda x: x IS NOT NULL)) AS "check" FROM j)
SELECT "check", count(*) AS rows, count(DISTINCT l_orderkey) AS orders FROM f GROUP BY ALL
"""


def accounting_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Order totals against the sum of their lines: TIES, NEAR_TIE, DOES_NOT_TIE or INSUFFICIENT."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("lines"))
    o = table(spark, d, "orders")
    rows = o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left")
    off = F.abs(F.col("lines") - F.col("o_totalprice"))
    state = F.when(F.col("lines").isNull() | F.col("o_totalprice").isNull(), "INSUFFICIENT").when(off <= 1, "TIES").when(off <= 0.25 * F.col("o_totalprice"), "NEAR_TIE").otherwise("DOES_NOT_TIE")
    return rows.groupBy(state.alias("state"), "o_orderstatus").agg(F.count("*").alias("n"))


ACCOUNTING_RECONCILIATION = """
WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS lines FROM lineitem GROUP BY 1)
SELECT CASE WHEN lines IS NULL OR o_totalprice IS NULL THEN 'INSUFFICIENT' WHEN abs(lines - o_totalprice) <= 1 THEN 'TIES' WHEN abs(lines - o_totalprice) <= 0.25 * o_totalprice THEN 'NEAR_TIE' ELSE 'DOES_NOT_TIE' END AS state, o_orderstatus, count(*) AS n
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY ALL
"""


_PII_TABLES = ("customer", "supplier", "orders", "documents", "events")
#: Headers of a partner's file beside those of the tables.
_PII_HEADERS = ("Buyer E-Mail", "phone", "dob", "cvv", "bank", "payment_method", "order_id", "cell", "last4", "First Name", "zip", "Artist Name", "venue_name", "capacity", "customer", "customer_event_id")


def pii_columns(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on the headers of the star's tables and of a partner's file; no value is read."""
    names = [(t, c) for t in _PII_TABLES for c in table(spark, d, t).columns] + [("partner", h) for h in _PII_HEADERS]
    headers = spark.createDataFrame(names, "table string, header string")  # one row per column
    return headers.select("table", "header", warehouse.header_verdict(F.col("header")).alias("verdict"))


_PII_COLUMNS = {"customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "documents": "doc_id text lang source n_chars", "events": "event_id ts user_id event_type value props"}
_one_of = lambda patterns: " OR ".join(f"regexp_matches(h, '{p}')" for p in patterns)
PII_COLUMNS = (
    "WITH n AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in [*((t, cs.split()) for t, cs in _PII_COLUMNS.items()), ("partner", _PII_HEADERS)] for c in cs) + ") v(\"table\", header)), "
    "h AS (SELECT *, regexp_replace(regexp_replace(lower(header), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS h FROM n) "
    f"SELECT \"table\", header, CASE WHEN h IN {warehouse.PII_EXEMPT} THEN 'SAFE' WHEN {_one_of(warehouse.PII_PROHIBITED)} THEN 'PROHIBITED' WHEN {_one_of(warehouse.PII_POTENTIAL)} THEN 'POTENTIAL_PII' ELSE 'SAFE' END AS verdict FROM h"
)


def feature_admission(spark: SparkSession, d: str) -> DataFrame:
    """Features in the order of their gates: leakage, then coverage, then spread."""
    eng = engagements(spark, d)
    stats = eng.agg(*(F.struct(F.count(c).alias("known"), F.count("*").alias("rows"), F.approx_count_distinct(c).alias("distinct")).alias(c) for c in ("place", "market", "series", "headcount", "gross", "shows", "sold_out")))
    long = stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}.known").alias("known"), F.col(f"{c}.rows").alias("rows"), (F.col(f"{c}.distinct") > 1).alias("varies")) for c in stats.columns))).alias("s")).select("s.*")
    rows = waterfall(long, [("LEAKS_OUTCOME", F.col("feature").isin("headcount", "gross", "sold_out")), ("LOW_COVERAGE", F.col("known") < 0.5 * F.col("rows")), ("CONSTANT", ~F.col("varies"))])
    return rows.select("feature", "known", "rows", F.coalesce("reason", F.lit("ADMITTED")).alias("gate"))


FEATURE_ADMISSION = ENG + ", s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS known, count(*) AS rows, count(DISTINCT {c}) > 1 AS varies FROM eng" for c in ("place", "market", "series", "headcount", "gross", "shows", "sold_out")) + ") SELECT feature, known, rows, CASE WHEN feature IN ('headcount', 'gross', 'sold_out') THEN 'LEAKS_OUTCOME' WHEN known < 0.5 * rows THEN 'LOW_COVERAGE' WHEN NOT varies THEN 'CONSTANT' ELSE 'ADMITTED' END AS gate FROM s"


def retrospective_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Feature claims that a study with a cutoff may see, and leaks: visible claims that the sealed outcomes hold.

    The sealed outcomes are derived on their own, from the engagements that a study of the year after the cutoff predicts.
    """
    eng = engagements(spark, d)
    long = lambda e: e.select("id", "pub_date", F.col("headcount").cast("double").alias("headcount"), F.col("gross").alias("gross"), F.col("shows").cast("double").alias("shows")).unpivot(["id", "pub_date"], ["headcount", "gross", "shows"], "claim", "value")
    visible = long(eng).where((F.col("pub_date") <= F.lit("1998-01-01").cast("date")) & (F.col("claim") != "gross") & F.col("value").isNotNull())
    sealed = long(eng.where("start_date >= '1998-01-01' OR (start_date >= '1997-11-01' AND pub_date <= '1998-01-01' AND priority = '5-LOW')")).where("claim <> 'shows'").select("id", "claim")
    leaks = visible.join(sealed, ["id", "claim"], "left_semi").groupBy("claim").agg(F.count("*").alias("leaks"))
    seen = visible.groupBy("claim").agg(F.count("*").alias("visible"))
    zero = F.lit(0).cast("long")
    out = long(eng).groupBy("claim").agg(F.count("*").alias("claims")).join(seen, "claim", "left").join(leaks, "claim", "left")
    return out.select("claim", "claims", F.coalesce("visible", zero).alias("visible"), F.coalesce("leaks", zero).alias("leaks"))


RETROSPECTIVE_INPUTS = ENG + """,
c AS (SELECT id, pub_date, start_date, priority, unnest([{'c': 'headcount', 'v': headcount::double}, {'c': 'gross', 'v': gross}, {'c': 'shows', 'v': shows::double}]) AS s FROM eng),
v AS (SELECT s.c AS claim, coalesce(pub_date <= '1998-01-01' AND s.c <> 'gross' AND s.v IS NOT NULL, false) AS visible,
        coalesce(s.c <> 'shows' AND (start_date >= '1998-01-01' OR (start_date >= '1997-11-01' AND pub_date <= '1998-01-01' AND priority = '5-LOW')), false) AS sealed FROM c)
SELECT claim, count(*) AS claims, count(*) FILTER (visible) AS visible, count(*) FILTER (visible AND sealed) AS leaks FROM v GROUP BY claim
"""


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Name keys of parts and customers: distinct forms, and how often each is used."""
    names = table(spark, d, "part").select(F.col("p_type").alias("n")).unionAll(table(spark, d, "customer").select(F.col("c_mktsegment").alias("n"))).unionAll(table(spark, d, "nation").select("n_name"))
    return names.select(T.name_key(F.col("n")).alias("name_key"), T.compact_key(F.col("n")).alias("compact"), T.slug(F.col("n")).alias("slug")).groupBy("name_key", "compact", "slug").agg(F.count("*").alias("n"))


TEXT_NORMALIZE = """
WITH n AS (SELECT p_type AS n FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT n_name FROM nation)
SELECT regexp_replace(trim(regexp_replace(regexp_replace(lower(n), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '^(the )+', '') AS name_key, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS compact,
       regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, count(*) AS n FROM n GROUP BY ALL
"""


def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Pages by canonical address: sorted query without tracking keys, default ports and fragments dropped."""
    pages = table(spark, d, "pages").select("page_id", T.canonical_urls("url").alias("canonical"))
    return pages.groupBy("canonical").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


def intent_flags(spark: SparkSession, d: str) -> DataFrame:
    """Intents of conversation turns by ordered patterns; the first that fits."""
    text = F.lower("text")
    intent = F.when(text.rlike(r"\?"), "QUESTION").when(text.rlike(r"\b(thanks|thank you)\b"), "THANKS").when(text.rlike(r"\d"), "NUMERIC").otherwise("STATEMENT")
    return table(spark, d, "conversations").groupBy("role", intent.alias("intent")).agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"))


INTENT_FLAGS = r"SELECT role, CASE WHEN regexp_matches(lower(text), '\?') THEN 'QUESTION' WHEN regexp_matches(lower(text), '\b(thanks|thank you)\b') THEN 'THANKS' WHEN regexp_matches(lower(text), '\d') THEN 'NUMERIC' ELSE 'STATEMENT' END AS intent, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY ALL"


def wordlist_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """(positive - negative) / words of each document by a word list; NULL without words."""
    return table(spark, d, "documents").select("doc_id", F.round(T.word_sentiment(F.col("text")), 6).alias("sentiment"))


WORDLIST_SENTIMENT = """
WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) > 0 THEN round((len(list_filter(w, lambda x: x IN ('good', 'great', 'love', 'best', 'the'))) - len(list_filter(w, lambda x: x IN ('bad', 'worst', 'hate', 'idiot', 'moron')))) / len(w)::double, 6) END AS sentiment FROM w
"""


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of each page: its lines, words and length."""
    rows = table(spark, d, "pages").select("page_id", T.html_lines(F.col("html")).alias("text"))
    return rows.select("page_id", F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).cast("long").alias("lines"), F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))


HTML_TO_TEXT = r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|title|ul|article|nav)\s*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b),
e AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\n\f\v]+', ' ', 'g'))), lambda x: x <> '') AS l FROM c)
SELECT page_id, len(l) AS lines, length(array_to_string(l, chr(10))) AS chars, sha256(array_to_string(l, chr(10))) AS sha256 FROM e
"""


def number_parse(spark: SparkSession, d: str) -> DataFrame:
    """The first number in each document, and numbers in page addresses."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), T.first_number(F.col("text")).alias("number"))
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), T.first_number(F.col("url")).alias("number"))
    return docs.unionByName(pages)


NUMBER_PARSE = r"""
WITH t AS (SELECT 'd' || doc_id AS id, text AS t FROM documents UNION ALL SELECT 'p' || page_id, url FROM pages)
SELECT id, nullif(replace(regexp_extract(regexp_replace(t, '(\d),(\d{3})', '\1\2', 'g'), '(-?\d+(?:\.\d+)?)', 1), ',', ''), '')::double AS number FROM t
"""


def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    """JSON properties as rows: each key with the kinds and range of its values."""
    rows = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))
    number = F.col("value").try_cast("double")
    return rows.groupBy("event_type", "name").agg(F.count("*").alias("n"), F.count(number).alias("numeric"), F.min(number).alias("low"), F.max(number).alias("high"))


JSON_PROPS_EXTRACT = """
WITH k AS (SELECT event_type, unnest(json_keys(props)) AS name, props FROM events), v AS (SELECT event_type, name, json_extract_string(props, '$.' || name) AS value FROM k)
SELECT event_type, name, count(*) AS n, count(try_cast(value AS double)) AS numeric, min(try_cast(value AS double)) AS low, max(try_cast(value AS double)) AS high FROM v GROUP BY ALL
"""


def json_explode_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Names with aliases as JSON arrays, exploded to one term each, with the entities that share it."""
    part = table(spark, d, "part").select("p_partkey", F.to_json(F.split("p_type", " ")).alias("aliases"))
    terms = part.select("p_partkey", F.explode(F.from_json("aliases", "array<string>")).alias("alias"))
    return terms.groupBy("alias").agg(F.count("*").alias("uses"), F.count_distinct("p_partkey").alias("entities"))


JSON_EXPLODE_ALIASES = "SELECT alias, count(*) AS uses, count(DISTINCT p_partkey) AS entities FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS alias FROM part) GROUP BY alias"


def shares_map(spark: SparkSession, d: str) -> DataFrame:
    """Per key a map of status to share, written as sorted JSON-like text."""
    counts = snapshots(spark, d).groupBy("key", "status").agg(F.count("*").alias("n"))
    share = counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("key")), 4))
    listed = F.array_sort(F.collect_list(F.concat_ws("=", "status", F.format_number("share", 4))))
    return share.groupBy("key").agg(F.array_join(listed, ";").alias("shares"), F.count("*").alias("kinds"))


SHARES_MAP = SNAP + ", c AS (SELECT key, status, count(*) AS n FROM snap GROUP BY ALL), s AS (SELECT key, status, round(n / sum(n) OVER (PARTITION BY key)::double, 4) AS share FROM c) SELECT key, string_agg(status || '=' || printf('%.4f', share), ';' ORDER BY status || '=' || printf('%.4f', share)) AS shares, count(*) AS kinds FROM s GROUP BY key"


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    eng = engagements(spark, d).where("headcount > 0 AND gross > 0")
    return eng.select("series", "headcount", F.col("shows").cast("double").alias("shows"), F.log("gross").alias("log_gross"), F.log("headcount").alias("log_headcount"), F.col("sold_out").cast("double").alias("sold_out"))


def _coefficients(fitted: DataFrame) -> DataFrame:
    return fitted.select("series", "n", *(F.round(F.col("coefficients")[k], 5).alias(f"b{k}") for k in range(2)))


def ols_log_linear(spark: SparkSession, d: str) -> DataFrame:
    """log headcount on shows per series."""
    return _coefficients(M.solve(M.normal_equations(_model_rows(spark, d), ["series"], ["shows"], "log_headcount"), ["series"]))


OLS_LOG_LINEAR = ENG + ", r AS (SELECT series, ln(headcount) AS y, shows::double AS x FROM eng WHERE headcount > 0 AND gross > 0) SELECT series, count(*) AS n, round(regr_intercept(y, x), 5) AS b0, round(regr_slope(y, x), 5) AS b1 FROM r GROUP BY series"


def ridge(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(M.solve(M.normal_equations(_model_rows(spark, d), ["series"], ["shows"], "log_headcount"), ["series"], l2=10.0))


RIDGE = ENG + """, r AS (SELECT series, ln(headcount) AS y, shows::double AS x FROM eng WHERE headcount > 0 AND gross > 0),
s AS (SELECT series, count(*) AS n, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + 10) AS b, avg(y) AS my, avg(x) AS mx FROM r GROUP BY series)
SELECT series, n, round(my - b * mx, 5) AS b0, round(b, 5) AS b1 FROM s"""


def poisson(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(M.fit_glm(_model_rows(spark, d), ["series"], ["shows"], "headcount", "poisson"))


def logistic(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(M.fit_glm(_model_rows(spark, d), ["series"], ["shows"], "sold_out", "logistic"))


QUERIES = {name: (run, globals().get(name.upper())) for name, run in list(globals().items()) if callable(run) and getattr(run, "__module__", "") == __name__ and not name.startswith("_")}
