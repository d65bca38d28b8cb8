"""Reports: coverage, quality, bias, rights, yields and counts, most of them in long form with zero-filled closed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitengine.functions.stats import ratio_or_zero, safe_ratio
from pitengine.sources.tables import ENGAGEMENTS_SQL as ENG
from pitengine.sources.tables import SNAPSHOTS_SQL as SNAP
from pitengine.sources.tables import engagements, snapshots, table


def market_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Filtered and distinct counts of each market's engagements."""
    e = engagements(spark, d)
    return e.groupBy("market").agg(F.count("*").alias("engagements"), F.count_if(F.col("shows") == 1).alias("single_show"), F.count("headcount").alias("with_headcount"), F.count_distinct("entity").alias("entities"), F.count_distinct("place").alias("places"), F.count_distinct(F.year("start_date")).alias("years"))


MARKET_COVERAGE = ENG + "SELECT market, count(*) AS engagements, count(*) FILTER (shows = 1) AS single_show, count(headcount) AS with_headcount, count(DISTINCT entity) AS entities, count(DISTINCT place) AS places, count(DISTINCT year(start_date)) AS years FROM eng GROUP BY market"

#: Targets of a model: the value, and the condition under which an engagement has it.
TARGETS = (("HEADCOUNT", "headcount", "shows <= 5"), ("GROSS", "gross", "gross > 0"), ("SELL_OUT", "sold_out::int", "shows = 1"))


def target_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Per target family: eligible rows, entities and places, and the rows that other conditions keep out."""
    long = engagements(spark, d).select("entity", "place", F.explode(F.array(*(F.struct(F.lit(n).alias("target"), F.expr(f"CASE WHEN {c} THEN {v.replace('::int', '')} END IS NOT NULL").alias("has")) for n, v, c in TARGETS))).alias("t"))
    has = F.col("t.has")
    return long.groupBy("t.target").agg(F.count_if(has).alias("eligible"), F.count_if(~has).alias("excluded"), F.count_distinct(F.when(has, F.col("entity"))).alias("entities"), F.count_distinct(F.when(has, F.col("place"))).alias("places"))


TARGET_READINESS = ENG + ", t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS target, entity, place, coalesce(({c}) AND ({v}) IS NOT NULL, false) AS has FROM eng" for n, v, c in TARGETS) + ") SELECT target, count(*) FILTER (has) AS eligible, count(*) FILTER (NOT has) AS excluded, count(DISTINCT entity) FILTER (has) AS entities, count(DISTINCT place) FILTER (has) AS places FROM t GROUP BY target"


def data_quality_report(spark: SparkSession, d: str) -> DataFrame:
    """Totals, distributions, duplicates, conflicts and completeness as (section, item, n, part)."""
    s = snapshots(spark, d)
    total = s.count()
    section = lambda rows, name, item: rows.select(F.lit(name).alias("section"), item.cast("string").alias("item"), F.col("n"))
    status = section(s.groupBy("status").agg(F.count("*").alias("n")), "status", F.col("status"))
    level = section(s.groupBy("level").agg(F.count("*").alias("n")), "level", F.coalesce(F.col("level").cast("string"), F.lit("UNKNOWN")))
    copies = s.groupBy("key", "status", "price").agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("n"))
    conflicts = s.groupBy("key", "seen_at").agg(F.count_distinct("price").alias("v")).agg(F.count_if(F.col("v") > 1).alias("n"))
    known = s.agg(*(F.count(c).alias(c) for c in ("price", "level", "status"))).unpivot([], ["price", "level", "status"], "item", "n")
    out = status.unionByName(level).unionByName(section(copies, "duplicates", F.lit("rows"))).unionByName(section(conflicts, "conflicts", F.lit("groups"))).unionByName(section(known, "complete", F.col("item")))
    return out.withColumn("part", F.round(ratio_or_zero(F.col("n"), F.lit(total)), 6))


DATA_QUALITY_REPORT = SNAP + """,
r AS (
  SELECT 'status' AS section, status AS item, count(*) AS n FROM snap GROUP BY status
  UNION ALL SELECT 'level', coalesce(level::varchar, 'UNKNOWN'), count(*) FROM snap GROUP BY level
  UNION ALL SELECT 'duplicates', 'rows', coalesce(sum(m - 1), 0)::bigint FROM (SELECT count(*) AS m FROM snap GROUP BY key, status, price)
  UNION ALL SELECT 'conflicts', 'groups', count(*) FILTER (v > 1) FROM (SELECT count(DISTINCT price) AS v FROM snap GROUP BY key, seen_at)
  UNION ALL SELECT 'complete', 'price', count(price) FROM snap UNION ALL SELECT 'complete', 'level', count(level) FROM snap UNION ALL SELECT 'complete', 'status', count(status) FROM snap)
SELECT section, item, n, round(coalesce(n / nullif((SELECT count(*) FROM snap), 0)::double, 0), 6) AS part FROM r
"""

#: The closed list of outcome types; one that no claim has is reported with zero.
OUTCOMES = ("HEADCOUNT", "GROSS", "SOLD_OUT", "SHOWS", "SETTLEMENT")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """Outcome claims of engagements: id, type, value, quality and rights."""
    e = engagements(spark, d)
    quality = F.when(F.col("status") == "F", "REPORTED").when(F.col("status") == "O", "ESTIMATED").otherwise("UNKNOWN")
    rights = F.when(F.col("priority").isin("1-URGENT", "2-HIGH"), "COMMERCIAL").when(F.col("priority") == "3-MEDIUM", "RESEARCH").otherwise("UNKNOWN")
    wide = e.select("id", quality.alias("quality"), rights.alias("rights"), F.col("headcount").cast("double").alias("HEADCOUNT"), F.col("gross").cast("double").alias("GROSS"), F.col("sold_out").cast("double").alias("SOLD_OUT"), F.col("shows").cast("double").alias("SHOWS"))
    return wide.unpivot(["id", "quality", "rights"], ["HEADCOUNT", "GROSS", "SOLD_OUT", "SHOWS"], "type", "value").where("value IS NOT NULL")


_claims_sql = ENG + """,
q AS (SELECT *, CASE status WHEN 'F' THEN 'REPORTED' WHEN 'O' THEN 'ESTIMATED' ELSE 'UNKNOWN' END AS quality, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'COMMERCIAL' WHEN priority = '3-MEDIUM' THEN 'RESEARCH' ELSE 'UNKNOWN' END AS rights FROM eng),
claims AS (
  SELECT id, quality, rights, 'HEADCOUNT' AS type, headcount::double AS value FROM q WHERE headcount IS NOT NULL UNION ALL SELECT id, quality, rights, 'GROSS', gross FROM q WHERE gross IS NOT NULL
  UNION ALL SELECT id, quality, rights, 'SOLD_OUT', sold_out::int FROM q WHERE sold_out IS NOT NULL UNION ALL SELECT id, quality, rights, 'SHOWS', shows FROM q WHERE shows IS NOT NULL)
"""


def outcome_coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """Per outcome type: distinct events, their part of all events, and a histogram of quality."""
    c = _claims(spark, d)
    events = engagements(spark, d).select("id").distinct().count()
    per = c.groupBy("type").agg(F.count_distinct("id").alias("events"), *(F.count_if(F.col("quality") == q).alias(q.lower()) for q in ("REPORTED", "ESTIMATED", "UNKNOWN")))
    return per.withColumn("coverage", F.round(ratio_or_zero(F.col("events"), F.lit(events)), 6))


OUTCOME_COVERAGE_REPORT = _claims_sql + "SELECT type, count(DISTINCT id) AS events, count(*) FILTER (quality = 'REPORTED') AS reported, count(*) FILTER (quality = 'ESTIMATED') AS estimated, count(*) FILTER (quality = 'UNKNOWN') AS unknown, round(count(DISTINCT id) / (SELECT count(DISTINCT id) FROM eng)::double, 6) AS coverage FROM claims GROUP BY type"


def economic_coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """A scorecard over the closed list of types, absent ones with zero, and events that have headcount and gross both."""
    c = _claims(spark, d)
    per = c.groupBy("type").agg(F.count("*").alias("claims"), F.count_distinct("id").alias("events"))
    listed = spark.createDataFrame([(t,) for t in OUTCOMES], "type string")  # a closed list
    flags = c.groupBy("id").agg(F.bool_or(F.col("type") == "HEADCOUNT").alias("h"), F.bool_or(F.col("type") == "GROSS").alias("g"), F.bool_or(F.col("type") == "SETTLEMENT").alias("s"))
    both = flags.agg(F.count_if(F.col("h") & F.col("g")).alias("events"), F.count_if(F.col("h") | F.col("s")).alias("either")).select(F.explode(F.array(F.struct(F.lit("HEADCOUNT_AND_GROSS").alias("type"), F.col("events")), F.struct(F.lit("HEADCOUNT_OR_SETTLEMENT").alias("type"), F.col("either").alias("events")))).alias("x")).select("x.*")
    zero = F.lit(0).cast("long")
    out = listed.join(per, "type", "left").select("type", F.coalesce("claims", zero).alias("claims"), F.coalesce("events", zero).alias("events"))
    return out.unionByName(both.withColumn("claims", F.lit(None).cast("long")))


ECONOMIC_COVERAGE_REPORT = _claims_sql + f""",
f AS (SELECT id, bool_or(type = 'HEADCOUNT') AS h, bool_or(type = 'GROSS') AS g, bool_or(type = 'SETTLEMENT') AS s FROM claims GROUP BY id)
SELECT t.type, count(c.id) AS claims, count(DISTINCT c.id) AS events FROM (SELECT unnest({list(OUTCOMES)}) AS type) t LEFT JOIN claims c ON c.type = t.type GROUP BY t.type
UNION ALL SELECT 'HEADCOUNT_AND_GROSS', NULL, count(*) FILTER (h AND g) FROM f UNION ALL SELECT 'HEADCOUNT_OR_SETTLEMENT', NULL, count(*) FILTER (h OR s) FROM f
"""


def selection_bias_report(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent values of market, series, place and year among engagements with a result, and among all."""
    e = engagements(spark, d)
    dims = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("item")) for k, c in (("market", F.col("market")), ("series", F.col("series")), ("place", F.col("place")), ("year", F.year("start_date"))))))
    counts = e.select(dims.alias("x"), F.col("pub_date").isNotNull().alias("known")).where("x.item IS NOT NULL").groupBy("x.dimension", "x.item").agg(F.count_if("known").alias("known"), F.count("*").alias("n"))
    best = counts.groupBy("dimension").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("known")).alias("k"), "item", "n"))), 1, 10).alias("top"), F.sum("known").alias("total"))
    rows = best.select("dimension", "total", F.posexplode("top").alias("place", "t"))
    return rows.select("dimension", (F.col("place") + 1).cast("long").alias("place"), "t.item", (-F.col("t.k")).alias("known"), "t.n", F.round(safe_ratio(-F.col("t.k"), F.col("total")), 6).alias("share"))


SELECTION_BIAS_REPORT = ENG + """,
x AS (SELECT unnest([{'d': 'market', 'i': market::varchar}, {'d': 'series', 'i': series}, {'d': 'place', 'i': place::varchar}, {'d': 'year', 'i': year(start_date)::varchar}]) AS x, pub_date IS NOT NULL AS known FROM eng),
c AS (SELECT x.d AS dimension, x.i AS item, count(*) FILTER (known) AS known, count(*) AS n FROM x WHERE x.i IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY known DESC, item) AS place, sum(known) OVER (PARTITION BY dimension) AS total FROM c)
SELECT dimension, place, item, known, n, round(known / nullif(total, 0)::double, 6) AS share FROM r WHERE place <= 10
"""


def research_commercial_split(spark: SparkSession, d: str) -> DataFrame:
    """Claims and distinct events by rights class and type."""
    return _claims(spark, d).groupBy("rights").agg(F.count("*").alias("claims"), F.count_distinct("id").alias("events"), F.count_if(F.col("quality") == "REPORTED").alias("reported"))


RESEARCH_COMMERCIAL_SPLIT = _claims_sql + "SELECT rights, count(*) AS claims, count(DISTINCT id) AS events, count(*) FILTER (quality = 'REPORTED') AS reported FROM claims GROUP BY rights"


def structural_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How often entities, places and their pairs repeat: keys, keys seen again, and the most."""
    e, out = engagements(spark, d), None
    for name, keys in (("entity", ["entity"]), ("place", ["place"]), ("entity_place", ["entity", "place"]), ("entity_market", ["entity", "market"])):
        one = e.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.lit(name).alias("structure"), F.count("*").alias("keys"), F.count_if(F.col("n") >= 2).alias("repeated"), F.count_if(F.col("n") >= 5).alias("five_up"), F.max("n").alias("most"))
        out = one if out is None else out.unionByName(one)
    return out


STRUCTURAL_COVERAGE = ENG + " UNION ALL ".join(f"SELECT '{name}' AS structure, count(*) AS keys, count(*) FILTER (n >= 2) AS repeated, count(*) FILTER (n >= 5) AS five_up, max(n) AS most FROM (SELECT count(*) AS n FROM eng WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY {', '.join(keys)})" for name, keys in (("entity", ["entity"]), ("place", ["place"]), ("entity_place", ["entity", "place"]), ("entity_market", ["entity", "market"])))

STATUSES = ("view", "click", "purchase", "signup", "error", "RATE_LIMITED", "BLOCKED")


def summarize_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Counts over a closed list of statuses, zero for those not met; others are summed as OTHER."""
    listed = spark.createDataFrame([(s,) for s in (*STATUSES, "OTHER")], "status string")
    n = snapshots(spark, d).groupBy(F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("OTHER").alias("status")).agg(F.count("*").alias("attempts"), F.round(F.sum("price"), 2).alias("cost"))
    return listed.join(n, "status", "left").select("status", F.coalesce("attempts", F.lit(0).cast("long")).alias("attempts"), "cost")


SUMMARIZE_ATTEMPTS = SNAP + f", n AS (SELECT CASE WHEN status IN {STATUSES} THEN status ELSE 'OTHER' END AS status, price FROM snap) SELECT l.status, count(n.status) AS attempts, round(sum(price), 2) AS cost FROM (SELECT unnest({[*STATUSES, 'OTHER']}) AS status) l LEFT JOIN n ON n.status = l.status GROUP BY l.status"


def yield_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rates of each run (a user's events of a day) with explicit denominators; NULL where the denominator is zero."""
    s = snapshots(spark, d)
    runs = s.groupBy("key", F.to_date("seen_at").alias("run")).agg(F.count("*").alias("requests"), F.count_if(F.col("status") == "purchase").alias("claims"), F.count_if(F.col("status") == "click").alias("tasks"), F.count_if(F.col("price") > 50).alias("events"), F.sum("price").alias("cost"))
    per = lambda c, den: F.when(F.col(den) > 0, F.round(F.col(c) * (1000.0 / F.col(den)), 4))
    return runs.select("key", "run", per("claims", "requests").alias("claims_per_1000_requests"), per("claims", "tasks").alias("claims_per_1000_tasks"), per("events", "requests").alias("events_per_1000_requests"), F.when(F.col("requests") > 0, F.round((F.col("claims") + F.col("events")) / F.col("requests"), 6)).alias("success_rate"), F.when(F.col("claims") > 0, F.round(F.col("cost") / F.col("claims"), 4)).alias("cost_per_claim"))


YIELD_METRICS = SNAP + """,
r AS (SELECT key, seen_at::date AS run, count(*) AS requests, count(*) FILTER (status = 'purchase') AS claims, count(*) FILTER (status = 'click') AS tasks, count(*) FILTER (price > 50) AS events, sum(price) AS cost FROM snap GROUP BY ALL)
SELECT key, run, round(claims * (1000.0::double / requests), 4) AS claims_per_1000_requests, CASE WHEN tasks > 0 THEN round(claims * (1000.0::double / tasks), 4) END AS claims_per_1000_tasks, round(events * (1000.0::double / requests), 4) AS events_per_1000_requests,
       round((claims + events) / requests::double, 6) AS success_rate, CASE WHEN claims > 0 THEN round(cost / claims, 4) END AS cost_per_claim FROM r
"""


def market_vector(spark: SparkSession, d: str) -> DataFrame:
    """Per entity and market as of a day: past and upcoming, the last 12 months, places and repeats, first, last and next."""
    at = F.lit("1997-01-01").cast("date")
    e = engagements(spark, d).where("start_date IS NOT NULL")
    past, ahead = F.col("start_date") < at, F.col("start_date") >= at
    places = e.where(past & F.col("place").isNotNull()).groupBy("entity", "market", "place").agg(F.count("*").alias("n")).groupBy("entity", "market").agg(F.count("*").alias("places"), F.count_if(F.col("n") > 1).alias("repeat_places"))
    out = e.groupBy("entity", "market").agg(F.count_if(past).alias("past"), F.count_if(ahead).alias("upcoming"), F.count_if(past & (F.col("start_date") >= F.add_months(at, -12))).alias("last_12_months"), F.min(F.when(past, F.col("start_date"))).alias("first_day"), F.max(F.when(past, F.col("start_date"))).alias("last_day"), F.min(F.when(ahead, F.col("start_date"))).alias("next_day"))
    zero = F.lit(0).cast("long")
    return out.join(places, ["entity", "market"], "left").withColumn("places", F.coalesce("places", zero)).withColumn("repeat_places", F.coalesce("repeat_places", zero))


MARKET_VECTOR = ENG + """,
p AS (SELECT entity, market, count(*) AS places, count(*) FILTER (n > 1) AS repeat_places FROM (SELECT entity, market, place, count(*) AS n FROM eng WHERE start_date < '1997-01-01' AND place IS NOT NULL GROUP BY ALL) GROUP BY ALL),
v AS (SELECT entity, market, count(*) FILTER (start_date < '1997-01-01') AS past, count(*) FILTER (start_date >= '1997-01-01') AS upcoming, count(*) FILTER (start_date < '1997-01-01' AND start_date >= '1996-01-01') AS last_12_months,
        min(start_date) FILTER (start_date < '1997-01-01') AS first_day, max(start_date) FILTER (start_date < '1997-01-01') AS last_day, min(start_date) FILTER (start_date >= '1997-01-01') AS next_day FROM eng WHERE start_date IS NOT NULL GROUP BY ALL)
SELECT v.*, coalesce(places, 0) AS places, coalesce(repeat_places, 0) AS repeat_places FROM v LEFT JOIN p USING (entity, market)
"""


def identity_qa(spark: SparkSession, d: str) -> DataFrame:
    """Resolutions of suppliers by name digits held against the truth (same nation): confusion, precision, recall and ambiguous part."""
    s = table(spark, d, "supplier").select("s_suppkey", F.substring("s_name", -6, 6).alias("tail"), "s_nationkey")
    c = table(spark, d, "customer").select(F.substring("c_name", -6, 6).alias("tail"), "c_nationkey").groupBy("tail").agg(F.count("*").alias("candidates"), F.min("c_nationkey").alias("nation"))
    r = s.join(c, "tail", "left")
    matched, truth = F.coalesce(F.col("candidates") == 1, F.lit(False)), F.coalesce(F.col("nation") == F.col("s_nationkey"), F.lit(False))
    q = r.agg(F.count("*").alias("cases"), F.count_if(matched & truth).alias("tp"), F.count_if(matched & ~truth).alias("fp"), F.count_if(~matched & truth).alias("fn"), F.count_if(~matched & ~truth).alias("tn"), F.count_if(F.col("candidates") > 1).alias("ambiguous"))
    return q.select("*", F.round(safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(safe_ratio(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("false_positive_rate"))


IDENTITY_QA = """
WITH c AS (SELECT c_name[-6:] AS tail, count(*) AS candidates, min(c_nationkey) AS nation FROM customer GROUP BY 1),
r AS (SELECT coalesce(candidates = 1, false) AS m, coalesce(nation = s_nationkey, false) AS t, candidates FROM supplier LEFT JOIN c ON tail = s_name[-6:]),
q AS (SELECT count(*) AS cases, count(*) FILTER (m AND t) AS tp, count(*) FILTER (m AND NOT t) AS fp, count(*) FILTER (NOT m AND t) AS fn, count(*) FILTER (NOT m AND NOT t) AS tn, count(*) FILTER (candidates > 1) AS ambiguous FROM r)
SELECT *, round(tp / nullif(tp + fp, 0)::double, 6) AS precision, round(tp / nullif(tp + fn, 0)::double, 6) AS recall, round(fp / nullif(fp + tn, 0)::double, 6) AS false_positive_rate FROM q
"""


def coverage_by_target(spark: SparkSession, d: str) -> DataFrame:
    """Per series: how many of its target places have engagements, know their headcount, or are shared; shares clamped to 0 to 1."""
    e = engagements(spark, d).where("place IS NOT NULL")
    targets = e.where("start_date < '1997-01-01'").select("series", "place").distinct()
    later = e.where("start_date >= '1997-01-01'").select("series", "place").distinct()
    seen = targets.join(later, ["series", "place"], "left_semi").groupBy("series").agg(F.count("*").alias("covered"))
    lost = targets.join(later, ["series", "place"], "left_anti").groupBy("series").agg(F.count("*").alias("missing"))
    out = targets.groupBy("series").agg(F.count("*").alias("targets")).join(seen, "series", "left").join(lost, "series", "left").na.fill(0)
    return out.withColumn("part", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio_or_zero(F.col("covered"), F.col("targets")))), 6))


COVERAGE_BY_TARGET = ENG + """,
t AS (SELECT DISTINCT series, place FROM eng WHERE place IS NOT NULL AND start_date < '1997-01-01'), l AS (SELECT DISTINCT series, place FROM eng WHERE place IS NOT NULL AND start_date >= '1997-01-01')
SELECT t.series, count(*) AS targets, count(l.place) AS covered, count(*) - count(l.place) AS missing, round(least(1, greatest(0, count(l.place) / count(*)::double)), 6) AS part FROM t LEFT JOIN l ON l.series = t.series AND l.place = t.place GROUP BY t.series
"""


def canonical_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts that fall back on a second table where the first is empty, and cost since a time."""
    e, s = engagements(spark, d), snapshots(spark, d)
    a = e.where("shows > 1000").agg(F.count("*").alias("a")).crossJoin(e.agg(F.count_distinct("id").alias("b"), F.count_distinct(F.concat_ws("|", F.lower(F.col("entity").cast("string")), F.col("start_date").cast("string"))).alias("performances"), F.count_distinct("place").alias("places"), F.count_if(F.col("start_date") > F.lit("1998-01-01").cast("date")).alias("future"), F.count_if(F.col("sold_out") & (F.col("status") == "F")).alias("settled"), F.count_if(F.col("pub_date").isNull() & F.col("place").isNull()).alias("unknown")))
    cost = s.where("seen_at >= '2024-01-15'").agg(F.round(F.sum("price"), 2).alias("cost_since"))
    return a.crossJoin(cost).select(F.when(F.col("a") > 0, F.col("a")).otherwise(F.col("b")).alias("engagements"), "performances", "places", "future", "settled", "unknown", "cost_since")  # one row each


CANONICAL_COUNTS = ENG + """,
s AS (SELECT round(sum(value), 2) AS cost_since FROM events WHERE ts >= '2024-01-15')
SELECT CASE WHEN count(*) FILTER (shows > 1000) > 0 THEN count(*) FILTER (shows > 1000) ELSE count(DISTINCT id) END AS engagements, count(DISTINCT coalesce(lower(entity::varchar), '') || '|' || coalesce(start_date::varchar, '')) AS performances, count(DISTINCT place) AS places,
       count(*) FILTER (start_date > '1998-01-01') AS future, count(*) FILTER (sold_out AND status = 'F') AS settled, count(*) FILTER (pub_date IS NULL AND place IS NULL) AS unknown, (SELECT cost_since FROM s) AS cost_since FROM eng
"""

QUERIES = {name.lower(): (globals()[name.lower()], globals()[name]) for name in list(globals()) if name.isupper() and name.lower() in globals()}
