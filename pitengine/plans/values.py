"""Queries that read raw values: names, keys, numbers, dates and phrases as text, milestones, cutoffs and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitengine.functions import forms as V
from pitengine.functions.geo_time import end_of_day, known_by, minute_bucket
from pitengine.operators import pit
from pitengine.sources.tables import ENGAGEMENTS_SQL as ENG
from pitengine.sources.tables import SNAPSHOTS_SQL as SNAP
from pitengine.sources.tables import engagements, snapshots, table

SPONSORS = ("small", "red", "economy brushed")


def name_forms(spark: SparkSession, d: str) -> DataFrame:
    """Parts as places: normal forms, the name without a sponsor, ids, and whether name and type match."""
    p = table(spark, d, "part")
    name = F.concat(F.lit("The  "), F.initcap("p_name"))
    return p.select("p_partkey", V.place_name(name).alias("place"), V.without_prefix(name, SPONSORS).alias("unsponsored"), V.person_name(F.concat("p_name", F.lit("!'s "), "p_brand")).alias("person"), V.words(name).alias("entity_key"), F.concat_ws(":", F.lit("venue"), V.words(F.col("p_brand")), V.words(F.col("p_name"))).alias("place_id"), V.observation_id(F.lit("shop"), F.col("p_name")).alias("observation"), V.contained(F.lower("p_name"), F.lower(F.split("p_name", " ")[0])).alias("strong"))


NAME_FORMS = """
WITH n AS (SELECT *, string_split(p_name, ' ') AS w FROM part), x AS (SELECT *, 'the ' || lower(p_name) AS entity_key FROM n)
SELECT p_partkey, lower(p_name) AS place, CASE WHEN starts_with(lower(p_name), 'small ') THEN lower(p_name)[7:] WHEN starts_with(lower(p_name), 'red ') THEN lower(p_name)[5:] WHEN starts_with(lower(p_name), 'economy brushed ') THEN lower(p_name)[17:] ELSE lower(p_name) END AS unsponsored,
  trim(regexp_replace(regexp_replace(lower(p_name || '!''s ' || p_brand), '[^a-z0-9''\\- ]', '', 'g'), ' +', ' ', 'g')) AS person, entity_key, 'venue:' || lower(p_brand) || ':' || lower(p_name) AS place_id, 'canon_' || sha1('shop|' || p_name)[1:24] AS observation, true AS strong FROM x
"""


def event_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of engagements from entity, place and day; the customer's own id goes first where it is given."""
    e = engagements(spark, d)
    key = V.event_key(F.col("entity"), F.col("place"), F.col("start_date"))
    own = F.when(F.col("id") % 5 == 0, F.concat(F.lit("own-"), F.col("id").cast("string")))
    return e.select("id", key.alias("event_key"), F.coalesce(own, key).alias("resolved"), F.substring(F.col("start_date").cast("string"), 1, 10).alias("day"))


EVENT_KEYS = ENG + ", k AS (SELECT *, 'boxoffice_' || coalesce(entity::varchar, '') || '_' || coalesce(place::varchar, '') || '_' || coalesce(start_date::varchar, '') AS event_key FROM eng) SELECT id, event_key, CASE WHEN id % 5 = 0 THEN 'own-' || id ELSE event_key END AS resolved, start_date::varchar AS day FROM k"


def raw_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Balances as written with signs, separators and blanks; price ranges; city and state; sale states."""
    c = table(spark, d, "customer")
    raw = F.when(F.col("c_custkey") % 7 == 0, "n/a").when(F.col("c_custkey") % 11 == 0, " - ").otherwise(F.concat(F.lit(" $"), F.format_number("c_acctbal", 2)))
    low, high = V.price_range(F.concat(F.lit("from $"), F.format_number("c_acctbal", 2), F.lit(" to 1,500.5")))
    city, state = V.city_and_state(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" , "), "c_name", F.lit(", x"))))
    code = F.element_at(F.array(*map(F.lit, ("onsale", "Cancelled ", "", "moved"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select("c_custkey", V.to_number(raw).alias("number"), low.alias("low"), high.alias("high"), city.alias("city"), state.alias("state"), V.sale_state(code).alias("sale"))


RAW_NUMBERS = """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS number, CASE WHEN c_acctbal < 0 THEN least(-round(c_acctbal, 2), 1500.5) ELSE least(round(c_acctbal, 2), 1500.5) END AS low, greatest(abs(round(c_acctbal, 2)), 1500.5) AS high,
       c_mktsegment AS city, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS state, ['ONSALE', 'CANCELED', 'UNKNOWN', 'MOVED'][c_custkey % 4 + 1] AS sale FROM customer
"""


def raw_dates(spark: SparkSession, d: str) -> DataFrame:
    """Days of orders as written in seven ways, read back; several dates in one text are none."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("day", "MMM. d")).when(F.col("o_orderkey") % 3 == 1, F.date_format("day", "MMMM d, yyyy")).otherwise(F.concat_ws(" and ", F.date_format("day", "MMM d, yyyy"), F.lit("May 2, 2001")))
    stamp = F.concat(F.date_format("day", "yyyyMMdd"), F.lit("T101500Z"))
    return o.select(
        "o_orderkey", V.single_date(text, F.year("day")).alias("single"), F.to_date(F.date_format("day", "yyyyMMdd"), "yyyyMMdd").alias("digits"), F.unix_seconds(V.compact_time(stamp)).alias("stamp"),
        F.to_date(F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + 5000)).alias("from_epoch"), F.unix_seconds(end_of_day(F.col("day"))).alias("end_of_day"), minute_bucket(F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + 61)).alias("bucket"),
    )


RAW_DATES = """
WITH o AS (SELECT o_orderkey, o_orderdate::date AS day FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE day END AS single, day AS digits, epoch(day + INTERVAL '10 hours 15 minutes')::bigint AS stamp, day AS from_epoch, epoch(day::timestamp)::bigint + 86399 AS end_of_day, strftime(day, '%Y-%m-%d') || 'T00:01' AS bucket FROM o
"""


def date_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of four kinds (month and day, with year, ISO, weekday) resolved against a publication day."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    kind = F.col("o_orderkey") % 5
    phrase = F.when(kind == 0, F.date_format("day", "MMMM d")).when(kind == 1, F.concat(F.date_format("day", "MMMM d, yyyy"), F.lit(" at 10 a.m."))).when(kind == 2, F.date_format("day", "yyyy-MM-dd")).when(kind == 3, F.date_format("day", "EEEE")).otherwise("some day soon")
    return o.select("o_orderkey", V.date_phrase(phrase, F.date_add("day", -7)).alias("resolved"))


DATE_PHRASES = "WITH o AS (SELECT o_orderkey, o_orderdate::date AS day FROM orders) SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN make_date(year(day - 7), month(day), day(day)) WHEN 4 THEN NULL ELSE day END AS resolved FROM o WHERE NOT (o_orderkey % 5 = 0 AND month(day) = 2 AND day(day) = 29) UNION ALL SELECT o_orderkey, CASE WHEN year(day - 7) = year(day) THEN day END FROM o WHERE o_orderkey % 5 = 0 AND month(day) = 2 AND day(day) = 29"


def _ladder(start, onsale):
    """(milestone, due, basis) of an event: sale-relative steps need the sale's day, event-relative ones the event's."""
    step = lambda name, due, basis: F.struct(F.lit(name).alias("milestone"), due.alias("due"), basis.alias("basis"))
    none, on = F.lit(None).cast("date"), onsale.isNotNull()
    out = [step("DISCOVERED", F.date_add(start, -100), F.lit("first_seen")), step("ANNOUNCEMENT", none, F.lit("observed_live")), step("PRESALE", none, F.lit("observed_live")), step("ONSALE", onsale, F.when(on, "onsale_date").otherwise("observed_live"))]
    out += [step(f"D+{k}", F.date_add(onsale, k), F.when(on, "onsale+offset").otherwise("onsale_unknown")) for k in (1, 3, 7, 14)]
    out.append(step("WEEKLY", none, F.lit("recurring_weekly")))
    known = F.when(start.isNotNull(), "event-relative").otherwise("event_unknown")
    out += [step(f"T-{k}", F.date_add(start, -k), known) for k in (30, 14, 7, 3, 1)]
    out += [step("SHOW", start, F.when(start.isNotNull(), "event").otherwise("event_unknown")), step("SETTLEMENT", F.date_add(start, 30), F.when(start.isNotNull(), "assumption").otherwise("event_unknown"))]
    return F.array(*out)


def milestones(spark: SparkSession, d: str) -> DataFrame:
    """The ladder of each engagement, summed up by milestone and basis; days without an anchor stay unknown."""
    e = engagements(spark, d)
    onsale = F.when(F.col("id") % 2 == 0, F.date_add("start_date", -60))
    rows = e.select("id", F.explode(_ladder(F.col("start_date"), onsale)).alias("m")).select("id", "m.*")
    return rows.groupBy("milestone", "basis").agg(F.count("*").alias("n"), F.count("due").alias("dated"), F.min("due").alias("first_due"), F.max("due").alias("last_due"))


def _step(name: str, due: str, basis: str) -> str:
    return f"SELECT '{name}' AS milestone, {due} AS due, {basis} AS basis FROM e"


MILESTONES = ENG + ", e AS (SELECT id, start_date AS s, CASE WHEN id % 2 = 0 THEN start_date - 60 END AS o FROM eng), m AS (" + " UNION ALL ".join([
    _step("DISCOVERED", "s - 100", "'first_seen'"), _step("ANNOUNCEMENT", "NULL::date", "'observed_live'"), _step("PRESALE", "NULL::date", "'observed_live'"), _step("ONSALE", "o", "CASE WHEN o IS NULL THEN 'observed_live' ELSE 'onsale_date' END"),
    *(_step(f"D+{k}", f"o + {k}", "CASE WHEN o IS NULL THEN 'onsale_unknown' ELSE 'onsale+offset' END") for k in (1, 3, 7, 14)), _step("WEEKLY", "NULL::date", "'recurring_weekly'"),
    *(_step(f"T-{k}", f"s - {k}", "CASE WHEN s IS NULL THEN 'event_unknown' ELSE 'event-relative' END") for k in (30, 14, 7, 3, 1)), _step("SHOW", "s", "CASE WHEN s IS NULL THEN 'event_unknown' ELSE 'event' END"), _step("SETTLEMENT", "s + 30", "CASE WHEN s IS NULL THEN 'event_unknown' ELSE 'assumption' END"),
]) + ") SELECT milestone, basis, count(*) AS n, count(due) AS dated, min(due) AS first_due, max(due) AS last_due FROM m GROUP BY ALL"


def observation_milestones(spark: SparkSession, d: str) -> DataFrame:
    """Ship days as observations of an event that starts 20 days after its order and goes on sale 15 days before that where known."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("seen"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_add("o_orderdate", 20).alias("event"), F.when(F.col("o_orderkey") % 2 == 0, F.date_add("o_orderdate", 5)).alias("onsale"))
    r = lines.join(o, "l_orderkey")
    since, to = F.datediff("seen", "onsale"), F.datediff("event", "seen")
    ladder = F.when((since >= 0) & (since < 14), F.when(since <= 0, "ONSALE").otherwise(F.concat(F.lit("D+"), since.cast("string")))).when(to <= -30, "SETTLEMENT").when(to <= 0, "SHOW")
    for k in (30, 14, 7, 3, 1):
        ladder = ladder.when(to >= k, f"T-{k}")
    return r.groupBy(ladder.otherwise("WEEKLY").alias("milestone")).agg(F.count("*").alias("n"))


OBSERVATION_MILESTONES = """
WITH r AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN date_diff('day', o_orderdate::date + 5, l_shipdate::date) END AS since, date_diff('day', l_shipdate::date, o_orderdate::date + 20) AS left_ FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT CASE WHEN since = 0 THEN 'ONSALE' WHEN since BETWEEN 1 AND 13 THEN 'D+' || since WHEN left_ <= -30 THEN 'SETTLEMENT' WHEN left_ <= 0 THEN 'SHOW' WHEN left_ >= 30 THEN 'T-30' WHEN left_ >= 14 THEN 'T-14' WHEN left_ >= 7 THEN 'T-7' WHEN left_ >= 3 THEN 'T-3' WHEN left_ >= 1 THEN 'T-1' ELSE 'WEEKLY' END AS milestone, count(*) AS n FROM r GROUP BY 1
"""

#: Evidence classes by what validation mode may use them, from the strictest.
STRICT, BOUND, ESTIMATED = ("OBSERVED_EXACT", "OBSERVED_DAY"), ("ARCHIVE_CAPTURE_UPPER_BOUND", "SOURCE_PERIOD_BOUND"), ("ESTIMATED_RESEARCH_ONLY",)
CLASSES = (*STRICT, *BOUND, *ESTIMATED, "UNKNOWN")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of each engagement's result: its class and when it counts as known (a day's evidence at the day's end)."""
    e = engagements(spark, d)
    kind = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("id") % len(CLASSES) + 1).cast("int"))
    known = F.when(kind == CLASSES[0], F.col("pub_date").cast("timestamp")).when(kind == CLASSES[1], end_of_day(F.col("pub_date"))).when(kind.isin(*BOUND), F.date_add("pub_date", 30).cast("timestamp"))
    return e.select("*", kind.alias("class"), known.alias("known_at"))


_evidence_sql = ENG + f", ev AS (SELECT *, {list(CLASSES)}[id % 6 + 1] AS class, CASE id % 6 WHEN 0 THEN pub_date::timestamp WHEN 1 THEN pub_date::timestamp + INTERVAL '86399 seconds' WHEN 2 THEN (pub_date + 30)::timestamp WHEN 3 THEN (pub_date + 30)::timestamp END AS known_at FROM eng)"


def evidence_modes(spark: SparkSession, d: str) -> DataFrame:
    """Evidence by class, what modes it may enter, and how much of it bears a day-granular time."""
    g = _evidence(spark, d).groupBy("class").agg(F.count("*").alias("n"), F.count("known_at").alias("known"), F.count_if(F.col("known_at") == F.date_trunc("day", "known_at")).alias("day_granular"))
    return g.withColumn("strict", F.col("class").isin(*STRICT)).withColumn("bound", F.col("class").isin(*STRICT, *BOUND)).withColumn("estimated", F.col("class") != "UNKNOWN")


EVIDENCE_MODES = _evidence_sql + f" SELECT class, count(*) AS n, count(known_at) AS known, count(*) FILTER (known_at = date_trunc('day', known_at)) AS day_granular, class IN {STRICT} AS strict, class IN {(*STRICT, *BOUND)} AS bound, class <> 'UNKNOWN' AS estimated FROM ev GROUP BY class"


def prior_distribution_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Per cutoff and mode: targets by how many results of their entity were knowable before the cutoff; unknown cutoffs apart."""
    ev = _evidence(spark, d).where("start_date IS NOT NULL AND headcount IS NOT NULL")
    out = None
    for mode, classes in (("STRICT", STRICT), ("CONSERVATIVE", (*STRICT, *BOUND))):
        for cutoff, back in (("EVENT_DATE", 0), ("ANNOUNCEMENT", 45)):
            t = ev.withColumn("cutoff", F.when(F.lit(cutoff == "EVENT_DATE") | (F.col("id") % 3 == 0), F.date_add("start_date", -back)))
            # known before the cutoff's day starts, and started before the target does
            usable = F.greatest(F.to_date("known_at"), F.date_add("start_date", -back))
            known = ev.where(F.col("class").isin(*classes) & F.col("known_at").isNotNull()).select("entity", "start_date", "id", usable.alias("pub_date"), F.col("headcount").alias("value"))
            n = pit.prior_totals(t.select("id", "entity", F.col("cutoff").alias("start_date")), known, ["entity"])
            has = F.col("start_date").isNotNull()
            c = F.when(has, F.col("prior_count"))
            one = n.agg(F.lit(mode).alias("mode"), F.lit(cutoff).alias("cutoff"), F.count("*").alias("targets"), F.count_if(has).alias("known_cutoff"), F.count_if(~has).alias("unknown_cutoff"), F.count_if(c == 0).alias("zero"), F.count_if(c == 1).alias("one"), F.count_if(c == 2).alias("two"), F.count_if(c >= 3).alias("three_up"), F.count_if(c >= 5).alias("five_up"))
            out = one if out is None else out.unionByName(one)
    return out


PRIOR_DISTRIBUTION_BUCKETS = _evidence_sql + ", t AS (SELECT * FROM ev WHERE start_date IS NOT NULL AND headcount IS NOT NULL) " + " UNION ALL ".join(
    f"""SELECT '{mode}' AS mode, '{cutoff}' AS cutoff, count(*) AS targets, count(c) AS known_cutoff, count(*) - count(c) AS unknown_cutoff, count(*) FILTER (n = 0) AS zero, count(*) FILTER (n = 1) AS one, count(*) FILTER (n = 2) AS two, count(*) FILTER (n >= 3) AS three_up, count(*) FILTER (n >= 5) AS five_up
FROM (SELECT t.id, any_value({c}) AS c, CASE WHEN any_value({c}) IS NOT NULL THEN count(h.id) END AS n FROM t LEFT JOIN t h ON h.entity = t.entity AND h.class IN {classes} AND h.known_at < ({c})::timestamp AND h.start_date < t.start_date GROUP BY t.id)"""
    for mode, classes in (("STRICT", STRICT), ("CONSERVATIVE", (*STRICT, *BOUND)))
    for cutoff, c in (("EVENT_DATE", "t.start_date"), ("ANNOUNCEMENT", "CASE WHEN t.id % 3 = 0 THEN t.start_date - 45 END"))
)


def decision_time_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Distinct events under different conditions on their evidence, and reconstructable ones per mode."""
    ev = _evidence(spark, d).withColumn("key", V.event_key(F.col("entity"), F.col("place"), F.col("start_date")))
    n = lambda c: F.count_distinct(F.when(c, F.col("key")))
    strict, bound = F.col("class").isin(*STRICT), F.col("class").isin(*STRICT, *BOUND)
    known = known_by(F.col("known_at"), F.col("start_date").cast("timestamp"), F.lit("1998-01-01").cast("timestamp"))
    wide = ev.agg(n(F.col("key").startswith("boxoffice_")).alias("events"), n(strict).alias("strict"), n(bound).alias("bound"), n(strict & known).alias("strict_known"), n(F.col("class") == "UNKNOWN").alias("unknown"), n(F.col("shows") == 1).alias("single_show"), n((F.col("shows") == 1) & bound & F.col("known_at").isNotNull()).alias("reconstructable"))
    return wide.unpivot([], wide.columns, "measure", "events").select("measure", "events")


DECISION_TIME_COVERAGE = _evidence_sql + f""", k AS (SELECT *, 'boxoffice_' || coalesce(entity::varchar, '') || '_' || coalesce(place::varchar, '') || '_' || coalesce(start_date::varchar, '') AS key, class IN {STRICT} AS s, class IN {(*STRICT, *BOUND)} AS b FROM ev),
w AS (SELECT count(DISTINCT key) AS events, count(DISTINCT key) FILTER (s) AS strict, count(DISTINCT key) FILTER (b) AS bound, count(DISTINCT key) FILTER (s AND coalesce(known_at, start_date::timestamp) <= '1998-01-01') AS strict_known, count(DISTINCT key) FILTER (class = 'UNKNOWN') AS unknown,
        count(DISTINCT key) FILTER (shows = 1) AS single_show, count(DISTINCT key) FILTER (shows = 1 AND b AND known_at IS NOT NULL) AS reconstructable FROM k)
FROM w UNPIVOT (events_ FOR measure IN (events, strict, bound, strict_known, unknown, single_show, reconstructable)) SELECT measure, events_ AS events"""


def page_meta(spark: SparkSession, d: str) -> DataFrame:
    """Of each page's HTML: language, title, charset, links, headings, and its address without secrets."""
    h = F.col("html")
    first = lambda p: F.nullif(F.regexp_extract(h, p, 1), F.lit(""))
    n = lambda p: F.regexp_count(h, F.lit(p)).cast("long")
    return table(spark, d, "pages").select("page_id", first(r'<html lang="([^"]*)"').alias("lang"), first(r"(?s)<title>(.*?)</title>").alias("title"), first(r'<meta charset="([^"]*)"').alias("charset"), n("<a href=").alias("links"), n("<h[1-6]>").alias("headings"), V.without_secrets(F.concat("url", F.lit("?a=1&api_key=abc&Token=x#f"))).alias("address"))


PAGE_META = r"""
SELECT page_id, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title, nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset,
  len(regexp_extract_all(html, '<a href=')) AS links, len(regexp_extract_all(html, '<h[1-6]>')) AS headings, regexp_replace(url || '?a=1&api_key=abc&Token=x#f', '(?i)([?&](?:key|access_token|token|api_key|apikey|client_id|client_secret)=)[^&#]*', '\1***', 'g') AS address FROM pages
"""


def json_values(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events as JSON: the typed value, a path that isn't there, bad JSON kept as text, and keys in order as a digest."""
    s = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{bad"), "props")).otherwise(F.col("props")).alias("raw"))
    v = F.try_parse_json("raw")
    kept = F.when(v.isNull(), F.col("raw"))
    sorted_keys = F.array_join(F.transform(F.array_sort(F.map_entries(F.from_json("raw", "map<string,string>"))), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return s.select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"), kept.alias("text"), F.sha2(F.when(v.isNotNull(), sorted_keys), 256).alias("content_hash"))


JSON_VALUES = """
WITH r AS (SELECT event_id, event_id % 9 = 0 AS bad, props FROM events)
SELECT event_id, CASE WHEN NOT bad THEN json_extract_string(props, '$.k')::int END AS k, NULL::varchar AS missing, CASE WHEN bad THEN '{bad' || props END AS text, CASE WHEN NOT bad THEN sha256('k=' || json_extract_string(props, '$.k')) END AS content_hash FROM r
"""


def json_attractions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as events with their parts as a JSON array of objects: exploded, one row per part with first and last day and name."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey")
    docs = lines.groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("id"), F.col("p_name").alias("name"))))).alias("attractions"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("day"))
    rows = docs.join(o, "l_orderkey").select("day", F.explode(F.from_json("attractions", "array<struct<n:int,id:long,name:string>>")).alias("a"), F.lower("attractions").contains("ring").alias("ring"))
    return rows.groupBy(F.coalesce(F.concat(F.lit("id:"), F.col("a.id").cast("string")), F.concat(F.lit("name:"), F.col("a.name"))).alias("key")).agg(F.count("*").alias("n"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.min("a.name").alias("name"), F.count_if("ring").alias("with_ring"))


JSON_ATTRACTIONS = """
WITH l AS (SELECT l_orderkey, l_partkey, p_name, o_orderdate::date AS day FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT l_orderkey, bool_or(contains(lower(p_name), 'ring')) AS ring FROM l GROUP BY 1)
SELECT 'id:' || l_partkey AS key, count(*) AS n, min(day) AS first_seen, max(day) AS last_seen, min(p_name) AS name, count(*) FILTER (ring) AS with_ring FROM l JOIN r USING (l_orderkey) GROUP BY 1
"""


def presale_changes(spark: SparkSession, d: str) -> DataFrame:
    """Sets of a key's statuses per day as JSON arrays: what a day has that the day before had not, and the reverse."""
    from pyspark.sql import Window

    days = snapshots(spark, d).groupBy("key", F.to_date("seen_at").alias("day")).agg(F.to_json(F.array_sort(F.collect_set("status"))).alias("now"))
    now, old = F.from_json("now", "array<string>"), F.from_json("old", "array<string>")
    rows = days.withColumn("old", F.lag("now").over(Window.partitionBy("key").orderBy("day"))).where("old IS NOT NULL")
    return rows.select("key", "day", F.array_join(F.array_except(now, old), ",").alias("added"), F.array_join(F.array_except(old, now), ",").alias("removed"), F.size(F.array_union(now, old)).cast("long").alias("either"))


PRESALE_CHANGES = SNAP + """,
x AS (SELECT key, seen_at::date AS day, list_sort(list(DISTINCT status)) AS now FROM snap GROUP BY ALL), l AS (SELECT *, lag(now) OVER (PARTITION BY key ORDER BY day) AS old FROM x)
SELECT key, day, array_to_string(list_filter(now, lambda s: NOT list_contains(old, s)), ',') AS added, array_to_string(list_filter(old, lambda s: NOT list_contains(now, s)), ',') AS removed, len(list_distinct(list_concat(now, old))) AS either FROM l WHERE old IS NOT NULL
"""

QUERIES = {name.lower(): (globals()[name.lower()], globals()[name]) for name in list(globals()) if name.isupper() and name.lower() in globals()}
