"""Queries behind the product's views: related entities, verified claims, page-view series, news and festival rows of the tape, partner files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitengine.functions import intents
from pitengine.operators import verify
from pitengine.sources import delimited
from pitengine.sources.tables import table


def related_entities(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each event (order) from its latest snapshot that names performers: itself, matched performers in their order (the first is
    the primary one), place, market and promoter; nothing is guessed."""
    lines = table(spark, d, "lineitem")
    # a snapshot per return flag; those of flag A name no performers
    acts = F.when(F.col("l_returnflag") != "A", F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey")))).alias("acts")
    snaps = lines.groupBy("l_orderkey", "l_returnflag").agg(acts.alias("acts"), F.max("l_shipdate").alias("seen"))
    latest = snaps.groupBy("l_orderkey").agg(F.max(F.struct(F.col("acts").isNotNull().alias("named"), "seen", "l_returnflag", "acts")).alias("s"))
    ledger = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.when((F.col("s_suppkey") + v) % 4 != 0, "MATCHED").otherwise("REJECTED").alias("status"), F.concat(F.lit("artist"), F.col("s_suppkey") * 10 + v).alias("artist")) for v in (1, 2)))).alias("r"))
    matched = ledger.where("r.status = 'MATCHED'").groupBy("s_suppkey").agg(F.max(F.struct("r.version", "r.artist"))["artist"].alias("artist"))
    each = latest.select("l_orderkey", F.posexplode("s.acts").alias("at", "a")).join(matched, F.col("a.l_suppkey") == F.col("s_suppkey"))
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("at"))
    artists = each.select("l_orderkey", F.col("artist").alias("entity"), F.when(order == 1, "EVENT_PRIMARY_ARTIST").otherwise("EVENT_ARTIST").alias("relation"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    edge = lambda entity, relation: F.struct(entity.alias("entity"), F.lit(relation).alias("relation"))
    edges = F.array(
        edge(F.concat(F.lit("event::"), "o_orderkey"), "EVENT_SELF"), edge(F.concat(F.lit("venue::"), "c_custkey"), "EVENT_VENUE"), edge(F.concat(F.lit("market::"), "c_nationkey"), "EVENT_MARKET"),
        edge(F.when(F.col("o_orderpriority") != "3-MEDIUM", F.concat(F.lit("promoter::"), "o_orderpriority")), "EVENT_PROMOTER"),
    )
    seen = o.join(latest.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return seen.select(F.col("o_orderkey").alias("event"), F.explode(edges).alias("e")).select("event", "e.*").where("entity IS NOT NULL").unionByName(artists.withColumnRenamed("l_orderkey", "event"))


RELATED_ENTITIES = """
WITH s AS (SELECT l_orderkey AS event, l_returnflag AS mode, CASE WHEN l_returnflag <> 'A' THEN list(l_suppkey ORDER BY l_linenumber, l_suppkey) END AS acts, max(l_shipdate) AS seen FROM lineitem GROUP BY l_orderkey, l_returnflag),
t AS (SELECT event, acts FROM s QUALIFY row_number() OVER (PARTITION BY event ORDER BY acts IS NOT NULL DESC, seen DESC, mode DESC) = 1),
l AS (SELECT s_suppkey, v, 'artist' || (s_suppkey * 10 + v) AS artist FROM supplier, (VALUES (1), (2)) x(v) WHERE (s_suppkey + v) % 4 <> 0), m AS (SELECT s_suppkey, arg_max(artist, v) AS artist FROM l GROUP BY 1),
a AS (SELECT event, at, artist, row_number() OVER (PARTITION BY event ORDER BY at) AS k FROM (SELECT event, unnest(acts) AS supp, unnest(range(len(acts))) AS at FROM t WHERE acts IS NOT NULL) JOIN m ON s_suppkey = supp),
o AS (SELECT orders.*, c_custkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey IN (SELECT event FROM t))
SELECT event, artist AS entity, CASE k WHEN 1 THEN 'EVENT_PRIMARY_ARTIST' ELSE 'EVENT_ARTIST' END AS relation FROM a UNION ALL SELECT o_orderkey, 'event::' || o_orderkey, 'EVENT_SELF' FROM o UNION ALL SELECT o_orderkey, 'venue::' || c_custkey, 'EVENT_VENUE' FROM o
UNION ALL SELECT o_orderkey, 'market::' || c_nationkey, 'EVENT_MARKET' FROM o UNION ALL SELECT o_orderkey, 'promoter::' || o_orderpriority, 'EVENT_PROMOTER' FROM o WHERE o_orderpriority <> '3-MEDIUM'
""".replace(" AS at", ' AS "at"').replace(" at, artist", ' "at", artist').replace("ORDER BY at)", 'ORDER BY "at")')


def verified_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Claims on sale and booking days with the first reason that rejects them; each of the twelve reasons and acceptance occur."""
    k = F.col("k")
    pick = lambda *values: F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, d, "orders").withColumn("k", F.floor(F.col("o_orderkey") / 4) + F.col("o_orderkey") % 4 * 7).select(
        F.col("o_orderkey").alias("claim"), F.when(k % 23 != 0, F.concat(F.lit("doc"), k)).alias("document"), F.when(k % 19 != 0, k % 100).alias("span_start"), (k % 100 + 5).alias("span_end"), (k % 17 == 0).alias("contradicted"),
        pick("GENERAL_ONSALE", "EVENT_DATE", "BOOKING_OR_OFFER", "PRESALE").alias("kind"), pick("OBSERVED_DAY", "ARCHIVE_CAPTURE_UPPER_BOUND", "OBSERVED_EXACT", "UNKNOWN", "ESTIMATED_RESEARCH_ONLY", "OBSERVED_DAY", "OBSERVED_EXACT").alias("evidence_class"),
        F.when(k % 5 != 0, F.when(k % 3 == 0, F.concat(day, F.lit("T10:00:00"), F.when(k % 2 == 0, "Z").otherwise(""))).otherwise(day)).alias("value"), F.when(k % 13 == 0, day).alias("lower_bound"), F.when(k % 13 == 0, day).alias("upper_bound"),
        pick("DAY", "EXACT", "DAY", "EXACT", "MONTH", "YEAR", "EXACT", "DAY", "DAY").alias("granularity"), F.when(k % 2 == 0, "from contract_date").alias("interpretation"), pick("RESEARCH_ONLY", "TERMS_REVIEW_REQUIRED", "NONE", "OPEN_COMMERCIAL_OK", None).alias("rights"),
    )
    return verify.verified(rows).select("claim", "status", "reason")


VERIFIED_CANDIDATES = """
WITH o AS (SELECT o_orderkey AS claim, o_orderkey // 4 + o_orderkey % 4 * 7 AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
c AS (SELECT *, ['GENERAL_ONSALE', 'EVENT_DATE', 'BOOKING_OR_OFFER', 'PRESALE'][k % 4 + 1] AS kind, ['DAY', 'ARCHIVE', 'EXACT', 'UNKNOWN', 'ESTIMATED', 'DAY', 'EXACT'][k % 7 + 1] AS class, k % 5 <> 0 AS has, k % 13 = 0 AS bounds, ['DAY', 'EXACT', 'DAY', 'EXACT', 'MONTH', 'YEAR', 'EXACT', 'DAY', 'DAY'][k % 9 + 1] AS gran FROM o),
r AS (SELECT claim, CASE WHEN k % 23 = 0 THEN 'claim_without_source_document' WHEN k % 19 = 0 THEN 'claim_without_evidence_span' WHEN k % 17 = 0 THEN 'wrong_artist_venue_city_or_date' WHEN class = 'ESTIMATED' THEN 'estimated_research_only_never_admissible'
  WHEN class = 'UNKNOWN' THEN 'unknown_never_admissible' WHEN class = 'ARCHIVE' AND has AND kind <> 'BOOKING_OR_OFFER' AND NOT bounds THEN 'archive_upper_bound_must_set_upper_bound_not_exact' WHEN kind = 'BOOKING_OR_OFFER' AND class IN ('DAY', 'EXACT') AND k % 2 = 1 THEN 'announcement_interpreted_as_booking_exact'
  WHEN kind IN ('GENERAL_ONSALE', 'PRESALE') AND NOT has AND NOT bounds THEN 'relative_date_without_anchor' WHEN bounds AND has AND k % 3 <> 0 THEN 'interval_collapsed_to_midpoint' WHEN gran = 'YEAR' THEN 'unsupported_granularity'
  WHEN gran = 'EXACT' AND has AND k % 3 = 0 AND k % 2 = 1 THEN 'unsupported_timezone_precision' WHEN k % 5 IN (2, 4) THEN 'source_rights_failure' END AS reason FROM c)
SELECT claim, CASE WHEN reason IS NULL THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, reason FROM r
"""


def pageview_series(spark: SparkSession, d: str) -> DataFrame:
    """Daily views per key out of raw responses (JSON with items; errors have none): sum of seven days, its change, the change of that, and the
    z-score against the four weeks before. Missing days count as not observed, not as zero."""
    e = table(spark, d, "events").select((F.col("user_id") % 40).alias("key"), F.to_date("ts").alias("day"), F.col("value").alias("v"), "event_id")
    item = F.to_json(F.struct(F.concat(F.date_format("day", "yyyyMMdd"), F.lit("00")).alias("timestamp"), F.floor(F.col("v") * 10).alias("views")))
    raw = F.when(F.col("event_id") % 31 == 0, '{"detail": "not found"}').otherwise(F.concat(F.lit('{"items": ['), item, F.lit("]}")))
    parsed = e.select("key", F.from_json(raw, "items array<struct<timestamp: string, views: long>>").alias("r"))
    items = parsed.select("key", F.explode("r.items").alias("i")).select("key", F.to_date(F.substring("i.timestamp", 1, 8), "yyyyMMdd").alias("day"), F.col("i.views").alias("views"))
    daily = items.groupBy("key", "day").agg(F.sum("views").alias("views")).withColumn("n", F.unix_date("day"))
    own = Window.partitionBy("key").orderBy("n")
    week, before = own.rangeBetween(-6, 0), own.rangeBetween(-28, -1)
    rows = daily.withColumn("week", F.sum("views").over(week)).withColumn("known_days", F.count("*").over(week)).withColumn("mean", F.avg("views").over(before)).withColumn("spread", F.stddev_pop("views").over(before)).withColumn("past", F.count("*").over(before))
    rows = rows.withColumn("velocity", F.col("week") - F.lag("week").over(own)).withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(own))
    z = F.when((F.col("past") >= 7) & (F.col("spread") > 0), (F.col("views") - F.col("mean")) / F.col("spread"))
    return rows.select("key", "day", "views", "week", "known_days", "velocity", "acceleration", F.round(z, 4).alias("z"))


PAGEVIEW_SERIES = """
WITH d AS (SELECT user_id % 40 AS key, ts::date AS day, sum(floor(value * 10)::bigint)::bigint AS views FROM events WHERE event_id % 31 <> 0 GROUP BY ALL),
w AS (SELECT *, (sum(views) OVER (PARTITION BY key ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))::bigint AS week, count(*) OVER (PARTITION BY key ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS known_days,
  avg(views) OVER b AS mean, stddev_pop(views) OVER b AS spread, count(*) OVER b AS past FROM d WINDOW b AS (PARTITION BY key ORDER BY day RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)),
v AS (SELECT *, week - lag(week) OVER (PARTITION BY key ORDER BY day) AS velocity FROM w)
SELECT key, day, views, week, known_days, velocity, velocity - lag(velocity) OVER (PARTITION BY key ORDER BY day) AS acceleration, CASE WHEN past >= 7 AND spread > 0 THEN round((views - mean) / spread, 4) END AS z FROM v
"""

#: Kinds of entities that the tape knows.
ENTITY_KINDS = ("ARTIST", "EVENT", "VENUE", "FESTIVAL")


def news_tape(spark: SparkSession, d: str) -> DataFrame:
    """Tape rows of mentions (pages) and of festival listings (parts): when it was so, when it was seen, and a key that makes rows come once.

    A mention's publication is when it was so; what was known first of knowledge, retrieval and publication is when it was seen, and a mention
    without any of them has no row. A listing is seen when it is retrieved and is so from its edition's first day on.
    """
    p, k = table(spark, d, "pages"), F.col("page_id")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (k % n).cast("int"))
    published, retrieved, known = F.when(k % 3 != 0, day(50)), F.when(k % 4 != 0, day(70)), F.when(k % 5 == 0, day(90))
    raw_kind = F.element_at(F.array(*map(F.lit, ("ARTIST", "VENUE", "PERSON"))), (k % 3 + 1).cast("int"))
    mentions = p.select(F.lit("NEWS_MENTION").alias("activity"), F.when(raw_kind.isin(*ENTITY_KINDS), raw_kind).otherwise("ARTIST").alias("entity_kind"), F.concat(F.lit("m"), k % 200).alias("record"), published.alias("effective"), F.coalesce(known, retrieved, published).alias("observed"))
    q, n = table(spark, d, "part"), F.col("p_partkey")
    listed = q.select(F.lit("FESTIVAL_LISTED").alias("activity"), F.lit("FESTIVAL").alias("entity_kind"), F.concat("p_brand", F.lit("/"), "p_size").alias("record"), F.make_date(F.lit(2020) + F.col("p_size").cast("int") % 5, F.lit(6), F.lit(1)).alias("effective"), F.date_add(F.lit("2023-01-01").cast("date"), (n % 300).cast("int")).alias("observed"))
    rows = mentions.unionByName(listed).where("observed IS NOT NULL")
    key = F.substring(F.sha2(F.concat_ws("|", "activity", "entity_kind", "record", F.coalesce(F.col("effective").cast("string"), F.lit(""))), 256), 1, 32)
    return rows.withColumn("dedupe_key", key).groupBy("dedupe_key", "activity", "entity_kind", "record", "effective").agg(F.min("observed").alias("observed"), F.count("*").alias("seen"))


NEWS_TAPE = """
WITH m AS (SELECT page_id AS k, DATE '2024-01-01' AS z, ['ARTIST', 'VENUE', 'ARTIST'][page_id % 3 + 1] AS entity_kind FROM pages),
r AS (SELECT 'NEWS_MENTION' AS activity, entity_kind, 'm' || k % 200 AS record, CASE WHEN k % 3 <> 0 THEN z + (k % 50)::int END AS effective, CASE WHEN k % 5 = 0 THEN z + (k % 90)::int WHEN k % 4 <> 0 THEN z + (k % 70)::int WHEN k % 3 <> 0 THEN z + (k % 50)::int END AS observed FROM m
  UNION ALL SELECT 'FESTIVAL_LISTED', 'FESTIVAL', p_brand || '/' || p_size, make_date(2020 + p_size % 5, 6, 1), DATE '2023-01-01' + (p_partkey % 300)::int FROM part)
SELECT sha256(activity || '|' || entity_kind || '|' || record || '|' || coalesce(effective::varchar, ''))[1:32] AS dedupe_key, activity, entity_kind, record, effective, min(observed) AS observed, count(*) AS seen FROM r WHERE observed IS NOT NULL GROUP BY ALL
"""

PARTNER_FIELDS = {"customer_key": ("cust_id",), "ticket_gross_total": ("gross",), "tour_name": ("tour",), "capacity": ("seats",)}


def partner_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of three delimiters and three sets of headers, one per market, read by what their own lines say."""
    c, n = table(spark, d, "customer"), F.col("c_nationkey")
    delimiter = F.element_at(F.array(*map(F.lit, (",", "\t", ";"))), (n % 3 + 1).cast("int"))
    headers = F.element_at(F.array(*(F.array(*map(F.lit, h)) for h in (("Customer Key", "Gross", "Tour Name", "note"), ("cust id", "ticket gross totl", "tour", "x"), ("Customer-Key", "GROSS ", "Tour_Nme", "y")))), (n % 3 + 1).cast("int"))
    text = F.concat("c_custkey", delimiter, F.format_string("%.2f", "c_acctbal"), delimiter, "c_mktsegment", delimiter, F.lit("a b"))
    body = c.select(n.alias("file"), (F.col("c_custkey") + 1).alias("line"), text.alias("text"))
    head = c.select(n.alias("file"), delimiter.alias("dl"), headers.alias("h")).distinct().select("file", F.lit(0).cast("long").alias("line"), F.concat(F.get("h", F.lit(0)), *(x for k in (1, 2, 3) for x in ("dl", F.get("h", F.lit(k))))).alias("text"))
    return delimited.table_rows(head.unionByName(body), PARTNER_FIELDS).select(F.col("file").cast("long").alias("file"), "line", "customer_key", F.col("ticket_gross_total").try_cast("double").alias("gross"), "tour_name", "capacity")


PARTNER_FILES = "SELECT c_nationkey::bigint AS file, c_custkey + 1 AS line, c_custkey::varchar AS customer_key, round(c_acctbal, 2) AS gross, c_mktsegment AS tour_name, NULL AS capacity FROM customer"

#: What turns say in turn, beside their own text.
PHRASES = ("bought a ticket, who's going?", "how much are the tickets", "too expensive, overpriced even", "you should see them", "can't wait to hear this", "on sale at face value", "worth it, highly recommend", "just words", "presale fomo")


def all_intents(spark: SparkSession, d: str) -> DataFrame:
    """Each intent of each conversation turn, with the number of patterns that fit and the first of them; shares by role and intent."""
    turns = table(spark, d, "conversations")
    said = F.element_at(F.array(*map(F.lit, PHRASES)), ((F.col("conv_id") + F.col("turn")) % len(PHRASES) + 1).cast("int"))
    rows = turns.select("role", F.explode(intents.intents(F.concat_ws(" ", "text", said))).alias("i"))
    hit = F.col("i.label") != "no_signal"
    return rows.groupBy("role", F.col("i.task").alias("task")).agg(F.count("*").alias("turns"), F.count_if(hit).alias("hits"), F.sum(F.size("i.hits")).alias("patterns"), F.min(F.get("i.hits", F.lit(0))).alias("first"))


_said = "concat_ws(' ', text, [" + ", ".join("'" + x.replace("'", "''") + "'" for x in PHRASES) + f"][(conv_id + turn) % {len(PHRASES)} + 1])"
_fit = lambda p: "regexp_matches(said, '" + p.replace("'", "''") + "')"
ALL_INTENTS = f"WITH t AS (SELECT role, lower({_said}) AS said FROM conversations) " + " UNION ALL ".join(
    f"SELECT role, '{task}' AS task, count(*) AS turns, count(*) FILTER ({' OR '.join(map(_fit, ps))}) AS hits, sum({' + '.join(_fit(p) + '::int' for p in ps)})::bigint AS patterns, "
    f"min(CASE {' '.join(f'WHEN {_fit(p)} THEN {k}' for k, p in enumerate(ps))} END)::int AS first FROM t GROUP BY role"
    for task, ps in intents.INTENTS.items()
)


def candidate_states(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers held against customers by the digits of their names: resolved from 0.9 up unless the next is within 0.08, else ambiguous;
    unresolved below, no match without candidates. Every state occurs."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    k = F.col("s_suppkey")
    # how far apart the digits may be, and what such a candidate scores
    probe = lambda off, score: F.struct((F.substring("s_name", -9, 9).cast("long") + off).alias("digits"), F.lit(score).alias("score"))
    probes = F.array_compact(F.array(F.when((k % 5 != 0) & (k % 7 != 0), probe(0, 1.0)), F.when((k % 3 == 0) & (k % 7 != 0), probe(1, 0.96)), F.when((k % 3 == 1) & (k % 7 != 0), probe(2, 0.75)), F.when((k % 5 == 0) & (k % 7 != 0), probe(3, 0.6))))
    digits = c.select("c_custkey", F.substring("c_name", -9, 9).cast("long").alias("digits"))
    pairs = s.select("s_suppkey", F.explode(probes).alias("p")).select("s_suppkey", "p.*").join(digits, "digits")
    best = F.row_number().over(Window.partitionBy("s_suppkey").orderBy(F.desc("score"), "c_custkey"))
    two = pairs.withColumn("place", best).groupBy("s_suppkey").agg(F.count("*").alias("candidates"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("place") == 1, F.col("c_custkey"))).alias("first"))
    sure, clear = F.col("score") >= 0.9, F.col("score") - F.coalesce("second", F.lit(0.0)) >= 0.08
    state = F.when(F.col("score").isNull(), "NO_MATCH").when(sure & clear, "RESOLVED").when(sure, "AMBIGUOUS").otherwise("UNRESOLVED")
    return s.select("s_suppkey").join(two, "s_suppkey", "left").select("s_suppkey", F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"), "score", "second", state.alias("state"), F.when(state == "RESOLVED", F.col("first")).alias("match"))


CANDIDATE_STATES = """
WITH p(off, score) AS (VALUES (0, 1.0::double), (1, 0.96::double), (2, 0.75::double), (3, 0.6::double)),
c AS (SELECT s_suppkey, c_custkey, score FROM supplier JOIN p ON s_suppkey % 7 <> 0 AND CASE off WHEN 0 THEN s_suppkey % 5 <> 0 WHEN 1 THEN s_suppkey % 3 = 0 WHEN 2 THEN s_suppkey % 3 = 1 ELSE s_suppkey % 5 = 0 END JOIN customer ON c_name[-9:]::bigint = s_name[-9:]::bigint + off),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) AS k FROM c),
b AS (SELECT s_suppkey, count(*) AS candidates, max(score) FILTER (k = 1) AS score, max(score) FILTER (k = 2) AS second, max(c_custkey) FILTER (k = 1) AS first FROM r GROUP BY 1),
t AS (SELECT s.s_suppkey, coalesce(candidates, 0) AS candidates, score, second, first, CASE WHEN score IS NULL THEN 'NO_MATCH' WHEN score >= 0.9 AND score - coalesce(second, 0) >= 0.08 THEN 'RESOLVED' WHEN score >= 0.9 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS state FROM supplier s LEFT JOIN b USING (s_suppkey))
SELECT s_suppkey, candidates, score, second, state, CASE WHEN state = 'RESOLVED' THEN first END AS match FROM t
"""

QUERIES = {name.lower(): (globals()[name.lower()], globals()[name]) for name in list(globals()) if name.isupper() and name.lower() in globals()}
