"""Read models: events, places, markets, tours, attention, sources and news, with their orders, fallbacks and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitengine.sources.tables import ENGAGEMENTS_SQL as ENG
from pitengine.sources.tables import SNAPSHOTS_SQL as SNAP
from pitengine.sources.tables import engagements, snapshots, table


def event_card(spark: SparkSession, d: str) -> DataFrame:
    """An event from the first source that has it: forward watch, else the latest provider snapshot, else history."""
    e = engagements(spark, d)
    watch = e.where("start_date >= '1998-01-01'").select(F.col("id").alias("event"), F.lit(1).alias("priority"), F.lit("WATCH").alias("source"), F.col("status").alias("state"))
    s = snapshots(spark, d)
    last = s.groupBy("key").agg(F.max(F.struct("seen_at", "seq", "status")).alias("r")).select(F.col("key").alias("event"), F.lit(2).alias("priority"), F.lit("SNAPSHOT").alias("source"), F.col("r.status").alias("state"))
    history = e.where("start_date < '1998-01-01'").select(F.col("id").alias("event"), F.lit(3).alias("priority"), F.lit("HISTORY").alias("source"), F.col("status").alias("state"))
    rows = watch.unionByName(last).unionByName(history)
    return rows.groupBy("event").agg(F.min(F.struct("priority", "source", "state")).alias("r"), F.count("*").alias("sources")).select("event", "r.source", "r.state", "sources")


EVENT_CARD = ENG + """,
snap AS (SELECT user_id AS event, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id),
r AS (SELECT id AS event, 1 AS priority, 'WATCH' AS source, status AS state FROM eng WHERE start_date >= '1998-01-01' UNION ALL SELECT event, 2, 'SNAPSHOT', state FROM snap UNION ALL SELECT id, 3, 'HISTORY', status FROM eng WHERE start_date < '1998-01-01')
SELECT event, arg_min(source, priority) AS source, arg_min(state, priority) AS state, count(*) AS sources FROM r GROUP BY event
"""


def place_card(spark: SparkSession, d: str) -> DataFrame:
    """Per place: history and upcoming, and its capacity claims side by side: how many, how many differ, least, most, latest."""
    e = engagements(spark, d).where("place IS NOT NULL")
    at = F.lit("1998-01-01").cast("date")
    card = e.groupBy("place").agg(F.count_if(F.col("start_date") < at).alias("history"), F.count_if(F.col("start_date") >= at).alias("upcoming"), F.count("headcount").alias("claims"), F.count_distinct("headcount").alias("different"), F.min("headcount").alias("least"), F.max("headcount").alias("most"), F.max_by("headcount", F.when(F.col("headcount").isNotNull(), F.struct("start_date", "id"))).alias("latest"))
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("place"), F.col("s_name").alias("name"))
    return sup.join(card, "place", "left").withColumn("state", F.when(F.col("different") > 1, "CONFLICTING").when(F.col("claims") > 0, "OBSERVED").otherwise("UNKNOWN"))


PLACE_CARD = ENG + """,
c AS (SELECT place, count(*) FILTER (start_date < '1998-01-01') AS history, count(*) FILTER (start_date >= '1998-01-01') AS upcoming, count(headcount) AS claims, count(DISTINCT headcount) AS different, min(headcount) AS least, max(headcount) AS most,
        arg_max(headcount, (start_date, id)) FILTER (headcount IS NOT NULL) AS latest FROM eng WHERE place IS NOT NULL GROUP BY place)
SELECT s_suppkey AS place, s_name AS name, history, upcoming, claims, different, least, most, latest, CASE WHEN different > 1 THEN 'CONFLICTING' WHEN claims > 0 THEN 'OBSERVED' ELSE 'UNKNOWN' END AS state FROM supplier LEFT JOIN c ON c.place = s_suppkey
"""


def market_card(spark: SparkSession, d: str) -> DataFrame:
    """Per market with its name: history, upcoming, places, and the region as context; markets without engagements stay."""
    e, at = engagements(spark, d), F.lit("1998-01-01").cast("date")
    g = e.groupBy("market").agg(F.count_if(F.col("start_date") < at).alias("history"), F.count_if(F.col("start_date") >= at).alias("upcoming"), F.count_distinct("place").alias("places"), F.max("start_date").alias("last_day"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("market"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r_regionkey"))
    # the condition on the region stays on the right side, so markets of other regions keep their row
    r = table(spark, d, "region").where("r_name <> 'ASIA'").select("r_regionkey", F.col("r_name").alias("context"))
    return n.join(g, "market", "left").join(r, "r_regionkey", "left").select("market", "name", "context", "history", "upcoming", "places", "last_day")


MARKET_CARD = ENG + """,
g AS (SELECT market, count(*) FILTER (start_date < '1998-01-01') AS history, count(*) FILTER (start_date >= '1998-01-01') AS upcoming, count(DISTINCT place) AS places, max(start_date) AS last_day FROM eng GROUP BY market)
SELECT n_nationkey AS market, n_name AS name, r_name AS context, history, upcoming, places, last_day FROM nation LEFT JOIN g ON g.market = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA'
"""


def tour_list(spark: SparkSession, d: str) -> DataFrame:
    """Tours (a series in a market and year) in which a place of the first market took part: events, entities, and the order by size."""
    e = engagements(spark, d).where("start_date IS NOT NULL").withColumn("year", F.year("start_date"))
    tours = e.groupBy("series", "market", "year").agg(F.count("*").alias("events"), F.count_distinct("entity").alias("performers"), F.count_distinct("place").alias("places"), F.min("start_date").alias("first_day"))
    there = e.join(table(spark, d, "supplier").where("s_nationkey = 0").select(F.col("s_suppkey").alias("place")), "place", "left_semi").select("series", "market", "year").distinct()
    order = Window.partitionBy("year").orderBy(F.desc("events"), "series", "market")
    return tours.join(there, ["series", "market", "year"], "left_semi").withColumn("position", F.row_number().over(order).cast("long"))


TOUR_LIST = ENG + """,
t AS (SELECT series, market, year(start_date) AS year, count(*) AS events, count(DISTINCT entity) AS performers, count(DISTINCT place) AS places, min(start_date) AS first_day FROM eng WHERE start_date IS NOT NULL GROUP BY ALL),
w AS (SELECT DISTINCT series, market, year(start_date) AS year FROM eng WHERE start_date IS NOT NULL AND place IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 0))
SELECT *, row_number() OVER (PARTITION BY year ORDER BY events DESC, series, market) AS position FROM t WHERE EXISTS (SELECT 1 FROM w WHERE w.series = t.series AND w.market = t.market AND w.year = t.year)
"""


def tour_card(spark: SparkSession, d: str) -> DataFrame:
    """Each stop of an entity with the one before it and the days between; stops without a day come last."""
    e = engagements(spark, d)
    order = Window.partitionBy("entity").orderBy(F.col("start_date").asc_nulls_last(), "id")
    return e.select("entity", "id", F.row_number().over(order).cast("long").alias("stop"), "place", F.lag("place").over(order).alias("from_place"), F.datediff("start_date", F.lag("start_date").over(order)).cast("long").alias("days"))


TOUR_CARD = ENG + "SELECT entity, id, row_number() OVER w AS stop, place, lag(place) OVER w AS from_place, date_diff('day', lag(start_date) OVER w, start_date) AS days FROM eng WINDOW w AS (PARTITION BY entity ORDER BY start_date NULLS LAST, id)"


def attention_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What is measured per key and kind: observations, days, the last day and the sum, largest first; and errors left out of the sum."""
    s = snapshots(spark, d)
    ok = F.col("status") != "error"
    return s.groupBy("key", (F.col("level") % 3).alias("kind")).agg(F.count("*").alias("observations"), F.count_distinct(F.when(ok, F.to_date("seen_at"))).alias("days"), F.max(F.when(ok, F.to_date("seen_at"))).alias("last_day"), F.round(F.sum(F.when(ok, F.col("price"))), 4).alias("total"))


ATTENTION_COVERAGE = SNAP + "SELECT key, level % 3 AS kind, count(*) AS observations, count(DISTINCT seen_at::date) FILTER (status <> 'error') AS days, max(seen_at::date) FILTER (status <> 'error') AS last_day, round(sum(price) FILTER (status <> 'error'), 4) AS total FROM snap GROUP BY ALL"


def source_health(spark: SparkSession, d: str) -> DataFrame:
    """The registry of document sources and languages joined to their labels; NOT_MEASURED where nothing is known."""
    reg = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("rows"))
    health = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels").where("quality IS NOT NULL"), "doc_id").groupBy("source", "lang").agg(F.round(F.avg("quality"), 6).alias("score"), F.count("*").alias("measured"))
    out = reg.join(health, ["source", "lang"], "left")
    state = F.when(F.col("score").isNull(), "NOT_MEASURED").when(F.col("score") == 0, "ZERO").when(F.col("score") < 0.9, "BELOW").otherwise("MEETS")
    return out.select("source", "lang", "rows", F.coalesce("measured", F.lit(0).cast("long")).alias("measured"), "score", state.alias("state"))


SOURCE_HEALTH = """
WITH r AS (SELECT source, lang, count(*) AS rows FROM documents GROUP BY ALL), h AS (SELECT source, lang, round(avg(quality), 6) AS score, count(*) AS measured FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL)
SELECT source, lang, rows, coalesce(measured, 0) AS measured, score, CASE WHEN score IS NULL THEN 'NOT_MEASURED' WHEN score = 0 THEN 'ZERO' WHEN score < 0.9 THEN 'BELOW' ELSE 'MEETS' END AS state FROM r LEFT JOIN h USING (source, lang)
"""


def recent_changes(spark: SparkSession, d: str) -> DataFrame:
    """The 25 newest changes of a closed list of kinds, with a price first, then by effective time and id."""
    s = snapshots(spark, d).where(F.col("status").isin("purchase", "error"))
    ordered = s.orderBy(F.col("price").isNotNull().desc(), F.coalesce("seen_at", F.lit("1970-01-01").cast("timestamp")).desc(), "seq")
    return ordered.limit(25).select("seq", "key", "status", "price")


RECENT_CHANGES = SNAP + "SELECT seq, key, status, price FROM snap WHERE status IN ('purchase', 'error') ORDER BY (price IS NOT NULL) DESC, coalesce(seen_at, '1970-01-01') DESC, seq LIMIT 25"


def news(spark: SparkSession, d: str) -> DataFrame:
    """Per name the newest three turns of conversations that contain it, by conversation and turn."""
    names = table(spark, d, "conversations").where("turn = 0").select(F.substring_index(F.lower("text"), " ", 1).alias("name")).groupBy("name").agg(F.count("*").alias("n")).where("n > 1 AND length(name) > 3").select("name")
    words = table(spark, d, "conversations").select("conv_id", "turn", "role", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("name"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("conv_id"), F.desc("turn")))
    return words.join(names, "name", "left_semi").withColumn("k", place.cast("long")).where("k <= 3").select("name", "k", "conv_id", "turn", "role")


NEWS = """
WITH n AS (SELECT string_split(lower(text), ' ')[1] AS name FROM conversations WHERE turn = 0 GROUP BY 1 HAVING count(*) > 1 AND length(name) > 3),
w AS (SELECT DISTINCT conv_id, turn, role, unnest(string_split(lower(text), ' ')) AS name FROM conversations)
SELECT name, k, conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY conv_id DESC, turn DESC) AS k FROM w WHERE name IN (SELECT name FROM n)) WHERE k <= 3
"""


def shortest_hits(spark: SparkSession, d: str) -> DataFrame:
    """The 20 shortest names that contain a text, over customers, suppliers and parts (distinct), by length and name."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).union(table(spark, d, "nation").select("n_name")).union(table(spark, d, "region").select("r_name")).distinct()
    hits = names.where(F.lower("name").contains("i"))
    return hits.select("name", F.length("name").cast("long").alias("n")).orderBy("n", "name").limit(20)


SHORTEST_HITS = "SELECT name, length(name) AS n FROM (SELECT p_name AS name FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region) WHERE contains(lower(name), 'i') ORDER BY n, name LIMIT 20"


def busiest_places(spark: SparkSession, d: str) -> DataFrame:
    """The 15 places with the most distinct parts delivered."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("place")).agg(F.count_distinct("l_partkey").alias("parts"))
    return g.orderBy(F.desc("parts"), "place").limit(15)


BUSIEST_PLACES = "SELECT l_suppkey AS place, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 ORDER BY parts DESC, place LIMIT 15"


def event_key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Computed event keys of two sources: how many either has, both, only the first, only the second."""
    key = lambda p: F.lower(F.replace(F.concat_ws("_", F.lit("boxoffice"), F.coalesce(F.col("o_custkey").cast("string"), F.lit("")), F.date_format(p, "yyyy-MM-dd")), F.lit(" "), F.lit("-")))
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus <> 'O'").select(key("o_orderdate").alias("key"), F.lit(1).alias("side"))
    b = o.where("o_orderpriority <> '1-URGENT'").select(key("o_orderdate").alias("key"), F.lit(2).alias("side"))
    sides = a.union(b).groupBy("key").agg(F.bool_or(F.col("side") == 1).alias("a"), F.bool_or(F.col("side") == 2).alias("b"))
    return sides.agg(F.count("*").alias("either"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("first_only"), F.count_if(~F.col("a") & F.col("b")).alias("second_only"))


EVENT_KEY_SETS = """
WITH k AS (SELECT 'boxoffice_' || o_custkey || '_' || strftime(o_orderdate, '%Y-%m-%d') AS key, o_orderstatus <> 'O' AS a, o_orderpriority <> '1-URGENT' AS b FROM orders),
x AS (SELECT key FROM k WHERE a), y AS (SELECT key FROM k WHERE b)
SELECT (SELECT count(*) FROM (SELECT key FROM x UNION SELECT key FROM y)) AS either, (SELECT count(*) FROM (SELECT key FROM x INTERSECT SELECT key FROM y)) AS both,
       (SELECT count(*) FROM (SELECT key FROM x EXCEPT SELECT key FROM y)) AS first_only, (SELECT count(*) FROM (SELECT key FROM y EXCEPT SELECT key FROM x)) AS second_only
"""


def knowledge_gate(spark: SparkSession, d: str) -> DataFrame:
    """Observations that were known by a time (a semi join), or that have a value or a later purchase of their key (a disjunction)."""
    s = snapshots(spark, d)
    known = s.where("seen_at <= '2024-01-10'").select("key").distinct()
    later = s.where("seen_at > '2024-01-25' AND status = 'purchase'").select("key").distinct().withColumn("later", F.lit(True))
    rows = s.join(known, "key", "left_semi").join(later, "key", "left").where(F.col("price").between(10, 20) | F.coalesce("later", F.lit(False)))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


KNOWLEDGE_GATE = SNAP + "SELECT status, count(*) AS n, count(DISTINCT key) AS keys FROM snap s WHERE key IN (SELECT key FROM snap WHERE seen_at <= '2024-01-10') AND (price BETWEEN 10 AND 20 OR EXISTS (SELECT 1 FROM snap x WHERE x.key = s.key AND x.seen_at > '2024-01-25' AND x.status = 'purchase')) GROUP BY status"


def stale_providers(spark: SparkSession, d: str) -> DataFrame:
    """Status kinds and keys not seen for a day before the end of the ledger, with the alert's key."""
    s = snapshots(spark, d)
    end = s.agg(F.max("seen_at").alias("end"))
    last = s.groupBy("key", "status").agg(F.max("seen_at").alias("last")).crossJoin(F.broadcast(end))  # end is one row
    late = last.where(F.col("last") < F.col("end") - F.expr("INTERVAL 1 DAY"))
    return late.select("key", "status", F.datediff("end", "last").cast("long").alias("days"), F.substring(F.sha2(F.concat_ws("|", F.lit("STALE"), F.col("key").cast("string"), "status"), 256), 1, 32).alias("alert_key"))


STALE_PROVIDERS = SNAP + ", e AS (SELECT max(seen_at) AS e FROM snap), l AS (SELECT key, status, max(seen_at) AS last FROM snap GROUP BY ALL) SELECT key, status, date_diff('day', last::date, e::date) AS days, sha256('STALE|' || key || '|' || status)[1:32] AS alert_key FROM l, e WHERE last < e - INTERVAL 1 DAY"


def tracked_events(spark: SparkSession, d: str) -> DataFrame:
    """Engagements as tracked at a time: ACTIVE until 48 hours after the start, then EXPIRED; the state's age in hours."""
    at = F.lit("1996-06-01 12:00:00").cast("timestamp")
    e = engagements(spark, d).where("start_date IS NOT NULL")
    hours = F.floor((F.unix_seconds(at) - F.unix_seconds(F.col("start_date").cast("timestamp"))) / 3600)
    return e.groupBy("market", F.when(hours > 48, "EXPIRED").when(hours >= 0, "RUNNING").otherwise("ACTIVE").alias("state")).agg(F.count("*").alias("n"), F.min(hours).alias("least_hours"), F.max(hours).alias("most_hours"))


TRACKED_EVENTS = ENG + ", h AS (SELECT market, date_diff('hour', start_date::timestamp, '1996-06-01 12:00:00'::timestamp) AS h FROM eng WHERE start_date IS NOT NULL) SELECT market, CASE WHEN h > 48 THEN 'EXPIRED' WHEN h >= 0 THEN 'RUNNING' ELSE 'ACTIVE' END AS state, count(*) AS n, min(h) AS least_hours, max(h) AS most_hours FROM h GROUP BY ALL"


def candidate_universe(spark: SparkSession, d: str) -> DataFrame:
    """Names of five sources merged by their normalised form: how many sources hold them, summed evidence, most first."""
    from pitengine.functions.text import name_key

    parts = [("part", "p_name", 3), ("part", "p_type", 2), ("customer", "c_mktsegment", 1), ("nation", "n_name", 4), ("region", "r_name", 5)]
    rows = None
    for t, c, weight in parts:
        one = table(spark, d, t).select(name_key(F.col(c)).alias("name"), F.lit(f"{t}.{c}").alias("source"), F.lit(weight).alias("w"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("name").agg(F.count_distinct("source").alias("sources"), F.sum("w").alias("evidence"))


CANDIDATE_UNIVERSE = """
WITH r AS (SELECT p_name AS n, 'a' AS s, 3 AS w FROM part UNION ALL SELECT p_type, 'b', 2 FROM part UNION ALL SELECT c_mktsegment, 'c', 1 FROM customer UNION ALL SELECT n_name, 'd', 4 FROM nation UNION ALL SELECT r_name, 'e', 5 FROM region)
SELECT regexp_replace(trim(regexp_replace(regexp_replace(lower(n), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '^(the )+', '') AS name, count(DISTINCT s) AS sources, sum(w)::bigint AS evidence FROM r GROUP BY 1
"""

QUERIES = {name.lower(): (globals()[name.lower()], globals()[name]) for name in list(globals()) if name.isupper() and name.lower() in globals()}
