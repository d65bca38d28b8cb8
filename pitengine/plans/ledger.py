"""Queries over the snapshot ledger: transitions, alerts, idempotent appends, merges, claims, validity, competition and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitengine.functions.geo_time import effective_cutoff, haversine_km, valid_at
from pitengine.functions.stats import ratio_or_zero
from pitengine.operators import changes as C
from pitengine.operators import pit
from pitengine.operators import windows as W
from pitengine.sources.tables import ENGAGEMENTS_SQL as ENG
from pitengine.sources.tables import SNAPSHOTS_SQL as SNAP
from pitengine.sources.tables import engagements, snapshots, table

ORDER = ["seen_at", "seq"]


def snapshot_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Status changes between consecutive snapshots of a key; the first is a discovery."""
    return C.transitions(snapshots(spark, d), ["key"], ORDER, "status").select("key", "seq", "old", "new", "kind")


SNAPSHOT_TRANSITIONS = SNAP + """
SELECT key, seq, old, status AS new, CASE WHEN n = 1 THEN 'DISCOVERED' ELSE 'CHANGED' END AS kind FROM (
  SELECT *, lag(status) OVER w AS old, row_number() OVER w AS n FROM snap WINDOW w AS (PARTITION BY key ORDER BY seen_at, seq)) WHERE n = 1 OR old IS DISTINCT FROM status
"""


def snapshot_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Price and level against the snapshot before; NULL if either side is missing."""
    rows = C.with_previous(snapshots(spark, d), ["key"], ORDER, ["price", "level"])
    return rows.select("key", "seq", F.round(F.col("price") - F.col("previous.price"), 6).alias("price_delta"), (F.col("level") - F.col("previous.level")).alias("level_delta"))


SNAPSHOT_DELTAS = SNAP + "SELECT key, seq, round(price - lag(price) OVER w, 6) AS price_delta, level - lag(level) OVER w AS level_delta FROM snap WINDOW w AS (PARTITION BY key ORDER BY seen_at, seq)"


def _observed(price):
    """The price of a view was not observed: nothing is paid for it."""
    return F.when(F.col("status") != "view", price)


def price_change_semantics(spark: SparkSession, d: str) -> DataFrame:
    """What a price change means, where prices of views count as not observed."""
    rows = snapshots(spark, d).withColumn("price", _observed(F.col("price")))
    rows = rows.withColumn("old", F.lag("price").over(Window.partitionBy("key").orderBy(*ORDER)))
    return rows.groupBy("key", C.describe_change(F.col("old"), F.col("price")).alias("change")).agg(F.count("*").alias("n"))


PRICE_CHANGE_SEMANTICS = SNAP + """,
p AS (SELECT key, seen_at, seq, CASE WHEN status <> 'view' THEN price END AS price FROM snap),
l AS (SELECT *, lag(price) OVER (PARTITION BY key ORDER BY seen_at, seq) AS old FROM p)
SELECT key, CASE WHEN old IS NULL AND price IS NULL THEN 'NO_INFORMATION' WHEN old IS NULL THEN 'BECAME_OBSERVABLE' WHEN price IS NULL THEN 'BECAME_UNOBSERVABLE'
  WHEN old = price THEN 'UNCHANGED' WHEN price > old THEN 'INCREASED' ELSE 'DECREASED' END AS change, count(*) AS n FROM l GROUP BY ALL
"""


def activity_tape(spark: SparkSession, d: str) -> DataFrame:
    """One ledger of discoveries, status changes and large price rises, each kind counted per key and day."""
    rows = C.with_previous(snapshots(spark, d), ["key"], ORDER, ["status", "price"])
    found = F.array(
        F.when(F.col("is_first"), F.lit("DISCOVERED")),
        F.when(~F.col("is_first") & (F.col("previous.status") != F.col("status")), F.lit("STATUS_CHANGED")),
        F.when(F.col("price") > 2 * F.col("previous.price"), F.lit("PRICE_DOUBLED")),
    )
    tape = rows.select("key", F.to_date("seen_at").alias("day"), F.explode(F.array_compact(found)).alias("activity"))
    return tape.groupBy("key", "day", "activity").agg(F.count("*").alias("n"))


ACTIVITY_TAPE = SNAP + """,
l AS (SELECT *, lag(status) OVER w AS s0, lag(price) OVER w AS p0, row_number() OVER w AS n FROM snap WINDOW w AS (PARTITION BY key ORDER BY seen_at, seq)),
t AS (SELECT key, seen_at::date AS day, 'DISCOVERED' AS activity FROM l WHERE n = 1 UNION ALL SELECT key, seen_at::date, 'STATUS_CHANGED' FROM l WHERE n > 1 AND s0 <> status
      UNION ALL SELECT key, seen_at::date, 'PRICE_DOUBLED' FROM l WHERE price > 2 * p0)
SELECT key, day, activity, count(*) AS n FROM t GROUP BY ALL
"""


def alerts_deduped(spark: SparkSession, d: str) -> DataFrame:
    """One alert per key and status reached; a return to a status that was reported is none."""
    return C.alerts(snapshots(spark, d), ["key"], ORDER, "status", "STATUS_CHANGED").select("alert_key", "kind", "key", "seq", "new")


ALERTS_DEDUPED = SNAP + """,
l AS (SELECT *, lag(status) OVER w AS old, row_number() OVER w AS n FROM snap WINDOW w AS (PARTITION BY key ORDER BY seen_at, seq)),
a AS (SELECT *, row_number() OVER (PARTITION BY key, status ORDER BY seen_at, seq) AS k FROM l WHERE n > 1 AND old IS DISTINCT FROM status)
SELECT sha256('STATUS_CHANGED|' || key || '|' || status)[1:32] AS alert_key, 'STATUS_CHANGED' AS kind, key, seq, status AS new FROM a WHERE k = 1
"""


def new_in_latest_run(spark: SparkSession, d: str) -> DataFrame:
    """Keys that the second of two days brought: those of the first two days of the ledger."""
    rows = snapshots(spark, d).where("seen_at < '2024-01-03'").withColumn("batch", F.to_date("seen_at"))
    return C.new_in_latest(rows, "batch", "key")


NEW_IN_LATEST_RUN = SNAP + """,
two AS (SELECT * FROM snap WHERE seen_at < '2024-01-03'), b AS (SELECT key, min(seen_at::date) AS first_batch FROM two GROUP BY key), l AS (SELECT max(seen_at::date) AS latest, min(seen_at::date) AS earliest FROM two)
SELECT key, first_batch FROM b, l WHERE first_batch = latest AND latest > earliest
"""


def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The last snapshot of each key."""
    return pit.latest_as_of(snapshots(spark, d), ["key"], "seen_at", F.col("seen_at"), ORDER).select("key", "seq", "status", "price")


LATEST_SNAPSHOT = SNAP + "SELECT key, max(seq) FILTER (n = 1) AS seq, max(status) FILTER (n = 1) AS status, max(price) FILTER (n = 1) AS price FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seen_at DESC, seq DESC) AS n FROM snap) GROUP BY key"


def latest_as_of(spark: SparkSession, d: str) -> DataFrame:
    """What was known of each key by a knowledge time, that time included."""
    return pit.latest_as_of(snapshots(spark, d), ["key"], "seen_at", F.lit("2024-01-15 12:00:00").cast("timestamp"), ORDER).select("key", "seq", "status", "price")


LATEST_AS_OF = SNAP + "SELECT key, seq, status, price FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seen_at DESC, seq DESC) AS n FROM snap WHERE seen_at <= '2024-01-15 12:00:00') WHERE n = 1"


def validity_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are valid at noon of each of three days, from half-open validity intervals."""
    rows = pit.close_superseded(snapshots(spark, d), ["key"], "seen_at", ORDER)
    at = spark.sql("SELECT at::timestamp AS at FROM VALUES ('2024-01-05 12:00:00'), ('2024-01-15 12:00:00'), ('2024-01-25 12:00:00') AS t(at)")
    valid = rows.join(F.broadcast(at), valid_at(F.col("seen_at"), F.col("valid_to"), F.col("at")))  # three rows
    return valid.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day"), "status").agg(F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("price"))


VALIDITY_FILTER = SNAP + """,
v AS (SELECT *, lead(seen_at) OVER (PARTITION BY key ORDER BY seen_at, seq) AS valid_to FROM snap),
d AS (SELECT unnest(['2024-01-05 12:00:00'::timestamp, '2024-01-15 12:00:00'::timestamp, '2024-01-25 12:00:00'::timestamp]) AS noon)
SELECT strftime(noon, '%Y-%m-%d') AS day, status, count(*) AS n, round(sum(price), 4) AS price FROM v JOIN d ON seen_at <= noon AND (valid_to IS NULL OR valid_to > noon) GROUP BY ALL
"""


def dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    """Observations with one content key merged: first and last time seen, how often, the winner's columns."""
    rows = snapshots(spark, d).withColumn("content", F.concat_ws("|", "key", "status", "level"))
    return C.merge_observations(rows, "content", "seen_at", ["seq"]).select("content", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"), "seen_count", "seq", "price")


DEDUP_MERGE = SNAP + "SELECT concat_ws('|', key, status, level) AS content, epoch_us(min(seen_at)) AS first_seen, epoch_us(max(seen_at)) AS last_seen, count(*) AS seen_count, min(seq) AS seq, arg_min(price, seq) AS price FROM snap GROUP BY 1"


def canonical_key(spark: SparkSession, d: str) -> DataFrame:
    """Canonical keys of pages: the address without query where there is a host, else a digest of the html."""
    from pitengine.functions.text import url_key

    pages = table(spark, d, "pages")
    key = F.coalesce(F.concat(F.lit("url::"), url_key(F.col("url"))), F.concat(F.lit("hash::"), F.sha2("html", 256)))
    return pages.groupBy(key.alias("canonical_key")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


CANONICAL_KEY = r"""
SELECT CASE WHEN regexp_matches(url, '^https?://') THEN 'url::' || lower(regexp_extract(url, '^(https?)://', 1)) || '://' || lower(regexp_extract(url, '^https?://(?:[^/@?#]*@)?([^/:?#]+)', 1)) || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '')
            ELSE 'hash::' || sha256(html) END AS canonical_key, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1
"""


def idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    """What a second batch adds to a ledger: its first row per (key, status) that the first batch doesn't hold."""
    rows = snapshots(spark, d)
    cut = F.lit("2024-01-10 00:00:00").cast("timestamp")
    return C.append_new(rows.where(F.col("seen_at") < cut), rows.where(F.col("seen_at") >= cut), ["key", "status"], ORDER).select("key", "status", "seq", "price")


IDEMPOTENT_APPEND = SNAP + """
SELECT key, status, seq, price FROM (SELECT *, row_number() OVER (PARTITION BY key, status ORDER BY seen_at, seq) AS n FROM snap s WHERE seen_at >= '2024-01-10'
  AND NOT EXISTS (SELECT 1 FROM snap e WHERE e.key = s.key AND e.status = s.status AND e.seen_at < '2024-01-10')) WHERE n = 1
"""


def conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    """Claims of a part's discount per order size that disagree; all of them stay."""
    return C.conflicts(table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_discount"), ["l_partkey", "l_quantity"], "l_discount")


CONFLICT_GROUPS = "SELECT l_partkey, l_quantity, count(*) AS claims, count(DISTINCT l_discount) AS n_values, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_discount) > 1"


def scd_supersede(spark: SparkSession, d: str) -> DataFrame:
    """Each row with the time and row that replaced it."""
    rows = pit.close_superseded(snapshots(spark, d), ["key"], "seen_at", ORDER)
    by = F.lead("seq").over(Window.partitionBy("key").orderBy(*ORDER))
    return rows.select("key", "seq", F.unix_micros("valid_to").alias("valid_to"), by.alias("superseded_by"))


SCD_SUPERSEDE = SNAP + "SELECT key, seq, epoch_us(lead(seen_at) OVER w) AS valid_to, lead(seq) OVER w AS superseded_by FROM snap WINDOW w AS (PARTITION BY key ORDER BY seen_at, seq)"


def claim_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Wide rows as long typed claims, with how many are missing. Values are summed as decimals, so that no order of addition shows."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    # a subject's rows are summed up first, all claims side by side: no row is laid out per claim, no distinct count over them
    sums = [x for k, c in enumerate(names) for x in (F.count(c).alias(f"known{k}"), F.sum(F.col(c).cast("decimal(18,4)")).alias(f"sum{k}"))]
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("claims"), *sums)
    whole = per.agg(F.sum("claims").alias("claims"), F.count("l_orderkey").alias("subjects"), *(F.sum(f"{x}{k}").alias(f"{x}{k}") for k in range(len(names)) for x in ("known", "sum"))).where("claims > 0")
    each = F.array(*(F.struct(F.lit(c).alias("claim"), F.col(f"known{k}").alias("known"), F.col(f"sum{k}").cast("double").alias("total")) for k, c in enumerate(names)))
    return whole.select("claims", "subjects", F.explode(each).alias("c")).select("c.claim", "claims", "c.known", "subjects", F.round(F.col("c.total") / F.col("c.known"), 6).alias("mean"))



CLAIM_LEDGER = "SELECT claim, count(*) AS claims, count(value) AS known, count(DISTINCT l_orderkey) AS subjects, round(sum(value::decimal(18,4))::double / count(value), 6) AS mean FROM lineitem UNPIVOT INCLUDE NULLS (value FOR claim IN (l_quantity, l_extendedprice, l_discount, l_tax)) GROUP BY claim"


def competition_windows(spark: SparkSession, d: str) -> DataFrame:
    """Per engagement: others of its market within 0, 3, 7 and 14 days, and how many were known when it started.

    A market's engagements are counted per day first, so the range join meets days and not rows.
    """
    eng = engagements(spark, d).where("start_date IS NOT NULL AND market IS NOT NULL")
    known = F.coalesce(F.datediff("pub_date", "start_date"), F.lit(10_000))
    # a day's engagements by how late they were published: a few dozen counts per market and day
    daily = eng.groupBy("market", F.col("start_date").alias("day"), known.alias("lag")).agg(F.count("*").alias("n"))
    days = eng.select("market", "start_date").distinct()
    back = F.explode(F.sequence(F.lit(-14), F.lit(14))).alias("back")
    near = days.select("market", "start_date", back).withColumn("day", F.date_add("start_date", F.col("back"))).join(daily, ["market", "day"])
    open_ = (F.col("back") + F.col("lag")) < 0  # published before the target's start
    parts = [F.sum(F.when(F.abs("back") <= w, F.col("n"))).alias(f"within_{w}") for w in (0, 3, 7, 14)]
    counted = near.groupBy("market", "start_date").agg(*parts, F.coalesce(F.sum(F.when(open_, F.col("n"))), F.lit(0)).alias("known_14"))
    joined = eng.select("id", "market", "start_date").join(counted, ["market", "start_date"])
    return joined.select("id", *((F.col(f"within_{w}") - 1).alias(f"within_{w}") for w in (0, 3, 7, 14)), "known_14")


COMPETITION_WINDOWS = ENG + """
SELECT t.id, count(*) FILTER (h.start_date = t.start_date) - 1 AS within_0, count(*) FILTER (abs(date_diff('day', t.start_date, h.start_date)) <= 3) - 1 AS within_3, count(*) FILTER (abs(date_diff('day', t.start_date, h.start_date)) <= 7) - 1 AS within_7,
       count(*) - 1 AS within_14, count(*) FILTER (h.pub_date < t.start_date) AS known_14
FROM eng t JOIN eng h ON h.market = t.market AND h.start_date BETWEEN t.start_date - 14 AND t.start_date + 14 GROUP BY t.id
"""


def competition_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per market: days with engagements, the busiest day and its count."""
    days = engagements(spark, d).where("start_date IS NOT NULL").groupBy("market", "start_date").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.datediff("start_date", F.lit("1970-01-01"))).alias("e"), F.date_format("start_date", "yyyy-MM-dd").alias("day")))
    return days.groupBy("market").agg(F.sum("n").alias("engagements"), F.count("*").alias("days"), best.alias("b")).select("market", "engagements", "days", F.col("b.n").alias("busiest"), F.col("b.day").alias("busiest_day"))


COMPETITION_PROFILE = ENG + ", days AS (SELECT market, start_date, count(*) AS n FROM eng GROUP BY ALL) SELECT market, sum(n)::bigint AS engagements, count(*) AS days, max(n) AS busiest, strftime(arg_max(start_date, (n, -date_diff('day', '1970-01-01'::date, start_date))), '%Y-%m-%d') AS busiest_day FROM days GROUP BY market"


def _site(nation):
    """A made-up but fixed place on the map for each market."""
    return ((nation * 37) % 180 - 90).cast("double"), ((nation * 53) % 360 - 180).cast("double")


def exclusivity_gap(spark: SparkSession, d: str) -> DataFrame:
    """Per engagement: other engagements in the same series and place within 14 days, and the nearest one's distance.

    Days cut the range join: a target meets the rows of 14-day bins next to its own only.
    """
    eng = engagements(spark, d).where("start_date IS NOT NULL AND place IS NOT NULL")
    lat, lon = _site(F.col("market"))
    eng = eng.select("id", "series", "place", "market", "start_date", lat.alias("lat"), lon.alias("lon"), F.floor(F.datediff("start_date", F.lit("1970-01-01")) / 14).alias("bin"))
    a = eng.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))).alias("a")
    b = eng.alias("b")
    same = (F.col("a.bin") == F.col("b.bin")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.series") == F.col("b.series"))
    near = a.join(b, same & (F.col("a.id") != F.col("b.id")) & (F.abs(F.datediff("a.start_date", "b.start_date")) <= 14))
    km = haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return near.groupBy(F.col("a.id").alias("id")).agg(F.count("*").alias("conflicts"), F.round(F.min(km), 4).alias("gap_km"))


EXCLUSIVITY_GAP = ENG + """,
s AS (SELECT *, radians(((market * 37) % 180 - 90)::double) AS la, radians(((market * 53) % 360 - 180)::double) AS lo FROM eng WHERE place IS NOT NULL)
SELECT a.id, count(*) AS conflicts, round(min(2 * 6371.0 * asin(least(sqrt(sin((b.la - a.la) / 2) ** 2 + cos(a.la) * cos(b.la) * sin((b.lo - a.lo) / 2) ** 2), 1))), 4) AS gap_km
FROM s a JOIN s b ON a.place = b.place AND a.series = b.series AND a.id <> b.id AND abs(date_diff('day', a.start_date, b.start_date)) <= 14 GROUP BY a.id
"""


def pit_availability(spark: SparkSession, d: str) -> DataFrame:
    """Claims known by four cutoffs relative to the start of their engagement, the cutoff included; strict and conservative."""
    eng = engagements(spark, d).select("id", "start_date", "pub_date")
    cutoffs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("days")) for n, k in (("BOOKING", -90), ("ANNOUNCEMENT", -30), ("EVENT_DATE", 0), ("RESULT", 60))))).alias("c")
    rows = eng.select("id", "start_date", "pub_date", cutoffs)
    at = F.date_add("start_date", F.col("c.days"))
    strict = effective_cutoff(F.when(F.col("c.days") >= 0, at), at, at, True)
    loose = effective_cutoff(F.when(F.col("c.days") >= 0, at), at, at, False)
    return rows.groupBy("c.name").agg(F.count("*").alias("events"), F.count(strict).alias("exact_cutoffs"), F.count_if(F.col("pub_date") <= strict).alias("known_strict"), F.count_if(F.col("pub_date") <= loose).alias("known_conservative"))


PIT_AVAILABILITY = ENG + """,
c AS (SELECT * FROM (VALUES ('BOOKING', -90), ('ANNOUNCEMENT', -30), ('EVENT_DATE', 0), ('RESULT', 60)) c(name, days))
SELECT name, count(*) AS events, count(*) FILTER (days >= 0) AS exact_cutoffs, count(*) FILTER (days >= 0 AND pub_date <= start_date + days) AS known_strict, count(*) FILTER (pub_date <= start_date + days) AS known_conservative FROM eng, c GROUP BY name
"""


def daily_series(spark: SparkSession, d: str) -> DataFrame:
    return W.daily_series(snapshots(spark, d), "key", "seen_at", "price").select("key", "day", F.round("value", 4).alias("value"), "observations")


DAILY_SERIES = SNAP + "SELECT key, seen_at::date AS day, round(sum(price), 4) AS value, count(*) AS observations FROM snap WHERE price IS NOT NULL GROUP BY ALL"


def pit_windows(spark: SparkSession, d: str) -> DataFrame:
    """Trailing sums strictly before two cutoffs per key, days known before the cutoff only."""
    daily = W.daily_series(snapshots(spark, d), "key", "seen_at", "price").withColumn("available", F.date_add("day", 2))
    keys = daily.select("key").distinct().select("key", F.explode(F.array(F.lit("2024-01-16").cast("date"), F.lit("2024-02-01").cast("date"))).alias("cutoff"))
    out = W.trailing_features(daily, keys, "key", available="available")
    return out.select("key", "cutoff", *(F.round(c, 4).alias(c) for c in ("sum_7d", "sum_30d", "sum_90d", "sum_365d")), "days_observed")


_DAILY = SNAP + ", daily AS (SELECT key, seen_at::date AS day, sum(price) AS value FROM snap GROUP BY ALL), cut AS (SELECT DISTINCT key, unnest(['2024-01-16'::date, '2024-02-01'::date]) AS cutoff FROM daily)"
PIT_WINDOWS = _DAILY + """,
b AS (SELECT c.key, c.cutoff, value, CASE WHEN day + 2 < cutoff THEN date_diff('day', day, cutoff) END AS back FROM cut c LEFT JOIN daily d ON d.key = c.key)
SELECT key, cutoff, round(sum(value) FILTER (back BETWEEN 1 AND 7), 4) AS sum_7d, round(sum(value) FILTER (back BETWEEN 1 AND 30), 4) AS sum_30d, round(sum(value) FILTER (back BETWEEN 1 AND 90), 4) AS sum_90d,
       round(sum(value) FILTER (back BETWEEN 1 AND 365), 4) AS sum_365d, count(*) FILTER (back >= 1) AS days_observed FROM b GROUP BY ALL
"""


def attention_stats(spark: SparkSession, d: str) -> DataFrame:
    """Growth, variation and spike of the last 30 days before the end of the ledger."""
    daily = W.daily_series(snapshots(spark, d), "key", "seen_at", "price")
    out = W.trailing_features(daily, daily.select("key").distinct().withColumn("cutoff", F.lit("2024-02-10").cast("date")), "key")
    return out.select("key", *(F.round(c, 4).alias(c) for c in ("sum_30d", "growth_30d", "variation", "spike")))


ATTENTION_STATS = SNAP + """,
b AS (SELECT key, date_diff('day', seen_at::date, '2024-02-10'::date) AS back, sum(price) AS value FROM snap GROUP BY ALL)
SELECT key, round(sum(value) FILTER (back BETWEEN 1 AND 30), 4) AS sum_30d,
  round((sum(value) FILTER (back BETWEEN 1 AND 30) - sum(value) FILTER (back BETWEEN 31 AND 60)) / nullif(sum(value) FILTER (back BETWEEN 31 AND 60), 0), 4) AS growth_30d,
  round(stddev_pop(value) FILTER (back BETWEEN 1 AND 30) / nullif(avg(value) FILTER (back BETWEEN 1 AND 30), 0), 4) AS variation,
  round(max(value) FILTER (back BETWEEN 1 AND 30) / nullif(avg(value) FILTER (back BETWEEN 1 AND 30), 0), 4) AS spike FROM b GROUP BY key
"""


def calendar_densify(spark: SparkSession, d: str) -> DataFrame:
    """Days of each key by state, and how complete its calendar is."""
    days = W.densify(W.daily_series(snapshots(spark, d), "key", "seen_at", "price"), "key")
    return days.groupBy("key").agg(F.count("*").alias("days"), F.count_if(F.col("state") == "MISSING").alias("missing"), F.count_if(F.col("state") == "TRUE_ZERO").alias("zero"), F.round(ratio_or_zero(F.count("value"), F.count("*")), 6).alias("completeness"))


CALENDAR_DENSIFY = SNAP + """,
daily AS (SELECT key, seen_at::date AS day, sum(price) AS value FROM snap GROUP BY ALL),
s AS (SELECT key, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::date AS day FROM daily GROUP BY key)
SELECT key, count(*) AS days, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (value = 0) AS zero, round(count(value) / count(*)::double, 6) AS completeness FROM s LEFT JOIN daily USING (key, day) GROUP BY key
"""


def ewma_series(spark: SparkSession, d: str) -> DataFrame:
    out = W.moving_average_fold(W.daily_series(snapshots(spark, d), "key", "seen_at", "price"), "key")
    return out.select("key", F.col("days").cast("long").alias("days"), F.round("ewma", 4).alias("ewma"))


EWMA_SERIES = SNAP + ", daily AS (SELECT key, seen_at::date AS day, sum(price) AS value FROM snap GROUP BY ALL) SELECT key, count(*) AS days, round(list_reduce(list(value ORDER BY day), lambda acc, v: 0.5::double * v + 0.5::double * acc), 4) AS ewma FROM daily GROUP BY key"


def portfolio_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each key's daily sums as an equity curve: mean and deviation of returns, and their ratio per year."""
    daily = W.daily_series(snapshots(spark, d), "key", "seen_at", "price")
    out = W.drawdown(daily, ["key"], ["day"], "value")
    ratio = F.when(F.col("sd_return") > 1e-12, F.col("mean_return") / F.col("sd_return") * F.sqrt(F.lit(252.0))).otherwise(0.0)
    return out.select("key", "periods", F.round("mean_return", 4).alias("mean_return"), F.round(ratio, 4).alias("sharpe"))


_RETURNS = SNAP + """,
daily AS (SELECT key, seen_at::date AS day, sum(price) AS value FROM snap GROUP BY ALL),
r AS (SELECT key, value, lag(value) OVER w AS v0, max(value) OVER (PARTITION BY key ORDER BY day) AS peak FROM daily WINDOW w AS (PARTITION BY key ORDER BY day)),
x AS (SELECT key, value / nullif(peak, 0) - 1 AS fall, CASE WHEN v0 > 0 THEN value / v0 - 1 END AS ret FROM r)
"""
PORTFOLIO_METRICS = _RETURNS + "SELECT key, count(ret) AS periods, round(avg(ret), 4) AS mean_return, round(CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END, 4) AS sharpe FROM x GROUP BY key"


def max_drawdown(spark: SparkSession, d: str) -> DataFrame:
    out = W.drawdown(W.daily_series(snapshots(spark, d), "key", "seen_at", "price"), ["key"], ["day"], "value")
    return out.select("key", F.round("max_drawdown", 6).alias("max_drawdown"))


MAX_DRAWDOWN = _RETURNS + "SELECT key, round(min(fall), 6) AS max_drawdown FROM x GROUP BY key"

QUERIES = {name.lower(): (globals()[name.lower()], globals()[name]) for name in list(globals()) if name.isupper() and name.lower() in globals()}
