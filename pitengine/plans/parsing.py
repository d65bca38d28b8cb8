"""Queries that parse raw pages: records out of lines and tables, claims out of JSON-LD. The pages are written from the given tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitengine.operators import jsonld
from pitengine.session import new_path
from pitengine.sources import dumps
from pitengine.sources import records as R
from pitengine.sources.tables import table

TIERS = ("10,001 - 15,000 Capacity", "5,001 - 10,000", "Capacity", "5,000 or less capacity")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("gross"), F.to_date("o_orderdate").alias("day"))


def _lines(rows: DataFrame, *lines) -> DataFrame:
    """page, line and text: line n of row k stands at 10 * k + n; NULL lines are left out."""
    each = F.array(*(F.struct(F.lit(n).alias("n"), text.alias("text")) for n, text in enumerate(lines)))
    return rows.select("page", "k", F.explode(each).alias("l")).where("l.text IS NOT NULL").select("page", (F.col("k") * 10 + F.col("l.n")).alias("line"), "l.text")


def text_records(spark: SparkSession, d: str) -> DataFrame:
    """Two-line records under tiers, a page per customer: heads without fields and fields without a head keep a reason."""
    o, k = _orders(spark, d), F.col("k")
    head = F.when(k % 13 != 0, F.concat(k % 5 + 1, F.lit(") Act "), k))
    body = F.concat(
        F.lit("Tickets Sold: "), F.format_number(k % 30_000, 0), F.lit("; Venue: Hall, "), k % 7, F.lit(", Town "), k % 3, F.lit("; Gross: $"), F.format_number("gross", 2), F.lit("; Ticket Range: $10 - $"),
        F.format_number(k % 2000, 0), F.lit(".50; Promoter: P"), k % 4, F.lit("; Dates: "), F.date_format("day", "MMM. d, yyyy"), F.lit("; No. of Shows: "), k % 3 + 1,
    )
    lines = _lines(o, F.lit(None).cast("string"), head, F.when(k % 11 == 0, "No numbers today").otherwise(body))
    tiers = o.select("page").distinct().select("page", F.posexplode(F.array(*map(F.lit, TIERS))).alias("line", "text")).withColumn("line", F.col("line").cast("long") - 9)
    out = R.records(lines.unionByName(tiers), R.PairedLines)
    return out.select("page", "line", "rank", "name", "place", "city", "tier", "headcount", "gross", "low", "high", "promoter", "shows", "first_day", "last_day", "reason")


TEXT_RECORDS = """
WITH e AS (
  SELECT o_custkey AS page, o_orderkey AS k, o_orderkey * 10 + 1 AS line, 'H' AS kind FROM orders WHERE o_orderkey % 13 <> 0 UNION ALL
  SELECT o_custkey, o_orderkey, o_orderkey * 10 + 2, 'B' FROM orders WHERE o_orderkey % 11 <> 0),
w AS (
  SELECT *, max(CASE WHEN kind = 'H' THEN line END) OVER p AS head, max(CASE WHEN kind = 'B' THEN line END) OVER p AS body, lead(kind) OVER (PARTITION BY page ORDER BY line) AS next
  FROM e WINDOW p AS (PARTITION BY page ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT page, k, line, head, head IS NOT NULL AND (body IS NULL OR body < head) AS ok FROM w WHERE kind = 'B'),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line) - 1 AS nr FROM b WHERE ok)
SELECT page, head AS line, ((head - 1) // 10 % 5 + 1)::int AS rank, 'Act ' || (head - 1) // 10 AS name, 'Hall, ' || k % 7 AS place, 'Town ' || k % 3 AS city,
  ['10,001 - 15,000 Capacity', '5,001 - 10,000 Capacity', '5,000 or less capacity'][nr // 5 + 1] AS tier, (k % 30000)::double AS headcount, round(o_totalprice, 2) AS gross, 10.0::double AS low, k % 2000 + 0.5::double AS high,
  'P' || k % 4 AS promoter, (k % 3 + 1)::int AS shows, o_orderdate::date AS first_day, o_orderdate::date AS last_day, NULL AS reason
FROM n JOIN orders ON o_orderkey = k
UNION ALL SELECT page, line, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'NO_HEAD' FROM b WHERE NOT ok
UNION ALL SELECT page, line, (k % 5 + 1)::int, 'Act ' || k, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'NO_BODY' FROM w WHERE kind = 'H' AND next IS DISTINCT FROM 'B'
"""


def _block_lines(o: DataFrame) -> DataFrame:
    """Seven lines per row: as reported, open, estimated, malformed, over three days, or cut off at the page's end."""
    k = F.col("k")
    days = F.when((k % 6 == 4) & (F.dayofmonth("day") <= 25), F.concat(F.date_format("day", "MMMM d"), F.lit("-"), F.dayofmonth("day") + 2, F.lit(", "), F.year("day"))).otherwise(F.date_format("day", "MMMM d, yyyy"))
    gross = F.when(k % 6 == 1, R.OPEN).otherwise(F.concat(F.when(k % 6 == 2, "~").otherwise(""), F.lit("$"), F.format_number("gross", 2)))
    heads = F.when(k % 6 == 3, "n/a").otherwise(F.concat(F.format_number(k % 30_000, 0), F.lit(" ("), k % 101, F.lit("%)")))
    whole = ~F.col("cut")
    return _lines(o, days, F.concat(F.lit("Act "), k), F.lit("Hall, big"), F.lit("Town, Land"), gross, F.when(whole, heads), F.when(whole, F.concat(k % 4 + 1, F.lit(" shows"))), F.when(whole & (k % 5 == 0), "tour news: May 5"))


def block_records(spark: SparkSession, d: str) -> DataFrame:
    """Seven-line blocks, a page per customer: open, malformed and cut-off ones keep a reason, estimated ones a mark."""
    o = _orders(spark, d)
    ends = o.groupBy("page").agg(F.max("k").alias("k")).where("page % 17 = 0").withColumn("cut", F.lit(True))
    lines = _block_lines(o.join(ends, ["page", "k"], "left").withColumn("cut", F.coalesce("cut", F.lit(False))))
    return R.records(lines, R.Blocks).select("page", "line", "name", "place", "city", "headcount", "gross", "sell_through", "shows", "first_day", "last_day", "estimated", "reason")


BLOCK_RECORDS = """
WITH o AS (SELECT o_custkey AS page, o_orderkey AS k, round(o_totalprice, 2) AS gross, o_orderdate::date AS day, max(o_orderkey) OVER (PARTITION BY o_custkey) = o_orderkey AND o_custkey % 17 = 0 AS cut FROM orders),
r AS (SELECT *, CASE WHEN cut THEN 'INCOMPLETE' WHEN k % 6 = 1 THEN 'UNREPORTED' WHEN k % 6 = 3 THEN 'MALFORMED' END AS reason FROM o)
SELECT page, k * 10 AS line, 'Act ' || k AS name, CASE WHEN NOT cut THEN 'Hall, big' END AS place, CASE WHEN NOT cut THEN 'Town, Land' END AS city, CASE WHEN reason IS NULL THEN (k % 30000)::double END AS headcount,
  CASE WHEN reason IS NULL THEN gross END AS gross, CASE WHEN reason IS NULL THEN (k % 101)::double END AS sell_through, CASE WHEN reason IS NULL THEN (k % 4 + 1)::int END AS shows, day AS first_day,
  CASE WHEN k % 6 = 4 AND day(day) <= 25 THEN day + 2 ELSE day END AS last_day, reason IS NULL AND k % 6 = 2 AS estimated, reason FROM r
"""


def auto_records(spark: SparkSession, d: str) -> DataFrame:
    """Pages in one of two layouts or in both: blocks win where one was read, inline lines stand in elsewhere."""
    p = table(spark, d, "part").select(F.col("p_size").cast("long").alias("page"), F.col("p_partkey").alias("k"), F.round("p_retailprice", 2).alias("gross"), F.date_add(F.lit("2001-01-01").cast("date"), (F.col("p_partkey") % 9000).cast("int")).alias("day"))
    k, layout = F.col("k"), F.col("page") % 4  # blocks, lines, both, blocks that are all open beside lines
    blocks = p.where(layout != 1).withColumn("cut", F.lit(False))
    open_ones = _lines(blocks.where(layout == 3), F.date_format("day", "MMMM d, yyyy"), *map(F.lit, ("Act", "Hall", "Town", R.OPEN, R.OPEN, "1 show")))
    inline = F.concat(F.date_format("day", "MMMM d, yyyy"), F.lit(": Hall "), k % 9, F.lit(", Town, Land ("), F.format_number(k % 30_000, 0), F.lit(" – $"), F.format_number("gross", 2), F.lit(")"), F.when(k % 3 == 0, " (2 shows)").otherwise(""))
    total = F.when(k % 10 == 0, "Total Estimated Gross: $1").when(k % 10 == 5, "Total Reported Attendance: 7")
    lines = _lines(p.where(layout != 0), *[F.lit(None).cast("string")] * 8, total, inline)
    return R.auto_records(_block_lines(blocks.where(layout != 3)).unionByName(open_ones).unionByName(lines)).select("page", "line", "layout", "headcount", "gross", "shows", "estimated", "reason")


AUTO_RECORDS = """
WITH p AS (SELECT p_size::bigint AS page, p_partkey AS k, round(p_retailprice, 2) AS gross, p_size % 4 AS layout FROM part),
i AS (SELECT *, last_value(CASE WHEN k % 10 = 0 THEN true WHEN k % 10 = 5 THEN false END IGNORE NULLS) OVER (PARTITION BY page ORDER BY k ROWS UNBOUNDED PRECEDING) AS est FROM p WHERE layout <> 0),
b AS (SELECT *, CASE WHEN layout = 3 OR k % 6 = 1 THEN 'UNREPORTED' WHEN k % 6 = 3 THEN 'MALFORMED' END AS reason FROM p WHERE layout <> 1)
SELECT page, k * 10 AS line, 'block' AS layout, CASE WHEN reason IS NULL THEN (k % 30000)::double END AS headcount, CASE WHEN reason IS NULL THEN gross END AS gross, CASE WHEN reason IS NULL THEN (k % 4 + 1)::int END AS shows,
  reason IS NULL AND k % 6 = 2 AS estimated, reason FROM b
UNION ALL SELECT page, k * 10 + 9, 'inline', (k % 30000)::double, gross, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END, coalesce(est, false), NULL FROM i WHERE page NOT IN (SELECT page FROM b WHERE reason IS NULL)
"""


def table_records(spark: SparkSession, d: str) -> DataFrame:
    """Rows of charts in two table layouts, a page per market and layout, read by their headers."""
    c = table(spark, d, "customer").select((F.col("c_nationkey") * 2 + F.col("c_custkey") % 2).cast("long").alias("page"), F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")
    cell = lambda *x: F.concat(F.lit("<td class='x'>"), *x, F.lit("</td>"))
    long = F.concat(F.lit("<tr>"), cell(F.col("k")), cell(F.lit("<b>"), F.col("c_name"), F.lit("</b>")), cell(F.col("c_mktsegment")), cell(F.lit("$1,0"), F.col("k") % 90 + 10), F.lit("</tr>"))
    short = F.concat(F.lit("<tr>"), cell(F.col("c_mktsegment")), cell(F.col("c_name")), cell(F.col("k")), F.lit("</tr>"))
    html = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.when(F.col("page") % 2 == 0, long).otherwise(short).alias("row")))), lambda x: x["row"]), "\n")
    heads = F.when(F.col("page") % 2 == 0, "<table><tr><th>Rank</th><th>Artist/Event</th><th>Venue</th><th>Gross Sales</th></tr>").otherwise("<table><tr><th>Venue</th><th>Artist</th><th>Rank</th></tr>")
    pages = c.groupBy("page").agg(html.alias("html")).select("page", F.concat(F.lit("<p>top</p><tr><td>no header yet</td></tr>"), heads, "html", F.lit("</table>")).alias("html"))
    return R.table_records(pages).select("page", F.col("rank").cast("long").alias("rank"), "name", "place", "gross")


TABLE_RECORDS = "SELECT c_nationkey * 2 + c_custkey % 2 AS page, c_custkey AS rank, c_name AS name, c_mktsegment AS place, CASE WHEN (c_nationkey * 2 + c_custkey % 2) % 2 = 0 THEN '$1,0' || (c_custkey % 90 + 10) END AS gross FROM customer"

DEPTHS = 8


def jsonld_events(spark: SparkSession, d: str) -> DataFrame:
    """Claims of event nodes that stand one to eight levels deep in arrays and graphs, of broken blocks and of publication metadata."""
    p, k = table(spark, d, "pages"), F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 1000).cast("int")), "yyyy-MM-dd")
    offers = F.when(k % 3 == 0, F.concat(F.lit('{"price": "'), k % 50, F.lit('"}'))).when(k % 3 == 1, F.concat(F.lit('[{"price": 0, "lowPrice": '), k % 40 + 1, F.lit('}, "x", {"price": 9.5}]'))).otherwise("[]")
    node = F.concat(F.lit('{"@type": "'), F.when(k % 2 == 0, "MusicEvent").otherwise("Event"), F.lit('", "startDate": "'), day, F.lit('T20:00", "presaleStart": "'), F.when(k % 5 == 0, day).otherwise(""), F.lit('", "offers": '), offers, F.lit("}"))
    wrap = lambda level, graph, array: F.when(k % DEPTHS >= level, array if level % 2 else graph).otherwise("")
    before = [wrap(level, '{"name": "g", "@graph": [', '[{"@type": "Thing"}, ') for level in reversed(range(DEPTHS))]
    node = F.concat(*before, node, *(wrap(level, "]}", "]") for level in range(DEPTHS)))
    json = F.when(k % 9 == 8, F.concat(F.lit("{"), node)).otherwise(node)
    meta = F.when(k % 4 == 0, F.concat(F.lit("<meta property='article:published_time' content='"), day, F.lit("T01:00:00Z'><meta property='og:title' content='t'>"))).otherwise("")
    html = F.concat(F.coalesce("html", F.lit("")), meta, F.lit("<script type='application/ld+json'>"), json, F.lit("</script>"))
    return jsonld.event_claims(p.select(k.alias("page"), html.alias("html")))


_path = "'$'" + "".join(f" || CASE WHEN page_id % {DEPTHS} >= {level} THEN '{'[1]' if level % 2 else '.@graph[0]'}' ELSE '' END" for level in reversed(range(DEPTHS)))
JSONLD_EVENTS = f"""
WITH p AS (SELECT page_id AS page, {_path} AS path, strftime(DATE '2020-01-01' + (page_id % 1000)::int, '%Y-%m-%d') AS day FROM pages), ok AS (SELECT * FROM p WHERE page % 9 <> 8)
SELECT page, 0::int AS block, path, 'EVENT_DATE' AS kind, day AS value FROM ok
UNION ALL SELECT page, 0, path, 'PRESALE', day FROM ok WHERE page % 5 = 0
UNION ALL SELECT page, 0, path, 'TICKET_PRICE', (page % 50)::varchar FROM ok WHERE page % 3 = 0 AND page % 50 <> 0
UNION ALL SELECT page, 0, path, 'TICKET_PRICE', (page % 40 + 1)::varchar FROM ok WHERE page % 3 = 1
UNION ALL SELECT page, 0, path, 'TICKET_PRICE', '9.5' FROM ok WHERE page % 3 = 1
UNION ALL SELECT page, 0, NULL, 'BAD_JSON', NULL FROM p WHERE page % 9 = 8
UNION ALL SELECT page, NULL, 'article:published_time', 'RESULT_PUBLICATION', day || 'T01:00:00Z' FROM p WHERE page % 4 = 0
"""

def dump_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of four kinds written as archives and read back through the data source in ranges; broken records keep their problem."""
    json = lambda **fields: F.to_json(F.struct(*(c.alias(k.replace("_", "-")) for k, c in fields.items())))
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    one = lambda df, kind, payload: df.select(F.lit(kind).alias("kind"), payload.alias("payload"))
    c, s, o, n = (table(spark, d, t) for t in ("customer", "supplier", "orders", "nation"))
    artist = F.struct(F.lit("artist").alias("target-type"), F.struct(key("a", "o_custkey").alias("id")).alias("artist"))
    event = json(id=F.when(F.col("o_orderkey") % 89 != 0, key("e", "o_orderkey")), name=F.col("o_orderpriority"), begin_date=F.date_format("o_orderdate", "yyyy-MM-dd"), relations=F.array(artist, artist))
    event = F.when(F.col("o_orderkey") % 97 == 0, F.substring(event, 1, 9)).otherwise(event)
    rows = one(c, "artist", json(id=key("a", "c_custkey"), name=F.col("c_name"), type=F.col("c_mktsegment"))).unionByName(one(s, "place", json(id=key("p", "s_suppkey"), name=F.col("s_name"))))
    rows = rows.unionByName(one(n, "area", json(id=key("n", "n_nationkey"), name=F.col("n_name")))).unionByName(one(o, "event", event))
    folder = new_path(spark, "dump")
    dumps.write_dump(rows, folder, 1 << 18).collect()  # a row per archive
    found = dumps.read_dump(spark, folder, 1 << 16)
    kind = F.regexp_extract("member", "dump/([a-z]+)-", 1)
    return found.select(kind.alias("kind"), "id", "name", "type", "begin", F.array_join("related", ",").alias("related"), "problem")


DUMP_ENTITIES = """
SELECT 'artist' AS kind, 'a' || c_custkey AS id, c_name AS name, c_mktsegment AS type, NULL AS "begin", '' AS related, NULL AS problem FROM customer UNION ALL SELECT 'place', 'p' || s_suppkey, s_name, NULL, NULL, '', NULL FROM supplier
UNION ALL SELECT 'area', 'n' || n_nationkey, n_name, NULL, NULL, '', NULL FROM nation
UNION ALL SELECT 'event', CASE WHEN o_orderkey % 89 <> 0 THEN 'e' || o_orderkey END, o_orderpriority, NULL, strftime(o_orderdate, '%Y-%m-%d'), 'a' || o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN 'NO_ID' END FROM orders WHERE o_orderkey % 97 <> 0
UNION ALL SELECT 'event', NULL, NULL, NULL, NULL, '', 'BAD_JSON' FROM orders WHERE o_orderkey % 97 = 0
"""

QUERIES = {name.lower(): (globals()[name.lower()], globals()[name]) for name in list(globals()) if name.isupper() and name.lower() in globals()}
