"""Record parsers and the JSON-LD walk on small pages."""

import datetime as dt

from pitengine.operators import jsonld
from pitengine.sources import records as R

D = dt.date


def read(spark, parser, *pages, auto=False):
    rows = [(p, k, t) for p, text in enumerate(pages) for k, t in enumerate(text.split("\n"))]
    lines = spark.createDataFrame(rows, "page long, line long, text string")
    out = R.auto_records(lines) if auto else R.records(lines, parser)
    return sorted(out.collect(), key=lambda r: (r.page, r.line))


def test_pairs_and_tiers(spark):
    body = "Tickets Sold: 15,000; Venue: United Center, Chicago; Gross: $1,234,567; Ticket Range: $49.50 - $199.50; Promoter: AEG Live; Dates: Oct. 26, 2013; No. of Shows: 1"
    a, b = read(spark, R.PairedLines, f"10,001 - 15,000 Capacity\n1) Taylor\n{body}\n2) Left over", f"{body}")[:2]
    assert (a.rank, a.name, a.place, a.city, a.tier, a.headcount, a.gross, a.low, a.high, a.promoter, a.shows, a.first_day, a.reason) == (1, "Taylor", "United Center", "Chicago", "10,001 - 15,000 Capacity", 15000.0, 1234567.0, 49.5, 199.5, "AEG Live", 1, D(2013, 10, 26), None)
    assert (b.line, b.name, b.reason) == (3, "Left over", "NO_BODY")
    assert [r.reason for r in read(spark, R.PairedLines, body)] == ["NO_HEAD"]


def test_blocks_and_inline_lines(spark):
    block = "intro\nMarch 5-7, 2024\nZach\nUnited Center\nChicago, United States\n$12,648,557\n56,931 (100%)\n3 shows\nMay 30 - June 2, 2024\nX\nY\nZ\n~$5\n10\n1 show\nJune 1, 2024\nX"
    a, b, c = read(spark, R.Blocks, block)
    assert (a.line, a.name, a.headcount, a.sell_through, a.shows, a.first_day, a.last_day, a.estimated) == (1, "Zach", 56931.0, 100.0, 3, D(2024, 3, 5), D(2024, 3, 7), False)
    assert (b.first_day, b.last_day, b.gross, b.estimated, b.reason) == (D(2024, 5, 30), D(2024, 6, 2), 5.0, True, None) and c.reason == "INCOMPLETE"
    lines = "October 22, 2019: United Center, Chicago, IL (15,000 – $2,000,000)\nTotal Estimated Gross: $40,000,000\nOctober 23-24, 2019: United Center, Chicago, IL (14,500 – $1,900,000) (2 shows)\nOctober 25, 2019: A, B (x – y)\nnothing here"
    a, b, c = read(spark, R.Inline, lines)
    assert (a.place, a.city, a.headcount, a.gross, a.shows, a.estimated) == ("United Center", "Chicago, IL", 15000.0, 2000000.0, 1, False)
    assert (b.shows, b.estimated, b.last_day, c.reason) == (2, True, D(2019, 10, 24), "MALFORMED")
    kinds = [(r.page, r.layout) for r in read(spark, None, block, lines, block + "\n" + lines, auto=True)]
    assert {k for k in kinds} == {(0, "block"), (1, "inline"), (2, "block")}


def test_a_page_of_many_lines_streams(spark):
    from pyspark.sql import functions as F

    lines = spark.range(100_002).select(F.lit(7).cast("long").alias("page"), F.col("id").alias("line"), F.element_at(F.array(*map(F.lit, ("May 1, 2024", "A", "B", "C", "$1", "2 (3%)", "4 shows"))), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    out = R.records(lines, R.Blocks)
    assert out.count() == 14286 and out.where("headcount = 2 AND shows = 4").count() == 14286


def test_pages_that_share_a_task_stay_apart(spark):
    """Lines go to a parser in Arrow batches: a page ends where the next begins, also a NULL one and in the middle of a record, and odd lines stop nothing."""
    block = ("May 1, 2024", "A", "B", "C", "$1", "2 (3%)", "4 shows")
    rows = [(p, k, t) for p in (1, 2, 3) for k, t in enumerate(block[: 7 if p != 2 else 3])] + [(None, k, t) for k, t in enumerate((None, "", *block[:2]))]
    lines = spark.createDataFrame(rows, "page long, line long, text string").repartition(3)
    read = R.records(lines, R.Blocks)
    assert "MapInArrow" in read._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = {(r.page, r.line, r.name, r.headcount, r.shows, r.reason) for r in R.records(lines, R.Blocks).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == {(1, 0, "A", 2.0, 4, None), (3, 0, "A", 2.0, 4, None), (2, 0, "A", None, None, "INCOMPLETE"), (None, 2, "A", None, None, "INCOMPLETE")}
    long = spark.createDataFrame([(1, 1, "99999999999) Act")], "page int, line int, text string")
    assert [(r["rank"], r.name, r.reason) for r in R.records(long, R.PairedLines).collect()] == [(None, "Act", "NO_BODY")]


def test_jsonld_walk(spark):
    script = lambda j: f"<script async type=\"application/ld+json\">{j}</script>"
    nested = '[[{"@type":"event","startDate":"2024-01-02T10:00"}],{"@graph":{"@type":"Event","startDate":"2024-02-02"}},{"@graph":[1,"x",{"@type":"Event","@graph":[{"@type":"Event","ticketSaleStart":"2024-03-03"}],"offers":{"price":0,"lowPrice":12}}]}]'
    pages = [(1, script(nested) + "<p>" + script("{broken")), (2, "<meta content='2024-05-05' property='article:modified_time'>"), (3, None), (4, script('{"@type":"Person"}')), (5, script("7"))]
    got = sorted(map(str, jsonld.event_claims(spark.createDataFrame(pages, "page long, html string")).collect()))
    assert len(got) == 5
    text = "\n".join(got)
    for part in ("path='$[0][0]', kind='EVENT_DATE', value='2024-01-02'", "path='$[2].@graph[2].@graph[0]', kind='GENERAL_ONSALE', value='2024-03-03'", "path='$[2].@graph[2]', kind='TICKET_PRICE', value='12'", "block=1, path=None, kind='BAD_JSON'", "kind='RESULT_PUBLICATION', value='2024-05-05'"):
        assert part in text


def test_tables_by_their_headers(spark):
    html = "<table><TR><TH>Rank</TH><th>Artist</th><th>Venue</th></TR><tr><td>1</td><td><b>A</b> B</td><td></td></tr><tr><th>Venue</th><th>Rank</th><th>Gross</th></tr><tr><td>V</td><td>2</td><td>$5</td></tr></table>"
    got = R.table_records(spark.createDataFrame([(1, html), (2, None), (3, "<p>no table</p>")], "page long, html string")).orderBy("row").collect()
    assert [(r["rank"], r.name, r.place, r.gross) for r in got] == [("1", "A B", None, None), ("2", None, "V", "$5")]
