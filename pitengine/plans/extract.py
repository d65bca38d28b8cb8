"""Claims from text: outcome candidates, date language, infobox fields, and the rows of plans, tasks and forward events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitengine.functions import forms as V
from pitengine.sources.tables import ENGAGEMENTS_SQL as ENG
from pitengine.sources.tables import engagements, table

#: Patterns of outcome statements, what they state, and the words that void one.
OUTCOMES = (("PAID", r"([\d,]+) paid"), ("SCANNED", r"([\d,]+) scanned"), ("ATTENDANCE", r"attendance of ([\d,]+)"), ("CAPACITY", r"capacity of ([\d,]+)"), ("GROSS", r"\$([\d,]+)"))
VOID = r"\b(not|expected|up to)\b"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A sentence per order as a page states it."""
    o = table(spark, d, "orders")
    n = F.format_number(F.round("o_totalprice").cast("long"), 0)
    k = F.col("o_orderkey") % 7
    text = F.when(k == 0, F.concat(F.lit("The show had "), n, F.lit(" paid and a capacity of 9,000"))).when(k == 1, F.concat(F.lit("An attendance of "), n, F.lit(" was reported"))).when(k == 2, F.concat(F.lit("It is expected to draw an attendance of "), n)).when(k == 3, F.concat(F.lit("It took $"), n, F.lit(" at the door"))).when(k == 4, F.lit("sold out in an hour")).when(k == 5, F.lit("not sold out")).otherwise("a quiet night")
    return o.select(F.col("o_orderkey").alias("page"), text.alias("text"), F.to_date("o_orderdate").alias("published"))


_pages_sql = """
WITH o AS (SELECT o_orderkey AS page, o_orderkey % 7 AS k, round(o_totalprice)::bigint AS n, o_orderdate::date AS published FROM orders)
"""


def outcome_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Typed candidates in each page's text, with its value, and a flag where a negation or an expectation voids it."""
    pages = _pages(spark, d)
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(kind).alias("kind"), F.replace(F.regexp_extract("text", p, 1), F.lit(","), F.lit("")).cast("long").alias("value"))) for kind, p in OUTCOMES)))
    return pages.select("page", F.explode(found).alias("c"), F.col("text").rlike(VOID).alias("void")).select("page", "c.kind", "c.value", F.when(F.col("void"), "REVIEW").otherwise("CANDIDATE").alias("state"))


OUTCOME_CANDIDATES = _pages_sql + """
SELECT page, 'PAID' AS kind, n AS value, 'CANDIDATE' AS state FROM o WHERE k = 0 UNION ALL SELECT page, 'CAPACITY', 9000, 'CANDIDATE' FROM o WHERE k = 0 UNION ALL SELECT page, 'ATTENDANCE', n, 'CANDIDATE' FROM o WHERE k = 1
UNION ALL SELECT page, 'ATTENDANCE', n, 'REVIEW' FROM o WHERE k = 2 UNION ALL SELECT page, 'GROSS', n, 'CANDIDATE' FROM o WHERE k = 3
"""


def sold_out_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Sold out by explicit words only: asserted, denied, or unknown."""
    t = F.col("text")
    state = F.when(t.rlike(r"\bnot sold out\b"), "DENIED").when(t.rlike(r"\bsold out\b"), "ASSERTED").otherwise("UNKNOWN")
    return _pages(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("pages"), F.min("page").alias("first_page"))


SOLD_OUT_EVIDENCE = _pages_sql + "SELECT CASE k WHEN 5 THEN 'DENIED' WHEN 4 THEN 'ASSERTED' ELSE 'UNKNOWN' END AS state, count(*) AS pages, min(page) AS first_page FROM o GROUP BY 1"


def date_language(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of a sale's start in text: the words, where they stand, and the day they mean; phrases without a day stay out."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.to_date("o_orderdate").alias("day"))
    text = F.when(F.col("page") % 4 == 0, F.concat(F.lit("Tickets go on sale "), F.date_format("day", "MMMM d, yyyy"), F.lit("."))).when(F.col("page") % 4 == 1, F.concat(F.lit("On sale "), F.date_format("day", "EEEE"), F.lit(" morning"))).when(F.col("page") % 4 == 2, F.lit("On sale soon")).otherwise(F.concat(F.lit("Announced "), F.date_format("day", "MMMM d, yyyy")))
    p = r"(?i)\bon sale ((?:[a-z]+ \d{1,2}, \d{4})|(?:mon|tues|wednes|thurs|fri|satur|sun)day)"
    rows = o.withColumn("text", text).withColumn("phrase", F.regexp_extract("text", p, 1)).where("phrase <> ''")
    return rows.select("page", F.lower("phrase").alias("phrase"), (F.instr("text", F.col("phrase")) - 1).cast("long").alias("at"), V.date_phrase(F.col("phrase"), F.date_add("day", -3)).alias("day"))


DATE_LANGUAGE = "SELECT o_orderkey AS page, lower(CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y') ELSE strftime(o_orderdate, '%A') END) AS phrase, CASE o_orderkey % 4 WHEN 0 THEN 19 ELSE 8 END AS at, o_orderdate::date AS day FROM orders WHERE o_orderkey % 4 < 2"


def infobox_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a place's infobox: names and values without links, references and templates; empty ones left out."""
    s = table(spark, d, "supplier")
    box = F.concat(F.lit("{{Infobox venue\n| name = [[X|"), "s_name", F.lit("]]<ref>a</ref>\n| capacity = {{nowrap|x}} "), F.floor("s_acctbal").cast("string"), F.lit("\n| city =\n| nation = "), F.col("s_nationkey").cast("string"), F.lit("\n}}"))
    lines = s.select("s_suppkey", F.explode(F.regexp_extract_all(box, F.lit(r"\n\| *([a-z_]+ *=[^\n]*)"), F.lit(1))).alias("line"))
    return lines.select("s_suppkey", F.trim(F.substring_index("line", "=", 1)).alias("field"), V.wikitext(F.regexp_replace("line", "^[^=]*=", "")).alias("value")).where("value <> ''")


INFOBOX_FIELDS = "SELECT s_suppkey, 'name' AS field, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'capacity', floor(s_acctbal)::bigint::varchar FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::varchar FROM supplier"


def hunt_plan(spark: SparkSession, d: str) -> DataFrame:
    """One task per missing field of each engagement, known days first, with what is attempted, done and pending."""
    e = engagements(spark, d)
    tasks = F.array_compact(F.array(*(F.when(F.col(c).isNull() | F.lit(always), F.lit(name)) for name, c, always in (("HEADCOUNT", "headcount", False), ("SETTLEMENT", "id", True), ("SELL_OUT", "sold_out", False)))))
    rows = e.select("id", F.col("start_date").isNotNull().alias("dated"), F.explode(tasks).alias("field"))
    state = F.when(F.col("id") % 4 == 0, "DONE").when(F.col("id") % 4 == 1, "BLOCKED").otherwise("PENDING")
    return rows.groupBy("field", "dated").agg(F.count("*").alias("tasks"), F.count_if(state != "PENDING").alias("attempted"), F.count_if(state == "DONE").alias("done"), F.min("id").alias("first_id"))


HUNT_PLAN = ENG + ", t AS (SELECT id, start_date IS NOT NULL AS dated, unnest(list_filter([CASE WHEN headcount IS NULL THEN 'HEADCOUNT' END, 'SETTLEMENT', CASE WHEN sold_out IS NULL THEN 'SELL_OUT' END], lambda x: x IS NOT NULL)) AS field FROM eng) SELECT field, dated, count(*) AS tasks, count(*) FILTER (id % 4 < 2) AS attempted, count(*) FILTER (id % 4 = 0) AS done, min(id) AS first_id FROM t GROUP BY ALL"


def guarded_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that state a capacity as an attendance, or a part as a whole, are set apart; the rest pass."""
    e = engagements(spark, d).where("headcount IS NOT NULL")
    definition = F.element_at(F.array(*map(F.lit, ("REPORTED_ATTENDANCE", "PAID_TICKETS", "CAPACITY"))), (F.col("id") % 3 + 1).cast("int"))
    why = F.when((definition == "CAPACITY") & F.col("sold_out"), "CAPACITY_AS_ATTENDANCE").when((definition == "PAID_TICKETS") & (F.col("shows") > 5), "PART_AS_WHOLE").otherwise("PASSED")
    return e.groupBy(definition.alias("definition"), why.alias("guard")).agg(F.count("*").alias("n"))


GUARDED_CLAIMS = ENG + ", g AS (SELECT ['REPORTED_ATTENDANCE', 'PAID_TICKETS', 'CAPACITY'][id % 3 + 1] AS definition, sold_out, shows FROM eng WHERE headcount IS NOT NULL) SELECT definition, CASE WHEN definition = 'CAPACITY' AND sold_out THEN 'CAPACITY_AS_ATTENDANCE' WHEN definition = 'PAID_TICKETS' AND shows > 5 THEN 'PART_AS_WHOLE' ELSE 'PASSED' END AS guard, count(*) AS n FROM g GROUP BY ALL"


def blind_export(spark: SparkSession, d: str) -> DataFrame:
    """Two manifests of a study, inputs and sealed outcomes, and how many claims stand in both (none may)."""
    e = engagements(spark, d)
    inputs = e.where("start_date >= '1997-01-01'").select("id", F.explode(F.array(*map(F.lit, ("place", "market", "series", "shows")))).alias("claim"))
    sealed = e.where("start_date >= '1997-01-01'").select("id", F.explode(F.array(*map(F.lit, ("headcount", "gross", "sold_out")))).alias("claim"))
    both = inputs.join(sealed, ["id", "claim"], "left_semi").agg(F.lit("both").alias("manifest"), F.count("*").alias("claims"), F.count_distinct("id").alias("events"))
    one = lambda rows, name: rows.agg(F.lit(name).alias("manifest"), F.count("*").alias("claims"), F.count_distinct("id").alias("events"))
    return one(inputs, "inputs").unionByName(one(sealed, "sealed")).unionByName(both)


BLIND_EXPORT = ENG + ", n AS (SELECT count(*) AS n FROM eng WHERE start_date >= '1997-01-01') SELECT 'inputs' AS manifest, 4 * n AS claims, n AS events FROM n UNION ALL SELECT 'sealed', 3 * n, n FROM n UNION ALL SELECT 'both', 0, 0"

QUERIES = {name.lower(): (globals()[name.lower()], globals()[name]) for name in list(globals()) if name.isupper() and name.lower() in globals()}
