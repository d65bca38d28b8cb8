"""Queries over merged identities, similar names, valence of texts, frozen corpora and exact order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitengine.functions import valence as V
from pitengine.operators import editions, folds, graph, selection, similar
from pitengine.session import materialize, new_path
from pitengine.sources import frozen, marts
from pitengine.sources.tables import ENGAGEMENTS_SQL as ENG
from pitengine.sources.tables import engagements, table


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Customers as places, merged by two kinds of claims: same market and near balance, same series and nearer balance."""
    c = table(spark, d, "customer")
    first = lambda *keys: c.groupBy(*(k.alias(f"g{n}") for n, k in enumerate(keys))).agg(F.min("c_custkey").alias("b"))

    def claims(*keys):
        groups = first(*keys)
        on = [k.eqNullSafe(groups[f"g{n}"]) for n, k in enumerate(keys)]
        return c.join(groups, on).select(F.col("c_custkey").alias("a"), "b")

    both = claims(F.col("c_nationkey"), F.floor(F.col("c_acctbal") / 40)).unionByName(claims(F.col("c_mktsegment"), F.floor(F.col("c_acctbal") / 20)))
    return graph.merged(c.select("c_custkey", "c_acctbal"), both, "c_custkey", -F.col("c_acctbal"))


def merged_places(spark: SparkSession, d: str) -> DataFrame:
    """Every place with the one that stands for it (the one of the largest balance), and how many it stands for; none is deleted."""
    return _places(spark, d).select("c_custkey", "canonical", "members", "superseded")


_components_sql = """
WITH RECURSIVE g AS (SELECT c_custkey AS k, c_acctbal AS bal, min(c_custkey) OVER (PARTITION BY c_nationkey, floor(c_acctbal / 40)) AS a, min(c_custkey) OVER (PARTITION BY c_mktsegment, floor(c_acctbal / 20)) AS b FROM customer),
e AS (SELECT k AS x, a AS y FROM g UNION SELECT a, k FROM g UNION SELECT k, b FROM g UNION SELECT b, k FROM g),
r(k, root) AS (SELECT k, k FROM g UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.k),
m AS (SELECT k, min(root) AS root FROM r GROUP BY k), f AS (SELECT root, arg_min(k, (-bal, k)) AS canonical, count(*) AS members FROM m JOIN g USING (k) GROUP BY root)
"""
MERGED_PLACES = _components_sql + "SELECT k AS c_custkey, canonical, members, canonical <> k AS superseded FROM m JOIN f USING (root)"


def merged_facts(spark: SparkSession, d: str) -> DataFrame:
    """Orders counted under the place that stands for theirs, with how many places they came in under."""
    facts = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    moved = graph.repointed(facts, _places(spark, d), "c_custkey")
    return moved.groupBy("canonical").agg(F.count("*").alias("orders"), F.count_distinct("original").alias("places"), F.round(F.sum("o_totalprice"), 2).alias("total"))


MERGED_FACTS = _components_sql + "SELECT canonical, count(*) AS orders, count(DISTINCT o_custkey) AS places, round(sum(o_totalprice), 2) AS total FROM orders JOIN m ON k = o_custkey JOIN f USING (root) GROUP BY 1"

TITLE = 32


def similar_titles(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different document titles (plain letters of the first words up to a length) that are similar by edit distance."""
    names = table(spark, d, "documents").select(F.trim(F.regexp_replace(F.lower(F.substring("text", 1, TITLE)), "[^a-z0-9 ]", "")).alias("name"))
    return similar.similar_pairs(names, names, 0.7).where("a < b").select("a", "b", F.round("similarity", 6).alias("similarity"))


SIMILAR_TITLES = f"""
WITH t AS (SELECT DISTINCT trim(regexp_replace(lower(substr(text, 1, {TITLE})), '[^a-z0-9 ]', '', 'g'), ' ') AS name FROM documents), p AS (SELECT a.name AS a, b.name AS b, greatest(length(a.name), length(b.name)) AS n FROM t a JOIN t b ON a.name < b.name WHERE a.name <> '' AND b.name <> '')
SELECT a, b, round(1 - list_distance / n, 6) AS similarity FROM (SELECT a, b, n, levenshtein(a, b) AS list_distance FROM p) WHERE list_distance <= floor(0.3 * n + 1e-9)
"""


def valence_scores(spark: SparkSession, d: str) -> DataFrame:
    """Valence and label of each document; texts without a listed word have none."""
    scored = V.valence_scores(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return scored.select("id", "hits", F.round("valence", 5).alias("valence"), "label")


def _listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_push = " + ".join(f"CASE WHEN w[i - {k}] IN {_listed(V.RAISING)} AND i > {k} THEN {V.BOOST * damped} WHEN w[i - {k}] IN {_listed(V.LOWERING)} AND i > {k} THEN {-V.BOOST * damped} ELSE 0 END" for k, damped in zip((1, 2, 3), V.DAMPED))
_turned = " OR ".join(f"(i > {k} AND w[i - {k}] IN {_listed(V.NEGATIONS)})" for k in (1, 2, 3))
_valence_sql = f"""
WITH lex(word, weight) AS (VALUES {", ".join(f"('{w}', {v}::double)" for w, v in V.LEXICON.items())}),
t AS (SELECT doc_id, source, lang, list_filter(string_split(regexp_replace(replace(lower(coalesce(text, '')), '''', ''), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, len(w) - coalesce(list_position(list_reverse(w), 'but'), len(w) + 1) + 1 AS but, unnest(range(1, len(w) + 1)) AS i FROM t),
h AS (SELECT doc_id, i, but, (weight + sign(weight) * ({_push})) * CASE WHEN {_turned} THEN {V.NEGATED} ELSE 1 END AS v FROM p JOIN lex ON word = w[i]),
s AS (SELECT doc_id, count(*) AS hits, sum(CASE WHEN but = 0 THEN v WHEN i < but THEN v * 0.5 ELSE v * 1.5 END) AS s FROM h GROUP BY 1),
o AS (SELECT t.doc_id AS id, source, lang, coalesce(hits, 0) AS hits, s / sqrt(s * s + {V.SPREAD}) AS v FROM t LEFT JOIN s USING (doc_id)),
l AS (SELECT *, CASE WHEN v >= {V.CLEAR} THEN 'positive' WHEN v <= -{V.CLEAR} THEN 'negative' WHEN v IS NOT NULL THEN 'neutral' END AS label FROM o)
"""
VALENCE_SCORES = _valence_sql + "SELECT id, hits, round(v, 5) AS valence, label FROM l"


def valence_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Label shares, mean, dispersion and evidence tier of each language's documents; sources are the platforms."""
    docs = table(spark, d, "documents")
    scored = V.valence_scores(docs.select(F.struct("lang", "source").alias("id"), "text")).select("id.lang", F.col("id.source").alias("platform"), "valence", "label")
    out = V.cohort_features(scored, ["lang"])
    return out.withColumns({c: F.round(c, 4) for c in ("positive_share", "negative_share", "neutral_share", "mean", "dispersion")})


VALENCE_COHORTS = _valence_sql + """
SELECT lang, count(*) AS mentions, count(label) AS scored, round(count(*) FILTER (label = 'positive') / nullif(count(label), 0), 4) AS positive_share, round(count(*) FILTER (label = 'negative') / nullif(count(label), 0), 4) AS negative_share,
  round(count(*) FILTER (label = 'neutral') / nullif(count(label), 0), 4) AS neutral_share, round(avg(v), 4) AS mean, CASE WHEN count(v) > 1 THEN round(stddev_pop(v), 4) END AS dispersion,
  CASE WHEN count(DISTINCT source) >= 2 AND count(label) / count(*) >= 0.5 THEN 'high' WHEN count(label) > 0 THEN 'medium' ELSE 'low' END AS tier FROM l GROUP BY lang
"""


def frozen_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A corpus frozen with its manifest, loaded with the check, and its rows and digest per market and in all."""
    corpus = engagements(spark, d).select("id", F.col("market").cast("long").alias("market"), F.col("pub_date").cast("string").alias("published"), "series", F.round("gross", 2).cast("decimal(15,2)").alias("gross"))
    folder = new_path(spark, "frozen")
    frozen.freeze(corpus, folder, "v1")
    loaded = frozen.load(spark, folder, "v1")
    return frozen.table_digest(loaded).select(F.lit("all").alias("part"), "rows", "digest").unionByName(frozen.table_digest(loaded.where("market = 3")).select(F.lit("3").alias("part"), "rows", "digest"))


_mark = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '~')"
FROZEN_CORPUS = ENG + f""",
c AS (SELECT market, sha256({_mark("round(gross, 2)::decimal(15,2)")} || {_mark("id")} || {_mark("market")} || {_mark("pub_date")} || {_mark("series")}) AS h FROM eng),
n AS (SELECT market, ('0x' || h[1:16])::ubigint::hugeint AS a, ('0x' || h[17:32])::ubigint::hugeint AS b FROM c),
s AS (SELECT 'all' AS part, count(*) AS rows, sum(a) AS a, sum(b) AS b FROM n UNION ALL SELECT '3', count(*), coalesce(sum(a), 0), coalesce(sum(b), 0) FROM n WHERE market = 3)
SELECT part, rows, format('{{:016x}}', (a % 18446744073709551616)::ubigint) || format('{{:016x}}', (b % 18446744073709551616)::ubigint) AS digest FROM s
"""

#: Values of a key from which the search by ranges is used: small, so that the test tables reach it.
SMALL_KEY = 200


def exact_medians(spark: SparkSession, d: str) -> DataFrame:
    """Exact medians of gross of all engagements, by market and by status, of headcounts (many ties) by status."""
    eng = engagements(spark, d)
    each = lambda name, key, value: F.struct(F.lit(name).alias("of"), key.cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    asked = F.array(each("gross", F.lit(None), "gross"), each("market", F.col("market"), "gross"), each("status", F.col("status"), "gross"), each("headcount", F.col("status"), "headcount"))
    # written once: all medians are found in one search, whose passes read it
    rows = materialize(eng.select(F.explode(asked).alias("a")).select("a.*"), "median_values")
    return selection.exact_medians(rows, ["of", "key"], "value", SMALL_KEY).select("of", "key", "n", F.round("median", 4).alias("median"))


EXACT_MEDIANS = ENG + """
SELECT 'gross' AS of, NULL AS key, count(gross) AS n, round(median(gross), 4) AS median FROM eng UNION ALL SELECT 'market', market::varchar, count(gross), round(median(gross), 4) FROM eng GROUP BY market HAVING count(gross) > 0
UNION ALL SELECT 'status', status, count(gross), round(median(gross), 4) FROM eng GROUP BY status HAVING count(gross) > 0 UNION ALL SELECT 'headcount', status, count(headcount), round(median(headcount), 4) FROM eng GROUP BY status HAVING count(headcount) > 0
"""

def incremental_mart(spark: SparkSession, d: str) -> DataFrame:
    """A mart of orders per customer after three appends, each refresh reading its new files only; it equals a full rebuild."""
    folder = new_path(spark, "mart")
    mart = marts.Mart(folder, ("o_custkey",), sums=("o_totalprice",), ranges=("o_orderdate",))
    orders = table(spark, d, "orders")
    for k in range(3):
        orders.where(F.col("o_orderkey") % 3 == k).write.mode("append").parquet(f"{folder}/source")
        marts.refresh(spark, mart, f"{folder}/source")
    log = marts.runs(spark, mart).where("status = 'REFRESHED'").agg(F.sum("rows_read").alias("rows_read"), F.max("version").alias("version"))
    out = marts.read(spark, mart).crossJoin(F.broadcast(log))  # log is one row
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select("o_custkey", "n", F.round("sum_o_totalprice", 2).alias("total"), F.floor(F.col("mean_o_totalprice") + 0.31371).alias("mean"), day("low_o_orderdate").alias("first_day"), day("high_o_orderdate").alias("last_day"), "rows_read", "version")


INCREMENTAL_MART = """
SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, floor(avg(o_totalprice) + 0.31371)::bigint AS mean, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day,
  (SELECT count(*) FROM orders) AS rows_read, '3' AS version FROM orders GROUP BY 1
"""

HOW_MANY = 5


def group_folds(spark: SparkSession, d: str) -> DataFrame:
    """Customers in five folds that share no group of near balances within a market, nor of nearer ones within a series."""
    c = table(spark, d, "customer").select("c_custkey", F.concat_ws("|", "c_nationkey", F.floor(F.col("c_acctbal") / 40)).alias("a"), F.concat_ws("|", "c_mktsegment", F.floor(F.col("c_acctbal") / 20)).alias("b"))
    out = folds.group_folds(c, ["a", "b"], HOW_MANY)
    size = out.groupBy("component").agg(F.count("*").alias("size"))
    return out.join(size, "component").select("c_custkey", "fold", "size")


GROUP_FOLDS = f"""
WITH RECURSIVE g AS (SELECT c_custkey AS k, '000:' || c_nationkey || '|' || floor(c_acctbal / 40)::bigint AS a, '001:' || c_mktsegment || '|' || floor(c_acctbal / 20)::bigint AS b FROM customer),
e AS (SELECT a AS x, b AS y FROM g UNION SELECT b, a FROM g), r(v, root) AS (SELECT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.v), m AS (SELECT v, min(root) AS root FROM r GROUP BY v),
s AS (SELECT root, count(*) AS size FROM g JOIN m ON v = a GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY size DESC, root) - 1 AS place FROM s)
SELECT k AS c_custkey, CASE WHEN place // {HOW_MANY} % 2 = 0 THEN place % {HOW_MANY} ELSE {HOW_MANY - 1} - place % {HOW_MANY} END::int AS fold, size FROM g JOIN m ON v = a JOIN o USING (root)
"""


def time_cut(spark: SparkSession, d: str) -> DataFrame:
    """Engagements cut in time at the day of the row at four fifths of all; later ones test."""
    out = folds.time_cut(engagements(spark, d).withColumn("day", F.when(F.col("id") % 20 != 3, F.col("start_date"))), "day")
    return out.groupBy("part").agg(F.count("*").alias("n"), F.count("day").alias("dated"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


TIME_CUT = ENG + """, s AS (SELECT id, CASE WHEN id % 20 <> 3 THEN start_date END AS day FROM eng), o AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS place, count(*) OVER () AS n FROM s WHERE day IS NOT NULL),
c AS (SELECT day AS cut FROM o WHERE place = floor(n * 0.8))
SELECT CASE WHEN day <= cut THEN 'TRAIN' ELSE 'TEST' END AS part, count(*) AS n, count(day) AS dated, min(day) AS first_day, max(day) AS last_day FROM s, c GROUP BY 1
"""


def _lineup(spark: SparkSession, d: str) -> DataFrame:
    """Customers billed in their series and market by year, with what they spent; attention is known for four of five."""
    e = engagements(spark, d).where("start_date IS NOT NULL").groupBy("series", "market", F.year("start_date").alias("year"), "entity").agg(F.round(F.sum("gross"), 0).cast("long").alias("spent"))
    return e.select(F.concat_ws(" ", "series", "market").alias("festival"), "year", "entity", "spent", F.when(F.col("entity") % 5 != 0, F.col("spent")).alias("attention"))


_lineup_sql = ENG + """, lineup AS (SELECT series || ' ' || market AS festival, year(start_date)::int AS year, entity, round(sum(gross))::bigint AS spent FROM eng WHERE start_date IS NOT NULL GROUP BY ALL)"""


def billing_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's tier in a festival by year: entries, moves, missed years and unbroken runs."""
    tier = F.when(F.col("spent") >= 300_000, 1).when(F.col("spent") >= 150_000, 2).otherwise(3)
    billed = _lineup(spark, d).select("festival", "entity", "year", tier.alias("tier"))
    return editions.trajectories(billed, ["festival", "entity"])


BILLING_TRAJECTORY = _lineup_sql + """, t AS (SELECT festival, entity, year, CASE WHEN spent >= 300000 THEN 1 WHEN spent >= 150000 THEN 2 ELSE 3 END AS tier FROM lineup),
w AS (SELECT *, lag(year) OVER p AS before, lag(tier) OVER p AS last, year - row_number() OVER p AS island FROM t WINDOW p AS (PARTITION BY festival, entity ORDER BY year))
SELECT festival, entity, year, tier, coalesce(year - before - 1, 0)::int AS gap, CASE WHEN before IS NULL THEN 'ENTRY' WHEN year > before + 1 THEN 'RETURN' WHEN tier < last THEN 'UP' WHEN tier > last THEN 'DOWN' ELSE 'SAME' END AS move,
  dense_rank() OVER (PARTITION BY festival, entity ORDER BY island)::int AS run FROM w
"""


def edition_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of editions after new rows came in: only editions whose own or compared inputs changed are computed again."""
    # written once: a sum of doubles may round otherwise when it is added up in another order, and would look changed
    lineup = materialize(_lineup(spark, d).drop("spent"), "lineup")
    before = lineup.where("NOT (year = 1996 AND entity % 7 = 0)")
    stored = materialize(editions.edition_metrics(before, editions.input_hashes(before)), "edition_metrics")
    out = editions.refreshed_metrics(lineup, stored)
    return out.select("festival", "year", "compared", "artists", F.round("coverage", 6).alias("coverage"), F.round("hhi", 6).alias("hhi"), F.round("jaccard", 6).alias("jaccard"), "missing", "recomputed")


EDITION_METRICS = _lineup_sql + """, l AS (SELECT festival, year, entity, CASE WHEN entity % 5 <> 0 THEN spent END AS attention FROM lineup),
m AS (SELECT festival, year, count(*) AS artists, count(attention) AS known, sum(attention::double * attention) / nullif(sum(attention::double) ** 2, 0) AS hhi, bool_or(year = 1996 AND entity % 7 = 0) AS touched, bool_and(year = 1996 AND entity % 7 = 0) AS new FROM l GROUP BY ALL),
c AS (SELECT *, lag(year) OVER p AS compared, lag(touched) OVER p AS other, lag(artists) OVER p AS others, lag(year) OVER p IS DISTINCT FROM (CASE WHEN lag(new) OVER p THEN lag(year, 2) OVER p ELSE lag(year) OVER p END) AS moved FROM m WINDOW p AS (PARTITION BY festival ORDER BY year)),
s AS (SELECT a.festival, a.year, count(*) AS shared FROM l a JOIN c USING (festival, year) JOIN l b ON b.festival = a.festival AND b.year = c.compared AND b.entity = a.entity GROUP BY ALL)
SELECT festival, year, compared, artists, round(known / artists, 6) AS coverage, round(hhi, 6) AS hhi, CASE WHEN compared IS NOT NULL THEN round(coalesce(shared, 0) / (artists + others - coalesce(shared, 0)), 6) END AS jaccard,
  known = 0 AS missing, touched OR coalesce(other, false) OR moved AS recomputed FROM c LEFT JOIN s USING (festival, year)
"""

QUERIES = {name.lower(): (globals()[name.lower()], globals()[name]) for name in list(globals()) if name.isupper() and name.lower() in globals()}
