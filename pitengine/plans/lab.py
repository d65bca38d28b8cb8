"""The experiment ladder: features, split, standardising, predictors, controls, ablation and verdicts; and price, capacity and rights rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitengine.functions.stats import regression_metrics, safe_ratio
from pitengine.operators import models as M
from pitengine.operators import pit
from pitengine.sources.tables import ENGAGEMENTS_SQL as ENG
from pitengine.sources.tables import SNAPSHOTS_SQL as SNAP
from pitengine.sources.tables import engagements, snapshots, table

#: The day that parts training from test rows, and the strength of pooling.
SPLIT, STRENGTH = "1997-06-01", 5.0
FEATURES = ("shows", "entity_mean", "place_mean")


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one target (headcount) with their fold, and history that training rows published before them."""
    e = engagements(spark, d).where("headcount IS NOT NULL AND start_date IS NOT NULL")
    e = e.select("id", "entity", "place", "market", "start_date", "pub_date", "headcount", F.col("shows").cast("double").alias("shows"), F.when(F.col("start_date") < SPLIT, "TRAIN").otherwise("TEST").alias("fold"))
    rows = e
    for key in ("entity", "place"):
        past = e.where("fold = 'TRAIN'").select(key, "start_date", "pub_date", "id", F.col("headcount").alias("value"))
        rows = pit.prior_totals(rows, past, [key]).withColumnsRenamed({"prior_count": f"{key}_n", "prior_sum": f"{key}_sum"}).drop("prior_last", "prior_last_start")
    base = e.where("fold = 'TRAIN'").agg(F.avg("headcount").alias("global_mean"))
    rows = rows.crossJoin(F.broadcast(base))  # base is one row
    mean = lambda k: F.coalesce(safe_ratio(F.col(f"{k}_sum"), F.col(f"{k}_n")), F.col("global_mean"))
    pooled = lambda k: (F.coalesce(F.col(f"{k}_sum"), F.lit(0.0)) + STRENGTH * F.col("global_mean")) / (F.col(f"{k}_n") + STRENGTH)
    return rows.withColumns({"entity_mean": mean("entity"), "place_mean": mean("place"), "pooled": F.when(F.col("entity_n") > 0, pooled("entity")).when(F.col("place_n") > 0, pooled("place")).otherwise(F.col("global_mean"))})


_features_sql = ENG + f""",
e AS (SELECT id, entity, place, market, start_date, pub_date, headcount, shows::double AS shows, CASE WHEN start_date < '{SPLIT}' THEN 'TRAIN' ELSE 'TEST' END AS fold FROM eng WHERE headcount IS NOT NULL AND start_date IS NOT NULL),
g AS (SELECT avg(headcount) AS global_mean FROM e WHERE fold = 'TRAIN'),
a AS (SELECT t.id, count(h.id) AS entity_n, sum(h.headcount) AS entity_sum FROM e t LEFT JOIN e h ON h.entity = t.entity AND h.fold = 'TRAIN' AND h.pub_date < t.start_date GROUP BY t.id),
b AS (SELECT t.id, count(h.id) AS place_n, sum(h.headcount) AS place_sum FROM e t LEFT JOIN e h ON h.place = t.place AND h.fold = 'TRAIN' AND h.pub_date < t.start_date GROUP BY t.id),
f AS (SELECT e.*, entity_n, place_n, global_mean, coalesce(entity_sum / nullif(entity_n, 0), global_mean) AS entity_mean, coalesce(place_sum / nullif(place_n, 0), global_mean) AS place_mean,
        CASE WHEN entity_n > 0 THEN (entity_sum + {STRENGTH} * global_mean) / (entity_n + {STRENGTH}) WHEN place_n > 0 THEN (place_sum + {STRENGTH} * global_mean) / (place_n + {STRENGTH}) ELSE global_mean END AS pooled FROM e JOIN a USING (id) JOIN b USING (id), g)
"""


def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    """Features of each row, standardised by mean and population deviation of the training rows (a deviation of 0 counts as 1)."""
    rows = _features(spark, d)
    stats = rows.where("fold = 'TRAIN'").agg(*(x for c in FEATURES for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))))
    scaled = [F.round((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0), 4).alias(c) for c in FEATURES]
    return rows.crossJoin(F.broadcast(stats)).select("id", "fold", *scaled)  # stats is one row


FEATURE_VECTOR = _features_sql + ", s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES) + " FROM f WHERE fold = 'TRAIN') SELECT id, fold, " + ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 4) AS {c}" for c in FEATURES) + " FROM f, s"


def _predictions(rows: DataFrame, shuffled: bool = False) -> DataFrame:
    """Test rows with the guesses of each predictor, clipped to what training targets allow."""
    train = rows.where("fold = 'TRAIN'").withColumn("one", F.lit("x"))
    bounds = train.agg((0.05 * F.min("headcount")).alias("low"), (50 * F.max("headcount")).alias("high"))
    y = F.log("headcount")
    fit = M.solve(M.normal_equations(train.withColumn("log_y", y), ["one"], ["shows"], "log_y"), ["one"]).select(F.col("coefficients")[0].alias("b0"), F.col("coefficients")[1].alias("b1"))
    test = rows.where("fold = 'TEST'").crossJoin(F.broadcast(bounds)).crossJoin(F.broadcast(fit))  # one row each
    clip = lambda c: F.least(F.greatest(c, F.col("low")), F.col("high"))
    guesses = {"global_mean": F.col("global_mean"), "entity_mean": F.col("entity_mean"), "place_mean": F.col("place_mean"), "partial_pooling": F.col("pooled"), "log_linear": clip(F.exp(F.col("b0") + F.col("b1") * F.col("shows")))}
    entries = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), g.alias("guess")) for n, g in guesses.items())))
    return test.select("id", "entity", "headcount", entries.alias("p")).select("id", "entity", "headcount", "p.model", "p.guess")


_predictions_sql = _features_sql + """,
k AS (SELECT 0.05 * min(headcount) AS low, 50 * max(headcount) AS high, regr_intercept(ln(headcount), shows) AS b0, regr_slope(ln(headcount), shows) AS b1 FROM f WHERE fold = 'TRAIN'),
p AS (SELECT id, entity, headcount, unnest([{'m': 'global_mean', 'g': global_mean}, {'m': 'entity_mean', 'g': entity_mean}, {'m': 'place_mean', 'g': place_mean}, {'m': 'partial_pooling', 'g': pooled}, {'m': 'log_linear', 'g': least(greatest(exp(b0 + b1 * shows), low), high)}]) AS p FROM f, k WHERE fold = 'TEST')
"""


def evaluate_split(spark: SparkSession, d: str) -> DataFrame:
    """The ladder of predictors on one target and split: errors of each, and its place by mean absolute error."""
    out = regression_metrics(_predictions(_features(spark, d)), "headcount", "guess", ["model"])
    place = F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.round("mae", 6)))  # five rows
    return out.select("model", "n", *(F.round(c, 5).alias(c) for c in ("mae", "rmse", "wape", "bias")), place.cast("long").alias("place"))


EVALUATE_SPLIT = _predictions_sql + ", m AS (SELECT p.m AS model, count(*) AS n, avg(abs(headcount - p.g)) AS mae, sqrt(avg((headcount - p.g) ** 2)) AS rmse, sum(abs(headcount - p.g)) / sum(abs(headcount)) AS wape, avg(p.g - headcount) AS bias FROM p GROUP BY p.m) SELECT model, n, round(mae, 5) AS mae, round(rmse, 5) AS rmse, round(wape, 5) AS wape, round(bias, 5) AS bias, rank() OVER (ORDER BY round(mae, 6)) AS place FROM m"


def target_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Wins of each model against the global mean, entity by entity, as a verdict."""
    p = _predictions(_features(spark, d))
    e = p.groupBy("model", "entity").agg(F.avg(F.abs(F.col("headcount") - F.col("guess"))).alias("mae"))
    base = e.where("model = 'global_mean'").select("entity", F.col("mae").alias("base"))
    r = e.where("model <> 'global_mean'").join(base, "entity").groupBy("model").agg(F.count("*").alias("entities"), F.count_if(F.round("mae", 6) < F.round("base", 6)).alias("wins"))
    share = F.col("wins") / F.col("entities")
    return r.withColumn("verdict", F.when(share > 0.55, "BETTER").when(share < 0.45, "WORSE").otherwise("NO_DIFFERENCE"))


TARGET_VERDICT = _predictions_sql + ", w AS (SELECT p.m AS model, entity, avg(abs(headcount - p.g)) AS mae FROM p GROUP BY ALL), r AS (SELECT w.model, count(*) AS entities, count(*) FILTER (round(w.mae, 6) < round(v.mae, 6)) AS wins FROM w JOIN w v ON v.entity = w.entity AND v.model = 'global_mean' WHERE w.model <> 'global_mean' GROUP BY w.model) SELECT *, CASE WHEN wins / entities::double > 0.55 THEN 'BETTER' WHEN wins / entities::double < 0.45 THEN 'WORSE' ELSE 'NO_DIFFERENCE' END AS verdict FROM r"


def ablation(spark: SparkSession, d: str) -> DataFrame:
    """Log-linear models of each single feature: coefficients on the training rows and the error on the test rows."""
    rows, out = _features(spark, d).withColumn("log_y", F.log("headcount")), None
    for name in FEATURES:
        fit = M.solve(M.normal_equations(rows.where("fold = 'TRAIN'").withColumn("feature", F.lit(name)), ["feature"], [name], "log_y"), ["feature"])
        one = rows.where("fold = 'TEST'").crossJoin(F.broadcast(fit)).groupBy("feature").agg(F.count("*").alias("rows"), F.round(F.avg(F.abs(F.col("log_y") - F.col("coefficients")[0] - F.col("coefficients")[1] * F.col(name))), 5).alias("log_mae"), F.round(F.first("coefficients")[1], 5).alias("slope"))
        out = one if out is None else out.unionByName(one)
    return out


ABLATION = _features_sql + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS rows, round(avg(abs(ln(headcount) - b0 - b1 * {c})), 5) AS log_mae, round(any_value(b1), 5) AS slope FROM f, (SELECT regr_intercept(ln(headcount), {c}) AS b0, regr_slope(ln(headcount), {c}) AS b1 FROM f WHERE fold = 'TRAIN') WHERE fold = 'TEST'" for c in FEATURES)


def random_split_control(spark: SparkSession, d: str) -> DataFrame:
    """An 80/20 split by a digest of the id, and targets exchanged with those of a digest's order as a control: the mean's error on both."""
    e = engagements(spark, d).where("headcount IS NOT NULL").select("id", "series", "headcount")
    digit = F.conv(F.substring(F.sha2(F.concat(F.lit("42:"), F.col("id").cast("string")), 256), 1, 4), 16, 10).cast("int")
    rows = e.withColumn("train", digit < 52429).withColumn("a", F.row_number().over(Window.partitionBy("series").orderBy("id"))).withColumn("b", F.row_number().over(Window.partitionBy("series").orderBy(F.sha2(F.col("id").cast("string"), 256))))
    other = rows.select("series", F.col("b").alias("a"), F.col("headcount").alias("shuffled"))
    rows = rows.join(other, ["series", "a"])
    means = rows.where("train").groupBy("series").agg(F.avg("headcount").alias("m"), F.avg("shuffled").alias("ms"))
    return rows.where("NOT train").join(means, "series").groupBy("series").agg(F.count("*").alias("test"), F.round(F.avg(F.abs(F.col("headcount") - F.col("m"))), 5).alias("mae"), F.round(F.avg(F.abs(F.col("shuffled") - F.col("ms"))), 5).alias("shuffled_mae"))


RANDOM_SPLIT_CONTROL = ENG + """,
r AS (SELECT id, series, headcount, ('0x' || sha256('42:' || id)[1:4])::int < 52429 AS train, row_number() OVER (PARTITION BY series ORDER BY id) AS a, row_number() OVER (PARTITION BY series ORDER BY sha256(id::varchar)) AS b FROM eng WHERE headcount IS NOT NULL),
x AS (SELECT r.*, o.headcount AS shuffled FROM r JOIN r o ON o.series = r.series AND o.b = r.a), m AS (SELECT series, avg(headcount) AS m, avg(shuffled) AS ms FROM x WHERE train GROUP BY series)
SELECT series, count(*) AS test, round(avg(abs(headcount - m)), 5) AS mae, round(avg(abs(shuffled - ms)), 5) AS shuffled_mae FROM x JOIN m USING (series) WHERE NOT train GROUP BY series
"""


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Sell-out odds by a fixed line through a clipped sigmoid, and right-censored headcounts of sold-out engagements."""
    e = engagements(spark, d).where("headcount IS NOT NULL")
    z = F.least(F.greatest((F.col("headcount") - 100) / 20, F.lit(-30.0)), F.lit(30.0))
    p = 1 / (1 + F.exp(-z))
    return e.groupBy("series", F.when(F.col("sold_out"), "RIGHT_CENSORED").otherwise("OBSERVED").alias("censoring")).agg(F.count("*").alias("n"), F.round(F.avg(p), 5).alias("mean_probability"), F.max("headcount").alias("upper"))


PROBABILITIES = ENG + "SELECT series, CASE WHEN sold_out THEN 'RIGHT_CENSORED' ELSE 'OBSERVED' END AS censoring, count(*) AS n, round(avg(1 / (1 + exp(-least(greatest((headcount - 100) / 20, -30), 30)))), 5) AS mean_probability, max(headcount) AS upper FROM eng WHERE headcount IS NOT NULL GROUP BY ALL"


def _currency(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("USD", "EUR", None))), (c % 3 + 1).cast("int"))


def price_spread(spark: SparkSession, d: str) -> DataFrame:
    """The last purchase of a key against its last click as primary and secondary price: spread where both may be compared, else why not."""
    s = snapshots(spark, d)
    last = lambda kind, name: s.where(F.col("status") == kind).groupBy("key").agg(F.max(F.struct("seen_at", "seq", "price", "level")).alias("r")).select("key", F.col("r.price").alias(f"{name}_price"), _currency(F.col("r.level")).alias(f"{name}_currency"), (F.col("r.level") % 2).alias(f"{name}_fees"))
    r = last("purchase", "primary").join(last("click", "secondary"), "key", "full")
    reason = F.when(F.col("primary_price").isNull() | F.col("secondary_price").isNull(), "MISSING_SIDE").when(F.col("primary_currency").isNull() | F.col("secondary_currency").isNull(), "MISSING_CURRENCY").when(F.col("primary_currency") != F.col("secondary_currency"), "CURRENCY_MISMATCH").when(F.col("primary_fees") != F.col("secondary_fees"), "FEES_MISMATCH")
    ok = reason.isNull()
    spread = F.col("secondary_price") - F.col("primary_price")
    rate = F.element_at(F.create_map(F.lit("USD"), F.lit(100), F.lit("EUR"), F.lit(108)), F.col("primary_currency"))
    return r.select("key", F.coalesce(reason, F.lit("COMPARABLE")).alias("state"), F.when(ok, F.round(spread, 4)).alias("spread"), F.when(ok & (F.col("primary_price") > 0), F.round(spread / F.col("primary_price"), 5)).alias("part"), F.when(ok, F.round(spread * rate).cast("long")).alias("minor_units"))


_cur = "['USD', 'EUR', NULL][level % 3 + 1]"
PRICE_SPREAD = SNAP + f""",
l AS (SELECT *, row_number() OVER (PARTITION BY key, status ORDER BY seen_at DESC, seq DESC) AS n, {_cur} AS cur, level % 2 AS fees FROM snap WHERE status IN ('purchase', 'click')),
r AS (SELECT coalesce(a.key, b.key) AS key, a.price AS p, b.price AS s, a.cur AS pc, b.cur AS sc, a.fees AS pf, b.fees AS sf FROM (SELECT * FROM l WHERE n = 1 AND status = 'purchase') a FULL JOIN (SELECT * FROM l WHERE n = 1 AND status = 'click') b ON a.key = b.key),
t AS (SELECT *, CASE WHEN p IS NULL OR s IS NULL THEN 'MISSING_SIDE' WHEN pc IS NULL OR sc IS NULL THEN 'MISSING_CURRENCY' WHEN pc <> sc THEN 'CURRENCY_MISMATCH' WHEN pf <> sf THEN 'FEES_MISMATCH' ELSE 'COMPARABLE' END AS state FROM r)
SELECT key, state, CASE WHEN state = 'COMPARABLE' THEN round(s - p, 4) END AS spread, CASE WHEN state = 'COMPARABLE' AND p > 0 THEN round((s - p) / p, 5) END AS part, CASE WHEN state = 'COMPARABLE' THEN round((s - p) * CASE pc WHEN 'USD' THEN 100 ELSE 108 END)::bigint END AS minor_units FROM t
"""


def capacity_use(spark: SparkSession, d: str) -> DataFrame:
    """Headcount over the capacity that applies: the place's explicit claim for the kind, else its upper bound, else unknown; conflicts void it."""
    e = engagements(spark, d).where("place IS NOT NULL AND headcount IS NOT NULL")
    claims = e.groupBy("place", (F.col("shows") % 3).alias("kind")).agg(F.max("headcount").alias("claim"), F.count_distinct("headcount").alias("values"))
    explicit = claims.where("kind > 0").select("place", "kind", F.col("claim").alias("explicit"), (F.col("values") > 12).alias("conflict"))
    upper = claims.where("kind = 0").select("place", F.col("claim").alias("upper"))
    r = e.withColumn("kind", F.col("shows") % 3).join(explicit, ["place", "kind"], "left").join(upper, "place", "left")
    basis = F.when(F.col("conflict"), "CONFLICTING").when(F.col("explicit").isNotNull(), "EXPLICIT").when(F.col("upper").isNotNull(), "UPPER_BOUND").otherwise("UNKNOWN")
    use = F.when(basis == "EXPLICIT", F.col("headcount") / F.col("explicit")).when(basis == "UPPER_BOUND", F.col("headcount") / F.col("upper"))
    return r.groupBy("kind", basis.alias("basis")).agg(F.count("*").alias("n"), F.round(F.avg(use), 5).alias("mean_use"), F.count_if(use > 1).alias("over"))


CAPACITY_USE = ENG + """,
e AS (SELECT place, headcount, shows % 3 AS kind FROM eng WHERE place IS NOT NULL AND headcount IS NOT NULL),
c AS (SELECT place, kind, max(headcount) AS claim, count(DISTINCT headcount) AS v FROM e GROUP BY ALL),
r AS (SELECT e.kind, headcount, x.claim AS explicit, x.v > 12 AS conflict, u.claim AS upper FROM e LEFT JOIN c x ON x.place = e.place AND x.kind = e.kind AND x.kind > 0 LEFT JOIN c u ON u.place = e.place AND u.kind = 0),
b AS (SELECT *, CASE WHEN conflict THEN 'CONFLICTING' WHEN explicit IS NOT NULL THEN 'EXPLICIT' WHEN upper IS NOT NULL THEN 'UPPER_BOUND' ELSE 'UNKNOWN' END AS basis FROM r),
u AS (SELECT *, CASE basis WHEN 'EXPLICIT' THEN headcount / explicit WHEN 'UPPER_BOUND' THEN headcount / upper END AS use FROM b)
SELECT kind, basis, count(*) AS n, round(avg(use), 5) AS mean_use, count(*) FILTER (use > 1) AS over FROM u GROUP BY ALL
"""

#: Rights from the most to the least restrictive.
RIGHTS = ("PROHIBITED", "UNKNOWN", "RESEARCH_ONLY", "COMMERCIAL")


def rights_and_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per source of documents: the most restrictive right of its languages, and the state of its coverage by labels."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    order = F.element_at(F.create_map(*(F.lit(x) for kv in (("en", 4), ("de", 3), ("fr", 3), ("es", 2)) for x in kv)), F.col("lang"))
    seen = docs.join(table(spark, d, "labels").where("quality IS NOT NULL").select("doc_id").distinct().withColumn("known", F.lit(1)), "doc_id", "left").where(F.col("doc_id") % 7 < 5)
    g = seen.groupBy("source").agg(F.min(F.coalesce(order, F.lit(2))).alias("r"), F.round(F.count("known") / F.count("*"), 6).alias("measured"))
    state = F.when(F.col("measured").isNull(), "NOT_MEASURED").when(F.col("measured") == 0, "MEASURED_ZERO").when(F.col("measured") < 0.4, "BELOW_THRESHOLD").otherwise("MEETS_THRESHOLD")
    return g.select("source", F.element_at(F.array(*map(F.lit, RIGHTS)), F.col("r")).alias("rights"), "measured", state.alias("state"))


RIGHTS_AND_COVERAGE = f"""
WITH s AS (SELECT source, lang, l.doc_id IS NOT NULL AS known FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality IS NOT NULL) l ON l.doc_id = d.doc_id WHERE d.doc_id % 7 < 5),
g AS (SELECT source, min(CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 3 WHEN 'fr' THEN 3 ELSE 2 END) AS r, round(count(*) FILTER (known) / count(*)::double, 6) AS measured FROM s GROUP BY source)
SELECT source, {list(RIGHTS)}[r] AS rights, measured, CASE WHEN measured = 0 THEN 'MEASURED_ZERO' WHEN measured < 0.4 THEN 'BELOW_THRESHOLD' ELSE 'MEETS_THRESHOLD' END AS state FROM g
"""

QUERIES = {name.lower(): (globals()[name.lower()], globals()[name]) for name in list(globals()) if name.isupper() and name.lower() in globals()}
