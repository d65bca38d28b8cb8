"""Small cases of the operators: published-before, unknown is not zero, ties, conflicts, streams, sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitengine.functions import geo_time as G
from pitengine.functions import stats as S
from pitengine.functions import text as T
from pitengine.operators import changes, comparables, models, pit, resolve, windows
from pitengine.session import new_path
from pitengine.sources import warehouse
from pitengine.streaming import streams

D = dt.date


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_only_results_published_before_count(spark):
    eng = spark.createDataFrame([(1, "a", D(2020, 6, 1), D(2020, 7, 1), 10.0), (2, "a", D(2020, 1, 1), D(2020, 2, 1), 10_000.0), (3, "a", D(2020, 1, 1), D(2020, 6, 1), 5.0), (4, "a", D(2020, 1, 1), None, 7.0), (5, None, D(2020, 6, 1), D(2020, 6, 2), 1.0)], "id long, entity string, start_date date, pub_date date, value double")
    got = {r.id: r for r in pit.prior_totals(eng.select("id", "entity", "start_date"), eng, ["entity"]).collect()}
    assert (got[1].prior_count, got[1].prior_sum, got[1].prior_last) == (1, 10_000.0, 10_000.0)
    assert (got[2].prior_count, got[2].prior_sum, got[2].prior_last) == (0, None, None) and got[5].prior_count == 0
    assert [(r._start, r.m) for r in pit.prior_median(eng, eng, ["entity"], "value", "m").collect()] == [(D(2020, 6, 1), 10_000.0)]
    out = {r.id: (r.estimate, r.level) for r in pit.fallback_medians(eng.select("id", "entity", "start_date"), eng, [["entity"]], "value", 999.0).collect()}
    assert out == {1: (10_000.0, 0), 2: (999.0, 1), 3: (999.0, 1), 4: (999.0, 1), 5: (999.0, 1)}


def test_dates_and_distances(spark):
    d = lambda m: F.lit(f"2024-{m:02d}-10").cast("date")
    assert one(spark, G.calendar_distance(d(1), d(7)), G.calendar_distance(d(1), d(12)), G.calendar_distance(d(3), d(3)), G.calendar_distance(d(3), F.lit(None).cast("date"))) == (1.0, 1 / 6, 0.0, None)
    assert one(spark, F.round(G.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), 3), G.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0))) == (20015.087, None)
    assert one(spark, G.valid_at(F.lit(1), F.lit(2), F.lit(1)), G.valid_at(F.lit(1), F.lit(2), F.lit(2)), G.valid_at(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(2))) == (True, False, True)
    assert one(spark, G.next_weekday(F.lit("2024-01-01").cast("date"), "Mon"), F.date_format(G.end_of_day(F.lit("2024-01-05").cast("date")), "yyyy-MM-dd HH:mm:ss")) == (D(2024, 1, 8), "2024-01-05 23:59:59")


@pytest.mark.parametrize("values, weights, q, want", [([1, 2, 3], [1, 1, 1], 0.5, 2), ([10, 20, 30], [1, 1, 1], 0.25, 10), ([1, 2, 3], [0, 0, 0], 0.5, 2)])
def test_weighted_quantiles(spark, values, weights, q, want):
    df = spark.createDataFrame([("k", float(v), float(w)) for v, w in zip(values, weights)], "k string, v double, w double")
    assert S.weighted_quantiles(df, ["k"], "v", "w", [q]).first()[2] == want


def test_auc_and_regression(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    assert S.auc(df, "s", "y").first().auc == 1.0 and S.average_precision(df, "s", "y").first()[0] == 1.0
    assert S.auc(df.where("y = 1"), "s", "y").first().auc is None
    r = S.regression_metrics(spark.createDataFrame([(100.0, 110.0), (200.0, 190.0), (300.0, 310.0), (None, 1.0)], "y double, p double"), "y", "p").first()
    assert (r.n, r.mae, round(r.rmse, 9)) == (3, 10.0, 10.0)


def test_strata_and_retrieval(spark):
    kind = "id long, entity string, place string, market string, series string, start_date date, pub_date date, value double"
    target = [(0, "A", "P", "M", "S", D(2024, 1, 1), D(2024, 3, 1), None)]
    same = [(k, "A", "P", "M", "S", D(2023, 1, 1), D(2023, 2, 1), 500.0 + k) for k in range(1, 4)]
    broad = [(10 + k, "B", "P", "M", "S", D(2023, 1, 1), D(2023, 2, 1), 9000.0) for k in range(10)]
    pool = spark.createDataFrame(target + same + broad, kind)
    target = pool.where("id = 0")
    scored = comparables.distances(comparables.nearest_pairs(target, pool, "value", 20))
    sizes = comparables.stratum_sizes(target, pool, "value")
    near = comparables.retrieve_stratum(scored, sizes, 10, 3)
    assert {(r.stratum, r.c_id) for r in near.collect()} == {(1, 1), (1, 2), (1, 3)}
    assert comparables.valuation(near).first().q50 == 502.0
    assert {r.stratum for r in comparables.retrieve_stratum(scored, sizes, 20, 4).collect()} == {4}


def test_nearest_of_the_whole_pool_match_all_pairs(spark):
    """Random rows with gaps and ties: the k nearest by cells are those of all pairs, for targets without an own history too."""
    import random
    from datetime import timedelta

    rng, kind = random.Random(7), "id long, entity string, place string, market string, series string, start_date date, pub_date date, value double"
    pick = lambda xs: rng.choice([*xs, None])
    rows = []
    for k in range(400):
        start = D(2022, 1, 1) + timedelta(rng.randrange(700))
        rows.append((k, pick("ABCDE"), pick("PQR"), pick("MN"), pick("ST"), start, rng.choice([start + timedelta(rng.randrange(1, 90)), start - timedelta(3), None]), rng.choice([1.0, 2.0, None])))
    pool = spark.createDataFrame(rows, kind)
    target = pool.where("id % 9 = 0")
    got = {(r.t_id, r.place): (r.c_id, round(r.ranking, 9)) for r in comparables.retrieve_global(comparables.distances(comparables.nearest_pairs(target, pool, "value", 6)), 6).collect()}
    names, weights = ("entity", "place", "market", "series"), (3.0, 2.0, 1.5, 1.0)
    want = {}
    for t in rows[::9]:
        found = []
        for c in rows:
            if c[0] == t[0] or c[6] is None or c[6] >= t[5] or c[7] is None:
                continue
            off = abs(t[5].month - c[5].month)
            known = [(w, t[k] != c[k]) for k, w in enumerate(weights, 1) if t[k] is not None and c[k] is not None]
            d = (sum(w * x for w, x in known) + min(off, 12 - off) / 6) / (sum(w for w, _ in known) + 1.0)
            found.append((min(1.0, d + 0.1 * (len(names) - len(known))), -c[5].toordinal(), c[0]))
        for place, (d, _, c) in enumerate(sorted((round(a, 12), b, c) for a, b, c in found)[:6], 1):
            want[t[0], place] = (c, round(d, 9))
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert sum(got[k][0] == want[k][0] for k in want) >= 0.98 * len(want)  # equal distances may round apart


def test_changes_and_alerts(spark):
    rows = spark.createDataFrame([("e", 1, 50), ("e", 2, 70), ("e", 3, 50), ("e", 4, 70), ("f", 1, 1)], "key string, at int, price int")
    assert changes.transitions(rows, ["key"], ["at"], "price").where("kind = 'CHANGED'").count() == 3
    assert changes.alerts(rows, ["key"], ["at"], "price", "PRICE").count() == 2
    again = changes.append_new(rows.where("at < 3"), rows, ["key", "price"], ["at"])
    assert again.count() == 0
    describe = lambda a, b: one(spark, changes.describe_change(F.lit(a).cast("int"), F.lit(b).cast("int")))[0]
    assert [describe(*x) for x in ((None, None), (None, 1), (1, None), (1, 1), (1, 2))] == ["NO_INFORMATION", "BECAME_OBSERVABLE", "BECAME_UNOBSERVABLE", "UNCHANGED", "INCREASED"]
    single = rows.where("at = 1")
    assert changes.new_in_latest(single, "at", "key").count() == 0
    assert [r.key for r in changes.new_in_latest(rows.withColumn("key", F.concat("key", F.col("at").cast("string"))), "at", "key").collect()] == ["e4"]
    assert changes.conflicts(rows, ["key"], "price").first().n_values == 2


def test_trailing_windows(spark):
    cutoff = D(2024, 6, 1)
    daily = spark.createDataFrame([("k", cutoff - dt.timedelta(n), float(v), cutoff if n == 5 else cutoff - dt.timedelta(n)) for n, v in ((1, 10), (5, 20), (20, 30), (40, 40), (100, 50), (0, 999), (-3, 999))], "key string, day date, value double, available date")
    cut = spark.createDataFrame([("k", cutoff), ("none", cutoff)], "key string, cutoff date")
    r = {x.key: x for x in windows.trailing_features(daily, cut, "key").collect()}
    assert [r["k"][f"sum_{n}d"] for n in (7, 30, 90, 365)] == [30, 60, 100, 150] and r["k"].days_observed == 5
    assert r["none"].sum_7d is None and r["none"].days_observed == 0
    gated = windows.trailing_features(daily, cut.where("key = 'k'"), "key", available="available").first()
    assert gated.sum_30d == 40
    days = windows.densify(daily.where("day <= '2024-06-01'").select("key", "day", "value"), "key")
    assert days.count() == 101 and days.where("state = 'MISSING'").count() == 95
    equity = spark.createDataFrame([("k", 1, 100.0), ("k", 2, 120.0), ("k", 3, 90.0)], "key string, t int, v double")
    assert windows.drawdown(equity, ["key"], ["t"], "v").first().max_drawdown == -0.25


def test_resolution(spark):
    rows = spark.createDataFrame([(1, "x", True, False), (1, "y", False, True), (2, "x", False, True), (2, "y", False, True), (3, None, None, None)], "id int, cand string, exact boolean, near boolean")
    got = {r.id: (r.status, r.method, r.match) for r in resolve.ladder(rows, "id", "cand", [("EXACT", F.col("exact")), ("NEAR", F.col("near"))]).collect()}
    assert got == {1: ("MATCHED", "EXACT", "x"), 2: ("AMBIGUOUS", "NEAR", None), 3: ("NO_MATCH", None, None)}
    spans = spark.createDataFrame([(1, "a", D(2024, 1, 1), D(2024, 1, 5)), (2, "a", D(2024, 1, 4), D(2024, 1, 9)), (3, "a", D(2024, 1, 8), D(2024, 1, 9)), (4, "a", None, None), (5, "b", D(2024, 1, 1), None)], "id int, k string, s date, e date")
    assert {r.id: r.anchor for r in resolve.anchor_clusters(spans, ["k"], "s", "e", "id").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_models(spark):
    import math

    rows = spark.createDataFrame([("g", float(x), 2.0 + 3.0 * x, float(round(math.exp(0.5 + 0.2 * x)))) for x in range(20)], "g string, x double, y double, c double")
    fit = models.solve(models.normal_equations(rows, ["g"], ["x"], "y"), ["g"]).first().coefficients
    assert [round(v, 6) for v in fit] == [2.0, 3.0]
    b = models.fit_glm(rows, ["g"], ["x"], "c", "poisson").first().coefficients
    assert abs(b[0] - 0.5) < 0.1 and abs(b[1] - 0.2) < 0.01


def test_text(spark):
    f = lambda c: one(spark, c)[0]
    assert f(T.name_key(F.lit("The  The B-52's!"))) == "b 52 s" and f(T.slug(F.lit(" A&B "))) == "a-b" and f(T.slug(F.lit("!"))) == "unknown"
    assert f(T.first_number(F.lit("about 1,234.5 of 7"))) == 1234.5 and f(T.first_number(F.lit("none"))) is None
    assert f(T.html_lines(F.lit("<p>a &amp; b</p><script>x</script><div>c<br>d</div>"))) == "a & b\nc\nd"
    assert f(T.token_jaccard(F.lit("a b c"), F.lit("b c d"))) == 0.5 and f(T.token_jaccard(F.lit(""), F.lit("b"))) is None
    assert f(T.edit_similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert T.canonical_url("HTTP://User:pw@Example.com:80/a/?b=2&utm_source=x&a=1#f") == "http://example.com/a/?a=1&b=2" and T.canonical_url("mailto:a@b") is None
    got = spark.createDataFrame([("​A  Bﬁ ", "Café & Bar"), (None, None)], "a string, b string").select(T.unicode_text("a"), T.plain_letters("b")).collect()
    assert tuple(got[0]) == ("A Bfi", "cafe and bar") and tuple(got[1]) == (None, None)


def test_warehouse_and_partner_files(spark, tmp_path):
    w = warehouse.Warehouse(spark)
    w.register(spark.range(5).toPandas(), "five")
    assert w.to_arrow("SELECT count(*) AS n FROM five WHERE id >= :low", {"low": 2}).to_pydict() == {"n": [3]}
    w.export_parquet("SELECT id, id % 2 AS side FROM five", str(tmp_path / "out"), partition_by=["side"])
    assert spark.read.parquet(str(tmp_path / "out")).where("side = 1").count() == 2
    (tmp_path / "p.csv").write_text("Final Sold,buyer_email,Venue Name\n12,x@y.z,Hall\nmany,x@y.z,\n")
    rows = warehouse.import_partner(warehouse.read_any(spark, str(tmp_path / "p.csv"), "csv"), {"tickets_sold": "int", "venue": "string", "buyer_email": "string", "capacity": "int"}).collect()
    assert [tuple(r) for r in rows] == [(12, "Hall", None, None), (None, None, None, None)]
    assert [warehouse.classify_header(h) for h in ("buyer_email", "Buyer Name", "event name", "gross")] == ["PROHIBITED", "POTENTIAL_PII", "SAFE", "SAFE"]
    with pytest.raises(ValueError):
        warehouse.read_any(spark, "x", "xml")


def test_published_versions(spark):
    folder = new_path(spark, "versions")
    warehouse.publish(spark.range(1), folder, "0001")
    warehouse.publish(spark.range(2), folder, "0002")
    assert warehouse.latest_version(spark, folder).count() == 2


def test_streams_equal_batch_over_several_batches(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * k), k % 3, "abca"[k * k % 4], float(k), "{}") for k in range(60)]
    for part in range(3):
        df = spark.createDataFrame(rows[part * 20 : part * 20 + 20], streams.SCHEMA).coalesce(1)
        df.write.parquet(str(tmp_path / "in" / f"{part}"))
    files = sorted((tmp_path / "in").glob("*/*.parquet"))
    import os

    (tmp_path / "all").mkdir()
    for k, f in enumerate(files):
        os.utime(f, (k, k))
        f.rename(tmp_path / "all" / f"{k}.parquet")
    events = streams.event_stream(spark, str(tmp_path / "all" / "*.parquet"), files_per_batch=1)
    got = streams.run_to_table(streams.transitions(events)).collect()
    want, last = [], {}
    for seq, _, key, status, *_ in rows:
        if last.get(key) != status:
            want.append((key, seq, last.get(key), status))
        last[key] = status
    assert sorted(map(tuple, got)) == sorted(want)
    assert streams.run_to_table(streams.first_of_each(events)).count() == len({(r[2], r[3], r[4] // 10) for r in rows})


def test_prior_medians_of_hot_keys(spark):
    """Keys over the limit are cut into bins by value; the medians are those of a plain sort."""
    import random
    import statistics
    from datetime import date, timedelta

    from pitengine.operators import pit

    rng, day = random.Random(4), date(2020, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, None]), day + timedelta(rng.randrange(60)), rng.choice([day + timedelta(rng.randrange(90)), None]), rng.choice([float(rng.randrange(9)), rng.random() * 50, None])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "k int, start_date date, pub_date date, v double")
    want = {}
    for k, start, _, _ in rows:
        past = [v for k2, _, pub, v in rows if k2 == k and k is not None and pub and pub < start and v is not None]
        if past:
            want[k, start] = statistics.median(past)
    for limit in (1 << 16, 700, 100):
        got = {(r.k, r["_start"]): r.m for r in pit.prior_median(df, df, ["k"], "v", "m", hot_rows=limit).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_cluster_overlaps_query_matches_a_plain_walk(spark, sf):
    from pitengine.plans.audit import cluster_overlaps
    from pitengine.sources.tables import engagements

    rows = sorted((r.entity, r.start_date, r.id, r.pub_date or r.start_date) for r in engagements(spark, sf).collect())
    want, entity, anchor, until = {}, None, None, None
    for e, start, i, end in rows:
        if e != entity or start > until:
            entity, anchor, until = e, i, end
        want[i] = anchor
    assert {r.id: r.anchor for r in cluster_overlaps(spark, sf).collect()} == want


@pytest.mark.parametrize("name, target, family", [("poisson", "headcount", "poisson"), ("logistic", "sold_out", "logistic")])
def test_model_queries_match_reweighted_least_squares(spark, sf, name, target, family):
    import numpy as np

    from pitengine.plans import audit

    rows = audit._model_rows(spark, sf).toPandas()
    got = {r.series: (r.n, r.b0, r.b1) for r in getattr(audit, name)(spark, sf).collect()}
    for series, g in rows.groupby("series"):
        x, y = np.column_stack([np.ones(len(g)), g["shows"]]), g[target].to_numpy(float)
        b = np.array([np.log(y.mean()) if family == "poisson" else 0.0, 0.0])
        for _ in range(100):
            eta = x @ b
            mu = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))
            w = mu if family == "poisson" else mu * (1 - mu)
            b = np.linalg.solve(x.T @ (w[:, None] * x) + 1e-4 * np.diag([0.0, 1.0]), x.T @ (w * (eta + (y - mu) / w)))
        assert got[series][0] == len(g) and np.allclose(got[series][1:], b, atol=2e-4)


def test_publication_keeps_three_versions_and_points_to_the_last(spark, tmp_path):
    from pitengine.sources import warehouse

    folder = f"file:{tmp_path}/mart"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, secret string")
    for v in ("8", "9", "10", "11"):
        out = warehouse.publish(df.withColumn("v", F.lit(v)), folder, v, drop=["secret"])
        assert out.columns == ["k", "v"] and out.count() == 2
    assert warehouse.versions(spark, folder) == ["9", "10", "11"]
    assert {r.v for r in warehouse.latest_version(spark, folder).collect()} == {"11"}
    with pytest.raises(Exception):
        warehouse.publish(df, folder, "11")
    assert warehouse.latest_version(spark, folder).count() == 2


def test_nearest_with_an_unknown_identity_go_by_start_where_the_ranking_ends(spark):
    """A target without a place ranks all rows of three months away or more at 1: the later start decides, not the nearer month."""
    kind = "id long, entity string, place string, market string, series string, start_date date, pub_date date, value double"
    target = [(0, "A", None, "M", "S", D(2024, 1, 1), None, None)]
    nearer = [(k, "B", "P", "N", "T", D(2022, 4, k), D(2022, 5, 1), 1.0) for k in range(1, 6)]
    later = [(k, "B", "P", "N", "T", D(2023, 7, k), D(2023, 8, 1), 1.0) for k in range(11, 13)]
    pool = spark.createDataFrame(target + nearer + later, kind)
    near = comparables.retrieve_global(comparables.distances(comparables.nearest_pairs(pool.where("id = 0"), pool, "value", 2)), 2)
    assert sorted((r.place, r.c_id, r.ranking) for r in near.collect()) == [(1, 12, 1.0), (2, 11, 1.0)]
    # a row without a place, seen from a target that has one
    pool = spark.createDataFrame([(r[0], r[1], None if r[0] else "P", *r[3:]) for r in target + nearer + later], kind)
    near = comparables.retrieve_global(comparables.distances(comparables.nearest_pairs(pool.where("id = 0"), pool, "value", 2)), 2)
    assert sorted((r.place, r.c_id, r.ranking) for r in near.collect()) == [(1, 12, 1.0), (2, 11, 1.0)]


def test_targets_of_a_cell_and_day_are_asked_once(spark, monkeypatch):
    kind = "id long, entity string, place string, market string, series string, start_date date, pub_date date, value double"
    pool = spark.createDataFrame([(k, f"e{k % 20}", "P", "M", "S", D(2024, 1, 1 + k % 2), D(2024, 1, 1 + k % 2), 1.0 * k) for k in range(400)], kind)
    asked, fold = [], comparables.as_of_fold
    monkeypatch.setattr(comparables, "as_of_fold", lambda targets, *a, **b: asked.append(targets.count()) or fold(targets, *a, **b))
    pairs = comparables.nearest_pairs(pool.where("start_date = '2024-01-02'"), pool, "value", 3)
    # 200 targets of ten entities, on one day: with and without their entity
    assert asked[0] <= 16 * 11
    assert {r.n for r in pairs.groupBy("t_id").agg(F.count_if(F.col("c_start") < F.col("t_start")).alias("n")).collect()} >= {4} and pairs.select("t_id").distinct().count() == 200


def test_fold_over_batches_with_gaps_in_keys_and_values(spark):
    """25,000 rows (three Arrow batches) of keys with NULLs; NULL values and questions reach the fold as None."""
    rows = spark.range(25_000).select((F.col("id") % 2).alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("b"), F.lit(D(2020, 1, 1)).alias("_pub"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    asks = rows.select("a", "b").distinct().select("a", "b", F.lit(D(2020, 1, 2)).alias("_start"), F.explode(F.array(F.lit(7), F.lit(None).cast("int"))).alias("q"))

    class Seen:
        def __init__(self):
            self.known = self.gaps = 0

        def add(self, v):
            self.known, self.gaps = self.known + (v is not None), self.gaps + (v is None)

        def answer(self, q):
            return self.known, self.gaps, q is None

    got = sorted((r.a, r.b or "", r.q or 0, r.known, r.gaps, r.open, str(r._start)) for r in pit.as_of_fold(asks, rows, ["a", "b"], ["v"], Seen, "known long, gaps long, open boolean", extra=["q"]).collect())
    want = [(a, f"k{b}" if b else "", q, sum(1 for i in range(25_000) if (i % 2, i % 3) == (a, b) and i % 5), sum(1 for i in range(25_000) if (i % 2, i % 3) == (a, b) and i % 5 == 0), q == 0, "2020-01-02") for a in (0, 1) for b in (0, 1, 2) for q in (0, 7)]
    assert got == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_agreement_groups_a_key_once(spark):
    rows = spark.createDataFrame([("k", "s", 1.0, None), ("k", "t", 1.0, 4.0), ("k", "t", 1.0, 5.0), ("m", "s", 2.0, 0.0), ("m", "t", 3.0, -1.0), ("n", None, 7.0, 7.0), ("n", "s", 8.0, 8.0)], "key string, source string, a double, b double")
    out = resolve.agreement(rows, "key", "source", ["a", "b"])
    assert {r.field: (r.compared, r.exact, r.mean_spread, r.max_part) for r in out.collect()} == {"a": (2, 1, 0.5, 1 / 3), "b": (1, 0, 1.0, None)}
    assert "Expand" not in _plan(out) and _plan(out).count("Aggregate") == 2


def test_prior_totals_add_up_days_in_one_aggregation(spark):
    rows = spark.createDataFrame([("A", D(2020, 1, 1), D(2020, 1, 5), 1, 2.0), ("A", D(2020, 1, 2), D(2020, 1, 5), 2, 3.0), ("A", D(2020, 1, 6), D(2020, 1, 9), 3, None), ("B", None, D(2020, 1, 1), 4, 1.0), (None, D(2020, 1, 6), D(2020, 1, 1), 5, 1.0)], "k string, start_date date, pub_date date, id long, value double")
    out = pit.prior_totals(rows.select("k", "start_date", "id"), rows, ["k"])
    assert sorted((r.id, r.prior_count, r.prior_sum, r.prior_last) for r in out.collect()) == [(1, 0, None, None), (2, 0, None, None), (3, 2, 5.0, 3.0), (4, 0, None, None), (5, 0, None, None)]
    assert _plan(out).count("Aggregate") == 1


def test_claim_ledger_lays_out_no_row_per_claim(spark, tmp_path):
    from pitengine.plans import ledger

    kind = "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame([(1, 1.0, None, 0.1, None), (1, 2.0, None, 0.2, None), (None, 4.0, None, None, 0.5)], kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = ledger.claim_ledger(spark, str(tmp_path))
    assert {r.claim: (r.claims, r.known, r.subjects, r["mean"]) for r in out.collect()} == {"l_quantity": (3, 3, 1, 2.333333), "l_extendedprice": (3, 0, 1, None), "l_discount": (3, 2, 1, 0.15), "l_tax": (3, 1, 1, 0.5)}
    assert "Expand" not in _plan(out)
