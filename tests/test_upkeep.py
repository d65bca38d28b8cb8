"""Marts kept up by appends, folds of whole groups, cuts in time, editions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitengine.operators import editions, folds
from pitengine.plans import evidence
from pitengine.session import new_path
from pitengine.sources import marts


def test_mart_reads_only_new_files(spark):
    folder = new_path(spark, "mart_test")
    mart = marts.Mart(folder, ("k",), sums=("v",), ranges=("v",))
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 5.0), (None, 2.0)], "k string, v double").coalesce(1)
    assert marts.refresh(spark, mart, f"{folder}/source")["status"] == "UNCHANGED"
    rows.write.mode("append").parquet(f"{folder}/source")
    first = marts.refresh(spark, mart, f"{folder}/source")
    assert (first["status"], first["version"], first["rows_read"], first["files"]) == ("REFRESHED", "1", 4, 1)
    spark.createDataFrame([("a", -3.0), ("c", None)], "k string, v double").coalesce(1).write.mode("append").parquet(f"{folder}/source")
    # a refresh that dies before its pointer moves counts nothing and is run again
    with pytest.raises(ZeroDivisionError):
        marts.refresh(spark, mart, f"{folder}/source", lambda df: 1 / 0)
    second = marts.refresh(spark, mart, f"{folder}/source")
    assert (second["version"], second["rows_read"]) == ("2", 2)
    assert marts.refresh(spark, mart, f"{folder}/source")["status"] == "UNCHANGED"
    got = sorted((str(r.k), r.n, r.sum_v, r.mean_v, r.low_v, r.high_v) for r in marts.read(spark, mart).collect())
    assert got == [("None", 1, 2.0, 2.0, 2.0, 2.0), ("a", 3, -2.0, -1.0, -3.0, 1.0), ("b", 1, 5.0, 5.0, 5.0, 5.0), ("c", 1, None, None, None, None)]
    assert sorted(r.status for r in marts.runs(spark, mart).collect()) == ["FAILED", "REFRESHED", "REFRESHED", "UNCHANGED", "UNCHANGED"]
    assert marts.runs(spark, mart).where("status = 'FAILED' AND error LIKE '%division%'").count() == 1


def test_folds_keep_groups_apart_and_balanced(spark):
    rows = spark.range(6000).select("id", F.pmod(F.xxhash64("id"), F.lit(900)).alias("a"), (F.col("id") % 3000).alias("b"), F.lit("x").alias("c"))
    small = rows.withColumn("b", F.when(F.col("id") % 7 == 0, F.col("b"))).withColumn("a", F.when(F.col("id") % 2 == 0, F.col("a")))
    out = folds.group_folds(small, ["a", "b"], 4).cache()
    assert out.count() == 6000
    for g in ("a", "b"):
        assert out.where(f"{g} IS NOT NULL").groupBy(g).agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    dealt = out.where("component IS NOT NULL")
    sizes = [r["count"] for r in dealt.groupBy("fold").count().collect()]
    largest = dealt.groupBy("component").count().agg(F.max("count")).first()[0]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= largest
    assert out.where("component IS NULL AND fold <> 0").count() == 0 < out.where("component IS NULL").count()
    assert folds.group_folds(rows.limit(0), ["a"], 3).count() == 0


def test_time_cut_edges(spark):
    day = lambda k: dt.date(2020, 1, k)
    df = spark.createDataFrame([(day(1),), (day(1),), (day(2),), (day(3),), (day(9),), (None,)], "d date")
    assert sorted((str(r.d), r.part) for r in folds.time_cut(df, "d").collect()) == [("2020-01-01", "TRAIN"), ("2020-01-01", "TRAIN"), ("2020-01-02", "TRAIN"), ("2020-01-03", "TRAIN"), ("2020-01-09", "TRAIN"), ("None", "TEST")]
    assert sorted(r.part for r in folds.time_cut(df, "d", 0.5).collect()) == ["TEST", "TEST", "TEST", "TRAIN", "TRAIN", "TRAIN"]
    assert {r.part for r in folds.time_cut(df.where("d IS NULL"), "d").collect()} == {"TEST"}


def test_trajectory_and_recomputed_editions(spark):
    billed = spark.createDataFrame([("e", 2001, 3), ("e", 2002, 2), ("e", 2003, 2), ("e", 2006, 1), ("e", 2007, 3)], "entity string, year int, tier int")
    got = [(r.move, r.gap, r.run) for r in editions.trajectories(billed, ["entity"]).orderBy("year").collect()]
    assert got == [("ENTRY", 0, 1), ("UP", 0, 1), ("SAME", 0, 1), ("RETURN", 2, 2), ("DOWN", 0, 2)]
    lineup = spark.createDataFrame([("f", 1, 1, 10), ("f", 1, 2, 30), ("f", 2, 2, 5), ("f", 4, 3, None), ("g", 1, 1, 1)], "festival string, year int, entity long, attention long")
    stored = editions.edition_metrics(lineup, editions.input_hashes(lineup))
    rows = {(r.festival, r.year): r for r in stored.collect()}
    assert (rows["f", 1].artists, round(rows["f", 1].hhi, 4), rows["f", 1].jaccard, rows["f", 2].jaccard, rows["f", 4].compared, rows["f", 4].missing) == (2, 0.625, None, 0.5, 2, True)
    changed = lineup.withColumn("attention", F.when((F.col("year") == 2) & (F.col("festival") == "f"), 6).otherwise(F.col("attention")))
    again = {(r.festival, r.year): r.recomputed for r in editions.refreshed_metrics(changed.repartition(3), stored).collect()}
    assert again == {("f", 1): False, ("f", 2): True, ("f", 4): True, ("g", 1): False}


def test_editions_are_not_recomputed_because_sums_came_out_otherwise(spark, sf, monkeypatch):
    """Sums of doubles depend on the order that rows arrive in; here each evaluation of them differs, and no edition may look changed for it."""
    want = {(r.festival, r.year): r.recomputed for r in evidence.edition_metrics(spark, sf).collect()}
    noise, plain = F.udf(lambda: 100 * random.random(), "double").asNondeterministic(), evidence.engagements
    monkeypatch.setattr(evidence, "engagements", lambda *a: plain(*a).withColumn("gross", F.col("gross") + noise()))
    got = {(r.festival, r.year): r.recomputed for r in evidence.edition_metrics(spark, sf).collect()}
    assert got == want and set(got.values()) == {False, True}
