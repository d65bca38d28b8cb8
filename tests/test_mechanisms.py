"""Components, similarity join, exact selection, frozen corpora and valence at their edges."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pitengine.functions import valence as V
from pitengine.operators import graph, selection, similar
from pitengine.plans import evidence
from pitengine.session import new_path
from pitengine.sources import frozen


def test_components_of_a_long_chain_and_a_hub(spark):
    n = 10_000
    order = list(range(n))
    random.Random(1).shuffle(order)
    chain = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)], "a long, b long")
    hub = spark.range(1, 20_000).select((F.col("id") + n).alias("a"), F.lit(n).cast("long").alias("b"))
    odd = spark.createDataFrame([(99_999_999, None), (None, 5), (7, 7)], "a long, b long")
    got = graph.components(chain.unionByName(hub).unionByName(odd))
    assert {tuple(r) for r in got.groupBy("root").count().collect()} == {(0, n - 1), (n, 19_999)}
    assert graph.components(odd).count() == 0


def test_merged_keeps_all_rows(spark):
    rows = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 0), (2, 9)], "k long, size long")
    claims = spark.createDataFrame([(1, 2), (3, 2)], "a long, b long")
    placed = graph.merged(rows, claims, "k", -F.col("size"))
    assert sorted((r.k, r.canonical, r.members, r.superseded) for r in placed.collect()) == [(1, 2, 4, True), (2, 2, 4, False), (2, 2, 4, False), (3, 2, 4, True), (4, 4, 1, False)]
    facts = graph.repointed(spark.createDataFrame([(3, "x"), (8, "y"), (None, "z")], "k long, v string"), placed.dropDuplicates(["k"]), "k")
    assert sorted((str(r.original), str(r.canonical), r.v) for r in facts.collect()) == [("3", "2", "x"), ("8", "8", "y"), ("None", "None", "z")]


@pytest.mark.parametrize("least", [0.6, 0.8, 1.0])
def test_similar_pairs_are_those_of_all_pairs(spark, least):
    rnd = random.Random(4)
    names = {"".join(rnd.choice("abcd é") for _ in range(rnd.randrange(1, 14))) for _ in range(250)} | {"a", "aa", "aaaaaaaaaa", "aaaaaaaaa"}
    names |= {x[:-1] + "z" for x in list(names)[:60]}
    names.discard("")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    left, right = sorted(names)[::2], sorted(names)[1::2] + ["", None]
    want = {(a, b) for a in left for b in right if b and distance(a, b) <= (1 - least) * max(len(a), len(b)) + 1e-9}
    got = similar.similar_pairs(*(spark.createDataFrame([(x,) for x in side], "name string") for side in (left, right)), least)
    assert {(r.a, r.b) for r in got.collect()} == want and (least == 1.0 or len(want) > 20)


def test_few_candidates_meet(spark):
    rnd = random.Random(6)
    base = ["".join(rnd.choice("etaoinshrdlu") for _ in range(20)) for _ in range(1500)]
    names = spark.createDataFrame([(x,) for x in base] + [(x[:7] + "q" + x[8:],) for x in base[:50]], "name string")
    pairs = similar.similar_pairs(names, names, 0.85).where("a < b")
    assert pairs.count() == 50


def test_exact_medians_of_large_keys(spark):
    """Skewed values, many ties, infinities and one key with most rows; ranges are narrowed until 1,000 values are left."""
    df = spark.range(200_000).select(
        F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "cold").alias("k"),
        F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 1000 == 1, float("inf")).when(F.col("id") % 1000 == 2, None).otherwise(F.exp(F.pmod(F.xxhash64("id"), F.lit(1400)) - 700.0)).alias("v"),
    )
    want = {r.k: (r.n, r.m) for r in df.where("v IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.percentile("v", 0.5).alias("m")).collect()}
    got = {r.k: (r.n, r["median"]) for r in selection.exact_medians(df, ["k"], "v", 1000).collect()}
    assert got == want and len(got) == 3
    whole = selection.exact_medians(df, [], "v", 500).first()
    assert tuple(whole) == tuple(df.where("v IS NOT NULL").agg(F.count("*"), F.percentile("v", 0.5)).first())
    ties = selection.exact_medians(df.select(F.lit(1.5).alias("v")), [], "v", 10).collect()
    assert [tuple(r) for r in ties] == [(200_000, 1.5)]
    assert selection.exact_medians(df.limit(0), ["k"], "v").count() == 0


def test_medians_anywhere_in_a_range_and_one_reading_of_the_engagements(spark, sf, monkeypatch):
    # the rank leaves the middle after the first pass: half of the values are one, the rest lies on one side of it
    skew = spark.range(60_000).select(F.when(F.col("id") % 20 < 9, 7.0).otherwise(7 + F.pmod(F.xxhash64("id"), F.lit(10**9)) ** 3.0).alias("v"))
    for df in (skew, skew.selectExpr("-v AS v"), skew.selectExpr("exp(v / 1e26) AS v")):
        assert selection.exact_medians(df, [], "v", 50).first()["median"] == df.agg(F.percentile("v", 0.5)).first()[0]
    seen, plain = spark.sparkContext.accumulator(0), evidence.engagements
    count = F.udf(lambda v: seen.add(1) or v, "double")
    monkeypatch.setattr(evidence, "engagements", lambda *a: plain(*a).withColumn("gross", count("gross")))
    assert evidence.exact_medians(spark, sf).count() > 3
    assert seen.value <= 2 * plain(spark, sf).count()


def test_digest_sees_changes_and_no_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (3, "")], "x int, y string")
    digest = lambda d: tuple(frozen.table_digest(d).first())
    same = digest(df)
    assert digest(df.repartition(7).orderBy(F.desc("x"))) == same == digest(df.select("y", "x")) and len(same[1]) == 32
    others = [df.limit(3), df.unionByName(df.limit(1)), df.withColumn("y", F.coalesce("y", F.lit(""))), df.withColumn("x", F.col("x") + 1), df.distinct(), df.limit(0)]
    assert len({digest(d) for d in others} | {same}) == 6  # three rows and the distinct ones are the same rows
    # neighbours that only differ in where a value ends
    assert digest(spark.createDataFrame([("ab", "c")], "x string, y string")) != digest(spark.createDataFrame([("a", "bc")], "x string, y string"))


def test_a_changed_version_is_not_loaded(spark):
    folder = new_path(spark, "frozen_test")
    df = spark.range(10).select("id", (F.col("id") * 2).alias("v"))
    manifest = frozen.freeze(df, folder, "v1")
    assert manifest["rows"] == 10 and frozen.load(spark, folder, "v1").count() == 10
    with pytest.raises(Exception):
        frozen.freeze(df, folder, "v1")
    df.limit(1).write.mode("append").parquet(f"{folder}/v1/rows")
    with pytest.raises(ValueError):
        frozen.load(spark, folder, "v1")


def test_valence_with_context(spark):
    texts = ["good", "not good", "very good", "slightly good", "The plot was great, but the end was awful", "awful start but great end", "isn't it good", "neutral words only", "", None, "good " * 400]
    got = {r.id: r for r in V.valence_scores(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    v = lambda k: got[k].valence
    assert v(1) < 0 < v(3) < v(0) < v(2) and v(4) < 0 < v(5) and v(6) < 0
    assert round(v(0), 6) == round(1.9 / (1.9**2 + 15) ** 0.5, 6) and got[0].label == "positive" and got[1].label == "negative"
    assert [(got[k].hits, got[k].valence, got[k].label) for k in (7, 8, 9)] == [(0, None, None)] * 3 and 0.99 < v(10) <= 1


def test_valence_of_a_long_text_is_linear(spark):
    """A text of 40,000 words is cut into words once; done once per word, this takes minutes."""
    long = spark.createDataFrame([(1, "plain words " * 20_000 + "not good but great")], "id long, text string")
    start = time.monotonic()
    row = V.valence_scores(long).first()
    assert time.monotonic() - start < 20 and row.hits == 2
    s = 1.9 * -0.74 * 0.5 + 3.1 * 1.5 * -0.74  # "not" stands up to three words before both
    assert round(row.valence, 9) == round(s / (s * s + 15) ** 0.5, 9)
    mine = spark.createDataFrame([("plain", 2.0), ("unseen", 1.0)], "word string, weight double")
    assert V.valence_scores(spark.createDataFrame([(1, "a plain, not plain one good"), (2, "none")], "id long, text string"), mine).orderBy("id").first().hits == 2


def test_names_of_few_syllables_meet_in_blocks(spark, monkeypatch):
    """Prefixes of such names at 0.7 are nearly whole names: blocks take over, and give the pairs of all names against all."""
    monkeypatch.setattr(similar, "BLOCK", 300)
    used = []
    whole = similar._met_in_blocks
    monkeypatch.setattr(similar, "_met_in_blocks", lambda *x: used.append(1) or whole(*x))
    rnd = random.Random(8)
    base = ["".join(rnd.choice(("th", "in", "er", "an ", "é", "on")) for _ in range(rnd.randrange(1, 14))) for _ in range(900)]
    names = spark.createDataFrame([(x,) for x in base + [x[:-2] + "q" for x in base[:50]]], "name string")
    got = similar.similar_pairs(names, names, 0.7)
    one = names.where("name <> ''").distinct().cache()
    a, b = one.withColumnRenamed("name", "a"), one.withColumnRenamed("name", "b")
    want = a.crossJoin(b).where(F.levenshtein("a", "b") <= F.floor(0.3 * F.greatest(F.length("a"), F.length("b")) + 1e-9))
    rows = [(r.a, r.b) for r in got.collect()]
    assert used and len(rows) == len(set(rows)) and set(rows) == {(r.a, r.b) for r in want.collect()}


def test_names_are_cut_once_and_side_by_side(spark, monkeypatch):
    """The grams of one table held against itself are made once, by as many tasks as there are shuffle partitions, however few bytes they are."""
    made = []
    whole = similar.materialize
    monkeypatch.setattr(similar, "materialize", lambda df, name: made.append((name, whole(df, name))) or made[-1][1])
    names = spark.range(3000).select(F.concat_ws(" ", *(F.substring(F.sha2(F.concat("id", F.lit(k)), 256), 1, 5) for k in range(4))).alias("name"))
    assert similar.similar_pairs(names, names, 0.7).where("a = b").count() == 3000
    assert [name for name, _ in made] == ["name_grams", "name_prefixes"]
    assert all(len(df.inputFiles()) >= int(spark.conf.get("spark.sql.shuffle.partitions")) for _, df in made)


@pytest.mark.parametrize("kind", ["repeats", "long", "many characters"])
def test_blocks_hold_all_pairs_of_odd_names(kind):
    """Two blocks of names, one against itself and against the other: all pairs that are near enough, with their distance or left to be verified."""
    rnd = random.Random(kind)
    letters = {"repeats": "ab ", "long": "abcdefgh ", "many characters": [chr(0x4E00 + k) for k in range(400)] + list("aé\U0001f600")}[kind]
    size = {"repeats": (1, 40), "long": (25, 90), "many characters": (1, 33)}[kind]
    names = ["".join(rnd.choice(letters) for _ in range(rnd.randint(*size))) for _ in range(60)]
    for name in names[:60]:
        for edits in (1, 4, 9):
            changed = list(name)
            for _ in range(edits):
                at = rnd.randrange(len(changed))
                changed[at : at + 1] = rnd.choice(([], [rnd.choice(letters)], [changed[at], rnd.choice(letters)])) or ["a"]
            names.append("".join(changed))
    names = list(dict.fromkeys(names))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for left, right, same in ((names[:130], names[130:], False), (names[:130], names[:130], True)):
        want = {(i, j): d for i, a in enumerate(left) for j, b in enumerate(right) if (i <= j or not same) and (d := distance(a, b)) <= 0.3 * max(len(a), len(b)) + 1e-9}
        rows = [tuple(map(int, r)) for part in similar._near_in_blocks(left, right, 0.7, same) for r in zip(*part)]
        got = {(i, j): d for i, j, d in rows}
        assert len(got) == len(rows) and set(want) <= set(got) and len(want) > 130 * same + 20
        assert all(want.get(pair) == d for pair, d in got.items() if d >= 0)
        if kind == "repeats":
            assert set(got) == set(want)
