import zlib

import numpy as np
from pyspark.sql import functions as F

from pitengine.llm import language_id as L
from pitengine.llm._shared import fold


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify(docs, L.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_languages_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    other = docs.withColumn("lang", F.when(fold("doc_id") == 0, F.lit("xx")).otherwise(F.col("lang")))
    one, two = L.fit(docs), L.fit(other)
    assert one.languages == two.languages and np.array_equal(one.masks, two.masks)


def own_grams(text):
    """The 4-grams around each letter, by plain strings."""
    s = "  " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    return [s[k - 2 : k + 2] for k, c in enumerate(s) if c != " "]


def test_filter_matches_sets():
    rng = np.random.default_rng(2)
    letters = [chr(c) for c in range(97, 123)]
    grams = {f"l{k:03d}": sorted({"".join(rng.choice(letters, 4)) for _ in range(5000)}) for k in range(70)}
    model, sets = L.build(grams, "l003"), {lang: set(g) for lang, g in grams.items()}
    texts = ["".join(rng.choice([*letters, " ", "."], 200)) for _ in range(20)]
    n, found = L.hits(texts, model)
    for k, text in enumerate(texts):
        own = own_grams(text)
        assert n[k] == len(own)
        for j, lang in enumerate(model.languages):
            exact = sum(g in sets[lang] for g in own)
            assert exact <= found[k, j] <= exact + 20
    assert max(model.false_rate) <= L.FILL**L.HASHES


def test_fit_and_decision_match_plain_sets(spark):
    """Fit, look-up and decision against sets of strings: every 4-gram counts, however rare and however many there are."""
    rng = np.random.default_rng(3)
    kinds = {"aa": "abcdefghijkl", "bb": "fghijklmnopq", "cc": "klmnopqrstuv"}
    rows = []
    for k in range(400):
        lang = ["aa", "bb", "cc"][k % 3]
        rows.append((k, " ".join("".join(rng.choice(list(kinds[lang]), rng.integers(1, 9))) for _ in range(120)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    sets = {lang: set() for lang in kinds}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            sets[lang].update(own_grams(text))
    assert min(map(len, sets.values())) > 3000
    found = {r.doc_id: r for r in L.identify(docs, model).collect()}
    for i, text, _ in rows:
        held = {lang: sum(g in s for g in own_grams(text)) for lang, s in sets.items()}
        assert found[i].lang_pred == max(sorted(held), key=held.get)
        assert abs(found[i].score - max(held.values()) / sum(held.values())) < 0.02


def test_odd_rows(spark, odd_docs, no_docs):
    model = L.build({"aa": ["  on", " one", "one "], "bb": ["  tw", " two", "two "]}, "bb")
    rows = {(r.doc_id, r.lang_pred) for r in L.identify(odd_docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und")} <= rows
    texts = [None, "", "12 !", "ONE", "one two", "zzz", "你", "x" * 3_000_000 + " one"]
    assert L.predict(texts, model)[0] == ["und", "und", "und", "aa", "aa", "bb", "bb", "aa"]
    assert L.fit(no_docs) is None
    assert {r.lang_pred for r in L.identify(odd_docs, None).collect()} == {"und"}
    assert L.identify(no_docs, model).count() == 0
    assert L.identify(odd_docs, L.fit(odd_docs)).count() == odd_docs.count()
