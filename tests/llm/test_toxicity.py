import math
import re
import zlib

import pytest
import zstandard

from pitengine.llm import toxicity as T

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, T.fit(docs, labels)


def plain_score(text, toxic, ordinary, tau, base, slope):
    """The rule again, with the zstandard library alone: windows of four words, the better of whole text and densest 256 windows."""

    def size(dictionary, window):
        params = zstandard.ZstdCompressionParameters(compression_level=6, window_log=18, min_match=6, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        learned = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        if learned:
            learned.precompute_compress(compression_params=params)
        return len(zstandard.ZstdCompressor(compression_params=params, dict_data=learned).compress(window + b" 0123456789ABCDEF 0123456789ABCDEF"))

    found = [f" {w} ".encode() for w in re.findall(r"[^\W\d_]{1,16}", (text or "").lower())]
    cut = [b"".join(found[k : k + 4]) for k in range(0, len(found), 4)]
    gain = [max(0, size(ordinary, w) - size(toxic, w) - tau + 1) for w in cut]
    spans = [gain] + [gain[k : k + 256] for k in range(len(gain) - 255)]
    return 1 / (1 + math.exp(-max((sum(s) - base - slope * len(s)) / math.sqrt(1 + slope * len(s)) for s in spans)))


def test_held_out(spark, fitted):
    """sf0.1 has 360 toxic training texts; the README gives the figures of the larger tables."""
    docs, labels, model = fitted
    rows = T.score(docs, model).join(labels, "doc_id").select("doc_id", "score", "predicted", "toxic").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum(r.predicted == r.toxic for r in held)
    flagged = [r for r in held if r.predicted]
    assert right >= 0.92 * len(held) and sum(r.toxic for r in flagged) >= 0.85 * len(flagged)
    assert sum(r.toxic for r in flagged) >= 0.4 * sum(r.toxic for r in held)
    assert all(0 <= r.score <= 1 and (r.score >= 0.5) == r.predicted for r in rows)


def test_dictionaries_are_trained_and_of_equal_size(fitted):
    model = fitted[2]
    assert len(model.toxic) == len(model.ordinary) >= T.SHARED + min(T.OWN) and model.toxic != model.ordinary


def test_labels_of_the_held_out_fold_are_not_learned(spark, fitted):
    from pyspark.sql import functions as F

    from pitengine.llm._shared import fold

    docs, labels, model = fitted
    other = labels.withColumn("toxic", F.when(fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert T.fit(docs, other) == model


def test_matches_plain_scoring(spark, fitted):
    docs, _, model = fitted
    rows = T.score(docs.where("doc_id < 60"), model).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        assert r.score == pytest.approx(plain_score(r.text, model.toxic, model.ordinary, model.tau, model.base, model.slope), abs=1e-12)


def test_words_no_list_holds_are_learned(spark):
    """Planted words of any script are learned from texts alone, and a passage in a very long text is found."""
    import random

    rng = random.Random(5)
    ordinary = ["".join(rng.choice(["lo", "mi", "ra", "te", "sun", "ver", "hal"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    planted = ["zorquax", "vibblet", "прукна"]
    texts = []
    for k in range(3000):
        w = rng.choices(ordinary, k=60)
        if k % 5 == 0:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(planted)
        texts.append((k, " ".join(w), int(k % 5 == 0)))
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in texts], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    long = rng.choices(ordinary, k=20_000)
    clean = " ".join(long)
    long[9_000:9_020] = rng.choices(planted, k=20)
    some = [(1, "ra zorquax sunver mi vibblet lomi zorquax"), (2, "ra sunver mi lomi te halra"), (3, " ".join(long)), (4, clean)]
    got = {r.doc_id: r.predicted for r in T.score(spark.createDataFrame(some, "doc_id long, text string"), model).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0}


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (None, 1), (5, 1), (5, 0), (99, 1)], "doc_id long, toxic int")
    rows = T.score(odd_docs, T.fit(odd_docs, labels)).collect()
    assert len(rows) == odd_docs.count() and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in rows if r.doc_id in (1, 2, 3, 4))
    left = T.drop_toxic(odd_docs, labels)
    assert left.schema == odd_docs.schema and left.count() == odd_docs.count()
    assert T.drop_toxic(no_docs, labels).count() == 0
    empty = T.fit(no_docs, labels.limit(0))
    assert T.score(odd_docs, empty).where("predicted = 1").count() == 0


def test_windows_cover_the_whole_text():
    text = " ".join("word" + "abcdefghij"[k % 10] * (k % 9) for k in range(1003))
    assert b"".join(T.windows(text)).split() == text.encode().split() and T.windows(None) == T.windows(" \n") == []
    assert b"".join(T.windows("你" * 40)).replace(b" ", b"") == ("你" * 40).encode()
