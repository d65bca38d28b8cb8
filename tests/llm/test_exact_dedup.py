import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitengine.llm import exact_dedup as X


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    low = lambda i: -(1 << 63) if i is None else i
    return sorted((str(i), str(max(groups[t or ""], key=low)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_matches_brute_force(spark, sf, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = X.exact_dedup(docs).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute(rows)
        assert sum(r.kept for r in got) == len({t or "" for _, t in rows})
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_keeps_columns_and_one_row_per_text(odd_docs, no_docs):
    left = X.drop_exact_copies(odd_docs)
    assert left.columns == odd_docs.columns
    texts = [r.text or "" for r in left.collect()]
    assert len(texts) == len(set(texts)) == odd_docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert X.drop_exact_copies(no_docs).count() == 0 == X.exact_dedup(no_docs).count()


def test_index_inserts_deletes_and_resizes():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (20_000, 5), dtype=np.uint64)
    index = X.CuckooIndex(buckets=16)
    for part in np.array_split(np.concatenate([keys, keys[:5000]]), 9):
        index.add(part, np.ones(len(part), np.int64), np.zeros((len(part), 2), np.int64))
    assert len(index) == 20_000 and index.resized and (index.find(keys) >= 0).all()
    assert (index.find(rng.integers(0, 1 << 63, (5000, 5), dtype=np.uint64)) < 0).all()
    index.remove(keys[:7000], np.ones(7000, np.int64))
    assert (index.find(keys[:5000]) >= 0).all() and (index.find(keys[5000:7000]) < 0).all() and len(index) == 18_000
    index.remove(keys[:5000], np.ones(5000, np.int64))
    index.add(keys[:100], np.ones(100, np.int64), np.zeros((100, 2), np.int64))
    assert len(index) == 13_100 and (index.find(keys[:100]) >= 0).all() and (index.find(keys[100:7000]) < 0).all()


def test_same_fingerprint_and_place_are_told_apart():
    keys = np.zeros((40, 5), np.uint64)
    keys[:, 3] = np.arange(40)  # all meet in two buckets, more than their slots hold
    keys[:, 0] = np.arange(40) // 8 * 1024
    index = X.CuckooIndex()
    index.add(keys, np.ones(40, np.int64), np.zeros((40, 2), np.int64))
    assert len(index) == 40 and (np.sort(index.find(keys)) == np.arange(40)).all()


def test_changes_keep_live_digests(spark):
    text = lambda xs: X.digests(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "doc_id long, text string"))
    index = X.build_index(text(["a", "a", "b", "c"])).select("digest", "n_bytes", "group_size")
    live = X.apply_changes(index, text(["d", "b"]), text(["a", "c", "zz"]))
    names = {hashlib.sha256(x.encode()).digest(): x for x in "abcd"}
    assert {names[bytes(r.digest)]: r.group_size for r in live.collect()} == {"a": 1, "b": 2, "d": 1}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_digests_that_meet_are_told_apart_by_content(odd_docs, monkeypatch, limit):
    """With a digest of one digit almost all texts of a length meet, and the content decides."""
    monkeypatch.setattr(X, "BROADCAST_KEYS", limit)
    weak = lambda t: F.unhex(F.concat(F.lit("0"), F.substring(F.sha2(t.cast("binary"), 256), 1, 1), F.repeat(F.lit("0"), 62)))
    docs = odd_docs.sparkSession.createDataFrame([(k, "abcdefgh"[k % 8]) for k in range(90)] + [(None, "a"), (7, "a")], "doc_id long, text string")
    got = X.exact_dedup(docs, digest=weak).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == [w[:3] for w in want]
    assert sum(r.kept for r in got) == 8


def test_full_index_hands_on_and_deletes_what_was_met_once(spark, monkeypatch):
    monkeypatch.setattr(X, "COMBINE_KEYS", 50)
    docs = spark.createDataFrame([(k, f"text {k % 300 if k % 2 else 'hot'}") for k in range(2000)], "doc_id long, text string")
    got = X.exact_dedup(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_drop_with_clashing_names(clashing_docs):
    left = X.drop_exact_copies(clashing_docs)
    assert left.schema == clashing_docs.schema
    assert left.count() == clashing_docs.select(F.coalesce("text", F.lit(""))).distinct().count()
