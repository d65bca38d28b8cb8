import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

from pitengine.llm import periodic_runs as P


def plain_runs(words):
    """Runs by definition: every stretch of every period, extended until a neighbour breaks it, if no smaller period holds."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i : j + q]
            if length >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_answer(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def by_text(rows):
    return sorted(map(str, rows))


def test_runs_of_random_texts_match_the_definition():
    rnd = random.Random(5)
    texts = []
    for _ in range(800):
        words = []
        while len(words) < rnd.choice([0, 1, 5, 6, 7, 30, 120]):
            unit = [rnd.choice("abc") for _ in range(rnd.choice([1, 1, 2, 3, 5, 9]))]
            words += unit * rnd.choice([1, 1, 2, 4, 5, 8]) + unit[: rnd.randrange(len(unit) + 1)]
        texts.append(words)
    number = {w: k for k, w in enumerate("abc")}
    import numpy as np

    ids = [np.array([number[w] for w in t], np.int32) for t in texts]
    want = [plain_runs(t) for t in texts]
    assert sum(map(len, want)) > 300
    assert P.scan(ids, [(1, len(t) // 4) for t in texts]) == want
    for t, x, w in zip(texts, ids, want):  # ranges of lags, then the smallest period of equal stretches
        cut = len(t) // 8
        merged = {}
        for r in P.scan([x, x], [(1, cut), (cut + 1, len(t) // 4)]):
            for s, length, q in r:
                merged[s, length] = min(q, merged.get((s, length), q))
        assert sorted(((s, length, q) for (s, length), q in merged.items()), key=lambda r: (r[0], r[2])) == w


def test_query_over_whole_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = P.query(spark, sf).collect()
    want = [plain_answer(*r) for r in rows if len(r[1] or "") < 6_000]
    some = {w[0] for w in want}
    assert sum(w[1] > 0 for w in want) > 5
    assert by_text(tuple(r) for r in got if r[0] in some) == by_text(want)
    assert len(got) == len(rows)


def test_long_texts_by_ranges_of_lags(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = P.find_runs(docs, arrange=P.repeated_tail, long=10**9)
    monkeypatch.setattr(P, "RANGE", 2000)
    for long in (300, 2500):
        assert by_text(P.find_runs(docs, arrange=P.repeated_tail, long=long).collect()) == by_text(plain.collect())


def test_odd_rows(spark, odd_docs, clashing_docs, no_docs, tmp_path):
    want = None
    for name, docs in (("odd", odd_docs), ("clashing", clashing_docs)):
        path = tmp_path / name
        docs.write.parquet(str(path / "documents.parquet"))
        got = P.query(spark, str(path)).collect()
        if want is None:
            want = by_text(plain_answer(r.doc_id, r.text) for r in odd_docs.collect() if len(r.text or "") < 10_000)
        assert set(want) <= set(by_text(map(tuple, got))) and len(got) == docs.count()
    assert P.find_runs(no_docs).count() == 0
    assert P.find_runs(odd_docs, long=0).count() == odd_docs.count()


def test_a_text_of_one_word_many_times(spark):
    docs = spark.createDataFrame([(1, "la " * 30_000), (2, " ".join(f"w{k % 7500}" for k in range(30_000)))], "doc_id long, text string")
    for long in (10, 10**9):
        got = {r.doc_id: r for r in P.find_runs(docs, long=long).collect()}
        assert [tuple(x) for x in got[1].runs] == [(0, 30_000, 1)] and got[1].collapsed == "la"
        assert [tuple(x) for x in got[2].runs] == [(0, 30_000, 7500)] and got[2].collapsed.endswith("w7499")
