import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pitengine.llm import quality_rules as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    often = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if often[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, sf, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        for r in docs.collect():
            assert Q.statistics(r.text) == plain(r.text)
    assert Q.statistics("a b c a b c a") == (7, 7, 0, 0, 7) and Q.statistics("x\nx\n\n \n x\nx") == (4, 4, 0, 2, 4)


def test_chi_square():
    assert math.isclose(Q.chi2_quantile(0.95, 1), 3.841459, abs_tol=1e-5) and math.isclose(Q.chi2_quantile(0.99, 5), 15.086272, abs_tol=1e-5)


def mcd(x, floors=(0.5, 0.08, 0.3, 0.5, 0.69), kept=0.75, seeds=25):
    """Squared distances by the covariance of least determinant over many random starts, exact ranks, in memory."""
    floors, h, best = np.diag(np.square(floors)), math.ceil(kept * len(x)), None
    for seed in range(seeds):
        rng = np.random.default_rng(seed)
        near = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(30):
            d = x - near.mean(axis=0)
            cov = np.cov(near.T, bias=True) * (Q.CONSISTENCY if len(near) == h else 1) + floors
            near = x[np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d), kind="stable")[:h]]
        cov = np.cov(near.T, bias=True) * Q.CONSISTENCY
        size = np.linalg.slogdet(cov + floors)[1]
        if best is None or size < best[0] - 1e-9:
            best = size, near.mean(axis=0), cov
    return best


def coordinates(r):
    return [math.log(r.n_words), math.log(r.word_chars / r.n_words), math.log1p(100 * r.n_symbols / r.word_chars), math.log1p(r.n_dup_lines), math.log1p(100 * r.n_repeat_words / r.n_words)]


def test_distances_match_a_plain_estimate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.lit("one"))
    got = Q.quality(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    groups = {lang: [r for r in got if r.lang == lang and not r.base_failed] for lang in {r.lang for r in got}}
    found = {lang: mcd(np.array([coordinates(r) for r in rows])) for lang, rows in groups.items() if rows}
    total = sum(len(groups[lang]) for lang in found)
    pooled = sum(len(groups[lang]) * cov for lang, (_, _, cov) in found.items()) / total
    for lang, (_, mean, cov) in found.items():
        n = len(groups[lang])
        inverse = np.linalg.inv((n * cov + 20 * pooled) / (n + 20) + np.diag(np.square((0.5, 0.08, 0.3, 0.5, 0.69))))
        d = np.array([coordinates(r) for r in groups[lang]]) - mean
        want = np.einsum("ij,jk,ik->i", d, inverse, d)
        assert np.allclose([r.distance for r in groups[lang]], want, rtol=0.08, atol=0.05)  # ranks are met to a bin
        assert all(r.kept == bool(w <= Q.CUTOFF) for r, w in zip(groups[lang], want) if abs(w / Q.CUTOFF - 1) > 0.08)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.base_failed or not r.kept) for r in got)


def prose(rng, words, n):
    return " ".join(rng.choice(words, n))


def test_outliers_of_each_kind_go_and_clean_rows_stay(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(4000)]
    rows = [(k, prose(rng, words, int(rng.lognormal(5.5, 0.7)) + 50), "en", "hot" if k % 3 else "cold") for k in range(600)]
    symbols = [(1000 + k, " ".join(w + "%%$$" for w in rng.choice(words, 200)), "en", "hot") for k in range(60)]
    lengthy = [(2000 + k, " ".join(a + b + c for a, b, c in rng.choice(words, (200, 3))), "en", "cold") for k in range(5)]
    repeats = [(3000 + k, prose(rng, words, 206) + " " + " ".join([prose(rng, words, 4)] * 50), "en", "hot") for k in range(5)]
    lines = [(4000 + k, "\n".join([prose(rng, words, 400), *["so it goes"] * 40]), "en", "cold") for k in range(5)]
    giant = [(5000, prose(rng, words, 300_000), "en", "cold")]
    mild = [(6000 + k, prose(rng, words, 200) + " " + " ".join([prose(rng, words, 10)] * 3), "en", "hot") for k in range(20)]
    bad = symbols + lengthy + repeats + lines + giant
    got = Q.quality(spark.createDataFrame(rows + bad + mild, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {b[0] for b in bad}
    assert not any(r.base_failed for r in got)


def test_groups_of_any_size_are_judged_alike(spark):
    """No least size: clean rows stay in groups of 1, 5, 99 and 100 rows, and a gross outlier goes from all that can tell it."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(2000)]
    rows, bad = [], []
    for size in (1, 5, 99, 100):
        rows += [(1000 * size + k, prose(rng, words, int(rng.lognormal(5.5, 0.5)) + 50), "en", f"s{size}") for k in range(size)]
        if size > 1:
            bad.append((1000 * size + 999, " ".join(w + "%%$$##" for w in rng.choice(words, 200)), "en", f"s{size}"))
    got = Q.quality(spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {b[0] for b in bad}


def test_far_distances_have_bins_of_their_own(spark):
    """A third of a group lies very far away, by different distances: the estimate must not take it in."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(2000)]
    rows = [(k, prose(rng, words, int(rng.lognormal(5.5, 0.5)) + 50), "en", "s") for k in range(300)]
    bad = [(1000 + k, "x".join("%#" * 40 for _ in range(2)) + " " + prose(rng, words, 60), "en", "s") for k in range(90)]
    got = Q.quality(spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {b[0] for b in bad}


def test_odd_rows(odd_docs, no_docs):
    rows = Q.quality(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(not r.kept for r in rows if r.doc_id in (1, 2, 3, 4))
    assert all(r.kept != r.base_failed for r in rows)
    assert Q.quality(no_docs).count() == 0
