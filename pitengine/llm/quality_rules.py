"""Quality rules: base limits, then robust multivariate outliers per language and source.

Each text gives five statistics; a transformed vector of them is held against a minimum-covariance-determinant
estimate of its group and rejected if its squared Mahalanobis distance is above a chi-square quantile.

The estimate is the fast algorithm for large data. A sample of about ``START_ROWS`` rows of the group, picked by a digest of the
row, gives starts: coordinate-wise medians, and ``TRIALS`` small random subsets, each improved by concentration steps in numpy; the
``STARTS`` of least determinant go on. Then come concentration steps over all rows of the group: rows are ranked by
distance, the nearest ``KEPT`` part gives the next mean and covariance, until no determinant falls any more (``ROUNDS`` at
most); the start of least determinant is the group's estimate. Ranks come from counts in bins of distance (``PER_OCTAVE`` to a
doubling, without a last one), so a group of any size needs some hundred counts and no ordering; means and covariances come
from sums. Text is read once; the rounds read a written table of five numbers a row.

As many statistics are zero in most texts, a small variance (``FLOORS``) is added to each coordinate, which keeps the covariance
from collapsing on them. It is set so that a row that is at the edge of the base limits in repeated words, or repeats 16 lines, or
has symbols in 5 % of its characters, or words 1.6 times as long as its group's, is rejected for that alone. A group's
covariance is pulled towards the mean of all groups' as ``PRIOR`` rows would, so a small group needs no rule of its own: a
group of one row keeps it, and the pull fades with size. Rows that fail the base limits are in no estimate.

Defined cases: null, empty and white-space texts have no word and fail. A very long text is read whole. Null languages and sources are
groups like others. Repeated rows count each; equal distances share a bin and are kept or left together. Empty
tables work; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitengine.llm._shared import materialize, table

SPACES, SYMBOLS = "\t\n\x0b\x0c\r ", "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
KEPT, PRIOR = 0.75, 20
START_ROWS, TRIALS, STARTS, ROUNDS = 600, 20, 2, 25
#: A start's steps end when its log determinant no longer falls by more; ranks that are met to a bin let it waver below that.
LEAST_FALL = 1e-3
TAIL = 1e-5
#: Variance added to each coordinate, as a standard deviation: log words, log word length, symbols, repeated lines, repeated words.
FLOORS = (0.5, 0.08, 0.3, 0.5, 0.69)
P = len(FLOORS)
#: Bins of a distance to a doubling (of 1/16 plus the distance).
PER_OCTAVE = 16
X = [f"x{k}" for k in range(P)]
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def chi2_below(x: float, k: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, k) < q else (low, mid)
    return high


CUTOFF = chi2_quantile(1 - TAIL, P)
#: Makes the covariance of the nearest KEPT part that of the whole, for normal data.
CONSISTENCY = KEPT / chi2_below(chi2_quantile(KEPT, P), P + 2)


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            repeated += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    often, covered, reach = Counter(windows), 0, 0
    if len(often) < len(windows):
        for k, window in enumerate(windows):
            if often[window] > 1:
                covered += k + 3 - max(reach, k)
                reach = k + 3
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated, covered


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    def run(batches):
        for batch in batches:
            found = np.array([statistics(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in found.T)], ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, STATS)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics of rows with words."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log(n.cast("double")),
        F.log(chars / n),
        F.log1p(100 * F.col("n_symbols") / chars),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.log1p(100 * F.col("n_repeat_words") / n),
    ]


def _regular(cov: np.ndarray) -> np.ndarray:
    return cov + np.diag(np.square(FLOORS))


def _nearest(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the nearest KEPT part of x."""
    d = x - mean
    distance = np.einsum("ij,jk,ik->i", d, np.linalg.inv(_regular(cov)), d)
    near = x[np.argsort(distance, kind="stable")[: math.ceil(KEPT * len(x))]]
    return near.mean(axis=0), np.cov(near.T, bias=True) * CONSISTENCY


def starts(x: np.ndarray, seed: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The STARTS estimates (log determinant, mean, covariance) of least determinant that medians and random subsets lead to."""
    rng = np.random.default_rng(seed)
    median = np.median(x, axis=0)
    # 1.4826: the standard deviation of normal data as a multiple of their median deviation
    tried = [(median, np.diag(np.square(1.4826 * np.median(np.abs(x - median), axis=0))))]
    for _ in range(TRIALS):
        some = x[rng.choice(len(x), min(len(x), P + 1), replace=False)]
        tried.append((some.mean(axis=0), np.cov(some.T, bias=True)))
    size = lambda cov: float(np.linalg.slogdet(_regular(cov))[1])
    short = sorted((size(c), k, m, c) for k, (m, c) in enumerate(_nearest(x, *_nearest(x, *t)) for t in tried))[: 2 * STARTS]
    out = []
    for last, k, m, c in short:
        for _ in range(ROUNDS):
            m, c = _nearest(x, m, c)
            last, before = size(c), last
            if last >= before - 1e-9:
                break
        out.append((last, k, m, c))
    return [(d, m, c) for d, _, m, c in sorted(out, key=lambda t: t[:2])[:STARTS]]


def _first_estimates(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """group, start, n, mean, cov of each start of each group."""
    part = F.conv(F.substring(F.md5(F.concat_ws(",", *(F.col(x).cast("string") for x in ("doc_id", *X)))), 1, 8), 16, 10).cast("long")
    some = rows.join(sizes, "group").where(part < F.least(F.lit(1.0), START_ROWS / F.col("n")) * (1 << 32))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", *X])
        found = starts(frame[X].to_numpy(float), zlib.crc32(frame["group"].iloc[0].encode("utf-8", "surrogatepass")))
        return pd.DataFrame({"group": frame["group"].iloc[0], "start": range(len(found)), "n": frame["n"].iloc[0], "mean": [m.tolist() for _, m, _ in found], "cov": [c.reshape(-1).tolist() for _, _, c in found]})

    return some.groupBy("group").applyInPandas(run, "group string, start int, n long, mean array<double>, cov array<double>")  # about START_ROWS rows


def _with_inverse(groups: DataFrame) -> DataFrame:
    """Adds the inverse and the log determinant of the covariance with the floors on its diagonal. Each row is handled alone."""

    def run(batches):
        for batch in batches:
            cov = np.array(batch.column("cov").to_pylist(), float).reshape(-1, P, P) + np.diag(np.square(FLOORS))
            inverse = list(np.linalg.inv(cov).reshape(len(cov), P * P)) if len(cov) else []
            size = np.linalg.slogdet(cov)[1] if len(cov) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("group", "start", "n", "mean", "cov")), pa.array(inverse, pa.list_(pa.float64())), pa.array(size, pa.float64())], ["group", "start", "n", "mean", "cov", "inverse", "size"])

    return groups.mapInArrow(run, "group string, start int, n long, mean array<double>, cov array<double>, inverse array<double>, size double")


def _distance() -> Column:
    d = [F.col(x) - F.col("mean")[k] for k, x in enumerate(X)]
    total = None
    for i in range(P):
        for j in range(P):
            part = d[i] * d[j] * F.col("inverse")[P * i + j]
            total = part if total is None else total + part
    return total


def _bin() -> Column:
    return F.floor(PER_OCTAVE * F.log2(1 + 16 * F.greatest(_distance(), F.lit(0.0)))).cast("int")


def _step(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Means and covariances of the nearest KEPT part of each group, from each start's estimate."""
    keys = ["group", "start"]
    counts = rows.join(groups, "group").groupBy(*keys, _bin().alias("bin")).agg(F.count("*").alias("m"), F.first("n").alias("n"))
    below = F.sum("m").over(Window.partitionBy(*keys).orderBy("bin"))  # some hundred bins at most
    last = counts.withColumn("below", below).where(F.col("below") >= KEPT * F.col("n")).groupBy(*keys).agg(F.min("bin").alias("last"))
    inner = rows.join(materialize(groups.join(last, keys), "quality_limits"), "group").where(_bin() <= F.col("last"))
    # centred on the last mean, so that products keep their digits
    centred = [F.col(x) - F.col("mean")[k] for k, x in enumerate(X)]
    shifts = [F.avg(c).alias(f"s_{i}") for i, c in enumerate(centred)]
    products = [F.avg(centred[i] * centred[j]).alias(f"p_{i}_{j}") for i in range(P) for j in range(i, P)]
    found = inner.groupBy(*keys).agg(F.max("n").alias("n"), F.first("mean").alias("old"), *products, *shifts)
    cov = [(F.col(f"p_{min(i, j)}_{max(i, j)}") - F.col(f"s_{i}") * F.col(f"s_{j}")) * CONSISTENCY for i in range(P) for j in range(P)]
    return found.select(*keys, "n", F.array(*(F.col("old")[k] + F.col(f"s_{k}") for k in range(P))).alias("mean"), F.array(*cov).alias("cov"))


def estimates(rows: DataFrame) -> DataFrame:
    """group, n, mean, inverse of each group of rows (group, doc_id and coordinates)."""
    # a written table: Spark sees that it is small and rows are sampled where they are, without a shuffle by group
    sizes = materialize(rows.groupBy("group").agg(F.count("*").alias("n")), "quality_sizes")
    active, done = materialize(_with_inverse(_first_estimates(rows, sizes)), "quality_groups"), None
    for k in range(ROUNDS):
        after = materialize(_with_inverse(_step(rows, active)), "quality_groups")
        falls = after.join(active.select("group", "start", F.col("size").alias("old")), ["group", "start"]).where(F.col("size") < F.col("old") - LEAST_FALL).drop("old")
        falls = materialize(falls, "quality_falling")
        last = k == ROUNDS - 1 or falls.limit(1).count() == 0
        ended = active.join(falls, ["group", "start"], "left_anti")
        done = ended if done is None else done.unionByName(ended)
        if last:
            break
        active = falls
    groups = done.unionByName(falls)
    best = groups.groupBy("group").agg(F.min_by(F.struct("start", "n", "mean", "cov"), F.struct("size", "start")).alias("best")).select("group", "best.*")
    all_groups = best.agg(*(F.try_divide(F.sum(F.col("n") * F.col("cov")[k]), F.sum("n")).alias(f"c{k}") for k in range(P * P))).first()
    pooled = [c or 0.0 for c in all_groups]
    pulled = F.array(*((F.col("n") * F.col("cov")[k] + PRIOR * pooled[k]) / (F.col("n") + PRIOR) for k in range(P * P)))
    return materialize(_with_inverse(best.withColumn("cov", pulled)).select("group", "n", "mean", "inverse"), "quality_estimates")


def quality(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and distance (null where a group has no row within the base limits) of every row."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = with_statistics(docs, **columns).withColumn("base_failed", base_failed()).withColumns(dict(zip(X, vector())))
    rows = materialize(rows.withColumn("group", F.concat(name("lang"), F.lit("\x01"), name("source"))).drop("lang", "source"), "quality_rows")
    groups = estimates(rows.where(~F.col("base_failed")).select("group", "doc_id", *X))
    judged = rows.join(groups.select("group", "mean", "inverse"), "group", "left").withColumn("distance", F.round(_distance(), 6))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
