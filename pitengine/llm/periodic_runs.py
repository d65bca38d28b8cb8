"""Periodic runs of words: an all-lag vectorised scan.

A run is a stretch of consecutive words with smallest period q and a length of at least max(``MIN_LENGTH``,
``MIN_EXP`` * q) that no neighbouring word extends keeping period q. Each shift q up to n / MIN_EXP compares the array
of word ids with itself, moved by q places; a stretch of k equal places is a stretch of k + q words with period q.
Only stretches of at least (MIN_EXP - 1) * q equal places count, and such a stretch covers two neighbouring places at
a multiple of its least length less one. So each shift compares those places first, of all documents of a block at
once, and run-lengths in full the documents with an equal pair. As MIN_EXP is 2 or more, a stretch whose smallest
period is less than q is a run of that divisor of q with the same two ends: of equal stretches the smallest period
stays.

Spark parts the work by documents and, in texts from ``LONG`` code points, also by ranges of lags: the word ids of a
long text go to one task per range, and its runs meet by document. A text's runs are fewer than its words.

Defined cases: null, empty and white-space texts have no words, no runs and an empty collapsed text. Words are equal
when their UTF-8 is. Very long texts are read whole. A null id is an id like any other; rows that repeat an id or a
text are answered each. Empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitengine.llm._shared import materialize, shuffle_partitions, table

MIN_EXP, MIN_LENGTH = 4, 6
#: Code points of the texts that are scanned together, and from which a text's lags are parted over tasks.
BLOCK, LONG = 2_000_000, 60_000
#: Compared places (lags times words) of a range of lags, and the most ranges of a text.
RANGE, MOST_RANGES = 16_000_000, 256

RUNS = "array<struct<start: long, length: long, period: long>>"
#: Gives the word numbers, in their new order, of a document of so many words; None: as they are.
Arrange = Callable[[int | None, int], np.ndarray | None]
Run = tuple[int, int, int]


def least_equal(q: int, min_exp: int, min_length: int) -> int:
    """Equal places that a stretch at lag q needs."""
    return max(min_length - q, (min_exp - 1) * q)


def stretches(ids: np.ndarray, q: int, least: int) -> list[Run]:
    """(start, length, q) of each stretch with period q that can't be extended and has ``least`` equal places."""
    ends = np.concatenate([[-1], np.flatnonzero(ids[q:] != ids[:-q]), [len(ids) - q]])
    equal = np.diff(ends) - 1
    at = np.flatnonzero(equal >= least)
    return list(zip((ends[at] + 1).tolist(), (equal[at] + q).tolist(), [q] * len(at)))


def scan(docs: list[np.ndarray], ranges: list[tuple[int, int]], min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH) -> list[list[Run]]:
    """For each array of word ids and range of lags (first, last): its runs by start, then period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in docs]
    order = sorted((k for k in range(len(docs)) if ranges[k][0] <= ranges[k][1]), key=lambda k: -ranges[k][1])
    if not order:
        return [[] for _ in docs]
    flat = np.concatenate([docs[k] for k in order])
    ends = np.cumsum([len(docs[k]) for k in order])
    last = np.array([ranges[k][1] for k in order])
    alive = len(order)
    for q in range(min(r[0] for r in ranges), int(last[0]) + 1):
        while last[alive - 1] < q:  # the documents that reach this lag stand in front
            alive -= 1
        words = flat[: ends[alive - 1]]
        least = least_equal(q, min_exp, min_length)
        step = max(least - 1, 1)
        at = np.flatnonzero(words[: len(words) - q : step] == words[q::step]) * step
        at = at[at + q + 1 < len(words)] if least > 1 else at
        if least > 1 and len(at):
            at = at[words[at + 1] == words[at + 1 + q]]
        if not len(at):
            continue
        owner = np.searchsorted(ends[:alive], at, side="right")
        for k in np.unique(owner[at + q + (least > 1) < ends[owner]]).tolist():
            if ranges[order[k]][0] <= q:
                for start, length, _ in stretches(docs[order[k]], q, least):
                    found[order[k]].setdefault((start, length), q)
    return [sorted(((s, n, q) for (s, n), q in own.items()), key=lambda r: (r[0], r[2])) for own in found]


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay: those that are in no run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def words_of(text: bytes | None, key: int | None, arrange: Arrange | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, arranged anew where asked for."""
    words = text.split() if text else []
    order = arrange(key, len(words)) if arrange and words else None
    return words if order is None else [words[k] for k in order.tolist()]


def _blocks(batch: pa.RecordBatch, arrange: Arrange | None) -> Iterator[tuple[int, list[list[bytes]], list[np.ndarray]]]:
    """First row, words and word ids of the rows that are scanned together; equal words of a block have equal ids."""
    keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
    start, size, words = 0, 0, []
    for k, (key, text) in enumerate(zip(keys, texts)):
        buffer = text.as_buffer() if text.is_valid else None
        words.append(words_of(buffer and buffer.to_pybytes(), key, arrange))
        size += buffer.size if buffer else 0
        if size >= BLOCK or k == len(keys) - 1:
            number = defaultdict(count().__next__).__getitem__
            yield start, words, [np.fromiter(map(number, w), np.int32, len(w)) for w in words]
            start, size, words = k + 1, 0, []


def _answer(ids: pa.Array, words: list[list[bytes]], runs: list[list[Run]]) -> pa.RecordBatch:
    texts = [b" ".join(w) if not r else b" ".join([x for x, stays in zip(w, kept_words(len(w), r).tolist()) if stays]) for w, r in zip(words, runs)]
    flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
    each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), each)
    return pa.RecordBatch.from_arrays([ids, lists, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrange: Arrange | None = None, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH, long: int = LONG) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start, then period) and the collapsed text of each row."""
    if min_exp < 2:
        raise ValueError("min_exp must be 2 at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    is_long = F.coalesce(F.length("text") >= long, F.lit(False))

    def whole(batches):
        for batch in batches:
            for first, words, ids in _blocks(batch, arrange):
                runs = scan(ids, [(1, len(w) // min_exp) for w in words], min_exp, min_length)
                yield _answer(batch.column("doc_id").slice(first, len(words)), words, runs)

    answer = f"doc_id long, runs {RUNS}, collapsed string"
    short = rows.where(~is_long).mapInArrow(whole, answer)

    kept = materialize(rows.where(is_long).withColumn("key", F.monotonically_increasing_id()), "long_texts")

    def numbered(batches):
        for batch in batches:
            for first, words, ids in _blocks(batch, arrange):
                keys = batch.column("key").slice(first, len(words))
                yield pa.RecordBatch.from_arrays([keys, pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["key", "n", "ids"])

    units = kept.mapInArrow(numbered, "key long, n long, ids binary")
    lags = F.floor(F.col("n") / min_exp)
    parts = F.least(F.greatest(F.ceil(F.col("n") * lags / RANGE), F.lit(1)), F.lit(MOST_RANGES)).cast("long")
    units = units.withColumn("lags", lags).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    units = units.repartition(shuffle_partitions(spark), "key", "part")

    def ranged(batches):
        for batch in batches:
            for key, n, ids, lags, parts, part in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "ids", "lags", "parts", "part"))):
                words = np.frombuffer(ids, np.int32)
                runs = scan([words], [(1 + part * lags // parts, (part + 1) * lags // parts)], min_exp, min_length)[0]
                flat = np.array(runs, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(runs), pa.int64()), *(pa.array(flat[:, k]) for k in range(3))], ["key", "start", "length", "period"])

    found = units.mapInArrow(ranged, "key long, start long, length long, period long")
    found = found.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    found = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("found"))

    def gathered(batches):
        for batch in batches:
            own = [[(r["start"], r["length"], r["period"]) for r in runs or ()] for runs in batch.column("found").to_pylist()]
            for first, words, _ in _blocks(batch, arrange):
                yield _answer(batch.column("doc_id").slice(first, len(words)), words, own[first : first + len(words)])

    return short.unionByName(kept.join(found, "key", "left").mapInArrow(gathered, answer))


def repeated_tail(key: int | None, n: int) -> np.ndarray | None:
    """The query's rule: in documents with crc32(id) divisible by 10, words from a place on repeat with a period."""
    h = crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    order = np.arange(n)
    order[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return order


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), arrange=repeated_tail)
    exact_more = lambda r, b: r["length"] * b["period"] > b["length"] * r["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(exact_more(r, b), r).otherwise(b))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
