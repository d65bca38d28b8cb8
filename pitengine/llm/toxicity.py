"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

A text's letters are cut into words (runs of letters, of ``LONGEST`` letters at most, so that scripts without spaces are cut
too) and its words into windows of ``WINDOW``. Each window is compressed with either dictionary; what the toxic one saves
from ``tau`` bytes up adds to the text's excess. The excess is held against a line over the number of windows, in the whole
text or in its densest stretch of ``STRETCH`` windows, so that a long text does not dilute a passage. ``tau``, the line and
the size of the dictionaries are calibrated on labelled texts that trained no dictionary.

All dictionaries come from the library's trainer, over windows of whole class texts. Two dictionaries that are trained
apart differ in common words by chance, and that noise drowns a few toxic words. So both start with the same
``SHARED`` bytes, trained on ordinary text; the rest, of equal size, is trained on those words of the own class that the shared
part does not shorten. A fixed tail that compresses well is added to each window, because zstandard stores short
inputs that gain too little as they are.

Fitting takes at most about ``MAX_TRAIN`` labelled rows outside fold 0, picked by a digest of their id, and about
``MAX_SAMPLE`` bytes of their windows a class, picked by a digest of the window. Near copies among the rows count once
(by the smallest hash of their word 5-grams), so that a group of copies cannot fill a dictionary. Fold 4 calibrates.

Defined cases: null, empty and white-space texts have no window and score low. A very long text is read whole, a window at a time.
Labels of a repeated id count by their largest value; null labels don't count. A null id is never learned from. Rows that repeat
an id are scored each. Of near copies in training the text that sorts first counts. If one class has no training text, the
dictionaries are empty and every score is low. Extra columns are ignored by ``score`` and kept by ``drop_toxic``, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitengine.llm._shared import fold, materialize, table

WINDOW, LONGEST, STRETCH = 4, 16, 256
MAX_TRAIN, MAX_SAMPLE = 20_000, 16_000_000
#: Bytes of the dictionaries: the shared part, and the sizes of the class's own part that calibration chooses from.
SHARED, OWN = 1 << 16, (512, 1024, 2048)
#: The trainer's segment size and the length of the strings it counts; the compressor's shortest match.
SEGMENT, COUNTED, SHORTEST = 24, 6, 6
#: Shorter words are no training text of a class's own part: with the spaces around them they are no longer than a match.
LEAST_LETTERS = 4
#: Words of a training sample.
SAMPLE_WORDS = 8
TAIL = b" 0123456789ABCDEF" * 2
TAUS = (1, 2, 3, 4, 5, 6, 7)
#: The line: least excess of a text without length, and excess per window.
BASES, SLOPES = (0.5, 1.5, 2.5, 3.5, 5.5, 8.5), (0.0, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.2)
CALIBRATION_FOLD = 4
_WORD = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)


@dataclass(frozen=True)
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    tau: int = TAUS[-1]
    base: float = BASES[-1]
    slope: float = SLOPES[-1]


def words(text: str | None) -> list[bytes]:
    return [b" " + w.encode() + b" " for w in _WORD.findall((text or "").lower())]


def windows(text: str | None) -> list[bytes]:
    w = words(text)
    return [b"".join(w[k : k + WINDOW]) for k in range(0, len(w), WINDOW)]


@lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(compression_level=6, window_log=18, min_match=SHORTEST, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    if not content:
        return zstandard.ZstdCompressor(compression_params=params)
    learned = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    learned.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=learned)


def savings(text: str | None, toxic: bytes, ordinary: bytes) -> np.ndarray:
    """For each window, how many bytes less the toxic dictionary needs."""
    a, b = _compressor(toxic).compress, _compressor(ordinary).compress
    return np.array([len(b(w)) - len(a(w)) for w in (w + TAIL for w in windows(text))], np.int64)


def excess(saved: np.ndarray, tau: int) -> tuple[int, int, int]:
    """What windows save from tau bytes up: in the whole text, in its densest stretch, and the windows of that stretch."""
    gain = np.where(saved >= tau, saved - tau + 1, 0)
    if len(gain) <= STRETCH:
        return int(gain.sum()), int(gain.sum()), len(gain)
    along = np.concatenate([[0], np.cumsum(gain)])
    return int(along[-1]), int((along[STRETCH:] - along[:-STRETCH]).max()), STRETCH


def score_of(saved: np.ndarray, model: Model) -> float:
    """1/2 on the line; the distance to it in units that grow with the length as chance does. The better of text and stretch counts."""
    whole, densest, n = excess(saved, model.tau)
    z = max((found - model.base - model.slope * k) / math.sqrt(1 + model.slope * k) for found, k in ((whole, len(saved)), (densest, n)))
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _near_copy_key(text: str | None) -> int:
    w = words(text)
    return min((xxhash.xxh64_intdigest(b"".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))), default=0) >> 1


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> DataFrame:
    """part (fold), text and toxic (0 or 1) of at most about max_train labelled rows outside fold 0, near copies once."""
    labels = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"), fold(id_col).cast("int").alias("part")).where("part <> 0")
    rows = rows.where(F.length("text") > 0)
    known = rows.select("_id").join(labels, "_id").count()
    if known > max_train:
        digit = F.conv(F.substring(F.md5(F.col("_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
        rows = rows.where(digit < int(max_train / known * (1 << 32)))

    def keyed(batches):
        for batch in batches:
            keys = pa.array([_near_copy_key(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, *batch.columns], ["key", *batch.schema.names])

    rows = rows.join(labels, "_id").select("part", "text", "toxic").mapInArrow(keyed, "key long, part int, text string, toxic int")
    first = rows.groupBy("key", "toxic").agg(F.min(F.struct("text", "part")).alias("first"))
    return materialize(first.select("first.part", "first.text", "toxic"), "toxicity_training")


def _samples(rows: DataFrame, toxic: int, max_sample: int) -> list[bytes]:
    """Windows of SAMPLE_WORDS words of the class's texts: all, or by a digest of the window as many as make max_sample bytes."""
    own = rows.where((F.col("toxic") == toxic) & (F.col("part") != CALIBRATION_FOLD)).select("text")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    limit = (1 << 64) if total <= max_sample else int(max_sample / total * (1 << 64))

    def run(batches):
        for batch in batches:
            for text in batch.column("text"):
                w = words(text.as_py())
                cut = [b"".join(w[k : k + SAMPLE_WORDS]) for k in range(0, len(w), SAMPLE_WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array([c for c in cut if xxhash.xxh64_intdigest(c) < limit], pa.binary())], ["window"])

    found = (bytes(r.window) for r in own.mapInArrow(run, "window binary").collect())  # about max_sample bytes
    return sorted(found, key=lambda w: (xxhash.xxh64_intdigest(w), w))  # the trainer takes a piece from each stretch of its input, so similar windows must not lie together


def _train(size: int, samples: list[bytes]) -> bytes:
    """The library's trained dictionary; as plain content, because its entropy tables would make lengths differ by chance. Few samples: themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=COUNTED).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _unshortened(samples: list[bytes], shared: bytes) -> list[bytes]:
    """The words of the samples that the shared dictionary doesn't shorten, again as samples."""
    compress = _compressor(shared).compress
    empty, known = len(compress(TAIL)), {}

    def new(word: bytes) -> bool:
        if word not in known:
            known[word] = len(word.decode()) - 2 >= LEAST_LETTERS and len(compress(word + TAIL)) - empty >= len(word)
        return known[word]

    out = []
    for sample in samples:
        kept = [w for w in (b" " + x + b" " for x in sample.split()) if new(w)]
        if kept:
            out.append(b"".join(kept))
    return out


def dictionaries(toxic: list[bytes], ordinary: list[bytes], shared: int = SHARED, sizes: tuple[int, ...] = OWN) -> list[tuple[bytes, bytes]]:
    """For each size of the own part, the dictionaries of both classes."""
    common = _train(shared, ordinary)
    own = [_unshortened(samples, common) for samples in (toxic, ordinary)]
    return [tuple(common + _train(size, samples) for samples in own) for size in sizes]


def _calibrate(rows: DataFrame, tried: list[tuple[bytes, bytes]]) -> Model:
    """The dictionaries, tau and line with the fewest errors on the calibration rows; of equally good ones the middle."""
    shared = rows.sparkSession.sparkContext.broadcast(tried)

    def run(batches):
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic")):
                for k, pair in enumerate(shared.value):
                    saved = savings(text.as_py(), *pair)
                    found = [(tau, *excess(saved, tau)) for tau in TAUS]
                    columns = [pa.array([v] * len(TAUS), pa.int32()) for v in (label.as_py(), k, len(saved))] + [pa.array(c, pa.int32()) for c in zip(*found)]
                    yield pa.RecordBatch.from_arrays(columns, ["toxic", "pair", "n", "tau", "whole", "densest", "stretch"])

    held = rows.where(F.col("part") == CALIBRATION_FOLD).select("text", "toxic")
    seen = held.mapInArrow(run, "toxic int, pair int, n int, tau int, whole int, densest int, stretch int").toPandas()  # at most about MAX_TRAIN rows, each a few times
    errors = {}
    for (pair, tau), g in seen.groupby(["pair", "tau"]):
        label = g["toxic"].to_numpy() == 1
        for base in BASES:
            for slope in SLOPES:
                hit = (g["whole"] >= base + slope * g["n"]) | (g["densest"] >= base + slope * g["stretch"])
                errors[pair, tau, base, slope] = int((hit.to_numpy() != label).sum())
    if not errors:
        return Model(*tried[0])
    least = min(errors.values())
    best = sorted(key for key, n in errors.items() if n == least)
    pair, *line = best[len(best) // 2]
    return Model(*tried[pair], *line)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, max_sample: int = MAX_SAMPLE) -> Model:
    rows = training_rows(docs, labels, id_col, text_col, label_col, max_train)
    toxic, ordinary = (_samples(rows, k, max_sample) for k in (1, 0))
    if not toxic or not ordinary:
        return Model()
    return _calibrate(rows, dictionaries(toxic, ordinary))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and n_windows of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            n, scores = [], []
            for text in batch.column("text"):
                saved = savings(text.as_py(), shared.value.toxic, shared.value.ordinary)
                n.append(len(saved))
                scores.append(score_of(saved, shared.value))
            columns = [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "n_windows"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, n_windows int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text isn't predicted toxic, all columns kept. The decision is made where the row is, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def run(batches):
        for batch in batches:
            model = shared.value
            keep = [score_of(savings(text.as_py(), model.toxic, model.ordinary), model) < 0.5 for text in batch.column(text_col)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_windows")
