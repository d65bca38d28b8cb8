"""Language ID with a bit-sliced Bloom filter over character 4-grams.

The filter is a table of positions; each position holds a bit per language. A 4-gram that occurs in a training text of a
language sets the language's bit at ``HASHES`` positions. The AND of the masks at a 4-gram's positions is the set of
all languages that contain it, found in one look-up whatever the number of languages. A text's 4-grams are looked up in
bulk; the hits of each language (a popcount of its bit) are corrected for the false positives that its fill makes, and the
language with most hits wins.

Every 4-gram of the training texts is in the filter. These are at most about ``MAX_TRAIN`` texts a language outside fold 0, picked by
a digest of their id. The filter is sized from the 4-grams of the language that has most, so that its fill stays under
``FILL``; tasks build it in parts, and the driver merges and broadcasts as many integers as it has positions, which the
training sample bounds.

Only letters count: all else parts words, case is folded, and each letter is the third of exactly one 4-gram.
Defined cases: null texts and texts without a letter are ``und`` with score 0. A text whose 4-grams are all
unknown gets the language with the most training texts and score 0. Equal hits go to the language first in code-point order.
Rows without a language are never learned from, rows with a null id neither. Without training rows all is ``und``.
A very long text is read whole, in a block of its own. Repeated rows are predicted each; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitengine.llm._shared import fold, materialize, table

GRAM, HASHES, FILL = 4, 3, 0.3
LEAST_BITS = 16
MAX_TRAIN = 3000
NONE = "und"
#: Code points of a block of texts that are looked up together.
BLOCK = 1_000_000


@dataclass
class Filter:
    languages: list[str]
    fallback: int
    masks: np.ndarray  # (languages / 64, positions), unsigned 64-bit
    false_rate: np.ndarray  # of each language


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codes(text: str) -> np.ndarray:
    """Lower-case code points between two spaces and one; what is no letter is a space."""
    points = np.frombuffer(("  " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[points], points, 32)


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of code points, given by columns."""
    h = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def letters_at(points: np.ndarray) -> np.ndarray:
    return np.flatnonzero(points != 32)


def gram_hashes(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 4-gram around each letter (two code points before it and one behind) of texts as of ``codes``."""
    return hashed([points[at + k] for k in range(-2, GRAM - 2)])


def positions(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of hashed 4-grams in a filter of size positions, a power of two."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [(h + np.uint64(k) * step) & np.uint64(size - 1) for k in range(HASHES)]


def size_for(grams: int) -> int:
    """The least power of two that ``grams`` 4-grams fill to FILL at most."""
    return 1 << max(LEAST_BITS, math.ceil(math.log2(max(grams, 1) * HASHES / FILL)))


def sliced(languages: list[str], fallback: str, masks: np.ndarray) -> Filter:
    fill = [np.count_nonzero(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / masks.shape[1] for k in range(len(languages))]
    return Filter(languages, languages.index(fallback), masks, np.array(fill) ** HASHES)


def build(grams: dict[str, list[str]], fallback: str) -> Filter:
    """The filter of given 4-grams of each language, on one machine."""
    languages = sorted(grams)
    size = size_for(max(map(len, grams.values())))
    masks = np.zeros((-(-len(languages) // 64), size), np.uint64)
    for k, language in enumerate(languages):
        points = np.array([[*map(ord, g)] for g in grams[language]], np.uint32).reshape(-1, GRAM)
        masks[k // 64, np.concatenate(positions(hashed(list(points.T)), size))] |= np.uint64(1 << k % 64)
    return sliced(languages, fallback, masks)


def hits(texts: list[str], model: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Number of 4-grams of each text, and how many of them each language holds."""
    each = [codes(t) for t in texts]
    flat = np.concatenate(each)
    at = letters_at(flat)
    owner = np.repeat(np.arange(len(each)), [len(x) for x in each])[at]
    places = positions(gram_hashes(flat, at), model.masks.shape[1])
    n = np.bincount(owner, minlength=len(texts))
    found = np.zeros((len(texts), len(model.languages)))
    for word, masks in enumerate(model.masks):
        held = masks[places[0]] & masks[places[1]] & masks[places[2]]
        for bit in range(min(64, len(model.languages) - 64 * word)):
            found[:, 64 * word + bit] = np.bincount(owner[(held >> np.uint64(bit)) & np.uint64(1) == 1], minlength=len(texts))
    return n, found


def predict(texts: list[str | None], model: Filter | None) -> tuple[list[str], list[float]]:
    languages, scores = [NONE] * len(texts), [0.0] * len(texts)
    some = [k for k, t in enumerate(texts) if has_letter(t)] if model else []
    start = 0
    while start < len(some):
        end, size = start, 0
        while end < len(some) and (end == start or size + len(texts[some[end]]) <= BLOCK):
            size += len(texts[some[end]])
            end += 1
        n, found = hits([texts[k] for k in some[start:end]], model)
        right = np.maximum(found - n[:, None] * model.false_rate, 0) / (1 - model.false_rate)
        best, total = right.argmax(axis=1), right.sum(axis=1)
        for k, b, r, t in zip(some[start:end], best.tolist(), right.max(axis=1).tolist(), total.tolist()):
            languages[k], scores[k] = (model.languages[b], r / t) if t else (model.languages[model.fallback], 0.0)
        start = end
    return languages, scores


def _grams(batches):
    """The distinct 4-grams (hashed) of each language in a batch."""
    for batch in batches:
        own: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            points = codes(text.as_py())
            own.setdefault(lang, []).append(np.unique(gram_hashes(points, letters_at(points))))
        for lang, found in own.items():
            h = np.unique(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64))], ["lang", "gram"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Filter | None:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where((fold("_id") != 0) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r.lang: r.n for r in counted.collect()}  # one row per language
    if not sizes:
        return None
    languages = sorted(sizes)
    spark = docs.sparkSession
    limits = spark.createDataFrame([(lang, int(min(1.0, max_train / sizes[lang]) * (1 << 32)), k // 64, int(np.uint64(1 << k % 64).astype(np.int64))) for k, lang in enumerate(languages)], "lang string, most long, word int, mask long")
    part = F.conv(F.substring(F.md5(F.col("_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    chosen = rows.withColumn("part", part).join(limits.select("lang", "most"), "lang").where("part < most").select("lang", "text")
    grams = materialize(chosen.mapInArrow(_grams, "lang string, gram long").distinct(), "language_grams")
    size = size_for(grams.groupBy("lang").count().agg(F.max("count")).first()[0] or 1)

    def places(batches):
        for batch in batches:
            at = np.concatenate(positions(batch.column("gram").to_numpy().view(np.uint64), size)).astype(np.int64)
            again = lambda c: pa.chunked_array([batch.column(c)] * HASHES).combine_chunks()
            yield pa.RecordBatch.from_arrays([again("word"), again("mask"), pa.array(at)], ["word", "mask", "place"])

    marked = grams.join(limits.select("lang", "word", "mask"), "lang").select("word", "mask", "gram")
    merged = marked.mapInArrow(places, "word int, mask long, place long").groupBy("word", "place").agg(F.bit_or("mask").alias("mask")).toPandas()  # at most size rows for 64 languages
    masks = np.zeros((-(-len(languages) // 64), size), np.uint64)
    masks[merged["word"].to_numpy(), merged["place"].to_numpy()] = merged["mask"].to_numpy(np.int64).view(np.uint64)
    return sliced(languages, min(sizes, key=lambda x: (-sizes[x], x)), masks)


def identify(docs: DataFrame, model: Filter | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            languages, scores = predict(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
