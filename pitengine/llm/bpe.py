"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up all neighbouring pairs at once, by
binary search over the sorted pair keys of the merge table, takes each word's pair of lowest rank, and
merges all its places in that word (of overlapping ones every second, from the left). Words without a
pair in the table are done and leave the array. As a merge only makes symbols whose own merges rank
later, a round per rank gives what merging one place at a time gives.

A task merges each distinct piece of text (between ASCII white space) once while it is remembered, so a
worker's memory is bounded by ``CACHE_PIECES``; documents are handled and handed on in blocks of about
``BLOCK_CHARS`` characters, each document whole.

The tokenizer file names the vocabulary, merges, word-end suffix, pattern and normalizers; a file whose
parts are of other kinds is refused. Defined cases: a null text counts as empty and has no ids; strings
of the added tokens become these tokens' ids, as in the tokenizers library; rows are independent, so
repeated rows and ids, null ids and empty tables need no special care; extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitengine.llm._shared import table

CACHE_PIECES = 300_000
BLOCK_CHARS = 2_000_000
#: White space as Unicode defines it, for a pattern's \s.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = regex.compile(r"[^\x20\x09-\x0D]+")
NO_RANK = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]] + [s["type"] for s in steps]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or model["type"] != "BPE" or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path}: not a lower-case word BPE file")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for t, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = t
        self.split = regex.compile(steps[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}"))
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_symbols()], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a, b, made = (np.array(x, np.int64) for x in zip(*((vocab[x], vocab[y], vocab[x + y]) for x, y in merges)))
        keys = a * len(self.tokens) + b
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.bytes = {c: b for b, c in enumerate(byte_symbols())}
        self.library = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (not empty), one word after the other, and the number of ids of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        flat, ends = self.first[raw], np.cumsum(sizes) - 1
        flat[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_word = [], []
        while len(flat):
            pair = flat[:-1] * len(self.tokens) + flat[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, self.ranks[at], NO_RANK), NO_RANK)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            mine = np.repeat(lowest, np.diff(np.append(starts, len(flat))))
            chosen = np.flatnonzero((rank == mine) & (rank < NO_RANK))
            run = np.flatnonzero(np.append(True, np.diff(chosen) != 1)) if len(chosen) else chosen
            place = np.arange(len(chosen)) - np.repeat(run, np.diff(np.append(run, len(chosen))))
            chosen = chosen[place % 2 == 0]
            flat[chosen] = self.made[at[chosen]]
            keep = mine < NO_RANK
            done_ids.append(flat[~keep])
            done_word.append(word[~keep])
            keep[chosen + 1] = False
            flat, word = flat[keep], word[keep]
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _words(self, piece: str) -> list[bytes]:
        """The words of a piece in UTF-8. Characters that this Python's Unicode tables don't know are left to the library's."""
        if not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece):
            words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
            return [bytes(self.bytes[c] for c in w) for w, _ in words]
        piece = unicodedata.normalize("NFC", piece)
        piece = "".join(map(str.lower, piece)) if "Σ" in piece else piece.lower()  # letter by letter: no final sigma
        return [w.encode() for w in self.split.findall(piece)]

    def _learn(self, pieces: list[str]) -> None:
        """Remembers the ids of pieces."""
        split = [self._words(p) for p in pieces]
        words = [w for ws in split for w in ws]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        ids, sizes = self.merge(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(n_words)] * 4
        flat = ids.astype("<i4").tobytes()
        self.cache.update(zip(pieces, (flat[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()))))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.special.split(t) if self.special and self.special.search(t) else [t] for t in texts]
        pieces = [[PIECE.findall(part) if k % 2 == 0 else [] for k, part in enumerate(parts)] for parts in split]
        new = set().union(*(p for ps in pieces for p in ps)).difference(self.cache)
        if len(new) + len(self.cache) > CACHE_PIECES:
            self.cache.clear()
            new = set().union(*(p for ps in pieces for p in ps))
        if new:
            self._learn(list(new))
        own, out = self.cache, []
        for parts, ps in zip(split, pieces):
            out.append(b"".join([b"".join([own[p] for p in x]) if k % 2 == 0 else np.array([self.added[part]], "<i4").tobytes() for k, (part, x) in enumerate(zip(parts, ps))]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings joined by spaces, as a tokenizer file without a decoder asks for."""
        return " ".join([self.tokens[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _blocks(sizes: np.ndarray):
    """Bounds of runs of rows with about BLOCK_CHARS characters, at least a row each."""
    start, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and total + n > BLOCK_CHARS:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, ids (array of int) and decoded (the text that the ids decode to) of every row."""

    def run(batches):
        bpe = load(tokenizer_path)
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for a, b in _blocks(sizes):
                ids = bpe.encode_batch(texts.slice(a, b - a).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                decoded = pa.array([bpe.decode(np.frombuffer(x, "<i4")) for x in ids], pa.string())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                own = [batch.column(c).slice(a, b - a) for c in ("doc_id", *keep)]
                yield pa.RecordBatch.from_arrays([*own, lists, decoded], ["doc_id", *keep, "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kept = "".join(f"{rows.schema[c].name} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, f"doc_id long, {kept}ids array<int>, decoded string")


def decode(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; null ids decode to the empty text."""

    def run(batches):
        bpe = load(tokenizer_path)
        for batch in batches:
            texts = [bpe.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encode_decode`` rows."""
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
