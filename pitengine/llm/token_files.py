"""Token ids in Arrow stream files with fixed-size-list batches.

A shard is one Arrow stream file. Its rows are sequences of ``seq_len`` ids
(``input_ids``: fixed-size list of uint16, or uint32 for vocabularies over 65,536) with a mask of the
same shape (``mask``: fixed-size list of bool, false only in the padding of a shard's last sequence).
Every batch but the last has ``batch_rows`` sequences and nulls occur nowhere, so a mapped file gives
any sequence as a slice of the file's own bytes. The documents of a shard follow one another across
sequences; a sidecar Arrow stream file (``.docs``) has doc_id, start and n_tokens within the shard.

Documents are range-partitioned by quantiles of their ids (a pass over the id column alone) and sorted
by id before they are encoded; each task writes its own shard, and the number of tokens of the shards before it (a running sum over one row per shard) turns a
start within the shard into a start in the whole stream. Files are written under a name that only the
attempt knows and the manifest names those of successful attempts, so lost executors leave at most
files that nothing refers to.

Defined cases: a null text counts as empty and holds only the end id. A null id sorts first. Rows that
repeat an id are written one after the other, ordered by text. An empty table gives a manifest without
rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitengine.llm._shared import materialize, new_path, shuffle_partitions, table

SEQ_LEN, BATCH_ROWS, END_ID = 2048, 64, 2
MANIFEST = "shard int, path string, n_docs long, n_tokens long"
#: A space that has white space before it and white space or the end behind it: no border of tokens.
LOOSE = re.compile(r" (?<=\s )(?:\s|$)")
#: Pieces whose ids a worker remembers.
CACHE_PIECES = 1_000_000
#: Pieces that go to the library as one text, and characters of a block of texts.
JOINED_PIECES, BLOCK_CHARS = 20_000, 2_000_000


class Encoder:
    """Ids of whole texts, by the tokenizers library.

    The library encodes each distinct piece of a text once per worker. Texts are cut before each space; the byte-level
    pattern has a border there unless the space lies inside a run of white space (``LOOSE``). Texts with such a space
    or with the string of an added token go to the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.lengths = np.array([len(names.get(i, "")) for i in range(1 + max(names))], np.int64)  # a byte is a character in byte-level vocabularies
        self.cache: dict[str, bytes] = {}  # of pieces with a space before them
        self.loose: set[str] = set()  # pieces that may touch a loose space

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Remembers the ids of pieces, each with a space before it. Those without white space at their ends are encoded
        as one text, for the borders between them stay, and cut again by the tokens' bytes."""
        joined = [" " + p for p in pieces if not loose_end(p)]
        single = [p for p in pieces if loose_end(p)]
        self.cache.update(zip(single, self._library([" " + p for p in single])))
        for at in range(0, len(joined), JOINED_PIECES):
            some = joined[at : at + JOINED_PIECES]
            ids = np.frombuffer(self._library(["".join(some)])[0], self.type)
            ends = np.cumsum([len(p.encode()) for p in some])
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            size, flat = self.type.itemsize, ids.tobytes()
            cuts = (cuts * size).tolist()
            self.cache.update(zip((p[1:] for p in some), (flat[a:b] for a, b in zip([0, *cuts], cuts))))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, in the bytes of an integer type that holds the vocabulary."""
        split = [[] if any(a in t for a in self.added) else t.split(" ") for t in texts]
        heads = [pieces.pop(0) if pieces else None for pieces in split]
        own, distinct = self.cache, set().union(*split)
        new = list(distinct.difference(own))
        self.loose.update(filter(loose_end, new))
        if not self.loose.isdisjoint(distinct):
            for k, t in enumerate(texts):
                if heads[k] is not None and LOOSE.search(t):
                    heads[k], split[k] = None, []
        self._learn(new)
        first = self._library([t if h is None else h for t, h in zip(texts, heads)])
        out = [h + b"".join(map(own.__getitem__, pieces)) for h, pieces in zip(first, split)]
        for x in new[max(0, CACHE_PIECES - len(own) + len(new)) :]:  # the first pieces stay: frequent ones are met early
            del own[x]
            self.loose.discard(x)
        return out


def loose_end(piece: str) -> bool:
    return not piece or piece[0].isspace() or piece[-1].isspace()


def bounded_ids(ids: DataFrame, n: int) -> list[int]:
    """At most n - 1 ascending ids that cut the rows into n ranges of about the same number."""
    cuts = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("cuts")).first().cuts if n > 1 else None
    return sorted(set(cuts or ()))


def range_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts lie below the id (0 for null), by one search among every m-th cut and one among the m cuts there."""
    m = math.isqrt(len(cuts)) + 1
    below = lambda some: F.size(F.filter(some, lambda c: c < doc_id))
    array = lambda some: F.lit(some) if some else F.array().cast("array<bigint>")
    coarse = below(array(cuts[m - 1 :: m])) * m
    return coarse + below(F.slice(array(cuts), coarse + 1, m))


def blocks(sizes: np.ndarray):
    """Bounds of runs of rows with about BLOCK_CHARS characters, at least a row each."""
    start, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and total + n > BLOCK_CHARS:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def _open(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url) if "://" in url else pafs.FileSystem.from_uri("file://" + url) if url.startswith("/") else pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", url))


class ShardWriter:
    """Packs ids into sequences and writes a shard's two files."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, seq_len: int, batch_rows: int):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.dtype, self.seq_len, self.batch_rows = f"{folder}/{name}.arrows", dtype, seq_len, batch_rows
        ids = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([pa.field("input_ids", pa.list_(pa.field("item", ids, False), seq_len), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), seq_len), False)])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = [self.fs.open_output_stream(f"{base}/{name}.{kind}") for kind in ("arrows", "docs")]
        self.files = [pa.ipc.new_stream(o, s) for o, s in zip(self.out, (self.schema, self.index))]
        self.waiting, self.n_waiting, self.n_docs, self.n_tokens, self.docs = [], 0, 0, 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id, self.n_tokens, n))
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + n
        self.waiting.append(ids)
        self.n_waiting += n
        if self.n_waiting >= self.seq_len * self.batch_rows:
            self._flush(False)
        if len(self.docs) >= 10_000:
            self._flush_docs()

    def _flush(self, last: bool) -> None:
        flat, full = np.frombuffer(b"".join(self.waiting), self.dtype), self.seq_len * self.batch_rows
        at = 0
        while len(flat) - at >= full or last and at < len(flat):
            part = flat[at : at + full]
            rows = -(-len(part) // self.seq_len)
            ids, mask = np.zeros(rows * self.seq_len, self.dtype), np.zeros(rows * self.seq_len, bool)
            ids[: len(part)], mask[: len(part)] = part, True
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((ids, mask), self.schema)]
            self.files[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
            at += full
        rest = flat[at:] if at < len(flat) else flat[:0]
        self.waiting, self.n_waiting = [rest.tobytes()], len(rest)

    def _flush_docs(self) -> None:
        if self.docs:
            self.files[1].write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.docs)], schema=self.index))
            self.docs = []

    def close(self) -> None:
        self._flush(True)
        self._flush_docs()
        for f in (*self.files, *self.out):
            f.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, seq_len: int = SEQ_LEN, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Encodes every text and writes the shards below folder (any URI that pyarrow opens on every executor).

    Returns the manifest, which is a written table itself: shard (in ascending order of ids), path, n_docs,
    n_tokens, and start, the number of tokens of all shards before.
    """

    def run(batches):
        from pyspark import TaskContext

        shard, writer, encode = TaskContext.get().partitionId(), None, encoder(tokenizer_path)
        end = b"" if end_id is None else np.array([end_id], encode.type).tobytes()
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            for a, b in blocks(sizes):
                part = batch.slice(a, b - a)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode.encode_batch(part.column("text").to_pylist())):
                    if writer is None:
                        writer = ShardWriter(folder, f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}", encode.type, seq_len, batch_rows)
                    writer.add(doc_id, ids + end)
        if writer:
            writer.close()
            row = [[shard], [writer.path], [writer.n_docs], [writer.n_tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "path", "n_docs", "n_tokens"])

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = shuffle_partitions(spark)
    cuts = bounded_ids(rows.select("doc_id"), n)
    dealt = rows.repartitionById(n, range_of(F.col("doc_id"), cuts)).sortWithinPartitions("doc_id", "text")
    manifest = materialize(dealt.mapInArrow(run, MANIFEST), "token_manifest")
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0).cast("long")))  # one row per shard


class Shard:
    """A shard opened for reading; local files are mapped, so ids and masks are views of the file."""

    def __init__(self, path: str):
        fs, at = _open(path)
        kind = pa.memory_map if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        self.batches = list(pa.ipc.open_stream(kind(at)))
        self.documents = pa.ipc.open_stream(kind(at.removesuffix(".arrows") + ".docs"))
        self.batch_rows = self.batches[0].num_rows if self.batches else 1
        self.seq_len = self.batches[0].schema.field("input_ids").type.list_size if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and mask of the k-th sequence."""
        batch, row = self.batches[k // self.batch_rows], k % self.batch_rows
        part = slice(row * self.seq_len, (row + 1) * self.seq_len)
        return self._ids(batch)[part], batch.column("mask").values[part].to_numpy(zero_copy_only=False)

    def _ids(self, batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("input_ids").values.to_numpy()  # raises if it had to copy

    def span(self, start: int, n: int) -> list[np.ndarray]:
        """Views of the ids from start on, one per batch that they lie in."""
        size, out = self.batch_rows * self.seq_len, []
        while n:
            part = self._ids(self.batches[start // size])[start % size :][:n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out


def read_documents(manifest: DataFrame, digest_only: bool = False) -> DataFrame:
    """One row per document of the shards: doc_id, start in the whole stream, n_tokens, ids_crc32, and input_ids unless digest_only."""

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(path)
                for part in shard.documents:
                    starts, sizes = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    step = 10_000 if digest_only else 500
                    for at in range(0, part.num_rows, step):
                        crc, lists = [], []
                        for s, n in zip(starts[at : at + step].tolist(), sizes[at : at + step].tolist()):
                            check, views = 0, shard.span(s, n)
                            for v in views:
                                check = zlib.crc32(v.astype("<u4").tobytes(), check)
                            crc.append(check)
                            if not digest_only:
                                lists.append(np.concatenate([np.zeros(0, np.int32), *views]).astype(np.int32))
                        some = part.slice(at, step)
                        columns = [some.column("doc_id"), pa.array(starts[at : at + step] + base), some.column("n_tokens"), pa.array(crc, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        yield pa.RecordBatch.from_arrays(columns + ([] if digest_only else [pa.array(lists, pa.list_(pa.int32()))]), names + ([] if digest_only else ["input_ids"]))

    spread = manifest.select("path", "start").repartition(shuffle_partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", input_ids array<int>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    manifest = write_tokens(docs, new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(manifest, digest_only=True)
