"""Exact dedup with a cuckoo-filter index of live digests.

The work runs in two rounds of the same index:

1. each input task builds an index over its own rows, so a text that holds a third of all rows
   leaves a task as one row (a map-side combine); when the index is full, its digests that were met once are handed
   on and deleted from the filter, and those with copies stay live;
2. the combined rows are shuffled by digest; each task merges its digests in an index again.

A task's index is a table of buckets with four slots. A slot holds a 16-bit fingerprint and a
reference to a stored key (digest, byte length) with its count and largest row. A fingerprint hit counts
only after the stored key was compared. When an insertion finds no place, the table doubles and is filled again
from the stored keys. Digests whose last copy is deleted leave the filter.

Digests with copies are then verified against the content: their texts are dealt into buckets by digest, and a digest is good if the
least and the greatest text of its bucket are equal. Rows of a digest that stands for different texts are grouped by
the texts themselves.

Defined cases: a null text counts as the empty text. A null id sorts below every id. Rows that repeat
an id are rows of their own: of equal (text, id) rows exactly one is kept. A very long text is handled whole, by its digest. An
empty table gives an empty result. Extra columns of the input, whatever their names, are ignored here and survive in
``drop_exact_copies``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitengine.llm._shared import materialize, shuffle_partitions, table, unused

SLOTS, MAX_KICKS = 4, 200
#: Live digests that a map-side index gathers before it hands them on and starts afresh.
COMBINE_KEYS = 200_000
#: Digests per task of the merging round, which bounds its memory (about 100 bytes a digest).
MERGE_KEYS = 500_000
#: Digests with copies that may be broadcast (about 50 bytes each); with more of them texts meet them by a shuffle.
BROADCAST_KEYS = 200_000
NO_ID = np.iinfo(np.int64).min
ENTRY = "digest binary, n_bytes long, group_size long, keep_id long, keep_row long"


class CuckooIndex:
    """Live keys with a count and the largest (id, row) of each; batches of keys are numpy arrays.

    A key is a SHA-256 digest as four unsigned 64-bit words plus a byte length (shape (n, 5)).
    """

    def __init__(self, buckets: int = 1024):
        self.keys = np.zeros((256, 5), np.uint64)
        self.count = np.zeros(256, np.int64)
        self.best = np.zeros((256, 2), np.int64)
        self.used, self.free, self.resized = 0, [], 0
        self._table(buckets)

    def __len__(self) -> int:
        return self.used - len(self.free)

    def _table(self, buckets: int) -> None:
        self.mask = np.uint64(buckets - 1)
        self.prints = np.zeros((buckets, SLOTS), np.uint16)  # 0: empty
        self.refs = np.zeros((buckets, SLOTS), np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        one = keys[:, 0] & self.mask
        return prints, one, self._other(one, prints)

    def _other(self, place: np.ndarray, prints: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (place ^ (prints.astype(np.uint64) * np.uint64(0x5BD1E995))) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """References of the keys, -1 where a key is not live. Filter hits are verified in full."""
        prints, one, two = self._places(keys)
        found = np.full(len(keys), -1, np.int64)
        for place in (one, two):
            for slot in range(SLOTS):
                hit = np.flatnonzero((self.prints[place, slot] == prints) & (found < 0))
                refs = self.refs[place[hit], slot]
                same = (self.keys[refs] == keys[hit]).all(axis=1)
                found[hit[same]] = refs[same]
        return found

    def add(self, keys: np.ndarray, count: np.ndarray, best: np.ndarray) -> None:
        """Inserts keys with their counts and largest (id, row); equal keys of a batch are summed first."""
        if not len(keys):
            return
        order = np.lexsort((best[:, 1], best[:, 0], *keys.T))
        keys, count, best = keys[order], count[order], best[order]
        last = np.append((keys[1:] != keys[:-1]).any(axis=1), True)
        starts = np.append(0, np.flatnonzero(last)[:-1] + 1)
        keys, count, best = keys[last], np.add.reduceat(count, starts), best[last]
        refs = self.find(keys)
        known = refs >= 0
        old = self.best[refs[known]]
        new = best[known]
        larger = (new[:, 0] > old[:, 0]) | ((new[:, 0] == old[:, 0]) & (new[:, 1] > old[:, 1]))
        self.count[refs[known]] += count[known]
        self.best[refs[known][larger]] = new[larger]
        fresh = ~known
        refs = self._store(keys[fresh], count[fresh], best[fresh])
        if len(self) > 0.85 * self.prints.size:
            self._grow()
        else:
            self._place(refs)

    def remove(self, keys: np.ndarray, count: np.ndarray) -> None:
        """Takes counts away; a key whose count reaches zero leaves the filter. Keys are distinct."""
        refs = self.find(keys)
        known = refs >= 0
        refs = refs[known]
        self.count[refs] -= count[known]
        gone = refs[self.count[refs] <= 0]
        prints, one, two = self._places(self.keys[gone])
        for place in (one, two):
            for slot in range(SLOTS):
                at = np.flatnonzero((self.prints[place, slot] == prints) & (self.refs[place, slot] == gone))
                self.prints[place[at], slot] = 0
        self.free += gone.tolist()
        self.keys[gone] = 0

    def live(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        on = np.ones(self.used, bool)
        on[self.free] = False
        on = np.flatnonzero(on)
        return self.keys[on], self.count[on], self.best[on]

    def _store(self, keys: np.ndarray, count: np.ndarray, best: np.ndarray) -> np.ndarray:
        again = [self.free.pop() for _ in range(min(len(self.free), len(keys)))]
        refs = np.array(again + list(range(self.used, self.used + len(keys) - len(again))), np.int64)
        self.used += len(keys) - len(again)
        if self.used > len(self.count):
            more = max(self.used, 2 * len(self.count)) - len(self.count)
            self.keys = np.concatenate([self.keys, np.zeros((more, 5), np.uint64)])
            self.count = np.concatenate([self.count, np.zeros(more, np.int64)])
            self.best = np.concatenate([self.best, np.zeros((more, 2), np.int64)])
        self.keys[refs], self.count[refs], self.best[refs] = keys, count, best
        return refs

    def _grow(self) -> None:
        """Doubles the table, until it is at most half full, and places all stored keys anew."""
        self.resized += 1
        buckets = 2 * len(self.prints)
        while len(self) > 0.5 * SLOTS * buckets:
            buckets *= 2
        self._table(buckets)
        on = np.ones(self.used, bool)
        on[self.free] = False
        self._place(np.flatnonzero(on))

    def _place(self, refs: np.ndarray) -> None:
        prints, one, two = self._places(self.keys[refs])
        left = np.arange(len(refs))
        for place in (one, two):  # a round gives each bucket one key at most, so no two keys meet
            todo = left
            left = []
            while len(todo):
                free = self.prints[place[todo]] == 0
                full = ~free.any(axis=1)
                left.append(todo[full])
                todo, slot = todo[~full], free[~full].argmax(axis=1)
                _, first = np.unique(place[todo], return_index=True)
                now = todo[first]
                self.prints[place[now], slot[first]] = prints[now]
                self.refs[place[now], slot[first]] = refs[now]
                todo = np.delete(todo, first)
            left = np.concatenate(left) if left else np.zeros(0, np.int64)
        for k in left:
            if not self._kick(int(one[k]), prints[k], int(refs[k])):
                self._grow()  # every stored key, those still waiting among them, finds its place there
                return

    def _kick(self, place: int, mark: np.uint16, ref: int) -> bool:
        for n in range(MAX_KICKS):
            free = np.flatnonzero(self.prints[place] == 0)
            slot = int(free[0]) if len(free) else n % SLOTS
            mark, self.prints[place, slot] = self.prints[place, slot], mark
            ref, self.refs[place, slot] = int(self.refs[place, slot]), ref
            if len(free):
                return True
            place = int(self._other(np.array([place], np.uint64), np.array([mark], np.uint16))[0])
        return False


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    digests = batch.column("digest").cast(pa.binary(32)) if batch.num_rows else pa.array([], pa.binary(32))
    words = np.frombuffer(digests.buffers()[1] or b"", np.uint64)[4 * digests.offset :][: 4 * batch.num_rows]
    return np.column_stack([words.reshape(-1, 4), batch.column("n_bytes").to_numpy().astype(np.uint64)])


def _entries(index: CuckooIndex) -> pa.RecordBatch:
    return _batch(*index.live())


def _batch(keys: np.ndarray, count: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys[:, :4]).tobytes())])
    ids = pa.array(best[:, 0], mask=best[:, 0] == NO_ID)
    return pa.RecordBatch.from_arrays(
        [digests.cast(pa.binary()), pa.array(keys[:, 4].astype(np.int64)), pa.array(count), ids, pa.array(best[:, 1])],
        ["digest", "n_bytes", "group_size", "keep_id", "keep_row"],
    )


def _merge(limit: int | None):
    def run(batches):
        index = CuckooIndex()
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("keep_id").fill_null(NO_ID).to_numpy()
                best = np.column_stack([ids, batch.column("keep_row").to_numpy()])
                index.add(_keys(batch), batch.column("group_size").to_numpy(), best)
            if limit and len(index) > limit:
                keys, count, best = index.live()
                cold = count == 1
                if 2 * cold.sum() < len(count):
                    cold[:] = True
                yield _batch(keys[cold], count[cold], best[cold])
                index.remove(keys[cold], count[cold])
        yield _entries(index)

    return run


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: id, digest, byte length, and a row number that is unique in the result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        digest(text).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )


def build_index(rows: DataFrame) -> DataFrame:
    """Live digests of ``digests()`` rows, with the group's size, largest id and the row that stays."""
    spark = rows.sparkSession
    n = max(shuffle_partitions(spark), 1 + rows.count() // MERGE_KEYS)
    entries = rows.select("digest", "n_bytes", F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    combined = entries.mapInArrow(_merge(COMBINE_KEYS), ENTRY)
    return combined.repartition(n, "digest").mapInArrow(_merge(None), ENTRY)


def apply_changes(index: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """The live digests after a round of changes: digest, n_bytes, group_size.

    index: digest, n_bytes, group_size; added and deleted: ``digests()`` rows. Additions of a digest are
    applied before its deletions, and deletions of digests that are not live have no effect.
    """
    part = lambda d, n: d.select("digest", "n_bytes", n.cast("long").alias("change"))
    changes = part(index, F.col("group_size")).unionByName(part(added, F.lit(1))).unionByName(part(deleted, F.lit(-1)))
    summed = changes.groupBy("digest", "n_bytes", (F.col("change") < 0).alias("out")).agg(F.sum("change").alias("change"))

    def run(batches):
        live = CuckooIndex()
        for batch in batches:
            if batch.num_rows:
                keys, change = _keys(batch), batch.column("change").to_numpy()
                put = change > 0
                live.add(keys[put], change[put], np.zeros((int(put.sum()), 2), np.int64))
                live.remove(keys[~put], -change[~put])
        yield _entries(live).select(["digest", "n_bytes", "group_size"])

    dealt = summed.repartition("digest").sortWithinPartitions("out")
    return dealt.mapInArrow(run, "digest binary, n_bytes long, group_size long")


def _verdict(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, digest, n_bytes, keep_id, group_size, kept of every row."""
    rows = materialize(digests(docs, id_col, text_col, digest), "digests")
    groups = materialize(build_index(rows).where("group_size > 1"), "groups")
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    keys = groups.select("digest", "n_bytes")
    if groups.count() <= BROADCAST_KEYS:  # texts stay where they are until each task has the least and greatest of its own
        members = content.join(F.broadcast(keys), ["digest", "n_bytes"], "left_semi")
    else:  # texts of one digest are dealt over salts first
        members = content.join(keys, ["digest", "n_bytes"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        members = members.repartition(shuffle_partitions(docs.sparkSession), "digest", "salt").groupBy("digest", "n_bytes", "salt").agg(F.min("text").alias("text"), F.max("text").alias("most"))
        members = members.select("digest", "n_bytes", F.explode(F.array("text", "most")).alias("text"))
    buckets = members.groupBy("digest", "n_bytes").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
    mixed = materialize(buckets.where("least <> greatest").select("digest", "n_bytes"), "mixed_digests")
    joined = rows.join(groups, ["digest", "n_bytes"], "left")
    out = joined.select(
        "doc_id",
        "digest",
        "n_bytes",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
    )
    if mixed.limit(1).count() == 0:
        return out
    same = Window.partitionBy("digest", "text")
    apart = content.join(mixed, ["digest", "n_bytes"], "left_semi")
    first = F.row_number().over(same.orderBy(F.col("doc_id").desc_nulls_last()))
    apart = apart.select("doc_id", "digest", "n_bytes", F.max("doc_id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size"), (first == 1).alias("kept"))
    return out.join(mixed, ["digest", "n_bytes"], "left_anti").select(*apart.columns).unionByName(apart)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (the digest).

    Singletons need no partner, so only digests of two rows and more are joined back; Spark splits the
    rows of a hot digest there, as the index has one row for it.
    """
    return _verdict(docs, id_col, text_col, digest).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies, all columns kept. Rows equal in id and text leave one row."""
    verdict = exact_dedup(docs, id_col, text_col).where(~F.col("kept"))
    same_id = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    its_id, its_digest, whole = unused(docs, "its_id", "its_digest", "whole_text")
    gone = verdict.where(~same_id).select(F.col("doc_id").alias(its_id), F.unhex("text_sha256").alias(its_digest))
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.join(gone, F.col(id_col).eqNullSafe(F.col(its_id)) & (sha256(text) == F.col(its_digest)), "left_anti")
    if verdict.where(same_id).limit(1).count():  # an id repeats with its text
        left = left.withColumn(whole, text).dropDuplicates([id_col, whole]).drop(whole)
    return left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
