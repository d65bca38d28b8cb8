"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most four bits differ in at most
one bit in the first or the second segment, or not at all in the third (two bits or more in each of the first two
leave none for the third). So every fingerprint is stored under each of its segment values, and probes the tables of
the first two segments with the ball of radius 1 around its own value (22 probes each) and the third with its value
alone. Fingerprints that meet in a table are compared in full. The tables hold distinct fingerprints: copies meet
once, as one entry.

From ``WIDE_FROM`` distinct fingerprints on, a value of 21 bits is shared by so many that candidates outgrow probes;
there two segments of 32 bits do the same (at most two bits differ in the first, or at most one in the second: 529 and
33 probes). Both plans find every link.

Stored and probing entries of a table value are shuffled to one task and compared in numpy blocks. A task hands on a
spanning forest of the links it verified, so a dense group of n fingerprints leaves as n links and not n * n pairs,
and no link between groups is lost. A table value that more than ``HOT`` fingerprints share is dealt over a grid of
tasks: stored entries over its rows and probes over its columns, so that no task compares more than about ``HOT`` with
``HOT``. Components are found by alternating star contraction over the links, with a written table after each round.

A node is the fingerprint itself; the smallest id names a component once it is found.

``drop_near_copies`` links texts by the Jaccard similarity of their sets of 5-word shingles instead, from
``LEAST_SHARED`` up. There two fingerprints may differ in a sixth of their bits, beyond any ball that can be
enumerated whole, so its fingerprints are ``WORDS`` * 64 bits of the set, in ``WORDS`` * 4 segments, and a segment's
ball is enumerated over its two least certain bits (four probes). Candidates are verified on the shingle sets, in two
rounds, so that no pair is left out and no task hands on all pairs of a dense group:

- Tasks hand on a spanning forest of the candidates that they find, nearest pairs first (in steps of ``NEAR_STEP`` bits); where a table value's
  candidates outnumber its nodes by more than ``FEW``, later ones are held against its forest so far.
- Of the forests, each text's ``NEAREST`` nearest partners are verified first. Verified links give components.
- Texts with candidates then meet again under all their table values, on all bits of the fingerprints, and only those of different
  components are compared; a pair counts in the first segment that it meets in. What is left is verified pair by pair; where it is dense (many texts
  a little too far apart), in one task per value on the shingle sets themselves.

Defined cases: null and white-space texts have fingerprint zero and link like any other. A very long text is hashed
whole, block by block. A component without an id has no name. Rows that repeat an id are members of their own, and are
dropped by id and text. An empty table gives an empty result. Extra columns, whatever their names, are ignored by
``simhash_components`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitengine.llm._shared import materialize, shuffle_partitions, table, unused

SEED, MAX_DISTANCE = 42, 4
#: First bit and width of the segments, and the radius of the ball that is enumerated in each.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
WIDE_SEGMENTS, WIDE_FROM = ((0, 32, 2), (32, 32, 1)), 1 << 25
#: Of drop_near_copies: words of a fingerprint, most bits that candidates differ in (in the first word, in all), candidates for each node
#: of a table value that are handed on as they are.
WORDS, FIRST_DISTANCE, WIDE_DISTANCE, FEW = 6, 18, 90, 4
#: Distances in one step count as equally near where forests are chosen.
NEAR_STEP = 6
#: Candidates of a text that are verified before the others, the nearest.
NEAREST = 4
#: Least Jaccard similarity of shingle sets, as a fraction.
LEAST_SHARED = (4, 5)
#: Stored fingerprints under one table value that a task compares at a time.
HOT = 2048
#: Hot table values that may be broadcast (16 bytes each); with more of them the salts come by a shuffled join.
HOT_BROADCAST = 50_000
#: Table values to compare again that may be broadcast (16 bytes each).
MIXED_BROADCAST = 1_000_000
#: Rows, and comparisons, of a numpy block.
BLOCK_ROWS, BLOCK_PAIRS = 50_000, 500_000


def fingerprint(text: str | None, shingle: int = 4, seed: int = SEED, block: int = 1 << 16) -> int:
    """The SimHash of the word shingles, as an unsigned integer. Long texts are counted block by block."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(joined, seed)  # the only hash has each of its bits in over half of all
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.append(0, ends[:-1] + 1)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), block):
        hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[at : at + block], ends[at : at + block])), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, row (a hash of the text) and fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            marks = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(marks.view(np.int64))], ["doc_id", "row", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("row", F.xxhash64("text")).mapInArrow(run, "doc_id long, row long, fp long")


def ball(width: int, radius: int) -> list[int]:
    """All values of width bits with radius ones at most."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _entries(classes: DataFrame, segments: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Stored (probe false) and probing entries: segment, value, probe, fp, node."""
    out = None
    for k, (low, width, radius) in enumerate(segments):
        own = F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1)
        stored = classes.select(F.lit(k).alias("segment"), own.alias("value"), F.lit(False).alias("probe"), "fp", "node")
        flips = classes.withColumn("flip", F.explode(F.lit(ball(width, radius)).cast("array<bigint>")))
        probes = flips.select(F.lit(k).alias("segment"), own.bitwiseXOR(F.col("flip")).alias("value"), F.lit(True).alias("probe"), "fp", "node")
        out = stored.union(probes) if out is None else out.union(stored).union(probes)
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the links (a, b): its members and their smallest."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _once(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes, and each pair once, as places in nodes, by steps of distance, then by the smaller nodes: forests of the
    same group from different tasks then share most of their pairs."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    low, high = np.minimum(both[: len(a)], both[len(a) :]), np.maximum(both[: len(a)], both[len(a) :])
    _, once = np.unique(low * len(nodes) + high, return_index=True)
    once = once[np.argsort(d[once] // NEAR_STEP, kind="stable")]
    return nodes, low[once], high[once], d[once]


def _nearest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning forest of the pairs (a, b) at distances d."""
    nodes, low, high, d = _once(a, b, d)
    chosen = np.zeros(len(low), bool)
    label, rest = np.arange(len(nodes)), np.arange(len(low))
    while True:
        rest = rest[label[low[rest]] != label[high[rest]]]
        if not len(rest):
            break
        best = np.full(len(nodes), len(low))
        np.minimum.at(best, label[low[rest]], rest)
        np.minimum.at(best, label[high[rest]], rest)
        pick = np.unique(best[best < len(low)])
        chosen[pick] = True
        members, ends = _forest(label[low[pick]], label[high[pick]])
        to = np.arange(len(nodes))
        to[members] = ends
        label = to[label]
    return nodes[low[chosen]], nodes[high[chosen]], d[chosen]


class _Compare:
    """Compares the probes of a sorted task with the stored entries of the same table value."""

    radius, columns = MAX_DISTANCE, ("a", "b")

    def few(self, a, b, d, key):
        """What is handed on of the links (a, b) at distances d under table values key."""
        return (*_forest(a, b), d[:0], key[:0])

    def fresh(self, first, last, a, b):
        """Which of the links (a, b) under table values first to last are looked at."""
        return slice(None)

    def __init__(self):
        self.key, self.fp, self.node = None, np.zeros(0, np.int64), np.zeros(0, np.int64)  # stored under the last value seen

    def block(self, key, probe, fp, node):
        """key: one integer per (segment, value, salt). Stored entries come before the probes of their key."""
        stored = ~probe
        keys, fps, nodes = key[stored], fp[stored], node[stored]
        if len(key) and self.key == key[0]:
            keys = np.concatenate([np.full(len(self.fp), self.key), keys])
            fps, nodes = np.concatenate([self.fp, fps]), np.concatenate([self.node, nodes])
        first, last = np.searchsorted(keys, key[probe]), np.searchsorted(keys, key[probe], side="right")
        own_key, own_fp, own_node, n = key[probe], fp[probe], node[probe], last - first
        total = np.cumsum(n)
        at, found = 0, []
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK_PAIRS, side="right")))
            mine = np.repeat(np.arange(at, to), n[at:to])
            skip = np.repeat(total[at:to] - n[at:to] - (total[at - 1] if at else 0), n[at:to])
            theirs = np.arange(len(mine)) - skip + first[mine]
            distance = np.bitwise_count((own_fp[mine] ^ fps[theirs]).view(np.uint64))
            near = distance <= self.radius
            near &= own_node[mine] != nodes[theirs]
            near = np.flatnonzero(near)
            near = near[self.fresh(own_key[at], own_key[to - 1], own_node[mine[near]], nodes[theirs[near]])]
            if len(near):
                found.append(self.few(own_node[mine[near]], nodes[theirs[near]], distance[near], own_key[mine[near]]))
            at = to
        if len(key):
            mask = keys == key[-1]
            self.key, self.fp, self.node = key[-1], fps[mask], nodes[mask]
        if not found:
            return None
        a, b, d, of = self.few(*(np.concatenate(x) for x in zip(*found)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, of, d)[: len(self.columns)]], list(self.columns))


class _Candidates(_Compare):
    """Hands on the pairs of a table value with key -1, or their forest with the table value if they are many."""

    radius, columns = FIRST_DISTANCE, ("a", "b", "key", "d")

    def __init__(self, most: int = FEW):
        super().__init__()
        self.most = most
        self.joined = (None, np.zeros(0, np.int64), np.zeros(0, np.int64))  # the last crowded value, its nodes and their roots

    def fresh(self, first, last, a, b):
        """Pairs that the forest of the value's blocks so far doesn't join already."""
        value, nodes, roots = self.joined
        if first != value or last != value:
            return slice(None)
        at = [np.minimum(np.searchsorted(nodes, x), len(nodes) - 1) for x in (a, b)]
        known = (nodes[at[0]] == a) & (nodes[at[1]] == b)
        return ~known | (roots[at[0]] != roots[at[1]])

    def few(self, a, b, d, key):
        order = np.argsort(key, kind="stable")
        values, first, n = np.unique(key[order], return_index=True, return_counts=True)
        kept, out = np.ones(len(key), bool), []
        # table values that are crowded so far are written below -1; more than m pairs a node need 2 * m + 2 nodes
        for k in np.flatnonzero((values < -1) | (values >= 0) & (n > self.most * (2 * self.most + 2))).tolist():
            own = order[first[k] : first[k] + n[k]]
            if values[k] >= 0:
                nodes, low, _, _ = _once(a[own], b[own], d[own])
                if len(low) <= self.most * len(nodes):
                    continue
            kept[own] = False
            forest = _nearest(a[own], b[own], d[own])
            out.append((*forest, np.full(len(forest[0]), values[k] if values[k] < 0 else -2 - values[k])))
            if values[k] >= 0:
                self._join(values[k], *forest[:2])
        if kept.any():
            nodes, low, high, d = _once(a[kept], b[kept], d[kept])
            out.append((nodes[low], nodes[high], d, np.full(len(low), -1)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _join(self, value, a, b):
        old = self.joined
        if old[0] == value:
            a, b = np.concatenate([a, old[1]]), np.concatenate([b, old[2]])
        members, roots = _forest(a, b)
        nodes = np.concatenate([members, np.unique(roots)])
        order = np.argsort(nodes)
        self.joined = (value, nodes[order], np.concatenate([roots, np.unique(roots)])[order])

    def block(self, *columns):
        found = super().block(*columns)
        if found is None:
            return None
        key = found.column("key").to_numpy()
        return pa.RecordBatch.from_arrays([found.column("a"), found.column("b"), pa.array(np.where(key < -1, -2 - key, -1)), found.column("d")], list(self.columns))


def _links(batches, compare=None):
    compare = compare or _Compare()
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            col = lambda c, p=part: p.column(c).to_numpy(zero_copy_only=False)
            if (out := compare.block(col("key"), col("probe"), col("fp"), col("node"))) is not None:
                yield out


def _forests(batches, most: int):
    """A forest (a, b, d) of each block's candidates, nearest pairs first: whoever has a candidate is in it, with a nearest one."""
    for found in _links(batches, _Candidates(most)):
        a, b, d = _nearest(*(found.column(c).to_numpy() for c in ("a", "b", "d")))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d.astype(np.int32))], ["a", "b", "d"])


def links(classes: DataFrame, segments: Sequence[tuple[int, int, int]] | None = None) -> DataFrame:
    """Links (a, b) between nodes of distinct fingerprints (fp, node) that join all that are near."""
    segments = segments or (SEGMENTS if classes.count() < WIDE_FROM else WIDE_SEGMENTS)
    entries = _entries(classes, segments)
    return _dealt(entries, _grids(entries)).mapInArrow(_links, "a long, b long")


def _grids(entries: DataFrame) -> DataFrame | None:
    """Rows and columns of the grid of each hot table value, as a written table; None if no value is hot."""
    hot = materialize(entries.where(~F.col("probe")).groupBy("segment", "value").agg(F.count("*").alias("stored")).where(F.col("stored") > HOT), "hot_segments")
    n_hot = hot.count()
    if not n_hot:
        return None
    probes = entries.where("probe").join(F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot, ["segment", "value"]).groupBy("segment", "value").agg(F.max("stored").alias("stored"), F.count("*").alias("probes"))
    parts = lambda c: F.ceil(F.col(c) / HOT).cast("int")
    return materialize(probes.select("segment", "value", parts("stored").alias("rows"), parts("probes").alias("columns")), "hot_segments")


def _keyed(entries: DataFrame, grids: DataFrame | None) -> DataFrame:
    """Entries (segment, value, stored, probe, fp and others) with their table value (key): a hot value's stored entries in rows and its probes in
    columns of a grid. One that is both is stored in the cells of its row and probes in those of its column."""
    if grids is not None:
        entries = entries.join(F.broadcast(grids) if grids.count() <= HOT_BROADCAST else grids, ["segment", "value"], "left")
        digest = F.xxhash64("fp")
        row, column = F.pmod(digest, F.col("rows")).cast("int"), F.pmod(digest, F.col("columns")).cast("int")
        along = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: row * F.col("columns") + c)
        down = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: r * F.col("columns") + column)
        cells = F.when(F.col("rows").isNull(), F.array(F.lit(0))).when(~F.col("probe"), along).when(~F.col("stored"), down).otherwise(F.array_union(along, down))
        entries = entries.withColumn("cell", F.explode(cells))
        whole = F.col("rows").isNull()
        stored, probe = whole | (F.floor(F.col("cell") / F.col("columns")) == row), whole | (F.col("cell") % F.col("columns") == column)
        entries = entries.withColumns({"stored": F.col("stored") & stored, "probe": F.col("probe") & probe})
    else:
        entries = entries.withColumn("cell", F.lit(0))
    # a value takes 32 bits, the segment two, the cell the rest
    key = F.shiftleft(F.col("cell").cast("long"), 34) + F.shiftleft(F.col("segment").cast("long"), 32) + F.col("value")
    return entries.withColumn("key", key)


def _dealt(entries: DataFrame, grids: DataFrame | None) -> DataFrame:
    """Entries by table value (key), a task's in order."""
    dealt = _keyed(entries.withColumn("stored", ~F.col("probe")), grids).select("key", "probe", "fp", "node").repartition(shuffle_partitions(entries.sparkSession), "key")
    return dealt.sortWithinPartitions("key", "probe")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node with an edge, by alternating stars.

    A round points the larger neighbours of each node to its smallest one (large star), then the smaller
    ones too (small star); it ends when the edges stay as they were, each node then naming its root.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large_star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        before, edges = edges, materialize(small.select("e.*").where("a != b").distinct(), "small_star")
        # both tables are without repeated rows: of equal size and without a difference, they are equal
        if before.count() == edges.count() and edges.join(before, ["a", "b"], "left_anti").limit(1).count() == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _named(rows: DataFrame, by: str, edges: DataFrame) -> DataFrame:
    """rows (doc_id, row and the class by) with first, the least (doc_id, row) of the component; NULL if it has no id."""
    own = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row")))
    classes = materialize(rows.groupBy(by).agg(own.alias("own")), "classes")
    roots = components(edges).withColumnRenamed("node", "_node")
    grouped = classes.join(roots, classes[by] == roots["_node"], "left").select(by, "own", F.coalesce("root", by).alias("root"))
    first = grouped.groupBy("root").agg(F.min("own").alias("first"))
    return rows.join(grouped.join(first, "root").select(by, "first"), by)


def _without_copies(docs: DataFrame, near: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows of near whose id and text are not the first of their component."""
    its_id, its_row = unused(docs, "its_id", "its_row")
    gone = near.where(F.col("doc_id").isNotNull() & (F.struct("doc_id", "row") != F.col("first"))).select(F.col("doc_id").alias(its_id), F.col("row").alias(its_row)).distinct()
    return docs.join(gone, (F.col(id_col) == F.col(its_id)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(its_row)), "left_anti")


def _components_of(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = materialize(rows.select("fp", F.col("fp").alias("node")).distinct(), "fingerprint_classes")
    return _named(rows, "fp", links(classes))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    near = _components_of(docs, id_col, text_col, shingle)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def shingle_set(text: str | None, shingle: int = 5, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (of all words, if they are fewer)."""
    words = (text or "").encode().lower().split()
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.append(0, ends[:-1] + 1)[: max(len(words) - shingle + 1, min(len(words), 1))].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist() if words else []
    return np.unique(np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def wide_fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of a shingle set (WORDS integers), and the two least certain bits of each 16-bit segment."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 rows fit a byte
        z = hashes[at : at + 255, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        ones += np.unpackbits((z ^ z >> np.uint64(31)).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    margin = 2 * ones - len(hashes)
    return np.packbits(margin > 0, bitorder="little").view(np.int64), np.argsort(np.abs(margin).reshape(-1, 16), axis=1, kind="stable")[:, :2].astype(np.int8)


def _set_node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _lists(values: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * width, pa.array(values.reshape(-1)))


def _wide_values(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of classes (words, doubtful), and for each segment its own value and the three others that are probed, with the segment within."""
    words = part.column("words").flatten().to_numpy().reshape(-1, WORDS)
    own = words.view(np.uint16).astype(np.int64) + (np.arange(4 * WORDS) << 16)
    return words, own[..., None] ^ _probed(part.column("doubtful").flatten().to_numpy())


def _probed(doubtful: np.ndarray) -> np.ndarray:
    """For each segment the bits that its four probes flip, the first none."""
    one, two = np.moveaxis((1 << doubtful.astype(np.int64)).reshape(-1, 4 * WORDS, 2), 2, 0)
    return np.stack([np.zeros_like(one), one, two, one ^ two], axis=2)


def _wide_entries(batches):
    """Stored and probing entries of classes (node, words, doubtful), as of _entries, with the segment within value."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            words, value = _wide_values(part)
            value = np.concatenate([value[..., :1], value], axis=2)
            probe = np.broadcast_to(np.arange(5) > 0, value.shape).reshape(-1)
            each = lambda c, n=4 * WORDS * 5: np.repeat(c, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(value.size, np.int32)), pa.array(value.reshape(-1)), pa.array(probe), pa.array(each(words[:, 0])), pa.array(each(part.column("node").to_numpy()))], ["segment", "value", "probe", "fp", "node"])


def _wide_members(batches):
    """Entries of classes (node, root, words, doubtful) that carry these along; the entry of an own value is stored and probes, so it comes once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            words, value = _wide_values(part)
            each = 4 * WORDS * 4
            of = pa.array(np.repeat(np.arange(len(words)), each))
            stored = np.broadcast_to(np.arange(4) == 0, value.shape).reshape(-1)
            known = [pa.array(np.zeros(value.size, np.int32)), pa.array(value.reshape(-1)), pa.array(stored), pa.array(np.ones(value.size, bool)), pa.array(np.repeat(words[:, 0], each))]
            yield pa.RecordBatch.from_arrays([*known, *(part.column(c).take(of) for c in ("node", "root", "words", "doubtful"))], ["segment", "value", "stored", "probe", "fp", "node", "root", "words", "doubtful"])


def _members(classes: DataFrame, keys: DataFrame | None, grids: DataFrame | None) -> DataFrame:
    """key, stored, probe, node, root, words, doubtful of the entries (under the given table values, if any), a row for each class (node, root, words, doubtful) there."""
    entries = classes.select("node", "root", "words", "doubtful").mapInArrow(_wide_members, "segment int, value long, stored boolean, probe boolean, fp long, node long, root long, words array<long>, doubtful array<byte>")
    entries = _keyed(entries, grids)
    if keys is not None:
        # broadcast, the values pick their entries before these are shuffled
        entries = entries.join(F.broadcast(keys) if keys.count() <= MIXED_BROADCAST else keys, "key", "left_semi")
    return entries.select("key", "stored", "probe", "node", "root", "words", "doubtful")


def _far_apart() -> Column:
    """Bits that words_a and words_b differ in."""
    return sum((F.bit_count(F.col("words_a")[k].bitwiseXOR(F.col("words_b")[k])) for k in range(WORDS)), F.lit(0))


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """node and shingles of the given nodes, as a written table."""

    def sets(batches):
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([_set_node(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["node", "shingles"])

    wanted = nodes.distinct().join(classes.select("node", "row"), "node").select("row")
    texts = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("row", F.xxhash64("text")).join(wanted, "row", "left_semi").dropDuplicates(["row", "text"])
    return materialize(texts.select("text").mapInArrow(sets, "node long, shingles array<long>").dropDuplicates(["node"]), "shingle_sets")


def _near(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidates (a, b) whose fingerprints are near on all bits."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("words").alias(f"words_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_far_apart() <= WIDE_DISTANCE).select("a", "b")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, as a written table."""
    pairs = materialize(pairs, "candidates")
    held = _sets_of(docs, classes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), text_col, shingle)
    side = lambda c: held.select(F.col("node").alias(c), F.col("shingles").alias(f"in_{c}"))
    shared = F.size(F.array_intersect("in_a", "in_b"))
    part, whole = LEAST_SHARED
    linked = pairs.join(side("a"), "a").join(side("b"), "b").where(whole * shared >= part * (F.size("in_a") + F.size("in_b") - shared))
    return materialize(linked.select("a", "b"), "similar_sets")


def _far_pairs(words: np.ndarray, other: np.ndarray, most: int):
    """Pairs of places (in words, in other) that differ in ``most`` bits at most, in blocks."""
    step = max(1, BLOCK_PAIRS // (2 * max(1, len(other))))
    for at in range(0, len(words), step):
        apart = np.bitwise_count((words[at : at + step, None] ^ other[None]).view(np.uint64)).sum(axis=2, dtype=np.int32)
        x, y = np.nonzero(apart <= most)
        yield x + at, y


def _across(batches, few: int):
    """Of the members of table values, in order of these: candidates between different components, with key -1; where a value has many, its nodes as
    (node, node) with the key, root and words. A pair that meets in several segments counts in the first only."""
    rest = None
    for batch in chain(batches, (None,)):
        part = pa.Table.from_batches([batch]) if batch is not None else None
        if rest is not None:
            part = pa.concat_tables([rest, part]) if part is not None else rest
        if part is None or not part.num_rows:
            continue
        key = part.column("key").to_numpy()
        whole = int(np.searchsorted(key, key[-1])) if batch is not None else len(key)  # the last value's members may go on in the next batch
        rest = part.slice(whole)
        if whole:
            yield from _across_values(part.slice(0, whole).combine_chunks(), few).to_batches()


def _across_values(group: pa.Table, few: int) -> pa.Table:
    key, stored, probe, node, root = (group.column(c).to_numpy(zero_copy_only=False) for c in ("key", "stored", "probe", "node", "root"))
    words = pa.concat_arrays(group.column("words").chunks).flatten().to_numpy().reshape(-1, WORDS)
    flips = _probed(pa.concat_arrays(group.column("doubtful").chunks).flatten().to_numpy()).astype(np.uint16)
    segment = (key & (1 << 32) - 1) >> 16
    _, value, rows = np.unique(key, return_inverse=True, return_counts=True)
    own, stored = np.flatnonzero(probe), np.flatnonzero(stored)
    first, last = np.searchsorted(key[stored], key[own]), np.searchsorted(key[stored], key[own], side="right")
    total = np.cumsum(last - first)
    met, n, found, at = np.zeros(len(key), bool), np.zeros(len(rows), np.int64), [], 0
    while at < len(own):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + BLOCK_PAIRS // 32, side="right")))  # a pair takes some hundred bytes here
        each = (last - first)[at:to]
        x = np.repeat(own[at:to], each)
        y = stored[np.arange(len(x)) - np.repeat(total[at:to] - each - before, each) + np.repeat(first[at:to], each)]
        new = root[x] != root[y]
        x, y = x[new], y[new]
        near = np.bitwise_count((words[x] ^ words[y]).view(np.uint64)).sum(axis=1, dtype=np.int32) <= WIDE_DISTANCE
        x, y = x[near], y[near]
        apart = (words.view(np.uint16)[x] ^ words.view(np.uint16)[y])[..., None]
        here = ((apart == flips[x]) | (apart == flips[y])).any(axis=2).argmax(axis=1) == segment[x]
        x, y = x[here], y[here]
        met[x] = met[y] = True
        n += np.bincount(value[x], minlength=len(rows))
        # more than few for each node there is: crowded whatever comes, and the pairs need not be held
        held = n[value[x]] <= few * rows[value[x]]
        found.append((x[held], y[held]))
        at = to
    crowded = n > few * np.bincount(value[met], minlength=len(rows))
    x, y = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (zip(*found) if found else ((), ())))
    x, y = x[~crowded[value[x]]], y[~crowded[value[x]]]
    pairs = np.unique(np.sort(np.stack([node[x], node[y]], axis=1), axis=1), axis=0)
    crowd = np.flatnonzero(met & crowded[value])
    one = pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "key": np.full(len(pairs), -1), "root": pa.nulls(len(pairs), pa.int64()), "words": pa.nulls(len(pairs), pa.list_(pa.int64()))})
    return pa.concat_tables([one, pa.table({"a": node[crowd], "b": node[crowd], "key": key[crowd], "root": root[crowd], "words": _lists(words[crowd], WORDS)})])


def _linked_in_crowd(group: pa.Table) -> pa.Table:
    """A forest of the similar sets of different components under a table value."""
    node, root = (group.column(c).to_numpy() for c in ("node", "root"))
    words = pa.concat_arrays(group.column("words").chunks).flatten().to_numpy().reshape(-1, WORDS)
    sets = [np.array(x) for x in group.column("shingles").to_pylist()]
    size, (_, label) = np.array([len(x) for x in sets]), np.unique(root, return_inverse=True)
    part, whole = LEAST_SHARED
    out = []
    for x, y in _far_pairs(words, words, WIDE_DISTANCE):
        # each pair once, of sets whose sizes allow the similarity
        able = (x < y) & (label[x] != label[y]) & (part * np.maximum(size[x], size[y]) <= whole * np.minimum(size[x], size[y]))
        for i, j in zip(x[able].tolist(), y[able].tolist()):
            if label[i] == label[j]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if whole * shared >= part * (len(sets[i]) + len(sets[j]) - shared):
                out.append((node[i], node[j]))
                label[label == label[i]] = label[j]
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _nearest_few(found: DataFrame) -> DataFrame:
    """The ``NEAREST`` nearest partners of each node of the pairs (a, b, d), as pairs (a, b) with a < b, each once."""
    pairs = found.select("a", "b", "d").distinct()
    order = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    near = pairs.union(pairs.select("b", "a", "d")).withColumn("nth", order).where(F.col("nth") <= NEAREST)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_sets(docs: DataFrame, rows: DataFrame, text_col: str, shingle: int, few: int = FEW) -> DataFrame:
    """Links (a, b) between nodes of rows (node, row, words, doubtful) that join all whose shingle sets are similar."""
    classes = materialize(rows.groupBy("node").agg(F.min("row").alias("row"), F.first("words").alias("words"), F.first("doubtful").alias("doubtful")), "set_classes")
    entries = classes.select("node", "words", "doubtful").mapInArrow(_wide_entries, "segment int, value long, probe boolean, fp long, node long")
    grids = _grids(entries)
    found = materialize(_dealt(entries, grids).mapInArrow(lambda batches: _forests(batches, few), "a long, b long, d int"), "pairs")
    linked = _verified(docs, classes, _near(classes, _nearest_few(found)), text_col, shingle)
    # texts with candidates meet again with the component they are in, whole fingerprints at hand
    roots = components(linked)
    texts = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    rooted = classes.join(texts, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = _members(rooted, None, grids).repartition(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key")
    across = materialize(members.mapInArrow(lambda batches: _across(batches, few), "a long, b long, key long, root long, words array<long>"), "pairs_across")
    linked = linked.union(_verified(docs, classes, across.where("key < 0").select("a", "b").distinct(), text_col, shingle))
    crowd = across.where("key >= 0").select("key", F.col("a").alias("node"), "root", "words")
    if crowd.isEmpty():
        return linked
    held = _sets_of(docs, classes, crowd.select("node"), text_col, shingle)
    return linked.union(crowd.join(held, "node").groupBy("key").applyInArrow(_linked_in_crowd, "a long, b long"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, few: int = FEW) -> DataFrame:
    """docs with one document per component of similar shingle sets, the one of the least id; all columns kept. Rows without an id stay."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            marks = [wide_fingerprint(x) for x in found]
            words = np.array([w for w, _ in marks], np.int64).reshape(-1, WORDS)
            doubtful = np.array([x.reshape(-1) for _, x in marks], np.int8).reshape(-1, 8 * WORDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([_set_node(x) for x in found], pa.int64()), _lists(words, WORDS), _lists(doubtful, 8 * WORDS)], ["doc_id", "row", "node", "words", "doubtful"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    rows = materialize(rows.mapInArrow(run, "doc_id long, row long, node long, words array<long>, doubtful array<byte>"), "wide_fingerprints")
    near = _named(rows.select("doc_id", "row", "node"), "node", similar_sets(docs, rows, text_col, shingle, few))
    return _without_copies(docs, near, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
