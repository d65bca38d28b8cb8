"""Hard negatives by a vector-approximation file.

The index is a table of blocks of rows. A block keeps, beside its vectors, their approximation: each dimension is cut
into 16 cells at the block's own quantiles, two dimensions share a byte, and each cell keeps its least and greatest
value. For an anchor the product of its component with these two bounds the part of that dimension in the score, so
two tables of 256 entries per pair of dimensions give a lower and an upper bound of a row's score by one look-up per
byte. Only rows whose bounds let them enter a window are scored exactly:

- positives: rows of the anchor's label whose upper bound reaches the k-th greatest lower bound of the block;
- negatives of a positive with score p: rows of other labels whose bounds meet [low% of p, high% of p] and reach the
  k-th greatest lower   bound of the rows that lie in this window for certain.

Bounds are exact for any cells (the cells are cut per block, no sample and no global statistics are fitted), so the
result is that of a full scan. Blocks of anchors meet blocks of rows on a grid: each cell of the grid is one task's
group of bounded size, and a block hands on at most k rows per anchor and window; these meet in a rank over the
anchor, which Spark cuts to k before it shuffles. Anchors (the query set) grow with the table, so nothing is
broadcast; the shuffle is rows times blocks of anchors plus anchors times blocks of rows, far below the inner products
that any search with this query set needs. Blocks hold rows by a digest of a row number, so copies of one vector, a
hot label or repeated ids are spread like other rows.

Scores are integers: components become floor(scale * x). Defined cases: rows with a null id, label or vector, with a
null or non-finite component, or with a component of 2**26 or more after scaling (scores would leave 64 bits) take no
part. Vectors meet vectors of their own length only; empty ones score 0. Repeated rows are rows of their own: each is
an anchor, a positive of the other, or a negative again, and equal ones tie; rows that tie in score and id are
interchangeable in the result. Without anchors, positives or fitting negatives there are no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitengine.llm._shared import materialize, table

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Per cent of the positive's score that a negative's score lies between.
WINDOW = (30, 90)
CELLS = 16
LIMIT = 2**26
#: Components of a block of rows, least rows of it, rows of a block of anchors, and anchors whose bounds are looked up together.
BLOCK_VALUES, LEAST_ROWS, ANCHORS, TOGETHER = 4_000_000, 2048, 4096, 32

BLOCK = "dim int, block int, ids binary, labels binary, keys binary, vectors binary, cells binary, lows binary, highs binary"
PACKET = "dim int, part int, ids binary, labels binary, keys binary, vectors binary, windows binary"


def cells_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (pairs of dimensions, rows) and the least and greatest value of each cell (dimensions, CELLS); an odd last dimension gets a partner of zeros."""
    n, dim = vectors.shape
    if dim % 2:
        vectors, dim = np.hstack([vectors, np.zeros((n, 1), np.int64)]), dim + 1
    ordered = np.sort(vectors, axis=0)
    cuts = ordered[(np.arange(1, CELLS) * n) // CELLS]
    codes = np.empty((dim, n), np.uint8)
    lows, highs = np.zeros((dim, CELLS), np.int64), np.zeros((dim, CELLS), np.int64)
    for j in range(dim):
        codes[j] = np.searchsorted(cuts[:, j], vectors[:, j], side="right")
        first = np.searchsorted(ordered[:, j], cuts[:, j])  # a cell starts at its cut and ends before the next
        starts, ends = np.concatenate([[0], first]), np.concatenate([first, [n]]) - 1
        some = starts <= ends
        lows[j, some], highs[j, some] = ordered[starts[some], j], ordered[ends[some], j]
    return codes[::2] * CELLS + codes[1::2], lows, highs


class Block:
    """A block of rows with its approximation."""

    def __init__(self, row: dict) -> None:
        self.ids, self.labels, self.keys = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "keys"))
        n, dim = len(self.ids), row["dim"]
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(n, dim)
        self.cells = np.frombuffer(row["cells"], np.uint8).reshape(-1, n)
        self.lows, self.highs = (np.frombuffer(row[c], np.int64).reshape(-1, CELLS) for c in ("lows", "highs"))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, (anchors, rows)."""
        a = anchors.astype(np.int64)
        if a.shape[1] < len(self.lows):
            a = np.hstack([a, np.zeros((len(a), 1), np.int64)])
        one, other = a[:, :, None] * self.lows, a[:, :, None] * self.highs  # (anchors, dimensions, cells)
        most = np.maximum(abs(one), abs(other)).max(axis=2).sum(axis=1).max(initial=0)
        kind = np.int32 if most < 2**31 else np.int64
        sums = []
        for side in (np.minimum(one, other).astype(kind), np.maximum(one, other).astype(kind)):
            pairs = (side[:, ::2, :, None] + side[:, 1::2, None, :]).reshape(len(a), -1, CELLS * CELLS)
            total = np.zeros((len(self.ids), len(a)), kind)
            for j, codes in enumerate(self.cells):
                total += np.ascontiguousarray(pairs[:, j].T)[codes]
            sums.append(np.ascontiguousarray(total.T))
        return sums[0], sums[1]

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.vectors[rows].astype(np.int64) @ anchor.astype(np.int64)

    def first(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the k rows of greatest score, ties by smaller id."""
        return np.lexsort((self.ids[rows], -scores))[:k]


def kth_greatest(values: np.ndarray, k: int) -> int | None:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def positives_in(block: Block, anchors: dict, k: int):
    """(anchor key, anchor id, id, score) of at most k rows of the anchor's label for each anchor."""
    for at in range(0, len(anchors["ids"]), TOGETHER):
        some = slice(at, at + TOGETHER)
        lower, upper = block.bounds(anchors["vectors"][some])
        for i in range(len(lower)):
            label, key, vector = (anchors[c][at + i] for c in ("labels", "keys", "vectors"))
            same = np.flatnonzero((block.labels == label) & (block.keys != key))
            least = kth_greatest(lower[i, same], k)
            rows = same if least is None else same[upper[i, same] >= least]
            scores = block.scores(rows, vector)
            for j in block.first(rows, scores, k).tolist():
                yield int(key), int(anchors["ids"][at + i]), int(block.ids[rows[j]]), int(scores[j])


def negatives_in(block: Block, anchors: dict, k: int, window: tuple[int, int]):
    """(anchor key, positive's number, id, score) of at most k rows of other labels in the window of each positive.

    anchors["windows"]: scores of each anchor's positives.
    """
    low, high = window
    for at in range(0, len(anchors["ids"]), TOGETHER):
        some = slice(at, at + TOGETHER)
        lower, upper = block.bounds(anchors["vectors"][some])
        for i in range(len(lower)):
            label, key, vector = (anchors[c][at + i] for c in ("labels", "keys", "vectors"))
            other = np.flatnonzero(block.labels != label)
            under, over = lower[i, other].astype(np.int64), upper[i, other].astype(np.int64)
            for number, p in enumerate(anchors["windows"][at + i], 1):
                floor, ceiling = -(-low * p // 100), high * p // 100  # the scores s with low * p <= 100 * s <= high * p
                if floor > ceiling:
                    continue
                least = kth_greatest(under[(under >= floor) & (over <= ceiling)], k)
                rows = other[(over >= (floor if least is None else max(floor, least))) & (under <= ceiling)]
                scores = block.scores(rows, vector)
                inside = (scores >= floor) & (scores <= ceiling)
                rows, scores = rows[inside], scores[inside]
                for j in block.first(rows, scores, k).tolist():
                    yield int(key), number, int(block.ids[rows[j]]), int(scores[j])


def usable(rows: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """key, vec_id, label, dim and vector (whole numbers) of the rows that take part, as a written table."""
    vector = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("raw"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull())
    fits = F.forall("raw", lambda x: x.isNotNull() & (F.abs(x) * scale < LIMIT))  # false for infinities; a NaN is greater than any number
    rows = rows.where(F.coalesce(fits, F.lit(False)))
    whole = F.transform("raw", lambda x: F.floor(x * scale).cast("int"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", F.size("raw").alias("dim"), whole.alias("vector")), "vectors")


def _packed(columns: dict[str, np.ndarray], **more) -> pa.Table:
    return pa.table({k: pa.array([v]) if not isinstance(v, np.ndarray) else pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in (columns | more).items()})


def _columns(group: pa.Table) -> tuple[dict[str, np.ndarray], int]:
    dim = group.column("dim")[0].as_py()
    flat = group.column("vector").combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    vectors = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(group), dim)
    return {"ids": group.column("vec_id").to_numpy().astype(np.int64), "labels": group.column("label").to_numpy().astype(np.int64), "keys": group.column("key").to_numpy().astype(np.int64), "vectors": vectors}, dim


def build_index(rows: DataFrame, blocks: int) -> DataFrame:
    """The approximation file of ``usable`` rows: one row per block and length of vectors."""

    def build(group: pa.Table) -> pa.Table:
        columns, dim = _columns(group)
        cells, lows, highs = cells_of(columns["vectors"].astype(np.int64))
        out = _packed(columns, cells=cells, lows=lows, highs=highs)
        return out.add_column(0, "dim", pa.array([dim], pa.int32())).add_column(1, "block", pa.array([group.column("block")[0].as_py()], pa.int32()))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    return materialize(dealt.groupBy("dim", "block").applyInArrow(build, BLOCK), "approximation_file")


def _packets(anchors: DataFrame, parts: int) -> DataFrame:
    """Anchors (with windows: scores of their positives) in blocks."""

    def pack(group: pa.Table) -> pa.Table:
        columns, dim = _columns(group)
        windows = group.column("windows").to_pylist()
        flat = np.array([[len(w), *w] + [0] * (POSITIVES_MOST - len(w)) for w in ([*(x or ())] for x in windows)], np.int64)
        out = _packed(columns, windows=flat)
        return out.add_column(0, "dim", pa.array([dim], pa.int32())).add_column(1, "part", pa.array([group.column("part")[0].as_py()], pa.int32()))

    dealt = anchors.withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(parts)).cast("int"))
    return dealt.groupBy("dim", "part").applyInArrow(pack, PACKET)


#: Most positives of an anchor that a packet holds.
POSITIVES_MOST = 64


def _grid(index: DataFrame, packets: DataFrame, blocks: int, parts: int, run, schema: str) -> DataFrame:
    """run over each block of rows with each block of anchors; the two meet by the number of the cell."""
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = packets.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("dim", "block", "part")
    names = [x.split()[0] for x in schema.split(", ")]

    def both(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if len(rows) and len(anchors):
            a = anchors.to_pylist()[0]
            n = len(a["ids"]) // 8
            held = {c: np.frombuffer(a[c], np.int64) for c in ("ids", "labels", "keys")}
            held["vectors"] = np.frombuffer(a["vectors"], np.int32).reshape(n, a["dim"])
            held["windows"] = [w[1 : 1 + w[0]].tolist() for w in np.frombuffer(a["windows"], np.int64).reshape(n, 1 + POSITIVES_MOST)]
            found = [*run(Block(rows.to_pylist()[0]), held)]
        flat = np.array(found, np.int64).reshape(-1, len(names))
        return pa.table({c: pa.array(flat[:, k]) for k, c in enumerate(names)})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(both, schema)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, block_values: int = BLOCK_VALUES, anchors_together: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. rows: as of ``usable``; is_anchor: a condition on them."""
    if not 0 < positives <= POSITIVES_MOST:
        raise ValueError(f"positives must be 1 to {POSITIVES_MOST}")
    spark = rows.sparkSession
    n, values, asked = rows.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0)), F.count_if(is_anchor)).first()
    blocks = max(-(-values // block_values), min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)), 1)
    parts = max(-(-asked // anchors_together), 1)
    index = build_index(rows, blocks)
    anchors = rows.where(is_anchor)

    packets = _packets(anchors.withColumn("windows", F.array().cast("array<long>")), parts)
    close = _grid(index, packets, blocks, parts, lambda b, a: positives_in(b, a, positives), "key long, anchor_id long, positive_id long, score long")
    by_score = Window.partitionBy("key").orderBy(F.desc("score"), "positive_id")
    close = materialize(close.withColumn("number", F.row_number().over(by_score)).where(F.col("number") <= positives), "positives")

    windows = close.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("number", "score"))).alias("w")).select("key", F.col("w.score").alias("windows"))
    packets = _packets(anchors.join(windows, "key"), parts)
    hard = _grid(index, packets, blocks, parts, lambda b, a: negatives_in(b, a, negatives, window), "key long, number long, negative_id long, negative_score long")
    ranked = Window.partitionBy("key", "number").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    pairs = close.select("key", F.col("number").cast("long").alias("number"), "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return hard.join(pairs, ["key", "number"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(rows, "vec_id", moved, "embedding", SCALE), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM q a JOIN q r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
