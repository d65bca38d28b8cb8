"""Similarity join of names by edit distance, with q-gram prefix and length filters, exact.

Names x and y are similar if 1 - distance / longer length is ``least`` or more. One edit changes ``Q`` q-grams at most, so similar names share
all but Q * d of a name's grams, d being the most edits that a partner of it may need. With every name's grams in one fixed order,
rarest first, two such names share one among the first Q * d + 1 of each: only these few rare grams are indexed, and a hot gram is in
hardly any prefix. Pairs that meet there pass a length filter and are verified by the banded ``levenshtein``. No pair is lost for
``least`` above 1/2 (a name has more grams than edits can change); nothing is sampled or capped.

A low ``least`` or a language of few syllables makes prefixes nearly whole names, and most names meet. Where the prefixes' own counts say that
more than one pair in ``OFTEN`` would, all pairs are held against the least number of grams to share instead, two blocks of ``BLOCK`` names a
task: each gram has a bit for each name of one block, and full adders count the grams that a name of the other block shares, 64 names a word.
Grams that fall into one of ``SLOTS`` only raise a count. Pairs with enough of them need a common subsequence as long as the longer name less its
edits, and those get their edit distance, both by bit vectors over many pairs at once. So this too loses no pair; its memory is that of two blocks, its
time grows with the square of the distinct names. Names of over 64 characters, and blocks of more than ``CLASSES`` - 2 characters, are verified by
``levenshtein``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitengine.session import materialize

Q = 2
BLOCK, SPREAD, SLOTS, OFTEN = 16384, 12, 1024, 50
#: Pairs and words of bits that are held in memory at once.
PAIRS, WORDS = 1 << 16, 1 << 17
#: Characters and repeats of a gram that are told apart in a block: rarer characters and further repeats count as one.
CLASSES, REPEATS = 128, 8
#: Most partitions that pairs of blocks are dealt over.
PARTITIONS = 1000


def _with_grams(names: DataFrame) -> DataFrame:
    """Adds the distinct q-grams of a padded name, each with how often it was seen before in it, so that a set of them counts repeats."""

    def cut(batches):
        for batch in batches:
            out = []
            for name in batch.column("name").to_pylist():
                padded, seen = "\x02" * (Q - 1) + name + "\x03" * (Q - 1), Counter()
                out.append([])
                for k in range(len(padded) - Q + 1):
                    gram = padded[k : k + Q]
                    seen[gram] += 1
                    out[-1].append(f"{gram}{seen[gram]}")
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.list_(pa.string()))], ["name", "grams"])

    return names.mapInArrow(cut, "name string, grams array<string>")


def _prefixes(names: DataFrame, frequency: DataFrame, least: float, parts: int) -> DataFrame:
    """name and gram: the rarest grams that a similar name must share one of."""
    edits = F.floor(F.length("name") * F.lit(1 / least - 1) + 1e-9)
    each = names.select("name", edits.alias("edits"), F.explode("grams").alias("gram")).join(frequency, "gram")
    ordered = F.sort_array(F.collect_list(F.struct("n", "gram")))
    first = each.repartition(parts, "name").groupBy("name", "edits").agg(ordered.alias("g")).select("name", F.explode(F.slice("g", F.lit(1), (F.lit(Q) * F.col("edits") + 1).cast("int"))).alias("g"))
    return first.select("name", F.col("g.gram").alias("gram"))


class _Block:
    """Names of one block as numbers: lengths, classes of their characters, and the distinct pairs (row, gram) with repeats counted."""

    def __init__(self, names: list[str]):
        self.names, self.lengths = names, np.array([len(x) for x in names], np.int64)
        self.points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)

    def cut(self, points: np.ndarray, classes: np.ndarray) -> None:
        """Classes of the characters (points ascending), and the grams of the padded names."""
        ends = self.lengths + 2 * (Q - 1)
        row, start = np.repeat(np.arange(len(ends)), ends), np.cumsum(ends) - ends
        at = np.arange(len(row)) - start[row]
        inner = (at >= Q - 1) & (at < Q - 1 + self.lengths[row])
        padded = np.where(at < Q - 1, CLASSES - 2, CLASSES - 1)
        padded[inner] = self.codes = classes[np.searchsorted(points, self.points)]
        grams = row
        for k in range(Q):
            grams = grams * CLASSES + np.roll(padded, -k)
        grams = np.sort(grams[at < self.lengths[row] + Q - 1])
        place = np.arange(len(grams))
        seen = place - np.maximum.accumulate(np.where(np.diff(grams, prepend=-1) != 0, place, 0))
        self.rows, self.grams = grams // CLASSES**Q, grams % CLASSES**Q * REPEATS + np.minimum(seen, REPEATS - 1)

    def columns(self, slots: np.ndarray) -> np.ndarray:
        """For each slot, a bit for each name that has a gram there."""
        wide = np.zeros((SLOTS, -(-len(self.names) // 64) * 64), bool)
        wide[slots[self.grams], self.rows] = True
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def matrix(self, width: int) -> np.ndarray:
        """Classes by position; what is longer than width stays empty."""
        out, row = np.full((len(self.names), width), CLASSES - 1, np.uint8), np.repeat(np.arange(len(self.lengths)), self.lengths)
        at = np.arange(len(row)) - (np.cumsum(self.lengths) - self.lengths)[row]
        kept = self.lengths[row] <= width
        out[row[kept], at[kept]] = self.codes[kept]
        return out


def _met(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> Iterator[np.ndarray]:
    """Of x[r] and y[c] (classes by position, r in runs), for each position of y the positions of x with the same class, a bit each."""
    width = x.shape[1]
    kind = np.uint32 if width <= 32 else np.uint64
    new = np.diff(r, prepend=-1) != 0
    each, first = x[r[new]], (np.cumsum(new) - 1) * CLASSES
    places = np.zeros((len(each), CLASSES), kind)
    for k in range(width):
        places[np.arange(len(each)), each[:, k]] |= kind(1 << k)
    places[:, CLASSES - 1] = 0  # behind the end
    places, at = places.ravel(), np.empty(len(r), np.int64)
    for column in np.ascontiguousarray(y[c].T):
        yield places.take(np.add(first, column, out=at), mode="clip")


def _common(met: Iterator[np.ndarray]) -> np.ndarray:
    """Lengths of the longest common subsequences (Hyyro's bit vectors)."""
    left = None
    for now in met:
        left = ~np.zeros_like(now) if left is None else left
        both = left & now
        now = np.subtract(left, both, out=now)
        left += both
        left |= now
    return np.bitwise_count(~left).astype(np.int64)


def _edits(met: Iterator[np.ndarray], m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edit distances of names of m and n characters (Myers's bit vectors)."""
    edits = m.copy()
    for k, now in enumerate(met):
        if k == 0:
            more, less, last = ~np.zeros_like(now), np.zeros_like(now), (m - 1).astype(now.dtype)
        down = now | less
        across = (((now & more) + more) ^ more) | now
        up, low = less | ~(across | more), more & across
        edits += (k < n) * ((up >> last & 1).astype(np.int64) - (low >> last & 1).astype(np.int64))
        up = up << 1 | 1
        more, less = low << 1 | ~(down | up), up & down
    return edits


def _plane(planes: list, weight: int) -> np.ndarray:
    """Of numbers given by bits (planes[w] has rows of bits that count 2**w each), the bit of 2**weight of their sum, by full adders side by side."""
    for w in range(weight):
        p, carried = planes[w], []
        while len(p) > 2:
            n = len(p) // 3 * 3
            a, b, c = p[0:n:3], p[1:n:3], p[2:n:3]
            carry = a ^ b
            p = np.concatenate([carry ^ c, p[n:]])
            carry &= c
            carry |= a & b
            carried.append(carry)
        if len(p) == 2:
            carried.append(p[:1] & p[1:])
        planes[w + 1] = np.concatenate([planes[w + 1], *carried])
    return np.bitwise_xor.reduce(planes[weight], axis=0)


def _bits(packed: np.ndarray) -> np.ndarray:
    """Places of the bits that are set, in order."""
    words = np.flatnonzero(packed)
    flags = np.unpackbits(packed[words].view(np.uint8), bitorder="little")
    eights = np.flatnonzero(flags.view(np.uint64))
    at = np.flatnonzero(flags.reshape(-1, 8)[eights])
    at = eights[at >> 3] * 8 + (at & 7)
    return words[at >> 6] * 64 + (at & 63)


def _near_in_blocks(names: list[str], more: list[str], least: float, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of names and of more that may be similar and their edit distance, -1 where it is left open, part by part; of one and the same block, each pair one way."""
    x = _Block(names)
    y = x if same else _Block(more)
    points, n = np.unique(np.concatenate([x.points, y.points]), return_counts=True)
    classes = np.empty(len(points), np.int64)
    classes[np.argsort(-n, kind="stable")] = np.minimum(np.arange(len(points)), CLASSES - 3)
    for side in {id(x): x, id(y): y}.values():
        side.cut(points, classes)
    rank = np.empty(CLASSES**Q * REPEATS, np.int64)
    rank[np.argsort(-np.bincount(y.grams, minlength=len(rank)), kind="stable")] = np.arange(len(rank))
    slots = np.where(rank < SLOTS, rank, SLOTS - 1 - rank % SLOTS)  # rare grams share those of the less frequent
    columns = y.columns(slots)
    own = np.sort(x.rows * SLOTS + slots[x.grams])
    own, slot = np.divmod(own[np.diff(own, prepend=-1) != 0], SLOTS)
    distinct = np.bincount(own, minlength=len(names))
    first = np.cumsum(distinct) - distinct
    longest, most_words = int(max(x.lengths.max(), y.lengths.max())), columns.shape[1]
    most = np.floor((1 - least) * np.arange(longest + 1) + 1e-9).astype(np.int64)
    width = 32 if longest <= 32 else 64
    left, right = x.matrix(width), y.matrix(width)
    order = np.lexsort((distinct, x.lengths))
    alike = np.flatnonzero((np.diff(x.lengths[order], prepend=-1) != 0) | (np.diff(distinct[order], prepend=-1) != 0))
    waiting, held = [], 0

    def verify():
        r, c = (np.concatenate(k) for k in zip(*waiting))
        for start in range(0, len(r), PAIRS):
            a, b = r[start : start + PAIRS], c[start : start + PAIRS]
            m, n = x.lengths[a], y.lengths[b]
            longer = np.maximum(m, n)
            near = (longer > width) | (_common(_met(left, right, a, b)) >= longer - most[longer])
            if same:
                near &= a <= b
            a, b, m, n, longer = (k[near] for k in (a, b, m, n, longer))
            edits = _edits(_met(left, right, a, b), m, n) if len(points) <= CLASSES - 2 else np.full(len(a), -1)
            edits[longer > width] = -1
            yield tuple(k[edits <= most[longer]] for k in (a, b, edits))

    for start, end in zip(alike, [*alike[1:], len(order)]):
        length, n = x.lengths[order[start]], distinct[order[start]]
        longer = np.maximum(length, y.lengths)
        # a gram may be lost by an edit, or share a slot with another one of its own name
        need = np.maximum(longer + Q - 1 - Q * most[longer] - (length + Q - 1 - n), 0)
        weight = int(max(n, need.max(), 1)).bit_length()
        rest = np.zeros((weight + 1, most_words * 64), bool)
        rest[:, : len(more)] = ((1 << weight) - need) >> np.arange(weight + 1)[:, None] & 1
        rest = np.packbits(rest, axis=1, bitorder="little").view(np.uint64)[:, None]
        step = max(1, WORDS // int(n * most_words))
        for k in range(start, end, step):
            rows = order[k : min(k + step, end)]
            shared = columns[slot[first[rows] + np.arange(n)[:, None]]]
            planes = [np.broadcast_to(p, (1, *shared.shape[1:])) for p in rest]
            planes[0] = np.concatenate([shared, planes[0]])
            r, c = np.divmod(_bits(_plane(planes, weight).ravel()), most_words * 64)
            waiting.append((rows[r], c))
            held += len(r)
            if held >= PAIRS:
                yield from verify()
                waiting, held = [], 0
    if held:
        yield from verify()


def _met_in_blocks(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a and b of all pairs that may be similar; of one and the same table, each pair one way."""
    same = left is right
    blocks = [max(-(-n // BLOCK), min(SPREAD, n // 2048), 1) for n in (side.count() for side in (left, right))]
    cut = lambda side, n, right: side.select("name", F.pmod(F.xxhash64("name"), F.lit(n)).cast("int").alias("own"), F.lit(right).alias("right"))
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = cut(left, blocks[0], False).select(F.col("own").alias("i"), others(blocks[1]).alias("j"), "right", "name")
    b = cut(right, blocks[1], True).select(others(blocks[0]).alias("i"), F.col("own").alias("j"), "right", "name")
    if same:
        a, b = a.where("i <= j"), b.where("i < j")

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [], []
        for batch in batches:
            for name, right in zip(batch.column("name").to_pylist(), batch.column("right").to_pylist()):
                sides[right].append(name)
        own = same and key[0].as_py() == key[1].as_py()
        names, more = sides[0], sides[0] if own else sides[1]
        if names and more:
            first, second = pa.array(names, pa.string()), pa.array(more, pa.string())
            for r, c, edits in _near_in_blocks(names, more, least, own):
                yield pa.RecordBatch.from_arrays([first.take(pa.array(r)), second.take(pa.array(c)), pa.array(edits, pa.int32())], ["a", "b", "edits"])

    # a number of its own: few bytes of names are much work, and would be laid together in one task
    n = min(blocks[0] * blocks[1] + 1, PARTITIONS)
    return a.unionByName(b).repartition(n, "i", "j").groupBy("i", "j").applyInArrow(meet, "a string, b string, edits int")


def similar_pairs(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """a, b and similarity of all similar pairs of distinct names, a of left and b of right (one column ``name`` each); empty names match nothing."""
    if not 0.5 < least <= 1:
        raise ValueError("least must be above 1/2")
    tables = {id(side): side for side in (left, right)}
    # a number given keeps the tasks apart: few bytes of names are much work
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = {k: materialize(_with_grams(side.select("name").where("name <> ''").distinct().repartition(parts, F.xxhash64("name"))), "name_grams") for k, side in tables.items()}
    sides = [tables[id(side)] for side in (left, right)]
    both = sides[0].unionByName(sides[1])
    frequency = both.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    prefixes = {k: materialize(_prefixes(side, frequency, least, parts), "name_prefixes") for k, side in tables.items()}
    a, b = (prefixes[id(side)] for side in (left, right))
    count = lambda side, n: side.groupBy("gram").agg(F.count("*").alias(n))
    meetings = count(a, "m").join(count(b, "n"), "gram").agg(F.sum(F.col("m").cast("double") * F.col("n"))).first()[0] or 0
    longer = F.greatest(F.length("a"), F.length("b"))
    most = F.floor((1 - least) * longer + 1e-9)
    near = lambda met, edits: met.withColumn("edits", edits).where(F.col("edits") <= most)
    if meetings * OFTEN > sides[0].count() * sides[1].count():
        found = near(_met_in_blocks(*sides, least), F.when(F.col("edits") >= 0, F.col("edits")).otherwise(F.levenshtein("a", "b")))
        if sides[0] is sides[1]:  # a pair has come one way
            ways = F.array(F.struct("a", "b"), F.when(F.col("a") != F.col("b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
            found = found.select("edits", F.explode(F.array_compact(ways)).alias("pair")).select("pair.a", "pair.b", "edits")
    else:
        met = a.withColumnRenamed("name", "a").join(b.withColumnRenamed("name", "b"), "gram")
        found = near(met.where(F.least(F.length("a"), F.length("b")) >= least * longer - 1e-9).select("a", "b").distinct(), F.levenshtein("a", "b"))
    return found.select("a", "b", (1 - F.col("edits") / longer).alias("similarity"))
