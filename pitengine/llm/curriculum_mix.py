"""Mixing sources to target weights on a time-varying curriculum, in DataFrame functions only.

Each source gets a target by weight, stopped at ``cap`` times its size; what it cannot take is shared
again by weight until no source is above (the level of that water filling is found in closed form by
windows over one row per source). Within a source, documents are taken in the order of a digest of
their id, pass after pass, until the target is used up; the document at the border is taken in part.

A source's share over training time is a piecewise linear schedule. Its integral is the source's
cumulative demand; inverting it at the words taken so far gives the training time (0 to 1) at which a
document is due. ``training_stream`` range-sorts the documents by that position.

The running sums of words need no task that holds a source: each source is cut by the leading digits of
the digest into many buckets, small sums per bucket give the bucket's offset, and only the rows of one
bucket are ordered together. The bucket number only decides the partitions and not the order.

Defined cases: a null text has size 0, and rows of size 0 are never taken. A very long text counts as any other. A null source is a
source of its own, after all others; it never equals the empty string. Rows that repeat an id are taken as rows of
their own, in the order of size. Rows without an id come last, in the order of a digest of their text. Empty tables, and tables
without words, give targets of 0. Extra columns, whatever their names, are ignored by ``mix`` and kept by ``training_stream``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitengine.llm._shared import WORD, materialize, shuffle_partitions, table, unused

WEIGHTS, RATIO, CAP = (5, 2, 1), 1.5, 2
#: For the sources of each weight: knots (training time, relative rate) of the schedule.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (0.5, 1.2), (1.0, 1.0)), ((0.0, 0.5), (0.6, 1.0), (1.0, 2.0)))
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 16_384, 256, 1 << 20


def due(used: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The training time at which the part ``used`` (0 to 1) of a source's demand is reached: its inverse integral."""
    pieces, area = [], 0.0
    for (t, w), (t2, w2) in zip(schedule, schedule[1:]):
        pieces.append((area, t, w, (w2 - w) / (t2 - t)))
        area += (w + w2) / 2 * (t2 - t)
    want, out = used * F.lit(area), None
    for start, t, w, slope in pieces:
        rest = F.greatest(want - F.lit(start), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * rest, F.lit(0.0)))
        at = F.lit(t) + F.when(rest > 0, 2 * rest / (F.lit(w) + root)).otherwise(0.0)
        out = at if out is None else F.when(want >= start, at).otherwise(out)
    return F.least(out, F.lit(float(schedule[-1][0])))


def _by_source(schedules: Sequence[Sequence[tuple[float, float]]], used: Column) -> Column:
    out = due(used, schedules[0])
    for k, s in enumerate(schedules[1:], 1):
        out = F.when(F.col("class") == k, due(used, s)).otherwise(out)
    return out


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """Adds class, weight and target to one row per source (no_source, source, source_size)."""
    everything, by_name = Window.partitionBy(), Window.orderBy("no_source", "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("class") + 1)
    rows = sizes.withColumn("class", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")).withColumn("weight", weight)
    rows = rows.withColumn("_cap", cap * F.col("source_size").cast("double")).withColumn("_full", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_full", "no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0.0))
    level = (F.lit(ratio) * F.sum("source_size").over(everything) - before("_cap")) / (F.sum("weight").over(everything) - before("weight"))
    rows = rows.withColumn("_level", level)
    rows = rows.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_full"), F.col("_level"))).over(everything))
    target = F.least("_cap", F.coalesce("_level", F.lit(float("inf"))) * F.col("weight"))
    return rows.select("no_source", "source", "source_size", "class", "weight", target.alias("target"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    source = F.col(source_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        source.isNull().alias("no_source"),
        F.coalesce(source, F.lit("")).alias("source"),
        F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.concat(F.lit("g"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))).alias("turn"),
        F.xxhash64(F.col(text_col).cast("string")).alias("mark"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, ratio: float = RATIO, cap: int = CAP) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, and for each of the ``cap`` passes
    pass_k (words taken) and position_k (training time of its middle, null where nothing is taken). Range-sorted by the
    position of the first pass; rows that are not taken come last."""
    out = _plan(docs, id_col, text_col, source_col, weights, schedules, ratio, cap).drop("no_source", "source", "mark")
    order = [F.col("position_1").asc_nulls_last(), F.col("doc_id")]
    return out.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)


def _plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, ratio: float = RATIO, cap: int = CAP) -> DataFrame:
    """The columns of ``mix`` with no_source, source and mark (a hash of the text)."""
    rows = materialize(sizes(docs, id_col, text_col, source_col), "sizes")
    wanted, n = rows.count() // BUCKET_ROWS, LEAST_BUCKETS
    while n < min(wanted, MOST_BUCKETS):
        n *= 2
    # rows without an id (their turn starts with g) have as many buckets again, behind the others
    digits = lambda at: F.conv(F.substring("turn", at, 8), 16, 10).cast("long")
    head = F.when(F.col("turn").startswith("g"), (1 << 32) + digits(2)).otherwise(digits(1))
    rows = rows.withColumn("bucket", (head / F.lit((1 << 32) // n)).cast("long"))
    keys = ["no_source", "source", "bucket"]
    buckets = materialize(rows.groupBy(keys).agg(F.sum("size").alias("words")), "buckets")
    shares = targets(buckets.groupBy("no_source", "source").agg(F.sum("words").alias("source_size")), weights, ratio, cap)
    along = Window.partitionBy("no_source", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(*keys, F.coalesce(F.sum("words").over(along), F.lit(0).cast("long")).alias("offset"))
    offsets = materialize(offsets.join(shares, ["no_source", "source"]), "offsets")
    inside = Window.partitionBy(*keys).orderBy("turn", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    rows = rows.join(offsets, keys).withColumn("_start", F.col("_start") + F.col("offset"))
    passes, positions = [], []
    for k in range(cap):
        at = F.col("_start") + k * F.col("source_size")
        took = F.greatest(F.least(F.floor(F.col("target") + 0.5) - at, F.col("size")), F.lit(0).cast("long")).cast("long")
        passes.append(took.alias(f"pass_{k + 1}"))
        used = F.least(F.try_divide(at + took / F.lit(2.0), F.col("target")), F.lit(1.0))
        positions.append(F.when(took > 0, F.round(_by_source(schedules, used), 6)).alias(f"position_{k + 1}"))
    out = rows.select("doc_id", "size", "source_size", "target", "no_source", "source", "mark", *passes, *positions)
    taken = sum((F.col(f"pass_{k + 2}") for k in range(cap - 1)), F.col("pass_1"))
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(f"pass_{k + 1}" for k in range(cap)), *(f"position_{k + 1}" for k in range(cap)), "no_source", "source", "mark")


def training_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs in training order, all columns kept: a row for each pass that takes at least half of its document.

    Documents are left whole, so a source misses its target by half a document at most. Each row has its own plan, found by
    id, source and text; rows that are equal in these share out their plans in any order.
    """
    n = options.get("cap", CAP)
    due, number, theirs_number, *names = unused(docs, "mix_due", "mix_number", "mix_own_number", *(f"mix_{again}{k}" for again in ("", "again_") for k in ("id", "no_source", "source", "mark")))
    names, again_names = names[:4], names[4:]
    wanted = F.array_compact(F.array(*(F.when(2 * F.col(f"pass_{k + 1}") >= F.col("size"), F.col(f"position_{k + 1}")) for k in range(n))))
    plan = _plan(docs, id_col, text_col, source_col, **options)
    keys = ["doc_id", "no_source", "source", "mark"]
    plan = materialize(plan.select(*(F.col(k).alias(name) for k, name in zip(keys, names)), wanted.alias(due)), "training_plan")
    source = F.col(source_col).cast("string")
    own = [F.col(id_col), source.isNull(), F.coalesce(source, F.lit("")), F.xxhash64(F.col(text_col).cast("string"))]
    planned, again = [F.col(name) for name in names], [F.col(name) for name in again_names]
    same = lambda a, b: a[0].eqNullSafe(b[0]) & (a[1] == b[1]) & (a[2] == b[2]) & (a[3] == b[3])
    repeated = plan.groupBy(*names).count().where("count > 1").select(*(F.col(name).alias(other) for name, other in zip(names, again_names)))
    repeated = materialize(repeated, "repeated_plans")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if repeated.limit(1).count() == 0:
        stream = docs.join(plan, same(own, planned)).select(*columns, due)
    else:
        stream = docs.join(plan.join(repeated, same(planned, again), "left_anti"), same(own, planned)).select(*columns, due)
        rank = lambda parts: F.row_number().over(Window.partitionBy(*parts).orderBy(parts[0]))
        several = plan.join(repeated, same(planned, again), "left_semi").withColumn(number, rank(planned))
        theirs = docs.join(repeated, same(own, again), "left_semi").withColumn(theirs_number, rank(own))
        stream = stream.unionByName(theirs.join(several, same(own, planned) & (F.col(theirs_number) == F.col(number))).select(*columns, due))
    stream = stream.withColumn(due, F.explode(due))
    ordered = stream.repartitionByRange(shuffle_partitions(docs.sparkSession), due, id_col).sortWithinPartitions(due, id_col)
    return ordered.select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _due_sql(used: str, schedule: Sequence[tuple[float, float]]) -> str:
    pieces, area = [], 0.0
    for (t, w), (t2, w2) in zip(schedule, schedule[1:]):
        pieces.append((area, t, w, (w2 - w) / (t2 - t)))
        area += (w + w2) / 2 * (t2 - t)
    out = ""
    for start, t, w, slope in pieces:
        rest = f"greatest({used} * {area!r}::double - {start!r}::double, 0.0::double)"
        at = f"({t!r}::double + case when {rest} > 0 then 2 * {rest} / ({w!r}::double + sqrt(greatest({w * w!r}::double + {2 * slope!r}::double * {rest}, 0.0::double))) else 0.0::double end)"
        out = f"case when {used} * {area!r}::double >= {start!r}::double then {at} else {out} end" if out else at
    return f"least({out}, {schedule[-1][0]!r}::double)"


def oracle() -> str:
    """DuckDB SQL for ``query``: the same rules with one window per source."""
    by_class = lambda used: "case class " + " ".join(f"when {k} then {_due_sql(used, s)}" for k, s in enumerate(SCHEDULES)) + " end"
    position = lambda k: f"case when pass_{k} > 0 then round({by_class(f'least((start + {k - 1} * source_size + pass_{k} / 2.0::double) / target, 1.0::double)')}, 6) end AS position_{k}"
    took = lambda k: f"greatest(least(cast(floor(target + 0.5::double) as bigint) - (start + {k - 1} * source_size), size), 0)::bigint AS pass_{k}"
    return f"""
WITH docs AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size FROM documents),
names AS (SELECT source, sum(size)::bigint AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class,
    [{', '.join(f'{float(w)}' for w in WEIGHTS)}]::double[] AS ws FROM names),
caps AS (SELECT source, source_size, class, ws[class + 1] AS w, {CAP}.0::double * source_size AS cap FROM weighed),
levels AS (
  SELECT *, cap / w AS full_at,
    ({RATIO}::double * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0.0::double)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0::double)) AS level
  FROM caps WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, class, least(cap, w * (SELECT max(level) FROM levels WHERE level <= full_at)) AS target FROM levels),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY coalesce(md5(doc_id::varchar), 'g' || md5(coalesce(text, ''))), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM docs),
passes AS (
  SELECT doc_id, size, source_size, target, class, start, {took(1)}, {took(2)}
  FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, pass_1 + pass_2 AS taken, pass_1, pass_2, {position(1)}, {position(2)} FROM passes
"""


ORACLE = oracle()
