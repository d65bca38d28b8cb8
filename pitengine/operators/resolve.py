"""Entity resolution: ladders of evidence with an explicit ambiguous state, overlaps, agreement between sources."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ladder(candidates: DataFrame, key: str, candidate: str, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per key: the first step that any candidate meets, MATCHED if one does and AMBIGUOUS if several do.

    A key whose candidates meet no step is NO_MATCH; keys without candidates must come with a NULL candidate.
    """
    place = F.lit(None).cast("int")
    for k, (_, condition) in reversed(list(enumerate(steps))):
        place = F.when(condition, k).otherwise(place)
    rows = candidates.withColumn("_step", F.when(F.col(candidate).isNotNull(), place))
    best = rows.groupBy(key).agg(F.min("_step").alias("_step"))
    hits = rows.join(best, [key, "_step"]).groupBy(key, "_step").agg(F.count_distinct(candidate).alias("candidates"), F.min(candidate).alias("_first"))
    names = F.array(*(F.lit(n) for n, _ in steps))
    out = best.select(key).join(hits, key, "left")
    return out.select(
        key,
        F.when(F.col("candidates").isNull(), "NO_MATCH").when(F.col("candidates") > 1, "AMBIGUOUS").otherwise("MATCHED").alias("status"),
        F.when(F.col("_step").isNotNull(), F.try_element_at(names, F.col("_step") + 1)).alias("method"),
        F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"),
        F.when(F.col("candidates") == 1, F.col("_first")).alias("match"),
    )


def anchor_clusters(rows: DataFrame, block: Sequence[str], start: str, end: str, key: str) -> DataFrame:
    """Adds anchor: in order of (start, key) within a block, a row joins the running anchor while it starts no later than the
    anchor's end, and is an anchor of its own otherwise. Rows without a start are their own anchor.

    A block's rows go by in order; only the running anchor is held.
    """
    known = rows.where(F.col(start).isNotNull()).select(*block, F.col(start).alias("_from"), F.coalesce(end, start).alias("_to"), F.col(key).alias("_key"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        current, anchor, until = None, None, None
        for batch in batches:
            names = list(zip(*(batch.column(b).to_pylist() for b in block)))
            anchors = []
            for name, begins, ends, k in zip(names, *(batch.column(c).to_pylist() for c in ("_from", "_to", "_key"))):
                if name != current or begins > until:
                    current, anchor, until = name, k, ends
                anchors.append(anchor)
            keys = batch.column("_key")
            yield pa.RecordBatch.from_arrays([keys, pa.array(anchors, keys.type)], ["_key", "anchor"])

    assigned = known.repartition(*block).sortWithinPartitions(*block, "_from", "_key").mapInArrow(run, f"_key {kind}, anchor {kind}").withColumnRenamed("_key", key)
    return rows.join(assigned, key, "left").withColumn("anchor", F.coalesce("anchor", F.col(key)))


def agreement(rows: DataFrame, key: str, source: str, fields: Sequence[str]) -> DataFrame:
    """Per field: keys that two sources and more report, how many agree exactly, and the spread of the others."""
    # a key is grouped once, with all fields side by side; it has two sources and more if the first is not the last
    own = lambda f, c: F.when(F.col(f).isNotNull(), F.col(c))
    ends = [x for k, f in enumerate(fields) for x in (F.min(own(f, source)).alias(f"_a{k}"), F.max(own(f, source)).alias(f"_b{k}"), F.min(f).alias(f"_l{k}"), F.max(f).alias(f"_h{k}"))]
    each = F.array(*(F.struct(F.lit(f).alias("field"), (F.col(f"_a{k}") < F.col(f"_b{k}")).alias("several"), F.col(f"_l{k}").alias("low"), F.col(f"_h{k}").alias("high")) for k, f in enumerate(fields)))
    per = rows.groupBy(key).agg(*ends).select(F.explode(each).alias("f")).select("f.*").where("several")
    return per.groupBy("field").agg(F.count("*").alias("compared"), F.count_if(F.col("low") == F.col("high")).alias("exact"), F.avg(F.col("high") - F.col("low")).alias("mean_spread"), F.max(F.try_divide(F.col("high") - F.col("low"), F.abs("high"))).alias("max_part"))


def search(terms: DataFrame, entities: str, term: str, query: str, name: str, limit: int | None = None) -> DataFrame:
    """Entities by the best layer in which the query finds them: exact, prefix, substring; then by name and id."""
    q = query.lower().strip()
    low = F.lower(F.col(term))
    layer = F.when(low == q, 1).when(low.startswith(q), 2).when(low.contains(q), 3)
    hits = terms.withColumn("layer", layer).where(F.col("layer").isNotNull())
    best = hits.groupBy(entities).agg(F.min("layer").alias("layer"), F.min(name).alias(name))
    ordered = best.orderBy("layer", F.lower(name), entities)
    return ordered.limit(limit) if limit else ordered


def first_per_key(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
