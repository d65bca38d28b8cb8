"""Event nodes of JSON-LD in pages, at any depth of arrays and graphs.

A page's script blocks are parsed as variants; each level of the walk is one ``variant_explode`` over the nodes found so far and keeps
array elements and the elements of ``@graph``, with the path they stand at. The walk ends at the first level without nodes. Each level is
a written table, so a deep page costs its depth and never a recomputation from the top; rows stay spread as the pages are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitengine.session import materialize

#: Types of event nodes, and what their fields and a page's metadata state.
EVENT_TYPES = ("event", "musicevent", "concerto")
SALE_FIELDS = (("onsaleStart", "GENERAL_ONSALE"), ("presaleStart", "PRESALE"), ("ticketSaleStart", "GENERAL_ONSALE"))
META = ("article:published_time", "article:modified_time")
SCRIPT = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"


def script_blocks(pages: DataFrame) -> DataFrame:
    """page, block (from 0), json of every JSON-LD script in pages (page, html)."""
    return pages.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("block", "json"))


def _is_array(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))


def walk(blocks: DataFrame, name: str = "jsonld") -> DataFrame:
    """page, block, depth, path and node (a variant) of all objects in blocks (page, block, json) that arrays and graphs lead to.

    A block that is no JSON has one row with a NULL node and path.
    """
    level = blocks.select("page", "block", F.lit(0).alias("depth"), F.lit("$").alias("path"), F.try_parse_json("json").alias("node"))
    level = materialize(level.withColumn("path", F.when(F.col("node").isNotNull(), F.col("path"))), name)
    found = level.where(F.col("node").isNull() | ~_is_array(F.col("node")))
    while True:
        spark = level.sparkSession
        parts = level.where("node IS NOT NULL").lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        graphs = parts.where("key = '@graph'").where(_is_array(F.col("value")))
        inside = graphs.select("page", "block", "depth", F.concat("path", F.lit(".@graph")).alias("path"), F.col("value").alias("node"))
        inside = inside.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        elements = parts.where(_is_array(F.col("node"))).unionByName(inside)
        level = elements.select("page", "block", (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("["), "pos", F.lit("]")).alias("path"), F.col("value").alias("node"))
        level = materialize(level, name)
        if level.isEmpty():
            return found
        found = found.unionByName(level.where(~_is_array(F.col("node"))))


def _text(node: Column, path: str) -> Column:
    """The field as text; NULL where it is missing, empty or false."""
    value = F.try_variant_get(node, path, "string")
    return F.when(~F.coalesce(value, F.lit("")).isin("", "0", "0.0", "false"), value)


def event_claims(pages: DataFrame) -> DataFrame:
    """page, block, path, kind and value: days, sale starts and prices of event nodes, BAD_JSON for blocks that are none, and publication metadata.

    Nothing is made up: a kind has a row only where the markup states it.
    """
    nodes = walk(script_blocks(pages))
    node = F.col("node")
    claim = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    single = [claim("EVENT_DATE", F.substring(_text(node, "$.startDate"), 1, 10))]
    single += [claim(kind, F.substring(_text(node, f"$.{field}"), 1, 10)) for field, kind in SALE_FIELDS]
    offers = F.coalesce(F.try_variant_get(node, "$.offers", "array<variant>"), F.array_compact(F.array(F.try_variant_get(node, "$.offers", "variant"))))
    price = lambda o: F.coalesce(_text(o, "$.price"), F.try_variant_get(o, "$.lowPrice", "string"))
    prices = F.transform(offers, lambda o: claim("TICKET_PRICE", price(o)))
    events = nodes.where(F.lower(F.try_variant_get(node, "$['@type']", "string")).isin(*EVENT_TYPES))
    stated = events.select("page", "block", "path", F.explode(F.concat(F.array(*single), prices)).alias("c")).select("page", "block", "path", "c.*").where("value IS NOT NULL")
    bad = nodes.where("node IS NULL").select("page", "block", "path", F.lit("BAD_JSON").alias("kind"), F.lit(None).cast("string").alias("value"))
    tags = pages.select("page", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))).alias("tag"))
    attribute = lambda a: F.regexp_extract("tag", rf"(?is)\b{a}\s*=\s*[\"']([^\"']*)[\"']", 1)
    meta = tags.select("page", F.lit(None).cast("int").alias("block"), attribute("property").alias("path"), F.lit("RESULT_PUBLICATION").alias("kind"), attribute("content").alias("value"))
    return stated.unionByName(bad).unionByName(meta.where(F.col("path").isin(*META) & (F.col("value") != "")))
