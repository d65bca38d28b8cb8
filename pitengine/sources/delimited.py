"""Text tables of unknown delimiter and headers: both are found per file from its own lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Delimiters in the order in which equal ones win.
DELIMITERS = (",", "\t", ";")
SAMPLE_LINES = 50
#: Least similarity of a header and a field's name, where neither the name nor an alias is equal.
NEAR = 0.8


def delimiters(lines: DataFrame) -> DataFrame:
    """file and delimiter: of those that stand in a file's first line, the one whose number is the same in most of its first lines, then the
    most frequent; a comma where none does. lines: file, line (from 0), text."""
    first = lines.where(F.col("line") < SAMPLE_LINES)
    # quoted parts hold no delimiters
    bare = F.regexp_replace("text", '"[^"]*"', "")
    count = lambda d: F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))
    each = first.select("file", "line", F.explode(F.array(*(F.struct(F.lit(-k).alias("order"), F.lit(d).alias("delimiter"), count(d).alias("n")) for k, d in enumerate(DELIMITERS)))).alias("d"))
    each = each.select("file", "line", "d.*")
    head = each.where("line = 0").select("file", "delimiter", F.col("n").alias("in_head"))
    voted = each.join(head, ["file", "delimiter"]).groupBy("file", "delimiter", "order").agg(F.count_if((F.col("n") == F.col("in_head")) & (F.col("in_head") > 0)).alias("same"), F.max("in_head").alias("in_head"))
    best = voted.groupBy("file").agg(F.max(F.struct("same", "in_head", "order", "delimiter")).alias("b"))
    return best.select("file", F.when(F.col("b.same") > 0, F.col("b.delimiter")).otherwise(",").alias("delimiter"))


def _name(c):
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def mapped_headers(headers: DataFrame, fields: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """file, at, header, field and score: 1 for the field's name, 0.95 for an alias, the similarity of the names from NEAR up; the best
    header of a field and the best field of a header, ties by place. headers: file, at, header. fields: field to its aliases."""
    spark = headers.sparkSession
    names = spark.createDataFrame([(f, n, 1.0 if k == 0 else 0.95, j) for j, (f, aliases) in enumerate(fields.items()) for k, n in enumerate((f, *aliases))], "field string, known string, exact double, nr int")
    longest = F.greatest(F.length("key"), F.length("known"))
    near = F.when(F.col("key") == F.col("known"), F.col("exact")).otherwise(0.9 * (1 - F.levenshtein("key", "known") / longest))
    pairs = headers.withColumn("key", _name(F.col("header"))).where("key <> ''").crossJoin(F.broadcast(names))  # the user's own short list
    scored = pairs.groupBy("file", "at", "header", "field", "nr").agg(F.round(F.max(near), 6).alias("score")).where(F.col("score") >= 0.9 * NEAR)
    best = scored.groupBy("file", "at", "header").agg(F.max(F.struct("score", (-F.col("nr")).alias("nr"), "field")).alias("b")).select("file", "at", "header", "b.field", "b.score")
    first = best.groupBy("file", "field").agg(F.max(F.struct("score", (-F.col("at")).alias("at"), "header")).alias("b"))
    return first.select("file", (-F.col("b.at")).alias("at"), "b.header", "field", "b.score")


def table_rows(lines: DataFrame, fields: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """file, line and the fields (text, NULL where a file has no such column) of all lines behind each file's header line."""
    # a delimiter counts where an even number of quotes follows it
    where = F.concat(F.lit("\\Q"), "delimiter", F.lit(r"\E(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"))
    bare = lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    split = lines.join(delimiters(lines), "file").withColumn("cells", F.transform(F.split("text", where), lambda x: bare(F.trim(x))))
    head = split.where("line = 0").select("file", F.posexplode("cells").alias("at", "header"))
    placed = mapped_headers(head, fields).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field", "at"))).alias("places"))
    body = split.where("line > 0").join(placed, "file")
    return body.select("file", "line", *(F.nullif(F.get("cells", F.try_element_at("places", F.lit(f))), F.lit("")).alias(f) for f in fields))
