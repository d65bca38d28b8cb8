"""License scans: sparse TF-IDF cosine of notices and licence files to templates, then inheritance by directory.

A text is a sequence of terms (runs of letters and digits, with inner dots). Each template, a licence's tag, notice, header or text,
is held against windows of as many terms as it has, a start every eighth of that, wherever lines break. The terms are weighed by
their count in the window and by how few documents of the corpus hold them; the cosine of window and template,
``THRESHOLD`` at least, gives a licence, and the greatest one the text's. Terms of the window that the template doesn't have lengthen
it with the weight of a term that no document holds.

Most texts are never cut into windows: a window of cosine c needs template terms whose squared weights sum to c squared, so a text
without them is left out exactly, first by a look at the terms that are needed in any case, then by the sums. Texts are handled by a
digest, so copies are weighed once, and a window's terms are counted by grouping: the work grows with a text's length and not with its square.

A file is a licence file if its base name is like ``FILE_NAMES`` or the template of its licence has at least half as many terms as
the file. A directory's licence is the best of its licence files'. A file without a licence of its own inherits from the
nearest directory above it that has one; the directories are joined by path, each distinct one once.

Only DataFrame functions are used. Defined cases: null and empty texts have no licence of their own and may inherit one; a null path has
no directory and inherits nothing; a file at the top lies in the directory ``''``. Equal cosines go to the licence first in
code-point order. A very long text is scanned whole. Repeated rows are files of their own. Empty tables work; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitengine.llm._shared import LOWER, UPPER, ascii_lower, materialize, table
from pitengine.llm.license_texts import templates as usual_templates

THRESHOLD = 0.8
#: Starts of windows in a template's length.
STARTS = 8
TERM = r"[a-z0-9]+(?:[.][a-z0-9]+)*"
FILE_NAMES = r"^(licen[cs]e|copying|notice|unlicense)([.-][a-z0-9.-]+)?$"
TEMPLATES = usual_templates()


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def _rows(templates: Sequence[tuple[str, str]]) -> list[tuple[int, str, int, str, int]]:
    """template, license, its number of terms, term, count."""
    lower = str.maketrans(UPPER, LOWER)
    out = []
    for k, (name, text) in enumerate(templates):
        found = re.findall(TERM, text.translate(lower))
        out += [(k, name, len(found), term, n) for term, n in sorted(Counter(found).items())]
    return out


def _weights(spark: SparkSession, templates: Sequence[tuple[str, str]], counts: DataFrame, total: int) -> DataFrame:
    """template, license, n, step, term, idf and weight, a unit vector per template. Templates are a parameter, some thousand rows."""
    rows = spark.createDataFrame(_rows(templates), "template int, license string, n int, term string, tf int")
    idf = F.log(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1
    rows = rows.join(counts, "term", "left").withColumn("idf", idf).withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / STARTS).cast("int"))
    return rows.select("template", "license", "n", step.alias("step"), "term", "idf", (F.col("w") / length).alias("weight"))


def _needed(weights: list, threshold: float) -> list[str]:
    """Terms of which a window of that cosine has one at least: all but a template's lightest, as far as these don't reach it together."""
    light: dict[int, float] = {}
    needed = set()
    for v in sorted(weights, key=lambda v: (v.weight, v.term)):
        light[v.template] = light.get(v.template, 0.0) + v.weight**2
        if light[v.template] >= threshold**2 - 1e-9:
            needed.add(v.term)
    return sorted(needed)


def _matches(files: DataFrame, seen: DataFrame, weights: DataFrame, needed: list[str], total: int, threshold: float) -> DataFrame:
    """digest, own (cost, license, n) of every text with a window of that cosine."""
    small = F.broadcast(weights)  # one row per term of each template
    held = seen.where(F.arrays_overlap("there", F.lit(needed))).groupBy("digest").agg(F.first("there").alias("there"))
    held = held.select("digest", F.explode("there").alias("term")).join(small.select("template", "term", "weight"), "term")
    enough = held.groupBy("digest", "template").agg(F.sum(F.col("weight") * F.col("weight")).alias("mass")).where(F.col("mass") >= threshold**2 - 1e-9)
    wanted = materialize(enough.groupBy("digest").agg(F.collect_set("template").alias("wanted")), "license_candidates")
    texts = files.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text").join(wanted, "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.first("text").alias("text")).join(wanted, "digest")
    words = texts.select("digest", "wanted", terms(F.col("text")).alias("terms")).withColumn("length", F.size("terms"))
    words = words.select("digest", "wanted", "length", F.posexplode("terms").alias("pos", "term")).join(small, "term").where(F.array_contains("wanted", F.col("template")))
    low = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("n") + 1) / F.col("step")).cast("int"))
    spread = words.withColumn("start", F.explode(F.sequence(low, F.floor(F.col("pos") / F.col("step")).cast("int")))).withColumn("start", F.col("start") * F.col("step"))
    counted = spread.groupBy("digest", "template", "license", "n", "start", "length", "term", "idf", "weight").agg(F.count("*").alias("tf"))
    each = F.col("tf") * F.col("idf")
    scored = counted.groupBy("digest", "template", "license", "n", "start", "length").agg(F.sum(each * F.col("weight")).alias("dot"), F.sum(each * each).alias("squares"), F.sum("tf").alias("held"))
    unknown = F.log(F.lit(1.0 + total)) + 1
    others = F.least(F.col("n"), F.col("length") - F.col("start")) - F.col("held")
    cosine = F.round(F.col("dot") / F.sqrt(F.col("squares") + others * unknown * unknown), 6)
    best = scored.withColumn("cosine", cosine).where(F.col("cosine") >= threshold)
    return best.groupBy("digest").agg(F.min(F.struct((-F.col("cosine")).alias("cost"), "license", (-F.col("n")).alias("n"))).alias("own"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per file: path, license, how (own, inherited, none), score, is_license_file, and the directory it came from."""
    spark = files.sparkSession
    files = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    names = sorted({r[3] for r in _rows(templates)})
    seen = files.select("path", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), terms(F.col("text")).alias("terms"))
    seen = materialize(seen.select("path", "digest", F.size("terms").alias("n_terms"), F.array_intersect("terms", F.lit(names)).alias("there")), "license_terms")
    total = seen.count()
    counts = seen.select(F.explode("there").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = materialize(_weights(spark, templates, counts, total), "license_weights")
    needed = _needed(weights.select("template", "term", "weight").collect(), threshold)
    found = materialize(_matches(files, seen, weights, needed, total, threshold), "license_matches")

    base = ascii_lower(F.substring_index("path", "/", -1))
    licence_file = F.col("own").isNotNull() & (F.rlike(base, F.lit(FILE_NAMES)) | (-2 * F.col("own.n") >= F.col("n_terms")))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    rows = seen.select("path", "digest", "n_terms").join(found, "digest", "left")
    rows = rows.select("path", folder.alias("dir"), "own", F.coalesce(licence_file, F.lit(False)).alias("is_license_file"))
    rows = materialize(rows, "license_files")

    given = rows.where("is_license_file AND dir IS NOT NULL").groupBy("dir").agg(F.min("own").alias("given"))
    # every directory with those above it, from itself (0) to the top ('')
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    dirs = rows.where("own IS NULL AND dir IS NOT NULL").select("dir").distinct()
    above = dirs.withColumn("up", F.explode(F.sequence(F.lit(0), depth))).withColumn("from", F.when(depth - F.col("up") <= 0, "").otherwise(F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.greatest(depth - F.col("up"), F.lit(1))), "/")))
    near = above.join(given.withColumnRenamed("dir", "from"), "from").groupBy("dir").agg(F.min(F.struct("up", "from", "given")).alias("near"))
    # a written table: with the aggregation below the join, Spark could not split the rows of a hot directory
    out = rows.join(materialize(near, "license_inherited"), "dir", "left")
    mine = F.col("own").isNotNull()
    return out.select(
        "path",
        F.when(mine, F.col("own.license")).otherwise(F.col("near.given.license")).alias("license"),
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(mine, -F.col("own.cost")).otherwise(-F.col("near.given.cost")).alias("score"),
        "is_license_file",
        F.when(mine, F.col("dir")).otherwise(F.col("near.from")).alias("license_dir"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are files named by their id in a directory per source and language."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    found = scan(docs.select(path.alias("path"), "text"))
    return found.select(F.try_to_number(F.substring_index("path", "/", -1), F.lit("9999999999999999999")).cast("long").alias("doc_id"), "path", "license", "how", "score", "is_license_file", "license_dir")


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``query``: every window of every document against every template, and directories by prefix."""
    values = ", ".join(f"({k}, '{name}', {n}, '{term}', {tf})" for k, name, n, term, tf in _rows(templates))
    names = FILE_NAMES.replace("'", "''")
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || coalesce(doc_id::varchar, '-') AS path,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
parts(template, license, n, term, tf) AS (VALUES {values}),
dfs AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT rid, unnest(terms) AS term FROM docs) GROUP BY term),
total AS (SELECT count(*) AS c FROM docs),
idfs AS (SELECT p.*, ln((1.0::double + c) / (1 + coalesce(df, 0))) + 1 AS idf FROM parts p LEFT JOIN dfs USING (term), total),
weights AS (SELECT *, greatest(1, n // {STARTS}) AS step, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS weight FROM idfs),
words AS (SELECT rid, len(terms) AS length, unnest(range(len(terms))) AS pos, unnest(terms) AS term FROM docs),
spread AS (
  SELECT rid, length, template, license, n, term, idf, weight, step * unnest(range(greatest(0, ceil((pos - n + 1) / step::double)::bigint), pos // step + 1)) AS start
  FROM words JOIN weights USING (term)),
counted AS (SELECT rid, length, template, license, n, start, term, idf, weight, count(*) AS f FROM spread GROUP BY ALL),
scored AS (
  SELECT rid, license, n, round(sum(f * idf * weight) / sqrt(sum(f * idf * f * idf) + (least(n, length - start) - sum(f)) * (SELECT (ln(1.0::double + c) + 1) ** 2 FROM total)), 6) AS cosine
  FROM counted GROUP BY rid, length, template, license, n, start),
own AS (
  SELECT rid, license, n, cosine FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY cosine DESC, license, n DESC) AS k FROM scored WHERE cosine >= {threshold}) WHERE k = 1),
files AS (
  SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, license, cosine,
         coalesce(license IS NOT NULL AND (regexp_matches(translate(split_part(path, '/', -1), '{UPPER}', '{LOWER}'), '{names}') OR 2 * n >= len(terms)), false) AS is_license_file
  FROM docs LEFT JOIN own USING (rid)),
given AS (
  SELECT dir, license, cosine FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license) AS k FROM files WHERE is_license_file) WHERE k = 1),
near AS (
  SELECT dir, g_dir, license, cosine FROM (
    SELECT d.dir, g.dir AS g_dir, g.license, g.cosine, row_number() OVER (PARTITION BY d.dir ORDER BY length(g.dir) DESC) AS k
    FROM (SELECT DISTINCT dir FROM files) d JOIN given g ON d.dir = g.dir OR starts_with(d.dir, g.dir || '/')) WHERE k = 1)
SELECT doc_id, path, coalesce(f.license, g.license) AS license, CASE WHEN f.license IS NOT NULL THEN 'own' WHEN g.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       coalesce(f.cosine, g.cosine) AS score, is_license_file, CASE WHEN f.license IS NOT NULL THEN f.dir ELSE g_dir END AS license_dir
FROM files f LEFT JOIN near g ON g.dir = f.dir
"""


ORACLE = oracle()
