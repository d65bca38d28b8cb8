"""Warehouse access: SQL text, pandas and Arrow results, views, tables, Parquet import and export, published snapshots."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Warehouse:
    """The session's catalog. Statements take named or positional parameters and never string-built values."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def sql(self, query: str, parameters: Mapping | Sequence | None = None) -> DataFrame:
        return self.spark.sql(query, args=parameters) if parameters else self.spark.sql(query)

    def to_pandas(self, query: str, parameters: Mapping | Sequence | None = None) -> pd.DataFrame:
        """For results that are known to be small."""
        return self.sql(query, parameters).toPandas()

    def to_arrow(self, query: str, parameters: Mapping | Sequence | None = None) -> pa.Table:
        return self.sql(query, parameters).toArrow()

    def register(self, frame: pd.DataFrame | DataFrame, name: str) -> None:
        df = frame if isinstance(frame, DataFrame) else self.spark.createDataFrame(frame)
        df.createOrReplaceTempView(name)

    def create_table(self, df: DataFrame, name: str, overwrite: bool = False) -> None:
        df.write.mode("overwrite" if overwrite else "errorifexists").saveAsTable(name)

    def import_parquet(self, path: str, name: str, overwrite: bool = False) -> None:
        self.create_table(self.spark.read.parquet(path), name, overwrite)

    def export_parquet(self, query: str, path: str, compression: str = "zstd", partition_by: Sequence[str] = ()) -> None:
        self.sql(query).write.mode("overwrite").partitionBy(*partition_by).option("compression", compression).parquet(path)

    def tables(self) -> DataFrame:
        return self.spark.sql("SHOW TABLES").select("namespace", "tableName", "isTemporary")


def read_any(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """parquet, orc, csv (all columns as strings unless a schema is given) or json (lines)."""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind not in ("parquet", "orc", "json"):
        raise ValueError(f"unknown source kind: {kind}")
    return getattr(reader, kind)(path)


ALIASES = {"final sold": "tickets_sold", "gross": "ticket_gross_total", "venue name": "venue"}
#: Patterns of normal headers, exempt names first, then what is never taken, then what needs a look. Values are never read.
PII_EXEMPT = ("artist_name", "venue_name", "event_name", "configuration_name", "customer_event_id", "venue_external_id", "artist_external_id")
PII_PROHIBITED = (
    "email", "e_mail", "mail_address", "phone", "mobile", "cell", "credit_card", "card_number", "cc_num", "cvv", "cvc", "security_code", "expiry", "expiration",
    "ssn", "social_security", "date_of_birth", "dob", "transaction_id", "order_id", "payment_method", "last4", "bank", "billing_address", "shipping_address",
)
PII_POTENTIAL = ("first_name", "last_name", "full_name", "buyer", "customer", "street", "address", "zip", "postal", "^name$")


def normal_header(header: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(header), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def header_verdict(header: Column) -> Column:
    """SAFE, POTENTIAL_PII or PROHIBITED."""
    h = normal_header(header)
    return F.when(h.isin(*PII_EXEMPT), "SAFE").when(h.rlike("|".join(PII_PROHIBITED)), "PROHIBITED").when(h.rlike("|".join(PII_POTENTIAL)), "POTENTIAL_PII").otherwise("SAFE")


def classify_header(header: str) -> str:
    """The same for one name, on the driver."""
    h = re.sub("[^a-z0-9]+", "_", header.lower()).strip("_")
    if h in PII_EXEMPT:
        return "SAFE"
    return next((verdict for verdict, patterns in (("PROHIBITED", PII_PROHIBITED), ("POTENTIAL_PII", PII_POTENTIAL)) if any(re.search(p, h) for p in patterns)), "SAFE")


def import_partner(raw: DataFrame, canonical: Mapping[str, str]) -> DataFrame:
    """Rows of a partner file with canonical names and types: headers map by name or alias, columns with personal
    data are left out unread, values that don't parse become null. canonical: field to type."""
    found = {}
    for column in raw.columns:
        if classify_header(column) == "PROHIBITED":
            continue
        name = re.sub(r"[^a-z0-9]+", "_", ALIASES.get(column.strip().lower(), column).strip().lower()).strip("_")
        if name in canonical and name not in found:
            found[name] = column
    pick = lambda f, kind: F.col(f"`{found[f]}`").try_cast(kind) if f in found else F.lit(None).cast(kind)
    return raw.select(*(pick(f, kind).alias(f) for f, kind in canonical.items()))


def _fs(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((folder, *parts)))
    return path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _replace(spark: SparkSession, source, target) -> None:
    """Renames over target in one step: a reader finds the old file or the new one."""
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, options)


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Complete versions from the oldest: numbers in their order, then other names. Spark's _SUCCESS marker is written last."""
    fs, path = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path())] if fs.exists(path()) else []
    found = [n.removeprefix("version=") for n in names if n.startswith("version=") and fs.exists(path(n, "_SUCCESS"))]
    return sorted(found, key=lambda v: (0, int(v), v) if v.isdigit() else (1, 0, v))


def publish(df: DataFrame, folder: str, version: str, keep: int = 3, drop: Sequence[str] = ()) -> DataFrame:
    """Writes df without the columns of drop as a new immutable version, verifies it, points CURRENT to it and removes all but keep versions.

    Rows and schema are read back before the pointer moves, by a rename; a version that fails is removed and readers keep the one before.
    """
    spark, out = df.sparkSession, df.drop(*drop)
    fs, path = _fs(spark, folder)
    target = f"{folder}/version={version}"
    counter = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    out.observe(counter, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(target)
    back = spark.read.parquet(target)
    if back.count() != counter.get["n"] or back.columns != out.columns:
        fs.delete(path(f"version={version}"), True)
        raise ValueError(f"version {version} is not what was written")
    stream = fs.create(path("CURRENT.new"), True)
    stream.write(version.encode())
    stream.close()
    _replace(spark, path("CURRENT.new"), path("CURRENT"))
    for old in [v for v in versions(spark, folder) if v != version][: -(keep - 1) or None]:
        fs.delete(path(f"version={old}"), True)
    return back


def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    """The version that CURRENT names; the newest complete one of a folder that has no such file or names a version that is gone."""
    fs, path = _fs(spark, folder)
    found = versions(spark, folder)
    if not found:
        raise FileNotFoundError(f"no complete version in {folder}")
    name = next((r.value for r in spark.read.text(f"{folder}/CURRENT").collect()), "") if fs.exists(path("CURRENT")) else ""
    return spark.read.parquet(f"{folder}/version={name if name in found else found[-1]}")


def describe(df: DataFrame) -> DataFrame:
    """A row per column: name, type, whether it may be NULL, rows and known values."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *(F.count(F.col(f"`{c}`")).alias(f"_{k}") for k, c in enumerate(df.columns)))
    entries = F.array(*(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"), F.col("_rows").alias("rows"), F.col(f"_{k}").alias("known")) for k, f in enumerate(df.schema.fields)))
    return counts.select(F.explode(entries).alias("c")).select("c.*")
