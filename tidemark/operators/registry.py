"""Append-only model version registry and aliases (parquet tables).

Versions and alias moves are appended, never updated, so concurrent writers
cannot lose each other's rows and history stays queryable; the current
champion is the version of the latest ``champion`` alias event.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION_SCHEMA = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("reason", T.StringType()),
    T.StructField("step", T.LongType()), T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("source", T.StringType()), T.StructField("created_at", T.TimestampType())])
ALIAS_SCHEMA = T.StructType([
    T.StructField("alias", T.StringType()), T.StructField("version", T.LongType()),
    T.StructField("set_at", T.TimestampType())])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not _exists(spark, path):  # nothing written yet; any other failure is the caller's to see
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _claim(spark: SparkSession, root: str, version: int) -> bool:
    """Reserve a version number: creating its marker fails if another writer has it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/claims/v{version}")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(p))


def versions(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/versions", VERSION_SCHEMA)


def register(spark: SparkSession, root: str, reason: str, step: int, metrics: dict[str, float],
             source: str = "") -> int:
    """Append a new version (the next number that no other writer holds) and return it."""
    cur = versions(spark, root).agg(F.max("version")).first()[0]
    v = int(cur or 0) + 1
    while not _claim(spark, root, v):
        v += 1
    row = [(v, reason, int(step), {k: float(x) for k, x in metrics.items()}, source, datetime.now(timezone.utc))]
    spark.createDataFrame(row, VERSION_SCHEMA).write.mode("append").parquet(f"{root}/versions")
    return v


def set_alias(spark: SparkSession, root: str, version: int, alias: str = "champion") -> None:
    row = [(alias, int(version), datetime.now(timezone.utc))]
    spark.createDataFrame(row, ALIAS_SCHEMA).write.mode("append").parquet(f"{root}/aliases")


def champion(spark: SparkSession, root: str, alias: str = "champion") -> DataFrame:
    """The version row the alias points to now (empty if never set)."""
    a = _read(spark, f"{root}/aliases", ALIAS_SCHEMA).where(F.col("alias") == alias)
    cur = a.agg(F.max_by("version", F.struct("set_at", "version")).alias("version"))
    return versions(spark, root).join(cur, "version")
