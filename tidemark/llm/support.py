"""Settings, shared-folder tables and text helpers of the operators here.

Every operator cuts its lineage with tables written under the session's
checkpoint folder (shared by the cluster), so a lost executor costs the tasks
it ran and nothing else. ``Scratch`` names those tables and removes the
intermediate ones when the operator is done.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: Rows per Arrow batch: texts may be long, and a Python worker holds one batch.
BATCH_ROWS = 1024

_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    # shuffle files go when the job that wrote them ends, not at a later garbage collection
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


@contextlib.contextmanager
def operator_conf(spark: SparkSession, **extra: str) -> Iterator[None]:
    """Run a block under the operators' settings, restoring the caller's."""
    wanted = _CONF | extra
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables of one operator run in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self._paths = spark, name, {}

    def table(self, df: DataFrame, label: str, keep: bool = False, few: bool = False, by: str | None = None) -> DataFrame:
        """Write ``df`` and return the written table; ``keep`` spares it from ``close``.

        ``few`` gathers rows that are light next to the shuffle they come from in
        an eighth as many files: small files cost more than their rows. ``by`` names
        a column with few values that later reads are limited by.
        """
        path = scratch_path(self.spark, f"{self.name}-{label}")
        with operator_conf(self.spark):
            if few:
                df = df.repartition(-(-shuffle_width(self.spark) // 8))
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if not keep:
            self._paths[id(out)] = (out, path)
        return out

    def drop(self, table: DataFrame) -> None:
        out = self._paths.pop(id(table), None)
        if out:
            _remove(self.spark, out[1])

    def close(self) -> None:
        for _, path in self._paths.values():
            _remove(self.spark, path)
        self._paths.clear()


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Scratch]:
    s = Scratch(spark, name)
    try:
        yield s
    finally:
        s.close()


def row_key(id_col: str, text_col: str) -> Column:
    """256-bit digest of id and text: never null, equal only for repeated rows."""
    return F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.lit("\x1f"),
                           F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
