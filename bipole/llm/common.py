"""Scratch tables, size checks and small helpers that the operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this run inside the shared folder that the session names in spark.checkpoint.dir. Only a local master without that
    setting falls back to a temporary folder of this machine. It is removed when the Python process ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="bipole-")
        _roots[app] = f"{base.rstrip('/')}/bipole-{uuid.uuid4().hex[:12]}"
        atexit.register(drop, spark, _roots[app])
    return _roots[app]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table; a stopped session leaves it."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001 - the session is gone
        return


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors, and are computed once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex[:12]}"
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((back, path))
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for table, path in [p for p in self.paths if any(p[0] is t for t in tables)]:
            drop(self.spark, path)
            self.paths = [p for p in self.paths if p[1] != path]


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow of a function of one batch; a batch gives any number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(run, schema)


def fits(df: DataFrame, limit: int, *size: str) -> bool:
    """Whether the summed bytes of the named text columns of df, plus 16 a row, stay within limit: the check before data goes to every task."""
    parts = [F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c in size]
    total = F.lit(16)
    for p in parts:
        total = total + p
    return (df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("b")).first()["b"] or 0) <= limit


def as_bigint(c: str) -> F.Column:
    return F.col(c).cast("bigint").alias(c)
