"""Tables in and out: Parquet, JSON lines and CSV pools, reports, and written intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_pool(spark: SparkSession, *paths: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    """All files of all paths, as one table by column name; JSON and CSV need a schema, nothing is inferred."""
    if form != "parquet" and schema is None:
        raise ValueError("a schema is needed")
    reader = spark.read.format(form)
    if schema:
        reader = reader.schema(schema)
    if form == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    out = None
    for p in paths:
        part = reader.load(p)
        out = part if out is None else out.unionByName(part)
    return out


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(pos, text, label): the documents that have labels; 1 is toxic."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    return table(spark, folder, "documents").select("doc_id", "text").join(labels, "doc_id").select(F.col("doc_id").alias("pos"), "text", "label")


def materialise(df: DataFrame) -> DataFrame:
    """df computed once and read back from the folder that executors share (spark.checkpoint.dir; a temporary one only where a local session has none)."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="bipole-")
    path = f"{base.rstrip('/')}/bipole-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
