"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepulse.session import shared_dir

#: White space between words, as in ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that a task's writer of such a table gathers in memory at most.
ROW_GROUP_BYTES = 32 << 20
#: Bytes of words for phrase search: lower-case letters, digits and all of UTF-8's higher bytes; others become spaces.
LOWER_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


_RUN: ContextVar[str] = ContextVar("run", default="")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sitepulse/{spark.sparkContext.applicationId}{_RUN.get()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts its lineage, and outlives executors."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``written``, outside of any ``scratch``."""
    before = _RUN.set("")
    try:
        return written(df, name)
    finally:
        _RUN.reset(before)


def drop_written(spark: SparkSession) -> None:
    """Delete what ``written`` has left in this application, or in the ``scratch`` around, once no result that reads it is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """What is ``written`` inside is deleted at the end."""
    before = _RUN.set(f"{_RUN.get()}/{uuid.uuid4().hex}")
    try:
        yield
    finally:
        drop_written(spark)
        _RUN.reset(before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; if it's so small that it has fewer partitions than there are cores, dealt out to all."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))
