"""Results as CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepulse.functions.text import csv_field


def csv_lines(df: DataFrame) -> DataFrame:
    """``line``: each row's text columns quoted and guarded, others as they are, joined by commas."""
    fields = [csv_field(F.col(c)) if t == "string" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c, t in df.dtypes]
    return df.select(F.concat_ws(",", *fields).alias("line"))


def csv_header(df: DataFrame) -> str:
    return ",".join(df.columns)


def write_csv(df: DataFrame, path: str) -> None:
    """One file for each task, each with the header's row."""
    lines = csv_lines(df)
    lines.select(F.col("line").alias(csv_header(df))).write.mode("overwrite").option("header", True).option("quote", "").option("emptyValue", "").csv(path, sep="\x01")


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
