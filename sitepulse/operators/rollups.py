"""Daily rollups by site and dimension, with sketches of visitors that unite over any range of days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepulse.operators.filters import in_range, is_pageview
from sitepulse.operators.metrics import DIMENSIONS, UNKNOWN
from sitepulse.schema import conform
from sitepulse.sources.commits import CommittedTable

#: Log2 of a sketch's registers, and three times the relative standard error that follows: what an estimate is off by at most, nearly always.
LOG_K, ERROR = 14, 3 * 1.04 / 2**7
DAILY = T.StructType(
    [
        T.StructField("site_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("dimension", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("n_events", T.LongType()),
        T.StructField("pageviews", T.LongType()),
        T.StructField("visitors", T.BinaryType()),
    ]
)


def table(spark: SparkSession, path: str) -> CommittedTable:
    """A stored rollup.  A day may have several rows for a value, one of each batch that wrote it; they add up."""
    return CommittedTable(spark, path, DAILY, ("site_id", "date"))


def daily(events: DataFrame) -> DataFrame:
    """Rows of the rollup of some events: each day's values of each dimension, and ``all`` for the site as a whole.

    Counts and sketches are aggregated in parts before the exchange, so what travels is a row
    for each value, whatever the events.
    """
    dims = [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(c), F.lit(UNKNOWN)).alias("value")) for d, c in DIMENSIONS.items()]
    whole = F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value"))
    each = conform(events).select("site_id", F.to_date("timestamp").alias("date"), "visitor_id", is_pageview().alias("pv"), F.explode(F.array(whole, *dims)).alias("x"))
    grouped = each.groupBy("site_id", "date", "x.dimension", "x.value")
    return grouped.agg(F.count("*").alias("n_events"), F.count_if("pv").alias("pageviews"), F.hll_sketch_agg("visitor_id", F.lit(LOG_K)).alias("visitors"))


def breakdown(rollup: DataFrame, site_id: str, start: str, end: str) -> DataFrame:
    """dimension, value, n_events, pageviews and about how many visitors, of whole days from start to before end; events aren't read."""
    days = in_range(rollup.withColumn("timestamp", F.col("date").cast("timestamp_ntz")), site_id, start, end)
    grouped = days.groupBy("dimension", "value").agg(F.sum("n_events").alias("n_events"), F.sum("pageviews").alias("pageviews"), F.hll_union_agg("visitors").alias("sketch"))
    return grouped.select("dimension", "value", "n_events", "pageviews", F.hll_sketch_estimate("sketch").alias("visitors"))


def compacted(rollup: DataFrame) -> DataFrame:
    """One row for each value of a day."""
    grouped = rollup.groupBy("site_id", "date", "dimension", "value")
    return grouped.agg(F.sum("n_events").alias("n_events"), F.sum("pageviews").alias("pageviews"), F.hll_union_agg("visitors").alias("visitors"))
