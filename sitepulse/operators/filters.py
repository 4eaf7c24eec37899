"""Filters that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_range(events: DataFrame, site_id: str, start: str, end: str) -> DataFrame:
    """One site's events with start <= timestamp < end.

    A table partitioned by ``date`` gets the dates as well, as a range of timestamps alone prunes no partition.
    """
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    found = events.where((F.col("site_id") == site_id) & (F.col("timestamp") >= first) & (F.col("timestamp") < last))
    if "date" in events.columns:
        found = found.where((F.col("date") >= F.to_date(first)) & (F.col("date") <= F.to_date(last - F.expr("INTERVAL '0.000001' SECOND"))))
    return found


def is_pageview():
    return F.col("event_name") == "pageview"
