"""The analytical queries.  Each takes events (of any site and time) and gives a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitepulse.operators import behavior
from sitepulse.operators.filters import in_range, is_pageview

DIMENSIONS = {"pages": "pathname", "sources": "referrer_source", "countries": "country_code", "browsers": "browser", "os": "os", "devices": "device_type"}
UNKNOWN = "(unknown)"


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def unique_visitors(events: DataFrame, site_id: str, start: str, end: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("visitor_id") if approximate else F.countDistinct("visitor_id")
    return in_range(events, site_id, start, end).agg(count.alias("unique_visitors"))


def total_pageviews(events: DataFrame, site_id: str, start: str, end: str) -> DataFrame:
    return in_range(events, site_id, start, end).agg(F.count_if(is_pageview()).alias("total_pageviews"))


def pages_per_visit(events: DataFrame, site_id: str, start: str, end: str) -> DataFrame:
    """Pageviews for each visitor."""
    found = in_range(events, site_id, start, end).agg(F.countDistinct("visitor_id").alias("v"), F.count_if(is_pageview()).alias("p"))
    return found.select(_ratio(F.col("p"), F.col("v")).alias("pages_per_visit"))


def core_metrics(events: DataFrame, site_id: str, start: str, end: str, tie: str | None = None) -> DataFrame:
    """unique_visitors, total_pageviews, bounce_rate, avg_visit_duration_secs and pages_per_visit from one scan.

    Sessions, then visitors, are grouped on the exchange that the session windows made.
    """
    sessions = behavior.session_rows(in_range(events, site_id, start, end), tie=tie)
    visitors = sessions.groupBy("visitor_id").agg(F.count("*").alias("s"), F.sum("pageviews").alias("p"), F.count_if(F.col("pageviews") == 1).alias("b"), F.sum("seconds").alias("d"))
    total = visitors.agg(F.count("*").alias("v"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "spbd"))
    return total.select(
        F.col("v").alias("unique_visitors"),
        F.col("p").alias("total_pageviews"),
        _ratio(F.col("b"), F.col("s")).alias("bounce_rate"),
        _ratio(F.col("d"), F.col("s")).alias("avg_visit_duration_secs"),
        _ratio(F.col("p"), F.col("v")).alias("pages_per_visit"),
    )


def bounce_rate(events: DataFrame, site_id: str, start: str, end: str, tie: str | None = None) -> DataFrame:
    """Sessions of exactly one pageview among all sessions."""
    sessions = behavior.session_rows(in_range(events, site_id, start, end), tie=tie)
    return sessions.agg(_ratio(F.count_if(F.col("pageviews") == 1), F.count("*")).alias("bounce_rate"))


def session_metrics(events: DataFrame, site_id: str, start: str, end: str, tie: str | None = None) -> DataFrame:
    sessions = behavior.session_rows(in_range(events, site_id, start, end), tie=tie)
    return sessions.agg(
        F.count("*").alias("total_sessions"),
        F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_session_duration_secs"),
        F.coalesce(F.avg("pageviews"), F.lit(0.0)).alias("avg_pages_per_session"),
    )


def timeseries(events: DataFrame, site_id: str, start: str, end: str, by: str = "day") -> DataFrame:
    """bucket, visitors, pageviews of each hour or day with events, in order."""
    label = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH:00"}[by]
    bucket = F.date_format(F.date_trunc(by, "timestamp"), label)
    grouped = in_range(events, site_id, start, end).groupBy(bucket.alias("bucket"))
    return grouped.agg(F.countDistinct("visitor_id").alias("visitors"), F.count_if(is_pageview()).alias("pageviews")).orderBy("bucket")


def breakdown(events: DataFrame, dimension: str, site_id: str, start: str, end: str, limit: int = 10) -> DataFrame:
    """value, visitors, pageviews of the values with most visitors, equals by value."""
    value = F.coalesce(F.col(DIMENSIONS[dimension]), F.lit(UNKNOWN))
    grouped = in_range(events, site_id, start, end).groupBy(value.alias("value"))
    return grouped.agg(F.countDistinct("visitor_id").alias("visitors"), F.count_if(is_pageview()).alias("pageviews")).orderBy(F.desc("visitors"), "value").limit(limit)


def funnel(events: DataFrame, steps: list[Column], window_seconds: int, site_id: str, start: str, end: str, tie: str | None = None, by_range: bool = False) -> DataFrame:
    """Visitors by the deepest step they reached, 0 for those that never entered."""
    if not steps:
        return events.sparkSession.createDataFrame([], "step int, visitors long")
    depth = behavior.funnel_depth(in_range(events, site_id, start, end), steps, window_seconds, tie, by_range)
    return depth.groupBy("step").agg(F.count("*").alias("visitors")).orderBy("step")


def funnel_cumulative(events: DataFrame, steps: list[Column], window_seconds: int, site_id: str, start: str, end: str, tie: str | None = None) -> DataFrame:
    """Visitors that reached each step, from 1 on."""
    depth = behavior.funnel_depth(in_range(events, site_id, start, end), steps, window_seconds, tie)
    counts = depth.agg(*(F.count_if(F.col("step") >= k).alias(f"n{k}") for k in range(1, len(steps) + 1)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.col(f"n{k}").alias("visitors")) for k in range(1, len(steps) + 1)))).alias("x")).select("x.*")


def sequence_match(events: DataFrame, steps: list[Column], site_id: str, start: str, end: str, tie: str | None = None, by_range: bool = False) -> DataFrame:
    """converting_visitors, total_visitors and conversion_rate."""
    if len(steps) < 2:
        raise ValueError("a sequence has two steps at least")
    reached = behavior.sequence_reached(in_range(events, site_id, start, end), steps, tie, by_range)
    matched = F.count_if(F.col("step") == len(steps))
    return reached.agg(matched.alias("converting_visitors"), F.count("*").alias("total_visitors"), _ratio(matched, F.count("*")).alias("conversion_rate"))


def flow(events: DataFrame, page: str, site_id: str, start: str, end: str, limit: int = 10, tie: str | None = None) -> DataFrame:
    """The pages that most visitors went to after their first event on ``page``."""
    after = behavior.next_page(in_range(events, site_id, start, end), page, tie)
    return after.where("next_page IS NOT NULL").groupBy("next_page").agg(F.count("*").alias("visitors")).orderBy(F.desc("visitors"), "next_page").limit(limit)


def _cohorts(events: DataFrame, site_id: str, start: str, end: str, weeks: int) -> tuple[DataFrame, list[Column]]:
    found = behavior.visitor_weeks(events.where(F.col("site_id") == site_id), start, end)
    return found, [F.array_contains("weeks", F.date_add("first_week", 7 * i)) for i in range(weeks)]


def retention(events: DataFrame, site_id: str, start: str, end: str, weeks: int = 4) -> DataFrame:
    """cohort_week and, for each week after it, whether anyone of the cohort had events; all false if week 0 is outside the range."""
    if not weeks:
        return events.sparkSession.createDataFrame([], "cohort_week string, retained array<boolean>")
    found, active = _cohorts(events, site_id, start, end, weeks)
    any_of = [F.bool_or(a) for a in active]
    retained = F.array(any_of[0], *(any_of[0] & a for a in any_of[1:]))
    return found.groupBy(F.date_format("first_week", "yyyy-MM-dd").alias("cohort_week")).agg(retained.alias("retained")).orderBy("cohort_week")


def retention_counts(events: DataFrame, site_id: str, start: str, end: str, weeks: int = 4) -> DataFrame:
    """cohort_week, week (from 0), visitors of the cohort with events in it."""
    found, active = _cohorts(events, site_id, start, end, weeks)
    counts = found.groupBy(F.date_format("first_week", "yyyy-MM-dd").alias("cohort_week")).agg(F.array(*(F.count_if(a) for a in active)).alias("n"))
    return counts.select("cohort_week", F.posexplode("n").alias("week", "visitors")).orderBy("cohort_week", "week")


def export_daily(events: DataFrame, site_id: str, start: str, end: str) -> DataFrame:
    """date, visitors, pageviews of each day, with the range's top page and source: one scan, grouped three ways.

    A range without rows has none; a page or source is never missing where there are rows.
    """
    rows = in_range(events, site_id, start, end).select(
        F.date_format("timestamp", "yyyy-MM-dd").alias("date"),
        *(F.coalesce(F.col(DIMENSIONS[d]), F.lit(UNKNOWN)).alias(d) for d in ("pages", "sources")),
        "visitor_id",
        is_pageview().alias("pv"),
    )
    grouped = rows.groupingSets([["date"], ["pages"], ["sources"]], "date", "pages", "sources").agg(
        F.grouping_id().alias("by"), F.countDistinct("visitor_id").alias("visitors"), F.count_if("pv").alias("pageviews")
    )
    top = lambda by, value: F.min(F.when(F.col("by") == by, F.struct((-F.col("visitors")).alias("n"), F.col(value).alias("value"))))["value"]
    days = F.collect_list(F.when(F.col("by") == 0b011, F.struct("date", "visitors", "pageviews")))  # as many as the range has days
    one = grouped.agg(days.alias("days"), top(0b101, "pages").alias("top_page"), top(0b110, "sources").alias("top_source"))
    return one.select(F.explode("days").alias("d"), "top_page", "top_source").select("d.*", "top_page", "top_source").orderBy("date")


def partition_census(events: DataFrame) -> DataFrame:
    """Rows of each site and date, in order."""
    return events.groupBy("site_id", F.to_date("timestamp").alias("date")).agg(F.count("*").alias("n")).orderBy("site_id", "date")
