"""Behaviour of visitors over time: sessions, funnels, sequences, next pages and retention.

Events of a visitor are read in the order of (timestamp, tie).  Funnels and sequences run
over window frames that end before the event, so a visitor's history is never gathered into
one value, and all their windows share one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitepulse.session import scratch_folder

GAP_SECONDS = 30 * 60


def _order(events: DataFrame, tie: str | None):
    return Window.partitionBy("visitor_id").orderBy("timestamp", *([tie] if tie else []))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def sessionize(events: DataFrame, gap_seconds: int = GAP_SECONDS, tie: str | None = None) -> DataFrame:
    """``events`` with ``session``: from 0 for each visitor; a new one begins after more than the gap."""
    order = _order(events, tie)
    micros = _micros(F.col("timestamp"))
    fresh = (micros - F.lag(micros).over(order) > gap_seconds * 1_000_000).cast("int")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("__new", F.coalesce(fresh, F.lit(0))).withColumn("session", F.sum("__new").over(running)).drop("__new")


def sessionize_by_range(events: DataFrame, gap_seconds: int = GAP_SECONDS, tie: str | None = None) -> DataFrame:
    """``sessionize`` for visitors of any size: events are dealt by ranges of (visitor, time), so one with a third of all is shared by tasks.

    Sessions are numbered inside each part of a visitor.  A part's first session goes on from
    the part before unless there's a gap in between; how many sessions came before it follows
    from the parts' ends alone, of which a visitor has as many as there are ranges.
    """
    spark = events.sparkSession
    keys = ["visitor_id", "timestamp", *([tie] if tie else [])]
    path = scratch_folder(spark, "ranges")
    events.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    order = Window.partitionBy("__part", "visitor_id").orderBy(*keys[1:])
    micros, most = _micros(F.col("timestamp")), gap_seconds * 1_000_000
    fresh = (micros - F.lag(micros).over(order) > most).cast("int")
    marked = rows.withColumn("__new", F.coalesce(fresh, F.lit(0)))
    ends = rows.groupBy("visitor_id", "__part").agg(F.min(micros).alias("first"), F.max(micros).alias("last"))
    ends = ends.withColumn("n", F.count("*").over(Window.partitionBy("visitor_id"))).where("n > 1")  # at most one visitor goes over each border
    inside = marked.join(F.broadcast(ends.select("visitor_id", "__part")), ["visitor_id", "__part"], "left_semi").groupBy("visitor_id", "__part").agg(F.sum("__new").alias("new"))
    parts = Window.partitionBy("visitor_id").orderBy("__part")
    carried = ends.join(inside, ["visitor_id", "__part"]).withColumn("gap", F.coalesce((F.col("first") - F.lag("last").over(parts) > most).cast("int"), F.lit(0)))
    before = F.coalesce(F.sum(F.col("new")).over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("gap").over(parts.rowsBetween(Window.unboundedPreceding, 0))
    carried = carried.select("visitor_id", "__part", before.alias("__before"))
    local = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = marked.withColumn("session", local).join(F.broadcast(carried), ["visitor_id", "__part"], "left")
    return numbered.select(*events.columns, (F.col("session") + F.coalesce("__before", F.lit(0))).alias("session"))


def session_rows(events: DataFrame, gap_seconds: int = GAP_SECONDS, tie: str | None = None, by_range: bool = False) -> DataFrame:
    """A row for each session: visitor_id, session, started, ended, n_events, pageviews, seconds.

    by_range: for visitors of very many events; see ``sessionize_by_range``.
    """
    pageview = F.col("event_name") == "pageview"
    found = sessionize_by_range(events, gap_seconds, tie) if by_range else sessionize(events, gap_seconds, tie)
    grouped = found.groupBy("visitor_id", "session")
    rows = grouped.agg(
        F.min("timestamp").alias("started"),
        F.max("timestamp").alias("ended"),
        F.count("*").alias("n_events"),
        F.count_if(pageview).alias("pageviews"),
    )
    return rows.withColumn("seconds", (_micros(F.col("ended")) - _micros(F.col("started"))) / 1e6)


def _matching(events: DataFrame, steps: list[Column], tie: str | None) -> DataFrame:
    """Events that match a step, as c1 to cN."""
    flags = [F.coalesce(step, F.lit(False)).alias(f"c{i}") for i, step in enumerate(steps, 1)]
    found = events.select("visitor_id", "timestamp", *([tie] if tie else []), *flags)
    some = F.lit(False)
    for i in range(1, len(steps) + 1):
        some = some | F.col(f"c{i}")
    return found.where(some)


def _with_all(events: DataFrame, depth: DataFrame, name: str) -> DataFrame:
    """A row for each visitor; 0 for those without a matching event."""
    visitors = events.select("visitor_id").distinct()
    return visitors.join(depth, "visitor_id", "left").select("visitor_id", F.coalesce(F.col(name), F.lit(0)).alias(name))


def _depth_by_range(rows: DataFrame, n: int, most: int, tie: str | None) -> DataFrame:
    """visitor_id and ``step`` of events with flags c1 to cn, for visitors of any size.

    Events are dealt by ranges of (visitor, time).  What a part of a visitor does is a map of the
    latest starts of chains that have reached each step: ``made`` are those of chains that begin
    in it, ``done`` when a chain at step j is at step k at the earliest.  A start is carried on if
    that's within the window.  Such maps compose, so a visitor's parts, of which there are as many as ranges at
    most, are folded in order; events don't meet in one task.
    """
    spark, keys = rows.sparkSession, ["visitor_id", "timestamp", *([tie] if tie else [])]
    path = scratch_folder(spark, "ranges")
    rows.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    before = Window.partitionBy("__part", "visitor_id").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    found = spark.read.parquet(path).withColumn("at", _micros(F.col("timestamp"))).withColumn("s1", F.when(F.col("c1"), F.col("at")))
    for k in range(2, n + 1):
        found = found.withColumn("m", F.max(f"s{k - 1}").over(before)).withColumn(f"s{k}", F.when(F.col(f"c{k}") & (F.col("at") - F.col("m") <= most), F.col("m")))
    ways = [(j, k) for j in range(1, n) for k in range(j + 1, n + 1)]
    for j, k in ways:
        reached = F.lit(True) if k == j + 1 else F.coalesce(F.max(f"f{j}_{k - 1}").over(before), F.lit(False))
        found = found.withColumn(f"f{j}_{k}", F.col(f"c{k}") & reached)
    made = F.array(*(F.max(f"s{k}") for k in range(1, n + 1))).alias("made")
    done = F.array(F.lit(None).cast("long"), *(F.min(F.when(F.col(f"f{j}_{k}"), F.col("at"))) for j, k in ways)).alias("done")
    parts = found.groupBy("visitor_id", "__part").agg(made, done)
    place = {way: i for i, way in enumerate(ways, 1)}

    def after(starts: Column, part: Column) -> Column:
        start = lambda k: F.get(starts, F.lit(k - 1))
        carried = lambda j, k: F.when(F.get(part["done"], F.lit(place[j, k])) - start(j) <= most, start(j))
        return F.array(*(F.greatest(start(k), F.get(part["made"], F.lit(k - 1)), *(carried(j, k) for j in range(1, k))) for k in range(1, n + 1)))

    ordered = F.array_sort(F.collect_list(F.struct("__part", "made", "done")))
    deepest = lambda starts: F.greatest(F.lit(0), *(F.when(F.get(starts, F.lit(k - 1)).isNotNull(), k) for k in range(1, n + 1)))
    nothing = F.array(*(F.lit(None).cast("long") for _ in range(n)))
    return parts.groupBy("visitor_id").agg(F.aggregate(ordered, nothing, after, deepest).alias("step"))


def funnel_depth(events: DataFrame, steps: list[Column], window_seconds: int, tie: str | None = None, by_range: bool = False) -> DataFrame:
    """visitor_id and ``step``: the most steps that different events took in order, the last within the window of the first.

    For each event, the latest start of a chain that reached step k before it decides
    whether it takes step k + 1.  by_range: for visitors of very many events; see ``_depth_by_range``.
    """
    if by_range:
        return _with_all(events, _depth_by_range(_matching(events, steps, tie), len(steps), window_seconds * 1_000_000, tie), "step")
    before = _order(events, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = _matching(events, steps, tie).withColumn("at", _micros(F.col("timestamp"))).withColumn("s1", F.when(F.col("c1"), F.col("at")))
    for k in range(2, len(steps) + 1):
        start = F.max(f"s{k - 1}").over(before)
        rows = rows.withColumn("m", start).withColumn(f"s{k}", F.when(F.col(f"c{k}") & (F.col("at") - F.col("m") <= window_seconds * 1_000_000), F.col("m")))
    reached = F.greatest(F.lit(0), *(F.when(F.col(f"s{k}").isNotNull(), k) for k in range(1, len(steps) + 1)))
    return _with_all(events, rows.groupBy("visitor_id").agg(F.max(reached).alias("step")), "step")


def sequence_reached(events: DataFrame, steps: list[Column], tie: str | None = None, by_range: bool = False) -> DataFrame:
    """visitor_id and ``step``: how many of the steps the visitor's events match as a subsequence from the first on.

    by_range: for visitors of very many events, as a funnel whose window never ends.
    """
    if by_range:
        return _with_all(events, _depth_by_range(_matching(events, steps, tie), len(steps), 1 << 62, tie), "step")
    before = _order(events, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = _matching(events, steps, tie).withColumn("r1", F.col("c1"))
    for k in range(2, len(steps) + 1):
        rows = rows.withColumn(f"r{k}", F.col(f"c{k}") & F.coalesce(F.max(f"r{k - 1}").over(before), F.lit(False)))
    reached = F.greatest(F.lit(0), *(F.when(F.col(f"r{k}"), k) for k in range(1, len(steps) + 1)))
    return _with_all(events, rows.groupBy("visitor_id").agg(F.max(reached).alias("step")), "step")


def next_page(events: DataFrame, page: str, tie: str | None = None) -> DataFrame:
    """visitor_id and the path of the event right after the visitor's first one on ``page``; null if that was the last."""
    order = _order(events, tie)
    follows = events.select("visitor_id", "timestamp", *([tie] if tie else []), "pathname", F.lead("pathname").over(order).alias("next_page"))
    key = F.struct("timestamp", *([tie] if tie else []))
    return follows.where(F.col("pathname") == page).groupBy("visitor_id").agg(F.min_by("next_page", key).alias("next_page"))


def visitor_weeks(site_events: DataFrame, start: str, end: str) -> DataFrame:
    """visitor_id, first_week (of all the site's events) and the weeks (Mondays) with events in the range; visitors with none aren't there."""
    inside = (F.col("timestamp") >= F.lit(start).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(end).cast("timestamp_ntz"))
    week = F.to_date(F.date_trunc("week", "timestamp"))
    grouped = site_events.groupBy("visitor_id").agg(F.to_date(F.date_trunc("week", F.min("timestamp"))).alias("first_week"), F.collect_set(F.when(inside, week)).alias("weeks"))
    return grouped.where(F.size("weeks") > 0)
