"""Streams: requests to stored events, live sessions and time series, and the rate limit."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sitepulse.config import EngineConfig
from sitepulse.functions.identity import KeySchedule
from sitepulse.functions.useragent import is_bot
from sitepulse.operators import ratelimit
from sitepulse.operators.behavior import GAP_SECONDS
from sitepulse.operators.ratelimit import IDLE_SECONDS, STATE, take
from sitepulse.operators.rollups import daily
from sitepulse.schema import REQUEST
from sitepulse.sources.commits import CommittedTable, Files
from sitepulse.sources.ingest import KEYS, REASONS, enrich, form_reason, parse
from sitepulse.sources.store import EventStore, HotTier, is_safe_site_id
from sitepulse.streaming.counters import note

#: What is kept of a refused request.
REFUSED = T.StructType(
    [T.StructField("received", T.TimestampNTZType()), *(T.StructField(c, T.StringType()) for c in ("site_id", "event_name", "url", "request_id", "reject_reason")), T.StructField("date", T.DateType())]
)


def json_source(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Requests of both kinds as they arrive in a folder of JSON files.

    Which files have been read is in a stream's checkpoint, so one that starts again goes on
    there and repeats the batch that it was in.
    """
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_trigger).json(path)


def refused_table(spark: SparkSession, path: str) -> CommittedTable:
    """Refused requests by reason and day."""
    return CommittedTable(spark, path, REFUSED, ("reject_reason", "date"))


class Buckets:
    """What each site's bucket (site, tokens, refilled, seen) is after the last two batches of a stream, a folder of its checkpoint for each.

    A batch that comes again finds what was before it.  forget: a bucket that no request came
    to for five minutes is full, and goes.
    """

    SCHEMA = "site string, tokens double, refilled double, seen double"

    def __init__(self, spark: SparkSession, checkpoint: str, forget: bool):
        self.spark, self.forget = spark, forget
        self.files = Files(spark, f"{checkpoint}/buckets")

    def _saved(self) -> list[int]:
        return sorted(int(n) for n in self.files.children("") if self.files.exists(f"{n}/_SUCCESS"))

    def before(self, number: int) -> DataFrame:
        last = max((n for n in self._saved() if n < number), default=None)
        if last is None:
            return self.spark.createDataFrame([], self.SCHEMA)
        found = self.spark.read.schema(self.SCHEMA).parquet(f"{self.files.root}/{last}")
        return found.where(F.col("seen") >= time.time() - IDLE_SECONDS) if self.forget else found

    def save(self, judged: DataFrame, before: DataFrame, number: int) -> None:
        new = judged.where("turn IS NOT NULL").groupBy(F.col("d").alias("site")).agg(F.max(F.struct("turn", "tokens", "refilled")).alias("b"))
        new = new.select("site", "b.tokens", "b.refilled", F.lit(time.time()).alias("seen"))
        before.join(new, "site", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{self.files.root}/{number}")
        for n in self._saved():
            if n < number - 1 and n != max(k for k in self._saved() if k < number):
                self.files.delete(str(n))


def judged(requests: DataFrame, config: EngineConfig, buckets: DataFrame | None = None) -> DataFrame:
    """Raw requests with ``reject_reason``: form first, then the site's rate, then bots, then sites that can't name a folder.

    Only a request of good form takes a token, and a bot's does.  No request is dropped for
    being late: one that's older than its site's last takes a token of that moment.  A site's
    requests are taken by time, then request id, in one task that sorts them as Spark does and
    holds one bucket.  The rate is for tables, such as a batch of a stream; buckets: where their
    sites' buckets stand, which rows that took their turn then have after them.
    """
    own, state = REQUEST.names, []
    parsed = parse(requests.select(*own)).withColumn("reject_reason", form_reason(config))
    if config.rate_limit_per_site:
        keyed = parsed.select(*own, "reject_reason", F.col("d").alias("site"))
        some = keyed.where("reject_reason IS NULL")
        taken = ratelimit.limit(some, config.rate_limit_per_site, "site", "received", "request_id", buckets)
        taken = taken.withColumn("reject_reason", F.when(~F.col("allowed"), "rate")).drop("allowed")
        state = ["tokens", "refilled", "turn"] if buckets is not None else []
        limited = taken.unionByName(keyed.where("reject_reason IS NOT NULL"), allowMissingColumns=True)
        parsed = parse(limited.select(*own, "reject_reason", *state))
    bot = F.when(is_bot(F.col("user_agent")), "bot") if config.filter_bots else F.lit(None)
    return parsed.withColumn("reject_reason", F.coalesce("reject_reason", bot, F.when(~is_safe_site_id(F.col("d")), "path"))).select(*own, *KEYS, "reject_reason", *state)


def _numbers() -> dict[str, list]:
    """What is counted of judged requests, by observation."""
    return {"ingested": [F.count_if(F.col("reject_reason").isNull()).alias("events")], "refused": [F.count_if(F.col("reject_reason") == r).alias(r) for r in (*REASONS, "path")]}


def _counts(rows: DataFrame) -> DataFrame:
    for name, metrics in _numbers().items():
        rows = rows.observe(name, *metrics)
    return rows


def _refused(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason IS NOT NULL").select("received", F.col("d").alias("site_id"), F.col("n").alias("event_name"), F.col("u").alias("url"), "request_id", "reject_reason", F.to_date("received").alias("date"))


def _each_batch(rows: DataFrame, checkpoint: str, config: EngineConfig, once: bool, write: Callable[[DataFrame, str, int], None]):
    """Start a stream whose batches ``write`` takes with the stream's name, which its checkpoint keeps, and their number."""
    spark, known = rows.sparkSession, []

    def take_in(batch: DataFrame, number: int) -> None:
        if not known:
            known.append("stream-" + re.search(r'"id"\s*:\s*"([^"]+)"', Files(spark, checkpoint).get("metadata"))[1])
        write(batch, known[0], number)

    writer = rows.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{config.flush_interval_secs} seconds")
    return writer.start()


def start(events: DataFrame, store: EventStore | HotTier, checkpoint: str, config: EngineConfig, once: bool = False):
    """Write finished events, each batch once, every ``flush_interval_secs``, or what there is and stop.

    Into a store they go at once, and those whose site can't name a folder aren't written; into
    a hot tier until it's full or old enough.
    """
    into = store.push if isinstance(store, HotTier) else store.append
    return _each_batch(events.observe("ingested", F.count("*").alias("events")), checkpoint, config, once, lambda batch, source, number: into(batch, source, number))


def start_all(requests: DataFrame, store: EventStore | HotTier, refused: CommittedTable, checkpoint: str, config: EngineConfig, salt: str | KeySchedule, ranges: DataFrame | None = None, once: bool = False):
    """Requests to events: each is stored once as an event or once as refused, with its reason.

    Each batch is judged once and held while both tables are written.  A rate limit is judged
    batch by batch, as only a batch can be sorted; its buckets and counts are kept beside.  With a schedule of keys a
    batch gets those of its requests' days, so ids change at midnight, whatever day the stream
    began, and the secret is in no plan.
    """
    into = store.push if isinstance(store, HotTier) else store.append

    limited = bool(config.rate_limit_per_site)

    def write(batch: DataFrame, source: str, number: int) -> None:
        if limited:
            buckets = Buckets(batch.sparkSession, checkpoint, not once)
            before = buckets.before(number)
            batch = judged(batch, config, before)
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            into(enrich(batch.where("reject_reason IS NULL"), config, salt, ranges), source, number)
            refused.write(_refused(batch), source, number)
            if limited:
                buckets.save(batch, before, number)
                note(source, number, {name: row.asDict() for name, row in batch.agg(*(F.struct(*m).alias(n) for n, m in _numbers().items())).first().asDict().items()})
        finally:
            batch.unpersist()

    return _each_batch(requests if limited else _counts(judged(requests, config)), checkpoint, config, once, write)


def start_rollup(events: DataFrame, table: CommittedTable, checkpoint: str, config: EngineConfig, once: bool = False):
    """Add each batch of finished events to a stored rollup, once."""
    return _each_batch(events, checkpoint, config, once, lambda batch, source, number: table.write(daily(batch.where(is_safe_site_id(F.col("site_id")))), source, number))


def stop(query, timeout: float | None = None) -> None:
    """Take in what has arrived, then stop."""
    query.processAllAvailable()
    query.stop()
    query.awaitTermination(timeout)


def live_sessions(events: DataFrame, late: str = "1 minute", gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Sessions of each visitor, by a session window; the same as in batches."""
    stamped = events.withColumn("at", F.col("timestamp").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("at", late)
    # the window ends the gap after its last event, and takes in an event at that very moment
    grouped = stamped.groupBy("site_id", "visitor_id", F.session_window("at", f"{gap_seconds} seconds").alias("w"))
    return grouped.agg(F.count("*").alias("n_events"), F.count_if(F.col("event_name") == "pageview").alias("pageviews"), F.max("at").alias("last")).select(
        "site_id", "visitor_id", F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("last").cast("timestamp_ntz").alias("ended"), "n_events", "pageviews"
    )


def live_timeseries(events: DataFrame, by: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """Events, pageviews and about how many visitors each site had in tumbling windows; ``live_visitors`` counts them exactly."""
    stamped = events.withColumn("at", F.col("timestamp").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("at", late)
    grouped = stamped.groupBy("site_id", F.window("at", by).alias("w"))
    return grouped.agg(F.count("*").alias("n_events"), F.count_if(F.col("event_name") == "pageview").alias("pageviews"), F.approx_count_distinct("visitor_id").alias("visitors")).select(
        "site_id", F.col("w.start").cast("timestamp_ntz").alias("bucket"), "n_events", "pageviews", "visitors"
    )


def live_visitors(events: DataFrame, by: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """Exact visitors, events and pageviews of each site in tumbling windows, as the batch series has them.

    Two stateful steps: counts of each (site, window, visitor), then of each (site, window).  A
    busy site's visitors are spread over all tasks by the first; the second adds up its parts.
    A window comes out once the watermark has passed it.
    """
    stamped = events.withColumn("at", F.col("timestamp").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("at", late)
    each = stamped.groupBy("site_id", "visitor_id", F.window("at", by).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_name") == "pageview").alias("p"))
    grouped = each.groupBy("site_id", F.window(F.window_time("w"), by).alias("w"))
    return grouped.agg(F.sum("n").alias("n_events"), F.sum("p").alias("pageviews"), F.count("*").alias("visitors")).select("site_id", F.col("w.start").cast("timestamp_ntz").alias("bucket"), "n_events", "pageviews", "visitors")


def deduplicated(events: DataFrame, keys: list[str], within: str = "1 hour") -> DataFrame:
    """Without repeats of ``keys`` inside the watermark."""
    return events.withColumn("at", F.col("timestamp").cast("timestamp")).withWatermark("at", within).dropDuplicatesWithinWatermark(keys).drop("at")


def rate_limited(requests: DataFrame, capacity: int, late: str = "1 minute") -> DataFrame:
    """site_id, event_id, timestamp and ``allowed`` of a stream; buckets idle for five minutes of event time are forgotten."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["timestamp", "event_id"])
        times = rows["timestamp"].to_numpy("datetime64[us]").astype("int64") / 1e6
        tokens, refilled = state.get if state.exists else (float(capacity), float(times[0]))
        allowed = []
        for now in times.tolist():
            tokens, ok = take(tokens, refilled, max(now, refilled), capacity) if capacity else (tokens, True)
            refilled = max(now, refilled)
            allowed.append(ok)
        state.update((tokens, refilled))
        state.setTimeoutTimestamp(max(int(refilled * 1000), state.getCurrentWatermarkMs()) + IDLE_SECONDS * 1000)
        yield rows.assign(site_id=key[0], allowed=allowed)[["site_id", "event_id", "timestamp", "allowed"]]

    stamped = requests.withColumn("at", F.col("timestamp").cast("timestamp")).withWatermark("at", late)
    grouped = stamped.select("site_id", "event_id", "timestamp", "at").groupBy("site_id")
    judged = grouped.applyInPandasWithState(run, "site_id string, event_id long, timestamp timestamp_ntz, allowed boolean", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return judged.observe("limited", F.count_if(~F.col("allowed")).alias("requests"))
