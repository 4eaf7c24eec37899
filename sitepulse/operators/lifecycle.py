"""Retention, erasure and compaction of the partitioned table."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from sitepulse.params import MAX_DAYS, ParameterError, check_site_id
from sitepulse.sources.commits import CommittedTable
from sitepulse.sources.store import EventStore, HotTier


def expired(column, days: int, today: date):
    """Whether a date is older than ``days``; never for 0."""
    return F.lit(False) if days <= 0 else column < F.lit(today - timedelta(days))


def cleanup(store: EventStore, days: int, today: date | None = None) -> int:
    """Drop the partitions older than ``days``; how many they were.  0 days and a missing folder drop none."""
    return store.drop(store.older((today or date.today()) - timedelta(days))) if days > 0 else 0


def erase(store: EventStore, site_id: str, start: str, end: str, hot: HotTier | None = None, refused: CommittedTable | None = None) -> dict:
    """Take out one site's days from start to end, both included, wherever they are; what was erased.

    Stored partitions go whole, so other sites and days aren't read.  Pushed events that aren't
    flushed yet, those of unsafe sites among them, and refused requests, which have URLs, are
    written anew without them.  Streams that write the tables must be stopped meanwhile, and
    results kept elsewhere be forgotten.  Rows that are there afterwards are an error.
    """
    check_site_id(site_id)
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    if last < first or (last - first).days > MAX_DAYS:
        raise ParameterError(f"0 to {MAX_DAYS} days")
    own = lambda at: (F.col("site_id") == site_id) & F.to_date(at).between(F.lit(first), F.lit(last))
    stored = (F.col("site_id") == site_id) & F.col("date").between(F.lit(first), F.lit(last))
    before = store.read().where(stored).count()
    folder = store.site_folder(site_id)
    dropped = store.drop([f"{folder}/date={d}" for d in store.days(site_id) if start <= d <= end])
    from_hot = hot.erase(own("timestamp")) if hot else 0
    from_refused = refused.erase(own("received")) if refused else 0
    left = store.read().where(stored).count() if before else 0
    left += hot.read().where(own("timestamp")).count() if from_hot else 0
    left += refused.read().where(own("received")).count() if from_refused else 0
    if left:
        raise RuntimeError(f"{left} rows of {site_id} are still there")
    return {
        "status": "erased",
        "site_id": site_id,
        "start_date": start,
        "end_date": end,
        "records_deleted": before + from_hot,
        "hot_records_deleted": from_hot,
        "refused_deleted": from_refused,
        "partitions_deleted": dropped,
    }


def compact(store: EventStore, site_id: str, day: str, rows_per_file: int = 5_000_000) -> int:
    """Write one partition anew in as few files as its rows need, in one change; how many files those are."""
    part = store.read().where((F.col("site_id") == site_id) & (F.col("date") == F.lit(day).cast("date")))
    folder = f"{store.site_folder(site_id)}/date={day}"
    old = [f"{folder}/{name}" for name in store.files.below(folder)]
    files = max(1, -(-part.count() // rows_per_file))
    change = store.log.begin()
    part.repartition(files).write.mode("overwrite").option("compression", "zstd").partitionBy("site_id", "date").parquet(store.log.staging(change))
    store.log.commit(change, old)
    return files
