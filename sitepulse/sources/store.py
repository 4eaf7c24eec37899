"""The cold tier: Parquet partitioned by site and date, through Spark's readers and Hadoop's file systems only."""

from __future__ import annotations

import time
import uuid
from datetime import date
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepulse.config import EngineConfig
from sitepulse.operators.filters import in_range
from sitepulse.schema import EVENT, conform
from sitepulse.sources.commits import CommittedTable

VERSION = 1


def is_safe_site_id(column):
    """A value that can name a folder: not empty, of 256 bytes at most, without '..', slashes and NUL."""
    return F.coalesce((F.octet_length(column).between(1, 256)) & ~column.rlike(r"\.\.|[/\\\x00]"), F.lit(False))


class EventStore(CommittedTable):
    """Events under ``path``/site_id=.../date=...; every change of it is whole or isn't there."""

    SCHEMA = T.StructType([*EVENT.fields, T.StructField("date", T.DateType())])

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, self.SCHEMA, ("site_id", "date"))

    def site_folder(self, site_id: str) -> str:
        """Spark escapes some characters of a value in the folder's name, such as a port's colon."""
        return "site_id=" + self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(site_id)

    def days(self, site_id: str) -> list[str]:
        """The stored days of one site; one listing."""
        return [unquote(n[5:]) for n in self.files.children(self.site_folder(site_id)) if n.startswith("date=")]

    def partition_paths(self) -> dict[tuple[str, str], str]:
        """The folder of each (site, day), relative to the store."""
        sites = [n for n in self.files.children("") if n.startswith("site_id=")]
        listed = self.files.each(self.files.children, sites)
        return {(unquote(s[8:]), unquote(d[5:])): f"{s}/{d}" for s, found in zip(sites, listed) for d in found if d.startswith("date=")}

    def partitions(self) -> list[tuple[str, str]]:
        return sorted(self.partition_paths())

    def older(self, limit: date) -> list[str]:
        """Folders of the partitions before a day.  Spark lists the table, in parallel if it's large, and no column is read."""
        found = self.read().where(F.col("date") < F.lit(limit)).select("site_id", F.col("date").cast("string").alias("date")).distinct().collect()
        return [f"{self.site_folder(r.site_id)}/date={r.date}" for r in found]

    def drop(self, folders: list[str]) -> int:
        """Remove partitions as one change; how many there were."""
        there = [f for f, ok in zip(folders, self.files.each(self.files.exists, folders)) if ok]
        if there:
            self.log.commit(self.log.begin(), there)
        return len(there)

    def drop_partition(self, site_id: str, day: str) -> int:
        """1 if there was such a partition, else 0."""
        return self.drop([f"{self.site_folder(site_id)}/date={day}"])

    def append(self, events: DataFrame, source: str | None = None, batch: int | None = None) -> DataFrame:
        """Write events into their partitions; the rows whose site can't name a folder aren't written but returned.

        A batch of a source, such as a stream, is written once however often it comes.
        """
        rows = conform(events).withColumn("date", F.to_date("timestamp"))
        safe = is_safe_site_id(F.col("site_id"))
        self.write(rows.where(safe), source, batch)
        return rows.where(~safe).drop("date")

    def scan(self, site_id: str, start: str, end: str) -> DataFrame:
        """One site's events in a half-open range; prunes the partitions of both."""
        return in_range(self.read(), site_id, start, end)

    def view(self, hot: DataFrame, name: str = "events_all") -> DataFrame:
        """Hot and stored events as one, also as a temporary view."""
        both = conform(hot).unionByName(conform(self.read()))
        both.createOrReplaceTempView(name)
        return both

    def create_table(self, name: str) -> None:
        """The table for SQL users, with its schema's version."""
        self.log.roll_forward()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.SCHEMA)
        version = self.schema_version() or VERSION
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (site_id, date) LOCATION '{self.path}' TBLPROPERTIES ('schema_version' = '{version}')")
        self.spark.sql(f"MSCK REPAIR TABLE {name}")

    def schema_version(self) -> int:
        """The version that the store was brought to last; 0 for none."""
        mark = "_schema_version-"
        return max((int(n[len(mark) :]) for n in self.files.children("") if n.startswith(mark)), default=0)

    def migrate(self, steps: dict[int, object] | None = None) -> list[int]:
        """Run the steps (version to function of the store) above the store's version, in order; their versions.

        Each is recorded once it has run, so a run that broke off goes on where it stopped.
        """
        done = []
        for version, step in sorted((MIGRATIONS if steps is None else steps).items()):
            if version > self.schema_version():
                step(self)
                self.files.make(f"_schema_version-{version}")
                done.append(version)
        return done


def _make_folder(store: EventStore) -> None:
    store.files.make("")


#: Version 1: the folder; files carry the schema themselves.
MIGRATIONS = {VERSION: _make_folder}


class HotTier:
    """Events that aren't in their partitions yet, in one folder of the store, until there are ``flush_event_count`` or the oldest is ``flush_interval_secs`` old.

    Each push is a folder of its own, which counts once it's whole.  A flush writes what there
    is into the partitions and gives it up as one change of the store, so events are stored
    once wherever a driver dies.  Events whose site can't name a folder stay here, apart.
    """

    HOT = "_hot"

    def __init__(self, store: EventStore, config: EngineConfig, clock=time.monotonic):
        self.store, self.config, self.clock = store, config, clock
        self.files = store.files
        store.log.roll_forward()
        self.since, self.pending = clock(), self._read(self._parts("true")).count()

    def batches(self) -> list[str]:
        """The whole pushes."""
        names = self.files.children(self.HOT)
        return [n for n, ok in zip(names, self.files.each(lambda n: self.files.exists(f"{self.HOT}/{n}/_SUCCESS"), names)) if ok]

    def _parts(self, safe: str) -> list[str]:
        found = [f"{self.HOT}/{n}/safe={safe}" for n in self.batches()]
        return [p for p, ok in zip(found, self.files.each(self.files.exists, found)) if ok]

    def _read(self, parts: list[str]) -> DataFrame:
        spark = self.store.spark
        return spark.read.schema(EVENT).parquet(*(f"{self.store.path}/{p}" for p in parts)) if parts else spark.createDataFrame([], EVENT)

    def read(self) -> DataFrame:
        self.store.log.roll_forward()
        return self._read(self._parts("true") + self._parts("false"))

    def _write(self, events: DataFrame, path: str) -> None:
        """Both parts in one pass, through a writer each: one writer at a time would have each task sort its rows first."""
        split = conform(events).withColumn("safe", is_safe_site_id(F.col("site_id")))
        conf, key = split.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
        before = conf.get(key)
        conf.set(key, "2")
        try:
            split.write.mode("overwrite").option("compression", "zstd").partitionBy("safe").parquet(path)
        finally:
            conf.set(key, before)

    def push(self, events: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """Take events in; how many were flushed.  A batch of a source is taken once."""
        name = uuid.uuid4().hex if source is None else f"{source}@{batch}"
        path = f"{self.HOT}/{name}"
        if source is None or not (self.store.log.done(source, batch) or self.files.exists(f"{path}/_SUCCESS")):
            self._write(events, f"{self.store.path}/{path}")
            if not self.pending:
                self.since = self.clock()
            part = f"{path}/safe=true"
            self.pending += self._read([part]).count() if self.files.exists(part) else 0
        due = self.pending >= self.config.flush_event_count or self.clock() - self.since >= self.config.flush_interval_secs
        return self.flush() if due and self.pending else 0

    @staticmethod
    def _marks(batches: list[str]) -> list[tuple[str, int]]:
        """What the store has to remember of pushes that it takes over."""
        last: dict[str, int] = {}
        for name in batches:
            source, at, batch = name.rpartition("@")
            if at:
                last[source] = max(last.get(source, -1), int(batch))
        return sorted(last.items())

    def flush(self) -> int:
        """Write all events into their partitions; how many they were."""
        store = self.store
        store.log.roll_forward()
        batches, parts = self.batches(), self._parts("true")
        if not parts:
            return 0
        unsafe = set(self._parts("false"))
        change = store.log.begin()
        store.stage(self._read(parts).withColumn("date", F.to_date("timestamp")), change)
        whole = [f"{self.HOT}/{n}" for n in batches if f"{self.HOT}/{n}/safe=false" not in unsafe]
        rest = [p for p in parts if p.rpartition("/")[0] not in whole]
        store.log.commit(change, whole + rest, self._marks(batches))
        flushed, self.pending = self.pending, 0
        return flushed

    def erase(self, match: Column) -> int:
        """Take out matching events; how many they were.

        The pushes that hold such events are written anew without them and swapped in one change.
        """
        store = self.store
        store.log.roll_forward()
        parts = {f"{store.path}/{p}": p for p in self._parts("true") + self._parts("false")}
        if not parts:
            return 0
        hit = self._read(list(parts.values())).where(match).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).collect()  # a row for each file
        if not hit:
            return 0
        batches = sorted({store._inside(r.file).split("/")[1] for r in hit})
        own = [p for p in parts.values() if p.split("/")[1] in batches]
        change = store.log.begin()
        self._write(self._read(own).where(~F.coalesce(match, F.lit(False))), f"{store.log.staging(change)}/{self.HOT}/{change}")
        store.log.commit(change, [f"{self.HOT}/{n}" for n in batches], self._marks(batches))
        self.pending = self._read(self._parts("true")).count()
        return sum(r.n for r in hit)

    def view(self, name: str = "events_all") -> DataFrame:
        """Hot and stored events as one, also as a temporary view."""
        return self.store.view(self.read(), name)
