"""Changes of a table of Parquet files that happen as a whole or not at all.

A change writes its files aside, then names them, and the files it replaces, in a manifest that
becomes valid by a rename.  After that it is only carried out: files move into the table,
replaced ones go.  Whoever opens the table carries out what a driver that died has left, so
each change is seen once.  Changes made by a stream carry its name and the number of the batch
and aren't made again.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Calls to the file system at a time.
CALLS = 16


class Files:
    """The few calls to Hadoop's file systems that commits need; paths are relative to a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        place = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        self.base = self.fs.makeQualified(place).toUri().getPath().rstrip("/")

    def place(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.place(path))

    def children(self, path: str) -> list[str]:
        """Names of what lies in a folder; none if there's no such folder."""
        if not self.exists(path):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.place(path)))

    def below(self, path: str) -> list[str]:
        """All files under a folder, relative to it."""
        if not self.exists(path):
            return []
        found, listed, start = [], self.fs.listFiles(self.place(path), True), f"{self.base}/{path}/" if path else f"{self.base}/"
        while listed.hasNext():
            found.append(listed.next().getPath().toUri().getPath()[len(start) :])
        return found

    def move(self, source: str, target: str) -> None:
        """Move a file unless that's been done."""
        if self.exists(source):
            self.fs.mkdirs(self.place(target).getParent())
            if not self.fs.rename(self.place(source), self.place(target)) and self.exists(source):
                raise OSError(f"can't move {source} to {target}")

    def delete(self, path: str) -> bool:
        return self.fs.delete(self.place(path), True)

    def make(self, path: str) -> None:
        self.fs.mkdirs(self.place(path))

    def put(self, path: str, content: str | bytes) -> None:
        """A file that is there whole or not at all."""
        aside = f"{path}.writing"
        out = self.fs.create(self.place(aside), True)
        try:
            out.write(bytearray(content.encode() if isinstance(content, str) else content))
        finally:
            out.close()
        self.move(aside, path)

    def get(self, path: str) -> str:
        stream = self.fs.open(self.place(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def each(self, call, items) -> list:
        with ThreadPoolExecutor(CALLS) as pool:
            return list(pool.map(call, items))


class CommitLog:
    """Manifests under ``_log``, files of changes to come under ``_staging``, marks of streams under ``_marks``."""

    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)

    def begin(self) -> str:
        """A change's id; its files are written under ``staging``, laid out as in the table."""
        return uuid.uuid4().hex

    def staging(self, change: str) -> str:
        return f"{self.files.root}/_staging/{change}"

    def done(self, source: str | None, batch: int | None) -> bool:
        """Whether a stream's batch, or a later one, has been committed."""
        return source is not None and any(int(n) >= batch for n in self.files.children(f"_marks/{source}"))

    def commit(self, change: str, remove: list[str] = (), marks: list[tuple[str, int]] = ()) -> None:
        """Make a change valid, then carry it out.  remove: paths relative to the table."""
        self.files.put(f"_log/{change}.json", json.dumps({"remove": list(remove), "marks": list(marks)}))
        self.publish(change)

    def publish(self, change: str) -> None:
        """Carry out a valid change; doing so again from wherever it stopped gives the same."""
        said, aside = json.loads(self.files.get(f"_log/{change}.json")), f"_staging/{change}"
        moved = [f for f in self.files.below(aside) if "/" in f and "_temporary/" not in f]
        self.files.each(lambda f: self.files.move(f"{aside}/{f}", f), moved)
        self.files.each(self.files.delete, said["remove"])
        for source, batch in said["marks"]:
            self.files.make(f"_marks/{source}/{batch}")
            for n in self.files.children(f"_marks/{source}"):
                if int(n) < batch:
                    self.files.delete(f"_marks/{source}/{n}")
        self.files.delete(aside)
        self.files.delete(f"_log/{change}.json")

    def roll_forward(self) -> int:
        """Carry out what is valid and wasn't finished; how many changes that were."""
        left = [n.removesuffix(".json") for n in self.files.children("_log") if n.endswith(".json")]
        for change in left:
            self.publish(change)
        return len(left)

    def sweep(self) -> int:
        """Delete the files of changes that never became valid; no other change may be going on."""
        self.roll_forward()
        left = self.files.children("_staging")
        self.files.each(lambda n: self.files.delete(f"_staging/{n}"), left)
        return len(left)


class CommittedTable:
    """A table partitioned by some columns, written through a commit log."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: tuple[str, ...]):
        self.spark, self.path, self.schema, self.by = spark, path.rstrip("/"), schema, by
        self.log = CommitLog(spark, self.path)
        self.files = self.log.files

    def stage(self, rows: DataFrame, change: str) -> None:
        """Rows are dealt by partition, and a large one over several tasks, so that each gets few files."""
        dealt = rows.select(*self.schema.names).hint("rebalance", *self.by)
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy(*self.by).parquet(self.log.staging(change))

    def write(self, rows: DataFrame, source: str | None = None, batch: int | None = None, remove: list[str] = ()) -> bool:
        """Add rows as one change, which may take files' place; False if it's a stream's batch that has been written."""
        self.log.roll_forward()
        if self.log.done(source, batch):
            return False
        change = self.log.begin()
        self.stage(rows, change)
        self.log.commit(change, remove, [] if source is None else [(source, batch)])
        return True

    def read(self) -> DataFrame:
        """All rows; none if nothing was written."""
        self.log.roll_forward()
        if not any(n.startswith(f"{self.by[0]}=") for n in self.files.children("")):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("mergeSchema", "true").parquet(self.path)

    def _inside(self, uri: str) -> str:
        """A file's path relative to the table, from the URI that Spark gives."""
        return self.spark._jvm.java.net.URI(uri.replace(" ", "%20")).getPath().split(self.files.base + "/", 1)[1]

    def erase(self, match: Column) -> int:
        """Write the files that hold matching rows anew without them; how many rows went.

        Only files with such a row are read whole and replaced, in one change.
        """
        rows = self.read()
        hit = rows.where(match).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).collect()  # a row for each file
        if not hit:
            return 0
        held = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*(r.file for r in hit))
        self.write(held.where(~F.coalesce(match, F.lit(False))), remove=[self._inside(r.file) for r in hit])
        return sum(r.n for r in hit)
