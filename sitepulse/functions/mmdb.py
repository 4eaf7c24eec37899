"""Places from an address database in MaxMind's binary format, as the ranges that ``geo.locate`` takes.

The file is a binary search tree over the bits of addresses, whose leaves point at records.
Spark reads the file, so it may lie in any of its stores; the tree is walked in parallel, each
task below some prefixes of addresses.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepulse.functions.geo import V4

#: Fixed values of the format: what stands before the metadata, and bytes between tree and records.
MARKER, GAP = b"\xab\xcd\xefMaxMind.com", 16
#: A larger file isn't sent to the tasks.
MOST_BYTES = 1 << 30
#: Bits of a prefix: so many parts, of IPv4 and of IPv6, are walked independently.
PREFIX_BITS = 10
RANGES = "ip_start string, ip_end string, country_code string, region string, city string"


class Database:
    """The parts of a file: ``child`` steps down the tree, ``record`` reads what a leaf points at."""

    def __init__(self, data: bytes):
        at = data.rfind(MARKER)
        if at < 0:
            raise ValueError("not an address database")
        self.data, self.base = data, at + len(MARKER)
        about, _ = self._value(self.base)
        self.nodes, self.bits, self.version = about["node_count"], about["record_size"], about["ip_version"]
        if self.bits not in (24, 28, 32):
            raise ValueError(f"records of {self.bits} bits")
        self.base = self.nodes * self.bits // 4 + GAP
        self.place = lru_cache(100_000)(self._place)

    def child(self, node: int, bit: int) -> int:
        """A node below ``nodes``, that number for nothing, or a leaf above it."""
        size = self.bits // 4
        row = self.data[node * size : (node + 1) * size]
        if self.bits == 28:
            return (row[3] >> 4 << 24 | int.from_bytes(row[:3])) if not bit else ((row[3] & 15) << 24 | int.from_bytes(row[4:]))
        half = size // 2
        return int.from_bytes(row[half * bit : half * (bit + 1)])

    def _value(self, at: int):
        """(value, where the next one begins)"""
        data, control = self.data, self.data[at]
        kind, at = control >> 5, at + 1
        if kind == 1:
            size, low = control >> 3 & 3, control & 7
            tail = int.from_bytes(data[at : at + size + 1])
            target = tail if size == 3 else (low << 8 * (size + 1) | tail) + (0, 2048, 526336)[size]
            return self._value(self.base + target)[0], at + size + 1
        if kind == 0:
            kind, at = 7 + data[at], at + 1
        size = control & 31
        if size > 28:
            more = size - 28
            size, at = (29, 285, 65821)[more - 1] + int.from_bytes(data[at : at + more]), at + more
        if kind == 7:
            found = {}
            for _ in range(size):
                key, at = self._value(at)
                found[key], at = self._value(at)
            return found, at
        if kind == 11:
            items = []
            for _ in range(size):
                item, at = self._value(at)
                items.append(item)
            return items, at
        if kind == 14:
            return bool(size), at
        raw, at = data[at : at + size], at + size
        if kind == 2:
            return raw.decode(), at
        if kind in (3, 15):
            return struct.unpack(">d" if kind == 3 else ">f", raw)[0], at
        if kind == 8:
            return int.from_bytes(raw.rjust(4, b"\0"), signed=True), at
        return raw if kind == 4 else int.from_bytes(raw), at

    def _place(self, leaf: int) -> tuple[str | None, str | None, str | None]:
        """Country code, first subdivision's and city's English name of a leaf."""
        record, _ = self._value(self.base + leaf - self.nodes - GAP)
        part = lambda x, *names: part(x.get(names[0]), *names[1:]) if names and isinstance(x, dict) else None if names else x
        areas = part(record, "subdivisions")
        return part(record, "country", "iso_code"), part(areas[0], "names", "en") if areas else None, part(record, "city", "names", "en")

    def start(self, version: int) -> tuple[int, int]:
        """(node that addresses of 4 or 6 begin at, their bits); in a tree of IPv6 those of IPv4 are below 96 zeros."""
        if version == 6:
            return 0, 128
        node = 0
        for _ in range(96 if self.version == 6 else 0):
            if node >= self.nodes:
                break
            node = self.child(node, 0)
        return node, 32

    def ranges(self, version: int, prefix: int, bits: int):
        """(first, last, leaf) below a prefix, ascending; neighbours of one leaf are one range.

        In IPv6 what leads to the addresses of IPv4, such as ::ffff:0:0/96, is left out: those are
        looked up as IPv4.
        """
        node, width = self.start(version)
        skip = self.start(4)[0] if version == 6 else None
        for k in range(bits):
            if node >= self.nodes or node == skip:
                break
            node = self.child(node, prefix >> (bits - 1 - k) & 1)
        held, todo = None, [(node, prefix << (width - bits), width - bits)]
        while todo:
            node, first, rest = todo.pop()
            if node == self.nodes or node == skip:
                continue
            if node < self.nodes:
                todo.append((self.child(node, 1), first | 1 << (rest - 1), rest - 1))
                todo.append((self.child(node, 0), first, rest - 1))
                continue
            last = first + (1 << rest) - 1
            if held and held[2] == node and held[1] + 1 == first:
                held = held[0], last, node
            else:
                if held:
                    yield held
                held = first, last, node
        if held:
            yield held


def read_database(spark: SparkSession, path: str) -> DataFrame | None:
    """The ranges of the file at ``path``, IPv4 and IPv6, for ``geo.locate``; None if there's no such file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    file = spark.read.format("binaryFile").load(path)
    size = file.agg(F.max("length")).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"an address database of {size} bytes")
    content = bytes(file.select("content").first()[0])
    versions = [4, 6] if Database(content).version == 6 else [4]
    sent = spark.sparkContext.broadcast(content)  # of a checked size

    def walk(batches):
        database = Database(sent.value)
        for batch in batches:
            for version, prefix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for first, last, leaf in database.ranges(version, prefix, PREFIX_BITS):
                    keys = (f"{V4}{x:08x}" if version == 4 else f"{x:032x}" for x in (first, last))
                    rows.append((*keys, *database.place(leaf)))
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=[f.split()[0] for f in RANGES.split(", ")])

    parts = spark.range(0, len(versions) << PREFIX_BITS, 1, min(64, len(versions) << PREFIX_BITS))
    version = F.get(F.array(*map(F.lit, versions)), F.shiftright("id", PREFIX_BITS).cast("int"))
    return parts.select(version.alias("version"), (F.col("id") % (1 << PREFIX_BITS)).alias("prefix")).mapInArrow(walk, RANGES)
