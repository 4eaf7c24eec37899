"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows are numbered by id (then checksum and size), the numbers are permuted by a keyed
Feistel network with cycle walking, and position ``p`` goes to shard ``p % shards``,
slot ``p // shards``.  Where any row goes can be computed from its number alone, and
which row stands at a shard's slot from the inverse.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.common import written

ROUNDS = 8


class Permutation:
    """A keyed bijection of [0, n) and its inverse, on numpy arrays."""

    def __init__(self, n: int, seed: int):
        self.n = n
        self.half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = self._mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64((seed << 8) & 0xFFFFFFFFFFFFFFFF))

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _once(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        if inverse:
            for key in self.keys[::-1]:
                left, right = right ^ (self._mix(left + key) & self.mask), left
        else:
            for key in self.keys:
                left, right = right, left ^ (self._mix(right + key) & self.mask)
        return (left << self.half) | right

    def _walk(self, x, inverse: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), inverse)
        while (out := np.flatnonzero(x >= self.n)).size:
            x[out] = self._once(x[out], inverse)
        return x.astype(np.int64)

    def position(self, row) -> np.ndarray:
        return self._walk(row, False)

    def row(self, position) -> np.ndarray:
        return self._walk(position, True)


def shard(docs: DataFrame, shards: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards whose row counts differ by one at most.

    Returns id, size (UTF-8 bytes + 8), text_crc32, law 'rows', shard, slot (gapless from
    0), grown_shard (null under this law) and row_number.  The same rows and seed give the
    same shards under any partitioning.

    Null text counts as empty.  Null ids come first in the numbering.  Rows that agree in id,
    checksum and size are interchangeable; repeated rows each get a slot.  An empty table
    gives no rows, and further columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    keys = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("salt"),  # deals out equal rows; they are interchangeable
    )
    order = ["doc_id", "text_crc32", "size", "salt"]
    ordered = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(ordered.drop("salt").withColumn("at", F.monotonically_increasing_id()), "shard")
    part = F.shiftrightunsigned("at", 33)
    counts = {r.part: r.n for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    sizes = np.array([counts.get(k, 0) for k in range(max(counts, default=-1) + 1)], np.int64)
    before, total = np.cumsum(sizes) - sizes, int(sizes.sum())

    @F.pandas_udf("row_number long, position long")
    def place(at: pd.Series) -> pd.DataFrame:
        at = at.to_numpy(np.int64)
        row = before[at >> 33] + (at & ((1 << 33) - 1))
        return pd.DataFrame({"row_number": row, "position": Permutation(total, seed).position(row)})

    placed = numbered.withColumn("p", place("at"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("p.position") % shards).cast("int").alias("shard"),
        F.expr(f"p.position div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("p.row_number").alias("row_number"),
    )
