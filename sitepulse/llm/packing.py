"""Best-fit-decreasing packing of token sequences, exact over the whole corpus.

Pieces differ only in length, so best fit is decided on the histogram of lengths: for each
length, longest first, a segment tree over remaining capacities finds the tightest class of
open bins, and all bins of that class take as many pieces as best fit would put there.  The
plan has a few records for each length; a piece finds its bin by its rank among the pieces
of its length, so no bin, length or document is ever gathered in one place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepulse.llm.bpe import PieceEncoder
from sitepulse.llm.common import written


class CapacityTree:
    """Which remaining capacities have open bins; the smallest one of at least a given size in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.size)

    def mark(self, at: int, used: bool) -> None:
        at += self.size
        self.used[at] = used
        while at > 1:
            at //= 2
            self.used[at] = self.used[2 * at] or self.used[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        while not self.used[at]:
            while at % 2:  # a right child: go up until there's something to the right
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if self.used[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Records (length, first rank, first bin, pieces a bin, offset in the bin) in the order of (length, rank)."""
    tree, open_bins, bins = CapacityTree(capacity), {}, 0
    records = []

    def put(start: int, count: int, room: int) -> None:
        if room and count:
            open_bins.setdefault(room, []).append((start, count))
            tree.mark(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                start, count = bins, max(left // each, 1)
                bins += count
            else:
                each = room // length
                start, held = open_bins[room].pop()
                count = min(held, max(left // each, 1))
                if held > count:
                    open_bins[room].append((start + count, held - count))
                if not open_bins[room]:
                    tree.mark(room, False)
            each = min(each, left)
            records.append((length, rank, start, each, capacity - room))
            put(start, count, room - each * length)
            rank += count * each
            left -= count * each
    return np.array(sorted(records), np.int64).reshape(-1, 5)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and part and rank: how many pieces of this length its task had before."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)])
    for name, kind in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("rank", T.LongType())):
        schema.add(name, kind)

    def cut(batches):
        encoder = PieceEncoder.shared(tokenizer_path)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            owner, rows = [], []
            for k, (ids,) in enumerate(encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                begin = 0
                while begin < len(ids):
                    end = begin + first if not begin else begin + capacity
                    n = end - begin
                    rows.append((0 if not begin else rows[-1][0] + 1, begin, n, zlib.crc32(ids[begin:end].tobytes()), part, seen[n]))
                    seen[n] += 1
                    owner.append(k)
                    begin = end
            made = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64()))] + [pa.array(made[:, i].astype(t)) for i, t in enumerate((np.int32, np.int64, np.int64, np.int64, np.int32, np.int64))],
                names=schema.names,
            )

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the ids of all texts, each closed by ``end_id``, into sequences of ``capacity`` ids at most.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Documents of more than ``capacity`` ids are cut into pieces of ``capacity``; the first
    may be shorter.  Null text counts as empty: one piece of one id.  Very long texts are encoded
    whole before they are cut.  Null ids and repeated rows are packed like any other; an empty
    table gives no rows; further columns, of any name, are ignored.
    """
    pieces = written(pieces_of(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = best_fit_plan(histogram, capacity)
    keys = (plan[:, 0] << 48) + plan[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = plan[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
        nth = rank - at[:, 1]
        return pd.DataFrame({"sequence_id": at[:, 2] + nth // at[:, 3], "offset": at[:, 4] + nth % at[:, 3] * length})

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    placed = pieces.join(before, ["part", "length"]).withColumn("p", place("length", F.col("rank") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("p.sequence_id").alias("sequence_id"), F.col("p.offset").alias("offset"))


def pack_texts(packed: DataFrame) -> DataFrame:
    """A row for each sequence: sequence_id, used, and its pieces in order.  A sequence holds ``capacity`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), parts.alias("pieces"))
