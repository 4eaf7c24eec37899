"""Token ids in files: concatenated arrays with Elias-Fano encoded document boundaries.

A store is a folder of Parquet files whose rows are blocks: the ids of consecutive
documents as one little-endian array (16 bits an id where the vocabulary allows), and
where each document ends as an Elias-Fano code with sampled select, about
2 + log2(ids / documents) bits a document instead of 64.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepulse.llm.bpe import PieceEncoder
from sitepulse.llm.common import text_or_empty
from sitepulse.session import scratch_folder

SELECT_EVERY = 256
MASK = (1 << 64) - 1


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), ones[::SELECT_EVERY].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)], "<u4")
        return b"".join(x.tobytes() for x in (head, self.low, self.high, self.samples.astype("<u4")))

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b, c = np.frombuffer(data, "<u4", 5).tolist()
        at = 20
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", c, at + a + b))

    @property
    def n_bits(self) -> int:
        """Bits of the code and its samples."""
        return 8 * (len(self.low) + len(self.high)) + 32 * len(self.samples)

    def select(self, i) -> np.ndarray:
        """Values at the places ``i``: each from its sample on, over 64 high bits at a time until the word that has its one."""
        i = np.asarray(i, np.int64)
        words = np.append(np.frombuffer(self.high.tobytes() + bytes(-len(self.high) % 8), "<u8"), np.uint64(0))
        start = self.samples[i // SELECT_EVERY].astype(np.int64)
        at, left = start // 64, i % SELECT_EVERY
        word = words[at] & (np.uint64(MASK) << (start % 64).astype(np.uint64))
        while len(more := np.flatnonzero((ones := np.bitwise_count(word).astype(np.int64)) <= left)):
            left[more] -= ones[more]
            at[more] += 1
            word[more] = words[at[more]]
        bits = np.unpackbits(word.view(np.uint8).reshape(len(i), 8), axis=1, bitorder="little")
        place = np.argmax(np.cumsum(bits, axis=1, dtype=np.int16) > left[:, None], axis=1)
        return ((64 * at + place - i) << self.low_bits) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return ((self.low[bit // 8].astype(np.int64) >> bit % 8 & 1) << np.arange(self.low_bits)).sum(-1)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 2_000_000) -> None:
    """Write the ids of all texts, each closed by ``end_id``, in ascending id order.

    Null text counts as empty; very long texts are encoded whole, so a block may be larger than
    ``block_ids``.  Null ids come first; rows of one id are ordered by their text's hash;
    repeated rows are kept.  An empty table makes an empty store; further columns, of any
    name, are ignored.
    """
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(docs.schema[id_col].dataType))])
    for name, kind in (("part", T.IntegerType()), ("block", T.IntegerType()), ("first", T.LongType()), ("n_ids", T.LongType()), ("width", T.IntegerType()), ("ids", T.BinaryType()), ("ends", T.BinaryType())):
        schema.add(name, kind)

    def blocks(batches):
        encoder = PieceEncoder.shared(tokenizer_path)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        part, first, number = TaskContext.get().partitionId(), 0, 0
        keys, held, n = [], [], 0

        def block():
            flat = np.concatenate(held)
            ends = EliasFano.of(np.cumsum([len(x) for x in held]))
            row = [pa.array([keys], schema_type), *(pa.array([v], t) for v, t in ((part, pa.int32()), (number, pa.int32()), (first, pa.int64()), (len(flat), pa.int64()), (width, pa.int32()), (flat.tobytes(), pa.binary()), (ends.to_bytes(), pa.binary())))]
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        schema_type = None
        for batch in batches:
            schema_type = pa.list_(batch.schema.field(0).type)
            found = encoder.encode(batch.column(1).to_pylist())
            for key, (ids,) in zip(batch.column(0).to_pylist(), found):
                keys.append(key)
                held.append(np.append(ids, np.uint32(end_id)).astype(f"<u{width}"))
                n += len(held[-1])
                if n >= block_ids:
                    yield block()
                    number, first = number + 1, first + n
                    keys, held, n = [], [], 0
        if held:
            yield block()

    order = ["k", "h"]
    rows = docs.select(F.col(id_col).alias("k"), text_or_empty(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("k", "t")
    ordered.mapInArrow(blocks, schema).write.mode("overwrite").option("compression", "zstd").parquet(path)


def _before(store: DataFrame) -> np.ndarray:
    """Ids of all parts before each: the driver has a row for each task that wrote."""
    parts = {r.part: r.n for r in store.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    sizes = np.array([parts.get(k, 0) for k in range(max(parts, default=-1) + 1)], np.int64)
    return np.cumsum(sizes) - sizes


def _reader(before: np.ndarray, schema: T.StructType, what):
    """Tasks' side: the documents ``at`` of each block (all if null), their starts and ends by select; ``what`` makes the last column of (ids, starts, ends)."""

    def read(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                keys, part, first, width, data, code, at = (batch.column(k)[row] for k in range(7))
                ids = np.frombuffer(data.as_buffer(), f"<u{width.as_py()}")
                coded = EliasFano.from_bytes(code.as_py())
                own = np.array(at.as_py(), np.int64) if at.is_valid else np.arange(coded.n)
                ends, starts = coded.select(own), np.zeros(len(own), np.int64)
                later = np.flatnonzero(own > 0)
                starts[later] = coded.select(own[later] - 1)
                yield pa.RecordBatch.from_arrays([keys.values.take(pa.array(own)), pa.array(starts + first.as_py() + before[part.as_py()]), pa.array(ends - starts), what(ids, starts.tolist(), ends.tolist())], names=schema.names)

    return read


def _schema(store: DataFrame, last: T.StructField) -> T.StructType:
    kind = store.schema["doc_ids"].dataType.elementType
    return T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), last])


def read_ids(spark, path: str) -> DataFrame:
    """A row for each document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    store = spark.read.parquet(path)
    schema = _schema(store, T.StructField("ids_crc32", T.LongType()))
    sums = lambda ids, starts, ends: pa.array([zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(starts, ends)], pa.int64())
    return store.select("doc_ids", "part", "first", "width", "ids", "ends", F.lit(None).cast("array<int>").alias("at")).mapInArrow(_reader(_before(store), schema, sums), schema)


def ids_of(spark, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens and ids of the ``wanted`` documents: only their blocks are read, only their ids taken out."""
    store = spark.read.parquet(path)
    schema = _schema(store, T.StructField("ids", T.ArrayType(T.LongType())))
    places = store.select("part", "block", F.posexplode("doc_ids").alias("i", "k"))
    at = places.join(wanted.select(F.col(id_col).alias("k")).distinct(), "k", "left_semi").groupBy("part", "block").agg(F.sort_array(F.collect_list("i")).alias("at"))
    lists = lambda ids, starts, ends: pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64()))
    return store.join(at, ["part", "block"]).select("doc_ids", "part", "first", "width", "ids", "ends", "at").mapInArrow(_reader(_before(store), schema, lists), schema)


def new_store(spark, name: str) -> str:
    """A new folder among those of this application, which are deleted together."""
    return scratch_folder(spark, name)
