"""Near copies by the Jaccard similarity of their word shingles.

Candidates have SimHash fingerprints of their shingle sets within a few bits, found by pivot
tables, or share a band of their MinHash signatures, as at a similarity of 0.8 about 10 of 64
bits differ, more than pivots can divide by.  Each is verified by the similarity of its whole
shingle sets.  In a band's bucket texts are first held against a center, which unites a
large group of copies with as many comparisons as it has members, and for some rounds those
that are still apart against further centers.  What is apart after that isn't given up: texts of
small buckets are compared in all pairs, those of large ones joined by their rarest shingles.
Of two sets that are similar enough one of the rarest fifth of each is the same, and where it
stands bounds what they can share; so every pair that can be similar is verified, and a crowd
of texts that are alike, but not enough, is not compared in all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitepulse.llm.common import text_or_empty, written
from sitepulse.llm.components import connected_components
from sitepulse.llm.simhash import SEED, links, majority, rows_of

#: A pair of similarity 0.8 shares one of the bands, of so many hashes each, with a probability of 0.9998, of 0.5 with 0.64, of 0.2 with 0.03.
BANDS, BAND = 16, 4
#: Bits in which fingerprints of candidates differ at most; those of copies with one change in 100 shingles mostly do.
BITS = 2
#: Rounds of centers before the rest is joined exactly.  Buckets of up to so many texts that are apart are compared in all pairs.
ROUNDS, SMALL = 4, 12
#: Bits of the bitmap that keeps texts without a candidate at home: 1 MB.
BITMAP = 1 << 23


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Distinct XXH64 hashes of the text's word shingles, ascending; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts)))


class MinHash:
    def __init__(self, bands: int = BANDS, band: int = BAND):
        rng = np.random.default_rng(SEED)
        self.bands, self.band = bands, band
        self.times = rng.integers(0, 1 << 31, bands * band, np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 1 << 32, bands * band, np.uint32)
        self.mix = rng.integers(0, 1 << 63, (bands, band), np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each band of the signature of a set of hashes."""
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.times), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(short), 512):
            np.minimum(least, (short[at : at + 512, None] * self.times + self.plus).min(axis=0), out=least)
        code = (least.reshape(self.bands, self.band).astype(np.uint64) * self.mix).sum(axis=1, dtype=np.uint64)
        code = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(self.bands, dtype=np.uint64)
        return ((code ^ (code >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def pack_set(hashes: np.ndarray) -> bytes:
    """40 bits of each of some ascending hashes: the steps between them, byte by byte, compressed."""
    import zstandard

    steps = np.diff(hashes >> np.uint64(24), prepend=np.uint64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_set(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = text_or_empty(text_col).cast("string")
    return docs.select(F.xxhash64(text).alias("h"), text.alias("t"))


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits at ``hashes`` (h) modulo ``BITMAP``, as bytes: of one size, however many there are."""
    place = F.pmod("h", F.lit(BITMAP)) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()
    table = np.zeros((BITMAP // 32_768, 4096), np.uint8)
    for r in rows:
        table[r.b - 1] = np.frombuffer(r.m, np.uint8)
    return table.ravel()


def _sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(h, s): the packed shingle set of each of the ``wanted`` texts (h).

    A bitmap keeps most other texts from being worked on and exchanged; the join leaves out the rest.
    """
    wanted = written(wanted, "wanted")
    bits = _bitmap(wanted)

    def sets(batches):
        for batch in batches:
            at = batch.column(0).to_numpy() % BITMAP
            batch = batch.filter(pa.array((bits[at // 8] >> (at % 8).astype(np.uint8) & 1).astype(bool)))
            found = [pack_set(shingles(t, size)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["h", "s"])

    each = texts.mapInArrow(sets, "h long, s binary").join(wanted, "h", "left_semi")
    return written(each.groupBy("h").agg(F.first("s").alias("s")), "shingles")  # equal texts once


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of distinct ``pairs`` (u, v) of text hashes those whose shingle sets are similar enough."""

    def compare(batches):
        for batch in batches:
            keep, last, b = [], None, None
            for a, other in zip(batch.column(2), batch.column(3)):
                a, data = unpack_set(a.as_py()), other.as_py()
                if data != last:  # pairs of one center mostly follow each other
                    last, b = data, unpack_set(data)
                both = 0
                if min(len(a), len(b)) >= least * max(len(a), len(b)):
                    both = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(both >= least * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("h").alias("u"), F.col("s").alias("a")), "u")
    both = left.join(sets.select(F.col("h").alias("v"), F.col("s").alias("b")), "v").select("u", "v", "a", "b")
    return written(both.mapInArrow(compare, "u long, v long"), "similar")


def _close(signed: DataFrame, bits: int) -> DataFrame:
    """Candidates (u, v) by the fingerprints of ``signed`` (h, fp): what joins all texts whose fingerprints are within ``bits``, by pivot tables.

    The texts of one fingerprint are paired with the least of them, and those of the pairs of
    fingerprints that join all of these with each other.
    """
    first = written(signed.groupBy("fp").agg(F.min("h").alias("least")), "fingerprints")
    same = signed.join(first, "fp").where("h <> least").select(F.col("least").alias("u"), F.col("h").alias("v"))
    left, right = (first.select(F.col("fp").alias(c), F.col("least").alias(f"h{c}")) for c in "uv")
    near = links(first, bits, pairs_found=True).distinct().join(left, "u").join(right, "v")
    return written(same.union(near.select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v"))).distinct(), "close")


def _apart(members: DataFrame, turn: int) -> DataFrame:
    """Of ``members`` (h, key, root) each bucket with more than one root: key, k (its members), its center c and the center's root r.

    The first center is the group's, as the least of the texts' hashes; later ones are each bucket's own.
    """
    salt = F.xxhash64("h", F.lit(turn)) if not turn else F.xxhash64("h", "key", F.lit(turn))
    center = F.min(F.struct(salt.alias("x"), F.col("h").alias("c"), F.col("root").alias("r"))).alias("m")
    buckets = members.groupBy("key").agg(F.count("*").alias("k"), F.min("root").alias("a"), F.max("root").alias("b"), center)
    return buckets.where("a <> b").select("key", "k", "m.c", "m.r")


def _rarest(sets: DataFrame, least: float) -> DataFrame:
    """(h, n, token, at): the rarest shingles of each set, as many as a similar set must share one of, and their places from 1.

    Shingles are ordered by how many of the ``sets`` (h, s) have them.  Those that one set alone
    has count for the places and go.
    """

    def explode(batches):
        for batch in batches:
            own = [unpack_set(x.as_py()) for x in batch.column(1)]
            sizes = [len(x) for x in own]
            h = np.repeat(batch.column(0).to_numpy(), sizes)
            tokens = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(tokens)], names=["h", "n", "token"])

    each = sets.select("h", "s").mapInArrow(explode, "h long, n int, token long")
    counts = written(each.groupBy("token").agg(F.count("*").alias("k")), "rarities")
    ranked = each.join(counts, "token").withColumn("at", F.row_number().over(Window.partitionBy("h").orderBy("k", "token")))
    return written(ranked.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * least) + 1) & (F.col("k") > 1)).select("h", "n", "token", "at"), "rarest")


def _could_be_similar(sets: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (u, v) of different roots that share one of their rarest shingles, where sizes and places leave enough to share."""
    rows = _rarest(sets, least).join(roots, "h")
    left, right = (rows.select(F.col("token"), *(F.col(c).alias(f"{c}{k}") for c in ("h", "n", "at", "root"))) for k in (1, 2))
    sizes = (F.col("n1") >= least * F.col("n2")) & (F.col("n2") >= least * F.col("n1"))
    shared = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) + 1  # at most, if this is the first that they share; then nothing before counts
    enough = shared * (1 + least) + 1e-6 >= least * (F.col("n1") + F.col("n2"))
    pairs = left.join(right, "token").where((F.col("h1") < F.col("h2")) & (F.col("root1") != F.col("root2")) & sizes & enough)
    return pairs.select(F.col("h1").alias("u"), F.col("h2").alias("v")).distinct()


def _crowds(signed: DataFrame, roots: DataFrame | None, sets: DataFrame, tested: DataFrame, least: float) -> DataFrame | None:
    """The links that are left in buckets of more than ``SMALL`` texts, or None: all that there can be are verified."""
    own = signed.select("h", "keys") if roots is None else signed.select("h", "keys").join(roots, "h", "left")
    own = own.select("h", "keys", (F.coalesce("root", "h") if roots is not None else F.col("h")).alias("root"))
    members = own.select("h", "root", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("k"), F.min("root").alias("a"), F.max("root").alias("b")).where(f"a <> b and k > {SMALL}")
    crowd = written(members.join(buckets.select("key"), "key", "left_semi").select("h", "root").distinct(), "crowd")
    if crowd.isEmpty():
        return None
    pairs = _could_be_similar(sets.join(crowd.select("h"), "h", "left_semi"), crowd, least)
    found = _verified(written(pairs.join(tested, ["u", "v"], "left_anti"), "candidates"), sets, least)
    return None if found.isEmpty() else found


def near_copies(docs: DataFrame, least: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text) and root (the least h of its component) of every row.

    Texts whose sets of ``size``-word shingles have a Jaccard similarity of ``least`` or more are
    linked: candidates of SimHash fingerprints, and all of them that share a band, which a pair of 0.8 does with
    a probability of 0.9998.  Null text counts as empty; texts without words are copies of each other; very long
    texts are taken whole; null ids and repeated rows are kept; an empty table gives no rows;
    further columns, of any name, are ignored.
    """
    texts = _texts(docs, text_col)

    def sign(batches):
        minhash = MinHash()
        for batch in batches:
            keys, fps = [], []
            for t in batch.column(1).to_pylist():
                own = shingles(t, size)
                keys.append(minhash.keys(own))
                fps.append(majority(own))
            offsets = np.arange(len(keys) + 1, dtype=np.int32) * BANDS
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "keys", "fp"])

    signed = written(texts.mapInArrow(sign, "h long, keys array<long>, fp long"), "signatures")
    signed = written(signed.groupBy("h").agg(F.first("keys").alias("keys"), F.first("fp").alias("fp")).withColumn("root", F.col("h")), "distinct")
    close = _close(signed.select("h", "fp"), BITS)
    signed = signed.drop("fp")
    similar = tested = roots = sets = None
    for turn in range(ROUNDS):
        own = signed if roots is None else written(signed.drop("root").join(roots, "h", "left").select("h", "keys", F.coalesce("root", "h").alias("root")), "rooted")
        members = own.select("h", "root", F.explode("keys").alias("key"))
        apart = written(_apart(members, turn), "apart")
        if apart.isEmpty() and (turn or close.isEmpty()):
            break
        pairs = members.join(apart, "key").where("root <> r").select(F.least("h", "c").alias("u"), F.greatest("h", "c").alias("v"))
        if not turn:
            pairs = pairs.union(close)
        if turn == 1:  # what the first center has left of small buckets, once and for all
            crowd = members.join(apart.where(F.col("k") <= SMALL).select("key"), "key")
            other = crowd.select("key", F.col("h").alias("c"), F.col("root").alias("r"))
            pairs = pairs.union(crowd.join(other, "key").where("root <> r and h > c").select(F.least("h", "c").alias("u"), F.greatest("h", "c").alias("v")))
        pairs = written(pairs.distinct() if tested is None else pairs.distinct().join(tested, ["u", "v"], "left_anti"), "candidates")
        if sets is None:  # every text that has a candidate later has one now
            sets = _sets(texts, pairs.select(F.explode(F.array("u", "v")).alias("h")).distinct(), size)
            signed = written(signed.join(sets.select("h"), "h", "left_semi"), "alike")
        found = _verified(pairs, sets, least)
        tested = pairs if tested is None else tested.union(pairs)
        if not found.isEmpty():
            similar = found if similar is None else similar.union(found)
            roots = connected_components(similar).select(F.col("node").alias("h"), F.col("component").alias("root"))
        elif turn > 1:
            break
    if sets is not None:
        found = _crowds(signed, roots, sets, tested, least)
        if found is not None:
            similar = found if similar is None else similar.union(found)
            roots = connected_components(similar).select(F.col("node").alias("h"), F.col("component").alias("root"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col).cast("string")).alias("h"))
    return rows.withColumn("root", F.col("h")) if roots is None else rows.join(roots, "h", "left").select("doc_id", "h", F.coalesce("root", "h").alias("root"))


def keep_one(docs: DataFrame, least: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, all columns as they are: of the least id, then the least hash of the text."""
    found = written(near_copies(docs, least, size, id_col, text_col), "components")
    return rows_of(docs, found, [F.col("root")], id_col, text_col)
