"""SimHash near-duplicates by pivot distance tables.

A fingerprint's distances to a pool of reference fingerprints (pivots) are its coordinates;
two fingerprints that differ in ``k`` bits differ by ``k`` at most in every coordinate.  A
tree over these coordinates, fitted on a sample, deals the distinct fingerprints into leaves
so that every pair within ``k`` meets in one; inside a leaf pairs are discarded by their
greatest coordinate difference and the survivors are verified bit by bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepulse.llm.common import text_or_empty, written
from sitepulse.llm.components import connected_components

SEED = 42
#: Leaves aim at so many fingerprints; a leaf of more than CHUNK is compared in parts.
LEAF, CHUNK = 2000, 8192
#: The tree is fitted on a quarter of the fingerprints, or about so many of more, or one in SHARE of still more, but not over the second number.
SAMPLE, SHARE = (50_000, 1_000_000), 250


def fingerprint(text: str, size: int = 3) -> int:
    """64-bit SimHash of the text's word shingles: XXH64 with seed 42; a bit is set if over half the hashes have it."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return majority(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of some hashes: the bits that over half of them have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text) and fp (signed) of every row; null text counts as empty."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("h", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, size) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=schema.names)

    rows = docs.select(F.col(id_col), text_or_empty(text_col).cast("string").alias("t"))
    return rows.select(id_col, F.xxhash64("t").alias("h"), "t").mapInArrow(run, schema)


def distances(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The table of distances: a row for each fingerprint, a column for each pivot."""
    return np.stack([np.bitwise_count(fps ^ p) for p in pivots], axis=1)  # by pivot, so that no table is wider than 8 bits


@dataclass
class Node:
    """Distance up to ``cut`` goes left, over ``cut - k`` right, so those between go both ways; without a pivot it's leaf ``leaf``."""

    leaf: int = -1
    pivot: int = 0
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def fit_tree(sample: np.ndarray, total: int, bits: int, leaf: int = LEAF, pool: int = 96) -> tuple[np.ndarray, Node, int]:
    """(pivots, tree, number of leaves): at each node the pivot and cut that divide the sample with the least overlap."""
    rng = np.random.default_rng(SEED)
    pivots = rng.integers(0, 1 << 64, pool, np.uint64)
    if len(sample):
        pivots[: pool // 2] = sample[rng.integers(0, len(sample), pool // 2)]
    table = distances(sample, pivots)
    scale, leaves = total / max(len(sample), 1), 0

    def grow(rows: np.ndarray, depth: int) -> Node:
        nonlocal leaves
        n = len(rows)
        if n * scale > leaf and n >= 8 and depth < 60:
            own = table[rows]
            upto = np.cumsum([np.bincount(own[:, k], minlength=65) for k in range(pool)], axis=1)
            left = upto / n
            right = 1 - np.concatenate([np.zeros((pool, bits)), left], axis=1)[:, :65]
            with np.errstate(divide="ignore", invalid="ignore"):  # copies made, for each step towards smaller nodes
                gain = -(left * np.log(left) + right * np.log(right)) / (left + right)
                price = np.where(np.maximum(left, right) < 0.9, (np.log(left + right) + 0.01) / gain, np.inf)
            pivot, cut = np.unravel_index(np.argmin(price), price.shape)
            if price[pivot, cut] < np.inf:
                d = own[:, pivot]
                return Node(-1, int(pivot), int(cut), grow(rows[d <= cut], depth + 1), grow(rows[d > int(cut) - bits], depth + 1))
        leaves += 1
        return Node(leaves - 1)

    return pivots, grow(np.arange(len(sample)), 0), leaves


def route(tree: Node, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that a row of distances goes to."""
    rows, leaves, todo = [], [], [(tree, np.arange(len(table)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node.leaf >= 0:
            rows.append(own)
            leaves.append(np.full(len(own), node.leaf))
            continue
        d = table[own, node.pivot].astype(np.int64)
        todo += [(node.left, own[d <= node.cut]), (node.right, own[d > node.cut - bits])]
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64),) * 2


def forest(fps: np.ndarray, pivots: np.ndarray, bits: int, against: np.ndarray | None = None, pairs_found: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least fingerprint of its part) that join all pairs within ``bits``.

    With ``against``, only pairs of one fingerprint from each side.  pairs_found: the links are
    pairs within ``bits`` themselves, as few as join the same parts.
    """
    split = len(fps)
    all_fps = fps if against is None else np.concatenate([fps, against])
    label = np.arange(len(all_fps))
    table = distances(all_fps, pivots)
    second = np.arange(len(all_fps)) if against is None else np.arange(split, len(all_fps))
    second = second[np.argsort(table[second, 0], kind="stable")]
    first = np.arange(split)[np.argsort(table[:split, 0], kind="stable")]
    column = table[second, 0].astype(np.int64)
    tight, width = np.uint8(2 * bits), np.uint8(bits)
    joined: list[tuple[int, int]] = []
    for at in range(0, len(first), 256):
        own = first[at : at + 256]
        low = np.searchsorted(column, int(table[own[0], 0]) - bits, "left")
        high = np.searchsorted(column, int(table[own[-1], 0]) + bits, "right")
        other = second[low:high]
        near = np.ones((len(own), len(other)), bool)
        for k in range(min(5, table.shape[1])):
            near &= (table[own, k][:, None] - table[other, k][None, :] + width) <= tight  # wraps below zero
        i, j = np.nonzero(near)
        i, j = own[i], other[j]
        for k in range(5, table.shape[1]):
            keep = (table[i, k] - table[j, k] + width) <= tight
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(all_fps[i] ^ all_fps[j]) <= bits
        i, j = i[keep], j[keep]
        a, b = label[i], label[j]
        i, j, a, b = (x[a != b] for x in (i, j, a, b))
        pairs, at_pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_index=True)
        if pairs.shape[1]:
            parent = {}

            def root(x):
                while (up := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(up, up)
                return x

            for (a, b), x, y in zip(pairs.T.tolist(), i[at_pair].tolist(), j[at_pair].tolist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    joined.append((x, y))
            move = np.arange(len(label))
            move[list(parent)] = [root(x) for x in parent]
            label = move[label]
    signed = all_fps.view(np.int64)
    if pairs_found:
        ends = np.array(joined, np.int64).reshape(-1, 2)
        return signed[ends[:, 0]], signed[ends[:, 1]]
    least = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(least, label, signed)
    out = least[label]
    return signed[signed != out], out[signed != out]


def links(fps: DataFrame, bits: int = 2, leaf: int = LEAF, sample_rows: tuple[int, int] = SAMPLE, pivots_checked: int = 16, pairs_found: bool = False) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` whose components are those of all pairs within ``bits``; pairs_found: all links are such pairs."""
    total = fps.count()
    every = max(4, -(-total // min(max(sample_rows[0], total // SHARE), sample_rows[1])))
    sample = np.array([r.fp for r in fps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).collect()], np.int64).view(np.uint64)
    pivots, tree, leaves = fit_tree(np.sort(sample), total, bits, leaf)

    def deal(batches):
        for batch in batches:
            values = batch.column(0).to_numpy()
            row, to = route(tree, distances(values.view(np.uint64), pivots), bits)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(values[row])], names=["leaf", "fp"])

    dealt = written(fps.select("fp").mapInArrow(deal, "leaf long, fp long"), "leaves")
    large = {r.leaf: -(-r["count"] // CHUNK) for r in dealt.groupBy("leaf").count().where(F.col("count") > CHUNK).collect()}  # leaves are as many as the tree has

    @F.pandas_udf("array<string>")
    def cells(to: pd.Series, fp: pd.Series) -> pd.Series:
        """The cells of a leaf: one, or one for each pair of its parts."""
        out = []
        for leaf_id, value in zip(to.tolist(), fp.tolist()):
            parts = large.get(leaf_id, 1)
            mine = (value * 0x9E3779B97F4A7C15 >> 40) % parts
            out.append([f"{leaf_id}/{min(mine, k)}/{max(mine, k)}/{mine}" for k in range(parts)])
        return pd.Series(out)

    def compare(cell: pa.Table) -> pa.Table:
        values, side = np.unique(cell.column("fp").to_numpy()), None
        parts = cell.column("part").to_numpy()
        if parts.min() != parts.max():
            at = parts == parts.min()
            values, side = np.unique(cell.column("fp").to_numpy()[at]), np.unique(cell.column("fp").to_numpy()[~at])
        u, v = forest(values.view(np.uint64), pivots[-pivots_checked:], bits, None if side is None else side.view(np.uint64), pairs_found)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    named = dealt.select("fp", F.explode(cells("leaf", "fp")).alias("c")) if large else dealt.select("fp", F.concat("leaf", F.lit("/0/0/0")).alias("c"))
    sides = named.select("fp", F.substring_index("c", "/", 3).alias("cell"), F.substring_index("c", "/", -1).cast("int").alias("part"))
    return sides.groupBy("cell").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, bits: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and h (hash of the text) of every row.

    Rows whose fingerprints differ in ``bits`` bits or fewer are linked; component_id is the
    least id reachable.  Texts without words (null, empty) have fingerprint 0 and are linked
    like any other.  Null ids have no say in a component_id, which is null where a component
    has no other; repeated rows are kept; an empty table gives no rows; further columns are
    ignored.
    """
    rows = written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = written(links(fps, bits), "pairs")
    found = connected_components(linked).select(F.col("node").alias("fp"), "component")
    roots = fps.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(named, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "h")


def keep_one(docs: DataFrame, bits: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns as they are: of the least id, then the least hash of the text.

    A component without any id keeps its row of the least hash.  Null and empty texts are one
    component; of equal rows one stays; an empty table stays empty; columns may have any name.
    """
    found = written(near_duplicates(docs, bits, size, id_col, text_col), "components")
    alone = F.col("component_id").isNull()  # then told apart by fingerprint
    return rows_of(docs, found, [F.col("component_id"), F.when(alone, F.col("fingerprint")).alias("f")], id_col, text_col)


def rows_of(docs: DataFrame, found: DataFrame, group: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of ``docs`` that has the least doc_id, then the least h, of each ``group`` of ``found`` (doc_id, h, ...); its columns may have any name."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    groups = found.groupBy(*group).agg(F.min(order).alias("k"))
    kept = groups.select(F.col("k.doc_id").alias("kept_id"), F.col("k.h").alias("kept_h"))
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(text_or_empty(text_col).cast("string")).alias("own_h"))
    one = marked.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_h") == F.col("kept_h")), "left_semi")
    repeated = found.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h")), "left_semi").groupBy("doc_id", "h").count().where("count > 1")
    if not repeated.isEmpty():  # equal rows of one id: any of them
        one = one.dropDuplicates(["own_id", "own_h"])
    return one.select(*(F.col("row")[c].alias(c) for c in docs.columns))
