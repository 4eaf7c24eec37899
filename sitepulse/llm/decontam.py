"""Benchmark decontamination with suffix arrays of the training text.

Each batch of documents is a shard.  Its suffix array holds, in the order of their first
``size`` words, the suffixes that can hold a window: those whose first words are, pair by
pair, adjacent somewhere in the benchmark.  Every window of every test suffix is
binary-searched in every shard; the longest verbatim matches, and where they stand, are made
up of places that follow each other along one item, as the array is sorted no deeper.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepulse.llm.common import LOWER_WORDS, written

#: The words that ``words_of`` gives, before they are lowered.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER_WORDS).split()


class TestSuffixes:
    """The benchmark's windows: ``size`` words, or a whole shorter item."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.size, self.ids = size, {}
        numbered = []
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            if words:
                numbered.append((item, words))
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for number, (_, words) in enumerate(numbered):
            n = min(size, len(words))
            for j in range(len(words) - n + 1):
                found.setdefault(tuple(words[j : j + n]), []).append((number, j))
        self.items = [item for item, _ in numbered]
        self.windows = sorted(found)
        self.places = [found[w] for w in self.windows]
        self.least = min(map(len, self.windows), default=size)
        pairs = {a * (len(self.ids) + 1) + b for _, words in numbered for a, b in zip(words, words[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for w in self.windows}):
            which = [k for k, w in enumerate(self.windows) if len(w) == n]
            self.queries[n] = np.array(which), np.array([self.windows[k] for k in which], ">u4").reshape(-1, n)


def keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word ids as byte strings, in the order of the ids."""
    rows = np.ascontiguousarray(rows, ">u4")
    return rows.view(f"S{4 * rows.shape[1]}").ravel()


def search(test: TestSuffixes, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, window) of every place of every window, in the order of the places."""
    lengths = np.array([len(d) for d in docs], np.int64)
    text = np.concatenate([*(np.append(d, 0) for d in docs), np.zeros(test.size, np.int64)]) if docs else np.zeros(test.size, np.int64)
    ends = np.cumsum(lengths + 1)
    good = text > 0
    if test.least > 1:
        linked = np.zeros(len(text), bool)
        both = np.flatnonzero(good[:-1] & good[1:])
        code = text[both] * (len(test.ids) + 1) + text[both + 1]
        at = np.minimum(np.searchsorted(test.pairs, code), len(test.pairs) - 1)
        linked[both[test.pairs[at] == code]] = True
        stop = np.flatnonzero(~linked)  # the first word from here on that isn't followed as in the benchmark
        run = stop[np.searchsorted(stop, np.arange(len(text)))] - np.arange(len(text)) + 1
        suffixes = np.flatnonzero(good & (run >= test.least))
    else:
        suffixes = np.flatnonzero(good)
    if not len(suffixes):
        return (np.zeros(0, np.int64),) * 3
    spread = text[suffixes[:, None] + np.arange(test.size)]
    spread[np.cumsum(spread == 0, axis=1) > 0] = 0  # a suffix ends with its document
    order = np.argsort(keys(spread), kind="stable")
    suffixes, array = suffixes[order], keys(spread[order])
    found, windows = [], []
    for n, (which, rows) in test.queries.items():
        low = np.zeros((len(rows), test.size), ">u4")
        low[:, :n] = rows
        high = np.full((len(rows), test.size), 0xFFFFFFFF, ">u4")
        high[:, :n] = rows
        first, last = np.searchsorted(array, keys(low), "left"), np.searchsorted(array, keys(high), "right")
        for k in np.flatnonzero(last > first):
            found.append(suffixes[first[k] : last[k]])
            windows.append(np.full(last[k] - first[k], which[k]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    place, window = np.concatenate(found), np.concatenate(windows)
    order = np.lexsort((window, place))
    place, window = place[order], window[order]
    doc = np.searchsorted(ends, place, "right")
    return doc, place - (ends[doc] - lengths[doc] - 1), window


def longest_match(test: TestSuffixes, words: list[int], windows: list[int]) -> tuple[int, int, str | None]:
    """(words, start, item) of the longest verbatim match through the given places of one document; of equals the first, then of the least item, without an id last."""
    best, before, at = None, {}, None
    for word, window in zip(words, windows):
        if word != at:
            before, now, at = (now if at is not None and word == at + 1 else {}), {}, word
        n = len(test.windows[window])
        for number, j in test.places[window]:
            run = max(before.get((number, j), 0) + 1, n)
            now[number, j + 1] = run
            item = test.items[number]
            rank = -run, word + n - run, item is None, item or ""
            if best is None or rank < best[0]:
                best = rank, (run, word + n - run, item)
    return best[1]


FOUND = "n_words long, covered array<struct<start:long,stop:long>>, items array<string>, longest_words long, longest_start long, longest_item string"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[int, object]:
    """(number of blocks, function that gives one's items): each has about ``block_bytes`` bytes."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))

    def block(k: int) -> list[tuple[str, str]]:
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        return [(r.i, r.t) for r in part.collect()]

    return blocks, block


def _search_block(items: list, size: int):
    """A function of text columns: what each text shares with the items."""

    @F.arrow_udf(T.StructType.fromDDL(FOUND))
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        test = TestSuffixes(items, size)
        get = test.ids.get
        kind = pa.struct([("n_words", pa.int64()), ("covered", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest_words", pa.int64()), ("longest_start", pa.int64()), ("longest_item", pa.string())])
        for batch in batches:
            docs = [np.array([get(w, 0) for w in words_of(t)], np.int64) for t in batch.to_pylist()]
            found = [{"n_words": len(d), "covered": [], "items": [], "longest_words": 0, "longest_start": None, "longest_item": None} for d in docs]
            doc, word, window = search(test, docs)
            for d, first, last in zip(*(x.tolist() for x in _runs(doc))):
                own, which = word[first:last].tolist(), window[first:last].tolist()
                spans = _union([(w, w + len(test.windows[k])) for w, k in zip(own, which)])
                n, start, item = longest_match(test, own, which)
                found[d] |= {
                    "covered": [{"start": a, "stop": b} for a, b in spans],
                    "items": sorted({test.items[i] for k in set(which) for i, _ in test.places[k] if test.items[i] is not None}),
                    "longest_words": n,
                    "longest_start": start,
                    "longest_item": item,
                }
            yield pa.array(found, kind)

    return find


def annotate(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20, carry=("*",)) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` (its columns ``carry``), with what it shares with the benchmark as struct ``found``.

    n_words; covered: runs of words inside windows; items: ids of the items with a window; the longest
    verbatim match of them: words, start, item.  A benchmark of over ``block_bytes`` bytes is
    searched in blocks, one after the other: what a block finds is written before the next is
    read, so that one is at the driver and on the workers at a time.
    """
    blocks, block = _blocks(benchmark, item_col, item_text_col, block_bytes)
    text = F.col(text_col).cast("string")
    if blocks == 1:
        return docs.select(F.struct(*carry).alias("row"), _search_block(block(0), size)(text).alias("found"))
    keys = [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]
    hits = None
    for k in range(blocks):
        found = written(docs.select(*keys, _search_block(block(k), size)(text).alias("f")).where("size(f.covered) > 0"), "block")
        hits = found if hits is None else hits.union(found)
    order = F.struct((-F.col("f.longest_words")).alias("n"), F.col("f.longest_start").alias("s"), F.col("f.longest_item").isNull().alias("none"), F.col("f.longest_item").alias("i"))
    one = hits.groupBy("k1", "k2").agg(F.collect_set("f.covered").alias("c"), F.collect_set("f.items").alias("i"), F.min(order).alias("l"))
    merged = F.struct(F.flatten("c").alias("covered"), F.array_sort(F.array_distinct(F.flatten("i"))).alias("items"), (-F.col("l.n")).alias("longest_words"), F.col("l.s").alias("longest_start"), F.col("l.i").alias("longest_item"))
    count = F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORDS))).cast("long")
    rows = docs.select(F.struct(*carry).alias("row"), *keys, count.alias("n")).join(one.select("k1", "k2", merged.alias("f")), ["k1", "k2"], "left")
    own = F.coalesce("f", F.from_json(F.lit('{"covered": [], "items": [], "longest_words": 0}'), FOUND.partition(", ")[2]))
    names = T.StructType.fromDDL(FOUND).names[1:]
    return rows.select("row", F.struct(F.col("n").alias("n_words"), *(own[c].alias(c) for c in names)).alias("found"))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first, last) of each run of equal values."""
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], first, np.append(first[1:], len(values))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit (words inside a window), n_items, items_sha256, contaminated, and the longest match.

    A window is ``size`` consecutive words of an item, or a whole shorter item that has words.
    Null and empty texts have no words, null and empty items no windows; items without an id
    count as hits but not as items.  Very long texts are searched whole.  Null ids and repeated
    rows are kept; an empty table gives no rows, an empty benchmark no hits; further columns,
    of any name, are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = annotate(own, benchmark, size, "text", item_col, item_text_col, block_bytes, ("doc_id",))
    step = lambda done, x: F.struct((done["n"] + F.greatest(x["stop"] - F.greatest(x["start"], done["to"]), F.lit(0))).cast("long").alias("n"), F.greatest(x["stop"], done["to"]).alias("to"))
    hit = F.aggregate(F.array_sort("found.covered"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("to")), step, lambda done: done["n"])
    items = F.col("found.items")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("found.covered") > 0).alias("contaminated"),
        F.col("found.longest_words").alias("longest_words"),
        F.col("found.longest_start").alias("longest_start"),
        F.col("found.longest_item").alias("longest_item"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no window of the benchmark.

    Null and empty texts hold none and stay, as do repeated rows without one; very long texts
    are searched whole; an empty table stays empty; columns may have any name.
    """
    found = annotate(docs, benchmark, size, text_col, item_col, item_text_col)
    return found.where(F.size("found.covered") == 0).select(*(F.col("row")[c].alias(c) for c in docs.columns))
