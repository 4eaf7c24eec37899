"""Removal of long repeated strings with distributed suffix sorting.

Any string of ``least`` bytes has one anchor: the least of its ``gram``-byte hashes, the same
wherever the string stands.  So a repeat shows as two anchors with equal text around, and
only the suffixes at anchors whose gram occurs twice need sorting, each with the text before
it, backwards, behind.  Tasks sort these suffixes into front-coded runs, exchange them by
gram, and merge runs with a loser tree that compares from the known common prefix on.  The
common prefixes that the merge yields are the suffix array's LCPs; from them, and from the
text before, follows how far each repeat reaches to either side.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.common import text_or_empty, written

LEAST = 400
#: A repeated passage: so many bytes at least, and so many words (fewer words if it has LEAST bytes).
PASSAGE_BYTES, PASSAGE_WORDS = 250, 50
#: Suffixes for which one bucket of the exchange is laid out, and bytes that a task sorts into a run.
BUCKET, RUN_BYTES = 30_000, 24 << 20
#: A gram of more places is hot: its suffixes don't go to one bucket, whose task would hold so many times 750 bytes; their windows are counted.
HOT = 100_000
#: Groups of more suffixes are resolved by classes at each offset, not in pairs.
PAIRS = 96
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def gram_size(least: int) -> int:
    return max(1, min(100, least // 5))


class Anchors:
    """Anchors of texts: places of the least gram hash in any so many bytes, for each of some lengths, ascending.

    An anchor of a greater length is one of the lesser ones too.
    """

    def __init__(self, lengths: list[int], chunk: int = 1 << 18):
        self.lengths, self.gram = lengths, gram_size(lengths[0])
        self.chunk = chunk
        rng = np.random.default_rng(7)
        self.values = rng.integers(1, 1 << 63, 256, np.uint64)
        self.powers, self.inverse = self._powers(BASE), self._powers(pow(BASE, -1, 1 << 64))

    def _powers(self, base: int, n: int | None = None) -> np.ndarray:
        n = n or 2 * self.chunk
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, hashes, levels) of each text; level: the number of the greatest length whose anchor it is."""
        out, batch, size = [], [], 0
        for text in texts:
            if batch and size + len(text) > self.chunk:
                out += self._batch(batch)
                batch, size = [], 0
            batch.append(text)
            size += len(text)
        return out + (self._batch(batch) if batch else [])

    def _batch(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        sizes = np.array([len(t) for t in texts], np.int64)
        stops = np.cumsum(sizes)
        n, gram = int(stops[-1]), self.gram
        if n < self.lengths[0]:
            return [(np.zeros(0, np.int64),) * 3] * len(texts)
        if n + 1 > len(self.powers):
            self.powers, self.inverse = self._powers(BASE, 2 * n), self._powers(pow(BASE, -1, 1 << 64), 2 * n)
        text = np.frombuffer(b"".join(texts), np.uint8)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[text] * self.powers[:n], out=sums[1:])
        code = (sums[gram:] - sums[:-gram]) * self.inverse[: n + 1 - gram]
        code ^= code >> np.uint64(32)
        code *= np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(32)
        at = self._least(code, self.lengths[0], stops, n)
        level = np.zeros(len(at), np.int64)
        for number, least in enumerate(self.lengths[1:], 1):
            level[np.searchsorted(at, self._least(code, least, stops, n))] = number
        owner = np.searchsorted(stops, at, "right")
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        codes = code[at].view(np.int64)
        begin = stops - sizes
        return [(at[a:b] - begin[k], codes[a:b], level[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]

    def _least(self, code: np.ndarray, least: int, stops: np.ndarray, n: int) -> np.ndarray:
        """Places of the least codes in all windows of ``least`` bytes within one text, ascending."""
        width, places = least - self.gram + 1, len(code)  # of the grams that start in a window
        windows = places - width + 1
        if windows < 1:
            return np.zeros(0, np.int64)
        shift = np.uint64(max(24, n.bit_length()))
        blocks = -(-places // width) + 1
        key = np.full(blocks * width, MASK, np.uint64)
        key[:places] = (code >> shift << shift) | np.arange(places, dtype=np.uint64)
        grid = key.reshape(blocks, width)
        upto = np.minimum.accumulate(grid, axis=1).ravel()
        onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        found = np.minimum(onward[:windows], upto[width - 1 : width - 1 + windows]) & np.uint64((1 << int(shift)) - 1)
        inside = np.ones(windows, bool)  # a window within one text
        for stop in stops[:-1].tolist():
            inside[max(0, stop - least + 1) : min(stop, windows)] = False
        at = found[inside].astype(np.int64)
        return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix, of which ``known`` bytes aren't looked at again."""
    n = min(len(a), len(b))
    step = 32
    while known < n:
        to = min(known + step, n)
        x, y = a[known:to], b[known:to]
        if x != y:
            return to - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8
        known, step = to, 4 * step
    return n


class Run:
    """A front-coded sorted run: for each string the prefix it shares with the one before, and the rest."""

    FIELDS = (("shared", "<u2"), ("rest", "<u2"), ("right", "<u2"), ("twice", "u1"), ("k1", "<i8"), ("k2", "<i4"), ("place", "<i4"))

    @classmethod
    def pack(cls, rows: list[tuple]) -> bytes:
        """rows: (string, right, twice, k1, k2, place), sorted by string."""
        import zstandard

        shared, rest, before = [], [], b""
        for row in rows:
            n = common_prefix(before, row[0])
            shared.append(n)
            rest.append(row[0][n:])
            before = row[0]
        columns = [shared, [len(x) for x in rest], *list(zip(*rows))[1:]]
        body = b"".join([np.array(c, t).tobytes() for c, (_, t) in zip(columns, cls.FIELDS)] + rest)
        return len(rows).to_bytes(4, "little") + zstandard.compress(body, 3)

    def __init__(self, data: bytes):
        import zstandard

        n, body, at = int.from_bytes(data[:4], "little"), zstandard.decompress(data[4:]), 0
        self.n, self.next_row = n, 0
        for name, kind in self.FIELDS:
            size = n * np.dtype(kind).itemsize
            setattr(self, name, np.frombuffer(body[at : at + size], kind).tolist())
            at += size
        self.body, self.at, self.text = body, at, b""

    def step(self) -> int:
        """Go to the next string; what it shares with the one before, or -1 at the end."""
        row = self.next_row
        if row == self.n:
            self.text = None
            return -1
        shared, to = self.shared[row], self.at + self.rest[row]
        self.text = self.text[:shared] + self.body[self.at : to]
        self.at, self.next_row, self.row = to, row + 1, row
        return shared


def merge(runs: list[Run]):
    """(prefix shared with the string before, run) of all strings in order; the run's ``text`` and ``row`` are the string's.

    In the loser tree each loser keeps the prefix it shares with the winner it lost to.  Of
    two strings that share more with the last output the one that shares the most is less;
    only equals are compared, from there on.
    """
    k = len(runs)
    size = 1 << max(0, k - 1).bit_length()
    shares = [0] * k + [-1] * (size - k)
    for run in runs:
        run.step()
    losers, winners = [0] * (2 * size), [0] * (2 * size)
    lost = [-1] * (2 * size)

    def less(a: int, b: int) -> tuple[int, int, int]:
        """(winner, loser, prefix of the loser shared with the winner)"""
        x, y = shares[a], shares[b]
        if x != y:
            return (a, b, y) if x > y else (b, a, x)
        if x < 0:
            return a, b, -1
        s, t = runs[a].text, runs[b].text
        n = common_prefix(s, t, x)
        first = n == len(s) or (n < len(t) and s[n] < t[n])
        return (a, b, n) if first else (b, a, n)

    for i in range(size):
        winners[size + i] = i
    for node in range(size - 1, 0, -1):
        winners[node], losers[node], lost[node] = less(winners[2 * node], winners[2 * node + 1])
        shares[losers[node]] = lost[node]
    winner = winners[1]
    while shares[winner] >= 0:
        yield shares[winner], runs[winner]
        shares[winner] = runs[winner].step()
        node = (winner + size) // 2
        while node:
            other = losers[node]
            if shares[winner] != shares[other] or shares[winner] >= 0:
                winner, losers[node], n = less(winner, other)
                shares[losers[node]] = n
            node //= 2


def reaches(texts: list[bytes], rights: list[int], shared: list[int], full: list[bool], lengths: list[int]) -> list[list[tuple[int, int]]]:
    """For each of ``lengths``, how far repeats reach before and after each of some different suffixes of one gram: (0, 0) if nowhere.

    texts: sorted, each ``right`` bytes from the anchor on and the bytes before it backwards.
    shared: with the suffix before.  full: it occurs twice just so, and reaches as far as it goes.
    """
    n = len(texts)
    outs = [[(len(t) - r, r) if f and len(t) >= least else (0, 0) for t, r, f in zip(texts, rights, full)] for least in lengths]
    if n < 2:
        return outs
    lefts = [t[r:] for t, r in zip(texts, rights)]
    if n <= PAIRS:
        for i in range(n):
            ahead = lengths[-1]
            for j in range(i + 1, n):
                ahead = min(ahead, shared[j])
                if full[i] and full[j]:
                    continue
                after = min(ahead, rights[i], rights[j])
                if after + min(len(lefts[i]), len(lefts[j])) < lengths[0]:
                    continue
                before = common_prefix(lefts[i], lefts[j])
                for least, out in zip(lengths, outs):
                    if before + after >= least:
                        for k in (i, j):
                            out[k] = max(out[k][0], before), max(out[k][1], after)
        return outs
    right, ahead = np.array(rights), np.array(shared)
    order = sorted(range(n), key=lefts.__getitem__)
    behind = np.array([0] + [common_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:])])
    left = np.array([len(x) for x in lefts])
    return [_by_classes(out, full, right, left, ahead, behind, order, least) for out, least in zip(outs, lengths)]


def _by_classes(out, full, right, left, ahead, behind, order, least: int) -> list[tuple[int, int]]:
    """The same for many suffixes: at each offset those that agree before and after are one class."""
    n = len(out)
    first, last = np.full(n, -1), np.full(n, -1)
    for offset in range(min(int(left.max()), least) + 1):
        can = np.flatnonzero((left >= offset) & (right >= least - offset))
        if len(can) < 2:
            continue
        after = np.cumsum(ahead < least - offset)
        before = np.empty(n, np.int64)
        before[order] = np.cumsum(behind < offset)
        pair = after[can] * (n + 1) + before[can]
        _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
        hit = can[counts[inverse] > 1]
        first[hit] = np.where(first[hit] < 0, offset, first[hit])
        last[hit] = offset
    return [o if f else (int(b), least - int(a)) if b >= 0 else o for o, f, a, b in zip(out, full, first, last)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("k1"), F.hash(text, F.col(id_col)).alias("k2"), text.cast("binary").alias("t"))


#: A run, or a finished span, which travels with the runs.
EXCHANGED = "bucket int, k1 long, k2 int, start int, stop int, least int, run binary"
SPANS = "k1 long, k2 int, start int, stop int, least int"


def _sorted_runs(lengths: list[int], buckets: int):
    """Tasks' side of the sort: suffixes at the given places of each text into runs, one for each bucket.

    A place is the anchor of all lengths up to one; its suffix, with as much around as that one
    needs, serves them all.
    """
    gram = gram_size(lengths[0])
    names = [f.split()[0] for f in EXCHANGED.split(", ")]

    def flush(rows: list[tuple]):
        rows.sort()
        runs, spans, i = {}, [], 0
        while i < len(rows):
            j = i + 1
            while j < len(rows) and rows[j][:3] == rows[i][:3]:
                j += 1
            bucket, text, right, k1, k2, place = rows[i]
            held = [n for n in lengths if n <= len(text)]
            if j - i > 1 and held:  # equal suffixes of one task: their reach is known, and one stands for all
                spans += [(r[3] % buckets, r[3], r[4], r[5] - (len(text) - right), r[5] + right, held[-1]) for r in rows[i:j]]
            runs.setdefault(bucket, []).append((text, right, j - i > 1, k1, k2, place))
            i = j
        columns = [list(c) for c in zip(*spans)] or [[]] * 6
        made = [(b, Run.pack(r[a : a + 4096])) for b, r in runs.items() for a in range(0, len(r), 4096)]
        columns = [c + x for c, x in zip(columns, ([b for b, _ in made], *[[None] * len(made)] * 5))]
        kinds = (pa.int32(), pa.int64(), *[pa.int32()] * 4)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array([None] * len(spans) + [r for _, r in made], pa.binary())], names=names)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for k1, k2, text, places in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                for p, level in ((x["place"], x["level"]) for x in places):
                    bucket, most = zlib.crc32(text[p : p + gram]) % buckets, lengths[level]
                    right = text[p : p + most]
                    rows.append((bucket, right + text[max(0, p - most + gram) : p][::-1], len(right), k1, k2, p))
                    size += len(rows[-1][1])
                if size > RUN_BYTES:
                    yield from flush(rows)
                    rows, size = [], 0
        if rows:
            yield from flush(rows)

    return run


def _merged(lengths: list[int]):
    """The other side: merge the runs of each bucket and give what repeats as spans; finished spans pass."""
    gram = gram_size(lengths[0])
    names = [f.split()[0] for f in SPANS.split(", ")]

    def resolve(runs: list[Run]):
        spans: list[tuple] = []
        group: list[list] = []  # text, right, twice, holders, shared

        def close():
            if len(group) > 1 or group and group[0][2]:
                every = reaches([g[0] for g in group], [g[1] for g in group], [g[4] for g in group], [g[2] for g in group], lengths)
                for (_, _, _, holders, _), *found in zip(group, *every):
                    for k, (before, after) in enumerate(found):
                        if after and (before, after) not in found[k + 1 :]:  # a span of a greater length counts for the lesser ones too
                            spans.extend((k1, k2, place - before, place + after, lengths[k]) for k1, k2, place in holders)

        for shared, run in merge(runs):
            row, text = run.row, run.text
            holder = run.k1[row], run.k2[row], run.place[row]
            if group and shared >= gram:
                last = group[-1]
                if shared == len(text) == len(last[0]) and run.right[row] == last[1]:
                    last[2] = True
                    last[3].append(holder)
                    continue
            else:
                close()
                group = []
            group.append([text, run.right[row], bool(run.twice[row]), [holder], shared])
        close()
        return spans

    def rows(spans):
        columns = zip(*spans) if spans else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), *[pa.int32()] * 4))], names=names)

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            done = batch.filter(batch.column(6).is_null())
            yield pa.RecordBatch.from_arrays([done.column(i) for i in range(1, 6)], names=names)
            coded = batch.filter(batch.column(6).is_valid())
            for b, data in zip(coded.column(0).to_pylist(), coded.column(6)):
                if b != bucket:
                    if held:
                        yield rows(resolve(held))
                    bucket, held = b, []
                held.append(Run(data.as_py()))
        if held:
            yield rows(resolve(held))

    return run


def _hot(least: int, gram: int, step: int, cores: bool):
    """Tasks' side of hot grams: parts of the text around each place, by a 128-bit hash; spans of equal suffixes without.

    Any window of ``least`` bytes around a gram's place holds one of the cores, which are ``step`` bytes shorter and
    start at multiples of ``step`` before the place.  cores: give these; else the windows of each core in ``places``.
    """
    back = least - gram
    names = ["h", "k1", "k2", "start", "stop", "core"]
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())

    def batch_of(rows):
        columns = [list(c) for c in zip(*rows)] or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches):
        from xxhash import xxh3_128_digest

        seen: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            rows = []
            for k1, k2, text, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not cores:
                    starts = {s for p, at in ((x["start"], x["core"]) for x in places) for s in range(max(0, p - min(at + step, back)), min(p - at, len(text) - least) + 1)}
                    rows += [(xxh3_128_digest(text[s : s + least]), k1, k2, s, s + least, None) for s in starts]
                    places = ()
                for p in places:
                    low, high = max(0, p - back), min(len(text), p + least)
                    if high - low < least:
                        continue
                    suffix = p - low, text[low:high]  # an equal one of this task reaches as far as it goes, and one stands for all
                    known = seen.get(suffix)
                    if known is None:
                        seen[suffix] = [(k1, k2, low, high)]
                        size += high - low
                        for at in range(0, back, step):
                            start, stop = max(0, p - min(at + step, back)), p - at
                            if start <= min(stop, len(text) - least):
                                rows.append((xxh3_128_digest(text[p - at : p - at + least - step]), k1, k2, p, None, at))
                    else:
                        if len(known) == 1:
                            rows.append((None, *known[0], None))
                            known.append(None)
                        rows.append((None, k1, k2, low, high, None))
                if len(rows) > 50_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)
            if size > RUN_BYTES:
                seen, size = {}, 0

    return run


def _hot_spans(keyed: DataFrame, places: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """(k1, k2, start, stop, least) of all repeats around the grams at ``places`` (k1, k2, place, level); no task holds all of a gram.

    The texts that have such a gram are written once, with its places.
    """
    kinds = "h binary, k1 long, k2 int, start int, stop int, core int"
    own = places.groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "level")).alias("places"))
    texts = written(keyed.join(own, ["k1", "k2"]).select("k1", "k2", "t", "places"), "hot")

    def twice(found: DataFrame) -> DataFrame:
        often = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often")
        return found.join(often, "h", "left_semi")

    out = None
    for number, least in enumerate(lengths):
        step = max(1, least // 8)
        mine = F.transform(F.filter("places", lambda x: x["level"] >= number), lambda x: x["place"])  # noqa: B023
        parts = written(texts.select("k1", "k2", "t", mine.alias("places")).mapInArrow(_hot(least, gram, step, True), kinds), "cores")
        again = twice(parts.where("h is not null")).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "core")).alias("places"))
        windows = written(texts.select("k1", "k2", "t").join(again, ["k1", "k2"]).mapInArrow(_hot(least, gram, step, False), kinds), "windows")
        spans = parts.where("h is null").select("k1", "k2", "start", "stop").union(twice(windows).select("k1", "k2", "start", "stop"))
        spans = spans.withColumn("least", F.lit(least))
        out = spans if out is None else out.union(spans)
    return out


def repeated_spans(keyed: DataFrame, *lengths: int) -> DataFrame:
    """(k1, k2, spans) of the texts of ``keyed`` (doc_id, k1, k2, t) with repeats of any of ``lengths`` bytes.

    spans: array of (start, stop, least) in bytes, not yet united: what repeats of ``least`` bytes or more cover.
    """
    spark, lengths = keyed.sparkSession, sorted(lengths)
    gram = gram_size(lengths[0])

    def find(batches):
        anchors = Anchors(lengths)
        kinds = (np.int32, np.int64, np.int32)
        for batch in batches:
            found = anchors.of(batch.column(2).to_pylist())
            offsets = pa.array(np.cumsum([0] + [len(f[0]) for f in found]), pa.int32())
            flat = [np.concatenate([f[i] for f in found] or [np.zeros(0)]).astype(kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat)], names=["k1", "k2", "places", "grams", "levels"])

    anchors = written(keyed.select("k1", "k2", "t").mapInArrow(find, "k1 long, k2 int, places array<int>, grams array<long>, levels array<int>"), "anchors")
    each = anchors.select("k1", "k2", F.explode(F.arrays_zip("places", "grams", "levels")).alias("a")).select("k1", "k2", F.col("a.places").alias("place"), F.col("a.grams").alias("gram"), F.col("a.levels").alias("level"))
    twice = written(each.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")  # so that the join can split a gram of very many places
    hot = twice.where(F.col("n") > HOT).select("gram")
    chosen = each.join(twice.where(F.col("n") <= HOT), "gram", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "level")).alias("places"))
    chosen = written(chosen, "chosen")
    total = chosen.agg(F.sum(F.size("places")).alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    runs = keyed.join(chosen, ["k1", "k2"]).select("doc_id", "k1", "k2", "t", "places").mapInArrow(_sorted_runs(lengths, buckets), EXCHANGED)
    merged = runs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_merged(lengths), SPANS)
    if not hot.isEmpty():
        merged = merged.union(_hot_spans(keyed, each.join(hot, "gram", "left_semi").select("k1", "k2", "place", "level"), lengths, gram))
    return merged.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop", "least")).alias("spans"))


def unite(spans) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that (start, stop) spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its united spans."""
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def inward(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the parts of characters at their ends."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def _united(spans, least: int = 0) -> list[tuple[int, int]]:
    return unite((s["start"], s["stop"]) for s in spans if s["least"] >= least)


def passages(text: bytes, spans: list[tuple[int, int]], words: int, least: int) -> list[tuple[int, int]]:
    """The united spans with so many words, or so many bytes."""
    return [(a, b) for a, b in spans if b - a >= least or len(text[a:b].split()) >= words]


def digest(docs: DataFrame, least: int = LEAST, passage: tuple[int, int] = (PASSAGE_BYTES, PASSAGE_WORDS), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the text without its repeats, and n_passage_bytes.

    A byte goes if it's inside ``least`` bytes that also start anywhere else, in any row, the
    same included.  ``n_passage_bytes`` counts what stands in repeated passages, though it isn't
    removed: maximal runs covered by repeats of ``passage[0]`` bytes or more, that have
    ``passage[1]`` words or ``least`` bytes.

    Null text counts as empty; shorter texts have no repeats; very long texts are taken whole;
    repeated rows are repeats of each other; null ids are kept; an empty table gives no rows;
    further columns, of any name, are ignored.
    """
    short, words = passage
    keyed = _keyed(docs, id_col, text_col)
    found = "struct<n_removed:bigint,n_spans:bigint,kept_sha256:string,n_passage_bytes:bigint>"

    @F.arrow_udf(found)
    def measure(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            row = None
            if own is not None:
                gone = _united(own, least)
                kept = cut(text, gone)
                near = passages(text, _united(own), words, least)
                row = {"n_removed": len(text) - len(kept), "n_spans": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest(), "n_passage_bytes": sum(b - a for a, b in near)}
            out.append(row)
        return pa.array(out, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passage_bytes", pa.int64())]))

    joined = keyed.join(repeated_spans(keyed, least, short), ["k1", "k2"], "left")
    measured = joined.withColumn("m", measure(F.when(F.col("spans").isNotNull(), F.col("t")), F.col("spans")))  # texts without repeats needn't go to Python
    or_zero = lambda name: F.coalesce(F.col(f"m.{name}"), F.lit(0)).cast("long").alias(name)
    sha = F.when(F.col("spans").isNull(), F.sha2("t", 256)).otherwise(F.col("m.kept_sha256"))
    return measured.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), or_zero("n_removed"), or_zero("n_spans"), sha.alias("kept_sha256"), or_zero("n_passage_bytes"))


def remove_repeats(docs: DataFrame, least: int = LEAST, passage: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of the text, whole characters only; all rows and other columns as they are.

    Repeats are those of ``digest``; with ``passage`` its passages, which hold these, are cut.
    All copies of a repeat go.  Null texts stay null and empty ones empty, very long ones are
    taken whole, repeated rows lose what they share, null ids are kept, an empty table stays
    empty, and columns may have any name.
    """
    short, words = passage or (least, 0)
    spans = repeated_spans(_keyed(docs, id_col, text_col), short)
    text = text_or_empty(text_col).cast("string")

    @F.arrow_udf("string")
    def without(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), found.to_pylist()):
            out.append(None if own is None or text is None else cut(text, inward(text, passages(text, _united(own), words, least))).decode())
        return pa.array(out, pa.string())

    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(id_col), text).alias("k1"), F.hash(text, F.col(id_col)).alias("k2"))
    joined = rows.join(spans, ["k1", "k2"], "left")
    whole = F.col(f"row.`{text_col}`")
    kept = joined.withColumn("kept", without(F.when(F.col("spans").isNotNull(), whole.cast("binary")), F.col("spans")))  # texts without repeats needn't go to Python
    return kept.select(*(F.coalesce("kept", whole).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
