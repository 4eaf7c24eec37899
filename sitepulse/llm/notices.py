"""License and rights notices: exact phrases, and short notices within a few edits.

A notice that may differ by ``k`` edits is split into ``k + 1`` seeds, one of which must
then stand unchanged (pigeonhole).  An automaton finds all seeds; around each the regex
library matches the whole notice within its bound and gives the span and the edits.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepulse.llm.common import LOWER_WORDS

#: Phrases that are found word for word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int


#: Short notices in words of ``LOWER_WORDS``, with the edits (characters) allowed.
NOTICES = (
    Notice("apache-2.0", "licensed under the apache license version 2 0", 5),
    Notice("apache-2.0", "apache license version 2 0", 2),
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "licensed under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge", 5),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("mpl", "subject to the terms of the mozilla public license", 5),
    Notice("gpl", "gnu general public license", 3),
    Notice("lgpl", "gnu lesser general public license", 4),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("cc-by", "licensed under cc by", 2),
    Notice("reserved", "all rights reserved", 2),
    Notice("public-domain", "released into the public domain", 4),
)


def seeds(notice: Notice) -> list[tuple[int, str]]:
    """(start, seed): ``edits + 1`` parts of nearly equal length."""
    n, k = len(notice.text), notice.edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class NoticeSearch:
    """Fuzzy matches of all notices in a text of words joined by single spaces."""

    def __init__(self, notices=NOTICES):
        import ahocorasick
        import regex

        self.notices = notices
        self.patterns = [regex.compile(rf"(?<![^ ])(?:{regex.escape(x.text)}){{e<={x.edits}}}(?![^ ])", regex.BESTMATCH) for x in notices]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(notices):
            for start, seed in seeds(notice):
                places.setdefault(seed, []).append((number, start))
        self.automaton = ahocorasick.Automaton()
        for seed, found in places.items():
            self.automaton.add_word(seed, (len(seed), found))
        self.automaton.make_automaton()

    def _stretches(self, number: int, text: str, low: int, high: int):
        """A window in parts of bounded length, which begin and end with words; any match lies whole in one."""
        span = len(self.notices[number].text) + self.notices[number].edits + 1
        while high - low > 8 * span:
            cut = text.find(" ", low + 8 * span, high)
            if cut < 0:
                break
            yield low, cut
            back = text.rfind(" ", low, cut - span)  # the next part begins where a match that ends after the cut may
            low = (back if back >= 0 else text.find(" ", cut - span, cut + 1)) + 1
        yield low, high

    def _matches(self, number: int, text: str, low: int, high: int) -> list[tuple[int, int, int]]:
        """(edits, start, end) of a window's matches, the best first; those that overlap a better one don't count.

        Each part's best waits in a heap.  What is taken changes only the parts around it, so the
        time is in proportion to the window.
        """
        heap, taken = [], []

        def search(a: int, b: int) -> None:
            m = self.patterns[number].search(text, a, b) if a < b else None
            if m:
                heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

        for a, b in self._stretches(number, text, low, high):
            search(a, b)
        out = []
        while heap:
            edits, start, end, a, b = heapq.heappop(heap)
            first = bisect.bisect_left(taken, (a, a))
            around = taken[max(0, first - 1) : bisect.bisect_right(taken, (b, b))]  # ends as starts: taken ones don't overlap
            if any(s < end and start < e for s, e in around):
                at = a
                for s, e in around:
                    if s < b and e > a:
                        search(at, s)
                        at = max(at, e)
                search(at, b)
                continue
            out.append((edits, start, end))
            bisect.insort(taken, (start, end))
            search(a, start)
            search(end, b)
        return out

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice number, edits), in order; of one notice's overlapping matches the one of fewest edits, then the first."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, found) in self.automaton.iter(text):
            begin = last + 1 - size
            for number, start in found:
                notice = self.notices[number]
                low, high = begin - start - notice.edits, begin - start + len(notice.text) + notice.edits
                first = text.rfind(" ", 0, max(0, low)) + 1  # a window begins and ends with a word, so that neither is a boundary inside one
                stop = text.find(" ", min(len(text), high))
                windows.setdefault(number, []).append((first, len(text) if stop < 0 else stop))
        out = []
        for number, around in windows.items():
            merged: list[list[int]] = []
            for low, high in sorted(around):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            for low, high in merged:
                out += [(start, end, number, edits) for edits, start, end in self._matches(number, text, low, high)]
        return sorted(out)


def _spaces(text: bytes, unit) -> np.ndarray:
    """Places of the spaces in units of the encoding: how many come before a place is its word's number."""
    return np.flatnonzero(np.frombuffer(text, unit) == 0x20)


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start_word:long,end_word:long,edits:int>>"


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Notices in every text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Texts are taken as words: A-Z lowered, words of digits, letters and non-ASCII characters.
    ``n_base`` counts the places of ``phrases``; first and last are their starts in words.
    ``spans`` are the fuzzy matches in words.  ``score`` is 1 with a phrase, else the best
    match's share of unedited characters, else 0.

    Null and empty texts have no words, no labels and score 0.  Very long texts are scanned
    whole.  Null ids and repeated rows are scanned each for itself; an empty table gives no
    rows; further columns, of any name, are ignored.
    """
    columns = T.StructType.fromDDL(SCAN)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *columns.fields])

    def find(batches):
        search = NoticeSearch(notices)
        exact = [(f" {phrase} ".encode(), label) for phrase, label in phrases.items()]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode().translate(LOWER_WORDS).split()
                joined = b" " + b" ".join(words) + b" "
                places, base = [], set()
                for phrase, label in exact:
                    at = joined.find(phrase)
                    while at >= 0:
                        places.append(at)
                        base.add(label)
                        at = joined.find(phrase, at + 1)
                starts = np.searchsorted(_spaces(joined, np.uint8), places).tolist() if places else []
                plain = joined[1:-1].decode()
                found, spans = search.spans(plain), []
                if found:
                    gaps = _spaces(plain.encode("utf-32-le"), np.uint32)
                    ends = np.searchsorted(gaps, [x[:2] for x in found]).tolist()
                    for (_, _, number, edits), (first, last) in zip(found, ends):
                        notice = search.notices[number]
                        spans.append({"label": notice.label, "start_word": first, "end_word": last + 1, "edits": edits, "share": 1 - edits / len(notice.text)})
                score = 1.0 if starts else max((s["share"] for s in spans), default=0.0)
                labels = base | {s["label"] for s in spans}
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [{k: s[k] for k in ("label", "start_word", "end_word", "edits")} for s in spans]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())]))]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(find, schema)
