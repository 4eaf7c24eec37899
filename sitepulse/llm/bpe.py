"""Batched byte-level BPE on top of the ``tokenizers`` library.

Texts are cut into the pre-tokenizer's pieces with numpy, each distinct piece is
encoded by the library once and remembered, and the ids of whole texts are then
gathered from the remembered pieces.  The remembered code points are compared with
the text, so a hash collision can't change a result: such a text, and any text with
code points outside the plain range below, goes to the library whole.  So does every text if
the vocabulary's pre-tokenizer isn't the one whose cuts are made here.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

#: Code points whose class (letter, number, space, other) is the same in every Unicode version in use.
PLAIN = [(0x09, 0x0D), (0x20, 0x7E), (0xA1, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC)]
LIMIT = 0x20AE
LETTER, NUMBER, OTHER, SPACE, STRANGE = 1, 2, 3, 4, 9
CONTRACTION = re.compile(r"'(?:[stmd]|re|ve|ll)")
MASK = (1 << 64) - 1


def _classes() -> np.ndarray:
    table = np.full(LIMIT + 1, STRANGE, np.uint8)
    for low, high in PLAIN:
        for c in range(low, high + 1):
            kind = unicodedata.category(chr(c))[0]
            table[c] = SPACE if chr(c).isspace() else {"L": LETTER, "N": NUMBER, "C": STRANGE}.get(kind, OTHER)
    return table


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class _Grow:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 12, dtype), 0

    def add(self, values) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(need - len(self.data), len(self.data)), self.data.dtype)])
        self.data[self.n : need] = values
        self.n = need


class _Table:
    """Row numbers by 64-bit code: open addressing, on whole arrays."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self.codes, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The row of each code, or -1."""
        slots = (codes >> np.uint64(24)).astype(np.int64) & self.mask
        there = self.codes[slots]
        out = np.where(there == codes, self.rows[slots], -1)
        left = np.flatnonzero((there != codes) & (there != 0))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            there = self.codes[slots[left]]
            same = there == codes[left]
            out[left[same]] = self.rows[slots[left[same]]]
            left = left[~same & (there != 0)]
        return out

    def add(self, codes: np.ndarray, rows: np.ndarray) -> None:
        """Codes that aren't there yet, each once."""
        slots = (codes >> np.uint64(24)).astype(np.int64) & self.mask
        left = np.arange(len(codes))
        while len(left):
            free = left[self.codes[slots[left]] == 0]
            self.codes[slots[free]] = codes[free]
            self.rows[slots[free]] = rows[free]
            left = left[self.codes[slots[left]] != codes[left]]
            slots[left] = (slots[left] + 1) & self.mask


class PieceEncoder:
    """``encode(texts)`` gives the ids of each text; equal to the library's own output."""

    _shared: dict[tuple[str, bool], PieceEncoder] = {}

    @classmethod
    def shared(cls, path: str, offsets: bool = False) -> PieceEncoder:
        """One encoder for each vocabulary in a Python worker."""
        if (path, offsets) not in cls._shared:
            cls._shared[path, offsets] = cls(path, offsets)
        return cls._shared[path, offsets]

    def __init__(self, path: str, offsets: bool = False, max_pieces: int = 1_000_000, batch_chars: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.offsets, self.max_pieces, self.batch_chars = offsets, max(max_pieces, batch_chars), batch_chars
        known = json.loads(self.tokenizer.to_str())
        cutter = known.get("pre_tokenizer") or {}
        self.cuts = known.get("normalizer") is None and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) and known["model"]["type"] == "BPE"
        self.classes = _classes()
        power, powers = 1, []
        for _ in range(1 << 12):
            powers.append(power)
            power = power * 0x9E3779B97F4A7C15 & MASK
        self.powers = np.array(powers, np.uint64)
        values = np.arange(LIMIT + 1, dtype=np.uint64) + np.uint64(1)
        for _ in range(2):
            values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.values = values ^ (values >> np.uint64(32))
        self._forget()

    def _forget(self) -> None:
        self.table = _Table(max(10, (2 * self.max_pieces - 1).bit_length()))
        self.ids, self.begins, self.ends, self.chars = (_Grow(t) for t in (np.uint16, np.int32, np.int32, np.uint16))
        if self.tokenizer.get_vocab_size() > 1 << 16:
            self.ids = _Grow(np.uint32)
        self.first, self.count, self.char_first, self.char_count = (_Grow(np.int32) for _ in range(4))
        self.pieces = 0

    def _tokens(self, text: str, pick: np.ndarray | None = None):
        """(ids, number of ids of each word, begins, ends) of the library's words ``pick`` of a text, or of all."""
        enc = self.tokenizer.encode(text, add_special_tokens=False)
        word = np.array(enc.word_ids, np.int64)
        ids, counts = np.array(enc.ids, np.uint32), np.bincount(word)
        spans = np.array(enc.offsets, np.int64).reshape(-1, 2) if self.offsets else np.zeros((len(ids), 2), np.int64)
        if pick is not None:
            keep = ragged((np.cumsum(counts) - counts)[pick], counts[pick])
            ids, spans, counts = ids[keep], spans[keep], counts[pick]
        return ids, counts, spans

    def _learn(self, codes: np.ndarray, cp: np.ndarray, at: np.ndarray, size: np.ndarray, kind: np.ndarray) -> None:
        """Encode new pieces.  Many make one text, which the library cuts before each: at the space that a piece begins with, or at line feeds put between others."""
        blank = kind[at] == SPACE
        lead = blank & (size > 1) & (kind[np.minimum(at + 1, len(kind) - 1)] != SPACE)
        groups = []
        for group, apart in ((np.flatnonzero(lead), False), (np.flatnonzero(~blank), True)):
            for lo in range(0, len(group), 4096):
                own = group[lo : lo + 4096]
                length = size[own] + apart
                edges = np.cumsum(length) - length
                chars = cp[np.maximum(ragged(at[own] - apart, length), 0)]
                if apart:
                    chars[edges] = 10
                ids, counts, spans = self._tokens(chars.tobytes().decode("utf-32-le"), 2 * np.arange(len(own)) + 1 if apart else None)
                groups.append((own, ids, counts, spans - np.repeat(edges + apart, counts)[:, None]))
        for k in np.flatnonzero(blank & ~lead).tolist():
            enc = self.tokenizer.encode(cp[at[k] : at[k] + size[k]].tobytes().decode("utf-32-le"), add_special_tokens=False)
            groups.append((np.array([k]), np.array(enc.ids, np.uint32), np.array([len(enc.ids)]), np.array(enc.offsets, np.int64).reshape(-1, 2)))
        for own, ids, counts, spans in groups:
            counts = counts.astype(np.int64)
            self.first.add(self.ids.n + np.cumsum(counts) - counts)
            self.count.add(counts)
            self.ids.add(ids)
            if self.offsets:
                self.begins.add(spans[:, 0])
                self.ends.add(spans[:, 1])
            length = size[own]
            self.char_first.add(self.chars.n + np.cumsum(length) - length)
            self.char_count.add(length)
            self.chars.add(np.minimum(cp[ragged(at[own], length)], 0xFFFF))
            self.table.add(codes[own], np.arange(self.pieces, self.pieces + len(own), dtype=np.int32))
            self.pieces += len(own)

    def _whole(self, text: str):
        enc = self.tokenizer.encode(text, add_special_tokens=False)
        if not self.offsets:
            return (np.array(enc.ids, np.uint32),)
        spans = np.array(enc.offsets, np.int64).reshape(-1, 2)
        return np.array(enc.ids, np.uint32), spans[:, 0], spans[:, 1]

    def _batch(self, texts: list[str]):
        """Ids (and begins, ends) of texts without contractions; None in place of a text that must go to the library."""
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        stops = np.cumsum(sizes)
        begin = stops - sizes
        plain = np.minimum(cp, LIMIT)
        kind = self.classes[plain]
        space = kind == SPACE
        blank = cp == 32
        start = np.empty(len(cp), bool)
        start[0] = True
        start[1:] = np.where(space[1:], ~space[:-1], (kind[1:] != kind[:-1]) & ~blank[:-1])
        start[:-1] |= space[:-1] & ~space[1:]
        live = sizes > 0
        tail = stops[live] - 1  # a space at the end of a text stays with the spaces before it
        tail = tail[(tail > begin[live]) & space[tail]]
        start[tail] = ~space[tail - 1]
        start[begin[live]] = True
        at = np.flatnonzero(start)
        size = np.diff(at, append=len(cp))
        where = np.arange(len(cp)) - np.repeat(at, size)
        code = np.add.reduceat(self.values[plain] * self.powers[where & 0xFFF], at)
        code = ((code ^ (code >> np.uint64(31))) + size.astype(np.uint64)) | np.uint64(1)
        which = self.table.find(code)
        odd = kind == STRANGE
        if (which < 0).any():
            new, first = np.unique(code[which < 0], return_index=True)
            first = np.flatnonzero(which < 0)[first]
            if self.pieces + len(new) > self.max_pieces:
                self._forget()
                new, first = np.unique(code, return_index=True)
            usable = ~np.maximum.reduceat(odd, at)[first]
            new, first = new[usable], first[usable]
            self._learn(new, cp, at[first], size[first], kind)
            which = self.table.find(code)
            odd |= np.repeat(which < 0, size)
            which = np.maximum(which, 0)
        same = self.char_count.data[which] == size
        if same.all():
            odd |= self.chars.data[ragged(self.char_first.data[which], size)] != cp
        else:
            odd |= ~np.repeat(same, size)
        lengths = self.count.data[which]
        pick = ragged(self.first.data[which], lengths)
        owner = np.searchsorted(stops, at, "right")
        counts = np.bincount(owner, weights=lengths, minlength=len(texts)).astype(np.int64)
        cuts = np.cumsum(counts)
        bad = np.add.reduceat(np.append(odd, False).astype(np.int32), begin) > 0
        parts = (self.ids.data[pick],)
        if self.offsets:
            shift = np.repeat(at - begin[owner], lengths)
            parts = *parts, self.begins.data[pick] + shift, self.ends.data[pick] + shift
        return [None if b and n else tuple(p[c - k : c] for p in parts) for b, n, c, k in zip(bad.tolist(), sizes.tolist(), cuts.tolist(), counts.tolist())]

    def encode(self, texts: list[str]) -> list[tuple]:
        """A tuple (ids,) for each text, or (ids, begins, ends) with offsets in code points."""
        out: list = [None] * len(texts)
        empty = (np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * (2 * self.offsets))
        batch, room = [], 0
        for i, text in enumerate(texts):
            if not text:
                out[i] = empty
                continue
            if not self.cuts or len(text) > self.batch_chars or "'" in text and CONTRACTION.search(text):
                out[i] = self._whole(text)
                continue
            if room + len(text) > self.batch_chars:  # so a batch has no more pieces than the table takes
                self._fill(out, texts, batch)
                batch, room = [], 0
            batch.append(i)
            room += len(text)
        if batch:
            self._fill(out, texts, batch)
        return out

    def _fill(self, out: list, texts: list[str], batch: list[int]) -> None:
        for i, got in zip(batch, self._batch([texts[i] for i in batch])):
            out[i] = self._whole(texts[i]) if got is None else got
