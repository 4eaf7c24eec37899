"""Toxicity of texts whose words may be disguised.

A disguised word (leetspeak, spaced or stretched letters) is taken as the output of a noisy
channel: its lattice of possible letters is decoded with Viterbi under a character trigram
model that is counted over the whole corpus.  The restored words are then scored by weights
of words and word beginnings, and a logistic model over them, learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of the character model; symbol 0 is everything between words.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
N = len(LETTERS) + 1
SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS)}
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "#": "h", "%": "x"}
#: Costs in nats: of a sign read as a letter, of a separator or sign left out, of runs of a letter read as one or two.
READ, SKIP, DROP, ONCE, DOUBLE = 0.5, 0.3, 15.0, 1.5, 0.5
EDGE = ".,;:!?'\"()[]{}«»…—–-*_~`"
#: Letters and separators have no sign in common and separators are possessive, so that no text is tried in more than one way;
#: where the last letter goes on as a word, the letter before it ends the match, so a failed try is never a long one.
SPACED = re.compile(r"(?<!\S)(?:(?:[^\W_]|[@$!|+(€])[ .\-_*]++){3,}(?:[^\W_]|[@$!|+(€])(?![^\W_])")
#: Single letters whatever parts them, and short parts of words between white space.
LETTER_RUN = re.compile(r"(?<!\S)(?:(?:[^\W_]|[@$!|+(€])[\s.\-_*]++){2,}(?:[^\W_]|[@$!|+(€])(?![^\W_])")
CHUNKS = re.compile(r"(?<!\S)(?:\w{1,5}\s++)+\w{1,5}(?!\w)")
APART = re.compile(r"[\s.\-_*]+")
STRETCHED = re.compile(r"(.)\1\1")
BEGINNINGS = range(4, 9)
#: Labelled rows that the weights and the logistic model are fitted on, about, at most.
SAMPLE_ROWS = 30_000


def _bare(token: str) -> str:
    """From the first to the last word character; each end is searched from its side, so runs of signs in between aren't tried."""
    first = re.search(r"\w", token)
    return token[first.start() : len(token) - re.search(r"\w", token[::-1]).start()] if first else ""


def _codes() -> np.ndarray:
    table = np.zeros(0x101, np.int64)
    for c, i in SYMBOL.items():
        table[ord(c)] = i
    return table


def count_characters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all texts; (N, N, N)."""

    def count(batches):
        table, total = _codes(), np.zeros(N**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for at in range(0, len(text or ""), 1 << 20):
                    cp = np.frombuffer(f" {text[max(0, at - 2) : at + (1 << 20)].lower()} ".encode("utf-32-le"), np.uint32)
                    s = table[np.minimum(cp, 0x100)]
                    a, b, c = s[:-2], s[1:-1], s[2:]
                    code = np.append(b[:1], (np.where(b > 0, a, 0) * N + b) * N + c)
                    total += np.bincount(code[code > 0], minlength=N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "code long, n long")
    counts = np.zeros(N**3)
    for r in rows.groupBy("code").agg(F.sum("n").alias("n")).collect():  # N**3 rows at most
        counts[r.code] = r.n
    return counts.reshape(N, N, N)


class Restorer:
    """Decodes disguised words."""

    def __init__(self, counts: np.ndarray):
        one = counts.sum((0, 1)) + 1
        two = counts.sum(0) + 5 * one / one.sum()
        three = counts + 5 * (two / two.sum(-1, keepdims=True))[None]
        self.cost = -np.log(three / three.sum(-1, keepdims=True)).astype(np.float32)
        self.rows: dict[tuple[int, int], list[float]] = {}

    def _row(self, state: tuple[int, int]) -> list[float]:
        row = self.rows.get(state)
        if row is None:
            row = self.rows[state] = self.cost[state].tolist()
        return row

    @staticmethod
    def lattice(text: str) -> list[list[tuple[float, str]]]:
        """For each run of one character: (cost, letters) that it may stand for."""
        out = []
        for m in re.finditer(r"(.)\1*", text):
            sign, n = m[1], len(m[0])
            if sign in SYMBOL:
                ways = [(0.0, sign)] if n == 1 else [(0.0 if n == 2 else DOUBLE, 2 * sign), (ONCE if n == 2 else DOUBLE, sign)]
            elif sign in LEET:
                ways = [(READ * min(n, 2), letter * k) for letter in LEET[sign] for k in range(1, min(n, 2) + 1)] + [(DROP, "")]
            else:
                ways = [(SKIP, "")]
            out.append(ways)
        return out

    def restore(self, text: str) -> str:
        """The likeliest word behind ``text`` (lower case)."""
        return self._decoded([text])

    def segment(self, run: str) -> list[str]:
        """The likeliest words behind a run of letters, where each separator is nothing or the end of a word."""
        return self._decoded(APART.split(run)).split()

    def _decoded(self, parts: list[str]) -> str:
        """Viterbi over the parts' lattices; between parts, a space or nothing.  Paths are kept as links to what came before."""
        states: dict = {(0, 0): (0.0, None)}
        for k, part in enumerate(parts):
            if k:
                ended = [(cost + self._row(state)[0], (back, " ")) for state, (cost, back) in states.items() if state != (0, 0)]
                if ended:
                    best = min(ended, key=lambda x: x[0])
                    if (0, 0) not in states or best[0] < states[0, 0][0]:
                        states[0, 0] = best
            for ways in self.lattice(part):
                after: dict = {}
                for state, (cost, back) in states.items():
                    for price, letters in ways:
                        now, total = state, cost + price
                        for letter in letters:
                            symbol = SYMBOL[letter]
                            total += self._row(now)[symbol]
                            now = now[1], symbol
                        if now not in after or total < after[now][0]:
                            after[now] = total, (back, letters) if letters else back
                states = after
        _, back = min(((cost + (self._row(state)[0] if state != (0, 0) else 0), back) for state, (cost, back) in states.items()), key=lambda x: x[0])
        found = []
        while back:
            back, letters = back
            found.append(letters)
        return "".join(reversed(found))

    def words(self, token: str) -> list[str]:
        """The words that a token without white space may be: without its edges, and restored if it looks disguised."""
        plain = token.strip(EDGE)
        found = []
        if plain.isalpha():
            found.append(plain)
            if not STRETCHED.search(plain):
                return found
        else:
            bare = _bare(plain)
            if bare.isalpha():
                found.append(bare)
            if len(plain) - len(bare) > 2 and bare.isalpha() or not any(c in SYMBOL for c in plain):
                return found
        found.append(self.restore(plain))
        return found


@dataclass
class Model:
    counts: np.ndarray
    weights: dict[str, float]
    logistic: tuple[float, ...] = (0.0,) * 7


class Scorer:
    def __init__(self, model: Model, memory: int = 400_000):
        self.restorer, self.weights, self.logistic = Restorer(model.counts), model.weights, model.logistic
        self.memory, self.seen = memory, {}
        self.starts = {f[1:n] for f in self.weights if f[0] == "=" for n in range(2, len(f) + 1)}

    def words(self, text: str) -> set[str]:
        """Distinct restored words of a text, its disguises among them."""
        return {w for token in self._tokens(text) | self._segments(text.lower()) for w in self.restorer.words(token) if w}

    def _segments(self, low: str) -> set[str]:
        """Words of the runs of single letters of a text in lower case."""
        return {w for m in LETTER_RUN.finditer(low) for w in self.restorer.segment(m[0])}

    def _joined(self, low: str) -> set[str]:
        """Words with a weight that consecutive short parts of a text in lower case make, wherever they start."""
        found = set()
        for pattern in (LETTER_RUN, CHUNKS):
            for m in pattern.finditer(low):
                parts = APART.split(m[0])
                for i in range(len(parts) - 1):
                    word = parts[i]
                    if word not in self.starts:
                        continue
                    for k in range(i + 1, len(parts)):  # as far as a weighted word begins so
                        word += parts[k]
                        if word not in self.starts:
                            break
                        if "=" + word in self.weights:
                            found.add(word)
        return found

    @staticmethod
    def _tokens(text: str) -> set[str]:
        low = text.lower()
        tokens = set(low.split())
        for m in SPACED.finditer(low):  # a word of one letter may stand at either end
            joined = re.sub(r"\s+", "", m[0])
            tokens.update((joined, joined[1:], joined[:-1]))
        return tokens

    @staticmethod
    def features(word: str) -> list[str]:
        return ["=" + word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]

    def weight(self, token: str) -> float:
        found = self.seen.get(token)
        if found is None:
            if len(self.seen) >= self.memory:
                self.seen.clear()
            get = self.weights.get
            found = self.seen[token] = max((get(f, 0.0) for w in self.restorer.words(token) if w for f in self.features(w)), default=0.0)
        return found

    def summary(self, text: str) -> tuple[float, ...]:
        """The three greatest weights of the text's words, the sum of the others, and logs of 1 + its words and those with a weight."""
        low = text.lower()
        tokens = self._tokens(text) | self._segments(low) | self._joined(low)
        found = sorted((w for w in map(self.weight, tokens) if w), reverse=True)
        first = [*found[:3], 0.0, 0.0, 0.0][:3]
        return *first, math.log1p(sum(found[3:])), math.log1p(len(tokens)), math.log1p(len(found))

    def score(self, text: str) -> float:
        z = self.logistic[0] + sum(b * x for b, x in zip(self.logistic[1:], self.summary(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [0.1] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labelled rows that aren't held out, about ``sample_rows`` of them at most; characters are counted over all rows.

    Word weights come from one half of the rows, the logistic model from the other.  Null ids,
    labels and texts don't teach; an id with several labels counts as toxic if one says so.
    Without labels of both kinds every text scores the share of toxic ones, or 0.
    """
    counts = count_characters(docs, text_col)
    train = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    total = train.count()
    every = max(1, -(-total // sample_rows))
    chosen = train.where(F.pmod(F.xxhash64("i"), F.lit(every)) == 0)
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    rows = own.join(F.broadcast(chosen), "i").select("y", (F.pmod(F.xxhash64("i", F.lit(1)), F.lit(2)) == 0).alias("first"), "t")
    blank = Model(counts, {})

    def words(batches):
        scorer = Scorer(blank)
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in scorer.words(text) for f in scorer.features(w)}:
                    seen.setdefault(f, [0, 0])[y > 0] += 1
            n = list(zip(*seen.values())) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(n[1], pa.int64()), pa.array(n[0], pa.int64())], names=["f", "toxic", "clean"])

    first = rows.where("first")
    sizes = first.agg(F.sum(F.expr("y > 0").cast("long")).alias("toxic"), F.sum(F.expr("y <= 0").cast("long")).alias("clean")).first()
    toxic, clean = sizes.toxic or 0, sizes.clean or 0
    weights = {}
    if toxic and clean:
        found = first.select("y", "t").mapInArrow(words, "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
        weights = {r.f: r.w for r in found.where("toxic >= 3").select("f", odds.alias("w")).where("w >= 2").collect()}  # as many as a bounded sample has
    model = Model(counts, weights)

    def summaries(batches):
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.summary(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.float64()) for k in range(6))], names=["y", *"abcdef"])

    second = rows.where("not first").select("y", "t").mapInArrow(summaries, "y int, a double, b double, c double, d double, e double, f double").collect()
    y = np.array([r.y > 0 for r in second], float)
    if not 0 < y.sum() < len(y):
        share = min(max(y.mean() if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return Model(counts, weights, (math.log(share / (1 - share)), *[0.0] * 6))
    return Model(counts, weights, _logistic(np.array([list(r)[1:] for r in second]), y))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold`` on) of every row.

    Null text counts as empty, and empty texts score the model's base rate.  Very long texts and
    words are decoded whole, in time in proportion to their length.  Null ids count as not held
    out; repeated rows are scored alike; an empty table gives no rows; further columns, of any
    name, are ignored.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([scorer.score(t or "") for t in batch.column(2).to_pylist()], pa.float64())], names=schema.names)

    found = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string")).mapInArrow(run, schema)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
