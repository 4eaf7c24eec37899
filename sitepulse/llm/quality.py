"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule's rejections and cost are estimated on a sample; rules then run in the order of
rejections per cost, inside one CASE whose later branches Spark evaluates only for rows
that no earlier rule has rejected.  The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.common import WORD, written

WINDOW = 8


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))


def n_symbols(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    def repeated(lines):
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    return let(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), repeated)


def window_hashes(word_array: Column) -> Column:
    """A 64-bit hash of the eight words from each word on: each word is hashed once, then pairs of hashes, fours and eights."""

    def doubled(hashes: Column, apart: int) -> Column:  # past the end the pairs are junk, which the last slice leaves out
        return let(hashes, lambda h: F.zip_with(h, F.slice(h, F.lit(apart + 1), F.size(h)), lambda a, b: F.xxhash64(a, b)))

    eights = doubled(doubled(doubled(F.transform(word_array, lambda w: F.xxhash64(w)), 1), 2), 4)
    return let(eights, lambda h: F.slice(h, F.lit(1), F.size(h) - (WINDOW - 1)))


def n_repeat_words(word_array: Column) -> Column:
    """Words inside 8-word windows that occur twice or more.

    Windows are sorted by 40 bits of their hash, with their start in the 24 bits below.  Those with a neighbour's hash
    are compared by their words; if one differs, or starts need more bits, windows are sorted by the words themselves.
    """
    index = (1 << 24) - 1

    def covered(places):
        """places: sorted starts of repeated windows."""

        def gain(start, i):
            after = F.get(places, i + 1)
            return F.when(after.isNull(), F.lit(WINDOW)).otherwise(F.least(after - start, F.lit(WINDOW)))

        return F.aggregate(F.transform(places, gain), F.lit(0), lambda total, x: total + x).cast("long")

    def repeated(keys, of):
        """The keys, which are sorted, of which a neighbour has the same ``of``."""

        def same(x, i):
            return F.coalesce(of(F.get(keys, i + 1)) == of(x), F.lit(False)) | ((i > 0) & (of(F.get(keys, F.greatest(i - 1, F.lit(0)))) == of(x)))

        return F.filter(keys, same)

    def by_hash(h, ws):
        start = lambda x: x.bitwiseAND(F.lit(index)).cast("int")
        code = lambda x: F.shiftright(x, 24)
        window = lambda x: F.slice(ws, start(x) + 1, WINDOW)
        keys = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, 24).bitwiseOR(i.cast("long"))))

        def checked(found):
            clash = F.filter(found, lambda x, i: F.coalesce((code(F.get(found, i + 1)) == code(x)) & (window(F.get(found, i + 1)) != window(x)), F.lit(False)))
            return F.when(F.size(clash) > 0, by_words(ws)).otherwise(let(F.sort_array(F.transform(found, start)), covered))

        return let(keys, lambda k: let(repeated(k, code), checked))

    def by_words(ws):
        windows = F.transform(F.sequence(F.lit(0), F.size(ws) - WINDOW), lambda i: F.struct(F.slice(ws, i + 1, WINDOW).alias("w"), i.alias("i")))
        return let(F.sort_array(windows), lambda k: let(F.sort_array(F.transform(repeated(k, lambda x: x["w"]), lambda x: x["i"])), covered))

    def of(ws):
        exact = lambda h: F.when(F.size(ws) > index, by_words(ws)).otherwise(by_hash(h, ws))
        counted = let(window_hashes(ws), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(exact(h)))
        return F.when(F.size(ws) <= WINDOW, F.lit(0).cast("long")).otherwise(counted)

    return let(word_array, of)


def n_adjacent(word_array: Column) -> Column:
    """Words equal to the word before them."""
    return let(word_array, lambda ws: F.size(F.filter(ws, lambda w, i: (i > 0) & (w == F.get(ws, F.greatest(i - 1, F.lit(0)))))).cast("long"))


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes the text, or the word array for ``on='words'``, and gives true for a document to reject."""

    name: str
    on: str
    rejects: object

    def of(self, text: Column, word_array: Column) -> Column:
        return self.rejects(text if self.on == "text" else word_array)


def _adjacent(ws: Column) -> Column:
    return let(ws, lambda w: 100 * n_adjacent(w) > 30 * F.size(w))


#: Rejects: under 20 words; over 30 % of words in repeated windows; over a symbol in ten words; over 30 % of words
#: equal to the word before; over half of the lines repeated; mean word length outside 2 to 15.
BASE_RULES = (
    Rule("short", "words", lambda ws: F.size(ws) < 20),
    Rule("repeats", "words", lambda ws: let(ws, lambda w: 100 * n_repeat_words(w) > 30 * F.size(w))),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", "text", lambda text: 10 * n_symbols(text) > F.regexp_count(text, F.lit(WORD))),
    Rule("stutter", "words", _adjacent),
    Rule("lines", "text", lambda text: 2 * n_dup_lines(text) > F.size(F.split(text, "\n", -1))),
    Rule("word_length", "words", lambda ws: let(ws, lambda w: (F.length(F.array_join(w, "")) < 2 * F.size(w)) | (F.length(F.array_join(w, "")) > 15 * F.size(w)))),
)


#: Rows on which rules are timed, about; copies of them that a rule is run on; runs of which the fastest counts, after one that compiles.
SAMPLE_ROWS, COPIES, RUNS = 200, 4, 2


def order_rules(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """Rules with their rejected share and seconds on a sample of about ``sample_rows`` rows, most rejections per cost first.

    The sample is drawn evenly from all of ``docs``, the same each time, and written once with
    its words split, which every order needs alike.  A rule's cost is its own: what its job over
    copies of the sample takes longer than one that reads the same and judges nothing.  Runs of
    all rules take turns.  Ties, and an empty sample, keep the given order.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    drawn = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).sample(fraction=share, seed=5)
    sample = written(drawn.withColumn("w", words(F.col("t"))).repartition(1), "sample")
    copies = sample.select("t", "w", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    nothing = (F.length("t") < 0) | (F.size("w") < -1)
    jobs = [copies.agg(F.count("*").alias("rows"), F.count_if(condition).alias("rejected")) for condition in (nothing, *(nothing | rule.of(F.col("t"), F.col("w")) for rule in rules))]
    took, rows = [[] for _ in jobs], []
    for turn in range(RUNS + 1):
        for k, job in enumerate(jobs):
            began = time.perf_counter()
            row = job.first()
            if not row["rows"]:
                return [(rule, 0.0, 0.0) for rule in rules]
            (took[k] if turn else rows).append(time.perf_counter() - began if turn else row)
    least = [min(x) for x in took]
    found = [(rule, row["rejected"] / row["rows"], max(own - least[0], 1e-4) / COPIES) for rule, row, own in zip(rules, rows[1:], least[1:])]
    return sorted(found, key=lambda x: -x[1] / x[2])


#: Orders that this process has measured, by table and rules; an order decides the speed alone, never a verdict.
_MEASURED: dict[tuple, list[Rule]] = {}


def _ordered(docs: DataFrame, rules, sample_rows: int, text_col: str) -> list[Rule]:
    """The rules in their measured order, which is kept for a table: the same plan over the same files."""
    key = (docs.sparkSession.sparkContext.applicationId, docs.semanticHash(), tuple(rule.name for rule in rules), sample_rows, text_col)
    if key not in _MEASURED:
        _MEASURED[key] = [rule for rule, _, _ in order_rules(docs, rules, sample_rows, text_col)]
    found = {rule.name: rule for rule in rules}
    return [found[rule.name] for rule in _MEASURED[key]]


def cascade(rules, text: Column, word_array: Column) -> Column:
    """Name of the first rule that rejects, or null; later rules aren't evaluated."""
    chain = None
    for rule in rules:
        condition = rule.of(text, word_array)
        chain = F.when(condition, rule.name) if chain is None else chain.when(condition, rule.name)
    return chain


def keep(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that no rule rejects.

    Null and empty texts have no words and are rejected as short; repeated rows are judged
    each for itself; an empty table stays empty.
    """
    ordered = _ordered(docs, rules, sample_rows, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.where(let(words(text), lambda ws: cascade(ordered, text, ws)).isNull())


def report(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures and verdict for every row: see the columns.  Base figures are given for all rows, so base rules read
    these; the cascade runs the others, and only for rows that the base rules keep.
    """
    others = [rule for rule in rules if rule not in BASE_RULES]
    ordered = _ordered(docs, others, sample_rows, text_col)
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def base_failed(figures: Column) -> Column:
        return (figures["n_words"] < 20) | (100 * figures["n_repeat_words"] > 30 * figures["n_words"])

    def judged(ws: Column) -> Column:
        base = F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            n_repeat_words(ws).alias("n_repeat_words"),
        )
        verdict = lambda b: F.when(base_failed(b), F.lit("base")).otherwise(cascade(ordered, F.col("t"), ws))
        return let(base, lambda b: F.struct(b.alias("b"), verdict(b).alias("rejected_by")))

    found = text.withColumn("f", let(words(F.col("t")), judged)).select(
        "doc_id", "f.b.*", "f.rejected_by", n_symbols(F.col("t")).alias("n_symbols"), n_dup_lines(F.col("t")).alias("n_dup_lines")
    )
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.coalesce(F.col("rejected_by") == "base", F.lit(False)).alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
        "rejected_by",
    )
