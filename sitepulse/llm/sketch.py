"""Fingerprints of documents as invertible Bloom lookup tables of their paragraphs, in Spark's own functions.

Each paragraph's 64-bit digest is added to one cell of each of three tables; a cell holds how many
were added and sums of both halves.  Cells of two versions are subtracted, so what both have
cancels; a cell that holds one digest only is pure, shows it, and is taken out of its other
cells, until nothing is left.  Where something is left, the table was too small for the
difference, and the pair is tried again with a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitepulse.llm.common import text_or_empty, written

#: Tables of a sketch, and cells of each in a fingerprint.
TABLES, CELLS = 3, 4
#: Cells of each table of a pair for one paragraph of both; rounds of peeling, which are enough at that load; what a retry multiplies cells by.
LOAD, ROUNDS, LARGER = 1.0, 6, 4
LEAST_CELLS = 16
#: Between paragraphs.  Sentences in their place would make six times the cells, more than a task's memory holds.
BREAK = r"\n"
LOW = (1 << 32) - 1
#: Documents of one block in which each looks for the next.
BLOCK = 10_000


def _check(high: Column, low: Column) -> Column:
    """Sixteen bits that a digest has at its end."""
    return F.xxhash64(high, F.shiftright(low, 16)).bitwiseAND(F.lit(0xFFFF))


def digests(text: Column) -> Column:
    """The digests of a text's paragraphs, in order, those of spaces alone left out."""
    own = F.filter(F.split(text, BREAK, -1), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))

    def digest(p: Column) -> Column:
        h = F.xxhash64(p)
        high, low = F.shiftright(h, 32).bitwiseAND(F.lit(LOW)), F.shiftleft(F.shiftright(h, 16).bitwiseAND(F.lit(0xFFFF)), 16)
        return F.shiftleft(high, 32).bitwiseOR(low).bitwiseOR(_check(high, low))

    return F.transform(own, digest)


def _place(digest: Column, table: int, cells: Column | int) -> Column:
    """The cell of a digest in one table; tables lie one behind the other."""
    size = F.lit(cells) if isinstance(cells, int) else cells
    return F.pmod(F.xxhash64(digest, F.lit(table)), size) + size * table


def _halves(digest: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(digest, 32), digest.bitwiseAND(F.lit(LOW))


def fingerprint(found: Column) -> Column:
    """A text's cells, of a fixed number, as text: count and sums of each; of equal texts equal."""
    places = F.flatten(F.transform(found, lambda d: F.array(*(F.named_struct(F.lit("p"), _place(d, t, CELLS), F.lit("d"), d) for t in range(TABLES)))))

    def cell(c: Column) -> Column:
        own = F.transform(F.filter(places, lambda x: x["p"] == c), lambda x: x["d"])
        total = lambda half: F.aggregate(own, F.lit(0).cast("long"), lambda a, d: a + half(d))
        return F.concat_ws(":", F.hex(F.size(own).cast("long")), F.hex(total(lambda d: _halves(d)[0])), F.hex(total(lambda d: _halves(d)[1])))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(TABLES * CELLS - 1)), cell), ",")


def _added(rows: DataFrame, keys: list[str], pairs: list[tuple[str, str]], factor: int) -> DataFrame:
    """(keys, pair, cells, cell, n, s1, s2): the cells of each pair's difference that aren't empty."""
    sides = [(number, name, sign) for number, both in enumerate(pairs) for name, sign in zip(both, (1, -1))]
    held = F.array(*(F.struct(F.lit(number).alias("pair"), F.lit(sign).cast("long").alias("sign"), _cells(*pairs[number], factor).alias("cells"), F.col(name).alias("ds")) for number, name, sign in sides))
    each = rows.select(*keys, F.explode(held).alias("h")).select(*keys, "h.pair", "h.sign", "h.cells", F.explode("h.ds").alias("d"))
    high, low = _halves(F.col("d"))
    cell = F.explode(F.array(*(_place(F.col("d"), t, F.col("cells")) for t in range(TABLES)))).alias("cell")
    placed = each.select(*keys, "pair", "cells", "sign", (high * F.col("sign")).alias("a"), (low * F.col("sign")).alias("b"), cell)
    summed = placed.groupBy(*keys, "pair", "cells", "cell").agg(F.sum("sign").alias("n"), F.sum("a").alias("s1"), F.sum("b").alias("s2"))
    return _filled(summed).withColumn("shown", F.lit(0).cast("long"))


def _cells(left: str, right: str, factor: int) -> Column:
    """Cells of each table, by the paragraphs of both."""
    return F.greatest(F.lit(LEAST_CELLS), F.ceil((F.size(left) + F.size(right)) * LOAD).cast("long")) * factor


def _filled(cells: DataFrame) -> DataFrame:
    return cells.where((F.col("n") != 0) | (F.col("s1") != 0) | (F.col("s2") != 0))


def _round(cells: DataFrame, keys: list[str], show: bool) -> DataFrame:
    """One round of peeling: pure cells give their digests, each once, which leave all their cells.

    Rows of cell -1 hold what was found: how many digests, or with ``show`` each digest and how
    often the left side has it more.  All steps group by the keys first, so rows stay in their tasks.
    """
    zero, by = F.lit(0).cast("long"), [*keys, "pair", "cells"]
    exact = (F.col("n") != 0) & (F.expr("s1 % nullif(n, 0)") == 0) & (F.expr("s2 % nullif(n, 0)") == 0)
    halves = {name: F.when(exact, F.expr(f"{total} div nullif(n, 0)")) for name, total in (("high", "s1"), ("low", "s2"))}
    seen = cells.withColumns(halves).withColumn("d", F.shiftleft("high", 32).bitwiseOR(F.col("low")))
    table = F.when(F.col("cell") < F.col("cells"), _place(F.col("d"), 0, F.col("cells"))).when(F.col("cell") < 2 * F.col("cells"), _place(F.col("d"), 1, F.col("cells")))
    at = table.otherwise(_place(F.col("d"), 2, F.col("cells")))
    whole = F.col("high").between(0, LOW) & F.col("low").between(0, LOW) & (F.col("low").bitwiseAND(F.lit(0xFFFF)) == _check(F.col("high"), F.col("low")))
    pure = F.coalesce((F.col("cell") >= 0) & whole & (at == F.col("cell")), F.lit(False))
    cell = F.struct(F.lit(False).alias("found"), F.col("cell").alias("id"), "shown", "n", "s1", "s2")
    digest = F.struct(F.lit(True).alias("found"), F.col("d").alias("id"), zero.alias("shown"), "n", zero.alias("s1"), zero.alias("s2"))
    split = seen.select(*by, F.explode(F.when(pure, F.array(cell, digest)).otherwise(F.array(cell))).alias("x")).select(*by, "x.*")
    once = split.groupBy(*by, "found", "id", "shown").agg(F.max("n").alias("n"), F.max("s1").alias("s1"), F.max("s2").alias("s2"))
    high, low = _halves(F.col("id"))
    gone = [F.struct(_place(F.col("id"), t, F.col("cells")).alias("cell"), zero.alias("shown"), (-F.col("n")).alias("n"), (-high * F.col("n")).alias("s1"), (-low * F.col("n")).alias("s2")) for t in range(TABLES)]
    result = F.struct(F.lit(-1).cast("long").alias("cell"), (F.col("id") if show else zero).alias("shown"), (F.col("n") if show else F.abs("n")).alias("n"), zero.alias("s1"), zero.alias("s2"))
    kept = F.struct(F.col("id").alias("cell"), "shown", "n", "s1", "s2")
    spread = once.select(*by, F.explode(F.when(F.col("found"), F.array(*gone, result)).otherwise(F.array(kept))).alias("x")).select(*by, "x.*")
    return _filled(spread.groupBy(*by, "cell", "shown").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")))


def difference_counts(rows: DataFrame, keys: list[str], pairs: list[tuple[str, str]], factor: int = 1) -> DataFrame:
    """``rows`` with ``differences``: for each pair of columns of digests how many of both aren't shared, null where the table was too small.

    keys: columns that tell rows apart; rows that are dealt by them already aren't exchanged.
    """
    cells = _added(rows, keys, pairs, factor)
    for _ in range(ROUNDS):
        cells = _round(cells, keys, False)
    of = lambda k: F.col("pair") == k
    left = [F.coalesce(F.bool_or(of(k) & (F.col("cell") >= 0)), F.lit(False)).alias(f"left{k}") for k in range(len(pairs))]
    found = [F.coalesce(F.max(F.when(of(k) & (F.col("cell") < 0), F.col("n"))), F.lit(0)).alias(f"found{k}") for k in range(len(pairs))]
    counts = cells.groupBy(*keys).agg(*left, *found)
    joined = rows.join(counts, keys, "left")
    each = (F.when(~F.coalesce(F.col(f"left{k}"), F.lit(False)), F.coalesce(F.col(f"found{k}"), F.lit(0))) for k in range(len(pairs)))
    return joined.select(*rows.columns, F.array(*each).alias("differences"))


def likeness(left: str, right: str, difference: Column) -> Column:
    """Share of the paragraphs of both that are shared; 1 for two without any."""
    both = F.size(left) + F.size(right)
    return F.when(both > 0, (both - difference) / both).otherwise(F.lit(1.0))


def likenesses(rows: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """``rows`` with ``near``, the likeness of each pair of columns of digests, in their place.

    Rows of which a pair's table was too small keep their digests and are tried again with
    larger tables, as often as it takes.
    """
    held = sorted({name for pair in pairs for name in pair})
    own, factor, out = [c for c in rows.columns if c not in held], 1, None
    while True:
        tried = difference_counts(rows, keys, pairs, factor)
        near = F.array(*(likeness(left, right, F.get("differences", F.lit(k))) for k, (left, right) in enumerate(pairs)))
        left_over = F.exists("differences", lambda d: d.isNull())
        tried = written(tried.select(*own, F.when(~left_over, near).alias("near"), *(F.when(left_over, F.col(c)).alias(c) for c in held)), "sketches")
        done = tried.where("near IS NOT NULL").select(*own, "near")
        out = done if out is None else out.unionByName(done)
        rows = tried.where("near IS NULL").drop("near")
        if rows.isEmpty():
            return out
        factor *= LARGER


def _followers(keyed: DataFrame, order: list[str]) -> DataFrame:
    """(k1, k2, doc_id, n_chars, copies, and x1, x2 of the next) of each document, equal rows as one; after the last comes the first.

    Rows are numbered over ranges of ids; each looks ahead in its block, to which the first
    row of the next block is added.
    """
    own = ["k1", "k2", "doc_id", "n_chars", "copies"]
    ordered = keyed.groupBy(*order).agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies")).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(ordered.select(*own, F.monotonically_increasing_id().alias("at")), "order")
    part = F.shiftrightunsigned("at", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = {r.part: r.n for r in sizes.collect()}  # a row for each partition
    starts, total = [], 0
    for k in range(max(before, default=-1) + 1):
        starts.append(total)
        total += before.get(k, 0)
    if not total:
        return numbered.select(*own, F.col("k1").alias("x1"), F.col("k2").alias("x2"))
    offsets = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<long>")  # a constant
    row = F.get(offsets, part.cast("int")) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = numbered.select(*own, row.cast("long").alias("row"))
    block = F.expr(f"row div {BLOCK}")
    last = F.struct(F.lit((total - 1) // BLOCK).cast("long").alias("block"), F.lit(total).cast("long").alias("row"))
    here = F.struct(block.alias("block"), F.col("row"))
    back = F.struct((block - 1).alias("block"), F.col("row"))
    places = F.when(F.col("row") == 0, F.array(here, last)).when((F.col("row") % BLOCK == 0), F.array(here, back)).otherwise(F.array(here))
    seen = rows.select(*own, F.explode(places).alias("p")).select(*own, "p.*")
    ahead = Window.partitionBy("block").orderBy("row")
    pairs = seen.select("*", F.lead("k1").over(ahead).alias("x1"), F.lead("k2").over(ahead).alias("x2"))
    return pairs.where((F.col("row") < total) & (F.expr(f"row div {BLOCK}") == F.col("block"))).select(*own, "x1", "x2")


def differing(rows: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """keys, digest and n: the digests that the left column of digests has more (n > 0) or less (n < 0), as peeling recovers them.

    Rows that their table was too small for are tried again with larger ones.
    """
    own, factor, out = {k: f"__{i}" for i, k in enumerate(keys)}, 1, None
    rows = written(rows.select(*(F.col(k).alias(name) for k, name in own.items()), F.col(left).alias("l"), F.col(right).alias("r")), "versions")
    keys = list(own.values())
    while True:
        cells = _added(rows, keys, [("l", "r")], factor)
        for _ in range(ROUNDS):
            cells = _round(cells, keys, True)
        tried = written(cells, "peeled")
        failed = tried.where("cell >= 0").select(*keys).distinct()
        done = tried.where("cell < 0").join(failed, keys, "left_anti").select(*keys, F.col("shown").alias("digest"), "n")
        out = done if out is None else out.unionByName(done)
        if failed.isEmpty():
            return out.withColumnsRenamed({name: k for k, name in own.items()})
        rows = rows.join(failed, keys, "left_semi")
        factor *= LARGER


def edited_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    A document's edited text has the first half of its own and the beginning of the next
    document's, by ascending id.  ``near_``: the share of the paragraphs of both that are
    shared, in whatever order, as the peeled difference of their sketches gives it.

    Paragraphs are lines.  Null text counts as empty, and two texts
    without paragraphs are wholly alike.  Null ids come first; of one id the order is by a hash
    of the text; of rows that are repeated each but one is followed by itself.  Very long texts
    are taken whole, an only row is followed by itself, an empty table gives no rows, and
    further columns, of any name, are ignored.

    Each text is exchanged once, with the beginning of it that the document before needs and
    its digests; sketches are made, subtracted and peeled where the texts are.
    """
    text = text_or_empty(text_col).cast("string")
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select("doc_id", "t", F.xxhash64("doc_id", "t").alias("k1"), F.hash("t", "doc_id").alias("k2"))
    pairs = _followers(keyed.select("doc_id", "k1", "k2", F.length("t").cast("long").alias("n_chars")), ["doc_id", "k1", "k2"])
    pairs = written(pairs, "followers")
    texts = keyed.groupBy("k1", "k2").agg(F.any_value("t").alias("t"))  # both uses below read one exchange, as they take the same columns
    half = F.expr("n_chars div 2").cast("int")
    followed = pairs.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), "n_chars", F.col("x1").alias("k1"), F.col("x2").alias("k2"))
    heads = texts.join(followed, ["k1", "k2"]).select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), F.substring("t", F.lit(1), half).alias("head"), digests(F.col("t")).alias("next_digests"))
    sized = texts.join(pairs.select("k1", "k2", "doc_id", "n_chars", "copies"), ["k1", "k2"]).join(heads, ["k1", "k2"])
    first = F.substring("t", F.lit(1), (F.col("n_chars") - F.expr("n_chars div 2")).cast("int"))
    versions = sized.select(
        "k1",
        "k2",
        "doc_id",
        "n_chars",
        "copies",
        "next_digests",
        digests(F.col("t")).alias("own"),
        F.concat(first, "head").alias("e"),
        F.when(F.col("copies") > 1, F.concat(first, F.substring("t", F.lit(1), half))).alias("e2"),
    )
    again = F.coalesce(digests(F.col("e2")), F.array().cast("array<bigint>"))
    cut = versions.select("k1", "k2", "doc_id", "n_chars", "copies", "own", "next_digests", digests(F.col("e")).alias("edited"), again.alias("edited2"), F.sha2("e", 256).alias("sha"), F.sha2("e2", 256).alias("sha2"))
    prints = [fingerprint(F.col("own")), fingerprint(F.col("edited")), F.when(F.col("copies") > 1, fingerprint(F.col("edited2")))]
    made = cut.select("*", *(p.alias(f"f{k}") for k, p in enumerate(prints)))
    found = likenesses(made, ["k1", "k2"], [("own", "edited"), ("own", "next_digests"), ("own", "edited2")])
    last = found.select("doc_id", "n_chars", "sha", "sha2", "f0", "f1", "f2", "near", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    pick = lambda a, b: F.when(F.col("copy") == 1, a).otherwise(b)
    near = [F.get("near", F.lit(k)) for k in range(3)]
    return last.select(
        "doc_id",
        "n_chars",
        pick(F.col("sha"), F.col("sha2")).alias("edited_sha256"),
        F.col("f0").alias("fingerprint"),
        pick(F.col("f1"), F.col("f2")).alias("edited_fingerprint"),
        pick(near[0], near[2]).alias("near_edited"),
        pick(near[1], F.lit(1.0)).alias("near_next"),
    )
