"""Repair of conversations by the cheapest edits, as a scan of matrices over (min, +).

The roles of a conversation must read ``(s?(ua)+)?``: an automaton of four states.  What a turn
can do, by the edits that it allows and any insertions before it, is a 4x4 matrix of the
cheapest (cost, audit) from state to state; audits are the edits' initials.  Of two different
audits of one cost between the same states neither begins with the other, since insertions
cost; so the lesser stays the lesser whatever comes before or after, and the product of
matrices is associative.  A task multiplies the turns that it has, whatever conversation they
are of; conversations that go over borders of tasks are finished by a tree of products.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.common import written

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (BEGIN, ASSISTANT)
#: Where a role's initial leads from each state.
STEPS = {"s": {BEGIN: SYSTEM}, "u": {BEGIN: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
#: Parts of one conversation that a node of the tree takes, as a power of two.
FAN = 4
SPACE = r"[\x20\x09-\x0D]"

Matrix = tuple  # four rows of four entries (cost, audit), None for no way


def times(left: Matrix, right: Matrix) -> Matrix:
    """The product over (min, +), audits joined; of equal costs the lesser audit."""
    out = []
    for row in left:
        ways = [(k, e) for k, e in enumerate(row) if e]
        new = []
        for j in range(4):
            best = None
            for k, (cost, audit) in ways:
                after = right[k][j]
                if after:
                    total = cost + after[0]
                    if best is None or total <= best[0]:
                        way = total, audit + after[1]
                        if best is None or way < best:
                            best = way
            new.append(best)
        out.append(tuple(new))
    return tuple(out)


def _insertions() -> Matrix:
    """Any number of insertions: none, one, or two lead to all states that more do, for less."""
    one = [[None] * 4 for _ in range(4)]
    for initial in "ua":
        for a, b in STEPS[initial].items():
            one[a][b] = (INSERT, "I")
    none = tuple(tuple((0, "") if a == b else None for b in range(4)) for a in range(4))
    least = lambda x, y: tuple(tuple(min((e for e in pair if e), default=None) for pair in zip(a, b)) for a, b in zip(x, y))
    upto = least(none, one)
    return times(upto, upto)


CLOSURE = _insertions()


def turn_matrix(initial: str, must_go: bool, truncated: bool) -> Matrix:
    """One turn's edits, with any insertions before it."""
    ways: list[list] = [[None] * 4 for _ in range(4)]
    for a in range(4):
        found = {a: [(DELETE, "D")]}
        if not must_go:
            extra = TRUNCATED if truncated else 0
            for role in "ua":
                if a in STEPS[role]:
                    found.setdefault(STEPS[role][a], []).append((REROLE + extra, "R"))
            if a in STEPS.get(initial, ()):
                found.setdefault(STEPS[initial][a], []).append((extra, "K"))
        for b, entries in found.items():
            ways[a][b] = min(entries)
    return times(CLOSURE, tuple(map(tuple, ways)))


def product(matrices: list[Matrix]) -> Matrix:
    """In order, as a balanced tree, so that audits are joined about log n times."""
    while len(matrices) > 1:
        paired = [times(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
        matrices = paired + matrices[len(matrices) & ~1 :]
    return matrices[0]


def cheapest(matrix: Matrix | None) -> tuple[int, str]:
    """(cost, audit) of a conversation with this product; of no turns at all nothing."""
    if matrix is None:
        return 0, ""
    row = times((matrix[BEGIN],), CLOSURE)[0]
    return min(row[e] for e in ENDS if row[e])


#: What is known of some consecutive turns; turns that damage has dropped leave only their conversation's name.
SUMMARY = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64())]
ENDPOINTS = [("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string())]
COSTS, AUDITS = ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))
PART = [*SUMMARY, *ENDPOINTS, COSTS, AUDITS]
PART_SQL = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string, costs array<long>, audits array<string>"


class Part:
    """A run of turns of one conversation: counts, its ends, and the product of its matrices."""

    __slots__ = ("counts", "turns", "first", "last", "initials", "matrix")

    def __init__(self, counts=(0, 0, 0, 0), turns=0, first=None, last=None, initials=None, matrix=None):
        self.counts, self.turns, self.first, self.last, self.initials, self.matrix = list(counts), turns, first, last, initials, matrix

    def row(self) -> tuple:
        first, last = self.initials or (None, None)
        flat = [e for r in self.matrix for e in r] if self.matrix else None
        return (*self.counts, self.turns, self.first, self.last, first, last, flat and [e and e[0] for e in flat], flat and [e and e[1] for e in flat])

    @classmethod
    def of_row(cls, row: dict) -> Part:
        matrix = None
        if row["costs"] is not None:
            flat = [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])]
            matrix = tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4))
        initials = None if row["first_initial"] is None else (row["first_initial"], row["last_initial"])
        return cls([row[c] for c in ("blank", "duplicate", "truncated", "illegal")], row["turns"], row["first_turn"], row["last_turn"], initials, matrix)

    @classmethod
    def joined(cls, parts: list[Part]) -> Part:
        """Parts that follow each other as one."""
        out = cls()
        for p in parts:
            for i, n in enumerate(p.counts):
                out.counts[i] += n
            if p.initials:
                if out.initials:
                    out.counts[3] += out.initials[1] + p.initials[0] not in LEGAL
                out.initials = (out.initials or p.initials)[0], p.initials[1]
            out.turns += p.turns - (p.turns > 0 and out.last is not None and out.last == p.first)
            if p.first is not None:
                out.first = p.first if out.first is None else out.first
                out.last = p.last
        matrices = [p.matrix for p in parts if p.matrix]
        out.matrix = product(matrices) if matrices else None
        return out


class _Turns:
    """Gathers the turns of a part as they come; products wait for another of as many turns, so each audit is joined about log n times."""

    LEAVES = 256
    kinds: dict[tuple, Matrix] = {}

    def __init__(self):
        self.part, self.open, self.done = Part(), [], []

    def add(self, turn, initial, fault, n: int = 1) -> None:
        """A turn, or n equal ones."""
        kind = initial, fault in ("blank", "duplicate"), fault == "truncated"
        matrix = self.kinds.get(kind)
        if matrix is None:
            matrix = self.kinds[kind] = turn_matrix(*kind)
        p = self.part
        if fault:
            p.counts[("blank", "duplicate", "truncated").index(fault)] += n
        if p.initials:
            p.counts[3] += p.initials[1] + initial not in LEGAL
        p.counts[3] += n - 1  # no role may follow itself
        p.initials = (p.initials or (initial,))[0], initial
        if turn is not None:
            p.turns += turn != p.last
            p.first = turn if p.first is None else p.first
            p.last = turn
        self.open.append(matrix if n == 1 else product([matrix] * n))
        if len(self.open) == self.LEAVES:
            self.done.append((1, product(self.open)))
            self.open = []
            while len(self.done) > 1 and self.done[-1][0] == self.done[-2][0]:
                (size, left), (_, right) = self.done[-2:]
                self.done[-2:] = [(2 * size, times(left, right))]

    def close(self) -> Part:
        found = [m for _, m in self.done] + ([product(self.open)] if self.open else [])
        self.part.matrix = product(found) if found else None
        return self.part


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, copy, role and text of the turns after damage, and ``gone`` for those that it drops.

    The crc32 of ``conv:turn`` decides: of 20 remainders 0 drops a turn, 1 empties its text, 2
    takes out sentence ends, 3 repeats it, 4 makes it the user's.  Nulls are read as one space.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(or_space(id_col), F.lit(":"), or_space(turn_col))
    rows = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), or_space(role_col).alias("r"), or_space(text_col).alias("t"), (F.crc32(key.cast("binary")) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("t", "[.!?]", "")).otherwise(F.col("t"))
    copies = F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", F.explode(copies).alias("copy"), F.when(F.col("d") == 4, "user").otherwise(F.col("r")).alias("role"), text.alias("text"), (F.col("d") == 0).alias("gone"))


def _ordered(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """With two hashes of role and text, and the columns that order the turns of a conversation."""
    hashed = rows.withColumns({f"h{i}": F.xxhash64(F.lit(i), "role", "text") for i in (1, 2)})
    return hashed, ["turn", "role", "h1", "h2", "copy"]


def _faults(rows: DataFrame) -> DataFrame:
    """conv, order columns, initial, fault and n (equal turns) of each turn without its text; of turns that are gone, only their conversation.

    A turn is a duplicate if one with its role and text comes before it, so all but one of equal
    turns are; those are counted in parts before the exchange, as are the first places of texts
    that occur at several.
    """
    hashed, _ = _ordered(rows)
    bare = F.regexp_replace("text", f"{SPACE}+$", "")  # what is left ends with the last sign that is no space
    own = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).rlike("^[.!?]$"), "truncated")
    there = lambda c, name: F.when(~F.col("gone"), c).alias(name)
    keys = [there(F.col(c), c) for c in ("turn", "role", "h1", "h2")] + [there(F.substring("role", 1, 1), "initial"), there(own, "own")]
    small = hashed.groupBy("conv", "gone", *keys).agg(F.count("*").alias("n"))
    seen = small.where(~F.col("gone")).groupBy("conv", "h1", "h2").agg(F.count("*").alias("places"), F.min(F.struct("turn")).alias("at")).where("places > 1")
    first = seen.select(F.col("conv").alias("c"), F.col("h1").alias("x1"), F.col("h2").alias("x2"), "at")
    joined = small.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")), "left")
    again = F.col("at").isNotNull() & ~F.col("turn").eqNullSafe(F.col("at.turn"))
    fault = F.when(F.coalesce(F.col("own") != "blank", F.lit(True)) & again, "duplicate").otherwise(F.col("own"))
    return joined.select("conv", "turn", "role", "h1", "h2", "gone", "initial", fault.alias("fault"), "n")


def _parts(kind: pa.DataType):
    """A task's side: its sorted turns into parts; ``open`` marks those whose conversation may go on in another task."""
    names = ["conv", "task", "open", *(n for n, _ in PART)]
    types = [kind, pa.int64(), pa.bool_(), *(t for _, t in PART)]

    def batch_of(rows):
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    def run(batches):
        now, turns, task, first, ready = None, None, None, True, []
        for batch in batches:
            for conv, turn, initial, fault, gone, n, own_task in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if turns is None or conv != now:
                    if turns is not None:
                        ready.append((now, task, first, *turns.close().row()))
                        first = False
                    now, turns, task = conv, _Turns(), own_task
                if not gone:
                    turns.add(turn, initial, fault)
                    if n > 1:
                        turns.add(turn, initial, fault if fault == "blank" else "duplicate", n - 1)
            if len(ready) > 5000:
                yield batch_of(ready)
                ready = []
        if turns is not None:
            ready.append((now, task, True, *turns.close().row()))
        yield batch_of(ready)

    return run


def _node(kind: pa.DataType):
    names = ["conv", "task", *(n for n, _ in PART)]

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["task"])
        whole = Part.joined([Part.of_row(r) for r in rows])
        columns = [[rows[0]["conv"]], [rows[0]["task"]], *([v] for v in whole.row())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, pa.int64(), *(t for _, t in PART)])], names=names)

    return join


def _finished(kind: pa.DataType):
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                p = Part.of_row(row)
                gaps = 0 if p.first is None else p.last - p.first + 1 - p.turns
                rows.append((row["conv"], gaps, *p.counts, *cheapest(p.matrix)))
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [kind, *[pa.int64()] * 6, pa.string()])], names=names)

    return run


def diagnosed(turns: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of ``damaged`` turns.

    Turns are dealt by ranges of (conversation, place), so a conversation of any length is
    shared by tasks.  A task finishes conversations that lie inside it; its first and last
    parts go up a tree whose nodes join 2 ** ``FAN`` neighbours.
    """
    spark = turns.sparkSession
    small = _faults(turns)
    key = small.schema["conv"].dataType.simpleString()
    kind = pa.string() if key == "string" else pa.int64()
    if key not in ("string", "bigint"):
        small = small.withColumn("conv", F.col("conv").cast("string"))
        key, kind = "string", pa.string()
    order = ["conv", "turn", "role", "h1", "h2"]
    dealt = small.repartitionByRange(*order).sortWithinPartitions(*order)
    cells = dealt.select("conv", "turn", "initial", "fault", "gone", "n", F.spark_partition_id().cast("long").alias("task"))
    parts = written(cells.mapInArrow(_parts(kind), f"conv {key}, task long, open boolean, {PART_SQL}"), "parts")
    whole = parts.where("not open").drop("open", "task")
    rest = parts.where("open").drop("open")
    tasks = parts.agg(F.max("task").alias("n")).first().n or 0
    level = 0
    while True:
        level += FAN
        up = F.shiftright("task", level)
        rest = rest.groupBy("conv", up.alias("node")).applyInArrow(_node(kind), f"conv {key}, task long, {PART_SQL}")
        if tasks >> level == 0:
            break
        rest = written(rest, "nodes")
    both = whole.unionByName(rest.drop("task"))
    return both.mapInArrow(_finished(kind), f"conv {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def apply_edits(audit: str, at: int, state: int, role: str, text: str) -> tuple[list[tuple[str, str]], int, int]:
    """(turns that come out, place in the audit, state) after one more turn, with the insertions before it."""
    out = []
    while audit[at] == "I":
        role_in = "a" if state == USER else "u"
        out.append((NAMES[role_in], ""))
        state, at = STEPS[role_in][state], at + 1
    edit = audit[at]
    if edit == "K":
        out.append((role, text))
        state = STEPS[role[:1]][state]
    elif edit == "R":
        role_in = "a" if state == USER else "u"
        out.append((NAMES[role_in], text))
        state = STEPS[role_in][state]
    return out, at + 1, state


def last_insertions(audit: str, at: int, state: int) -> list[tuple[str, str]]:
    """Turns that the rest of the audit inserts at the end."""
    out = []
    for _ in audit[at:]:
        role_in = "a" if state == USER else "u"
        out.append((NAMES[role_in], ""))
        state = STEPS[role_in][state]
    return out


def _stream(kind: pa.DataType, counts: list[str], emit_turns: bool):
    """Rows of each conversation, first its audit, then its turns, into repaired turns or their digest; one turn is held at a time."""

    def run(batches):
        now, state, at, audit, place, head, digest, ready, size = None, BEGIN, 0, "", 0, None, None, [], 0

        def put(turns):
            nonlocal place, size
            for role, text in turns:
                if emit_turns:
                    ready.append((now, place, role, text))
                    size += len(text)
                else:
                    digest.update((b"\n" if place else b"") + f"{role}:{text}".encode())
                place += 1

        def close():
            put(last_insertions(audit, at, state))
            if not emit_turns:
                ready.append((now, *head, audit, digest.hexdigest()))

        def batch_of():
            columns = list(zip(*ready))
            if emit_turns:
                names, types = ["conv", "place", "role", "text"], [kind, pa.int64(), pa.string(), pa.string()]
            else:
                names, types = ["conv", *counts, "audit", "repaired_sha256"], [kind, *[pa.int64()] * len(counts), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns or [[]] * len(names), types)], names=names)

        for batch in batches:
            column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for i, (conv, own_audit, role, text) in enumerate(zip(column["conv"], column["audit"], column["role"], column["text"])):
                if own_audit is not None:
                    if head is not None:
                        close()
                    now, audit, state, at, place, head, digest = conv, own_audit, BEGIN, 0, 0, [column[c][i] for c in counts], hashlib.sha256()
                else:
                    turns, at, state = apply_edits(audit, at, state, role, text)
                    put(turns)
                if len(ready) > 5000 or size > 4 << 20:
                    yield batch_of()
                    ready, size = [], 0
        if head is not None:
            close()
        yield batch_of()

    return run


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _edited(turns: DataFrame, emit_turns: bool) -> DataFrame:
    found = written(diagnosed(turns), "audits")
    key = found.schema["conv"].dataType.simpleString()
    kind = pa.string() if key == "string" else pa.int64()
    order = ["conv", "turn", "role", "h1", "h2", "copy"]
    hashed, _ = _ordered(turns.where(~F.col("gone")))
    none = F.lit(None)
    texts = hashed.select(F.col("conv").cast(key).alias("conv"), F.lit(1).alias("kind"), "turn", "role", "h1", "h2", "copy", "text", none.cast("string").alias("audit"), *(none.cast("long").alias(c) for c in COUNTS))
    heads = found.select("conv", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), *(none.cast("long").alias(h) for h in ("h1", "h2")), none.cast("int").alias("copy"), none.cast("string").alias("text"), "audit", *COUNTS)
    rows = heads.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "kind", *order[1:])
    schema = f"conv {key}, place long, role string, text string" if emit_turns else f"conv {key}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    return rows.select("conv", "audit", "role", "text", *COUNTS).mapInArrow(_stream(kind, COUNTS, emit_turns), schema)


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    A turn's first fault counts: blank (nothing but white space), duplicate (its role and text
    came before), truncated (its last sign ends no sentence).  Keeping a turn costs nothing,
    giving it the role that fits 2, deleting it 3, which blank ones and duplicates need;
    inserting a turn costs 2, a truncated turn that stays 1.  Of equal costs the audit that's
    least in ASCII counts.

    Nulls are read as one space and come first in the order of turns; a null id is a
    conversation of its own.  Turns of one number are ordered by role, then a hash of role and
    text; of repeated rows all but one are duplicates.  Texts are taken whole.  A conversation of which damage
    left no turn has zeros, no audit and the digest of nothing.  An empty table gives no rows;
    further columns, of any name, are ignored.

    Analysis shares a conversation of any length among tasks.  Its digest can't be: SHA-256 is
    sequential, so one task streams through the texts of a conversation, holding one at a time
    and the audit.
    """
    ids = conversations.schema[id_col].dataType
    found = _edited(damaged(conversations, id_col, turn_col, role_col, text_col), False)
    return found.select(F.col("conv").cast(ids).alias(id_col), *COUNTS[:5], "cost", "audit", "repaired_sha256")


def repaired_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns of given conversations after their repair: id, place (from 0), role, text.  Nothing is damaged before."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    whole = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.lit(0).alias("copy"), or_space(role_col).alias("role"), or_space(text_col).alias("text"), F.lit(False).alias("gone"))
    return _edited(whole, True).withColumnRenamed("conv", id_col)

