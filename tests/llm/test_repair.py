"""Conversation repair against a plain version that tries all edits, on odd rows, and over borders of tasks."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sitepulse.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, copy string, conv string, audit string"
SPACES = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "v", "a") for r in rows], SCHEMA).repartition(3)


def dealt(rows):
    """Damage by the contract's words."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for c, own in out.items()}


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.rstrip(SPACES)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(turns, found):
    """The least (cost, audit, repaired turns) of all edits, by states of a plain search."""
    grammar = re.compile(r"(s?(ua)+)?")
    n, best = len(turns), None
    options = []
    for (_, role, text), fault in zip(turns, found):
        ways = [(3, "D", None)]
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            ways += [(more, "K", (role, text))] + [(2 + more, "R", (r, text)) for r in ("user", "assistant")]
        options.append(ways)
    inserts = [()] + [(a,) for a in ("user", "assistant")] + [("user", "assistant"), ("assistant", "user")]
    for ways in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=n + 1):
            kept = []
            audit, cost = "", 0
            for i in range(n + 1):
                for r in gaps[i]:
                    kept.append((r, ""))
                    audit, cost = audit + "I", cost + 2
                if i < n:
                    cost, audit = cost + ways[i][0], audit + ways[i][1]
                    if ways[i][2]:
                        kept.append(ways[i][2])
            if grammar.fullmatch("".join(r[:1] or "-" for r, _ in kept)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, kept
    return best


def plainly(rows):
    out = []
    for conv, turns in dealt(rows).items():
        found = faults(turns)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(turns, turns[1:])]
        cost, audit, kept = cheapest(turns, found)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return Counter(out)


def short(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for k in range(rng.randrange(1, 4)):
            turn = rng.choice([k, k, k, 2 * k, None])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice([f"t{k}.", f"t{k}.", "same!", "cut", " \t", "", None, "a? \n"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repair(spark, seed):
    rows = short(seed)
    tied = {c for c, turns in dealt(rows).items() if len({t[:2] for t in turns}) < len(set(turns))}  # different texts of one turn and role have no order by the contract
    rows = [r for r in rows if r[0] not in tied]
    assert len({r[0] for r in rows}) > 30
    assert Counter(tuple(r) for r in repair.repair(frame(spark, rows)).collect()) == plainly(rows)


def test_odd_rows(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:5".encode()) % 20 == 0)
    rows = [(None, None, None, None), (None, 3, "user", "x."), (dropped, 5, "user", "gone."), (7_000, 10**12, "user", "far."), (7_000, 1, "assistant", "near."), (7_001, 2, "user", "é日\r\n."), (7_001, 2, "user", "é日\r\n.")]
    found = repair.repair(frame(spark, rows)).collect()
    assert Counter(map(tuple, found)) == plainly(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in set(map(tuple, found))
    assert repair.repair(frame(spark, [])).collect() == []


def one_by_one(turns):
    """(cost, audit) by states, turn after turn."""
    row = tuple((0, "") if i == 0 else None for i in range(4))
    for (_, role, _), fault in zip(turns, faults(turns)):
        row = repair.times((row,), repair.turn_matrix(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))[0]
    row = repair.times((row,), repair.CLOSURE)[0]
    return min(row[e] for e in repair.ENDS if row[e])


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_long_conversation_over_many_tasks(spark, partitions):
    """Most turns are of one conversation, which goes over all tasks."""
    rng = random.Random(5)
    rows = [(9, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"text {t}.", f"text {t}", "again.", ""])) for t in range(3000) if t % 11]
    rows += [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in (8, 10, 11) for t in range(4)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.conv_id: r for r in repair.repair(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for conv, turns in dealt(rows).items():
        assert (found[conv].cost, found[conv].audit) == one_by_one(turns)
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(turns, turns[1:])]
        assert found[conv].illegal == sum(p not in repair.LEGAL for p in pairs)
        numbers = [t for t, _, _ in turns]
        assert found[conv].gaps == max(numbers) - min(numbers) + 1 - len(set(numbers))
        state, at, kept = 0, 0, []
        for _, role, text in turns:
            more, at, state = repair.apply_edits(found[conv].audit, at, state, role, text)
            kept += more
        kept += repair.last_insertions(found[conv].audit, at, state)
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
        assert found[conv].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def test_products_are_associative():
    rng = random.Random(3)
    kinds = [repair.turn_matrix(i, go, cut) for i in "sua " for go in (False, True) for cut in (False, True)]
    for _ in range(200):
        chosen = [rng.choice(kinds) for _ in range(rng.randrange(1, 12))]
        one = chosen[0]
        for m in chosen[1:]:
            one = repair.times(one, m)
        assert one == repair.product(chosen)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "tool", "x."), (2, 0, "user", "")]
    found = repair.repaired_turns(frame(spark, rows)).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in found] == [(1, 0, "user", ""), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "assistant", "x.")]
