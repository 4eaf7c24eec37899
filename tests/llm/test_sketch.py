"""Sketches of paragraphs against a plain version, on odd rows, and where tables are too small."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_documents import TEXTS, frame

from sitepulse.llm import sketch

ODD = [
    *TEXTS,
    (30, "a\nb\nc\nd\ne\nf\ng\nh"),
    (31, "a\nb\nc\nd\ne\nf\ng\nh"),
    (32, "a\nb\nc\nd\nx\ny\nz\n" + "a\n" * 50),
    (33, "One.\nTwo!\nThree?\nFour.\n日本。\n𝒳𝒴𝒵.\nSeven"),
    (34, "\n".join(f"line {i} of many" for i in range(3000))),
    (35, "\n".join(f"line {i} of many" for i in range(1500)) + "\nend"),
]


def paragraphs(text):
    return Counter(p for p in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", p))


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    both = a.total() + b.total()
    return 1.0 if not both else (both - ((a - b).total() + (b - a).total())) / both


def plainly(rows, following):
    """following: the text after each row, by (id, text)."""
    out = Counter()
    for (i, t), n in Counter((i, t or "") for i, t in rows).items():
        for copy in range(n):
            after = following[i, t] if copy == 0 else t
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            out[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(t, edited), 9), round(alike(t, after), 9)] += 1
    return out


def shown(rows):
    return Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)


def following(spark, rows):
    """Rows of one id are ordered by hashes that only Spark has."""
    df = frame(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("t")).distinct()
    order = [(r.doc_id, r.t) for r in df.orderBy("doc_id", F.xxhash64("doc_id", "t")).collect()]
    return dict(zip(order, [t for _, t in order[1:] + order[:1]]))


@pytest.mark.parametrize("least, load", [(16, 1.0), (1, 0.05)])
def test_edited_versions(spark, monkeypatch, least, load):
    """Also with tables that are far too small at first."""
    monkeypatch.setattr(sketch, "LEAST_CELLS", least)
    monkeypatch.setattr(sketch, "LOAD", load)
    monkeypatch.setattr(sketch, "BLOCK", 4)
    found = sketch.edited_versions(frame(spark, ODD)).collect()
    assert shown(found) == plainly(ODD, following(spark, ODD))
    prints = {(t or ""): None for _, t in ODD}
    for r in found:
        assert r.fingerprint and r.edited_fingerprint
    by_id = {r.doc_id: r for r in found}
    assert by_id[30].fingerprint == by_id[31].fingerprint != by_id[32].fingerprint
    assert len({r.fingerprint for r in found}) >= len(prints) - 3  # those without paragraphs have one


@pytest.mark.parametrize("rows", [[], [(1, "only one\nof two")], [(1, None)], [(2, "same.\nx")] * 3, [(None, None)] * 2])
def test_few_rows(spark, rows):
    assert shown(sketch.edited_versions(frame(spark, rows)).collect()) == plainly(rows, following(spark, rows))


def test_differing_digests(spark):
    """Peeling gives the very digests, and how often."""
    both = spark.createDataFrame([(1, "a\nb\nc\nc\nd", "a\nb\nx\nc"), (2, "", "p.\nq"), (3, "same", "same"), (4, "\n".join(f"p{i}" for i in range(400)), "p1")], "id long, l string, r string")
    rows = both.select("id", sketch.digests(F.col("l")).alias("l"), sketch.digests(F.col("r")).alias("r"))
    names = {r.d: r.p for r in spark.createDataFrame([(p,) for p in ("a", "b", "c", "d", "x", "p.", "q", *(f"p{i}" for i in range(400)))], "p string").select("p", F.get(sketch.digests(F.col("p")), F.lit(0)).alias("d")).collect()}
    found = {(r.id, names[r.digest]): r.n for r in sketch.differing(rows, ["id"], "l", "r").collect()}
    assert found == {(1, "c"): 1, (1, "d"): 1, (1, "x"): -1, (2, "p."): -1, (2, "q"): -1} | {(4, f"p{i}"): 1 for i in range(400) if i != 1}


def test_sketch_is_native(spark):
    plan = sketch.edited_versions(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
