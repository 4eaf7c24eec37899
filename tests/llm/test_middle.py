"""Fill-in-middle arrangements against a plain version, SQL, and on odd rows."""

import hashlib
import re
from collections import Counter

import duckdb
from test_documents import TEXTS, frame

from sitepulse.llm import middle, queries

ODD = [
    *TEXTS,
    (20, "has <P> in it"),
    (21, "almost <S <M P>"),
    (22, "<"),
    (23, "<<<<S<S<S M><M"),
    (24, "x"),
    (25, "𝒳y é\r\n z"),
    *((100 + i, f"text {i} <{'S' * (i % 3)} of some words, é日 <M {'<' * (i % 5)}") for i in range(60)),
]


def plainly(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def test_arrange(spark):
    found = middle.arrange(frame(spark, ODD)).collect()
    assert Counter(tuple(r) for r in found) == Counter(plainly(*x) for x in ODD)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert middle.digest(middle.arrange(frame(spark, []))).collect() == []


def test_arrange_is_native(spark):
    plan = middle.digest(middle.arrange(frame(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan


def test_arrange_sql(spark, tmp_path):
    frame(spark, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(queries.ORACLE_SQL["op13_fill_in_middle"])
    names = [c[0] for c in want.description]
    found = queries.op13_fill_in_middle(spark, str(tmp_path))
    assert found.columns == names
    assert Counter(map(tuple, found.collect())) == Counter(want.fetchall())
