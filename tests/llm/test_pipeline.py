"""The pipeline against brute force, stage by stage, on the smallest data."""

from collections import Counter

import pytest
from test_documents import TEXTS, frame, low_words
from test_jaccard import kept

import __spark_entry__ as entry


def test_stages(spark, sf_dir):
    import corpus_pipeline
    from sitepulse.llm import quality, suffix
    from sitepulse.llm.common import table, written

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    bench = [low_words(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    windows = {tuple(b[j : j + min(10, len(b))]) for b in bench if b for j in range(max(1, len(b) - 9))}
    sizes = {len(w) for w in windows}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir), "stage")
        before, after = docs.collect(), out.collect()
        if name != "best-fit packing":
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        if name == "quality rules":
            good = {r.doc_id for r in quality.report(docs).where("kept").collect()}
            assert {r.doc_id for r in after} == good and 0 < len(good) < len(before)
        elif name == "SimHash near-dedup":
            assert sorted(r.doc_id for r in after) == kept([(r.doc_id, r.text) for r in before]) and len(after) < len(before)
        elif name == "suffix-array dedup":
            own = [r.text.encode() for r in before]
            counts = Counter(hash(t[i : i + 250]) for t in own for i in range(len(t) - 249))
            got = {r.doc_id: r for r in after}
            assert len(got) == len(before)
            for r, t in zip(before, own):
                spans = suffix.unite([(i, i + 250) for i in range(len(t) - 249) if counts[hash(t[i : i + 250])] > 1])
                spans = suffix.inward(t, suffix.passages(t, spans, 50, 400))
                assert got[r.doc_id].text == suffix.cut(t, spans).decode() and got[r.doc_id].n_chars == len(got[r.doc_id].text)
            assert [r.text for r in after] != [r.text for r in before]
        elif name == "benchmark decontamination":
            clean = {r.doc_id for r in before if not any(tuple(w[p : p + n]) in windows for w in [low_words(r.text)] for n in sizes for p in range(len(w) - n + 1))}
            assert {r.doc_id for r in after} == clean
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
        docs = out


@pytest.mark.parametrize("n", range(5))
def test_stages_on_odd_rows(spark, sf_dir, n):
    """Null, empty and long texts, repeated rows and an empty table: columns stay, nothing breaks."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[n]
    rows = [*TEXTS, *TEXTS[:3], (50, "passage of words that repeat " * 20), (51, "x " + "passage of words that repeat " * 20)]
    docs = frame(spark, rows)
    out, none = stage(spark, docs, sf_dir), stage(spark, frame(spark, []), sf_dir)
    assert none.count() == 0
    found = out.collect()
    if n == 4:
        assert Counter(r.doc_id for r in found if r.piece == 0) == Counter(i for i, _ in rows)
        return
    assert out.columns == none.columns == docs.columns and out.schema.simpleString().replace("struct", "") == docs.schema.simpleString().replace("struct", "")
    ids = Counter(r.doc_id for r in found)
    if n == 0:
        assert ids == Counter({5: 1})
    elif n == 1:
        assert sorted(-1 if i is None else i for i in ids.elements()) == kept(rows)
    elif n == 2:
        assert ids == Counter(i for i, _ in rows) and sorted(str(r.text) for r in found if r.doc_id in (2, 3)) == ["", "", "None", "None"]
    else:
        assert ids == Counter(i for i, _ in rows)


def test_run(spark, sf_dir):
    assert entry.queries()["pipeline"](spark, sf_dir).count() > 0


@pytest.mark.parametrize("n", range(1, 11))
def test_each_operator_has_a_query(n):
    assert len([q for q in entry.queries() if q.startswith(f"op{n}_")]) == 1


def test_decontamination_equals_sql(spark, sf_dir):
    import duckdb

    from sitepulse.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLE_SQL["op9_decontamination"])
    got = QUERIES["op9_decontamination"](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_toxicity_held_out_accuracy(spark):
    from sitepulse.llm import toxicity

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in found)
    assert right >= 0.9 * len(found) and not any(r.predicted and not r.toxic for r in found)
