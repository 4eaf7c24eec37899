"""Every operator on odd rows: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitepulse.llm import attribution, decontam, idstore, notices, packing, quality, queries, sharding, simhash, suffix, toxicity
from sitepulse.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k1 string, shard string, length string, found string"
LONG = " ".join(f"word{i} of a long text" for i in range(6000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.\nAll rights reserved.\n\nCC BY text 12 34"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, LONG),
    (6, "same text here twice " * 30),
    (6, "same text here twice " * 30),
    (7, "same text here twice " * 30),
    (None, "no id but text, l'été 日本語 ﷽ don't"),
    (None, None),
    (8, "Licensed under the Apache Licence, Version 2.0 by ###$$$ someone"),
    (9, "a b"),
    (10, "The quick brown fox jumps over the lazy dog and then runs far away from all the other foxes"),
]


def frame(spark, texts=None):
    rows = [(i, t, "en", None, None if t is None else len(t), "r", "k", "s", "l", "f") for i, t in (TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_shard(spark):
    found = sharding.shard(frame(spark), 3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    by = defaultdict(list)
    for r in found:
        assert r.law == "rows" and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == [4, 4, 5] and all(sorted(s) == list(range(len(s))) for s in by.values())
    again = sharding.shard(frame(spark).repartition(1), 3).collect()
    place = lambda rows: sorted(((r.doc_id or 0, r.size, r.text_crc32), r.shard, r.slot) for r in rows)
    assert place(found) == place(again)
    assert sharding.shard(frame(spark, []), 3).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_permutation(n):
    p = sharding.Permutation(n, 9)
    at = p.position(np.arange(n))
    assert sorted(at.tolist()) == list(range(n)) and p.row(at).tolist() == list(range(n))


def test_quality(spark):
    found = {(r.doc_id, r.n_words): r for r in quality.report(frame(spark)).collect()}
    for i, t in TEXTS:
        ws = words(t)
        r = found[i, len(ws)]
        lines = [x for x in (t or "").split("\n") if words(x)]
        windows = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
        covered = {j for k in range(len(ws) - 7) if windows[tuple(ws[k : k + 8])] > 1 for j in range(k, k + 8)}
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(ws) < 20 or 100 * len(covered) > 30 * len(ws))
        assert not (r.base_failed and r.kept)
    kept = quality.keep(frame(spark))
    assert kept.columns == frame(spark).columns
    assert [r.doc_id for r in kept.collect()] == [5]
    order = quality.order_rules(frame(spark))
    assert {x[0].name for x in order} == {r.name for r in quality.RULES}
    assert quality.report(frame(spark, [])).count() == quality.keep(frame(spark, [])).count() == 0


def test_quality_sql(spark, tmp_path):
    import duckdb

    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = db.execute(queries.ORACLE_SQL["op5_quality_rules"])
        assert [c[0] for c in want.description] == names
        assert Counter(want.fetchall()) == Counter(tuple(r) for r in queries.op5_quality_rules(spark, str(tmp_path)).select(names).collect())


def test_quality_is_native(spark):
    plan = quality.report(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_are_timed_on_one_sample(spark):
    docs = spark.range(4000).select(F.concat_ws(" ", F.sequence(F.lit(0), F.col("id") % 60)).alias("text"))
    shares = [{rule.name: share for rule, share, _ in quality.order_rules(docs)} for _ in range(2)]
    assert shares[0] == shares[1] and 0.1 < shares[0]["short"] < 0.6


def test_rule_order_leaves_verdict(spark):
    df = frame(spark)
    text = F.coalesce("text", F.lit(""))
    verdicts = [[r.v for r in df.select("doc_id", quality.cascade(rules, text, quality.words(text)).isNull().alias("v")).orderBy("doc_id").collect()] for rules in (quality.RULES, quality.RULES[::-1])]
    assert Counter(verdicts[0]) == Counter(verdicts[1])


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    base = [list(rng.choice(vocabulary, 400)) for _ in range(6)]
    texts = list(TEXTS)
    for i, b in enumerate(base):
        for k in range(12):
            copy = list(b)
            copy[int(rng.integers(400))] = "edit"
            texts.append((100 + 20 * i + k, " ".join(copy)))
    found = simhash.near_duplicates(frame(spark, texts)).collect()
    assert len(found) == len(texts)

    import xxhash

    def fingerprint(t):
        ws = (t or "").encode().lower().split()
        shingles = ([b" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or [b" ".join(ws)]) if ws else []
        counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))

    prints = [fingerprint(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    want = Counter((i, f"{prints[k]:016x}", least.get(root(k))) for k, (i, _) in enumerate(texts))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == want
    assert len({r.component_id for r in found}) < len({p for p in prints})  # some differ and are linked
    kept = simhash.keep_one(frame(spark, texts))
    assert kept.columns == frame(spark).columns and kept.count() == len({root(k) for k in range(len(texts))})
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.keep_one(frame(spark, [])).count() == 0


def test_links_of_crowded_leaves(spark, monkeypatch):
    rng = np.random.default_rng(4)
    center = rng.integers(0, 1 << 63, 1)[0]
    values = {int(center) ^ sum({1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 6))}) for _ in range(300)}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    monkeypatch.setattr(simhash, "CHUNK", 40)
    from sitepulse.llm.components import connected_components

    found = {r.node: r.component for r in connected_components(simhash.links(fps, 2, leaf=60)).collect()}
    values = sorted(values)
    label = dict(zip(values, values))
    for _ in values:
        for a in values:
            label[a] = min(label[b] for b in values if (a ^ b).bit_count() <= 2)
        if all(label[a] == label[b] for a in values for b in values if (a ^ b).bit_count() <= 2):
            break
    assert {v: found.get(v, v) for v in values} == label


def removed(texts, least):
    counts = Counter(hash(t[i : i + least]) for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if counts[hash(t[i : i + least])] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("least, pairs", [(8, 96), (20, 96), (12, 2)])
def test_suffix(spark, monkeypatch, least, pairs):
    monkeypatch.setattr(suffix, "PAIRS", pairs)
    rng = np.random.default_rng(least)
    base = ["".join(rng.choice(list("abé "), rng.integers(1, 90))) for _ in range(12)]
    texts = list(TEXTS[:4]) + list(TEXTS[5:])
    for i in range(90):
        text = ""
        for _ in range(rng.integers(0, 4)):
            b = base[rng.integers(len(base))]
            at = int(rng.integers(len(b)))
            text += b[at : at + int(rng.integers(1, 60))] + "xyz" * int(rng.integers(0, 9))
        texts.append((1000 + i, text))
    short = 2 * least // 3
    found = suffix.digest(frame(spark, texts), least, (short, 0)).collect()
    own = [(t or "").encode() for _, t in texts]
    want = [(*w, x[1]) for w, x in zip(removed(own, least), removed(own, short))]
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_bytes) for r in found) == Counter((i, *w) for (i, _), w in zip(texts, want))
    cut = suffix.remove_repeats(frame(spark, texts), least)
    assert [r.text for r in cut.collect() if r.doc_id == 2] == [None]
    assert cut.columns == frame(spark).columns and cut.count() == len(texts)
    assert suffix.digest(frame(spark, []), least).count() == 0


def test_suffix_of_documents(spark, sf_dir):
    """The query over its table: repeats of 400 bytes, and passages of 50 words, by brute force."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    own = [(r.text or "").encode() for r in docs]
    found = {r.doc_id: r for r in queries.op3_suffix_dedup(spark, sf_dir).collect()}
    for r, want in zip(docs, removed(own, 400)):
        assert tuple(found[r.doc_id])[:5] == (r.doc_id, *want)
    counts = Counter(hash(t[i : i + 250]) for t in own for i in range(len(t) - 249))
    for r, t in zip(docs, own):
        spans = suffix.unite([(i, i + 250) for i in range(len(t) - 249) if counts[hash(t[i : i + 250])] > 1])
        assert found[r.doc_id].n_passage_bytes == sum(b - a for a, b in spans if len(t[a:b].split()) >= 50 or b - a >= 400)
    assert sum(r.n_removed > 0 for r in found.values()) > 10


def test_merge_never_compares_known_prefixes():
    rng = np.random.default_rng(1)
    strings = [bytes(rng.choice([97, 98], rng.integers(30, 60)).astype(np.uint8)) for _ in range(200)]
    runs = [sorted(strings[k::5]) for k in range(5)]
    packed = [suffix.Run(suffix.Run.pack([(s, 30, False, 1, 2, 3) for s in run])) for run in runs]
    out, before = [], b""
    for shared, run in suffix.merge(packed):
        assert shared == suffix.common_prefix(before, run.text)
        before = run.text
        out.append(before)
    assert out == sorted(strings)


def test_ids_in_files(spark, tmp_path):
    path = str(tmp_path / "ids")
    idstore.write_ids(frame(spark), path, tokenizer_path(), block_ids=50)
    found = sorted(idstore.read_ids(spark, path).collect(), key=lambda r: r.start)
    tokens = library()
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in found] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))
    want = Counter()
    for i, t in TEXTS:
        ids = np.array([*tokens.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    some = idstore.ids_of(spark, path, spark.createDataFrame([(6,), (1,), (99,), (1,)], "doc_id long")).collect()
    assert Counter(r.doc_id for r in some) == Counter({6: 2, 1: 1})
    for r in some:
        assert r.ids == [*tokens.encode(dict(TEXTS)[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens) in {(x.start, x.n_tokens) for x in found if x.doc_id == r.doc_id}
    idstore.write_ids(frame(spark, []), str(tmp_path / "none"), tokenizer_path())
    assert idstore.read_ids(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 7], list(range(0, 3000, 3)), [1 << 33, 1 << 34], sorted(np.random.default_rng(2).integers(0, 1 << 20, 1500).tolist())])
def test_elias_fano(values):
    code = idstore.EliasFano.from_bytes(idstore.EliasFano.of(values).to_bytes())
    assert code.select(np.arange(len(values))).tolist() == values
    some = np.random.default_rng(3).integers(0, max(len(values), 1), 40) if values else []
    assert code.select(some).tolist() == [values[i] for i in some]


@pytest.mark.parametrize("each", [3, 700, 60_000])
def test_elias_fano_takes_few_bits(each):
    """2 + log2(ids a document) bits a document, and 32 for every 256th as a sample."""
    lengths = np.random.default_rng(4).integers(1, 2 * each, 5000)
    code = idstore.EliasFano.of(np.cumsum(lengths))
    assert code.n_bits / 5000 <= 2 + np.log2(lengths.mean()) + 1 + 32 / 256
    assert code.select(np.arange(5000)).tolist() == np.cumsum(lengths).tolist()


def test_scratch_tables_go(spark):
    from sitepulse.llm import common

    with common.scratch(spark):
        inside = common.written(spark.range(5), "inside")
        outside = common.kept(inside, "outside")
        assert inside.count() == 5
    assert outside.count() == 5
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(inside.inputFiles()[0]).count()


def test_pack(spark):
    found = packing.pack(frame(spark), tokenizer_path(), 64).collect()
    tokens = library()
    want = Counter()
    for i, t in TEXTS:
        ids = np.array([*tokens.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 64 or 64
        edges = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    import bisect

    rooms, n = [], 0
    for length in sorted((r.length for r in found), reverse=True):  # best fit, one at a time
        k = bisect.bisect_left(rooms, length)
        n += k == len(rooms)
        bisect.insort(rooms, (64 if k == len(rooms) else rooms.pop(k)) - length)
    assert len(bins) == n
    assert packing.pack(frame(spark, []), tokenizer_path(), 64).count() == 0
    assert packing.pack_texts(packing.pack(frame(spark), tokenizer_path(), 64)).count() == n


def test_plan_equals_best_fit():
    import bisect

    rng = np.random.default_rng(6)
    for _ in range(30):
        capacity = int(rng.integers(1, 60))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 300)).tolist()
        plan = packing.best_fit_plan(Counter(lengths), capacity)
        used, counts = Counter(), Counter(lengths)
        for length in sorted(counts, reverse=True):
            own = plan[plan[:, 0] == length]
            for (_, rank, start, each, offset), last in zip(own.tolist(), [*own[1:, 1].tolist(), counts[length]]):
                for k in range(last - rank):
                    assert used[start + k // each] == offset + k % each * length
                    used[start + k // each] += length
        rooms, n = [], 0
        for length in sorted(lengths, reverse=True):
            k = bisect.bisect_left(rooms, length)
            n += k == len(rooms)
            bisect.insort(rooms, (capacity if k == len(rooms) else rooms.pop(k)) - length)
        assert len(used) == n and max(used.values()) <= capacity


@pytest.mark.parametrize("rule", attribution.RULES)
def test_token_counts(spark, rule):
    found = attribution.count_tokens(frame(spark), tokenizer_path(), rule=rule).collect()
    tokens = library()
    want = Counter()
    for i, t in TEXTS:
        t = t or ""
        enc = tokens.encode(t, add_special_tokens=False)
        edges = [0, *(m.end() for m in re.finditer(r"\n+", t) if 0 < m.end() < len(t)), len(t)]
        counts, crossing = [0] * (len(edges) - 1), [0] * (len(edges) - 1)
        for a, b in enc.offsets:
            shares = [max(0, min(b, y) - max(a, x)) for x, y in zip(edges, edges[1:])]
            home = next(k for k, s in enumerate(shares) if s) if rule == "start" else shares.index(max(shares))
            counts[home] += 1
            crossing[home] += sum(s > 0 for s in shares) > 1
        for k, (x, y) in enumerate(zip(edges, edges[1:])):
            want[i, k, x, y, counts[k], crossing[k], len(enc.ids)] += 1
    assert Counter(tuple(r) for r in found) == want
    assert attribution.count_tokens(frame(spark, []), tokenizer_path()).count() == 0


def test_majority_of_a_crossing_token():
    edges = np.array([0, 4, 5])
    home, crossing = attribution.allocate(np.array([3, 3, 4]), np.array([6, 5, 5]), edges, "majority")
    assert home.tolist() == [0, 0, 1] and crossing.tolist() == [True, True, False]


def test_notices(spark):
    found = notices.scan(frame(spark)).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        text = next(t for i, t in TEXTS if i == r.doc_id and len(low_words(t)) == r.n_words)
        ws = low_words(text)
        starts = [k for p in notices.PHRASES for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        assert (r.n_base, r.first_word, r.last_word) == (len(starts), min(starts, default=None), max(starts, default=None))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    by = {r.doc_id: r for r in found}
    assert by[1].labels == "cc-by,reserved" and by[8].base_labels == "" and by[8].labels == "apache-2.0"
    span = by[8].spans[0]
    assert (span.start_word, span.edits) == (0, 1) and span.end_word == 8
    assert notices.scan(frame(spark, [])).count() == 0


def test_notice_edits_within_the_bound():
    rng = np.random.default_rng(8)
    search = notices.NoticeSearch()
    for number, notice in enumerate(search.notices):
        for _ in range(20):
            text = list(notice.text)
            for at in rng.choice(np.arange(1, len(text) - 1), notice.edits, replace=False):
                text[at] = "q"
            assert any(n == number for *_, n, _ in search.spans("some words before " + "".join(text) + " and after"))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def fuzzy(text, notice):
    """All runs of whole words within the notice's edits; of overlapping ones the fewest edits, then the first."""
    starts = [0, *(i + 1 for i, c in enumerate(text) if c == " ")]
    stops = [*(i for i, c in enumerate(text) if c == " "), len(text)]
    every = [(edits(text[a:b], notice.text), a, b) for a in starts for b in stops if abs(b - a - len(notice.text)) <= notice.edits]
    out = []
    for n, a, b in sorted(x for x in every if x[0] <= notice.edits):
        if all(b <= x or a >= y for _, x, y in out):
            out.append((n, a, b))
    return sorted((a, n) for n, a, b in out)


@pytest.mark.parametrize(
    "text",
    [
        "released under the mit licence released under the mit license",
        "all rights reserved all rihts reserved all rights reserved",
        "all right reserved all rights reserved",
        "x all rights reservd y all rights reserved z all rights reserved",
        "licensed under cc by licensed under cc bx licenced under cc by and more",
        "apache license version 2 0 licensed under the apache licence version 2 0 and apache lisense version 2 0",
    ],
)
def test_notices_in_a_row(text):
    search = notices.NoticeSearch()
    found = search.spans(text)
    for number, notice in enumerate(search.notices):
        assert [(a, e) for a, _, n, e in found if n == number] == fuzzy(text, notice)


def test_notices_equal_brute_force():
    rng = np.random.default_rng(21)
    search = notices.NoticeSearch()
    for _ in range(150):
        text = []
        for _ in range(rng.integers(1, 5)):
            notice = list(search.notices[rng.integers(len(search.notices))].text)
            for at in rng.integers(0, len(notice), rng.integers(0, 4)):
                notice[at] = str(rng.choice(["", "q", "e", "ra"]))
            text += ["".join(notice), *rng.choice(["the", "and", "license", "under"], rng.integers(0, 3))]
        text = " ".join(" ".join(text).split())
        found = search.spans(text)
        for number, notice in enumerate(search.notices):
            assert sum(n == number for *_, n, _ in found) == len(fuzzy(text, notice)), (text, notice)


def test_notices_take_linear_time():
    search, took = notices.NoticeSearch(), []
    for n in (5_000, 10_000):
        text = " ".join(["all rigts reserved"] * n)
        began = time.perf_counter()
        found = search.spans(text)
        took.append(time.perf_counter() - began)
        assert len([x for x in found if search.notices[x[2]].label == "reserved"]) == n
    assert took[1] < 4 and took[1] < 3 * took[0] + 0.2


def test_notices_in_long_words():
    search = notices.NoticeSearch()
    text = "x" * 3000 + " all rights reservd " + "y" * 5000 + " all rights reserved z"
    assert [(text[a:b], e) for a, b, n, e in search.spans(text) if search.notices[n].label == "reserved"] == [("all rights reservd", 1), ("all rights reserved", 0)]


ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog and then"),
    (2, "same text here"),
    (3, None),
    (4, ""),
    (5, "B a b"),
    (5, "dog and then runs far away from all the other things"),
    (None, "word1 of a long text word2 of a long text word3"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40, 3])
def test_contamination(spark, block_bytes):
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, row string")
    annotated = decontam.contamination(frame(spark).select("doc_id", "text"), bench, block_bytes=block_bytes)
    plan = annotated._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1  # blocks that are done are read from their tables
    lengths = {(r.doc_id, r.n_words): r for r in annotated.collect()}
    want = Counter()
    for i, t in TEXTS:
        ws, hit, items, longest = low_words(t), set(), set(), (0, 0, True, "")
        for item, s in ITEMS:
            q = low_words(s)
            n = min(10, len(q))
            for j in range(len(q) - n + 1 if q else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == q[j : j + n]:
                        hit |= set(range(p, p + n))
                        items |= {str(item)} - {"None"}
                        run = n
                        while p + run < len(ws) and j + run < len(q) and ws[p + run] == q[j + run]:
                            run += 1
                        longest = min(longest, (-run, p, item is None, str(item)))
        want[i, len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)] += 1
        got = lengths[i, len(ws)]
        assert (got.longest_words, got.longest_start, got.longest_item) == ((-longest[0], longest[1], None if longest[2] else longest[3]) if hit else (0, None, None))
    found = decontam.contamination(frame(spark), bench, block_bytes=block_bytes)
    assert Counter(tuple(r)[:6] for r in found.collect()) == want
    clean = decontam.remove_contaminated(frame(spark), bench)
    assert clean.columns == frame(spark).columns and clean.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontam.contamination(frame(spark, []), bench).count() == 0
    assert decontam.contamination(frame(spark), bench.limit(0)).where("contaminated").count() == 0


def test_toxicity_on_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 11)] + [(None, 1, None), (4, None, None)], "doc_id long, toxic int, text string")
    model = toxicity.fit(frame(spark), labels)
    found = toxicity.score(frame(spark), model).collect()
    assert len(found) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert toxicity.score(frame(spark, []), toxicity.fit(frame(spark, []), labels.limit(0))).count() == 0


def test_restores_disguised_words():
    counts = np.zeros((toxicity.N,) * 3)
    for word in ["idiot", "moron", "stupid", "loser", "worthless", "trash", "letter", "the", "and"] * 50:
        symbols = [0, 0, *(toxicity.SYMBOL[c] for c in word), 0]
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
            counts[a if b else 0, b, c] += 1
    restorer = toxicity.Restorer(counts)
    for disguised, word in {"1d10t": "idiot", "m0r0n": "moron", "stuuupid": "stupid", "l.o.s.e.r": "loser", "w0rthl3ss": "worthless", "tr@$h": "trash", "i-d-i-0-t": "idiot"}.items():
        assert word in restorer.words(disguised), disguised
    assert restorer.words("letter,") == ["letter"] and restorer.words("2024") == [] and restorer.words("thoner$$$") == ["thoner"]
    assert "idiot" in toxicity.Scorer._tokens("you i d i o t there")
