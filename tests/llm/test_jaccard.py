"""The near-copy stage against brute-force Jaccard similarity."""

import numpy as np
import pytest
from test_documents import TEXTS, frame

from sitepulse.llm import jaccard


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def kept(rows):
    """Ids that brute force keeps: the least of each component."""
    own = [sets(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both >= 0.8 * (len(own[i]) + len(own[j]) - both) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return sorted(min((r[0] for r, x in zip(rows, label) if x == y and r[0] is not None), default=-1) for y in set(label))


def test_packed_sets():
    for text in ("", "a b", " ".join(map(str, range(3000)))):
        own = jaccard.shingles(text)
        assert jaccard.unpack_set(jaccard.pack_set(own)).tolist() == [int(x) >> 24 for x in own.tolist()]


@pytest.mark.parametrize("small", [12, 0])
def test_near_copies(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows = list(TEXTS)
    for i in range(8):
        base = list(rng.choice(vocabulary, 150))
        for k in range(10):
            copy = list(base)
            for at in rng.integers(0, 150, rng.integers(0, 5)):
                copy[at] = f"edit{at}"
            rows.append((100 + 20 * i + k, " ".join(copy)))
    found = jaccard.keep_one(frame(spark, rows))
    assert found.columns == frame(spark).columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in found.collect()) == kept(rows)
    assert jaccard.keep_one(frame(spark, [])).count() == 0


def family(n, words, edits, twin_edits, seed):
    """Texts that are alike, but mostly not enough, each with a twin that is."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    out = []
    for i in range(n // 2):
        own = list(base)
        for at in rng.choice(words, edits, replace=False):
            own[at] = f"e{rng.integers(0, 3000)}"
        twin = list(own)
        for at in rng.choice(words, twin_edits, replace=False):
            twin[at] = f"t{rng.integers(0, 3000)}"
        out += [" ".join(own), " ".join(twin)]
    return out


def recall(spark, texts, least=0.8):
    """Share of the pairs of ``least`` or more that end in one component, and how many pairs there are."""
    own = [sets(t) for t in texts]
    found = {r.doc_id: r.root for r in jaccard.near_copies(frame(spark, list(enumerate(texts)))).collect()}
    tokens: dict = {}
    member = np.zeros((len(own), len({tokens.setdefault(x, len(tokens)) for s in own for x in s})), np.float32)
    for i, s in enumerate(own):
        member[i, [tokens[x] for x in s]] = 1
    both = member @ member.T
    size = member.sum(1)
    u, v = np.nonzero(np.triu(both >= least * (size[:, None] + size[None] - both) - 1e-6, 1))
    return np.mean([found[a] == found[b] for a, b in zip(u.tolist(), v.tolist())]), len(u)


@pytest.mark.parametrize("n, edits, twin_edits", [(1400, 9, 4), (1400, 6, 3), (3000, 14, 4)])
def test_no_link_of_a_crowd_is_lost(spark, n, edits, twin_edits):
    """A large bucket of texts that are mostly less similar than 0.8."""
    share, pairs = recall(spark, family(n, 300, edits, twin_edits, 7))
    assert pairs >= n // 4 and share == 1.0


def test_rarest_shingles_miss_no_pair(spark, monkeypatch):
    """Without any rounds of centers but the first."""
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "SMALL", 0)
    share, pairs = recall(spark, family(300, 100, 3, 1, 3) + family(300, 40, 1, 1, 4))
    assert pairs > 300 and share == 1.0


def test_stage_of_the_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in found.collect()) == kept([(r.doc_id, r.text) for r in docs.collect()])


def test_fingerprints_alone_unite_close_copies(spark, sf_dir, monkeypatch):
    """The stage without bands: copies whose SimHash fingerprints are within two bits, through the pivot tables, verified."""
    import corpus_pipeline
    from sitepulse.llm.simhash import majority

    rng = np.random.default_rng(9)
    rows = []
    for i in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        changed = [*base[:399], "changed"]
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(changed)), (10 * i + 2, " ".join(base[:200]))]
    close = []
    fps = [majority(jaccard.shingles(t)) for _, t in rows]
    for a in range(len(rows)):
        close += [(rows[a][0], rows[b][0]) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert len(close) >= 30 and all(a == b + 1 for a, b in close)
    none = jaccard._apart
    monkeypatch.setattr(jaccard, "_apart", lambda members, turn: none(members, turn).where("false"))
    found = corpus_pipeline.near_dedup(spark, frame(spark, rows), sf_dir)
    assert sorted(r.doc_id for r in found.collect()) == sorted({i for i, _ in rows} - {a for a, _ in close})


def test_found_pairs_are_within_bits():
    from sitepulse.llm.simhash import forest

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(6))]))
    pivots = rng.integers(0, 1 << 63, 16, np.uint64)
    for against in (None, fps[1::2]):
        own = fps if against is None else fps[::2]
        u, v = forest(own, pivots, 2, against, True)
        assert len(u) > 60 and (np.bitwise_count(u.view(np.uint64) ^ v.view(np.uint64)) <= 2).all()
        label = {}
        for links in ((u, v), forest(own, pivots, 2, against)):
            part = {x: x for x in np.concatenate(links).tolist()}
            for a, b in zip(*(x.tolist() for x in links)):
                a, b = part[a], part[b]
                part = {k: min(a, b) if x in (a, b) else x for k, x in part.items()}
            label[len(label)] = part
        assert label[0] == label[1]
