"""Grams that very many rows hold, in different surroundings."""

from collections import Counter

import numpy as np
import pytest
from test_documents import TEXTS, frame, removed

from sitepulse.llm import suffix


@pytest.mark.parametrize("least, hot", [(8, 1), (40, 1), (40, 30)])
def test_hot_grams(spark, monkeypatch, least, hot):
    rng = np.random.default_rng(least + hot)
    base = ["".join(rng.choice(list("abé "), rng.integers(1, 90))) for _ in range(8)]
    passage = "".join(rng.choice(list("abcdefghij"), 60))
    texts = list(TEXTS[:4]) + list(TEXTS[5:])
    for i in range(120):
        around = ["".join(rng.choice(list("abc"), 50)) for _ in range(2)]
        at, stop = int(rng.integers(0, 20)), int(rng.integers(25, 60))  # parts of the passage, shorter or longer than a repeat
        b = base[rng.integers(len(base))]
        texts.append((1000 + i, around[0] + passage[at:stop] + around[1] + b[int(rng.integers(len(b))) :]))
    sizes = []
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "_hot_spans", lambda keyed, places, n, g, f=suffix._hot_spans: sizes.append(places.count()) or f(keyed, places, n, g))
    found = suffix.digest(frame(spark, texts), least, (least // 2, 0)).collect()
    own = [(t or "").encode() for _, t in texts]
    want = [(*w, x[1]) for w, x in zip(removed(own, least), removed(own, least // 2))]
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_bytes) for r in found) == Counter((i, *w) for (i, _), w in zip(texts, want))
    assert sizes and sizes[0] > hot
