"""Toxic words in runs of spaced letters and in chunks."""

import itertools
import time

import numpy as np
import pytest

from sitepulse.llm import toxicity


@pytest.fixture(scope="module")
def scorer():
    counts = np.zeros((toxicity.N,) * 3)
    for word in ["idiot", "stupid", "moron", "you", "are", "an", "the", "and", "letter", "ass"] * 50:
        symbols = [0, 0, *(toxicity.SYMBOL[c] for c in word), 0]
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
            counts[a if b else 0, b, c] += 1
    return toxicity.Scorer(toxicity.Model(counts, {"=idiot": 5.0, "=stupid": 4.0, "=ass": 3.0}))


@pytest.mark.parametrize("text, weight", [
    ("y o u a r e a n i d i o t", 5), ("y o u  i d i o t", 5), ("i\nd\ni\no\nt", 5), ("so i\td\ti\to\tt there", 5), ("y o u a r e a n i d 1 0 t", 5),
    ("you stu pid thing", 4), ("you st up\nid thing", 4), ("a s s", 3), ("the letter and you", 0),
])
def test_spaced_words(scorer, text, weight):
    assert scorer.summary(text)[0] == weight


def test_letters_are_segmented_into_words(scorer):
    assert scorer.restorer.segment("y o u a r e a n i d i o t") == ["you", "are", "an", "idiot"]


def test_viterbi_equals_enumeration():
    """The decoded word has the least cost of all ways through the lattice."""
    rng = np.random.default_rng(4)
    restorer = toxicity.Restorer(rng.integers(0, 50, (toxicity.N,) * 3).astype(float))
    signs = list("abeglostz013457@$!|(.-")
    for _ in range(150):
        text = "".join(rng.choice(signs, rng.integers(1, 6)))

        def cost(ways):
            total, state = 0.0, (0, 0)
            for price, letters in ways:
                total += price
                for letter in letters:
                    symbol = toxicity.SYMBOL[letter]
                    total += float(restorer.cost[state][symbol])
                    state = state[1], symbol
            return total + (float(restorer.cost[state][0]) if state != (0, 0) else 0.0)

        every = {}
        for ways in itertools.product(*restorer.lattice(text)):
            word = "".join(letters for _, letters in ways)
            every[word] = min(every.get(word, 1e9), cost(ways))
        assert every[restorer.restore(text)] == pytest.approx(min(every.values()), abs=1e-4)


def test_long_runs_take_no_time():
    """Signs that were letter and separator at once made the search exponential; long words were copied for each letter."""
    restorer = toxicity.Scorer(toxicity.Model(np.ones((toxicity.N,) * 3), {"=idiot": 3.0}))
    for text in ("_" * 5000 + "ab", "_ " * 5000 + "ab", "a_" * 5000 + "bc", "- " * 5000, "a " * 20_000 + "bc", "x" + "-" * 50_000 + "y", "1a" * 100_000, "ab " * 20_000 + "longerword"):
        began = time.perf_counter()
        restorer.summary(text)
        assert time.perf_counter() - began < 20
    assert restorer.weight("1d10t") == 3.0 and restorer.summary("y o u\ti\nd i o t")[0] == 3.0


def test_time_is_linear():
    """Twice the signs take about twice the time, also where a weighted word begins like the runs."""
    scorer = toxicity.Scorer(toxicity.Model(np.ones((toxicity.N,) * 3), {"=idiot": 3.0, "=ass": 2.0, "=aaaa": 2.0}))

    def took(text):
        began = time.perf_counter()
        scorer.seen.clear()
        scorer.summary(text)
        return time.perf_counter() - began

    for make in (lambda n: "x" + "-" * n + "y", lambda n: "a " * (n // 2), lambda n: "a_ " * (n // 3) + "bc", lambda n: "-" * n, lambda n: "a_a-" * (n // 4) + "bc", lambda n: "ab " * (n // 3) + "longerword"):
        half, whole = min(took(make(100_000)) for _ in range(2)), took(make(200_000))
        assert whole < 2.5 * half + 0.3, make(12)


def test_bare():
    assert [toxicity._bare(x) for x in ("--a-b--", "---", "", "a", "-é1!")] == ["a-b", "", "", "a", "é1"]
