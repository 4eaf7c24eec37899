import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitepulse.llm.bpe import PieceEncoder
from sitepulse.llm.queries import tokenizer_path

SIGNS = list("ab Z 1 9 \n\t  .,!'s'tédß日　 ​’½ª$#") + ["'ll", " re", "<|endoftext|>", "\r\n", "\x00", "\x1c"]


@pytest.fixture(scope="module", params=[{}, {"max_pieces": 300, "batch_chars": 500}])
def encoder(request):
    return PieceEncoder(tokenizer_path(), offsets=True, **request.param)


def equal(encoder, texts):
    for text, (ids, begins, ends) in zip(texts, encoder.encode(texts)):
        want = encoder.tokenizer.encode(text, add_special_tokens=False)
        assert ids.tolist() == want.ids and list(zip(begins.tolist(), ends.tolist())) == want.offsets, text


def test_odd_texts(encoder):
    rng = random.Random(1)
    equal(encoder, ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 50))) for _ in range(3000)])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=8))
def test_any_texts(encoder, texts):
    equal(encoder, texts)


def test_documents(encoder, spark, sf_dir):
    equal(encoder, [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()])
