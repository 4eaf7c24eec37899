"""Offsets inside a piece of more than 65,535 code points."""

from sitepulse.llm.bpe import PieceEncoder
from sitepulse.llm.queries import tokenizer_path


def test_long_white_space():
    encoder = PieceEncoder(tokenizer_path(), offsets=True)
    text = "a" + "\n \t " * 20_000 + "b"
    ((ids, begins, ends),) = encoder.encode([text])
    want = encoder.tokenizer.encode(text, add_special_tokens=False)
    assert ids.tolist() == want.ids and list(zip(begins.tolist(), ends.tolist())) == want.offsets


def test_another_pre_tokenizer_goes_to_the_library():
    encoder = PieceEncoder(tokenizer_path("word_bpe_49k.json"))
    texts = ["Hello  World 123\n\nagain", "", "d'été won't"]
    assert not encoder.cuts and PieceEncoder(tokenizer_path()).cuts
    assert [ids.tolist() for (ids,) in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
