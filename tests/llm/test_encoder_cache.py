"""Pieces that texts go on using are encoded once, however many others come between."""

import numpy as np
import public_tokenizers
import pytest

from wavetally.llm import bpe


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_frequent_pieces_are_not_encoded_again(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library, merger, asked = Tokenizer.from_file(path), bpe.Merger(bpe.vocabulary(path)), []

    def words(found):
        asked.extend(found)
        return merger.words(found)

    encoder = bpe.TextEncoder(bpe.vocabulary(path), words=words, most=60)
    rng = np.random.default_rng(3)
    for _ in range(40):
        rare = ["".join(rng.choice(list("abcdefgh"), 9)) for _ in range(25)]
        texts = ["often used words, " + " ".join(rare), "", " <|endoftext|> x", "a\n b"]
        got = [np.frombuffer(x, "<u2").tolist() for x in encoder.texts([t.encode() for t in texts])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(w.strip() == b"used" for w in asked) == 1
    assert len(encoder.known) + len(encoder.old) < 4 * 60
