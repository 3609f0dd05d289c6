"""The encoder's limits on replays and caches change its memory, never its ids."""

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken

from llm import bpe


@pytest.mark.parametrize("replay, learn, long, cache", [(1, 1, 0, 0), (40, 3, 4, 5), (200_000, 20_000, 64, 60_000)])
def test_ids_are_the_librarys_under_any_limits(monkeypatch, replay, learn, long, cache):
    monkeypatch.setattr(bpe, "REPLAY_BYTES", replay)
    monkeypatch.setattr(bpe, "LEARN_PIECES", learn)
    monkeypatch.setattr(bpe, "LONG", long)
    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    library = tiktoken.Encoding("test", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long_word = "unaccountability" * 300
    texts = ["", " ", "one two  three \n four ", long_word, f"a {long_word} b {long_word}", "naïve çà 漢字 🙂 x\t\ty", "same words same words", "same words same words", "1234567890 it's we'll\n\n"]
    encoder = bpe.Encoder(ranks, tokenizers.PATTERN, cache)
    for _ in range(2):  # with empty and with filled caches
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [library.encode(t, disallowed_special=()) for t in texts]
        assert [encoder.decode(x) for x in encoder.encode(texts)] == [t.encode() for t in texts]
    assert all(len(p) <= long for c in (encoder.first, encoder.later, encoder.words) for p in c)


def test_a_piece_of_one_word_holds_no_second_copy_of_its_ids():
    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        encoder = bpe.Encoder(bpe.parse_ranks(f.read()), tokenizers.PATTERN)
    encoder.encode(["one unaccountabilities two,three"])
    assert encoder.later["unaccountabilities"] is encoder.words[" unaccountabilities"]
    assert encoder.decode(encoder.later["two,three"]) == b" two,three"
