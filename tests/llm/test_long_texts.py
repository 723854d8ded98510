"""Tokens of long texts and long pieces."""

import random

import numpy as np
import public_tokenizers
import regex
import tiktoken

from tillhouse.llm.byte_bpe import Coder, read_ranks


def test_byte_bpe_of_long_texts_and_long_pieces():
    coder = Coder(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    pattern = public_tokenizers.PATTERN
    tool = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})
    text = "one two, three é " * 600_000
    ids = coder.encode([regex.findall(pattern, text)])[0]
    assert len(ids) > 4 * 2_500_000
    assert coder.decode([b"", ids, ids[:8]]) == [b"", text.encode(), coder.decode([ids[:8]])[0]]
    rng = random.Random(6)
    for piece in ("a" * 400_001, "".join(rng.choice("etaoin") for _ in range(400_000)), "é日" * 4_000):
        assert regex.findall(pattern, piece) == [piece]
        ids = coder.encode([[piece]])[0]
        assert np.frombuffer(ids, "<u4").tolist() == tool.encode_ordinary(piece)
