"""Encoding keeps ids in the database, and cuts texts at spaces as the pattern does."""

import random

import public_tokenizers
import tiktoken

from lumengrid.llm import bpe


def test_pieces_are_decoded_where_they_were_encoded(monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    own = bpe.Coder(path, public_tokenizers.PATTERN)
    monkeypatch.setattr(own, "decode_ids", None)  # ids need not become numbers again
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "a", "words", "é", "😀", "17", "'s", "!!", "x" * 60]
    texts = ["", " ", *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(2000))]
    for _ in range(2):  # the second time from what is kept
        for text, (ids, n, back) in zip(texts, own.code(texts), strict=True):
            assert (list(map(int, ids.split(","))) if ids else [], n, back) == (other.encode_ordinary(text), len(other.encode_ordinary(text)), text.encode())
