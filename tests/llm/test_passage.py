"""Shared passages of over 50 words go by their bytes: 400 are removed, 399 stay, whatever else repeats."""

import random

import pytest

import corpus_pipeline
from lumengrid.llm import suffixarray
from lumengrid.llm.common import prepare
from tests.llm import fixture as fx


@pytest.mark.parametrize(("size", "length", "gone"), [(399, 400, 0), (400, 400, 400), (394, 400, 0), (394, corpus_pipeline.PASSAGE, 394)])
def test_passage(spark, size, length, gone):
    rng = random.Random(size)
    passage = fx.prose(rng, 200)[: size - 1].rstrip() + "z"
    passage += "z" * (size - len(passage))
    assert len(passage.encode()) == size and len(fx.words(passage)) > 50
    # no byte beside the passage agrees with another document's
    texts = [fx.prose(rng, 90) + left + passage + right + fx.prose(rng, 90) for left, right in ("AB", "CD", "EF")]
    docs = prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fx.rows(suffixarray.deduplicate(docs, length))
    for i, text in enumerate(texts):
        left = text.replace(passage, "") if gone else text
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(text), gone, int(gone > 0), left.encode())
