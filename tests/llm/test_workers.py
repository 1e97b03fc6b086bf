"""A worker that goes on to another operator drops what the one before has kept."""

import sys

from lumengrid.llm import bpe, common, packing, secrets


def run(batches):
    yield from batches


def test_caches_go_when_another_operator_begins(monkeypatch):
    monkeypatch.setitem(bpe._coders, ("a", "b"), None)
    monkeypatch.setitem(packing._loaded, "a", None)
    secrets.known()
    assert set(common.KEEPERS) <= sys.modules.keys()
    run.__module__ = packing.__name__
    assert list(common.lean(run)([1])) == [1]
    assert not bpe._coders and not secrets.ranks.cache_info().currsize and "a" in packing._loaded
    bpe._coders["a", "b"] = None
    assert list(common.lean(run)([1])) == [1] and bpe._coders  # the same operator again: nothing is looked for
