"""Quality rules: counts over whole texts, and a log-likelihood ratio of hashed n-grams.

The ratio compares two multinomials over a fixed number of hash buckets (runs of four bytes): one of
trusted texts, one of the whole corpus; a document's sum is divided by its number of n-grams. The bucket
tables have a fixed size, so that they are broadcast. Corpus counts cover every document, trusted counts
every document that a label gives quality 1.

A null text counts as empty: no words, which fails the base rules. Without trusted documents, or in an
empty table, the ratio is 0 for every document and only the base rules reject. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.llm import textkernel as tk
from lumengrid.llm.common import lean, texts, with_trusted

#: Buckets, added count, least mean log ratio of a kept document.
BUCKETS, ADDED, LEAST = 1 << 16, 1.0, -0.75
#: Bytes of an n-gram, and steps of a log ratio.
GRAM, UNIT = 4, 1 << 20
#: Base rules: least words, and largest share of repeated words in percent.
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = np.zeros(256, dtype=np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1


def buckets(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of GRAM bytes inside a row, and where each row's begin (one more for the end)."""
    n = np.maximum(np.diff(c.offsets) - GRAM + 1, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    if not first[-1]:
        return np.zeros(0, np.int64), first
    size = len(c.data) - GRAM + 1
    whole = np.ones(len(c.data), dtype=bool)
    for k in range(1, GRAM):
        whole[np.maximum(c.offsets[1:] - k, c.offsets[:-1])[np.diff(c.offsets) > 0]] = False
    value = np.zeros(size, dtype=np.uint32)
    for k in range(GRAM):
        value |= c.data[k : k + size].astype(np.uint32) << np.uint32(8 * k)
    value = value[whole[:size]] * np.uint32(2654435761)
    return ((value ^ (value >> np.uint32(15))) >> np.uint32(33 - BUCKETS.bit_length())).astype(np.int64), first


def multinomials(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of trusted to corpus probability by bucket, in whole UNITths so that sums are exact; zeros if nothing is trusted."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for c in tk.chunks(batch.column(0)):
                where, first = buckets(c)
                total[0] += np.bincount(where, minlength=BUCKETS)
                own = np.repeat(good[c.lo : c.hi], np.diff(first))
                total[1] += np.bincount(where[own], minlength=BUCKETS)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], names=["bucket", "raw", "trusted"])

    rows = with_trusted(texts(docs), labels).select("text", "trusted").mapInArrow(lean(count), "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw"), F.sum("trusted")).collect()
    counts = np.zeros((2, BUCKETS))
    for bucket, raw, own in rows:
        counts[:, bucket] = raw, own
    if not counts[1].any():
        return np.zeros(BUCKETS, dtype=np.int64)
    logs = np.log((counts + ADDED) / (counts.sum(axis=1, keepdims=True) + ADDED * BUCKETS))
    return np.rint((logs[1] - logs[0]) * UNIT).astype(np.int64)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[at])


def repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row, the words inside 3-word windows that the row has twice or more."""
    row = tk.row_of(first)
    if len(row) < 3:
        return np.zeros(len(first) - 1, np.int64)
    whole = np.flatnonzero(row[2:] == row[:-2])
    keys = tk.mix(tk.window_hashes(hashes, 3, seed=3)[whole] ^ tk.mix(row[whole].astype(np.uint64) + np.uint64(1)))
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    at = whole[count[inverse] > 1]
    covered = np.zeros(len(row), dtype=bool)
    for k in range(3):
        covered[at + k] = True
    return _sums(covered, first)


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and llr (the mean log ratio)."""
    ratio = docs.sparkSession.sparkContext.broadcast(multinomials(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = ratio.value
        for batch in batches:
            for c in tk.chunks(batch.column(1)):
                w = tk.words(c)
                hashes = tk.word_hashes(c, w)
                n = np.diff(w.first)
                inside = ~tk.IS_SPACE[c.data] & ((c.data & 0xC0) != 0x80)
                repeated = repeated_words(hashes, w.first)
                plain = c.data.tobytes()
                lines = [duplicate_lines(plain[a:b]) for a, b in zip(c.offsets[:-1], c.offsets[1:], strict=True)]
                where, first = buckets(c)
                llr = _sums(logs[where], first) / UNIT / np.maximum(np.diff(first), 1)
                failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)
                arrays = [batch.column(0).slice(c.lo, c.hi - c.lo), *(pa.array(x) for x in (n, _sums(inside, c.offsets), _sums(SYMBOLS[c.data], c.offsets), np.array(lines, np.int64), repeated, failed, ~failed & (llr >= LEAST), llr))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
    return texts(docs).mapInArrow(lean(run), schema)
