"""Packing along a space-filling curve: neighbouring documents share training sequences.

1. Texts become token ids. A vectorised pass cuts them into spaces, words and the rest; a worker encodes each distinct part
   once, keeps the first ones in a bounded table, and texts gather their parts' ids.
2. Hashed token vectors are summed and projected to DIMS dimensions; their direction gives a Hilbert key.
3. Documents are range-sorted by that key (then by hash and id: copies that share a key spread over ranges), and
   running sums place each in one stream of tokens.
4. The stream is cut into sequences of LENGTH tokens; what is left becomes sequences whose lengths are powers of
   two. So there is no padding, and each token lies in exactly one piece.

A null or empty text has the end token alone. Repeated rows are packed each. Other columns are left out.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.llm import textkernel as tk
from lumengrid.llm.common import lean, stored, tasks, texts

#: Tokens of a sequence, the id that ends a document, dimensions and bits of the curve, runs a worker keeps at most.
LENGTH, END_ID, DIMS, BITS, KEPT = 4096, 2, 3, 10, 300_000


#: What the short way through a vocabulary takes for granted: how it prepares a text and cuts it into pre-tokens.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
#: Bytes: 0 for the space, 1 for letters, 2 for digits, other white space and marks that join with no letter, 3 for all else.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[0x20] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[x for x in (*range(9, 14), *range(33, 127)) if _CLASS[x] == 3 and chr(x) not in "'<"]] = 2
#: Second bytes of Latin letters that begin with 0xC3, and of capitals among them.
_SECOND, _CAPITAL = (np.isin(np.arange(256), [x for x in places if x not in (0x97, 0xB7)]) for places in (range(0x80, 0xC0), range(0x80, 0x9F)))


def items(c: tk.Chunk, short: bool) -> tuple[pa.Array, np.ndarray]:
    """A chunk's texts cut into spaces, words of lower-case letters and other parts, and each row's first (one more for the end).

    A stretch between spaces that holds a byte of class 3 stays whole and as it is; so does every one if not short.
    """
    data, starts = c.data, c.offsets[:-1][np.diff(c.offsets) > 0]
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(c.offsets), np.int64)
    kind = _CLASS[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & _SECOND[data[1:]])
    kind[latin] = kind[latin + 1] = 1
    space = kind == 0
    border = np.zeros(len(data), dtype=bool)
    border[1:] = space[1:] != space[:-1]
    border[starts] = True
    at = np.flatnonzero(border)
    whole = np.maximum.reduceat(kind, at) == 3
    if not short:
        whole |= ~space[at]
    whole = np.repeat(whole, np.diff(np.append(at, len(data))))
    kind[whole] = 3
    low = np.where(whole, data, tk.LOWER[data])
    capital = latin[_CAPITAL[data[latin + 1]] & ~whole[latin]] + 1
    low[capital] += 32
    border[1:] = kind[1:] != kind[:-1]
    border[starts] = True
    at = np.flatnonzero(border)
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(low)]), np.searchsorted(at, c.offsets)


class Tokens:
    """Ids of texts, two bytes each, little-endian."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if size > 1 << 16:
            raise ValueError("ids of two bytes are expected")
        if any(self._whole([x])[0] != b"".join(self._whole(x.split(" "))) for x in ("a b", "one  two ", " Ab, c.")):
            raise ValueError("a vocabulary is expected in which spaces separate tokens")
        made = json.loads(self.tokenizer.to_str())
        first = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        ends = made["model"].get("end_of_word_suffix")
        self.short = (made["normalizer"] or {}).get("normalizers") == _NORMALIZERS and first.get("pattern") == {"Regex": _WORDS} and bool(ends)
        if self.short:  # letters go to the merges directly
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(1 << 16, dtype=bool)
            self.last[[i for x, i in made["model"]["vocab"].items() if x.endswith(ends)]] = True
        self.kept: dict[str, bytes] = {}
        at = np.arange(size * DIMS, dtype=np.uint64).reshape(size, DIMS)
        self.vectors = (tk.mix(at + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / (1 << 52) - 1

    def encode(self, c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's texts, END_ID behind each, and where each text's begin (one more for the end)."""
        found, rows = items(c, self.short)
        words = found.dictionary_encode()
        coded = self._coded(words.dictionary.to_pylist())
        size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 2
        flat, first = np.frombuffer(b"".join(coded), dtype="<u2"), np.cumsum(size) - size
        of = words.indices.to_numpy()
        many = size[of]
        upto = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.repeat(first[of] - upto[:-1], many) + np.arange(upto[-1])]
        ends = upto[rows[1:]]
        return np.insert(ids, ends, END_ID), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])

    def _coded(self, distinct: list[str]) -> list[bytes]:
        kept = self.kept
        new = [x for x in distinct if x not in kept]
        fresh = self._words([x for x in new if self.short and _LETTERS.fullmatch(x)])
        rest = [x for x in new if x not in fresh]
        fresh.update(zip(rest, self._whole(rest), strict=True))
        out = [kept[x] if x in kept else fresh[x] for x in distinct]
        kept.update(islice(fresh.items(), max(0, KEPT - len(kept))))
        return out

    def _whole(self, many: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(many), 20_000):
            out += [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch_fast(many[lo : lo + 20_000], add_special_tokens=False)]
        return out

    def _words(self, many: list[str]) -> dict[str, bytes]:
        """Ids of words of lower-case letters: many words in a text, told apart by the tokens that end a word."""
        out: dict[str, bytes] = {}
        for lo in range(0, len(many), 20_000):
            part = many[lo : lo + 20_000]
            found = self.bare.encode_batch_fast([" ".join(part[k : k + 50]) for k in range(0, len(part), 50)], add_special_tokens=False)
            ids = np.array([i for e in found for i in e.ids], dtype="<u2")
            at = np.concatenate([[0], 2 * np.flatnonzero(self.last[ids]) + 2]).tolist()
            raw = ids.tobytes()
            out.update(zip(part, [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))
        return out

    def keys(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hilbert keys of documents that have an id each at least."""
        sums = np.stack([np.add.reduceat(self.vectors[:, d][ids], at[:-1]) for d in range(DIMS)], axis=1)
        unit = sums / np.maximum(np.sqrt((sums**2).sum(axis=1, keepdims=True)), 1e-12)
        return hilbert(np.clip(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)


_loaded: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of points (rows of non-negative coordinates under 2**bits) along a Hilbert curve."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b) & 1
    return out


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """row (unique), doc_id, key, n_tokens and ids (two bytes each), the end id included; written to shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(vocabulary)
        for batch in batches:
            for c in tk.chunks(batch.column(1)):
                ids, at = own.encode(c)
                coded = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(2 * at), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(own.keys(ids, at)), pa.array(np.diff(at)), coded], names=["doc_id", "key", "n_tokens", "ids"])

    return stored(texts(docs).mapInArrow(lean(run), "doc_id long, key long, n_tokens long, ids binary").select(F.monotonically_increasing_id().alias("row"), "*"))


def placed(ordered: DataFrame) -> DataFrame:
    """row, and the number of tokens before it in the whole stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            upto = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(upto - n), batch.column(1), pa.array(np.full(len(n), part, np.int32))], names=["row", "inside", "n_tokens", "part"])
            before = int(upto[-1]) if len(n) else before

    spark = ordered.sparkSession
    by = ("key", F.xxhash64("doc_id"), "doc_id", "row")
    local = stored(ordered.repartitionByRange(tasks(spark), *by).sortWithinPartitions(*by).select("row", "n_tokens").mapInArrow(lean(run), "row long, inside long, n_tokens long, part int"))
    sums = sorted(local.groupBy("part").agg(F.sum("n_tokens")).collect())  # a row for each task
    starts, total = [], 0
    for part, n in sums:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "part int, start long")
    return local.join(F.broadcast(offsets), "part").select("row", (F.col("inside") + F.col("start")).alias("before")), total


def limits(total: int) -> tuple[int, list[int]]:
    """Whole sequences, and where the shorter ones behind them begin (one more for the end)."""
    whole, rest = divmod(total, LENGTH)
    ends = [whole * LENGTH]
    for bit in range(LENGTH.bit_length() - 2, -1, -1):
        if rest >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    return whole, ends


def pack(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids."""
    coded = tokenized(docs, vocabulary)
    where, total = placed(coded.select("row", "doc_id", "key", "n_tokens"))
    whole, tail = limits(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
        edges = np.array(tail)
        for batch in batches:
            rows = []
            for doc_id, body, before in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(body.as_buffer(), dtype="<u2").astype("<u4")
                at, end = before, before + len(ids)
                while at < end:
                    if at < tail[0]:
                        seq, first, last = at // LENGTH, at // LENGTH * LENGTH, (at // LENGTH + 1) * LENGTH
                    else:
                        k = int(np.searchsorted(edges, at, "right")) - 1
                        seq, first, last = whole + k, tail[k], tail[k + 1]
                    last = min(last, end)
                    piece = ids[at - before : last - before]
                    rows.append((doc_id, at - before, last - at, zlib.crc32(piece.tobytes()), len(ids), seq, at - first, *[piece] * with_ids))
                    at = last
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return coded.select("row", "doc_id", "ids").join(where, "row").select("doc_id", "ids", "before").mapInArrow(lean(run), schema)
