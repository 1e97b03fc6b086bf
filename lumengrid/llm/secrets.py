"""Secrets in texts: fixed patterns, and values in credential context that would be hard to guess.

How hard is told by dynamic programming over a value: the cheapest way to cut it into dictionary words,
dates, repeats, keyboard walks and brute-force spans, where the costs (log10 of guesses) add up.

A null text counts as empty and has no spans. Each row stands alone; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import zip_longest
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from lumengrid.llm.common import lean, texts

# Fixed values of the contract: kinds in order, their patterns, and the least length of what must be long.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
KINDS = (*(k for k, *_ in BASE), "guess")
#: Longer runs alone can pass, and are found faster.
_HEX_RUN = re.compile(r"[0-9a-f]{16,}")

#: Where a value is a credential, and the log10 of guesses from which it counts as a secret.
CONTEXT = re.compile(r"""(?:passphrase|password|passwd|pwd|secret|token|credential|api[_-]?key|access[_-]?key|auth[_-]?key)["']?[\x20\t]{0,4}[:=][\x20\t]{0,4}["']?([^\s"'<>,;]{8,})""", re.ASCII | re.IGNORECASE)
LEAST_GUESSES = 9.0

#: Frequent passwords and words in them, most frequent first; those of a ranked vocabulary follow.
FIRST = (
    "password", "passwd", "pass", "secret", "token", "admin", "administrator", "root", "user", "login", "welcome", "letmein", "master", "monkey", "dragon",
    "shadow", "sunshine", "princess", "football", "baseball", "superman", "batman", "hello", "freedom", "whatever", "trustno", "starwars", "iloveyou", "test",
    "guest", "default", "changeme", "example", "sample", "dummy", "qwerty", "temp", "demo",
)
_LONGEST = 24


@cache
def ranks(words: str, pieces: str) -> dict[str, int]:
    """Words and their ranks: FIRST, then by turns the whole words of two vocabularies, frequent ones first.

    words: a file of the tokenizers library, in which a suffix tells where a word ends; pieces: one of the tiktoken library, in which a
    space tells where a word begins. Both are in order of merging, which follows frequency; the second one is in many languages.
    """
    vocabulary = json.loads(Path(words).read_text())["model"]
    end = vocabulary.get("end_of_word_suffix") or ""
    one = [x.removesuffix(end) for x, _ in sorted(vocabulary["vocab"].items(), key=lambda x: x[1]) if x.endswith(end)]
    two = [base64.b64decode(x.split()[0]) for x in Path(pieces).read_bytes().splitlines() if x]
    two = [x[1:].decode(errors="replace") for x in two if x[:1] == b" "]
    found = dict.fromkeys(FIRST)
    for pair in zip_longest(one, two):
        for x in pair:
            if x and 3 <= len(x) <= _LONGEST and x.isalpha():
                found.setdefault(x.lower())
    return {x: k + 1 for k, x in enumerate(found)}


def known() -> dict[str, int]:
    return ranks(public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


_LEET = str.maketrans("@4301!$57", "aaeoiisst")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?")
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in _ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in _ROWS for a, b in zip(row, row[1:], strict=False)}


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


def segments(value: str) -> Iterator[tuple[int, int, str, float]]:
    """Candidate spans (start, end, kind, log10 of guesses); their number grows with the value's length alone."""
    rank_of = known()
    low = value.lower()
    plain = low.translate(_LEET) if len(low) == len(value) else value
    n = len(value)
    for i in range(n):
        yield i, i + 1, "brute", _brute(value[i])
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            rank = rank_of.get(plain[i:j])
            if rank:
                extra = (value[i:j] != low[i:j]) + (plain[i:j] != low[i:j])
                yield i, j, "word", math.log10(rank + 1) + 0.5 * extra
        m = _DATE.match(value, i)
        if m and m.end() - i >= 4:
            yield i, m.end(), "date", math.log10(120) + (m.end() - i >= 6) * math.log10(12) + (m.end() - i >= 8) * math.log10(31)
    for unit in (1, 2, 3, 4):
        i = 0
        while i + unit < n:
            j = i
            while j + unit < n and value[j] == value[j + unit]:
                j += 1
            if j - i >= max(2, unit):
                yield i, j + unit, "repeat", sum(map(_brute, value[i : i + unit])) + math.log10((j + unit - i) / unit)
            i = max(i + 1, j)
    i = 0
    while i + 2 < n and len(low) == n:
        j = i
        while j + 1 < n and (low[j], low[j + 1]) in _NEXT:
            j += 1
        if j - i >= 2:
            yield i, j + 1, "walk", math.log10(47) + math.log10(j + 1 - i) + 0.3 * (j - i) ** 0.5
        i = max(i + 1, j)


def cheapest(value: str) -> tuple[float, list[tuple[int, int, str]]]:
    """The least log10 of guesses that segments() can make up the whole value for, and those spans; of equal ones the first found."""
    ending: dict[int, list[tuple[int, str, float]]] = {}
    for i, j, kind, cost in segments(value):
        ending.setdefault(j, []).append((i, kind, cost))
    best = [(0.0, 0, "")]
    for j in range(1, len(value) + 1):
        best.append(min(((best[i][0] + cost + (0.0 if kind == "brute" else 0.3), i, kind) for i, kind, cost in ending[j]), key=lambda x: x[0]))
    path, j = [], len(value)
    while j:
        _, i, kind = best[j]
        path.append((i, j, kind))
        j = i
    return best[-1][0], path[::-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns by start, then kind."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        for m in (_HEX_RUN if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(found)]


def all_spans(text: str) -> list[tuple[int, int, str]]:
    """base_spans() and, where they don't cover them wholly, credential values that cost LEAST_GUESSES or more."""
    base = base_spans(text)
    if "=" not in text and ":" not in text:
        return base
    starts, ends = [], []  # of covered stretches
    for s, e, _ in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    more, judged = [], {}
    for m in CONTEXT.finditer(text):
        k = bisect_right(starts, m.start(1)) - 1
        if k >= 0 and m.end(1) <= ends[k]:
            continue
        value = m[1]
        if value not in judged:
            judged[value] = cheapest(value)[0]
        if judged[value] >= LEAST_GUESSES:
            more.append((m.start(1), m.end(1), "guess"))
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{kind}:{s}:{e}" for s, e, kind in spans])


def scan(docs: DataFrame) -> DataFrame:
    """Per document the counts of each kind, the digest of its base spans, and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = all_spans(text)
                base = [x for x in spans if x[2] != "guess"]
                rows.append((*(sum(x[2] == k for x in spans) for k in KINDS), hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact(text: str, mark: str = "[REDACTED]") -> str:
    """The text with every span replaced by the mark, overlapping ones together."""
    out, at = [], 0
    for s, e, _ in all_spans(text):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]
