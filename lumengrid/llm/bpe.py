"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per Python worker.

A text is cut by the tokenizer's pattern, each match ("piece") on its own. Pieces repeat, so a worker
encodes each distinct one of a batch once and keeps the first ones in a bounded table. For new pieces a recursive query holds
one row per token and position: it joins neighbours with the merge table, and contracts each piece's
pair of lowest rank, leftmost first and wherever else the pair stands without overlap (which is what
repeated leftmost contraction comes to), until no pair can merge. Decoding is an ordered aggregation.

Null and empty texts give no tokens and an empty decoded text. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumengrid.llm.common import lean, slices, texts

#: Distinct chunks a worker keeps at most, pieces in one recursive query, and DuckDB's memory.
KEPT, AT_ONCE, MEMORY = 600_000, 50_000, "300MB"
#: Bytes of a piece that may take a round for each contraction.
SHORT = 48

#: Contracts one pair a round: few rows for short pieces.
ENCODE = """
WITH RECURSIVE step(piece, ids, done) AS (
    SELECT piece, ids, len(ids) < 2 FROM pieces
    UNION ALL
    SELECT s.piece, CASE WHEN best IS NULL THEN s.ids ELSE s.ids[:best & 1048575] || [(best >> 20)::INTEGER] || s.ids[(best & 1048575) + 3:] END,
        best IS NULL OR len(s.ids) = 2
    FROM (SELECT * FROM step WHERE NOT done) s LEFT JOIN (
        SELECT piece, min(rank * 1048576 + pos) AS best FROM (
            SELECT piece, unnest(range(len(ids) - 1)) AS pos, unnest(ids[:-2]) * 65536 + unnest(ids[2:]) AS pair FROM step WHERE NOT done
        ) t JOIN merges USING (pair) GROUP BY piece
    ) b USING (piece)
)
SELECT piece, ids FROM step WHERE done
"""

#: Contracts all places of a piece's best pair in a round, as long pieces need.
ENCODE_LONG = """
WITH RECURSIVE step(piece, pos, id, done) AS (
    SELECT piece, unnest(range(len(ids)))::INTEGER, unnest(ids), false FROM pieces
    UNION ALL
    SELECT piece, pos, coalesce(new_id, id), best IS NULL FROM (
        SELECT *, lag(new_id) OVER (PARTITION BY piece ORDER BY pos) AS new_before FROM (
            SELECT *, CASE WHEN rank = best AND (place - coalesce(max(CASE WHEN rank IS DISTINCT FROM best THEN place END)
                OVER (PARTITION BY piece ORDER BY pos ROWS UNBOUNDED PRECEDING), -1)) % 2 = 1 THEN rank END AS new_id
            FROM (
                SELECT t.piece, t.pos, t.id, m.rank::INTEGER AS rank, row_number() OVER (PARTITION BY t.piece ORDER BY t.pos) - 1 AS place,
                    min(m.rank) OVER (PARTITION BY t.piece) AS best
                FROM (SELECT piece, pos, id, lead(id) OVER (PARTITION BY piece ORDER BY pos) AS next_id FROM step WHERE NOT done) t
                LEFT JOIN merges m ON m.pair = t.id * 65536 + t.next_id
            )
        )
    ) WHERE new_before IS NULL
)
SELECT piece, list(id ORDER BY pos) AS ids FROM step WHERE done GROUP BY piece
"""

LISTED = "SELECT piece, array_to_string(ids, ',') AS ids, len(ids) AS n FROM coded"

DECODE = """
SELECT piece, string_agg(v.hex, '' ORDER BY pos) AS hex FROM (
    SELECT piece, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM coded
) t JOIN vocabulary v USING (id) GROUP BY piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """Encodes and decodes texts with the ranks of one vocabulary file."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.db = db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self._table("merges", pa.table({"pair": pa.array([a << 16 | b for a, b, _ in pairs], pa.int64()), "rank": pa.array([r for *_, r in pairs], pa.int64())}))
        self.whole = ranks
        self.single = np.array([ranks[bytes([k])] for k in range(256)], dtype=np.int64)
        self._table("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.kept: dict[str, tuple[str, int, str]] = {}

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _encoded(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Fills the table coded (piece, ids) for some pieces of one byte or more after others; their places."""
        whole = [k for k, x in enumerate(pieces) if x in self.whole]  # a piece that is a token by itself stays whole
        if whole:
            ids = pa.ListArray.from_arrays(pa.array(range(len(whole) + 1), pa.int32()), pa.array([self.whole[pieces[k]] for k in whole], pa.int32()))
            self._table("coded", pa.table({"piece": pa.array(whole, pa.int32()), "ids": ids}))
            yield whole
        for query, own in (
            (ENCODE, [k for k, x in enumerate(pieces) if x not in self.whole and len(x) <= SHORT]),
            (ENCODE_LONG, [k for k, x in enumerate(pieces) if x not in self.whole and len(x) > SHORT]),
        ):
            for at in range(0, len(own), AT_ONCE):
                part = own[at : at + AT_ONCE]
                body = self.single[np.frombuffer(b"".join(pieces[k] for k in part), np.uint8)]
                ends = np.cumsum([0, *(len(pieces[k]) for k in part)])
                self._table("pieces", pa.table({"piece": pa.array(part, pa.int32()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(body))}))
                self.db.execute(f"CREATE OR REPLACE TEMP TABLE coded AS {query}")
                yield part

    def _decoded(self) -> list[tuple[int, bytes]]:
        """The bytes behind the ids of the table coded, by piece."""
        return [(k, bytes.fromhex(text)) for k, text in self.db.execute(DECODE).fetchall()]

    def code_pieces(self, pieces: list[bytes]) -> list[tuple[str, int, bytes]]:
        """Ids (decimal, comma-joined), their number and the bytes that they decode to, of each piece of one byte or more."""
        out: list = [None] * len(pieces)
        for _ in self._encoded(pieces):
            back = dict(self._decoded())
            for k, ids, n in self.db.execute(LISTED).fetchall():
                out[k] = ids, n, back[k]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[str, int]]:
        """Ids (decimal, comma-joined) and their number, of each piece of one byte or more."""
        out: list = [None] * len(pieces)
        for _ in self._encoded(pieces):
            for k, ids, n in self.db.execute(LISTED).fetchall():
                out[k] = ids, n
        return out

    def decode_ids(self, coded: list[str]) -> list[bytes]:
        """The bytes behind comma-joined ids."""
        out = [b""] * len(coded)
        for at in range(0, len(coded), AT_ONCE):
            ids = [list(map(int, x.split(","))) if x else [] for x in coded[at : at + AT_ONCE]]
            self._table("coded", pa.table({"piece": pa.array(range(len(ids)), pa.int32()), "ids": pa.array(ids, pa.list_(pa.int32()))}))
            for k, text in self._decoded():
                out[at + k] = text
        return out

    def _learn(self, chunks: set[str]) -> dict[str, tuple[str, int, str]]:
        """Chunks are cut into pieces, their distinct pieces are encoded and decoded, and put together again."""
        cut = {c: self.pattern.findall(c) for c in chunks}
        pieces = list(dict.fromkeys(p for found in cut.values() for p in found))
        known = dict(zip(pieces, self.code_pieces([p.encode() for p in pieces]), strict=True))
        out = {}
        for c, found in cut.items():
            if len(found) == 1:
                ids, n, back = known[found[0]]
                decoded = back.decode()
                out[c] = ids, n, c if c == decoded else decoded
                continue
            own = [known[p] for p in found]
            decoded = b"".join([x[2] for x in own]).decode()
            out[c] = ",".join([x[0] for x in own]), sum([x[1] for x in own]), c if c == decoded else decoded
        return out

    def code(self, many: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """Per text its ids, their number and the decoded bytes.

        A text is cut at single spaces, which begin a piece if no other white space touches them; a text
        where some does is cut by the pattern as a whole.
        """
        cut = []
        for text in many:
            if not text or text[0].isspace() or text[-1].isspace() or _BEFORE.search(text) or _BEHIND.search(text) or _ODD.search(text):
                cut.append(self.pattern.findall(text))
            else:
                cut.append(_PARTS.findall(text))
        needed = {x for parts in cut for x in parts}
        known = {x: self.kept[x] for x in needed & self.kept.keys()}
        fresh = self._learn(needed - known.keys())
        self.kept.update(islice(fresh.items(), max(0, KEPT - len(self.kept))))
        known |= fresh
        for parts in cut:
            own = [known[x] for x in parts]
            yield ",".join([x[0] for x in own]), sum([x[1] for x in own]), "".join([x[2] for x in own]).encode()


#: A space with white space behind it or before it; a part of a text that is cut at spaces.
_BEFORE, _BEHIND, _PARTS = re.compile(r" \s"), re.compile(r"[^\S ] "), re.compile(r"\A[^ ]+| [^ ]+")
#: White space for Python's strip() alone, or for the pattern alone.
_ODD = re.compile("[\x1c-\x1f]")
_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders.clear()
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ids the array of token ids."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            at, doc_ids = 0, batch.column(0)
            for part in slices(batch.column(1).to_pylist()):
                rows = [(n, sha(x.encode()), sha(back), x if ids else "") for x, n, back in own.code(part)]
                columns = [doc_ids.slice(at, len(part)), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))]
                if ids:
                    columns.append(pa.array([list(map(int, r[3].split(","))) if r[3] else [] for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])
                at += len(part)

    return texts(docs).mapInArrow(lean(run), schema)
