"""Byte-level BPE encoding and decoding by recursive queries.

A text is parted by the tokenizer's pattern.  The distinct pieces of a partition
that aren't known yet go to an in-process DuckDB: rows (piece, position, token)
join the merge table on neighbouring tokens, and a recursive query contracts each
piece's leftmost pair of least rank until no pair can be merged.  An ordered
aggregation gives each piece's ids and, joined with the vocabulary, its bytes.
Each Python worker keeps the pieces it knows, in a table of bounded size.

Defined results: a null text is the empty text, which has no tokens; a vocabulary must
hold all single bytes; rows of
equal doc_id are encoded one by one; special tokens' strings are ordinary text.
The vocabulary file is read by path on the driver and sent along; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Pieces that a worker keeps, and bytes of pieces that one recursive query takes.
KNOWN_PIECES = 400_000
QUERY_BYTES = 400_000
#: The recursion over longer pieces holds their last state only, and contracts all pairs of a
#: rank at once where that gives the same: theirs is the same rule, at a bounded cost in memory.
LONG_PIECE = 200

_RESULT = """
    SELECT w, list(id) AS ids, string_agg(hex, '') AS hex
    FROM (SELECT s.w, s.pos, s.id, v.hex FROM last s JOIN vocabulary v ON v.id = s.id ORDER BY s.w, s.pos) GROUP BY w
"""
#: Every step contracts each piece's leftmost pair of least rank.  One thread runs it, so the
#: aggregates of the result meet their rows in order.
_ENCODE = f"""
    WITH RECURSIVE state AS (SELECT w, pos, id, 0 AS it FROM start UNION ALL
      (WITH x AS MATERIALIZED (SELECT w, pos, id, it, lag(pos) OVER near AS before, lead(id) OVER near AS after FROM state WINDOW near AS (PARTITION BY w ORDER BY pos)),
      b AS (SELECT w, (best >> 32)::INT AS rank, (best & 4294967295)::INT AS at
            FROM (SELECT x.w, min((m.rank::BIGINT << 32) | x.pos) AS best FROM x JOIN merges m ON m.l = x.id AND m.r = x.after GROUP BY x.w))
      SELECT x.w, x.pos, CASE WHEN x.pos = b.at THEN b.rank ELSE x.id END AS id, x.it + 1 AS it
      FROM x JOIN b ON b.w = x.w WHERE x.before IS DISTINCT FROM b.at)),
    last AS (SELECT s.* FROM state s JOIN (SELECT w, max(it) AS it FROM state GROUP BY w) e ON s.w = e.w AND s.it = e.it)
    {_RESULT}
"""
#: Every step contracts each piece's pairs of least rank from the left, up to one that makes a pair
#: of no larger rank.  Rows know their neighbours (-1: none); id -1 is a row that was merged away.
_ENCODE_LONG = f"""
    WITH RECURSIVE state(w, pos, id, prv, nxt, rnk) USING KEY (w, pos) AS (
      SELECT w, pos, id, prv, nxt, rnk FROM start
      UNION
      (WITH live AS (SELECT * FROM recurring.state WHERE id >= 0),
      best AS (SELECT w, min(rnk) AS best FROM live WHERE rnk IS NOT NULL GROUP BY w),
      hit AS (SELECT l.w, l.pos, l.prv, l.nxt, b.best, lag(l.nxt) OVER (PARTITION BY l.w ORDER BY l.pos) IS DISTINCT FROM l.pos AS lead FROM live l JOIN best b ON b.w = l.w AND b.best = l.rnk),
      runs AS (SELECT *, sum(lead::INT) OVER (PARTITION BY w ORDER BY pos) AS run FROM hit),
      pick AS (SELECT w, pos, prv, nxt, best FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS k FROM runs) WHERE k % 2 = 1),
      around AS (SELECT c.w, c.pos, c.nxt, c.best, d.nxt AS far, coalesce(p.pos, c.prv) AS before, p.pos IS NOT NULL AS paired
        FROM pick c JOIN live d ON d.w = c.w AND d.pos = c.nxt LEFT JOIN pick p ON p.w = c.w AND p.nxt = c.prv),
      ids AS (SELECT a.*, CASE WHEN a.paired THEN a.best ELSE b.id END AS left_id, f.id AS right_id, n.pos IS NOT NULL AS right_hit
        FROM around a LEFT JOIN live b ON b.w = a.w AND b.pos = a.before LEFT JOIN live f ON f.w = a.w AND f.pos = a.far LEFT JOIN pick n ON n.w = a.w AND n.pos = a.far),
      ranked AS (SELECT i.*, x.rank AS left_rank, y.rank AS right_rank, z.rank AS both_rank
        FROM ids i LEFT JOIN merges x ON x.l = i.left_id AND x.r = i.best LEFT JOIN merges y ON y.l = i.best AND y.r = i.right_id LEFT JOIN merges z ON i.right_hit AND z.l = i.best AND z.r = i.best),
      cut AS (SELECT w, min(pos) AS last FROM ranked WHERE least(left_rank, right_rank, both_rank) <= best GROUP BY w),
      done AS (SELECT r.*, r.right_hit AND (c.last IS NULL OR r.far <= c.last) AS joined FROM ranked r LEFT JOIN cut c ON c.w = r.w WHERE c.last IS NULL OR r.pos <= c.last),
      -- the row before a merged pair gets a new rank, the row after it a new neighbour
      touched AS (SELECT w, before AS pos, left_rank AS rank, NULL AS back, true AS ranks FROM done WHERE NOT paired AND before >= 0
        UNION ALL SELECT w, far, NULL, pos, false FROM done WHERE far >= 0 AND NOT joined),
      sums AS (SELECT w, pos, max(rank) AS rank, max(back) AS back, bool_or(ranks) AS ranks FROM touched GROUP BY w, pos)
      SELECT w, pos, best, before, far, CASE WHEN joined THEN both_rank ELSE right_rank END FROM done
      UNION ALL SELECT w, nxt, -1, -1, -1, NULL FROM done
      UNION ALL SELECT l.w, l.pos, l.id, coalesce(s.back, l.prv), l.nxt, CASE WHEN s.ranks THEN s.rank ELSE l.rnk END FROM sums s JOIN live l ON l.w = s.w AND l.pos = s.pos)),
    last AS (SELECT w, pos, id FROM state WHERE id >= 0)
    {_RESULT}
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, from a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Knows the ids and the decoded bytes of pieces; unknown ones go to DuckDB."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.plain = regex.compile(pattern), _plain_pattern(pattern)
        self.ranks = ranks
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.ids: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}  # decoded bytes of pieces that differ from the piece's own
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        pairs = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        l, r, rank = (list(x) for x in zip(*pairs, strict=True)) if pairs else ([], [], [])
        self._table("merges", {"l": pa.array(l, pa.int32()), "r": pa.array(r, pa.int32()), "rank": pa.array(rank, pa.int32())})
        self._table("vocabulary", {"id": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in ranks])})

    def _table(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("arrived", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS FROM arrived")
        self.db.unregister("arrived")

    def _start(self, pieces: list[bytes], long: bool) -> None:
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces], np.int64)
        at = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
        ids = self.single[raw]
        columns = {"w": np.repeat(np.arange(len(pieces), dtype=np.int32), size), "pos": at, "id": ids}
        if long:
            last = at + 1 == np.repeat(size, size)
            columns |= {"prv": at - 1, "nxt": np.where(last, -1, at + 1), "after": np.append(ids[1:], -1)}
        self._table("start", {name: pa.array(x.astype(np.int32)) for name, x in columns.items()})
        if long:
            self.db.execute("CREATE OR REPLACE TABLE start AS SELECT w, pos, id, prv, nxt, CASE WHEN nxt >= 0 THEN m.rank END AS rnk FROM start LEFT JOIN merges m ON m.l = id AND m.r = after")

    def _solve(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded bytes of each piece."""
        long = len(pieces[0]) > LONG_PIECE
        self._start(pieces, long)
        rows = self.db.sql(_ENCODE_LONG if long else _ENCODE).to_arrow_table().combine_chunks()
        ids = rows.column("ids").chunk(0)
        flat, ends = np.asarray(ids.flatten()).astype("<u4").tobytes(), (np.asarray(ids.offsets) * 4).tolist()
        first, out = ends[0], [(b"", b"")] * len(pieces)
        for w, digits, i, j in zip(rows.column("w").to_pylist(), rows.column("hex").to_pylist(), ends, ends[1:], strict=False):
            out[w] = (flat[i - first : j - first], bytes.fromhex(digits))
        return out

    def find(self, text: str) -> list[str]:
        """The pieces of a text."""
        if self.plain and not _PLAIN.search(text):
            return self.plain.findall(text)
        return self.pattern.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Solves the pieces that aren't known yet."""
        if len(self.ids) + len(pieces) > KNOWN_PIECES:
            self.ids = {p: x for p in pieces if (x := self.ids.get(p))}
            self.raw = {p: self.raw[p] for p in self.ids if p in self.raw}
        few: list[tuple[str, bytes]] = []
        size = 0

        def solve(some: list[tuple[str, bytes]]) -> None:
            for (piece, own), (ids, raw) in zip(some, self._solve([b for _, b in some]), strict=True):
                self.ids[piece] = ids
                if raw != own:
                    self.raw[piece] = raw

        for piece in pieces:
            if piece in self.ids:
                continue
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:  # a piece that is itself a token isn't merged
                self.ids[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                solve([(piece, raw)])
            else:
                few.append((piece, raw))
                size += len(raw)
                if size >= QUERY_BYTES:
                    solve(few)
                    few, size = [], 0
        if few:
            solve(few)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids as little-endian 32-bit integers, and the decoded bytes, of each text."""
        parted = [self.find(t) for t in texts]
        self.learn(set().union(*parted))
        ids = self.ids.__getitem__
        decoded = (lambda pieces: b"".join(self.raw.get(p) or p.encode() for p in pieces)) if self.raw else (lambda pieces: "".join(pieces).encode())
        return [(b"".join(map(ids, pieces)), decoded(pieces)) for pieces in parted]


#: Texts of these characters only are parted by the standard library's engine: there
#: letters and digits are the same classes as the pattern's, and it is faster.
_PLAIN = re.compile("[^\\t-\\r -~\xa0\xc0-\u024f\u2010-\u2027]")
_PLAIN_FORM = {r"\p{L}+": r"[^\W\d_]+", r"\p{N}+": r"\d+", r"[^\s\p{L}\p{N}]+": r"(?:[^\s\w]|_)+"}


def _plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for plain texts, or None if it has other classes than these."""
    for a, b in sorted(_PLAIN_FORM.items(), key=lambda x: -len(x[0])):
        pattern = pattern.replace(a, b)
    return None if "\\p" in pattern else re.compile(pattern)


_ENCODERS: dict[tuple[str, str], Encoder] = {}
#: Characters of texts that are parted at once; their pieces are objects of some 60 bytes each.
_TEXT_CHARS = 1_000_000


def _batch_texts(column: pa.Array) -> Iterator[list[str]]:
    part, size = [], 0
    for x in column:
        t = x.as_py() or ""
        part.append(t)
        size += len(t)
        if size >= _TEXT_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded bytes of every document."""
    with open(path, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())  # one tokenizer's file: its size is fixed
    key = (hashlib.sha256(vocabulary.value).hexdigest(), pattern)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.value.splitlines() if line)}
            _ENCODERS[key] = Encoder(ranks, pattern)
        encoder = _ENCODERS[key]
        for batch in batches:
            rows = [x for texts in _batch_texts(batch.column("text")) for x in ((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()) for ids, raw in encoder.encode(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encoded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
