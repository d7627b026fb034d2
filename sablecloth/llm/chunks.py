"""Questions from chunks of documents to buckets of a hash space, and answers.

Documents are gathered into chunks of about two megabytes, held compressed in one
row of a bucketed table.  A chunk asks each bucket once, with all it wants to know there
in one packed row, so what is shuffled is a few bytes a question and a key that is
everywhere arrives once a chunk, not once a document.  Buckets answer in the order of
the questions; the answers go back to the chunks, which stay where they are.  Rows:
(chunk, bucket, data), with bucket STATE for what a chunk keeps for its next step.

Chunks and buckets both grow with the input, so rows of a chunk and a bucket become many
and small.  together() lets the chunks of a home share rows: such a row is a list of
(chunk, question), and its answer a list of (chunk, answer).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .cluster import parts, written_in_buckets
from .textbytes import U64, column_bytes, mix

CHUNK_BYTES, CHUNK_ROWS = 2_000_000, 4096
#: Bytes of questions that chunks of a home gather before they are sent.
HELD_BYTES = 48_000_000
STATE = -1
SCHEMA = "chunk long, bucket int, data binary"
#: Lower bits of a chunk's number, which count the chunks of its home.
_CHUNK_BITS = 20
_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])


def pack(x: object, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(x, protocol=5))


def unpack(b: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))  # noqa: S301 - only what pack() wrote in this job


def pack_sorted(x: np.ndarray) -> tuple[int, bytes]:
    """Sorted numbers as differences, byte by byte of equal weight."""
    step = np.diff(x, prepend=U64(0)) if len(x) else x
    return len(x), np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(x: tuple[int, bytes]) -> np.ndarray:
    n, raw = x
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(U64).ravel()) if n else np.zeros(0, U64)


class Chunk:
    """Some documents: ids (None for null), their bytes and offsets, and what later steps need."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = ids
        self.raw = b"".join(texts)
        self.off = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        self.more: dict = {}

    @property
    def data(self) -> np.ndarray:
        return np.frombuffer(self.raw, np.uint8)

    def text(self, i: int) -> bytes:
        return self.raw[self.off[i] : self.off[i + 1]]

    def part(self, rows: np.ndarray) -> Chunk:
        return Chunk([self.ids[i] for i in rows], [self.text(i) for i in rows])


def rows_of(chunk: int, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(found), pa.int64()), pa.array([b for b, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], schema=_ARROW)


def together(asked: Iterable[tuple[int, list[tuple[int, tuple[bytes, ...]]]]]) -> Iterator[pa.RecordBatch]:
    """Rows that hold what several chunks of one home ask a bucket."""
    held: dict[int, list] = {}
    size, first = 0, 0
    for chunk, found in asked:
        if held and (size >= HELD_BYTES or chunk >> _CHUNK_BITS != first >> _CHUNK_BITS):
            yield rows_of(first, [(b, pack(x)) for b, x in held.items()])
            held, size = {}, 0
        if not held:
            first = chunk
        for b, x in found:
            held.setdefault(b, []).append((chunk, x))
            size += sum(map(len, x))
    if held:
        yield rows_of(first, [(b, pack(x)) for b, x in held.items()])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    ids, texts, size = [], [], 0
    for batch in batches:
        data, off = column_bytes(batch.column("text"))
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            ids.append(doc_id)
            texts.append(data[off[i] : off[i + 1]].tobytes())
            size += len(texts[-1])
            if size >= CHUNK_BYTES or len(ids) == CHUNK_ROWS:
                yield Chunk(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield Chunk(ids, texts)


def _bucket(x: int, buckets: int) -> int:
    """Where Spark's hash puts a long: Murmur3 with seed 42, of its lower and its upper half."""
    word, h = 2**32 - 1, 42
    for half in (x & word, x >> 32 & word):
        k = half * 0xCC9E2D51 & word
        k = (k << 15 | k >> 17) & word
        h ^= k * 0x1B873593 & word
        h = ((h << 13 | h >> 19) & word) * 5 + 0xE6546B64 & word
    h ^= 8
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & word
    h ^= h >> 16
    return (h - 2**32 if h >= 2**31 else h) % buckets


def home_of(task: int, buckets: int) -> int:
    """A number for a task whose bucket is the task's number, so that tasks fill buckets evenly."""
    home = task
    while _bucket(home, buckets) != task % buckets:
        home += 1 << 24
    return home


def gather(docs: DataFrame, name: str) -> DataFrame:
    """A table (home, chunk, data) of the chunks of all documents, in the shared folder.

    Its files are buckets by home, the task that made a chunk, so that later steps
    bring answers to the chunks and never shuffle the documents again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        home, k = home_of(task.partitionId() if task else 0, buckets), 0
        for chunk in _gathered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([home], pa.int64()), pa.array([(home << _CHUNK_BITS) + k], pa.int64()), pa.array([pack(chunk, 3)], pa.binary())], names=["home", "chunk", "data"])
            k += 1

    buckets = parts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written_in_buckets(rows.mapInArrow(run, "home long, chunk long, data binary"), name, "home")


def asking(content: DataFrame, ask: Callable[[Chunk], list[tuple[int, bytes]]]) -> DataFrame:
    """The first questions of all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield rows_of(batch.column("chunk")[i].as_py(), ask(unpack(batch.column("data")[i].as_py())))

    return content.select("chunk", "data").mapInArrow(run, SCHEMA)


def asking_together(content: DataFrame, ask: Callable[[Chunk], list[tuple[int, tuple[bytes, ...]]]]) -> DataFrame:
    """The first questions of all chunks, in rows of together()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from together((chunk.as_py(), ask(unpack(data.as_py()))) for batch in batches for chunk, data in zip(batch.column("chunk"), batch.column("data"), strict=True))

    return content.select("chunk", "data").mapInArrow(run, SCHEMA)


def answered_together(rows: DataFrame, answer: Callable[[list], list[bytes]]) -> DataFrame:
    """One answer to every question in rows of together()."""

    def run(table: pa.Table) -> pa.Table:
        asked = [unpack(x) for x in table.column("data").to_pylist()]
        told = iter(answer([x for row in asked for _, x in row]))
        return pa.table([table.column("chunk"), table.column("bucket"), pa.array([pack([(chunk, next(told)) for chunk, _ in row]) for row in asked], pa.binary())], schema=_ARROW)

    return rows.groupBy("bucket").applyInArrow(run, SCHEMA)


def answered(rows: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """One answer to every question; a task handles one bucket, whose size follows the number of buckets."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table([table.column("chunk"), table.column("bucket"), pa.array(answer(table.column("data").to_pylist()), pa.binary())], schema=_ARROW)

    return rows.filter(F.col("bucket") != STATE).groupBy("bucket").applyInArrow(run, SCHEMA)


def returned(content: DataFrame, told: list[DataFrame], use: Callable, schema: str) -> DataFrame:
    """use(chunk number, Chunk, [answers by bucket]) yields record batches for every chunk.

    A group is what one task gathered: its size is that of a split of the input."""
    return _cogrouped(content, told, lambda chunks: (batch for number, chunk, known in chunks for batch in use(number, chunk, known)), schema, False)


def returned_together(content: DataFrame, told: DataFrame, use: Callable, schema: str) -> DataFrame:
    """use([(chunk number, Chunk, answers by bucket)]) yields record batches for all chunks of a home; answers are rows of together()."""
    return _cogrouped(content, [told], lambda chunks: use((number, chunk, known[0]) for number, chunk, known in chunks), schema, True)


def _cogrouped(content: DataFrame, told: list[DataFrame], use: Callable, schema: str, joined: bool) -> DataFrame:
    every, n, to_arrow = None, len(told), to_arrow_schema(StructType.fromDDL(schema))
    for k, rows in enumerate(told):
        rows = rows.select(F.shiftright("chunk", _CHUNK_BITS).alias("home"), "chunk", "bucket", "data", F.lit(k).alias("k"))
        every = rows if every is None else every.union(rows)

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        known: dict[int, list[dict[int, bytes]]] = {}
        for chunk, bucket, data, k in zip(*(answers.column(x).to_pylist() for x in ("chunk", "bucket", "data", "k")), strict=True):
            for of, x in unpack(data) if joined else [(chunk, data)]:
                known.setdefault(of, [{} for _ in range(n)])[k][bucket] = x
        out = list(use((chunk.as_py(), unpack(data.as_py()), known.get(chunk.as_py()) or [{} for _ in range(n)]) for chunk, data in zip(own.column("chunk"), own.column("data"), strict=True)))
        return pa.Table.from_batches(out, None if out else to_arrow)

    return content.groupBy("home").cogroup(every.groupBy("home")).applyInArrow(run, schema)


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted distinct keys, as each bucket gets them: places into keys."""
    b = (keys % U64(buckets)).astype(np.uint16 if buckets <= 2**16 else np.int64)  # sixteen bits: a radix sort
    order = np.argsort(b, kind="stable")
    b = b.astype(np.int64)
    at = np.append(np.flatnonzero(np.diff(b[order], prepend=-1)), len(order))
    for i, j in zip(at[:-1], at[1:], strict=True):
        yield int(b[order[i]]), order[i:j]


def ask_counts(keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """How often does each of these sorted distinct keys occur in all chunks?"""
    return [(b, pack((pack_sorted(keys[at]), counts[at].astype(np.uint32).tobytes()))) for b, at in by_bucket(keys, buckets)]


def answer_counts(asked: list[bytes]) -> list[bytes]:
    """Sums of the counts of each key, up to 2**32 - 1."""
    parts = [unpack(x) for x in asked]
    return [pack(x.tobytes()) for x in totals([unpack_sorted(p[0]) for p in parts], [np.frombuffer(p[1], np.uint32) for p in parts])]


def totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For each of the keys, the sum of its counts in all lists, up to 2**32 - 1."""
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts).astype(np.int64)).clip(max=2**32 - 1).astype(np.uint32)[place]
    ends = np.cumsum([len(k) for k in keys])
    return [total[e - len(k) : e] for k, e in zip(keys, ends, strict=True)]


def counts_told(keys: np.ndarray, told: dict[int, bytes], buckets: int) -> np.ndarray:
    out = np.zeros(len(keys), np.int64)
    for b, at in by_bucket(keys, buckets):
        out[at] = np.frombuffer(unpack(told[b]), np.uint32)
    return out


_ODD = U64(0xBF58476D1CE4E5B9)


class Rolling:
    """Hashes of runs of a sequence: polynomials modulo 2**64, from sums of prefixes."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, items: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(items) + 1
        if base not in self._powers or len(self._powers[base][0]) < n:
            size = max(n, 1 << 16)
            one = np.ones(1, U64)
            self._powers[base] = tuple(np.cumprod(np.concatenate([one, np.full(size, p, U64)])) for p in (base, pow(base, -1, 2**64)))
        up, self.down = self._powers[base]
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(items * up[: n - 1])])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def windows(self, k: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Hashes of runs of k items, by start (from lo to before hi)."""
        n = len(self.sums) - k if hi is None else hi
        if n <= lo:
            return np.zeros(0, U64)
        x = self.sums[lo + k : n + k] - self.sums[lo:n]
        x *= self.down[lo:n]
        x ^= x >> U64(29)
        x *= _ODD
        x ^= x >> U64(32)
        return x


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct value stands first or elsewhere, which of them each place holds, and how many hold each."""
    order = np.argsort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return order[at], place, np.diff(np.append(at, len(x)))


def least_windows(roll: Rolling, k: int, w: int, block: int = 50_000) -> np.ndarray:
    """The least hash of each w runs of k items, by start; blocks stay in cache."""
    n = len(roll.sums) - k - w + 1
    out = np.zeros(max(n, 0), U64)
    for lo in range(0, n, block):
        hi = min(lo + block, n)
        out[lo:hi] = sliding_min(roll.windows(k, lo, hi + w - 1), w)
    return out


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each run of w items, by start."""
    if len(a) < w:
        return a[:0]
    span, m = 1, a
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(a) - w + 1], m[w - span :]) if span < w else m


def starts_within(off: np.ndarray, n: int, k: int) -> np.ndarray:
    """Where a run of k items lies within one row; off: where rows begin (with the end)."""
    ok = np.zeros(n, np.int8)
    size = np.diff(off)
    long = size >= k
    np.add.at(ok, off[:-1][long], 1)
    stop = off[1:][long] - k + 1
    np.add.at(ok, stop[stop < n], -1)
    return np.cumsum(ok, dtype=np.int8) > 0


def merged(keep_from: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n items are covered by runs of the given length."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, keep_from, 1)
    np.add.at(step, np.minimum(keep_from + length, n), -1)
    return np.cumsum(step)[:n] > 0
