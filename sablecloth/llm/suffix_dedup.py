"""Suffix-array dedup: byte strings that repeat across documents.

Which strings of 50 bytes occur elsewhere is decided by suffix arrays of shards.
A shard must see all copies of a string, and no more text than needed.  So the
least of the hashed 24-byte runs of a string is its anchor; Spark counts in how many
documents an anchor stands, and only stretches of text around anchors of two documents
go to shards, each to the shard of its anchor, equal stretches of a chunk once.
An anchor of very many documents (HOT_DOCUMENTS) is split: its strings go one by one,
each to the shard of its own hash, where its copies go too.  A shard writes what
arrives to disk and sorts the strings' suffixes by external induced sorting (see
suffix_array); suffixes with 50 bytes in common are copies.  What stands in a larger
document than a group's least is sent back as runs of places, and removed.

Documents are written once, in compressed chunks; chunks, anchors, stretches and runs
of places are all that is shuffled.

Defined results: a null text is empty; documents of equal doc_id don't remove each
other's strings; a null doc_id comes before all others; the digest of nothing is
that of the empty string.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import chunks as c
from .cluster import parts
from .suffix_array import BUDGET, Queue, Store, sort_suffixes
from .textbytes import U64, mix, prefix

LENGTH, ANCHOR = 50, 24
SPAN = LENGTH - ANCHOR + 1
#: Documents from which on an anchor's strings are dealt out one by one.
HOT_DOCUMENTS = 10_000
#: Strings of a stretch at most, so that its size fits a byte.
MOST_STRINGS = 150
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_BYTES = mix(np.arange(1, 257, dtype=U64))
#: Stands for a null doc_id.
LEAST = -(2**63)
_NO_DOCUMENT = 2**63 - 1


class Anchors:
    """Starts of the 50-byte strings of a chunk, and the anchor of each."""

    def __init__(self, chunk: c.Chunk):
        data = chunk.data
        self.roll = c.Rolling(_BYTES[data])
        least = c.least_windows(self.roll, ANCHOR, SPAN)
        self.at = np.flatnonzero(c.starts_within(chunk.off, len(data), LENGTH)[: len(least)]) if len(least) else np.zeros(0, np.int64)
        anchor = least[self.at]
        new = np.ones(len(self.at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        run = np.flatnonzero(new)  # strings that follow one another and share an anchor
        within = np.arange(len(new)) - np.repeat(run, np.diff(np.append(run, len(new))))
        self.run = np.flatnonzero(within % MOST_STRINGS == 0)  # text that repeats itself may share one for long
        self.stop = np.append(self.run[1:], len(self.at)) - 1
        self.anchor = anchor[self.run] & U64(2**40 - 1)  # five bytes are asked for: what they confuse is sorted out by the shards
        self.doc = np.searchsorted(chunk.off, self.at[self.run], "right") - 1 if len(self.run) else np.zeros(0, np.int64)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, sorted, and the documents of the chunk that hold each."""
        key = np.sort(self.anchor << U64(12) | self.doc.astype(U64))  # a chunk has 4,096 documents at most
        other = np.ones(len(key), bool)
        other[1:] = key[1:] != key[:-1]
        a = key >> U64(12)
        new = np.ones(len(key), bool)
        new[1:] = a[1:] != a[:-1]
        at = np.flatnonzero(new)
        return a[at], np.add.reduceat(other.astype(np.int64), at) if len(at) else at


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of runs, one run after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(before - start, size)


def ask_anchors(chunk: c.Chunk, buckets: int) -> list[tuple[int, tuple[bytes, bytes]]]:
    """The chunk's anchors, and in how many of its documents each stands."""
    keys, counts = Anchors(chunk).counted()
    # anchors of a bucket have one remainder, so only quotients are sent
    return [(b, (c.pack_sorted(keys[at] // U64(buckets))[1], counts[at].astype(np.uint16).tobytes())) for b, at in c.by_bucket(keys, buckets)]


def answer_anchors(asked: list[tuple[bytes, bytes]]) -> list[bytes]:
    """Of each anchor: 0 for one document, 1 for more, 2 for HOT_DOCUMENTS or more."""
    keys, counts = [c.unpack_sorted((len(raw) // 8, raw)) for raw, _ in asked], [np.frombuffer(n, np.uint16) for _, n in asked]
    return [((n > 1).astype(np.uint8) + (n >= HOT_DOCUMENTS)).tobytes() for n in c.totals(keys, counts)]


def _steps(x: np.ndarray) -> bytes:
    """Places as differences modulo 2**32, byte by byte of equal weight."""
    step = np.diff(x.astype(np.uint32), prepend=np.uint32(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes()


def _places(raw: bytes) -> np.ndarray:
    step = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(step, dtype=np.uint32)


def _questions(chunk: c.Chunk, told: dict[int, bytes], buckets: int) -> list[tuple[int, tuple[bytes, ...]]]:
    """The chunk's stretches, by shard: texts, and who has them where."""
    a = Anchors(chunk)
    keys, _ = a.counted()
    kind = np.zeros(len(keys), np.uint8)
    for b, at in c.by_bucket(keys, buckets):
        kind[at] = np.frombuffer(told[b], np.uint8)
    kind = kind[np.searchsorted(keys, a.anchor)] if len(keys) else kind
    some, hot = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
    first, last = a.at[a.run[some]], a.at[a.stop[some]] + LENGTH
    each = a.at[_flat(a.run[hot], a.stop[hot] - a.run[hot] + 1)]
    hot_doc = np.repeat(a.doc[hot], a.stop[hot] - a.run[hot] + 1)
    shard = np.concatenate([a.anchor[some], a.roll.runs(each, each + LENGTH)])
    first, last, doc = np.concatenate([first, each]), np.concatenate([last, each + LENGTH]), np.concatenate([a.doc[some], hot_doc])
    text = a.roll.runs(first, last)
    head, place, count = c.distinct(text)
    order = np.argsort(place)  # who has a text, text by text
    before = np.cumsum(count) - count
    ids = np.array([LEAST if x is None else x for x in chunk.ids], np.int64)
    size = (last - first)[head]
    out = []
    for b, i in c.by_bucket(shard[head], buckets):
        i = i[np.argsort(first[head[i]])]  # in the order of the chunk, so that places and documents differ little
        who = order[_flat(before[i], count[i])]
        docs, own = np.unique(doc[who], return_inverse=True)
        out.append((b, (size[i].astype(np.uint8).tobytes(), chunk.data[_flat(first[head[i]], size[i])].tobytes(), count[i].astype(np.uint32).tobytes(), ids[docs].tobytes(), _steps(own), _steps(first[who]))))
    return out


class Growing:
    """An array that grows at the end, in an unnamed file."""

    def __init__(self, kind: type):
        self.kind, self.n, self.file = np.dtype(kind), 0, tempfile.TemporaryFile()

    def add(self, x: np.ndarray) -> None:
        self.file.write(memoryview(np.ascontiguousarray(x, self.kind)).cast("B"))
        self.n += len(x)

    def read(self) -> np.ndarray:
        self.file.flush()
        return np.memmap(self.file, self.kind, "r", shape=(self.n,)) if self.n else np.zeros(0, self.kind)


class Shard:
    """The stretches of a shard, on disk from their arrival on."""

    def __init__(self, budget: int = BUDGET):
        self.budget = budget
        self.hash, self.size, self.text, self.count, self.doc, self.place = (Growing(k) for k in (np.int64, np.uint8, np.uint8, np.uint32, np.int64, np.uint32))
        self.chunks: list[tuple[int, int]] = []  # number and occurrences of each question

    def add(self, number: int, asked: tuple[bytes, ...]) -> None:
        size, text, count, ids, own, place = asked
        size, text, own = np.frombuffer(size, np.uint8), np.frombuffer(text, np.uint8), _places(own)
        end = np.cumsum(size, dtype=np.int64)
        self.hash.add(c.Rolling(_BYTES[text]).runs(end - size, end).view(np.int64))  # as bytes that needn't be sent
        self.size.add(size)
        self.text.add(text)
        self.count.add(np.frombuffer(count, np.uint32))
        self.doc.add(np.frombuffer(ids, np.int64)[own])
        self.place.add(_places(place))
        self.chunks.append((number, len(own)))

    def _distinct(self, size: np.ndarray, begin: np.ndarray, data: np.ndarray, store: Store) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of distinct texts, and the first stretch of each."""
        queue, n, hashes = Queue(self.budget), len(size), self.hash.read()
        step = max(self.budget // 64, 1)
        for lo in range(0, n, step):
            hi = min(lo + step, n)
            queue.push([hashes[lo:hi] >> np.int64(1), size[lo:hi].astype(np.int64)], np.arange(lo, hi), np.arange(lo, hi))
        eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        number, first, k, last = store.array(n, np.int64), store.array(n, np.int64), 0, None
        for words, _, at in queue.pop():
            same = np.ones(len(at), bool)
            for w, x in zip(words, last or [None] * 2, strict=True):
                same &= np.concatenate([[x is not None and w[0] == x], w[1:] == w[:-1]])
            # equal hashes: the texts themselves are compared
            pair = np.flatnonzero(same)
            before = np.concatenate([[last_at if last else 0], at[:-1]])[pair]
            x, y, own = begin[at[pair]], begin[before], size[at[pair]].astype(np.int64)
            for j in range(0, int(own.max(initial=0)), 8):  # eight bytes at a time, the last ones at the end of the text
                more = np.flatnonzero(own > j)
                to = np.minimum(own[more] - 8, j)
                wrong = eight[x[more] + to] != eight[y[more] + to]
                if wrong.any():
                    same[pair[more[wrong]]] = False
            number[at] = k + np.cumsum(~same) - 1
            new = at[~same]
            first[k : k + len(new)] = new
            k, last, last_at = k + len(new), [int(w[-1]) for w in words], int(at[-1])
        return number, first[:k]

    def answers(self) -> Iterator[tuple[int, tuple[bytes, bytes]]]:
        """For each chunk, the places of strings that stand in a smaller document, as runs."""
        size, data, count, doc, place = (g.read() for g in (self.size, self.text, self.count, self.doc, self.place))
        if not len(size):
            return
        store = Store(self.budget)
        n = len(size)
        begin = store.array(n + 1, np.int64)
        np.cumsum(size, out=begin[1:], dtype=np.int64)
        number, first = self._distinct(size, begin[:-1], data, store)
        m, step = len(first), max(self.budget // 64, 1)
        own, least, stretch = store.array(m, np.int64), store.array(m, np.int64), store.array(len(doc), np.int64)
        least[:] = _NO_DOCUMENT
        for lo in range(0, m, step):
            own[lo : lo + step] = size[first[lo : lo + step]]
        k = 0
        for lo in range(0, n, step):
            of_occurrence = np.repeat(number[lo : lo + step], count[lo : lo + step])
            stretch[k : k + len(of_occurrence)] = of_occurrence
            np.minimum.at(least, of_occurrence, doc[k : k + len(of_occurrence)])
            k += len(of_occurrence)
        at = store.array(m + 1, np.int64)
        np.cumsum(own, out=at[1:])
        for lo in range(0, m + 1, step):
            at[lo : lo + step] += np.arange(lo, min(lo + step, m + 1))  # an end after each text
        text = store.array(int(at[-1]), np.uint16)
        need, of = store.array(len(text), bool), store.array(len(text), np.int32)  # of: the stretch of a string
        for lo in range(0, m, step):
            i = slice(lo, min(lo + step, m))
            text[_flat(at[i], own[i])] = data[_flat(begin[first[i]], own[i])].astype(np.uint16) + 1
            starts = _flat(at[i], own[i] - LENGTH + 1)
            need[starts] = True
            of[starts] = np.repeat(np.arange(i.start, i.stop), own[i] - LENGTH + 1)
        order, common = sort_suffixes(text, need, LENGTH, self.budget, store)
        # suffixes with LENGTH bytes in common are a group; found: its least document
        group, groups = store.array(len(order), np.int64), 0
        for lo in range(0, len(order), self.budget):
            g = groups + np.cumsum(common[lo : lo + self.budget] < LENGTH)
            group[lo : lo + self.budget], groups = g - 1, int(g[-1])
        of_group, found = store.array(groups, np.int64), store.array(len(text), np.int64)
        of_group[:] = _NO_DOCUMENT
        for lo in range(0, len(order), self.budget):
            np.minimum.at(of_group, group[lo : lo + self.budget], least[of[order[lo : lo + self.budget]]])
        for lo in range(0, len(order), self.budget):
            found[order[lo : lo + self.budget]] = of_group[group[lo : lo + self.budget]]
        k = 0
        for chunk, n_own in self.chunks:
            s, d, p = stretch[k : k + n_own], doc[k : k + n_own], place[k : k + n_own].astype(np.int64)
            strings = own[s] - LENGTH + 1
            gone = found[_flat(at[s], strings)] < np.repeat(d, strings)
            edge = np.zeros(len(gone) + 1, bool)
            edge[np.cumsum(strings) - strings] = True
            on = gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]]))
            off = gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))
            off[-1:] |= gone[-1:]
            where = _flat(p, strings)
            if on.any():
                yield chunk, (_steps(where[on]), _steps(where[off] + LENGTH))
            k += n_own


def _answer_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's questions are one shard, which is read as it arrives."""
    shard = Shard()
    for batch in batches:
        for row in batch.column("data"):
            for number, asked in c.unpack(row.as_py()):
                shard.add(number, asked)
    yield from c.together((number, [(0, x)]) for number, x in shard.answers())


def _documents(chunk: c.Chunk, told: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    step = np.zeros(len(chunk.raw) + 1, np.int32)
    for x in told:
        on, off = map(_places, x)
        np.add.at(step, on, 1)
        np.add.at(step, off, -1)
    removed = np.cumsum(step[:-1]) > 0
    sums = prefix(removed)
    begins = np.zeros(len(removed), bool)
    begins[:1] = removed[:1]
    begins[1:] = removed[1:] & ~removed[:-1]
    first = chunk.off[:-1][np.diff(chunk.off) > 0]
    begins[first] = removed[first]
    spans = prefix(begins)
    n_removed = np.diff(sums[chunk.off])
    digests = []
    for i, n in enumerate(n_removed.tolist()):
        lo, hi = chunk.off[i], chunk.off[i + 1]
        digests.append(hashlib.sha256(chunk.data[lo:hi][~removed[lo:hi]].tobytes() if n else chunk.text(i)).hexdigest())
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk.ids, pa.int64()), pa.array(np.diff(chunk.off), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(np.diff(spans[chunk.off]), pa.int64()), pa.array(digests, pa.string())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and a digest of what is left, of every document."""
    buckets = 4 * parts(docs.sparkSession)

    def ask(chunk: c.Chunk) -> list[tuple[int, tuple[bytes, bytes]]]:
        return ask_anchors(chunk, buckets)

    def ask_shards(chunks: Iterator[tuple[int, c.Chunk, dict]]) -> Iterator[pa.RecordBatch]:
        return c.together((number, _questions(chunk, told, buckets)) for number, chunk, told in chunks)

    def finish(chunks: Iterator[tuple[int, c.Chunk, dict]]) -> Iterator[pa.RecordBatch]:
        return (_documents(chunk, list(told.values())) for _, chunk, told in chunks)

    content = c.gather(docs, "chunks")
    # every answer is used once: the steps are one plan, and only the chunks are written
    anchors = c.answered_together(c.asking_together(content, ask), answer_anchors)
    shards = c.returned_together(content, anchors, ask_shards, c.SCHEMA).repartitionById(buckets, F.col("bucket"))
    gone = shards.mapInArrow(_answer_shards, c.SCHEMA).withColumn("bucket", F.spark_partition_id())
    return c.returned_together(content, gone, finish, _RESULT)
