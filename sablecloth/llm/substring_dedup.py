"""Substring dedup over words, by compaction of a de Bruijn graph.

The graph's edges are the k-mers of 35 words, its nodes the 34 words that two
neighbouring edges share; equal words are the same node or edge in all documents.

1. A window of 35 words can repeat only if the least of its hashed eight-word runs
   does; Spark counts these runs, and other windows take no further part.
2. Every place of a node tells which word comes before it and which after.  Joined by
   node, these say which edges stand in two places or more (they are kept), and at
   which nodes the graph branches: where places differ in the word before or after,
   or where a document begins or ends.
3. Kept edges of a document that follow one another are compacted to one path, from one
   branching node to the next.  A path lies whole in every document that holds one of
   its edges, so paths of equal words are found by their hash.
4. Paths are verified: their source documents send the words themselves, once a chunk,
   and a path is repeated only if equal words stand at two coordinates.

Every word of a repeated path is removed, in all copies; nothing else is.

Defined results: a null or empty text has no words; repeated rows are copies of one
another and lose what repeats; the hash of no words is that of the empty string.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as c
from .cluster import forget, parts, written
from .textbytes import U64, hash_spans, padded, words

WINDOW, RUN = 35, 8
NODE = WINDOW - 1
SPAN = WINDOW - RUN + 1
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Words:
    """Words of a chunk and their hashes."""

    def __init__(self, chunk: c.Chunk):
        self.starts, self.ends, self.first = words(chunk.data, chunk.off)
        self.hashes = hash_spans(padded(chunk.data), self.starts, self.ends)
        self.n = len(self.hashes)
        self.roll = c.Rolling(self.hashes)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows, and the least run of each."""
        least = c.least_windows(self.roll, RUN, SPAN)
        at = np.flatnonzero(c.starts_within(self.first, self.n, WINDOW)[: len(least)]) if len(least) else np.zeros(0, np.int64)
        return at, least[at]

    def sampled(self) -> np.ndarray:
        """Hashes of the runs that are the least of a window that they lie in, one for each place."""
        at, least = self.windows()
        runs = self.roll.windows(RUN)
        if not len(at):
            return runs[:0]
        most = np.zeros(len(runs) + SPAN - 1, U64)  # the least run of the window that begins SPAN - 1 before
        most[at + SPAN - 1] = least
        top = ~c.sliding_min(~most, SPAN)  # a run is no less than the least of any window around it
        return runs[(top == runs) & (top > 0)]


def _runs(at: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places as runs of neighbours, first and last; cut: where a run ends before a place in any case."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    if cut is not None:
        new |= cut
    begin = np.flatnonzero(new)
    return at[begin], at[np.append(begin[1:], len(at)) - 1] if len(at) else at


def _places(state: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, last = (np.frombuffer(x, np.uint32).astype(np.int64) for x in c.unpack(state))
    return first, last


def _kept(first: np.ndarray, last: np.ndarray) -> bytes:
    return c.pack((first.astype(np.uint32).tobytes(), last.astype(np.uint32).tobytes()))


def _flat(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(before - first, size)


class Nodes:
    """Places of the nodes on both sides of the windows that may repeat."""

    def __init__(self, w: Words, first: np.ndarray, last: np.ndarray):
        """first, last: runs of windows."""
        self.at = _flat(first, last - first + 2)
        self.key = w.roll.runs(self.at, self.at + NODE)
        # the words around a node; there is none at the ends of a document
        row = np.searchsorted(w.first, self.at, "right") - 1
        low = (w.hashes >> U64(32)).astype(np.uint32) | np.uint32(1)
        lone = np.zeros(0, np.uint32)
        self.before = np.where(self.at > w.first[row], low[self.at - 1], np.uint32(0)) if w.n else lone
        self.after = np.where(self.at + NODE < w.first[row + 1], low[np.minimum(self.at + NODE, w.n - 1)], np.uint32(0)) if w.n else lone
        order = np.lexsort((self.after, self.before, self.key))
        new = np.ones(len(order), bool)
        for x in (self.key, self.before, self.after):
            new[1:] &= x[order][1:] == x[order][:-1]
        new[1:] = ~new[1:]
        self.head = order[new]  # distinct nodes with their neighbours, by key
        self.count = np.diff(np.append(np.flatnonzero(new), len(order)))
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def asked(self, buckets: int) -> list[tuple[int, bytes]]:
        out = []
        for b, at in c.by_bucket(self.key[self.head], buckets):
            i = self.head[at]
            out.append((b, c.pack((c.pack_sorted(self.key[i]), self.before[i].tobytes(), self.after[i].tobytes(), np.minimum(self.count[at], 255).astype(np.uint8).tobytes()))))
        return out

    def told(self, answers: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """At each place: whether the edge to the word after stands elsewhere too, and whether the graph branches."""
        flag = np.zeros(len(self.head), np.uint8)
        for b, at in c.by_bucket(self.key[self.head], buckets):
            flag[at] = np.frombuffer(c.unpack(answers[b]), np.uint8)
        flag = flag[self.of]
        return (flag & 1) > 0, (flag & 2) > 0


def answer_nodes(asked: list[bytes]) -> list[bytes]:
    """Joins all places of a node: 1 if the edge after it repeats, 2 if places differ in a neighbour."""
    told = [c.unpack(x) for x in asked]
    key = np.concatenate([c.unpack_sorted(t[0]) for t in told])
    before, after = (np.concatenate([np.frombuffer(t[k], np.uint32) for t in told]) for k in (1, 2))
    count = np.concatenate([np.frombuffer(t[3], np.uint8) for t in told]).astype(np.int64)
    order = np.lexsort((after, key))
    k, a, b = key[order], after[order], before[order]
    node, edge = np.ones(len(order), bool), np.ones(len(order), bool)
    node[1:] = k[1:] != k[:-1]
    edge[1:] = node[1:] | (a[1:] != a[:-1])
    edges, nodes = np.flatnonzero(edge), np.flatnonzero(node)
    often = (np.add.reduceat(count[order], edges) >= 2)[np.cumsum(edge) - 1] & (a > 0)
    differ = np.minimum.reduceat(a, nodes) != np.maximum.reduceat(a, nodes)
    differ |= np.minimum.reduceat(b, nodes) != np.maximum.reduceat(b, nodes)
    differ |= (np.minimum.reduceat(a, nodes) == 0) | (np.minimum.reduceat(b, nodes) == 0)
    flag = np.empty(len(order), np.uint8)
    flag[order] = often.astype(np.uint8) | (differ[np.cumsum(node) - 1].astype(np.uint8) << 1)
    ends = np.cumsum([len(t[3]) for t in told])
    return [c.pack(flag[e - len(t[3]) : e].tobytes()) for t, e in zip(told, ends, strict=True)]


def _asked_paths(chunk: c.Chunk, w: Words, first: np.ndarray, last: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """The words of each distinct path of a chunk, and at how many coordinates they stand."""
    found: dict[bytes, int] = {}
    text = b" ".join(chunk.raw[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)) if len(first) else b""
    # words joined by one space, so that a path is a slice
    size = w.ends - w.starts
    begin = np.cumsum(size + 1) - size - 1
    for a, b in zip(begin[first].tolist(), (begin + size)[last + WINDOW - 1].tolist(), strict=True):
        path = text[a:b]
        found[path] = found.get(path, 0) + 1
    texts = list(found)
    key = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in texts], U64)
    out = []
    for b, at in c.by_bucket(key, buckets):
        some = [texts[i] for i in at]
        out.append((b, c.pack((some, [min(found[t], 2) for t in some]))))
    return out


def answer_paths(asked: list[bytes]) -> list[bytes]:
    """1 for each path whose words stand at two coordinates."""
    told = [c.unpack(x) for x in asked]
    total: dict[bytes, int] = {}
    for texts, counts in told:
        for t, n in zip(texts, counts, strict=True):
            total[t] = total.get(t, 0) + n
    return [c.pack(bytes(total[t] >= 2 for t in texts)) for texts, _ in told]


def _documents(chunk: c.Chunk, w: Words, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Results of a chunk whose repeated paths are runs of windows."""
    step = np.zeros(w.n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + WINDOW, -1)
    removed = np.cumsum(step)[:-1] > 0
    n_words, n_removed, digests = [], [], []
    for i in range(len(chunk.ids)):
        gone = removed[w.first[i] : w.first[i + 1]]
        all_words = chunk.text(i).split()
        left = compress(all_words, ~gone) if gone.any() else all_words
        n_words.append(len(all_words))
        n_removed.append(int(gone.sum()))
        digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
    return pa.RecordBatch.from_arrays([pa.array(chunk.ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and a digest of the words that are left, of every document."""
    buckets = 4 * parts(docs.sparkSession)

    def ask_runs(chunk: c.Chunk) -> list[tuple[int, bytes]]:
        keys, count = np.unique(Words(chunk).sampled(), return_counts=True)
        return c.ask_counts(keys, np.minimum(count, 2), buckets)

    def ask_nodes(number: int, chunk: c.Chunk, told: list[dict]) -> Iterator[pa.RecordBatch]:
        w = Words(chunk)
        at, least = w.windows()
        keys, place = np.unique(least, return_inverse=True)
        again = c.counts_told(keys, told[0], buckets) >= 2
        first, last = _runs(at[again[place]])
        yield c.rows_of(number, [(c.STATE, _kept(first, last)), *Nodes(w, first, last).asked(buckets)])

    def ask_paths(number: int, chunk: c.Chunk, told: list[dict]) -> Iterator[pa.RecordBatch]:
        w = Words(chunk)
        nodes = Nodes(w, *_places(told[0][c.STATE]))
        often, branches = nodes.told(told[1], buckets)
        first, last = _runs(nodes.at[often], branches[often])
        yield c.rows_of(number, [(c.STATE, _kept(first, last)), *_asked_paths(chunk, w, first, last, buckets)])

    def finish(number: int, chunk: c.Chunk, told: list[dict]) -> Iterator[pa.RecordBatch]:
        w = Words(chunk)
        first, last = _places(told[0][c.STATE])
        yield _documents(chunk, w, *_verified(chunk, w, first, last, told[1], buckets))

    content = c.gather(docs, "chunks")
    runs = c.answered(c.asking(content, ask_runs), c.answer_counts)
    nodes = written(c.returned(content, [runs], ask_nodes, c.SCHEMA), "nodes")
    joined = c.answered(nodes, answer_nodes)
    paths = written(c.returned(content, [nodes.filter(f"bucket = {c.STATE}"), joined], ask_paths, c.SCHEMA), "paths")
    forget(nodes)
    return c.returned(content, [paths.filter(f"bucket = {c.STATE}"), c.answered(paths, answer_paths)], finish, _RESULT)


def _verified(chunk: c.Chunk, w: Words, first: np.ndarray, last: np.ndarray, told: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The paths whose words were found at two coordinates."""
    good: set[bytes] = set()
    for b, data in _asked_paths(chunk, w, first, last, buckets):
        texts, _ = c.unpack(data)
        good.update(compress(texts, c.unpack(told[b])))
    size = w.ends - w.starts
    begin = np.cumsum(size + 1) - size - 1
    text = b" ".join(chunk.raw[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)) if len(first) else b""
    keep = np.array([text[a:b] in good for a, b in zip(begin[first].tolist(), (begin + size)[last + WINDOW - 1].tolist(), strict=True)], bool)
    return first[keep], last[keep]
