"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Every passage (shares of kinds of
characters and words, hashed three-byte runs and hashed words) is encoded by a small
network, a gate weighs the passages (softmax of w . tanh(Vh) * sigmoid(Uh)), and
the weighted mean is scored.  Labels exist for documents only; the gate learns
which passages decide them.  The model is fitted with numpy on the driver over a
bounded sample of labelled rows (FIT_DOCUMENTS, the rows of least hash), with all
passages of each (82 numbers for 64 words); scoring runs over all documents.  Only the text is an input.

Defined results: a null or empty text is one empty passage and gets a score;
labels that are null or whose document is missing teach nothing; repeated labels
count once (the largest); without two classes of labels every score is the share
of label 1, or 0.5 without labels.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textbytes import U64, column_bytes, hash_spans, padded, prefix, slices, words

#: Most labelled documents that the fit collects; larger inputs are sampled down to it.
FIT_DOCUMENTS = 6000
PASSAGE_WORDS = 64
THRESHOLD = 0.3
HIDDEN, GATE, EPOCHS, BATCH, RATE = 24, 12, 30, 128, 0.01

_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b"#*$%&<>")] = 1
_KINDS[list(b"|")] = 2
_KINDS[list(b"!?")] = 3
_KINDS[list(b".,;:")] = 4
_KINDS[48:58] = 5
_KINDS[65:91] = 6
_KINDS[97:123] = 7
_KINDS[128:] = 8
_KINDS[[0x0A, 0x0D]] = 9
_N_KINDS = 10
_SHARES = _N_KINDS + 8
#: Buckets of hashed runs of three bytes and of hashed words of a passage, and their weight.
GRAMS, WORDS, HASHED = 48, 16, 4.0
FEATURES = _SHARES + GRAMS + WORDS
_ODD = U64(0x9E3779B97F4A7C15)


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the first passage of each row (n + 1 places)."""
    starts, ends, first = words(data, off)
    hashes = hash_spans(padded(data), starts, ends)
    per_row = np.diff(first)
    count = np.maximum(-(-per_row // PASSAGE_WORDS), 1)
    at = prefix(count)
    row = np.repeat(np.arange(len(per_row)), count)
    k = np.arange(len(row)) - at[row]
    begin = np.minimum(first[row] + k * PASSAGE_WORDS, first[row + 1])
    end = np.minimum(begin + PASSAGE_WORDS, first[row + 1])
    n = (end - begin).astype(np.float64)
    some = np.maximum(n, 1)
    place = np.append(starts, len(data))
    lo = np.where(k == 0, off[row], place[begin])
    hi = np.where(end >= first[row + 1], off[row + 1], place[np.minimum(end, len(place) - 1)])
    size = np.maximum(hi - lo, 1)
    x = np.zeros((len(row), FEATURES))
    kinds = _KINDS[data]
    for i in range(_N_KINDS):
        c = prefix(kinds == i)
        x[:, i] = (c[hi] - c[lo]) / size
    length = (ends - starts).astype(np.float64)
    twice = np.zeros(len(hashes), bool)
    twice[1:] = hashes[1:] == hashes[:-1]
    last = kinds[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    order = np.lexsort((hashes, np.searchsorted(begin, np.arange(len(hashes)), "right")))
    group = np.searchsorted(begin, np.arange(len(hashes)), "right")
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (group[order][1:] != group[order][:-1])
    fresh = np.zeros(len(hashes), bool)
    fresh[order[new]] = True
    for i, v in enumerate((length, length > 12, twice, fresh, (last == 1) | (last == 3), length == 1)):
        c = np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)])
        x[:, _N_KINDS + i] = (c[end] - c[begin]) / some
    x[:, _N_KINDS] /= 10
    x[:, _N_KINDS + 6] = np.log1p(n) / 5
    x[:, _N_KINDS + 7] = n == 0
    # shares of hashed three-byte runs (lower-cased, of the passage a run begins in) and words
    if len(data) > 2:
        low = np.where((data >= 65) & (data <= 90), data | 32, data).astype(U64)
        gram = ((low[:-2] << U64(16) | low[1:-1] << U64(8) | low[2:]) * _ODD >> U64(32)) % U64(GRAMS)
        of = np.repeat(np.arange(len(row)), np.maximum(hi - lo, 0))[: len(gram)]
        x[:, _SHARES : _SHARES + GRAMS] = _shares(of[: len(gram)], gram[: len(of)], len(row), GRAMS)
    if len(hashes):
        of = np.repeat(np.arange(len(row)), end - begin)
        x[:, _SHARES + GRAMS :] = _shares(of, hashes % U64(WORDS), len(row), WORDS)
    return x, at


def _shares(of: np.ndarray, bucket: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Square roots of the shares of buckets within each passage."""
    count = np.bincount(of * buckets + bucket.astype(np.int64), minlength=n * buckets).reshape(n, buckets)
    return HASHED * np.sqrt(count / np.maximum(count.sum(axis=1, keepdims=True), 1))


class Model:
    """Weights of the encoder, the gate and the score; numbers of inputs are standardised first."""

    def __init__(self, x: np.ndarray, share: float, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        self.w = [r.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), r.normal(0, GATE**-0.5, GATE), r.normal(0, HIDDEN**-0.5, HIDDEN), np.array([np.log(share / (1 - share))])]

    def forward(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple]:
        w1, b1, v, u, g, c, b = self.w
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ w1 + b1)
        hv, hu = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (hv * hu) @ g
        n = np.diff(at)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at[:-1]), n))
        a = e / np.repeat(np.add.reduceat(e, at[:-1]), n)
        bag = np.add.reduceat(h * a[:, None], at[:-1], axis=0)
        return 1 / (1 + np.exp(-(bag @ c + b[0]))), (z, h, hv, hu, a, bag)

    def gradient(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w1, _, v, u, g, c, _ = self.w
        p, (z, h, hv, hu, a, bag) = self.forward(x, at)
        n = np.diff(at)
        d = (p - y) / len(y)
        dbag = np.repeat(d[:, None] * c, n, axis=0)
        da = (dbag * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, at[:-1]), n))
        dhv, dhu = de[:, None] * g * hu * (1 - hv**2), de[:, None] * g * hv * hu * (1 - hu)
        dh = (dbag * a[:, None] + dhv @ v.T + dhu @ u.T) * (1 - h**2)
        return [z.T @ dh, dh.sum(axis=0), h.T @ dhv, h.T @ dhu, (hv * hu).T @ de, bag.T @ d, np.array([d.sum()])]

    def fit(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> Model:
        r = np.random.default_rng(11)
        m, s, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(y))
            for i in range(0, len(y), BATCH):
                rows = np.sort(order[i : i + BATCH])
                n = at[rows + 1] - at[rows]
                part = prefix(n)
                take = np.arange(part[-1]) - np.repeat(part[:-1], n) + np.repeat(at[rows], n)
                t += 1
                rate = RATE * (1 - epoch / EPOCHS) + 1e-4
                for k, d in enumerate(self.gradient(x[take], part, y[rows])):
                    d = d + 1e-5 * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    s[k] = 0.999 * s[k] + 0.001 * d**2
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self


def _passage_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = column_bytes(batch.column("text"))
        blobs: list[bytes] = []
        for i, j in slices(off):
            x, at = passages(data[off[i] : off[j]], off[i : j + 1] - off[i])
            blobs += [x[at[k] : at[k + 1]].astype(np.float32).tobytes() for k in range(j - i)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(blobs, pa.binary())], names=["label", "x"])


def held_out(doc_id: Column) -> Column:
    """Every fifth document by checksum; its label is for tests only."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_DOCUMENTS) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Learns from labels of documents that aren't held out; returns the scoring function."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max(F.col(label).cast("int")).alias("label"))
    sample = known.orderBy(F.xxhash64("labelled"), "labelled").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most `most` rows of two numbers, so a broadcast is safe at any size of the corpus
    bags = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).select("label", "text").mapInArrow(_passage_batches, "label int, x binary").collect()
    bags = sorted((r["label"], bytes(r["x"])) for r in bags)
    y = np.array([r[0] for r in bags], np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return lambda x, at: np.full(len(at) - 1, share)
    parts = [np.frombuffer(r[1], np.float32).reshape(-1, FEATURES) for r in bags]
    x = np.concatenate(parts).astype(np.float64)
    model = Model(x, y.mean()).fit(x, prefix(np.array([len(p) for p in parts])), y)
    return lambda x, at: model.forward(x, at)[0]


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """The columns named by keep (the others of docs need not pass through Python),
    the score and the prediction of every document."""
    model = fit(docs, labels, label)
    names = keep or ["doc_id"]
    rows = docs.select(*names, *(["text"] if "text" not in names else []))
    out = [f for f in rows.schema.fields if f.name in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column("text"))
            p = [model(*passages(data[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in slices(off)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in out), pa.array(np.concatenate(p) if p else np.zeros(0))], names=[*(f.name for f in out), "score"])

    return rows.mapInArrow(scored, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The documents that the classifier doesn't reject, columns unchanged."""
    model = fit(docs, labels, label)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(batch.schema.get_field_index("text")))
            p = [model(*passages(data[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in slices(off)]
            yield batch.filter(pa.array(np.concatenate(p) >= THRESHOLD)) if p else batch

    return docs.mapInArrow(kept, docs.schema)
