"""Document fingerprints by consistent weighted sampling.

Each document is a weighted set: its runs of five words with their counts.  For
sample k every term draws r and c from Gamma(2, 1) and b from [0, 1); with
weight w it gets t = floor(ln w / r + b) and the value ln c - r (t - b + 1), and
the term of least value (with its t) is the sample.  Two documents agree on a
sample with a probability that equals the generalised Jaccard similarity
sum(min w) / sum(max w).  Draws are functions of the term and k alone, so every
executor makes the same ones.

Defined results: a null text is the empty text; an empty text has one fixed
fingerprint, which agrees with itself only; a text of fewer than five words is
one term.  Rows of equal doc_id are ordered by their text, a null doc_id comes
before all others.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .cluster import parts
from .textbytes import U64, hash_spans, keyed_by_row, mix, mix1, shingles, words

SAMPLES = 64
SHINGLE_WORDS = 5
#: Bytes of text whose terms are sampled at once: the arrays then stay in cache.
CHUNK_BYTES = 500_000
_ODD = np.array([mix1(1000 + k) | 1 for k in range(256)], dtype=U64)
_SPREAD = U64(0xD6E8FEB86659FD93)
_NONE = U64(2**64 - 1)


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        step = (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12)
        x = np.maximum(x - np.clip(step, -1, 1), 1e-6)
    return x


_R = _gamma_quantiles(1 << 16).astype(np.float32)
_LN_C = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)


def signatures(terms: np.ndarray, weights: np.ndarray, begin: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The least (value, term) of every group of terms for every sample, packed in 64 bits.

    begin: where each group starts; an empty group gets the largest number."""
    out = np.empty((samples, len(begin)), U64)
    n = len(terms)
    packed = np.empty(n + 1, U64)
    packed[n] = _NONE
    low = (terms >> U64(32)).astype(np.uint32)
    heavy = np.flatnonzero(weights > 1)
    ln_w = np.log(weights[heavy]).astype(np.float32)
    empty = np.diff(np.append(begin, n)) == 0
    value, near, b = (np.empty(n, np.float32) for _ in range(3))
    for k in range(samples):
        x = terms * _ODD[k]
        x ^= x >> U64(32)
        x *= _SPREAD
        r = _R.take(x.view(np.uint16)[3::4], mode="clip")
        _LN_C.take(x.view(np.uint16)[2::4], mode="clip", out=value)
        np.multiply(x.view(np.uint32)[0::2], np.float32(2.0**-32), out=b, casting="unsafe", dtype=np.float32)
        np.subtract(np.float32(1), b, out=near)
        if len(heavy):
            near[heavy] += np.floor(ln_w / r[heavy] + b[heavy])
        near *= r
        value -= near
        value += np.float32(64)  # now positive, so its bits are ordered as it is
        packed.view(np.uint32)[1 : 2 * n : 2] = value.view(np.uint32)
        packed.view(np.uint32)[0 : 2 * n : 2] = low
        least = np.minimum.reduceat(packed, begin) if len(begin) else packed[:0]
        least[empty] = _NONE
        out[k] = least
    return out


def codes(packed: np.ndarray) -> np.ndarray:
    """Sixteen bits of each sample; rows are documents."""
    x = packed * _SPREAD
    x ^= x >> U64(29)
    x *= _ODD[0]
    return (x >> U64(48)).astype(">u2").T


def weighted_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, keyed by document, and their counts."""
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    starts, ends, first = words(data[: off[-1]], off)
    return keyed_by_row(*shingles(hash_spans(data, starts, ends), first, SHINGLE_WORDS))


def fingerprint_pairs(texts: list[bytes], edited: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts and of their edited forms; a term that both hold with one weight is sampled once."""
    n = len(texts)
    (a, wa), (b, wb) = weighted_terms(texts), weighted_terms(edited)
    at = np.minimum(np.searchsorted(a, b), max(len(a) - 1, 0))
    twin = (a[at] == b) & (wa[at] == wb) if len(a) else np.zeros(len(b), bool)
    lone = np.ones(len(a), bool)
    lone[at[twin]] = False
    keys = [b[twin], a[lone], b[~twin]]
    rows = np.arange(n, dtype=U64) << U64(52)
    begin, before = [], 0
    for part in keys:
        begin.append(np.searchsorted(part, rows) + before)
        before += len(part)
    terms = mix(np.concatenate(keys) & U64(2**52 - 1))
    least = signatures(terms, np.concatenate([wb[twin], wa[lone], wb[~twin]]), np.concatenate(begin))
    both, own, other = least[:, :n], least[:, n : 2 * n], least[:, 2 * n :]
    return codes(np.minimum(both, own)), codes(np.minimum(both, other))


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str, bool]]]:
    """Runs of rows in order; the last of a run is the first of the next."""
    rows: list[tuple[int | None, str, bool]] = []
    size = 0
    for batch in batches:
        column = batch.column("text")
        for i, (doc_id, copy) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), strict=True)):
            text = column[i].as_py() or ""
            rows.append((doc_id, text, copy))
            size += len(text)
            if len(rows) > 1 and (size >= CHUNK_BYTES or len(rows) == 4096):
                yield rows
                rows, size = rows[-1:], len(text)
    if rows:
        yield rows


def _fingerprint_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _chunks(batches):
        texts = [t for _, t, _ in rows]
        edited = []
        for (_, text, copy), (_, following, _) in zip(rows, rows[1:], strict=False):
            q = 0 if copy else len(text) // 4
            edited.append((text[: len(text) - q] + following[:q]).encode())
        n = sum(not copy for _, _, copy in rows[: len(edited)])
        if not n:
            continue
        own, other = fingerprint_pairs([t.encode() for t in texts[: n + 1]], [*edited[:n], b""])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows[:n]], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited[:n]]),
                pa.array([own[i].tobytes().hex() for i in range(n)]),
                pa.array([other[i].tobytes().hex() for i in range(n)]),
                pa.array((own[:n] == other[:n]).mean(axis=1)),
                pa.array((own[:n] == own[1 : n + 1]).mean(axis=1)),
            ],
            schema=_ARROW,
        )


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key, by bisection of a constant array."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def halved(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        over = F.get(table, middle) <= key
        return F.when(at["lo"] >= at["hi"], at).otherwise(F.struct(F.when(over, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(over, at["hi"]).otherwise(middle).alias("hi")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halved, lambda at: at["lo"])


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its text with the end replaced by the
    beginning of the next document's, and how alike these are.

    Documents are dealt out once, by ranges of doc_id of equal counts; the first
    document of each range is also sent to the range before it (the very first
    to the last), so each task sees every successor it needs and no task more
    than its range."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    n = parts(spark)
    cuts = rows.select("key").stat.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = sorted({int(c) for c in cuts})
    placed = rows.withColumn("place", _place(F.col("key"), bounds))
    # a row a range: as many as there are shuffle partitions, whatever the input
    heads = sorted((r["place"], r["head"]) for r in placed.groupBy("place").agg(F.min("key").alias("head")).collect())
    before = spark.createDataFrame([(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)], "head long, before int")
    joined = placed.join(F.broadcast(before), F.col("key") == F.col("head"), "left")
    own, copy = (F.struct(F.col(c).alias("place"), F.lit(what).alias("copy")) for c, what in (("place", False), ("before", True)))
    dealt = joined.select("doc_id", "text", "key", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("to")).select("doc_id", "text", "key", "to.*")
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("place").cast("int")).sortWithinPartitions("copy", "key", "text")
    return ordered.select("doc_id", "text", "copy").mapInArrow(_fingerprint_partition, _SCHEMA)
