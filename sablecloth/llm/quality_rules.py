"""Quality rules with thresholds that follow the data.

Fixed rules come first: too few words, or mostly repeated three-word windows.
The documents that pass them are judged against those of the same language and source.
Each group's ratios go into quantile sketches: counts by buckets whose bounds grow by
GROWTH, so any quantile is known to one percent, sketches merge by adding, and equal
data give equal sketches.  A document is dropped when a ratio lies above its group's
threshold: UPPER quantile + SPREADS * (UPPER quantile - median) + UNITS * (what one
symbol, line or word makes of a median document).  Nothing in it is a fixed cutoff.
Small groups lean on their language: its sketch, brought down to POINTS quantiles, is
merged into the group's as SHRINK more documents, and that of all documents into the
language's in the same way, so no size of a group switches to other rules.

Defined results: a null text has no words and fails the fixed rules; a null
language or source is a group of its own; rows of equal doc_id are judged one by
one; a group whose documents all fail the fixed rules has no thresholds; an empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .cluster import written
from .textbytes import U64, column_bytes, hash_spans, padded, prefix, shingles, slices, words

#: Fixed rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Ratios, and the size of a document that each is counted in.
RATIOS = {"symbol_ratio": "word_chars", "upper_ratio": "word_chars", "dup_line_ratio": "n_lines", "repeat_ratio": "n_words"}
#: The threshold's quantile (more than that share of a group may not be junk), and its terms.
UPPER, SPREADS, UNITS = 0.85, 16.0, 4.0
#: Documents, at as many quantiles, that the level above adds to a group's sketch.
SHRINK, POINTS = 100, 20
#: Growth of the bounds of a sketch's buckets, and the bucket of zero.
GROWTH, ZERO = 1.02, -1_000_000

_FLAGS = np.zeros(256, np.uint8)
_FLAGS[list(b"#*$%&|<>")] = 1
_FLAGS[list(range(65, 91))] = 2
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_upper long"


def text_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every row; see the query's contract for their meaning."""
    n = len(off) - 1
    out = {c.split()[0]: np.zeros(n, np.int64) for c in _COUNTS.split(", ")}
    flags = _FLAGS[data]
    out["n_symbols"] = np.diff(prefix(flags == 1)[off])
    out["n_upper"] = np.diff(prefix(flags == 2)[off])
    for i, j in slices(off):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, first = words(part, o)
        out["n_words"][i:j] = np.diff(first)
        lead = prefix((part & 0xC0) != 0x80)
        out["word_chars"][i:j] = np.diff(prefix(lead[ends] - lead[starts])[first])
        hashes = hash_spans(padded(part), starts, ends)
        whole = np.diff(first) >= 3
        value, row = shingles(hashes, first, 3)
        value, row = value[whole[row]], row[whole[row]]
        window = first[:-1][row] + np.arange(len(row)) - np.searchsorted(row, row, "left")
        order = np.lexsort((value, row))
        same = (value[order][1:] == value[order][:-1]) & (row[order][1:] == row[order][:-1])
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        at = window[order[again]]
        step = np.zeros(len(starts) + 4, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + 3, -1)
        out["n_repeat_words"][i:j] = np.diff(prefix(np.cumsum(step)[: len(starts)] > 0)[first])
        raw = part.tobytes()
        for k in range(i, j):
            seen: set[bytes] = set()
            lines = again_lines = 0
            for line in raw[o[k - i] : o[k - i + 1]].split(b"\n"):
                if line.strip(b" \t\n\r\v\f"):
                    lines += 1
                    if line in seen:
                        again_lines += 1
                    else:
                        seen.add(line)
            out["n_dup_lines"][k], out["n_lines"][k] = again_lines, lines
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = text_counts(*column_bytes(batch.column("text")))
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(v) for v in counts.values())], names=[*names, *counts])


def with_counts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_count_batches, f"doc_id long, lang string, source string, {_COUNTS}")
    chars, total = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return counted.withColumns(
        {
            "symbol_ratio": F.col("n_symbols") / chars,
            "upper_ratio": F.col("n_upper") / chars,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "repeat_ratio": F.col("n_repeat_words") / total,
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
        }
    )


def bucket_of(x: Column) -> Column:
    return F.when(x > 0, F.ceil(F.log(x) / F.lit(math.log(GROWTH))).cast("int")).otherwise(ZERO)


def value_of(bucket: Column) -> Column:
    """The middle of a bucket."""
    return F.when(bucket == ZERO, 0.0).otherwise(F.pow(F.lit(GROWTH), bucket) * (2 / (1 + GROWTH)))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, name, bucket, n): partial sums first, so a hot group costs as many rows as it has buckets."""
    values = [F.struct(F.lit(name).alias("name"), F.col(name).alias("x")) for name in RATIOS]
    values += [F.struct(F.lit(size).alias("name"), (1 / F.greatest(F.col(size), F.lit(1))).alias("x")) for size in dict.fromkeys(RATIOS.values())]
    long = counted.filter("NOT base_failed").select("lang", "source", F.explode(F.array(*values)).alias("v"))
    return long.groupBy("lang", "source", F.col("v.name").alias("name"), bucket_of(F.col("v.x")).alias("bucket")).agg(F.count("*").alias("n"))


def _placed(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets with the number of documents up to each, and of all."""
    merged = sketch.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "name")
    return merged.select("*", F.sum("n").over(whole).alias("all"), F.sum("n").over(whole.orderBy("bucket")).alias("so_far"))


def _at(share: float) -> Column:
    return F.min(F.when(F.col("so_far") >= share * F.col("all"), F.col("bucket")))


def _points(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, bucket, n): POINTS quantiles, SHRINK documents in all."""
    found = _placed(sketch, keys).groupBy(*keys, "name").agg(F.array(*(_at((k + 0.5) / POINTS) for k in range(POINTS))).alias("at"))
    return found.select(*keys, "name", F.explode("at").alias("bucket"), F.lit(SHRINK / POINTS).alias("n"))


def _leaning(sketch: DataFrame, keys: list[str], above: DataFrame, by: list[str]) -> DataFrame:
    """The sketch of the groups of keys with the points of the level above, which has the keys in by."""
    own = sketch.select(*keys, "name", "bucket", F.col("n").cast("double").alias("n"))
    above = above.select(*(F.col(c).alias(f"up_{c}") for c in by), F.col("name").alias("up_name"), "bucket", "n")
    alike = F.col("name") == F.col("up_name")
    for c in by:
        alike &= F.col(c).eqNullSafe(F.col(f"up_{c}"))
    return own.union(sketch.select(*keys, "name").distinct().join(above, alike).select(*keys, "name", "bucket", "n"))


def thresholds(counted: DataFrame) -> DataFrame:
    """One row for each language and source: the largest ratio that is kept."""
    sketch = written(sketches(counted), "quality-sketches")
    language = _leaning(sketch, ["lang"], _points(sketch, []), [])
    group = _leaning(sketch, ["lang", "source"], _points(language, ["lang"]), ["lang"])
    found = _placed(group, ["lang", "source"]).groupBy("lang", "source", "name").agg(value_of(_at(0.5)).alias("half"), value_of(_at(UPPER)).alias("high"))
    of = lambda name, what: F.max(F.when(F.col("name") == name, F.col(what)))
    limits = [(of(name, "high") + SPREADS * (of(name, "high") - of(name, "half")) + UNITS * of(size, "half")).alias(f"most_{name}") for name, size in RATIOS.items()]
    return found.groupBy(F.col("lang").alias("group_lang"), F.col("source").alias("group_source")).agg(*limits)


def judge(docs: DataFrame) -> DataFrame:
    """Counts, ratios, thresholds and verdicts of all documents."""
    counted = written(with_counts(docs), "quality-counts")
    limits = thresholds(counted)
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("group_lang")) & F.col("source").eqNullSafe(F.col("group_source")), "left")
    outlying = F.lit(False)
    for name in RATIOS:
        outlying |= F.coalesce(F.col(name) > F.col(f"most_{name}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~outlying).drop("group_lang", "group_source")
