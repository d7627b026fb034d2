"""Text and JSON Lines files: scan, clean, and what happens to bad lines.

Frames are the large-scale path: lines with their numbers, cleaned in place.  The
single-file functions keep what only one file can: terminators byte for byte,
and a result that replaces its target at once or not at all.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..errors import LimitError, LineError
from ..functions import texts as t
from ..operators import clean as c
from ..operators.documents import COUNTERS, SAFE, safe_json, to_safe_data
from ..plans.policy import Policy

MAX_LINE = 1_000_000
ON_ERROR = ("raise", "skip", "placeholder")


def _mode(on_error: str) -> None:
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of: {', '.join(ON_ERROR)}")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number, text): lines of text files, numbered within each file from 1.

    LF, CR and CRLF end lines.  Large files are read in splits; a line's number is its
    place in its split and the lines of the splits before, of which there is one row each."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split_start"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"))
    splits = lines.groupBy("path", "split_start").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1))
    known = splits.select("path", "split_start", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lines.join(known, ["path", "split_start"]).select("path", (F.col("place") + F.col("shift")).alias("line_number"), "text")


def scan_text(spark: SparkSession, path: str, policy: Policy | None = None) -> DataFrame:
    """Findings of text files with places `name:line:column`; the first max_findings of a file."""
    policy = policy or Policy()
    found = c.findings_table(text_lines(spark, path), ["text"], ["path", "line_number"], policy).drop("column")
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.row_number().over(Window.partitionBy("path").orderBy("line_number", "start"))
    return found.withColumn("location", F.concat_ws(":", name, "line_number", (F.col("start") + 1).cast("string"))).withColumn("_k", rank).filter(F.col("_k") <= policy.max_findings).drop("_k")


def audit_text(spark: SparkSession, path: str, policy: Policy | None = None) -> DataFrame:
    """One row a file: lines, findings (max_findings at most), and whether and why not all was seen."""
    policy = policy or Policy()
    lines = text_lines(spark, path).select("path", c.result(F.col("text"), policy, audit=True).alias("r"))
    # a line names few limits, so the set of them is small
    seen = lines.groupBy("path").agg(F.count("*").alias("lines"), F.sum(F.size("r.findings")).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("r.limitations")))).alias("limits"))
    # a line too long to be scanned has the name that it has in scan_file()
    limits = F.transform("limits", lambda x: F.when(x == "max_text_chars", "max_line_chars").otherwise(x))
    limits = F.when(F.col("n") >= policy.max_findings, F.array_union(limits, F.array(F.lit("max_findings")))).otherwise(limits)
    return seen.select("path", "lines", F.least("n", F.lit(policy.max_findings)).alias("finding_count"), (F.size(limits) == 0).alias("complete"), limits.alias("limitations"))


def clean_text_files(spark: SparkSession, path: str, output: str, policy: Policy | None = None) -> None:
    """Cleans text files into a folder; the output committer makes it all or nothing.

    LF and CRLF stay as they are; a CR alone stays too but doesn't end a line here.  Names
    of the files aren't kept: clean_file() is for that."""
    lines = spark.read.text(path, lineSep="\n")
    lines.select(c.clean_text(F.col("value"), policy, "raise").alias("value")).write.text(output, lineSep="\n")


def jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number, raw): lines of JSON Lines files as bytes; LF alone ends a line."""
    whole = spark.read.format("binaryFile").load(path)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                lines = body.as_py().split(b"\n")
                lines = lines[:-1] if lines[-1] == b"" else lines
                for i in range(0, len(lines), 10_000):
                    some = lines[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(range(i + 1, i + 1 + len(some)), pa.int64()), pa.array(some, pa.binary())], names=["path", "line_number", "raw"])

    return whole.select("path", "content").mapInArrow(parted, "path string, line_number long, raw binary")


def _parsed(raw: bytes) -> tuple[tuple[object] | None, str | None]:
    """A line's value in a tuple, or the reason why there is none; both None for a blank line."""
    if len(raw) > MAX_LINE:
        return None, "max_line_bytes"
    try:
        text = raw.decode("utf-8").strip()
        return ((json.loads(text),) if text else None), None
    except UnicodeDecodeError:
        return None, "invalid_utf8"
    except json.JSONDecodeError:
        return None, "invalid_json"


def _line(raw: bytes, policy: Policy) -> tuple[dict | None, str | None]:
    """A clean record, or the reason why there is none; both None for a blank line."""
    value, reason = _parsed(raw)
    if value is None:
        return None, reason
    made = to_safe_data(value[0], policy)
    return {"cleaned": json.dumps(made.cleaned, allow_nan=False), "complete": made.complete, "limitations": list(made.limitations), "stats": made.stats}, None


def placeholder(reason: str, number: int) -> str:
    return json.dumps({"_error": reason, "_line": number})


def safe_jsonl(lines: DataFrame, policy: Policy | None = None, on_error: str = "raise") -> DataFrame:
    """(path, line_number, result, error) of lines (path, line_number, raw); blank ones go but count."""
    _mode(on_error)
    policy = policy or Policy()
    kind = pa.struct([("cleaned", pa.string()), ("complete", pa.bool_()), ("limitations", pa.list_(pa.string())), ("stats", pa.struct([(n, pa.int64()) for n in COUNTERS]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, number, raw in zip(*(batch.column(n).to_pylist() for n in ("path", "line_number", "raw")), strict=True):
                made, reason = _line(raw or b"", policy)
                if reason:
                    if on_error == "raise":
                        raise LineError(number, reason)
                    if on_error == "placeholder":
                        made = {"cleaned": placeholder(reason, number), "complete": False, "limitations": [reason], "stats": dict.fromkeys(COUNTERS, 0)}
                if made or reason:
                    rows.append((path, number, made, reason))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind), pa.array([r[3] for r in rows], pa.string())], names=["path", "line_number", "result", "error"])

    return lines.mapInArrow(run, f"path string, line_number long, result {SAFE}, error string")


def jsonl_stats(records: DataFrame, lines: DataFrame) -> DataFrame:
    """One row a file: lines read, written, invalid, skipped and replaced."""
    read = lines.groupBy("path").agg(F.count("*").alias("lines_read"))
    seen = records.groupBy("path").agg(F.count("result").alias("written"), F.count("error").alias("invalid"), F.sum((F.col("error").isNotNull() & F.col("result").isNull()).cast("int")).alias("skipped"), F.sum((F.col("error").isNotNull() & F.col("result").isNotNull()).cast("int")).alias("placeholders"), F.min(F.coalesce("result.complete", F.lit(False))).alias("complete"))
    return read.join(seen, "path", "left").select("path", "lines_read", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("written", "invalid", "skipped", "placeholders")), F.coalesce("complete", F.lit(True)).alias("complete"))


def clean_jsonl(spark: SparkSession, path: str, output: str, policy: Policy | None = None, on_error: str = "raise") -> DataFrame:
    """Cleans JSON Lines files into a folder of text files; returns their statistics."""
    lines = jsonl_lines(spark, path)
    records = safe_jsonl(lines, policy, on_error)
    records.filter("result IS NOT NULL").select(F.col("result.cleaned").alias("value")).write.text(output)
    return jsonl_stats(records, lines)


# One file, on the driver


def _bounded(path: str | Path, encoding: str) -> Iterator[tuple[int, str | None]]:
    """Lines with their terminators; None for one that is too long."""
    with open(path, encoding=encoding, errors="replace", newline="") as f:
        number = 0
        while line := f.readline(MAX_LINE + 1):
            number += 1
            if len(line) > MAX_LINE and not line.endswith(("\n", "\r")):
                while (more := f.readline(MAX_LINE)) and not more.endswith(("\n", "\r")):
                    pass
                yield number, None
            else:
                yield number, line


def scan_file(path: str | Path, policy: Policy | None = None, encoding: str = "utf-8") -> tuple[list[t.Finding], list[str]]:
    """Findings with places, and limitations, of one text file."""
    import dataclasses

    policy = policy or Policy()
    found: list[t.Finding] = []
    limits: list[str] = []
    for number, line in _bounded(path, encoding):
        if line is None:
            limits += ["max_line_chars"] * ("max_line_chars" not in limits)
            continue
        try:
            more = t.inspect(line, policy)
        except LimitError as e:
            limits += [e.limit] * (e.limit not in limits)
            continue
        found += [dataclasses.replace(f, location=f"{Path(path).name}:{number}:{f.start + 1}") for f in more]
        if len(found) >= policy.max_findings:
            limits.append("max_findings")
            return found[: policy.max_findings], limits
    return found, limits


def _target(path: str | Path, output: str | Path) -> tuple[Path, Path]:
    """The files that are read and replaced, behind links; raises where they can't be."""
    source, target = (Path(os.path.realpath(os.path.expanduser(p))) for p in (path, output))
    for file, needed in ((source, True), (target, False)):
        if file.is_dir():
            raise IsADirectoryError(file)
        if needed and not file.exists():
            raise FileNotFoundError(file)
        if file.exists() and not file.is_file():
            raise ValueError("input and output must be regular files")
    if not target.parent.is_dir():
        raise (NotADirectoryError if target.parent.exists() else FileNotFoundError)(target.parent)
    if target != source and target.exists() and target.samefile(source):
        raise ValueError("the output is a hard-link to the input; name the input itself to clean it in place")
    return source, target


def _replaced(source: Path, target: Path, encoding: str, write: Callable) -> None:
    """Writes a neighbour, flushes it to disk and puts it in place at once, with the mode of
    what it replaces, or of the input."""
    mode = (target if target.exists() else source).stat().st_mode & 0o7777
    handle, temp = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with open(handle, "w", encoding=encoding, newline="") as f:
            write(f)
            f.flush()
            os.chmod(temp, mode)
            os.fsync(f.fileno())
        os.replace(temp, target)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise
    # the new name must be on disk too
    folder = os.open(target.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def clean_file(path: str | Path, output: str | Path, policy: Policy | None = None, encoding: str = "utf-8") -> Path:
    """Cleans one text file; terminators and encoding stay, a block or a limit leaves the output as it was.

    Links are followed; the input itself may be the output."""
    policy = policy or Policy()
    source, target = _target(path, output)

    def write(f) -> None:  # noqa: ANN001
        for _, line in _bounded(source, encoding):
            if line is None:
                raise LimitError("max_line_chars", MAX_LINE)
            f.write(t.redact(line, policy)[0])

    _replaced(source, target, encoding, write)
    return Path(output)


def iter_safe_jsonl(path: str | Path, policy: Policy | None = None, on_error: str = "raise") -> Iterator[tuple[int, dict]]:
    """Clean records of one JSON Lines file, lazily."""
    _mode(on_error)
    policy = policy or Policy()
    with open(path, "rb") as f:
        number = 0
        while raw := f.readline(MAX_LINE + 2):
            number += 1
            body = raw.rstrip(b"\n")
            if len(body) > MAX_LINE:
                while raw and not raw.endswith(b"\n"):
                    raw = f.readline(MAX_LINE)
            made, reason = _line(body, policy)
            if reason and on_error == "raise":
                raise LineError(number, reason)
            if reason and on_error == "placeholder":
                made = {"cleaned": placeholder(reason, number), "complete": False, "limitations": [reason], "stats": dict.fromkeys(COUNTERS, 0)}
            if made:
                yield number, made


def append_jsonl(value: object, stream, policy: Policy | None = None) -> None:  # noqa: ANN001
    """Appends one clean record to a text stream."""
    stream.write(safe_json(value, policy, separators=(",", ":")) + "\n")


def scanned_jsonl(lines: DataFrame, policy: Policy | None = None, on_error: str = "skip") -> DataFrame:
    """(path, line_number, findings, complete, error) of lines with findings or without a full look.

    Lines that can't be read raise, are skipped, or (placeholder) have a row that names the error."""
    from ..operators.documents import audit_value

    _mode(on_error)
    policy = policy or Policy()
    kind = pa.struct([("rule_name", pa.string()), ("category", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string()), ("reason", pa.string()), ("location", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, number, raw in zip(*(batch.column(n).to_pylist() for n in ("path", "line_number", "raw")), strict=True):
                value, reason = _parsed(raw or b"")
                if reason and on_error == "raise":
                    raise LineError(number, reason)
                if value is None:
                    if reason and on_error == "placeholder":
                        rows.append((path, number, [], False, reason))
                    continue
                found, limits = audit_value(value[0], policy)
                if found or limits:
                    rows.append((path, number, [vars(f) for f in found], not limits, None))
            types = [pa.string(), pa.int64(), pa.list_(kind), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind_) for i, kind_ in enumerate(types)], names=["path", "line_number", "findings", "complete", "error"])

    return lines.mapInArrow(run, f"path string, line_number long, findings array<{t.FINDING}>, complete boolean, error string")


def safe_show(df: DataFrame, n: int = 20, policy: Policy | None = None) -> None:
    """Shows the first rows, cleaned."""
    from ..plans.compiler import clean_frame

    clean_frame(df, policy).show(n, truncate=80)


def column_json(value: Column, policy: Policy | None = None) -> Column:
    """to_json of a nested column, then cleaned as a document."""
    from ..operators.documents import clean_json

    return clean_json(F.to_json(value), policy)["cleaned"]
