"""Secret scans: patterns, and a battery of randomness tests for other tokens.

Patterns give the base spans.  The method looks at every run of 20 or more
characters of the base-64 alphabets: it infers the encoding (hexadecimal, base 32,
base 36, base 64), tests the symbols for uniformity (chi-squared), for runs above
and below the middle, and for serial correlation, and combines the three by
Fisher's method.  Runs without digits whose capitals stand as in words and names serve
as decoys (a random run of one case alone is one too, and isn't reported).  Within each class of length, the cut is the strictest score at which
decoys are at most FALSE_SHARE as many as candidates: false discoveries are
controlled where tests are weak (short tokens) and where they are strong alike.
DataFrame functions only; the counts behind the cuts cover all documents.

Offsets are code points.  Defined results: a null text is empty and has no
spans; repeated rows are scanned one by one; an empty table gives no rows.  Extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .cluster import written

#: Kinds of spans in the order in which they are listed.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ACCESS, HEX, RUN = "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_=-]{20,}"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Capitals that don't stand as in words: two of them beside a small letter.
ODD_CASE = "[a-z][A-Z]{2}|[A-Z]{2}[a-z]"
#: Upper ends of the classes of length; false discoveries a candidate; least combined p.
LENGTHS, FALSE_SHARE, LEAST_P = [24, 32, 48, 80], 0.05, 0.01
#: Bins of -log10 p, a tenth each.
MOST_BIN = 60


def _spans(text: Column, pattern: str, maybe: Column, group: int = 0) -> Column:
    """array<struct<s, e, t>>: starts and ends of the matches, and the text of a group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("g"), F.transform(found, F.length).alias("m"), part.alias("t"))
    empty = F.expr("struct(0 AS at, cast(array() AS array<struct<s: int, e: int, t: string>>) AS a)")
    step = lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(
        F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.concat(acc["a"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + x["m"]).alias("e"), x["t"].alias("t")))).alias("a"))
    )
    return F.when(maybe, F.aggregate(sizes, empty, step, lambda acc: acc["a"])).otherwise(F.expr("cast(array() AS array<struct<s: int, e: int, t: string>>)"))


def _base(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    maybe = F.lit(False)
    for word in ASSIGN_WORDS:
        maybe |= low.contains(word)
    long = lambda spans, least: F.filter(spans, lambda x: F.length(x["t"]) >= least)
    return {
        "assign": long(_spans(text, ASSIGN, maybe, 2), LEAST_ASSIGN),
        "access": long(_spans(text, ACCESS, text.contains("AKIA")), LEAST_ACCESS),
        "hex": long(_spans(text, HEX, text.rlike(f"[0-9a-f]{{{LEAST_HEX}}}")), LEAST_HEX),
    }


def _tail(z: Column) -> Column:
    """1 - Phi(z) for z >= 0, to seven digits."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def _alphabet(t: Column) -> Column:
    """The symbols of the inferred encoding, in order."""
    return (
        F.when(t.rlike("^[0-9a-fA-F]+$"), "0123456789abcdef")
        .when(t.rlike("^[A-Z2-7]+$"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
        .when(t.rlike("^[a-z0-9]+$") | t.rlike("^[A-Z0-9]+$"), "abcdefghijklmnopqrstuvwxyz0123456789")
        .otherwise("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    )


def _scored(runs: Column) -> Column:
    """array<struct<s, e, decoy, class, bin>> of runs; each step is bound once by its lambda."""
    coded = F.transform(
        runs,
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            (~x["t"].rlike(f"[0-9]|{ODD_CASE}")).alias("decoy"),
            _alphabet(F.regexp_replace(x["t"], "=+$", "")).alias("abc"),
            F.translate(F.regexp_replace(x["t"], "=+$", ""), "-_", "+/").alias("t"),
        ),
    )
    valued = F.transform(
        coded,
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            x["decoy"].alias("decoy"),
            F.length(x["abc"]).cast("double").alias("a"),
            F.transform(F.split(F.when(F.length(x["abc"]) < 64, F.when(x["abc"].startswith("A"), x["t"]).otherwise(F.lower(x["t"]))).otherwise(x["t"]), "(?!^)"), lambda c: (F.instr(x["abc"], c) - 1).cast("double")).alias("v"),
        ),
    )
    counted = F.transform(
        valued,
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            x["decoy"].alias("decoy"),
            x["a"].alias("a"),
            F.size(x["v"]).cast("double").alias("n"),
            F.aggregate(F.transform(F.array_distinct(x["v"]), lambda k: F.size(F.filter(x["v"], lambda y: y == k)).cast("double")), F.lit(0.0), lambda acc, c: acc + c * c).alias("squares"),
            F.size(F.filter(x["v"], lambda y: y >= x["a"] / 2)).cast("double").alias("up"),
            F.aggregate(x["v"], F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("runs")), lambda acc, y: F.struct(y.alias("last"), (acc["runs"] + F.when((acc["last"] >= 0) & ((acc["last"] >= x["a"] / 2) == (y >= x["a"] / 2)), 0.0).otherwise(1.0)).alias("runs")), lambda acc: acc["runs"]).alias("runs"),
            F.aggregate(x["v"], F.lit(0.0), lambda acc, y: acc + y).alias("sum"),
            F.aggregate(x["v"], F.lit(0.0), lambda acc, y: acc + y * y).alias("sum2"),
            F.aggregate(x["v"], F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("cross")), lambda acc, y: F.struct(y.alias("last"), (acc["cross"] + acc["last"] * y).alias("cross")), lambda acc: acc["cross"]).alias("cross"),
            (x["v"][0] + x["v"][F.size(x["v"]) - 1]).alias("ends"),
        ),
    )
    tested = F.transform(
        counted,
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            x["decoy"].alias("decoy"),
            ((x["a"] / x["n"] * x["squares"] - x["n"] - (x["a"] - 1)) / F.sqrt(2 * (x["a"] - 1) * (x["n"] - 1) / x["n"])).alias("chi"),
            F.when(
                (x["up"] > 0) & (x["up"] < x["n"]),
                (x["runs"] - 1 - 2 * x["up"] * (x["n"] - x["up"]) / x["n"])
                / F.sqrt(F.greatest(2 * x["up"] * (x["n"] - x["up"]) * (2 * x["up"] * (x["n"] - x["up"]) - x["n"]) / (x["n"] * x["n"] * (x["n"] - 1)), F.lit(1e-3))),
            )
            .otherwise(-8.0)
            .alias("run"),
            F.when(
                x["sum2"] - x["sum"] * x["sum"] / x["n"] > 1e-9,
                (x["cross"] - x["sum"] / x["n"] * (2 * x["sum"] - x["ends"]) + (x["n"] - 1) * x["sum"] * x["sum"] / (x["n"] * x["n"])) / (x["sum2"] - x["sum"] * x["sum"] / x["n"]) * F.sqrt(x["n"]),
            )
            .otherwise(8.0)
            .alias("serial"),
        ),
    )
    least = F.lit(1e-12)
    fisher = F.transform(
        tested,
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            x["decoy"].alias("decoy"),
            (
                -F.log(F.greatest(F.when(x["chi"] >= 0, _tail(F.abs(x["chi"]))).otherwise(1 - _tail(F.abs(x["chi"]))), least))
                - F.log(F.greatest(2 * _tail(F.abs(x["run"])), least))
                - F.log(F.greatest(2 * _tail(F.abs(x["serial"])), least))
            ).alias("h"),
        ),
    )
    width = lambda x: x["e"] - x["s"]
    return F.transform(
        fisher,
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            x["decoy"].alias("decoy"),
            sum((F.when(width(x) > most, 1).otherwise(0) for most in LENGTHS), F.lit(0)).alias("class"),
            F.least(F.floor(-10 * F.log10(F.greatest(F.exp(-x["h"]) * (1 + x["h"] + x["h"] * x["h"] / 2), F.lit(1e-9)))), F.lit(MOST_BIN)).cast("int").alias("bin"),
        ),
    )


def _cuts(scanned: DataFrame) -> dict[int, int]:
    """The largest bin that is reported, by class of length: a few rows, whatever the input."""
    counts = scanned.select(F.explode("runs").alias("r")).groupBy("r.class", "r.bin").agg(F.sum(F.col("r.decoy").cast("int")).alias("decoys"), F.sum((~F.col("r.decoy")).cast("int")).alias("found"))
    so_far = Window.partitionBy("class").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    share = counts.select("class", "bin", (F.sum("decoys").over(so_far) <= FALSE_SHARE * F.sum("found").over(so_far)).alias("good"), F.sum("found").over(so_far).alias("found"))
    rows = share.filter(F.col("good") & (F.col("found") > 0) & (F.col("bin") <= int(-10 * math.log10(LEAST_P)))).groupBy("class").agg(F.max("bin").alias("bin")).collect()
    return {r["class"]: r["bin"] for r in rows}


def _narrow(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, base spans by kind and scored runs; rows has the text as _text."""
    base = _base(F.col("_text"))
    found = rows.select(*keep, *(spans.alias(kind) for kind, spans in base.items()), _spans(F.col("_text"), RUN, F.col("_text").rlike(RUN)).alias("_runs"))
    return found.select(*keep, *(F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(kind) for kind in base), _scored(F.col("_runs")).alias("runs"))


def _with_random(narrow: DataFrame, cuts: dict[int, int]) -> DataFrame:
    """Adds the runs that the cuts let through and that no base span touches."""

    def reported(r: Column) -> Column:
        cut = F.lit(-1)
        for k, b in cuts.items():
            cut = F.when(r["class"] == k, b).otherwise(cut)
        touched = F.exists(F.concat("assign", "access", "hex"), lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"]))
        return ~r["decoy"] & (r["bin"] <= cut) & ~touched

    return narrow.withColumn("random", F.transform(F.filter("runs", reported), lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e")))).drop("runs")


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns named by keep, base spans by kind, and the spans that the tests add.

    Two passes: one over the texts, whose result is a narrow table, and one over that."""
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    scanned = written(_narrow(rows, *keep), "secrets")
    return _with_random(scanned, _cuts(scanned))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every secret replaced by a mark; n_chars follows, other columns stay.

    Two passes over the texts and no table between them: the first only counts."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    found = _with_random(_narrow(rows, "_row", "_text"), _cuts(_narrow(rows)))
    text = F.when(F.size(F.concat(*KINDS)) == 0, F.col("_row.text")).otherwise(redacted(F.col("_text"), KINDS))
    clean = found.select("_row", text.alias("_clean"))
    out = {"text": F.col("_clean"), "n_chars": F.when(F.col("_clean").eqNullSafe(F.col("_row.text")), F.col("_row.n_chars")).otherwise(F.length("_clean").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None}
    return clean.select(*(out[c].alias(c) if c in out else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def listed(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by start and then by kind, joined by commas."""
    def ranked(kind: str) -> Column:
        rank = F.lit(KINDS.index(kind))
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), rank.alias("k"), x["e"].alias("e")))

    placed = F.array_sort(F.concat(*map(ranked, kinds)))
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(placed, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, kinds: list[str], mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by a mark."""
    placed = F.array_sort(F.concat(*kinds))
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["e"]).alias("at"),
        F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
    )
    done = F.aggregate(placed, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(placed) == 0, text).otherwise(done)
