"""Scan, resolve, redact: once as Catalyst expressions, once in Python.

Columns are the fast path.  A match is a struct of its place, the prefix that stays
and the value that is masked; Java's offsets aren't code points, so places come
from the lengths of what stands between matches.  The Python form serves JSON of
unknown shape, rules and strategies of users, and log messages; both give the same
results.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F

from ..errors import BlockedError, LimitError
from .masking import keyed
from .rules import MAX_MATCHES, MAX_TEXT_CHARS, Part, Rule

MATCH = "struct<start:int,size:int,ord:int,rule:string,category:string,prefix:string,value:string,reason:string>"
FINDING = "struct<rule_name:string,category:string,start:int,end:int,replacement:string,reason:string,location:string>"


@dataclass(frozen=True)
class Finding:
    """What is told of a match: never the value."""

    rule_name: str
    category: str
    start: int
    end: int
    replacement: str
    reason: str
    location: str = ""


def find_all(text: str, rules: tuple) -> list[tuple]:
    """All matches of all rules, unresolved: (start, -length, rule's place, rule, prefix, value, reason)."""
    if len(text) > MAX_TEXT_CHARS:
        raise LimitError("max_text_chars", MAX_TEXT_CHARS)
    out = []
    for k, rule in enumerate(rules):
        for start, end, prefix, value, reason in _found(rule, text, MAX_MATCHES + 1 - len(out)):
            if not 0 <= start < end <= len(text):
                raise LimitError("rule_span", len(text))
            out.append((start, start - end, k, rule, prefix, value, reason))
            if len(out) > MAX_MATCHES:
                raise LimitError("max_matches", MAX_MATCHES)
    return out


def _found(rule, text: str, most: int):  # noqa: ANN001, ANN202
    """A rule's matches; rules that can stop early are told how many are of use."""
    limited = getattr(rule, "find_limited", None)
    return limited(text, most) if callable(limited) else rule.find(text)


def resolve(matches: list[tuple]) -> list[tuple]:
    """Earliest first, longest at one start, then in order of the rules; what overlaps goes."""
    out, last = [], -1
    for m in sorted(matches, key=lambda m: (m[0], m[1], m[2])):
        if m[0] >= last:
            out.append(m)
            last = m[0] - m[1]
    return out


def redact(text: str, policy) -> tuple[str, list[Finding]]:  # noqa: ANN001
    """The clean text and its findings; budget before block before masking."""
    kept = resolve(find_all(text, policy.rules))
    if len(kept) > policy.max_findings:
        raise LimitError("max_findings", policy.max_findings)
    blocked = tuple(dict.fromkeys(m[3].category for m in kept if m[3].category in policy.block_categories))
    if blocked:
        raise BlockedError(blocked)
    return _redacted(text, kept, policy)


def _redacted(text: str, kept: list[tuple], policy) -> tuple[str, list[Finding]]:  # noqa: ANN001
    out, at, findings = [], 0, []
    for start, minus, _, rule, prefix, value, reason in kept:
        mask = prefix + (policy.masking.mask(value, rule.category) if value else policy.masking.label(rule.category))
        out += [text[at:start], mask]
        at = start - minus
        findings.append(Finding(rule.name, rule.category, start, at, mask, reason))
    return "".join([*out, text[at:]]), findings


def inspect(text: str, policy) -> list[Finding]:  # noqa: ANN001
    """Findings without blocking."""
    return _redacted(text, resolve(find_all(text, policy.rules)), policy)[1]


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() AS array<{kind}>)")


def bound(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), where value is computed once however often it is used; use must not hold Python functions."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, rule: Rule, part: Part, k: int) -> Column:
    java = part.for_java
    found = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(java), F.lit(part.value_group)) if part.value_group else found
    # what stays is what stands before the value, so the pattern needn't run for it
    prefix = F.zip_with(found, value, lambda m, v: F.substr(m, F.lit(1), F.length(m) - F.length(v))) if part.prefix_group else F.transform(found, lambda _: F.lit(""))
    rows = F.arrays_zip(F.split(text, java, -1).alias("gap"), found.alias("found"), value.alias("value"), prefix.alias("prefix"))
    if rule.test_column is None:
        rows = F.slice(rows, 1, MAX_MATCHES + 1)  # one more than is allowed says enough
    name, category, reason, ord_ = F.lit(rule.name), F.lit(rule.category), F.lit(part.reason), F.lit(k)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        one = F.struct(start.alias("start"), F.length(x["found"]).alias("size"), ord_.alias("ord"), name.alias("rule"), category.alias("category"), x["prefix"].alias("prefix"), x["value"].alias("value"), reason.alias("reason"), x["found"].alias("found"))
        return F.when(x["found"].isNull(), acc).otherwise(F.struct((start + F.length(x["found"])).alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    first = F.struct(F.lit(0).alias("at"), _none(MATCH[:-1] + ",found:string>").alias("out"))
    out = F.aggregate(rows, first, step, lambda acc: acc["out"])
    if rule.test_column is not None:
        out = F.filter(out, lambda x: rule.test_column(x["found"]))
    kept = F.transform(out, lambda x: F.struct(*(x[n].alias(n) for n in ("start", "size", "ord", "rule", "category", "prefix", "value", "reason"))))
    return F.when(rule.gate(text), kept).otherwise(_none(MATCH)) if rule.gate is not None else kept


def _python_matches(text: Column, rule, k: int) -> Column:  # noqa: ANN001
    """Matches of a rule that must run in Python; a broken deadline gives null."""
    @F.pandas_udf(f"array<{MATCH}>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                # find_all() also refuses spans that lie outside of the text
                found = [] if t is None or len(t) > MAX_TEXT_CHARS else find_all(t, (rule,))
                out.append([{"start": s, "size": -minus, "ord": k, "rule": rule.name, "category": rule.category, "prefix": p, "value": v, "reason": r} for s, minus, _, _, p, v, r in found])
            except LimitError:
                out.append(None)
        return pd.Series(out)

    return run(text)


def matches(text: Column, policy) -> Column:  # noqa: ANN001
    """Resolved matches of a text; null where a deadline broke."""
    if not policy.rules:
        return _none(MATCH)
    native = [(k, rule) for k, rule in enumerate(policy.rules) if getattr(rule, "native", False)]
    # rules of users need find() only; those run in Python
    found = [_python_matches(text, rule, k) for k, rule in enumerate(policy.rules) if (k, rule) not in native]
    if native:
        found.append(bound(text, lambda t: F.concat(*(_matches(t, rule, part, k) for k, rule in native for part in rule.parts))))

    def step(acc: Column, x: Column) -> Column:
        return F.when(x["start"] >= acc["last"], F.struct((x["start"] - x["minus"]).alias("last"), F.concat(acc["out"], F.array(x["m"])).alias("out"))).otherwise(acc)

    def resolved(everything: Column) -> Column:
        ordered = F.array_sort(F.transform(everything, lambda m: F.struct(m["start"].alias("start"), (-m["size"]).alias("minus"), m["ord"].alias("ord"), m.alias("m"))))
        kept = F.aggregate(ordered, F.struct(F.lit(-1).alias("last"), _none(MATCH).alias("out")), step, lambda acc: acc["out"])
        return F.when(F.size(everything) == 0, _none(MATCH)).when(F.size(everything) > MAX_MATCHES, F.lit(None).cast(f"array<{MATCH}>")).otherwise(kept)

    return bound(F.concat(*found), resolved)


def masked(text: Column, found: Column, policy, shown: bool = True) -> Column:  # noqa: ANN001
    """struct<cleaned, findings> of a text and its resolved matches; shown: whether the cleaned text is of use."""
    strategy = policy.masking
    if getattr(strategy, "native", False):
        with_mask = F.transform(found, lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["size"]).alias("end"), m["rule"].alias("rule_name"), m["category"].alias("category"), m["reason"].alias("reason"), F.concat(m["prefix"], F.when(m["value"] == "", label_of(strategy, m["category"])).otherwise(strategy.column(m["value"], m["category"]))).alias("replacement")))
    else:
        masks = masks_of(strategy)(F.transform(found, lambda m: m["value"]), F.transform(found, lambda m: m["category"]))
        with_mask = F.zip_with(found, masks, lambda m, r: F.struct(m["start"].alias("start"), (m["start"] + m["size"]).alias("end"), m["rule"].alias("rule_name"), m["category"].alias("category"), m["reason"].alias("reason"), F.concat(m["prefix"], r).alias("replacement")))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substr(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], kept, x["replacement"]).alias("out"))

    # bound once: the masks are computed once and used for the text and the findings
    cleaned = lambda w: F.aggregate(w, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    findings = lambda w: F.transform(w, lambda x: F.struct(x["rule_name"].alias("rule_name"), x["category"].alias("category"), x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("replacement"), x["reason"].alias("reason"), F.lit(None).cast("string").alias("location")))
    both = F.transform(F.array(with_mask), lambda w: F.struct((F.when(F.size(w) == 0, text).otherwise(cleaned(w)) if shown else F.lit(None).cast("string")).alias("cleaned"), findings(w).alias("findings")))
    return both[0]


def label_of(strategy, category: Column) -> Column:  # noqa: ANN001
    from .masking import LABELS, FALLBACK

    out = F.lit(FALLBACK)
    for name in LABELS:
        out = F.when(category == name, strategy.label(name)).otherwise(out)
    return out


def masks_of(strategy):  # noqa: ANN001, ANN201
    """Masks of arrays of values, in Python workers."""
    @F.pandas_udf("array<string>")
    def run(values: pd.Series, categories: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else [strategy.mask(x, c) if x else strategy.label(c) for x, c in zip(v, k, strict=True)] for v, k in zip(values, categories, strict=True)])

    return run


__all__ = ["Finding", "find_all", "inspect", "keyed", "masked", "matches", "redact", "resolve"]
