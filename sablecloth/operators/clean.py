"""Cleaning and auditing text columns, and the findings relation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..errors import NotCleanError
from ..functions import texts as t
from ..functions.rules import MAX_TEXT_CHARS
from ..plans.policy import HIGH_RISK, Policy

RESULT = f"struct<cleaned:string,findings:array<{t.FINDING}>,limitations:array<string>,blocked:array<string>>"


def _distinct(items: Column) -> Column:
    return F.array_distinct(items)


def result(text: Column, policy: Policy | None = None, audit: bool = False) -> Column:
    """struct<cleaned, findings, limitations, blocked> of a text column.

    A text that is too long is not scanned: its limitation is max_text_chars and its
    cleaned text null, for what wasn't inspected isn't shown.  A text with blocked
    categories has a null cleaned text too.  audit: findings are kept up to
    max_findings, with a limitation beyond; else more of them are a limit."""
    policy = policy or Policy()
    native = getattr(policy.masking, "native", False)
    long = (F.octet_length(text) > MAX_TEXT_CHARS) & (F.length(text) > MAX_TEXT_CHARS)  # the bytes needn't be counted
    found = t.matches(F.when(~long, text), policy)
    categories = lambda m: F.transform(m, lambda x: x["category"])
    blocked = (lambda m: _distinct(F.filter(categories(m), lambda c: c.isin(list(policy.block_categories))))) if policy.block_categories and not audit else (lambda m: F.expr("cast(array() AS array<string>)"))

    def made(m: Column) -> Column:
        over = F.size(m) > policy.max_findings
        limits = F.when(long, F.array(F.lit("max_text_chars"))).when(m.isNull() & text.isNotNull(), F.array(F.lit("max_matches"))).when(over, F.array(F.lit("max_findings"))).otherwise(F.expr("cast(array() AS array<string>)"))
        kept = F.slice(m, 1, policy.max_findings) if audit else F.when(~over, m).otherwise(F.expr(f"cast(null AS array<{t.MATCH}>)"))
        both = t.masked(text, kept, policy, shown=not audit)
        stop = blocked(m)
        whole = lambda both: F.struct(
            F.when((F.size(F.coalesce(stop, F.array())) == 0) & ~over & ~long, both["cleaned"]).alias("cleaned"),
            F.coalesce(both["findings"], F.expr(f"cast(array() AS array<{t.FINDING}>)")).alias("findings"),
            limits.alias("limitations"),
            F.coalesce(stop, F.expr("cast(array() AS array<string>)")).alias("blocked"),
        )
        return t.bound(both, whole) if native else whole(both)

    # bound once by a lambda; Python can't run in one, so then the parts are computed apart
    return t.bound(found, made) if native else made(found)


def _raised(res: Column, policy: Policy) -> Column:
    """The cleaned text; a block or a limit ends the job with names of categories only."""
    problem = F.when(F.size(res["limitations"]) > 0, F.concat(F.lit("limit exceeded: "), F.array_join(res["limitations"], ","))).when(F.size(res["blocked"]) > 0, F.concat(F.lit("blocked categories: "), F.array_join(res["blocked"], ",")))
    return F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise(res["cleaned"])


def clean_text(text: Column, policy: Policy | None = None, mode: str = "null") -> Column:
    """The redacted text.  mode for blocked or uninspected texts: null, marker or raise."""
    policy = policy or Policy()
    res = result(text, policy)
    if mode == "raise":
        return F.transform(F.array(res), lambda x: _raised(x, policy))[0]
    if mode == "marker":
        return F.transform(F.array(res), lambda x: F.when(F.size(x["blocked"]) > 0, F.concat(F.lit("[BLOCKED categories="), F.array_join(x["blocked"], ","), F.lit("]"))).when(F.size(x["limitations"]) > 0, F.concat(F.lit("[INPUT LIMIT EXCEEDED limit="), x["limitations"][0], F.lit("]"))).otherwise(x["cleaned"]))[0]
    return res["cleaned"]


def findings(text: Column, policy: Policy | None = None) -> Column:
    return result(text, policy, audit=True)["findings"]


def risk_level(found: Column, complete: Column) -> Column:
    """high if a category of high risk is there; unknown if not all was seen; then by number."""
    return F.when(F.exists(found, lambda x: x["category"].isin(list(HIGH_RISK))), "high").when(~complete, "unknown").when(F.size(found) == 0, "none").when(F.size(found) >= 3, "medium").otherwise("low")


def explain(found: Column) -> Column:
    """A text that tells what was redacted, without values."""
    lines = F.transform(
        found,
        lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["category"], F.lit("\n   Rule: "), x["rule_name"], F.lit("\n   Reason: "), x["reason"], F.lit("\n   Action: replaced with "), x["replacement"]),
    )
    return F.when(F.size(found) == 0, "No sensitive values were found.").otherwise(F.concat(F.lit("Found "), F.size(found).cast("string"), F.lit(" sensitive value(s).\n\n"), F.array_join(lines, "\n\n")))


def describe(found: Column, limits: Column) -> Column:
    """A report in words."""
    complete = F.size(limits) == 0
    lines = F.concat(
        F.array(
            F.lit("Privacy audit"),
            F.lit(""),
            F.concat(F.lit("Complete: "), F.when(complete, "yes").otherwise("no")),
            F.concat(F.lit("Risk level: "), risk_level(found, complete)),
            F.concat(F.lit("Findings: "), F.size(found).cast("string")),
            F.concat(F.lit("Categories: "), F.when(F.size(found) == 0, "none").otherwise(F.array_join(F.array_distinct(F.transform(found, lambda x: x["category"])), ", "))),
        ),
        F.when(~complete, F.array(F.concat(F.lit("Limitations: "), F.array_join(limits, ", ")))).otherwise(F.expr("cast(array() AS array<string>)")),
        F.transform(found, lambda x: F.when(x["location"].isNotNull() & (x["location"] != ""), F.concat(x["category"], F.lit(" at "), x["location"])).otherwise(x["category"])),
    )
    return F.when(complete & (F.size(found) == 0), "Privacy audit: safe. No sensitive values were found.").otherwise(F.array_join(lines, "\n"))


def reports(df: DataFrame, columns: list[str], keys: list[str], policy: Policy | None = None) -> DataFrame:
    """One row an input row: keys, findings of all text columns with their places, completeness and risk."""
    policy = policy or Policy()
    per = [(c, result(F.col(c).cast("string"), policy, audit=True)) for c in columns]
    rows = df.select(*keys, *(p.alias(f"_{i}") for i, (_, p) in enumerate(per)))
    placed = []
    for i, (c, _) in enumerate(per):
        where = F.lit(f"$.{c}")
        placed.append(F.transform(F.col(f"_{i}.findings"), lambda x: x.withField("location", where)))
    found = F.concat(*placed)
    limits = F.array_distinct(F.concat(*(F.col(f"_{i}.limitations") for i in range(len(per)))))
    rows = rows.select(*keys, found.alias("findings"), limits.alias("limitations"))
    complete = F.size("limitations") == 0
    return rows.select(
        *keys,
        (complete & (F.size("findings") == 0)).alias("safe"),
        complete.alias("complete"),
        risk_level(F.col("findings"), complete).alias("risk_level"),
        F.size("findings").alias("finding_count"),
        F.array_distinct(F.transform("findings", lambda x: x["category"])).alias("categories"),
        F.array_distinct(F.transform("findings", lambda x: x["location"])).alias("locations"),
        "limitations",
        "findings",
    )


def findings_table(df: DataFrame, columns: list[str], keys: list[str], policy: Policy | None = None) -> DataFrame:
    """One row a finding: keys, column, and the finding; never the value."""
    policy = policy or Policy()
    parts = [df.select(*keys, F.lit(c).alias("column"), F.explode(findings(F.col(c).cast("string"), policy)).alias("f")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(*keys, "column", "f.*")


def clean(df: DataFrame, columns: list[str], policy: Policy | None = None, mode: str = "null") -> DataFrame:
    """The frame with some text columns redacted.  mode drop: rows with blocked texts go."""
    policy = policy or Policy()
    if mode == "drop":
        checked = df.withColumns({f"_r{i}": result(F.col(c), policy) for i, c in enumerate(columns)})
        for i, c in enumerate(columns):
            checked = checked.filter(F.size(f"_r{i}.blocked") == 0).withColumn(c, F.col(f"_r{i}.cleaned"))
        return checked.drop(*(f"_r{i}" for i in range(len(columns))))
    return df.withColumns({c: clean_text(F.col(c), policy, mode) for c in columns})


def assert_clean(df: DataFrame, columns: list[str], policy: Policy | None = None) -> None:
    """Raises unless every text was inspected and nothing was found; stops at the first."""
    bad = reports(df, columns, [], policy).filter("NOT safe").select("risk_level", "finding_count", "categories", "limitations").limit(1).collect()
    if bad:
        b = bad[0]
        raise NotCleanError(f"not clean: risk {b['risk_level']}, {b['finding_count']} finding(s), categories {', '.join(b['categories']) or 'none'}, limitations {', '.join(b['limitations']) or 'none'}")


def clean_bytes(raw: Column, policy: Policy | None = None) -> Column:
    """Bytes of UTF-8, cleaned; bytes that aren't UTF-8 come through as they are."""
    policy = policy or Policy()

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else t.redact(bytes(v).decode("utf-8", "surrogateescape"), policy)[0].encode("utf-8", "surrogateescape") for v in values])

    return run(raw)


def risk_summary(df: DataFrame, columns: list[str], policy: Policy | None = None) -> DataFrame:
    return reports(df, columns, [], policy).groupBy("risk_level").agg(F.count("*").alias("n"), F.sum("finding_count").alias("findings"))
