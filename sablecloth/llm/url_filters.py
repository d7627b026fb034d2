"""URL filters: listed rules first, host reputation for the rest.

Reputation is an empirical-Bayes estimate of the share of bad pages of a host.
Labelled outcomes are counted by host, and by registered domain and suffix above
it.  Each level has a beta-binomial prior around the posterior mean of the level
above; its strength comes from the data, by the method of moments.  A host is
blocked when the lower bound of its posterior lies above a limit, so few outcomes
move a host little.  DataFrame functions only.

The registered domain is the last two labels of a host, or one more where the
last two are a listed suffix.

Defined results: a null URL or one without `://` has an empty host and path; a
null page_id is judged by its URL; a page labelled more than once is bad if one
label says so; without any bad label nothing is blocked.
Repeated rows are judged one by one.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, functions as F

from .cluster import written

#: (rule, verdict) of the query; a rule is a host and a path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Labels under which countries register names, and shared hosts whose names belong to their users.
SECOND_LEVELS = ["ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "mil", "ne", "net", "or", "org"]
PRIVATE_SUFFIXES = ["blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "web.app", "wordpress.com"]
LONG_SUFFIX = f"(^|[.])(({'|'.join(SECOND_LEVELS)})[.][a-z][a-z]|{'|'.join(x.replace('.', '[.]') for x in PRIVATE_SUFFIXES)})$"
#: A host is blocked if it is worse than LIFT times the mean with that posterior probability.
LIFT, CERTAINTY = 1.25, 0.9
#: Cells of the grid over a posterior's log-odds.
GRID = 256
#: Bounds of a prior's strength in outcomes.
WEAKEST, STRONGEST = 2.0, 1000.0


def _after_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: (len(r[0]), len(r[0].partition("/")[0]))):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _suffix(host: Column) -> Column:
    return F.when(host.rlike(LONG_SUFFIX), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def _domain(host: Column) -> Column:
    return F.when(host.rlike(LONG_SUFFIX), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _exceeds(a: Column, b: Column, limit: float) -> Column:
    """Probability that a draw from Beta(a, b) is above the limit.

    The log-odds u have the density exp(a u) / (1 + exp(u))^(a + b), which is smooth for
    all a and b.  The grid reaches eight deviations, and ten decay lengths of the tails."""
    cut = math.log(limit / (1 - limit))
    bound = lambda values, use: F.transform(F.array(F.struct(*(v.alias(n) for n, v in values.items()))), use)

    def with_grid(p: Column) -> Column:
        wide = 8 * F.sqrt(1 / p["a"] + 1 / p["b"])
        left, right = wide + 10 / p["a"], wide + 10 / p["b"]
        middle = F.log(p["a"] / p["b"])
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), middle.alias("m"), (middle - left).alias("lo"), ((left + right) / GRID).alias("h"))

    def log_density(g: Column, u: Column) -> Column:
        return g["a"] * u - (g["a"] + g["b"]) * (F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u))))

    def summed(g: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda i: F.struct((g["lo"] + (i + 0.5) * g["h"]).alias("u")))
        part = F.transform(cells, lambda c: F.struct(c["u"].alias("u"), F.exp(log_density(g, c["u"]) - log_density(g, g["m"])).alias("d")))
        above = F.transform(part, lambda c: c["d"] * F.greatest(F.least((c["u"] - F.lit(cut)) / g["h"] + 0.5, F.lit(1.0)), F.lit(0.0)))
        add = lambda acc, x: acc + x
        return F.aggregate(above, F.lit(0.0), add) / F.aggregate(F.transform(part, lambda c: c["d"]), F.lit(0.0), add)

    least = F.lit(1e-6)
    return F.transform(bound({"a": F.greatest(a, least), "b": F.greatest(b, least)}, with_grid), summed)[0]


def _strength(groups: DataFrame, mean: Column) -> float:
    """The prior's strength that explains how far the groups' shares lie from their means.

    One row comes to the driver, whatever the number of groups."""
    r = (
        groups.filter("n > 0")
        .agg(
            F.sum("n").alias("n"),
            F.count("*").alias("k"),
            F.sum(F.col("n") * (F.col("bad") / F.col("n") - mean) * (F.col("bad") / F.col("n") - mean)).alias("between"),
            F.sum(F.col("n") * mean * (1 - mean)).alias("within"),
        )
        .first()
    )
    if not r["n"]:
        return WEAKEST
    variance = r["within"] / r["n"]
    extra = r["between"] / r["n"] - variance * (r["k"] - 1) / r["n"]
    return min(max(variance / extra - 1, WEAKEST), STRONGEST) if extra > 0 else STRONGEST


def reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes: host, n labelled pages, bad ones of them; one row a host.  Adds the posterior mean and
    the probability that the host is worse than LIFT times the mean."""
    hosts = outcomes.select("host", "n", "bad", _domain(F.col("host")).alias("domain"), _suffix(F.col("host")).alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = F.lit((total["bad"] or 0) / total["n"] if total["n"] else 0.5)

    def shrunk(level: DataFrame, prior: Column, name: str) -> tuple[DataFrame, float]:
        m = _strength(level, prior)
        return level.withColumn(name, (F.col("bad") + F.lit(m) * prior) / (F.col("n") + F.lit(m))), m

    suffixes, _ = shrunk(suffixes, mean, "suffix_mean")
    domains, _ = shrunk(domains.join(suffixes.select("suffix", "suffix_mean"), "suffix"), F.col("suffix_mean"), "domain_mean")
    hosts, m = shrunk(hosts.join(domains.select("domain", "domain_mean"), "domain"), F.col("domain_mean"), "host_mean")
    limit = min(LIFT * (total["bad"] or 0) / total["n"], 0.99) if total["n"] else 0.0
    if not limit:  # nothing is known to be bad
        return hosts.withColumn("worse", F.lit(0.0))
    a, b = F.col("bad") + F.lit(m) * F.col("domain_mean"), F.col("n") - F.col("bad") + F.lit(m) * (1 - F.col("domain_mean"))
    return hosts.withColumn("worse", _exceeds(a, b, limit))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    outcomes: page_id and bad (0 or 1) of the labelled pages."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("page_id").alias("labelled")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    # one row a host, read by every level
    counts = written(urls.join(known, F.col("page_id") == F.col("labelled"), "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "hosts")
    hosts = reputation(counts).select(F.col("host").alias("of_host"), F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), (F.col("worse") >= CERTAINTY).alias("poor"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # a hot host's pages are many rows against one: adaptive execution splits them
    return urls.join(hosts, F.col("host") == F.col("of_host"), "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("poor"), "block").otherwise("allow")).alias("verdict"), "n_labelled", "n_bad"
    )
