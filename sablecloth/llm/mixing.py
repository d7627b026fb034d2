"""Mixing to target weights with soft membership.

A labelled table (quality and toxic marks of some documents) defines four domains.
Every distinct word that the labels show to be more frequent in low or in toxic
documents adds its log-odds to one of two sums; a naive-Bayes classifier over bins of the two sums and of
four ratios gives posteriors of the domains.  Documents of equal bins have equal posteriors
and a common rate, so all documents are summed up once, as tokens of the cells of
equal bins (a table of bounded size), and rates are fitted to that table by
projected gradient steps on the relative squares, starting from 1, with momentum
that restarts when it stops helping.  rates() fits nonnegative rates r_d whose
expected tokens of each domain, sum r_d n_d p_dk, meet the targets; mixed() can
keep a document once at most, so its rates are held between 0 and 1.  The steps end
when the targets are met (CLOSE) or when the rates no longer move: then no rates
meet the targets, and a warning names the shares that were reached.
DataFrame functions only, but for the fit over the cells.

The classifier is fitted on a bounded sample of labelled rows (FIT_DOCUMENTS, those
of least hash); sums, posteriors and rates cover all documents.  Defined results:
null and empty texts have no tokens and posteriors like any other; null labels
teach nothing; repeated labels count as bad if one says so; without labels all
domains are alike, no rates meet the targets, and mixed() keeps everything.
Repeated rows are rated one by one.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

FIT_DOCUMENTS = 4000
#: (quality, toxic) of each domain, and its share of the expected tokens.
DOMAINS = {"clean": (1, 0), "toxic": (1, 1), "low": (0, 0), "low_toxic": (0, 1)}
TARGETS = {"clean": 0.94, "toxic": 0.02, "low": 0.03, "low_toxic": 0.01}
#: A word counts if its log-odds are LEAST_ODDS at least, less LEAST_ERRORS standard errors, and
#: if LEAST_SEEN labelled documents hold it: long documents hold all common words more often.
LEAST_ODDS, LEAST_ERRORS, LEAST_SEEN = 1.0, 3.0, 3
#: Bounds of the bins of each ratio and of the sums of log-odds.
BINS = {"symbols": [0.005, 0.02, 0.08], "upper": [0.08, 0.2, 0.4], "marks": [0.005, 0.05], "varied": [0.2, 0.4, 0.6, 0.8], "low": [1.0, 4.0, 10.0], "toxic": [1.0, 4.0, 8.0]}
#: The error relative to all tokens that ends the steps, and the tokens of the first
#: domain that the targets of rates() ask for, relative to what there is.
CLOSE, HEADROOM = 1e-4, 1.25
#: Weight of the rates' squared distance from 1 (of many rates with equal sums, the closest to 1
#: are sought, so the steps end); change of a rate in a step under which rates have settled.
CLOSENESS, SETTLED = 1e-6, 1e-9
#: Kept share of all tokens under which nothing meets the targets.
NOTHING = 1e-6
_WORD_GAP = "[\\x20\\x09-\\x0D.,;:!?#*$%&<>|]+"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    """Distinct words, lower-cased, without stops and symbols."""
    return F.array_distinct(F.split(F.lower(text), _WORD_GAP))


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _constant(values: np.ndarray) -> Column:
    """An array of numbers, which Spark folds into one constant."""
    return F.split(F.lit(",".join(f"{x:.9g}" for x in values.tolist())), ",").cast("array<double>")


def _measured(odds: dict[str, dict[str, float]]) -> Column:
    """struct<n_tokens, cell>: cell numbers the bins of all ratios.

    Lambdas bind the text, its words and the ratios, so that none is computed again for each use."""
    text = F.transform(F.array(_text()), lambda t: F.struct(t.alias("text"), _words(t).alias("words"), tokens(t).alias("n_tokens")))

    def summed(words: Column, name: str) -> Column:
        if not odds[name]:
            return F.lit(0.0)
        known, weights = F.array(*map(F.lit, odds[name])), _constant(np.array(list(odds[name].values())))
        # few words of a text are known, so each of them may be looked for
        return F.aggregate(F.array_intersect(words, known), F.lit(0.0), lambda acc, w: acc + F.get(weights, (F.array_position(known, w) - 1).cast("int")))

    def ratios(x: Column) -> Column:
        return F.struct(
            x["n_tokens"].alias("n_tokens"),
            _share(x["text"], "[#*$%&<>|]").alias("symbols"),
            _share(x["text"], "[A-Z]").alias("upper"),
            _share(x["text"], "[!?]").alias("marks"),
            (F.size(x["words"]) / F.greatest(x["n_tokens"], F.lit(1))).alias("varied"),
            summed(x["words"], "low").alias("low"),
            summed(x["words"], "toxic").alias("toxic"),
        )

    def cell(x: Column) -> Column:
        out = F.lit(0)
        for name, bounds in BINS.items():
            out = out * (len(bounds) + 1) + _bin(x[name], bounds)
        return F.struct(x["n_tokens"].alias("n_tokens"), out.alias("cell"))

    return F.transform(F.transform(text, ratios), cell)[0]


def _bins_of_cells() -> dict[str, np.ndarray]:
    """The bin of each ratio, by cell."""
    sizes = [len(bounds) + 1 for bounds in BINS.values()]
    return dict(zip(BINS, np.unravel_index(np.arange(math.prod(sizes)), sizes), strict=True))


def _bin(ratio: Column, bounds: list[float]) -> Column:
    return sum((F.when(ratio > b, 1).otherwise(0) for b in bounds), F.lit(0))


def _domain() -> Column:
    out = F.lit(None).cast("string")
    for name, (quality, toxic) in DOMAINS.items():
        out = F.when((F.col("quality") == quality) & (F.col("toxic") == toxic), name).otherwise(out)
    return out


class Classifier:
    """Log-weights of the domains: priors and, by ratio and bin, likelihoods."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        known = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
        sample = known.select("labelled", _domain().alias("domain")).filter("labelled IS NOT NULL AND domain IS NOT NULL").orderBy(F.xxhash64("labelled"), "labelled").limit(FIT_DOCUMENTS)
        # FIT_DOCUMENTS rows of an id and a name at most
        marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"))
        total = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
        self.odds = {name: self._odds(marked, total, [d for d, mark in DOMAINS.items() if mark[k] == bad]) for name, k, bad in (("low", 0, 0), ("toxic", 1, 1))}
        of_cell = _bins_of_cells()
        counts: dict[str, dict] = {}
        for r in marked.select("domain", _measured(self.odds)["cell"].alias("cell")).groupBy("domain", "cell").count().collect():
            c = counts.setdefault(r["domain"], {"n": 0})
            c["n"] += r["count"]
            for name in BINS:
                key = f"{name}_{of_cell[name][r['cell']]}"
                c[key] = c.get(key, 0) + r["count"]
        some = sum(c["n"] for c in counts.values())
        self.prior, self.weights = {}, {}
        for d in DOMAINS:
            c = counts.get(d, {"n": 0})
            self.prior[d] = math.log((c["n"] + 1) / (some + len(DOMAINS)))
            for name, bounds in BINS.items():
                size = len(bounds) + 1
                self.weights[d, name] = [math.log((c.get(f"{name}_{k}", 0) + 0.5) / (c["n"] + 0.5 * size)) for k in range(size)]

    @staticmethod
    def _odds(marked: DataFrame, total: dict[str, int], bad: list[str]) -> dict[str, float]:
        """Log-odds of the domains in bad, by word, of words for which they are clearly above LEAST_ODDS.

        What is collected grows with FIT_DOCUMENTS alone."""
        n_a, n_b = (sum(n for d, n in total.items() if (d in bad) == own) for own in (True, False))
        if not n_a or not n_b:
            return {}
        own = F.col("domain").isin(bad).cast("int")
        seen = marked.select(own.alias("t"), F.explode(_words(_text())).alias("word")).groupBy("word").agg(F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b"))
        odds = F.log((F.col("a") + 0.5) / (F.lit(n_a) - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (F.lit(n_b) - F.col("b") + 0.5))
        error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
        clear = seen.filter(f"word <> '' AND a >= {LEAST_SEEN}").select("word", odds.alias("odds"), error.alias("error")).filter(F.col("odds") >= LEAST_ODDS + LEAST_ERRORS * F.col("error"))
        return {r["word"]: r["odds"] for r in clear.orderBy("word").collect()}

    def posterior(self) -> np.ndarray:
        """By cell, in the order of DOMAINS."""
        logs = np.array([sum((np.array(self.weights[d, name])[b] for name, b in _bins_of_cells().items()), self.prior[d]) for d in DOMAINS]).T
        powers = np.exp(logs)
        return powers / powers.sum(axis=1, keepdims=True)


def _descend(n: np.ndarray, p: np.ndarray, by: np.ndarray, wanted: np.ndarray, unit: np.ndarray, most: float, one_sided: np.ndarray) -> tuple[np.ndarray, bool]:
    """Rates from 0 to most of cells of n tokens and posteriors p for which by @ sums is
    wanted, and whether they meet it.  Errors count relative to unit; those that are
    one-sided only if positive."""
    some = n > 0  # documents without tokens stay at 1: no sum depends on them
    rate = np.ones(len(n))
    n, q = n[some], p[some] @ by.T / unit
    top = np.linalg.eigvalsh(q.T @ (q * n[:, None]))[-1]
    error: Callable[[np.ndarray], np.ndarray] = lambda r: (e := (r * n) @ q - wanted / unit) * ~(one_sided & (e < 0))
    met: Callable[[np.ndarray], bool] = lambda r: bool(np.max(np.abs(error(r)) * unit) <= CLOSE * max((r * n).sum(), wanted.sum(), 1.0))
    r = ahead = np.ones(len(n))
    pace = 1.0
    while True:
        if met(r) or not top:
            rate[some] = r
            return rate, met(r)
        new = np.clip(ahead - (q @ error(ahead) / top + CLOSENESS * (ahead - 1)) / (1 + CLOSENESS), 0.0, most)
        if np.max(np.abs(new - ahead)) < SETTLED:  # a step from there goes nowhere: the least squares
            rate[some] = new
            return rate, met(new)
        if (n * (ahead - new) * (new - r)).sum() > 0:
            ahead, pace = r, 1.0
            continue
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        r, ahead, pace = new, new + (pace - 1) / faster * (new - r), faster


def fit_rates(n: np.ndarray, p: np.ndarray, targets: dict[str, float] = TARGETS) -> np.ndarray:
    """Nonnegative rates whose expected tokens meet the targets, by cell; n: tokens.

    The sizes of the targets are set so that the first domain gets HEADROOM times its
    tokens: its own documents then have rates of 1 or more."""
    if not n.sum():
        return np.ones(len(n))
    share = np.array(list(targets.values()))
    size = HEADROOM * (n @ p)[0] / share[0]
    total = size * share
    r, met = _descend(n, p, np.eye(len(share)), total, np.sqrt(np.maximum(total, max(1e-9 * size, 1e-9))), np.inf, np.zeros(len(share), bool))
    if not met:
        _warn(n, p, r, targets)
    return r


def fit_kept(n: np.ndarray, p: np.ndarray, targets: dict[str, float] = TARGETS, least_first: float = NOTHING) -> np.ndarray:
    """Rates between 0 and 1 whose expected tokens are in the proportions of the targets, by cell.

    Every domain is held against the first, so documents that are surely of the first
    have a rate of 1.  A domain with fewer tokens than its proportion asks for keeps
    them all, rather than that the first gives way.  If the targets can't be met, or only
    with less than a share of least_first of the first domain's tokens, because posteriors
    are blurred, documents that are likeliest of the first domain all stay, and the rates of the others bring
    the domains as close to their due as they can; a warning names the shares reached.
    Posteriors that are all alike say nothing, and everything stays."""
    if not n.sum():
        return np.ones(len(n))
    if np.ptp(p, axis=0).max() < 1e-9:
        _warn(n, p, np.ones(len(n)), targets)
        return np.ones(len(n))
    share = np.array(list(targets.values()))
    by = np.eye(len(share))[1:]
    by[:, 0] = -share[1:] / share[0]
    scarce = by @ (n @ p) < 0
    unit = np.sqrt(np.maximum(share[1:], 1e-9) * n.sum())
    r, met = _descend(n, p, by, np.zeros(len(share) - 1), unit, 1.0, scarce)
    if not met or (r * n) @ p[:, 0] < least_first * (n @ p[:, 0]):
        first = p.argmax(axis=1) == 0
        r, met = np.ones(len(n)), False
        if not first.all() and (n * ~first).any():
            # what the first domain's own documents bring is taken off the others' due
            due = np.maximum((n @ p)[0] / share[0] * share - (n * first) @ p, 0.0)
            unit = np.sqrt(np.maximum((n @ p)[0] / share[0] * share, 1e-9 * n.sum()))
            r[~first], _ = _descend(n[~first], p[~first], np.eye(len(share)), due, unit, 1.0, np.zeros(len(share), bool))
    if scarce.any() or not met:
        _warn(n, p, r, targets)
    return r


def _warn(n: np.ndarray, p: np.ndarray, r: np.ndarray, targets: dict[str, float]) -> None:
    sums = (r * n) @ p
    warnings.warn("the targets can't be met; shares reached: " + ", ".join(f"{d} {s:.4f} of {t:.4f}" for (d, t), s in zip(targets.items(), sums / max(sums.sum(), 1e-9), strict=True)), RuntimeWarning, stacklevel=3)


def _of_cell(values: np.ndarray, cell: Column) -> Column:
    return F.get(_constant(values), cell)


def _tokens_by_cell(rows: DataFrame) -> np.ndarray:
    """Tokens of all rows (n_tokens, cell): one row a cell reaches the driver."""
    out = np.zeros(math.prod(len(bounds) + 1 for bounds in BINS.values()))
    for r in rows.groupBy("cell").agg(F.sum("n_tokens").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, the posteriors, the likeliest domain and the rate of every document."""
    from .cluster import written

    model = Classifier(docs, labels)
    known = written(docs.select("doc_id", _measured(model.odds).alias("m")).select("doc_id", "m.n_tokens", "m.cell"), "cells")
    p = model.posterior()
    rate = fit_rates(_tokens_by_cell(known), p, targets)
    names = F.array(*map(F.lit, DOMAINS))
    best = F.get(names, _of_cell(p.argmax(axis=1).astype(float), F.col("cell")).cast("int"))
    return known.select("doc_id", "n_tokens", *(_of_cell(p[:, i], F.col("cell")).alias(f"p_{d}") for i, d in enumerate(DOMAINS)), best.alias("domain"), _of_cell(rate, F.col("cell")).alias("rate"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, least_first: float = NOTHING) -> DataFrame:
    """The documents that the rates keep, columns unchanged: of each cell a share that
    equals its rate, by a hash of the doc_id.  least_first: see fit_kept()."""
    model = Classifier(docs, labels)
    n = _tokens_by_cell(docs.select(_measured(model.odds).alias("m")).select("m.n_tokens", "m.cell"))
    rate = fit_kept(n, model.posterior(), targets, least_first)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("mixing")), F.lit(1_000_000)) / 1_000_000
    return docs.filter(place < _of_cell(rate, _measured(model.odds)["cell"]))
