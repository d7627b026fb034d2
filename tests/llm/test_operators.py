"""Each operator against a plain version of itself, over the awkward documents."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import tracemalloc
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sablecloth.llm import byte_bpe, chunks, components, fingerprints, mixing, near_dedup, quality_classifier, quality_rules, secret_scans, substring_dedup, suffix_array, suffix_dedup, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_fingerprints(spark, docs, texts, empty, clashing):
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_next(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == sha(t[: len(t) - q] + following[:q])
    assert got[5].fingerprint == got[6].fingerprint and got[5].near_next == 1.0
    assert got[0].fingerprint == got[1].fingerprint and got[6].near_next > 0.8 and 0.55 < got[12].near_edited < 0.95
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_with_next(clashing).collect()} == {i: r.fingerprint for i, r in got.items()}
    assert fingerprints.fingerprint_with_next(empty).count() == 0
    same = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert fingerprints.fingerprint_with_next(same).count() == 3


def test_fingerprints_against_plain_python(spark, texts, docs):
    """near_edited and near_next are the shares of equal samples, sample by sample from the definition."""
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_next(docs).collect()}

    def plain(text):
        terms, weights = fingerprints.weighted_terms([text.encode()])
        keys = fingerprints.mix(terms & np.uint64(2**52 - 1))
        out = []
        for k in range(fingerprints.SAMPLES):
            best = None
            for key, w in zip(keys.tolist(), weights.tolist(), strict=True):
                x = key * int(fingerprints._ODD[k]) % 2**64
                x = (x ^ x >> 32) * int(fingerprints._SPREAD) % 2**64
                r, ln_c, b = fingerprints._R[x >> 48], fingerprints._LN_C[x >> 32 & 0xFFFF], np.float32((x & 0xFFFFFFFF) * 2.0**-32)
                t = np.floor(np.float32(np.log(w)) / r + b) if w > 1 else 0
                v = ln_c - r * (t - b + 1)
                if best is None or v < best[0]:
                    best = (v, (key, int(t)))  # a sample is a term and its t
            out.append(best and best[1])
        return out

    some = [0, 3, 5, 7, 9, 12, 14, 15]
    edited = {i: (texts[i] or "")[: len(texts[i] or "") - len(texts[i] or "") // 4] + (texts[i + 1] or "")[: len(texts[i] or "") // 4] for i in some}
    for i in some:
        a, b, c = plain(texts[i] or ""), plain(edited[i]), plain(texts[i + 1] or "")
        share = lambda x, y: float(np.mean([p == q for p, q in zip(x, y, strict=True)]))
        assert got[i].near_edited == pytest.approx(share(a, b), abs=0.035) and got[i].near_next == pytest.approx(share(a, c), abs=0.035), i


def test_many_ranges(spark):
    assert [r.p for r in spark.range(0, 6000, 7).select(fingerprints._place(F.col("id"), list(range(0, 6000, 1))).alias("p")).collect()] == [i + 1 for i in range(0, 6000, 7)]


def test_collision_rate_is_generalised_jaccard():
    rand = np.random.default_rng(2)
    terms = rand.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rand.integers(0, 6, 400), rand.integers(0, 6, 400)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sign = lambda w: fingerprints.signatures(terms[w > 0], w[w > 0], np.array([0]), 256)[:, 0]
    assert abs((sign(a) == sign(b)).mean() - want) < 0.1


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://WWW.a.Example.com/de/1?x#y", "www.a.example.com", "/de/1", "example.com/de/", "block"),
        ("https://b.net/x", "b.net", "/x", "net/", "block"),
        ("https://b.example.net/en/1", "b.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://b.net", "b.net", "", None, "allow"),
        ("x.org/fr/", "", "", None, "allow"),
        ("x://y.org/fr/?://z", "y.org", "/fr/", "org/fr/", "allow"),
        (None, "", "", None, "allow"),
        ("://notnet/", "notnet", "/", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    got = url_filters.judge(pages, spark.createDataFrame([], "page_id long, bad int")).first()
    assert (got.host, got.path, got.rule, got.verdict) == (host, path, rule, verdict)


def test_host_reputation(spark):
    """Verdicts follow the outcomes: swapping the labels of two hosts swaps their verdicts."""
    rows = [(1000 * k + i, f"https://{name}.info/{i}") for k, name in enumerate(["bad.site", "good.place", "half.else"]) for i in range(60)] + [(9000, "https://new.info/"), (9001, "https://b.bad.site.info/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for worst, best in ((0, 1), (1, 0)):
        outcomes = [(1000 * worst + i, 1) for i in range(50)] + [(1000 * best + i, 0) for i in range(50)] + [(2000 + i, int(i % 5 == 0)) for i in range(50)] + [(None, 1), (1000 * best + 3, None), (1000 * worst + 4, 0)]
        got = {r.page_id: r.verdict for r in url_filters.judge(pages, spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
        assert {got[1000 * worst + i] for i in range(60)} == {"block"} and {got[1000 * best + i] for i in range(60)} == {"allow"}
        assert {got[2000 + i] for i in range(60)} == {"allow"} and got[9000] == "allow"
    # three bad pages of three are too few where hosts differ little
    few = url_filters.judge(pages, spark.createDataFrame([(1000 * k + i, int(i % 4 == 0)) for k in range(3) for i in range(50)] + [(9001, 1)], "page_id long, bad int"))
    assert {r.verdict for r in few.collect()} == {"allow"}
    assert url_filters.judge(pages.limit(0), spark.createDataFrame(outcomes, "page_id long, bad int")).count() == 0


def test_beta_posterior(spark):
    rand = np.random.default_rng(30)
    for a, b, limit in ((0.2, 3.0, 0.1), (1, 1, 0.3), (5, 15, 0.3), (0.05, 0.05, 0.5), (400, 1100, 0.28), (3e6, 9e6, 0.2502)):
        got = spark.range(1).select(url_filters._exceeds(F.lit(float(a)), F.lit(float(b)), limit)).first()[0]
        assert got == pytest.approx((rand.beta(a, b, 400_000) > limit).mean(), abs=0.006)


@pytest.mark.parametrize(("host", "domain", "suffix"), [("a.b.co.kr", "b.co.kr", "co.kr"), ("x.com.mx", "x.com.mx", "com.mx"), ("u.github.io", "u.github.io", "github.io"), ("a.b.org", "b.org", "org"), ("xco.uk", "xco.uk", "uk"), ("", "", "")])
def test_registered_domains(spark, host, domain, suffix):
    assert tuple(spark.range(1).select(url_filters._domain(F.lit(host)), url_filters._suffix(F.lit(host))).first()) == (domain, suffix)


def _base_spans(t: str) -> str:
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    for k, (pattern, least) in enumerate((("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32)), 1):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, t) if len(m[0]) >= least]
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_scans(spark, empty):
    rand = np.random.default_rng(3)
    token = lambda n: "".join(rand.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    fixed = [None, "", "token: key password: abcdefghij", "𝄞é token = \"abcdefgh\" AKIAABCDEFGHIJKL " + "a1" * 16, "token = token: abcdefghijk", "TOKEN=token=secret=abcdefgh12", "x" * 3000, "API_KEY:'Zxcvbnm.12=' " * 50]
    secrets = [f"see {token(n)} end" for n in (40, 44, 64, 64, 90)]
    plain = ["some/path/to/a/file/name/v2/index", "abcabcabcabc123123123123", "thononinghaoutinganderthing", "2020-2021-2022-2023-2024"]
    rows = list(enumerate([*fixed, *secrets, *plain, *plain]))
    found = secret_scans.scan(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    got = {r.doc_id: r for r in found.select("doc_id", secret_scans.listed(["assign", "access", "hex"]).alias("base"), F.size("random").alias("n")).collect()}
    for i, t in rows:
        assert got[i].base == _base_spans(t or ""), t
        assert got[i].n == (len(fixed) <= i < len(fixed) + len(secrets)), t
    assert secret_scans.scan(empty, "doc_id").count() == 0


def test_letters_only_secrets(spark):
    rand = np.random.default_rng(33)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    rows = [(i, f"key {''.join(rand.choice(letters, 44))} end") for i in range(4)] + [(10 + i, t) for i, t in enumerate(["someOrdinaryIdentifierOfAProgram", "thononinghaoutinganderthing", "ANOTHER_CONSTANT_OF_A_PROGRAM", "src/main/java/org/Example/App"] * 3)]
    got = {r.doc_id: r.n for r in secret_scans.scan(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").select("doc_id", F.size("random").alias("n")).collect()}
    assert all(got[i] == (i < 10) for i, _ in rows)


def test_redaction_keeps_columns(clashing, spark):
    rows = spark.createDataFrame([(1, "a token=abcdefgh12 b", 20), (2, None, None)], "doc_id long, text string, n_chars long").withColumn("runs", F.lit(1)).withColumn("_row", F.lit(2))
    got = {r.doc_id: r for r in secret_scans.redact(rows).collect()}
    assert got[1].text == "a [SECRET] b" and got[1].n_chars == 12 and got[2].text is None and got[1].runs == 1
    assert secret_scans.redact(clashing).columns == clashing.columns


def test_quality_rules(docs, texts, empty, clashing):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(texts):
        t, r = t or "", got[i]
        w = WORD.findall(t)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert got[5].kept and not got[14].kept
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.judge(clashing).count() == len(texts)


def test_thresholds_follow_the_group(spark):
    """A source whose texts are full of symbols keeps them; elsewhere the same text is dropped."""
    rand = np.random.default_rng(31)
    plain = lambda: " ".join("".join(rand.choice(list("aeinorst"), rand.integers(2, 8))) for _ in range(120))
    code = lambda: plain().replace(" ", " & ", int(rand.integers(20, 60)))
    texts = {("en", "prose"): [plain() for _ in range(200)], ("en", "code"): [code() for _ in range(60)], (None, None): [plain() for _ in range(30)]}
    odd = code()
    for group in texts:
        texts[group].append(odd)
    rows = [(i, t, *group) for i, (group, t) in enumerate((g, t) for g, ts in texts.items() for t in ts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = sorted(quality_rules.judge(frame).collect(), key=lambda r: r.doc_id)
    assert [r.kept for r, row in zip(got, rows, strict=True) if row[1] == odd] == [False, True, False]
    assert all(r.kept for r, row in zip(got, rows, strict=True) if row[1] != odd)

    def bucket(x):
        return quality_rules.ZERO if x <= 0 else math.ceil(math.log(x) / math.log(quality_rules.GROWTH))

    def at(sketch, q):  # the smallest bucket that holds the share q
        return next(b for b in sorted(sketch) if sum(n for y, n in sketch.items() if y <= b) >= q * sum(sketch.values()))

    def lean(own, above):
        out, k = Counter(own), quality_rules.POINTS
        for j in range(k):
            out[at(above, (j + 0.5) / k)] += quality_rules.SHRINK / k
        return out

    def value(b):
        return 0.0 if b == quality_rules.ZERO else quality_rules.GROWTH**b * 2 / (1 + quality_rules.GROWTH)

    for name, size in quality_rules.RATIOS.items():
        for lang, source in texts:
            found = []
            for x in (lambda r: r[name], lambda r: 1 / max(r[size], 1)):  # noqa: B023
                own, up, top = (Counter(bucket(x(r)) for r in got if (r.lang, r.source)[:k] == (lang, source)[:k]) for k in (2, 1, 0))  # noqa: B023
                found.append(lean(own, lean(up, top)))
            high, half = value(at(found[0], quality_rules.UPPER)), value(at(found[0], 0.5))
            want = high + quality_rules.SPREADS * (high - half) + quality_rules.UNITS * value(at(found[1], 0.5))
            assert all(r[f"most_{name}"] == pytest.approx(want, rel=1e-9) for r in got if (r.lang, r.source) == (lang, source))


@pytest.mark.parametrize("budget", [10**6, 50, 7])
def test_suffixes_by_external_induction(budget):
    """Order and common prefixes against sorted slices; small budgets put every queue and array on disk."""
    rand = np.random.default_rng(4)
    for trial in range(30):
        strings = [rand.integers(1, rand.integers(2, 6), rand.integers(1, 90)).tolist() for _ in range(rand.integers(1, 12))]
        if trial % 3 == 0:
            strings += [[1] * 80, [2] * 75 + [1] * 3, strings[0], [1] * 30 + [2] * 30 + [1] * 20, list(range(1, 90)), list(range(90, 1, -1))]
        text = np.concatenate([np.append(np.array(s, np.int64), 0) for s in strings])
        need, depth = (rand.random(len(text)) < rand.choice([0.2, 1.0])) & (text > 0), int(rand.choice([1, 2, 3, 7, 20, 50]))
        order, common = suffix_array.sort_suffixes(text, need, depth, budget)
        ends = np.flatnonzero(text == 0)
        cut = [text[i : min(i + depth, ends[np.searchsorted(ends, i)] + 1)].tolist() for i in order]
        assert sorted(order) == np.flatnonzero(need).tolist() and cut == sorted(cut)
        for a, b, k in zip(cut, cut[1:], common[1:], strict=False):
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), None)
            assert min(k, depth) >= len(a) if a == b else min(k, depth) == same


def test_shard_larger_than_its_memory():
    """A shard of 60 times the budget: the sort's memory stays with the budget."""
    rand = np.random.default_rng(14)
    text = np.append(rand.integers(1, 60, (40_000, 75)), np.zeros((40_000, 1), np.int64), axis=1).astype(np.uint16)
    text[20_000:, 10:], text[20_000:, 9] = text[:20_000, 10:], text[:20_000, 9] % 59 + 1
    text, need = text.ravel(), np.tile(np.arange(76) < 25, 40_000)
    peaks = []
    for budget in (50_000, 10_000_000):
        store = suffix_array.Store(budget)
        tracemalloc.start()
        order, common = suffix_array.sort_suffixes(text, need, 50, budget, store)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert (common >= 50).sum() == 20_000 * 15 and len(order) == 1_000_000
        assert (store.on_disk > 20_000_000) == (budget == 50_000)
    assert peaks[0] < 25_000_000 < peaks[1]


def test_suffix_dedup(docs, texts, empty, clashing):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    first: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first.setdefault(raw[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(raw, gone, strict=True) if not y)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)), i
    assert sum(r.n_removed for r in got.values()) > 2000
    assert suffix_dedup.remove_repeats(empty).count() == 0 and suffix_dedup.remove_repeats(clashing).count() == len(texts)


def test_chunks_of_a_home_share_their_questions():
    """What op5 sends doesn't grow with chunks times buckets, and shards find the same strings."""
    rand, buckets, home = np.random.default_rng(8), 600, 3 << 20
    lines = ["".join(map(chr, rand.integers(97, 123, 90))) for _ in range(60)]
    parts = [chunks.Chunk([10 * k + i for i in range(10)], [" ".join(lines[j] for j in rand.integers(0, 60, 30)).encode() for i in range(10)]) for k in range(12)]
    asked = [row for batch in chunks.together((home + k, suffix_dedup.ask_anchors(x, buckets)) for k, x in enumerate(parts)) for row in batch.to_pylist()]
    assert len(asked) <= buckets and {r["chunk"] for r in asked} == {home}
    told = {k: {} for k in range(12)}
    for row in asked:
        held = chunks.unpack(row["data"])
        for (number, _), x in zip(held, suffix_dedup.answer_anchors([q for _, q in held]), strict=True):
            told[number - home][row["bucket"]] = x
    asked = [row for batch in chunks.together((home + k, suffix_dedup._questions(x, told[k], buckets)) for k, x in enumerate(parts)) for row in batch.to_pylist()]
    assert len(asked) <= buckets and sum(len(r["data"]) for r in asked) < 2.5 * sum(len(x.raw) for x in parts)
    gone = {k: [] for k in range(12)}
    for row in asked:
        shard = suffix_dedup.Shard()
        for number, x in chunks.unpack(row["data"]):
            shard.add(number, x)
        for number, x in shard.answers():
            gone[number - home].append(x)
    first: dict[bytes, int] = {}
    for k, x in enumerate(parts):
        for i, r in enumerate(suffix_dedup._documents(x, gone[k]).to_pylist()):
            raw, hit = x.text(i), bytearray(len(x.text(i)))
            for j in range(len(raw) - 49):
                if first.setdefault(raw[j : j + 50], x.ids[i]) < x.ids[i]:
                    hit[j : j + 50] = b"\1" * 50
            assert r["n_removed"] == sum(hit) and r["kept_sha256"] == sha(bytes(b for b, h in zip(raw, hit, strict=True) if not h))


def test_substring_dedup(docs, texts, empty, clashing):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    parted = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[k : k + 35]) for w in parted for k in range(len(w) - 34))
    for i, w in enumerate(parted):
        gone = {k + j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(35)}
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))), i
    assert got[15].n_removed == 60
    assert substring_dedup.remove_repeats(empty).count() == 0 and substring_dedup.remove_repeats(clashing).count() == len(texts)


def test_homes_fill_buckets_evenly(spark):
    homes = [chunks.home_of(task, 7) for task in range(21)]
    got = spark.createDataFrame([(h,) for h in homes], "h long").select(F.expr("pmod(hash(h), 7)").alias("b")).collect()
    assert [r.b for r in got] == [task % 7 for task in range(21)] and len(set(homes)) == 21


def test_graph_where_copies_begin_and_end_differently(spark):
    """Spans that start, end and branch inside one another, repeats within a document, and shared short runs."""
    rand = np.random.default_rng(21)
    new = lambda n: [f"u{x}" for x in rand.integers(0, 10**9, n)]
    a, b = new(120), new(70)
    rows = [a, new(40) + a[30:90] + new(40), a[10:60] + b + a[60:100], b[:40] + b[5:45] + new(5), a[50:85] + new(3), a[51:85] + new(30), ["x", "y"] * 60, new(20) + b[20:60], new(9) + a[40:48] + new(50)]
    frame = spark.createDataFrame([(i, "  ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(3)
    count = Counter(tuple(w[k : k + 35]) for w in rows for k in range(len(w) - 34))
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(frame).collect()}
    for i, w in enumerate(rows):
        gone = {k + j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(35)}
        assert (got[i].n_removed, got[i].kept_sha256) == (len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))), i


def test_repeats_come_from_verified_paths(spark):
    """Without the paths nothing is removed, and paths whose words differ aren't repeats."""
    copy = " ".join(f"w{i}" for i in range(50))
    frame = spark.createDataFrame([(1, copy), (2, copy)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(frame).collect()] == [50, 50]
    told = substring_dedup.answer_paths([chunks.pack(([b"a b", b"c"], [1, 2])), chunks.pack(([b"a b", b"d"], [1, 1]))])
    assert [list(chunks.unpack(x)) for x in told] == [[1, 1], [1, 0]]


def _lower(t: str) -> str:
    return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in t)


def test_near_duplicates(docs, texts, empty, clashing):
    sets = []
    for t in texts:
        w = WORD.findall(_lower(t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(texts)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), root(i), root(i) == i)
    assert got[8].component_id == 5 and got[7].component_id == 5
    assert near_dedup.near_duplicates(empty).count() == 0
    left = near_dedup.deduplicated(clashing)
    assert left.columns == clashing.columns and sorted(r.doc_id for r in left.collect()) == [i for i in range(len(texts)) if root(i) == i]


def test_group_of_mutual_near_copies(spark):
    """A large group with edits, some of which are linked only through others."""
    import random

    rand = random.Random(9)
    base = [f"w{rand.randint(0, 999)}" for _ in range(200)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rand.choice([1, 2, 4, 6, 8])):
            w[rand.randrange(200)] = f"e{rand.randint(0, 99999)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in rows]
    parent = list(range(700))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(700):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(700)}


def test_similarity_of_near_duplicates(spark):
    """A pair at 0.82 goes in the pipeline and stays in op9; one at 0.78 stays in both."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = [f"w{i}" for i in range(204)]  # 200 shingles, of which an edit inside takes five
    edited = lambda n: [f"e{n}-{i}" if i % 10 == 5 and i < 10 * n else w for i, w in enumerate(base)]
    other = lambda words: [f"{w}x" for w in words]
    rows = [(0, base), (1, edited(4)), (2, other(base)), (3, other(edited(5)))]  # 180 of 220 and 175 of 225
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()} == {0, 2, 3}
    assert {r.doc_id for r in near_dedup.deduplicated(frame).collect()} == {0, 1, 2, 3}


def test_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "x"), (3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in near_dedup.near_duplicates(rows).collect())
    assert got == [("1", 1), ("1", 1), ("2", 2), ("3", 3), ("None", 1)]
    assert sorted(r.doc_id for r in near_dedup.deduplicated(rows.filter("doc_id IS NOT NULL")).collect()) == [1, 2, 3]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 60), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 40: 40, 50: 40, 60: 40}


def test_classifier(spark, clashing, empty):
    rand = np.random.default_rng(5)
    word = lambda: "".join(rand.choice(list("aeinorst"), rand.integers(2, 8)))
    good = [" ".join(word() for _ in range(150)) for _ in range(120)]
    bad = [" ".join(f"{word()}***" if k > 75 else word() for k in range(150)) for _ in range(120)]
    rows = [(i, t, int(i < 120)) for i, t in enumerate([*good, *bad])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = frame.select("doc_id", "quality").unionByName(spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    got = quality_classifier.score(frame.select("doc_id", "text"), labels).withColumn("held_out", quality_classifier.held_out(F.col("doc_id"))).collect()
    tested = [r for r in got if r.held_out]
    assert len(tested) > 20 and np.mean([r.predicted == (r.doc_id < 120) for r in tested]) > 0.95
    kept = quality_classifier.accepted(frame.select("doc_id", "text").withColumn("score", F.lit("x")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.filter("doc_id >= 120").count() < 6
    assert quality_classifier.score(empty, labels).count() == 0
    assert {r.score for r in quality_classifier.score(clashing.select("doc_id", "text"), labels.limit(0)).collect()} == {0.5}


def test_classifier_sees_the_ends_of_long_documents(spark):
    """Documents that differ after word 1,600 only."""
    rand = np.random.default_rng(15)
    vocabulary = np.array(["".join(rand.choice(list("aeinorst"), rand.integers(2, 8))) for _ in range(500)])
    rows = [(i, " ".join([*rand.choice(vocabulary, 1600), *(w if i % 2 else f"{w}***" for w in rand.choice(vocabulary, 400))]), i % 2) for i in range(240)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    got = quality_classifier.score(frame.select("doc_id", "text"), frame.select("doc_id", "quality")).filter(quality_classifier.held_out(F.col("doc_id"))).collect()
    assert len(got) > 20 and np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95


def test_gradient_of_the_classifier():
    rand = np.random.default_rng(6)
    x, at, y = rand.normal(size=(9, quality_classifier.FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])
    model = quality_classifier.Model(x, 0.6)

    def loss():
        p = model.forward(x, at)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for w, g in zip(model.w, model.gradient(x, at, y), strict=True):
        k = tuple(0 for _ in w.shape)
        w[k] += 1e-5
        up = loss()
        w[k] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[k]) < 1e-6
        w[k] += 1e-5


def test_mixing(spark, empty):
    rand = np.random.default_rng(7)
    word = lambda: "".join(rand.choice(list("aeinorst"), rand.integers(2, 8)))
    rows = []
    for i in range(300):
        toxic, low = i % 5 == 0, i % 7 == 0
        rows.append((i, " ".join([*(f"{word()}{'***' if low else ''}" for _ in range(60)), *(["moron", "trash"] if toxic else [])]), 0 if low else 1, int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    labels = frame.select("doc_id", "quality", "toxic")
    got = mixing.rates(frame.select("doc_id", "text"), labels).collect()
    domain = {i: next(d for d, m in mixing.DOMAINS.items() if m == (q, t)) for i, _, q, t in rows}
    assert np.mean([r.domain == domain[r.doc_id] for r in got]) > 0.97
    total = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) for d in mixing.DOMAINS}
    everything = sum(total.values())
    assert min(r.rate for r in got) >= 0 and all(abs(total[d] / everything - mixing.TARGETS[d]) < 0.02 for d in mixing.DOMAINS)
    kept = mixing.mixed(frame.select("doc_id", "text").withColumn("p", F.lit(1)), labels)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == ["doc_id", "text", "p"] and {i for i, d in domain.items() if d == "clean"} <= ids and len(ids) < 300
    assert mixing.rates(empty, labels).count() == 0
    assert mixing.rates(frame.select("doc_id", "text"), labels.limit(0)).count() == 300

def _labelled(spark, n: int, size: int, shares: dict[str, float]):
    """n documents of about size words in domains of these shares, and their labels."""
    rand = np.random.default_rng(12)
    vocabulary = ["".join(rand.choice(list("aeinorst"), rand.integers(2, 8))) for _ in range(500)]
    rows = []
    for i, d in enumerate(rand.choice(list(shares), n, p=list(shares.values()))):
        quality, toxic = mixing.DOMAINS[d]
        text = [w if quality else f"{w}***" for w in rand.choice(vocabulary, size)] + ["moron", "trash"] * toxic
        rows.append((i, " ".join(text), quality, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_mixing_against_plain_python(spark, texts):
    """Words, cells, posteriors and rates, worked out again document by document."""
    insults = ["moron", "trash"]
    rows = [(i, t, int(i % 4 > 0), 0) for i, t in enumerate(texts)] + [(100 + i, f"{' '.join(insults)} they said of {i} {'*** ' * (i % 9)}", int(i % 9 < 3), 1) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    labels = frame.select("doc_id", "quality", "toxic")
    model = mixing.Classifier(frame.select("doc_id", "text"), labels)
    assert set(insults) <= set(model.odds["toxic"])
    got = {r.doc_id: r for r in mixing.rates(frame.select("doc_id", "text"), labels).collect()}
    cells = {}
    for i, t, _, _ in rows:
        t = t or ""
        distinct = dict.fromkeys(re.split(r"[\x20\t-\r.,;:!?#*$%&<>|]+", t.lower()))
        n, size = len(WORD.findall(t)), max(len(t), 1)
        ratio = {"symbols": len(re.findall(r"[#*$%&<>|]", t)) / size, "upper": len(re.findall("[A-Z]", t)) / size, "marks": len(re.findall("[!?]", t)) / size, "varied": len(distinct) / max(n, 1)}
        ratio |= {name: sum(model.odds[name].get(w, 0) for w in distinct) for name in ("low", "toxic")}
        bins = [sum(ratio[name] > b for b in bounds) for name, bounds in mixing.BINS.items()]
        logs = np.array([model.prior[d] + sum(model.weights[d, name][b] for name, b in zip(mixing.BINS, bins, strict=True)) for d in mixing.DOMAINS])
        cells[i] = (int(np.ravel_multi_index(bins, [len(b) + 1 for b in mixing.BINS.values()])), n, np.exp(logs) / np.exp(logs).sum())
    tokens, posterior = np.zeros(len(model.posterior())), model.posterior()
    for cell, n, _ in cells.values():
        tokens[cell] += n
    rate = mixing.fit_rates(tokens, posterior)
    for i, (cell, n, p) in cells.items():
        assert got[i].n_tokens == n and got[i].rate == pytest.approx(rate[cell], rel=1e-6)
        assert [got[i][f"p_{d}"] for d in mixing.DOMAINS] == pytest.approx(p.tolist(), rel=1e-6)


@pytest.mark.parametrize("seed", range(6))
def test_rates_are_the_least_squares(seed):
    """Targets that can't be met: the error against the best of all sets of rates at their bounds."""
    rand = np.random.default_rng(seed)
    n, p = rand.integers(50, 500, 5).astype(float), rand.dirichlet([6.0, 2.0, 2.0, 2.0], 5)
    share = np.array(list(mixing.TARGETS.values()))
    total = mixing.HEADROOM * (n @ p)[0] / share[0] * share
    unit = np.sqrt(total)
    a = (n[:, None] * p / unit).T
    best = np.inf
    for free in itertools.product([False, True], repeat=5):
        at = np.flatnonzero(free)
        r = np.zeros(5)
        if len(at):
            r[at] = np.linalg.lstsq(a[:, at], total / unit, rcond=None)[0]
        if r.min() >= -1e-12:
            best = min(best, np.sum((a @ r - total / unit) ** 2))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        r = mixing.fit_rates(n, p)
    assert r.min() >= 0 and np.sum((a @ r - total / unit) ** 2) <= best * (1 + 1e-3) + 1e-4 * total.sum() ** 0.5


SHARES = {"clean": 0.76, "toxic": 0.107, "low": 0.081, "low_toxic": 0.052}


def test_rates_meet_the_targets(spark):
    frame = _labelled(spark, 1500, 30, SHARES)
    got = mixing.rates(frame.select("doc_id", "text"), frame.select("doc_id", "quality", "toxic")).collect()
    total = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) for d in mixing.DOMAINS}
    size = mixing.HEADROOM * sum(r.n_tokens * r.p_clean for r in got) / mixing.TARGETS["clean"]
    assert all(abs(total[d] - size * mixing.TARGETS[d]) < 2e-4 * size for d in mixing.DOMAINS)


def test_blurred_posteriors_meet_the_targets_or_say_so():
    rand = np.random.default_rng(13)
    n = rand.integers(1, 10_000, 300).astype(float)
    p = rand.dirichlet([2.5, 0.4, 0.3, 0.2], 300)
    sums = (mixing.fit_rates(n, p) * n) @ p
    assert np.abs(sums / sums.sum() - list(mixing.TARGETS.values())).max() < 2e-4
    with pytest.warns(RuntimeWarning, match="can't be met"):
        mixing.fit_rates(n, np.full((300, 4), 0.25))


def test_mixed_keeps_the_target_shares(spark):
    frame = _labelled(spark, 20_000, 15, SHARES)
    kept = mixing.mixed(frame.select("doc_id", "text"), frame.select("doc_id", "quality", "toxic")).join(frame.select("doc_id", "quality", "toxic"), "doc_id").collect()
    size = {d: sum(len(r.text.split()) for r in kept if (r.quality, r.toxic) == m) for d, m in mixing.DOMAINS.items()}
    assert all(abs(size[d] / sum(size.values()) / t - 1) < 0.12 for d, t in mixing.TARGETS.items())


def test_rates_of_documents_kept_once():
    rand = np.random.default_rng(14)
    n = rand.integers(1, 10_000, 300).astype(float)
    p = rand.dirichlet([2.5, 0.4, 0.3, 0.2], 300)
    rate = mixing.fit_kept(n, p)
    sums = (rate * n) @ p
    assert rate.min() >= 0 and rate.max() <= 1 and np.abs(sums / sums.sum() - list(mixing.TARGETS.values())).max() < 2e-4
    # blurred posteriors: likely clean documents stay, whatever the targets say
    blurred = np.array([[0.95, 0.04, 0.01, 0.0]] * 200 + [[0.1, 0.9, 0.0, 0.0]] * 60 + [[0.1, 0.0, 0.9, 0.0]] * 40)
    with pytest.warns(RuntimeWarning, match="can't be met"):
        rate = mixing.fit_kept(np.full(300, 100.0), blurred, least_first=0.95)
    assert (rate[:200] == 1).all() and rate[200:260].max() < 0.05 and 0.1 < rate[260:].mean() < 0.3
    few = np.array([[1.0, 0, 0, 0]] * 299 + [[0, 1, 0, 0]])
    with pytest.warns(RuntimeWarning, match="can't be met"):
        assert (mixing.fit_kept(np.ones(300), few) == 1).all()  # one toxic token of 300 stays, and so does what is clean


def test_byte_bpe(docs, texts, empty, clashing):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.encode_documents(docs, path, public.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")), i
    assert byte_bpe.encode_documents(empty, path, public.PATTERN).count() == 0
    assert byte_bpe.encode_documents(clashing, path, public.PATTERN).count() == len(texts)


def test_bpe_of_odd_characters():
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = byte_bpe.Encoder(ranks, public.PATTERN)
    odd = ["a" * 900, "  \n\n x", "\x1c\x1f\x85\xa0x", "²½ⅷ ٣٤", "it's I'll 'S", "<|endoftext|>", "_a_1_", "×÷Ā", "日本語 한국어", "e\u0301"]
    for text, (ids, raw) in zip(odd, encoder.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text) and raw == text.encode(), text


@pytest.mark.parametrize("kind", ["pairs", "one", "random", "wide", "short"])
def test_bpe_of_one_very_long_piece(kind):
    """100,000 characters of one class, or 20,000 where every pair is another one."""
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    rand = np.random.default_rng(40)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    text = {"pairs": "ab" * 50_000, "one": "=" * 100_001, "random": "".join(rand.choice(letters, 20_000)), "wide": "".join(map(chr, rand.integers(0x4E00, 0x9FFF, 4_000))), "short": " ".join("".join(rand.choice(letters[:4], n)) for n in (199, 200, 201, 202, 650))}[kind]
    (ids, raw), *_ = byte_bpe.Encoder(ranks, public.PATTERN).encode([text])
    assert raw == text.encode() and np.frombuffer(ids, "<u4").tolist() == tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


def test_bpe_where_a_merge_makes_a_pair_of_lower_rank():
    """Random vocabularies, against the merging of one pair at a time."""
    rand = np.random.default_rng(41)
    for _ in range(12):
        tokens = [bytes([b]) for b in range(256)]
        more = {bytes(rand.choice(list(b"abc"), rand.integers(2, 6)).tolist()) for _ in range(40)}
        ranks = {t: i for i, t in enumerate(tokens + sorted(more, key=lambda t: rand.random()))}
        text = bytes(rand.choice(list(b"abc"), 400).tolist()).decode()
        parts = [bytes([b]) for b in text.encode()]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        ids, raw = byte_bpe.Encoder(ranks, "[a-z]+").encode([text])[0]
        assert raw == text.encode() and np.frombuffer(ids, "<u4").tolist() == [ranks[x] for x in parts]


def test_heap_is_given_back(spark, docs):
    """A stage's garbage doesn't stay with the JVM while the workers of byte-level BPE run."""
    import corpus_pipeline

    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    for _ in range(8):
        spark.sparkContext._gateway.new_array(spark._jvm.long, 12_000_000)
    before = runtime.totalMemory()
    corpus_pipeline.encode(spark, docs, "")
    assert before > 500e6 and runtime.totalMemory() < before - 200e6


def test_bpe_takes_few_texts_at_once():
    column = pa.array(["a b " * 100_000] * 8)
    assert [sum(map(len, x)) for x in byte_bpe._batch_texts(column)] == [1_200_000, 1_200_000, 800_000]


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    pipeline = pytest.importorskip("corpus_pipeline")
    rand = np.random.default_rng(8)
    word = lambda: "".join(rand.choice(list("aeinorst"), rand.integers(2, 8)))
    good = [" ".join(word() for _ in range(120)) for _ in range(60)]
    rows = [*good, good[0], good[1] + " tail", good[2] + " token=abcdefgh1234", *(" ".join(f"{word()}$$$" for _ in range(120)) for _ in range(40))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 63), 0) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(60)) <= got and not got & {60, 61} and len(got) <= 62
    docs = frame
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns
