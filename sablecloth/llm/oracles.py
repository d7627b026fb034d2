"""SQL that DuckDB can run for the queries that SQL can express."""

from __future__ import annotations

from . import near_dedup, quality_rules, substring_dedup, suffix_dedup, url_filters

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def url_filters_sql() -> str:
    """Rules, and the three levels of shrinkage with their moments."""
    rules = sorted(url_filters.RULES, key=lambda r: (-len(r[0]), -len(r[0].partition("/")[0])))
    cases = {"rule": "", "verdict": ""}
    for rule, verdict in rules:
        host, _, rest = rule.partition("/")
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}') THEN "
        cases["rule"] += f"{fits}'{rule}' "
        cases["verdict"] += f"{fits}'{verdict}' "

    def strength(level: str, prior: str) -> str:
        share = f"(bad / n - {prior})"
        return f"""(SELECT CASE WHEN n IS NULL OR n = 0 THEN {url_filters.WEAKEST}
            WHEN b / n - (w / n) * (k - 1) / n > 0 THEN least(greatest((w / n) / (b / n - (w / n) * (k - 1) / n) - 1, {url_filters.WEAKEST}), {url_filters.STRONGEST}) ELSE {url_filters.STRONGEST} END
            FROM (SELECT sum(n) AS n, count(*) AS k, sum(n * {share} * {share}) AS b, sum(n * {prior} * (1 - {prior})) AS w FROM {level} WHERE n > 0))"""

    return f"""
    WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    known AS (SELECT page_id AS labelled, max(CAST(toxic = 1 OR quality = 0 AS INT)) AS bad FROM p JOIN labels ON doc_id = TRY_CAST(regexp_extract(path, '/([0-9]+)([.]html|/)?$', 1) AS BIGINT) GROUP BY page_id),
    h0 AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad FROM p LEFT JOIN known ON page_id = labelled GROUP BY host),
    h1 AS (SELECT *, string_split(host, '.') AS s, regexp_matches(host, '{url_filters.LONG_SUFFIX}') AS long FROM h0),
    h AS (SELECT host, n, bad, array_to_string(CASE WHEN long THEN s[-3:] ELSE s[-2:] END, '.') AS domain, CASE WHEN long THEN array_to_string(s[-2:], '.') ELSE s[-1] END AS suffix FROM h1),
    d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
    s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY ALL),
    g AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0.5 END AS mean FROM s0),
    s1 AS (SELECT suffix, n, bad, (SELECT mean FROM g) AS prior FROM s0),
    s2 AS (SELECT suffix, (bad + m * prior) / (n + m) AS suffix_mean FROM s1, (SELECT {strength("s1", "prior")} AS m)),
    d1 AS (SELECT domain, n, bad, suffix_mean AS prior FROM d0 JOIN s2 USING (suffix)),
    d2 AS (SELECT domain, (bad + m * prior) / (n + m) AS domain_mean FROM d1, (SELECT {strength("d1", "prior")} AS m)),
    e AS (SELECT host, n, bad, domain_mean AS prior FROM h JOIN d2 USING (domain)),
    f AS (SELECT host, n, bad, greatest(bad + m * prior, 1e-6) AS a, greatest(n - bad + m * (1 - prior), 1e-6) AS b FROM e, (SELECT {strength("e", "prior")} AS m)),
    t AS (SELECT CASE WHEN sum(bad) > 0 THEN least({url_filters.LIFT} * sum(bad) / sum(n), 0.99) END AS most FROM s0),
    x AS (SELECT *, ln(a / b) AS m, 8 * sqrt(1 / a + 1 / b) AS wide, ln(most / (1 - most)) AS cut FROM f, t),
    y AS (SELECT *, m - wide - 10 / a AS lo, (2 * wide + 10 / a + 10 / b) / {url_filters.GRID} AS w, a * m - (a + b) * (greatest(m, 0) + ln(1 + exp(-abs(m)))) AS top FROM x),
    c AS (SELECT host, w, cut, lo + (i + 0.5) * w AS u, a, b, top FROM y, range({url_filters.GRID}) r(i)),
    d AS (SELECT host, exp(a * u - (a + b) * (greatest(u, 0) + ln(1 + exp(-abs(u)))) - top) AS d, greatest(least((u - cut) / w + 0.5, 1), 0) AS above FROM c),
    w AS (SELECT host, sum(d * above) / sum(d) >= {url_filters.CERTAINTY} AS poor FROM d GROUP BY host),
    v AS (SELECT host, CAST(n AS BIGINT) AS n_labelled, CAST(bad AS BIGINT) AS n_bad, poor FROM f JOIN w USING (host))
    SELECT page_id, host, path, CASE {cases["rule"]} END AS rule, coalesce(CASE {cases["verdict"]} END, CASE WHEN poor THEN 'block' ELSE 'allow' END) AS verdict, n_labelled, n_bad
    FROM p JOIN v USING (host)"""


def substring_sql() -> str:
    k = substring_dedup.WINDOW
    return f"""
    WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    win AS (SELECT doc_id, k, md5(array_to_string(ws[k:k + {k - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {k - 2}, 1))) AS k FROM w)),
    rep AS (SELECT doc_id, k FROM win JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + {k})) AS i FROM rep),
    lists AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
      sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]), ' '), '') END) AS kept_sha256
    FROM w LEFT JOIN lists USING (doc_id)"""


def near_dedup_sql() -> str:
    k, share = near_dedup.SHINGLE_WORDS, near_dedup.SIMILARITY_PERCENT
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + {k - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {k - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {share} * (x.n + y.n - shared)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, r) AS (SELECT a, a FROM edges UNION SELECT reach.doc_id, e.b FROM reach JOIN edges e ON e.a = reach.r),
    comp AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(comp.r, doc_id), doc_id) AS component_id, coalesce(least(comp.r, doc_id), doc_id) = doc_id AS kept
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)"""


def quality_rules_sql() -> str:
    """Counts, bucket sketches of three levels, and thresholds shrunk towards the level above."""
    q = quality_rules
    names, sizes = list(q.RATIOS), dict.fromkeys(q.RATIOS.values())
    values = ", ".join([f"{{'name': '{n}', 'x': {n}}}" for n in names] + [f"{{'name': '{s}', 'x': 1 / greatest({s}, 1)}}" for s in sizes])
    value = lambda b: f"CASE WHEN {b} = {q.ZERO} THEN 0 ELSE pow({q.GROWTH}, {b}) * {2 / (1 + q.GROWTH)!r} END"

    def placed(table: str, keys: str) -> str:
        by = f"{keys}name"
        return f"""(SELECT *, sum(n) OVER (PARTITION BY {by}) AS al, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS so_far
            FROM (SELECT {by}, bucket, sum(n) AS n FROM {table} GROUP BY {by}, bucket))"""

    def points(table: str, keys: str) -> str:
        return f"""(SELECT {keys}name, min(bucket) FILTER (so_far >= (j + 0.5) / {q.POINTS} * al) AS bucket, {q.SHRINK / q.POINTS} AS n
            FROM {placed(table, keys)}, range({q.POINTS}) x(j) GROUP BY {keys}name, j)"""

    at = lambda share: value(f"min(bucket) FILTER (so_far >= {share} * al)")
    limits = ", ".join(f"max(high) FILTER (name = '{n}') + {q.SPREADS} * (max(high) FILTER (name = '{n}') - max(half) FILTER (name = '{n}')) + {q.UNITS} * max(half) FILTER (name = '{s}') AS most_{n}" for n, s in q.RATIOS.items())
    outlying = " OR ".join(f"coalesce({n} > most_{n}, false)" for n in names)
    return f"""
    WITH w AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
    win AS (SELECT k, i, list_extract(ws, i) AS a, list_extract(ws, i + 1) AS b, list_extract(ws, i + 2) AS c FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
    again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM win) WHERE n > 1),
    rep AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY k),
    l AS (SELECT k, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
    c AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
      CAST(coalesce(l.n - l.d, 0) AS BIGINT) AS n_dup_lines, coalesce(l.n, 0) AS n_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN l USING (k) LEFT JOIN rep USING (k)),
    r AS (SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_upper / greatest(word_chars, 1) AS upper_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
      n_repeat_words / greatest(n_words, 1) AS repeat_ratio, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM c),
    sketch AS (SELECT lang, source, v.name AS name, CASE WHEN v.x > 0 THEN CAST(ceil(ln(v.x) / ln({q.GROWTH})) AS INT) ELSE {q.ZERO} END AS bucket, count(*) AS n
      FROM (SELECT lang, source, unnest([{values}]) AS v FROM r WHERE NOT base_failed) GROUP BY ALL),
    langs AS (SELECT lang, name, bucket, CAST(n AS DOUBLE) AS n FROM sketch UNION ALL SELECT lang, name, u.bucket, u.n FROM (SELECT DISTINCT lang, name FROM sketch) JOIN {points("sketch", "")} u USING (name)),
    groups AS (SELECT lang, source, name, bucket, CAST(n AS DOUBLE) AS n FROM sketch UNION ALL
      SELECT g.lang, g.source, g.name, u.bucket, u.n FROM (SELECT DISTINCT lang, source, name FROM sketch) g JOIN {points("langs", "lang, ")} u ON g.name = u.name AND g.lang IS NOT DISTINCT FROM u.lang),
    t AS (SELECT lang AS g_lang, source AS g_source, {limits} FROM (SELECT lang, source, name, {at(0.5)} AS half, {at(q.UPPER)} AS high FROM {placed("groups", "lang, source, ")} GROUP BY lang, source, name) GROUP BY lang, source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({outlying}) AS kept, {", ".join(names)}, {", ".join(f"most_{n}" for n in names)}
    FROM r LEFT JOIN t ON lang IS NOT DISTINCT FROM g_lang AND source IS NOT DISTINCT FROM g_source"""


def suffix_sql() -> str:
    """Every 50-byte string of the two halves of its hex form, and the least document that holds it."""
    n = suffix_dedup.LENGTH
    return f"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * n})) AS m FROM (SELECT doc_id, h, unnest(range(0, greatest(CAST(length(h) // 2 - {n - 1} AS BIGINT), 0))) AS i FROM d)),
    f AS (SELECT m, min(doc_id) AS least FROM s GROUP BY m),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM s JOIN f USING (m) WHERE least < doc_id),
    k AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
    spans AS (SELECT doc_id, min(p) AS lo, max(p) + 1 AS hi FROM k GROUP BY doc_id, run),
    cut AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM spans GROUP BY doc_id)
    SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(CASE WHEN los IS NULL THEN unhex(h) ELSE unhex(substr(h, 1, 2 * los[1]) || coalesce(list_aggregate(list_transform(range(1, len(los) + 1), lambda i: substr(h, 2 * his[i] + 1, CASE WHEN i < len(los) THEN 2 * (los[i + 1] - his[i]) ELSE length(h) END)), 'string_agg', ''), '')) END) AS kept_sha256
    FROM d LEFT JOIN cut USING (doc_id)"""
