"""URLs, cleaned by their parts."""

from __future__ import annotations

import unicodedata
from urllib.parse import parse_qsl, quote_plus, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, functions as F

from ..errors import BlockedError, LimitError
from ..functions import texts as t
from ..functions.rules import MAX_TEXT_CHARS
from ..plans.policy import URL_KEYS, Policy, canonical_key

MAX_FIELDS = 10_000


def _escaped(text: str) -> str:
    return "".join("".join(f"%{b:02X}" for b in c.encode()) if unicodedata.category(c) == "Cc" else c for c in text)


def _masked(value: str, category: str, policy: Policy) -> str:
    if category in policy.block_categories:
        raise BlockedError((category,))
    return policy.masking.mask(value, category) if value else policy.masking.label(category)


def _fields(text: str, policy: Policy) -> str:
    if text.count("&") + 1 > MAX_FIELDS:
        raise LimitError("max_url_fields", MAX_FIELDS)
    out = []
    for key, value in parse_qsl(text, keep_blank_values=True, max_num_fields=MAX_FIELDS):
        name = canonical_key(key)
        if policy.is_sensitive_key(key) or name in URL_KEYS:
            value = _masked(value, "email" if name == "email" else "secret", policy)
        else:
            value = t.redact(value, policy)[0]
        out.append(f"{quote_plus(_escaped(t.redact(key, policy)[0]))}={quote_plus(value, safe='[],:/@-._~')}")
    return "&".join(out)


def clean_url(url: str, policy: Policy | None = None, redact_full: bool = False) -> str:
    """A URL for display: user information, sensitive parameters and findings are masked."""
    policy = policy or Policy()
    if redact_full:
        return policy.masking.label("url")
    if len(url) > MAX_TEXT_CHARS:
        raise LimitError("max_url_chars", MAX_TEXT_CHARS)
    try:
        parts = urlsplit(url)
    except ValueError:
        return t.redact(url, policy)[0]
    if not parts.scheme or not parts.netloc:
        return t.redact(url, policy)[0]
    user, at, host = parts.netloc.rpartition("@")
    host = _escaped(t.redact(host, policy)[0])
    if at:
        host = f"{_masked(user, 'credential', policy)}@{host}"
    plain = lambda x: _escaped(t.redact(x, policy)[0])
    fragment = _fields(parts.fragment, policy) if "=" in parts.fragment or "&" in parts.fragment else plain(parts.fragment)
    return urlunsplit((parts.scheme, host, plain(parts.path), _fields(parts.query, policy) if parts.query else "", fragment))


def clean_url_column(url: Column, policy: Policy | None = None, redact_full: bool = False) -> Column:
    """clean_url of a column; null where a limit or a block forbids a result."""
    policy = policy or Policy()

    @F.pandas_udf("string")
    def run(urls: pd.Series) -> pd.Series:
        out = []
        for u in urls:
            try:
                out.append(None if u is None else clean_url(u, policy, redact_full))
            except (BlockedError, LimitError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(url)
