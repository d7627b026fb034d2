"""Masking: what stands in the place of a found value.

Every strategy masks a Python string and, where it can, a column.  Keyed strategies
run in Python workers with the key in the function's closure, never in a plan.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, functions as F

# Labels of the categories.
LABELS = {"email": "[EMAIL]", "url": "[URL]", "secret": "[SECRET]", "credential": "[SECRET]", "token": "[TOKEN]", "ip_address": "[IP_ADDRESS]", "phone": "[PHONE]", "credit_card": "[CREDIT_CARD]"}
FALLBACK = "[REDACTED]"
EDGES = {"token": 4, "secret": 4, "credential": 4}


def label_column(category: Column, labels: dict[str, str] | None = None) -> Column:
    out = F.lit(FALLBACK)
    for name, label in (labels or LABELS).items():
        out = F.when(category == name, label).otherwise(out)
    return out


def edges(value: str, n: int) -> str:
    """The value with all but n characters at either end covered."""
    return value[:n] + "*" * (len(value) - 2 * n) + value[-n:] if len(value) > 2 * n else "*" * len(value)


def edges_column(value: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    size = F.length(value)
    return F.when(size > 2 * n, F.concat(F.substr(value, F.lit(1), n), F.repeat(F.lit("*"), size - 2 * n), F.substr(value, size - n + 1, n))).otherwise(F.repeat(F.lit("*"), size))


@dataclass(frozen=True)
class Placeholder:
    """A label of the category."""

    labels: tuple[tuple[str, str], ...] = tuple(LABELS.items())
    native = True

    def mask(self, value: str, category: str) -> str:
        return self.label(category)

    def label(self, category: str) -> str:
        return dict(self.labels).get(category, FALLBACK)

    def column(self, value: Column, category: Column) -> Column:
        return label_column(category, dict(self.labels))


@dataclass(frozen=True)
class Partial:
    """The shape of the value: its edges, or an e-mail's domain."""

    native = True

    def mask(self, value: str, category: str) -> str:
        if category == "email" and "@" in value:
            local, _, domain = value.partition("@")
            return f"{local[:1]}***@{domain}"
        return "[URL]" if category == "url" else edges(value, EDGES.get(category, 2))

    def label(self, category: str) -> str:
        return LABELS.get(category, FALLBACK)

    def column(self, value: Column, category: Column) -> Column:
        local = F.substring_index(value, "@", 1)
        mail = F.concat(F.substr(local, F.lit(1), F.lit(1)), F.lit("***"), F.substr(value, F.length(local) + 1))
        plain = edges_column(value, F.when(category.isin(list(EDGES)), 4).otherwise(2))
        return F.when((category == "email") & value.contains("@"), mail).when(category == "url", "[URL]").otherwise(plain)


def _framed(*parts: bytes) -> bytes:
    """Parts with their lengths before them, so that no two lists of parts look alike."""
    return b"".join(len(p).to_bytes(8, "big") + p for p in parts)


def framed_column(*parts: Column) -> Column:
    """The same as a binary column."""
    return F.concat(*(x for p in parts for x in (F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), F.encode(p, "UTF-8"))))


def _key(key: str | bytes) -> bytes:
    raw = key.encode() if isinstance(key, str) else key
    if not isinstance(raw, bytes):
        raise TypeError("a key must be text or bytes")
    if len(raw) < 16:
        raise ValueError("a key must have at least 16 bytes")
    return raw


@dataclass(frozen=True)
class Hashed:
    """[LABEL:digest]: the same value always gets the same mask.  Use a key: without
    one, values can be guessed and tried."""

    salt: str = field(default="", repr=False)
    length: int = 16
    key: str | bytes | None = field(default=None, repr=False)
    domain: str = "sablecloth.hash.v1"

    def __post_init__(self) -> None:
        if isinstance(self.length, bool) or not isinstance(self.length, int) or not 12 <= self.length <= 64:
            raise ValueError("length must be a number from 12 to 64")
        if self.key is not None:
            _key(self.key)
            if self.salt:
                raise ValueError("a key and a salt can't be used together")

    @property
    def native(self) -> bool:
        return self.key is None

    def mask(self, value: str, category: str) -> str:
        payload = _framed(self.domain.encode(), category.encode(), self.salt.encode(), value.encode("utf-8", "surrogatepass"))
        digest = hashlib.sha256(payload).hexdigest() if self.key is None else hmac.new(_key(self.key), payload, hashlib.sha256).hexdigest()
        return f"[{self.label(category).strip('[]')}:{digest[: self.length]}]"

    def label(self, category: str) -> str:
        return LABELS.get(category, FALLBACK)

    def column(self, value: Column, category: Column) -> Column:
        if self.key is not None:
            return keyed(self)(value, category)
        digest = F.sha2(framed_column(F.lit(self.domain), category, F.lit(self.salt), value), 256)
        return F.concat(F.lit("["), F.regexp_replace(label_column(category), "[\\[\\]]", ""), F.lit(":"), F.substring(digest, 1, self.length), F.lit("]"))


@dataclass(frozen=True)
class Pseudonyms:
    """[CATEGORY:hmac:digest] by a secret key; never shown, never exported."""

    key: bytes = field(repr=False)
    digest_size: int = 12
    domain: str = "sablecloth.hmac.v1"
    native = False

    def __post_init__(self) -> None:
        if not isinstance(self.key, bytes):
            raise TypeError("a key must be bytes")
        _key(self.key)
        if isinstance(self.digest_size, bool) or not isinstance(self.digest_size, int) or not 8 <= self.digest_size <= 64:
            raise ValueError("digest_size must be a number from 8 to 64")

    def mask(self, value: str, category: str) -> str:
        digest = hmac.new(self.key, _framed(self.domain.encode(), category.encode(), value.encode("utf-8", "surrogatepass")), hashlib.sha256).hexdigest()
        return f"[{self._name(category)}:hmac:{digest[: self.digest_size]}]"

    def label(self, category: str) -> str:
        return f"[{self._name(category)}:hmac:?]"

    @staticmethod
    def _name(category: str) -> str:
        return re.sub("[^A-Za-z0-9_]+", "_", category).upper() or "REDACTED"

    def column(self, value: Column, category: Column) -> Column:
        return keyed(self)(value, category)


def keyed(strategy):  # noqa: ANN001, ANN201
    """Masks batches in Python workers; whatever the strategy holds stays out of the plan."""

    @F.pandas_udf("string")
    def mask(value: pd.Series, category: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else strategy.mask(v, c) for v, c in zip(value, category, strict=True)])

    return mask
