"""Text rules: what is found, and which part of it is masked.

A rule states its pattern for Python and for Java, a necessary condition that is
cheap to test first, and a final test.  Patterns are fixed values that must match
what users of such rules expect; those of credential and secret are our own design.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from itertools import islice
from operator import or_

from pyspark.sql import Column, functions as F

from ..errors import RuleError

MAX_TEXT_CHARS, MAX_MATCHES = 1_000_000, 10_000


def luhn(text: str) -> bool:
    """Whether the digits of a text have the check sum of a card number, and as many."""
    digits = [int(c) for c in text if c.isdigit()]
    if not 13 <= len(digits) <= 19:
        return False
    total = sum(digits[-1::-2])
    for d in digits[-2::-2]:
        total += d * 2 - 9 * (d > 4)
    return total % 10 == 0


@dataclass(frozen=True)
class Part:
    """One pattern of a rule.  prefix and value: groups; without them all is masked."""

    python: str
    flags: int = 0
    java: str = ""
    reason: str = ""
    value_group: int = 0
    prefix_group: int = 0

    @cached_property
    def pattern(self) -> re.Pattern:
        return re.compile(self.python, self.flags)

    @property
    def for_java(self) -> str:
        """Unicode classes, and unicode case where case is ignored, as Python has them."""
        flags = "(?iuU)" if self.flags & re.IGNORECASE else "(?U)"
        return flags + (self.java or re.sub(r"\(\?P<", "(?<", self.python))


@dataclass(frozen=True)
class Rule:
    """A named rule of one category.  gate: a condition that every text with a match meets."""

    name: str
    category: str
    parts: tuple[Part, ...]
    gate: Callable[[Column], Column] | None = field(default=None, compare=False)
    gate_text: Callable[[str], bool] | None = field(default=None, compare=False)
    test: Callable[[str], bool] | None = field(default=None, compare=False)
    test_column: Callable[[Column], Column] | None = field(default=None, compare=False)

    native = True

    def __post_init__(self) -> None:
        if not self.name.strip() or not self.category.strip():
            raise RuleError("a rule needs a name and a category")

    def find(self, text: str) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, prefix that stays, value that is masked, reason)."""
        if self.gate_text and not self.gate_text(text):
            return
        for part in self.parts:
            for m in part.pattern.finditer(text):
                if self.test is None or self.test(m[0]):
                    value = m[part.value_group]
                    at = m.start(part.value_group) - m.start()
                    yield m.start(), m.end(), m[0][:at] if part.value_group else "", value, part.reason


@dataclass(frozen=True)
class CustomRule:
    """A pattern of the user, run with a deadline for each text; errors name no value.

    trusted: the pattern may run as a native expression, without a deadline."""

    name: str
    category: str
    pattern: str
    flags: int = 0
    reason: str = "text matched a custom pattern"
    timeout: float | None = 0.25
    trusted: bool = False

    def __post_init__(self) -> None:
        if not self.name.strip() or not self.category.strip():
            raise RuleError("a rule needs a name and a category")
        try:
            re.compile(self.pattern, self.flags)
        except re.error:
            raise RuleError("a custom pattern is not valid") from None

    @property
    def native(self) -> bool:
        return self.trusted

    @property
    def parts(self) -> tuple[Part, ...]:
        return (Part(self.pattern, self.flags, reason=self.reason),)

    gate = gate_text = test = test_column = None

    def find(self, text: str) -> Iterator[tuple[int, int, str, str, str]]:
        from .deadline import limited

        def some() -> list[tuple[int, int, str]]:
            found = ((m.start(), m.end(), m[0]) for m in re.compile(self.pattern, self.flags).finditer(text) if m.end() > m.start())
            return list(islice(found, MAX_MATCHES + 1))  # one more than is allowed says enough

        for a, b, found in limited(some, self.timeout):
            yield a, b, "", found, self.reason


# Patterns of the built-in rules.
URL = r"https?://[^\s'\"<>]+"
BEARER = r"(\bBearer\s+)([A-Za-z0-9._~+/=-]{8,})"
JWT = r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"
CARD = r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9._%+-])"
IPV4 = r"(?<!\d)(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d)"
PHONE = r"(?<!\d)(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?)\d{3,4}[-.\s]?\d{4}(?!\d)"
# Our own design: keys of credentials, an optional quote, and a value up to white space or punctuation.
CREDENTIAL = (
    r"(?<![A-Za-z0-9_-])((?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]key|access[_-]token|refresh[_-]token|client[_-]secret|private[_-]key|cookie|set-cookie)"
    r"[\"']?\s*[=:]\s*[\"']?)(\[[A-Z_]+(?::[^\]\s]*)?\]|[^\s'\"&,;<>)\]}]+)"
)
AUTHORIZATION = r"(?<![A-Za-z0-9_-])(authorization\s*[:=]\s*(?:bearer|basic)\s+)(\[[A-Z_]+(?::[^\]\s]*)?\]|[^\s'\"&,;<>)\]}]+)"
SECRET = r"(?<![A-Za-z0-9_])(?:sk_live_[A-Za-z0-9]{8,}|sk_test_[A-Za-z0-9]{8,}|pk_live_[A-Za-z0-9]{8,}|sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{16,}|AKIA[A-Z0-9]{16}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9_])"
SECRET_STARTS = ("sk_", "pk_", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AKIA", "xox")

_I = re.IGNORECASE


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)[^\\d]", "")


url = Rule("url", "url", (Part(URL, _I, reason="text matched an HTTP or HTTPS URL"),), lambda c: c.contains("://"), lambda t: "://" in t)
credential = Rule(
    "credential",
    "credential",
    (Part(CREDENTIAL, _I, reason="text matched a credential assignment", value_group=2, prefix_group=1),),
    lambda c: c.contains("=") | c.contains(":"),
    lambda t: "=" in t or ":" in t,
)
authorization = Rule("authorization", "token", (Part(AUTHORIZATION, _I, reason="text matched an authorization header", value_group=2, prefix_group=1),), lambda c: F.lower(c).contains("authorization"), lambda t: "authorization" in t.lower())
token = Rule(
    "token",
    "token",
    (Part(BEARER, _I, reason="text matched a bearer token", value_group=2, prefix_group=1), Part(JWT, reason="text matched a JWT-like token")),
    lambda c: F.lower(c).contains("bearer") | c.contains("eyJ"),
    lambda t: "bearer" in t.lower() or "eyJ" in t,
)
secret = Rule("secret", "secret", (Part(SECRET, reason="text matched a vendor secret"),), lambda c: reduce(or_, (c.contains(x) for x in SECRET_STARTS)), lambda t: any(x in t for x in SECRET_STARTS))
credit_card = Rule(
    "credit_card",
    "credit_card",
    (Part(CARD, reason="text matched a payment card number"),),
    lambda c: c.rlike("(?U)(?:\\d[ -]?){13}"),
    None,
    luhn,
    lambda c: F.length(_digits(c)).between(13, 19) & F.call_function("luhn_check", _digits(c)),
)
email = Rule("email", "email", (Part(EMAIL, reason="text matched an email address pattern"),), lambda c: c.contains("@"), lambda t: "@" in t)
ip_address = Rule("ip_address", "ip_address", (Part(IPV4, reason="text matched an IPv4 address"),), lambda c: c.rlike("(?U)\\d\\.\\d"))
phone = Rule("phone", "phone", (Part(PHONE, reason="text matched a phone-like pattern"),), lambda c: c.rlike("(?U)\\d{4}"))

#: Presets; their order decides ties.
DEFAULT = (url, authorization, credential, token, secret, credit_card, email)
STRICT = (*DEFAULT, ip_address, phone)
WEB = (url, authorization, credential, token, secret)


def checked(rules: tuple) -> tuple:
    """The rules, if they can stand together."""
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise RuleError("two rules have the same name")
    for r in rules:
        if not callable(getattr(r, "find", None)) or not getattr(r, "category", ""):
            raise RuleError("a rule needs a name, a category and find()")
    return tuple(rules)
