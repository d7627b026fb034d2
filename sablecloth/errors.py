"""Errors that callers can catch; none of them carries a source value."""

from __future__ import annotations


class PrivacyError(Exception):
    """The base of all errors of this package."""


class RuleError(PrivacyError, ValueError):
    """A rule or a set of rules is not valid."""


class BlockedError(PrivacyError):
    """A policy blocks a category that was found."""

    def __init__(self, categories: tuple[str, ...]):
        super().__init__("blocked sensitive categories: " + ", ".join(categories))
        self.categories = categories


class LimitError(PrivacyError):
    """An input is beyond a limit, so it was not inspected."""

    def __init__(self, limit: str, maximum: int):
        super().__init__(f"input exceeds {limit} ({maximum})")
        self.limit, self.maximum = limit, maximum


class NotCleanError(PrivacyError, AssertionError):
    """An audit found something, or could not look everywhere."""


class PolicyError(PrivacyError, ValueError):
    """A policy configuration is not valid."""


class LineError(PrivacyError):
    """A line of a JSON Lines source can't be read."""

    def __init__(self, line_number: int, reason: str):
        super().__init__(f"{reason.replace('_', ' ')} at line {line_number}")
        self.line_number, self.reason = line_number, reason


class PseudonymError(PrivacyError):
    """A rule asks for pseudonyms and the policy has no key for them."""
