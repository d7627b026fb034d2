"""Log records, in batches and in streams; and Python's own logging on the driver.

A record is (name, level, msg, args, exc_text, stack_info, extra).  All of this is a
stateless projection, so it runs on a readStream frame as it does on a table.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..errors import BlockedError, LimitError
from ..functions import texts as t
from ..operators.clean import clean_text
from ..operators.documents import bounded, escaped, to_safe_data
from ..plans.policy import Policy

MAX_RENDER = 16_384
#: Attributes that every record of the logging module has.
STANDARD = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}


def rendered(msg: str, args: list | tuple | dict, policy: Policy) -> str:
    """A message with its arguments, cleaned before and after they meet."""
    if args:
        import re

        widths = [int(w) for w in re.findall(r"%[-+ #0]*(\d+)", msg)] + [a for a in (args if isinstance(args, (list, tuple)) else ()) if "*" in msg and isinstance(a, int)]
        if sum(widths) > MAX_RENDER:
            raise LimitError("max_format_width", MAX_RENDER)
        safe = to_safe_data(list(args) if not isinstance(args, dict) else args, policy).cleaned
        try:
            msg = msg % (tuple(safe) if isinstance(safe, list) else safe)
        except (TypeError, ValueError, KeyError):
            msg = f"{msg} {safe}"
    return bounded(escaped(t.redact(msg, policy)[0]), MAX_RENDER)


def clean_logs(records: DataFrame, policy: Policy | None = None, blocked: str = "marker") -> DataFrame:
    """Cleaned records: message, exc_text, stack_info and extra.

    blocked: marker puts a marker in the message's place and masks the rest, drop
    removes the record, raise ends the query."""
    if blocked not in ("marker", "drop", "raise"):
        raise ValueError("blocked must be one of: marker, drop, raise")
    policy = policy or Policy()

    @F.pandas_udf("struct<message:string,exc_text:string,stack_info:string,extra:map<string,string>,blocked:boolean>")
    def run(msg: pd.Series, args: pd.Series, exc: pd.Series, stack: pd.Series, extra: pd.Series) -> pd.DataFrame:
        rows = []
        for m, a, e, s, x in zip(msg, args, exc, stack, extra, strict=True):
            names = dict(x) if x is not None else {}
            try:
                text = lambda v: None if v is None else bounded(escaped(t.redact(v, policy)[0], "\n\t"), MAX_RENDER)
                safe = to_safe_data(names, policy).cleaned
                rows.append((rendered(m or "", list(a) if a is not None else [], policy), text(e), text(s), {k: None if v is None else str(v) for k, v in safe.items()}, False))
            except BlockedError as error:
                if blocked == "raise":
                    raise
                rows.append((f"[BLOCKED categories={','.join(error.categories)}]", None, None, dict.fromkeys(names, "[REDACTED]"), True))
            except LimitError as error:
                rows.append((f"[INPUT LIMIT EXCEEDED limit={error.limit}]", None, None, dict.fromkeys(names, "[REDACTED]"), False))
        return pd.DataFrame(rows, columns=["message", "exc_text", "stack_info", "extra", "blocked"])

    made = records.withColumn("_r", run("msg", "args", "exc_text", "stack_info", "extra"))
    made = made.filter("NOT _r.blocked") if blocked == "drop" else made
    return made.select("name", "level", "_r.message", "_r.exc_text", "_r.stack_info", "_r.extra")


def clean_stream(stream: DataFrame, columns: list[str], policy: Policy | None = None, mode: str = "marker") -> DataFrame:
    """Text columns of a stream, cleaned; native, stateless, append mode."""
    return stream.withColumns({c: clean_text(F.col(c), policy, mode) for c in columns})


class SafeFilter(logging.Filter):
    """Cleans records of Python's logging in place, before any handler sees them."""

    def __init__(self, policy: Policy | None = None, namespace: str = "", drop_blocked: bool | None = None):
        super().__init__()
        self.policy, self.namespace, self.drop_blocked = policy or Policy(), namespace, drop_blocked

    def filter(self, record: logging.LogRecord) -> bool:
        if self.namespace and record.name != self.namespace and not record.name.startswith(self.namespace + "."):
            return True
        try:
            text = rendered(str(record.msg), record.args or (), self.policy)
            if record.exc_info and not record.exc_text:
                record.exc_text = logging.Formatter().formatException(record.exc_info)
            exc = record.exc_text and bounded(escaped(t.redact(record.exc_text, self.policy)[0], "\n\t"), MAX_RENDER)
            stack = record.stack_info and bounded(escaped(t.redact(record.stack_info, self.policy)[0], "\n\t"), MAX_RENDER)
            extras = to_safe_data({k: v for k, v in vars(record).items() if k not in STANDARD}, self.policy).cleaned
        except BlockedError as e:
            if self.drop_blocked is not None:
                if self.drop_blocked:
                    return False
                raise
            return self._marked(record, f"[BLOCKED categories={','.join(e.categories)}]")
        except LimitError as e:
            return self._marked(record, f"[INPUT LIMIT EXCEEDED limit={e.limit}]")
        record.msg, record.args, record.exc_info, record.exc_text, record.stack_info = text, (), None, exc, stack
        vars(record).update(extras)
        return True

    @staticmethod
    def _marked(record: logging.LogRecord, marker: str) -> bool:
        record.msg, record.args, record.exc_info, record.exc_text, record.stack_info = marker, (), None, None, None
        for k in set(vars(record)) - STANDARD:
            setattr(record, k, "[REDACTED]")
        return True


class SafeFormatter(logging.Formatter):
    """Formats a cleaned copy of each record."""

    def __init__(self, *args: object, policy: Policy | None = None, **kwargs: object):
        super().__init__(*args, **kwargs)
        self.cleaner = SafeFilter(policy, drop_blocked=False)

    def format(self, record: logging.LogRecord) -> str:
        copy = logging.makeLogRecord(vars(record))
        self.cleaner.filter(copy)
        return super().format(copy)


def _handlers(logger: logging.Logger) -> Iterator[logging.Handler]:
    """The handlers that records of a logger or of its descendants reach."""
    at: logging.Logger | None = logger
    while at is not None:
        yield from at.handlers
        at = at.parent if at.propagate else None
    for name, other in list(logging.Logger.manager.loggerDict.items()):
        if isinstance(other, logging.Logger) and (logger is logging.root or name.startswith(f"{logger.name}.")):
            yield from other.handlers


def safe_logger(name: str, policy: Policy | None = None, drop_blocked: bool | None = None) -> logging.Logger:
    """A logger whose records, and those of its descendants, are cleaned.

    A logger's own filters don't see records of its descendants, so the handlers get
    a filter for this name too; a second call changes the filters that are there.
    Handlers that are added later need another call."""
    logger = logging.getLogger(name)
    namespace = "" if logger is logging.root else logger.name
    for place in (logger, *{id(h): h for h in _handlers(logger)}.values()):
        own = next((f for f in place.filters if isinstance(f, SafeFilter) and f.namespace == namespace), None)
        if own is None:
            place.addFilter(SafeFilter(policy, namespace, drop_blocked))
        else:
            own.policy, own.drop_blocked = policy or Policy(), drop_blocked
    return logger
