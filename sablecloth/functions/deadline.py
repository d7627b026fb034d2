"""Deadlines for patterns of users."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable
from typing import TypeVar

from ..errors import LimitError

T = TypeVar("T")


def limited(work: Callable[[], T], seconds: float | None) -> T:
    """work(), or LimitError if it takes longer.

    Runs under an interval timer, which a Python worker's main thread has; in any
    other thread a child process does the work and is killed at the deadline."""
    if seconds is None:
        return work()
    if threading.current_thread() is not threading.main_thread():
        return _in_child(work, seconds)

    def stop(*_: object) -> None:
        raise LimitError("regex_execution_ms", int(seconds * 1000))

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return work()
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _in_child(work: Callable[[], T], seconds: float) -> T:
    import multiprocessing

    context = multiprocessing.get_context("fork")
    mine, theirs = context.Pipe(duplex=False)
    child = context.Process(target=lambda: theirs.send(work()), daemon=True)
    child.start()
    try:
        if not mine.poll(seconds):
            raise LimitError("regex_execution_ms", int(seconds * 1000))
        return mine.recv()
    finally:
        child.kill()
        child.join()
