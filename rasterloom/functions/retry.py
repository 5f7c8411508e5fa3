"""Retries for a source's own I/O: exponential backoff with full jitter. Spark retries tasks by itself."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
#: Parts of error texts that say trying again may help (fixed values), besides timeouts, which are told by their type.
TRANSIENT = ("429", "500", "502", "503", "504", "too many requests", "quota", "rate limit", "deadline", "timed out", "timeout", "unavailable", "connection reset")


class Retryable(RuntimeError):
    pass


def is_transient(error: BaseException) -> bool:
    return isinstance(error, (Retryable, TimeoutError, ConnectionError)) or any(x in str(error).lower() for x in TRANSIENT)


def delay(attempt: int, base: float, cap: float = 60.0, rng: Callable[[float, float], float] = random.uniform) -> float:
    return rng(0.0, min(cap, base * 2**attempt))


def with_retry(call: Callable[[], T], attempts: int = 6, base: float = 1.0, cap: float = 60.0, retry: Callable[[BaseException], bool] = is_transient, sleep: Callable[[float], None] = time.sleep) -> T:
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n + 1 == attempts or not retry(e):
                raise
            sleep(delay(n, base, cap))
    raise AssertionError("attempts must be above 0")


def within(seconds: float | None, call: Callable[..., T], *args) -> T:
    """The call's result, or a TimeoutError (which is transient) when it takes longer; a late call ends by itself, unheard."""
    if not seconds:
        return call(*args)
    said: list[tuple[T | None, BaseException | None]] = []

    def run() -> None:
        try:
            said.append((call(*args), None))
        except BaseException as e:
            said.append((None, e))

    one = threading.Thread(target=run, daemon=True)
    one.start()
    one.join(seconds)
    if not said:
        raise TimeoutError(f"not done in {seconds:g} s")
    value, error = said[0]
    if error:
        raise error
    return value
