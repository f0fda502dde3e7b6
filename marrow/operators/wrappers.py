"""Retry, timing and context for reads."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Context:
    """Who asks: given to policies."""

    identity: str | None = None
    roles: tuple[str, ...] = ()
    request: str | None = None
    scope: dict[str, Any] = field(default_factory=dict)


def observed(name: str, run: Callable[[], Any], report: Callable[[dict], None], slow: float | None = None) -> Any:
    """run() with a report of its time, its rows (if it returns a list) and whether it succeeded."""
    began, ok, out = time.monotonic(), False, None
    try:
        out = run()
        ok = True
        return out
    finally:
        seconds = time.monotonic() - began
        report({"op": name, "seconds": seconds, "ok": ok, "rows": len(out) if isinstance(out, list) else None, "slow": slow is not None and seconds > slow})


def retried(run: Callable[[], Any], tries: int = 3, first: float = 0.1, most: float = 2.0, again: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Runs a read again after failures, with a capped and jittered backoff.  Writes are not for this."""
    for k in range(tries):
        try:
            return run()
        except Exception as e:
            if k + 1 == tries or not again(e):
                raise
            sleep(min(most, first * 2**k) * (0.5 + random.random() / 2))
    return None


def within(seconds: float, run: Callable[[], Any], cancel: Callable[[], None] | None = None) -> Any:
    """run() if it ends in time; else ``cancel`` is called (such as SparkContext.cancelJobGroup) and TimeoutError raised."""
    out: dict[str, Any] = {}

    def body() -> None:
        try:
            out["value"] = run()
        except Exception as e:  # noqa: BLE001
            out["error"] = e

    thread = threading.Thread(target=body, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        if cancel is not None:
            cancel()
        raise TimeoutError(f"not done in {seconds} s")
    if "error" in out:
        raise out["error"]
    return out["value"]


def transacted(store: Any, body: Callable[[Any], Any], tries: int = 3, **backoff: Any) -> Any:
    """Runs body(store) in a transaction, and again from the start where another writer committed meanwhile."""
    from marrow.sources.store import Conflict

    def once() -> Any:
        with store.transaction() as tx:
            return body(tx)

    return retried(once, tries, again=lambda e: isinstance(e, Conflict), **backoff)
