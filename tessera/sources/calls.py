"""Calls of services from the driver or a task: replays with growing delays, politeness, errors kept by item, a stop when
blocked, and results written every few items."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any


class Transient(RuntimeError):
    """May work when it is tried again."""


class Blocked(RuntimeError):
    """The service refuses; never tried again."""


class Disallowed(RuntimeError):
    """The robots rules forbid the address."""


class Unreadable(RuntimeError):
    """The answer is not what was expected."""


def backoff(attempt: int, base: float = 2.0, cap: float = 120.0, jitter: float = 0.25, draw: Callable[[float, float], float] = random.uniform) -> float:
    """Seconds before replay `attempt`, from 0: doubling, capped, some share more or less."""
    return min(cap, base * 2**attempt) * (1 + draw(-jitter, jitter))


def polite(least: float, most: float, sleep: Callable[[float], None] = time.sleep) -> float:
    """Wait between least and most seconds; how long is returned."""
    seconds = random.uniform(least, max(least, most))
    sleep(seconds)
    return seconds


def replayed(call: Callable[..., Any], retries: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[..., Any]:
    """The call, replayed after Transient errors at most `retries` times; others, Blocked above all, pass at once."""

    def run(*args, **more):
        for attempt in range(retries + 1):
            try:
                return call(*args, **more)
            except Transient:
                if attempt == retries:
                    raise
            sleep(backoff(attempt, base))

    return run


def collect(keys: Iterable[str], call: Callable[[str], Any], save: Callable[[list[tuple[str, str, Any]]], None], every: int = 5) -> dict[str, int]:
    """Call for each key; (key, status, result) go to save() every few keys and at the end.

    An error of one key is its status, and the others go on; Blocked stops the rest, saved results stay, and the key
    blocked is among them.  Returns the keys of each status.
    """
    counts: dict[str, int] = {}
    held: list[tuple[str, str, Any]] = []
    for key in keys:
        try:
            held.append((key, "ok", call(key)))
        except Blocked as stop:
            held.append((key, "blocked", str(stop)))
        except Exception as fault:  # noqa: BLE001
            held.append((key, "error", f"{type(fault).__name__}: {fault}"))
        counts[held[-1][1]] = counts.get(held[-1][1], 0) + 1
        if held[-1][1] == "blocked":
            break
        if len(held) >= every:
            save(held)
            held = []
    if held:
        save(held)
    return counts


def in_partitions(call: Callable[[str], str], retries: int = 3, base: float = 2.0) -> Callable[[Iterator], Iterator]:
    """For mapInPandas on (key): key, status, payload; errors are rows, and a block ends its partition's calls."""

    def run(frames):
        import pandas as pd

        asked, stopped = replayed(call, retries, base), False
        for frame in frames:
            rows = []
            for key in frame["key"]:
                try:
                    rows.append((key, "skipped", None) if stopped else (key, "ok", asked(key)))
                except Blocked as stop:
                    stopped = True
                    rows.append((key, "blocked", str(stop)))
                except Exception as fault:  # noqa: BLE001
                    rows.append((key, "error", f"{type(fault).__name__}: {fault}"))
            yield pd.DataFrame(rows, columns=["key", "status", "payload"])

    return run
