"""Durations as the dialect writes them."""

from __future__ import annotations

import re

from quern.errors import AnalysisError

#: Seconds of a unit, by its names (fixed values).
UNITS = {
    **dict.fromkeys(("ns", "nanosecond", "nanoseconds"), 1e-9),
    **dict.fromkeys(("us", "microsecond", "microseconds"), 1e-6),
    **dict.fromkeys(("ms", "millisecond", "milliseconds"), 1e-3),
    **dict.fromkeys(("s", "sec", "secs", "second", "seconds"), 1),
    **dict.fromkeys(("m", "min", "mins", "minute", "minutes"), 60),
    **dict.fromkeys(("h", "hr", "hrs", "hour", "hours"), 3600),
    **dict.fromkeys(("d", "day", "days"), 86_400),
    **dict.fromkeys(("w", "week", "weeks"), 604_800),
}
PART = re.compile(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*([a-z]+)\s*")


def seconds(value: int | float | str) -> float:
    """A number, or a string of one, is seconds; else parts such as 1h30m are added up."""
    if not isinstance(value, str):
        total = float(value)
    else:
        try:
            total = float(value)
        except ValueError:
            total, at, low = 0.0, 0, value.lower()
            while at < len(low):
                m = PART.match(low, at)
                if not m or m[2] not in UNITS:
                    raise AnalysisError(f"not a duration: {value!r}") from None
                total += float(m[1]) * UNITS[m[2]]
                at = m.end()
    if total <= 0:
        raise AnalysisError(f"a duration must be positive: {value!r}")
    return total


def microseconds(value: int | float | str) -> int:
    return max(1, round(seconds(value) * 1_000_000))


def retention_seconds(value: str) -> float:
    return seconds(value)
