"""Durations such as 30s, 5m, 1.5h, 7d, 2w, 1mo."""

from __future__ import annotations

import re

# Seconds by unit; a month is 30 days (fixed values).
UNITS = {
    "s": 1, "sec": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "minute": 60, "minutes": 60, "h": 3600, "hr": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400, "w": 604800, "wk": 604800, "week": 604800, "weeks": 604800, "mo": 2592000, "month": 2592000, "months": 2592000,
}


def seconds(text: str) -> float:
    """Length of a duration; fractions are allowed, an unknown unit is an error."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]+)\s*", text)
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"not a duration: {text!r}")
    return float(m[1]) * UNITS[m[2].lower()]


def interval(text: str) -> str:
    """The duration as Spark writes intervals."""
    return f"{round(seconds(text) * 1_000_000)} microseconds"
