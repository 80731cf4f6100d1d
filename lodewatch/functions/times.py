"""Time ranges of searches, tiers and rules, as plain values: no wall clock, `as_of` is always given."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def resolve_time(text: str | datetime, as_of: datetime) -> datetime:
    """An absolute `yyyy-MM-dd HH:mm:ss`, `now`, or `-7d`, `-1h`, `-30m`, `-10s` before as_of."""
    if isinstance(text, datetime):
        return text
    if text == "now":
        return as_of
    if found := re.fullmatch(r"-(\d+)([smhdw])", text):
        return as_of - timedelta(**{_UNITS[found[2]]: int(found[1])})
    return datetime.strptime(text, "%Y-%m-%d %H:%M:%S")


def last(text: str, as_of: datetime) -> tuple[datetime, datetime]:
    """`last N h|d|w|m|y`; a month is 30 days and a year 365."""
    found = re.fullmatch(r"\s*last\s+(\d+)\s*([hdwmy])\w*\s*", text, re.IGNORECASE)
    if not found:
        raise ValueError(f"not a time range: {text!r}")
    n, unit = int(found[1]), found[2].lower()
    span = timedelta(hours=n) if unit == "h" else timedelta(days=n * {"d": 1, "w": 7, "m": 30, "y": 365}[unit])
    return as_of - span, as_of


def timeframe(text: str | int | None, default: str = "5 minutes") -> str:
    """A rule's time frame as an interval: `5m`, `1h`, `30s`, `2d`; a bare number is minutes."""
    found = re.fullmatch(r"\s*(\d+)\s*([smhd]?)\s*", str(text or ""))
    return f"{found[1]} {_UNITS[found[2] or 'm']}" if found else default


def tiers_for_range(start: datetime, end: datetime, as_of: datetime, hot_days: int = 7, warm_days: int = 90) -> list[str]:
    """The storage tiers that a range's rows belong to, by whole days of age as in tier_of(); none if it ends before it starts."""
    if end < start:
        return []
    youngest, oldest = (as_of.date() - end.date()).days, (as_of.date() - start.date()).days
    return [t for t, touched in (("hot", youngest < hot_days), ("warm", youngest < warm_days and oldest >= hot_days), ("cold", oldest >= warm_days)) if touched]
