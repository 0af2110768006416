"""Periods, and the dates of the from clause."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from ..errors import QueryError

UNITS = {"y": "years?|y", "mo": "months?|mo", "w": "weeks?|w", "d": "days?|d", "h": "hours?|h", "m": "minutes?|mins?|m", "s": "seconds?|secs?|s"}
PERIOD = re.compile(r"\s*" + "".join(rf"(?:(?P<{u}>\d*)\s*(?:{words})(?![a-z])\s*,?\s*)?" for u, words in UNITS.items()) + r"(?:ago)?\s*", re.I)
SECONDS = {"w": 604800, "d": 86400, "h": 3600, "m": 60, "s": 1}
ISO = re.compile(r"(\d{1,9})(?:-(\d{1,2})(?:-(\d{1,2}))?)?(?:T(\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:[.,](\d+))?)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
MOST_SECONDS = 2**31 - 1


def parse_period(text: str) -> dict[str, int] | None:
    """Counts by unit, or None if the text isn't a period."""
    m = PERIOD.fullmatch(text)
    found = {u: int(n or 1) for u, n in m.groupdict().items() if n is not None} if m else {}
    return found or None


def period_seconds(text: str) -> int | None:
    """Length of a period without months and years."""
    found = parse_period(text)
    if found is None:
        return None
    if "y" in found or "mo" in found:
        raise QueryError("months and years have no fixed length")
    return sum(n * SECONDS[u] for u, n in found.items())


def minus_period(when: datetime, period: dict[str, int]) -> datetime:
    months = when.year * 12 + when.month - 1 - period.get("y", 0) * 12 - period.get("mo", 0)
    year, month = divmod(months, 12)
    last = (datetime(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    when = when.replace(year=year, month=month + 1, day=min(when.day, last))
    return when - timedelta(seconds=sum(n * SECONDS[u] for u, n in period.items() if u in SECONDS))


def parse_date(text: str, now: datetime) -> datetime:
    """ISO date (also partial), a relative word or period, or a unix timestamp; naive, in the session's zone."""
    iso = ISO.match(text.strip().replace(" ", "T"))
    if iso:
        year, month, day, hour, minute, second, fraction, zone = iso.groups()
        if len(year) <= 4 or month:
            try:
                when = datetime(int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0))
            except ValueError as e:
                raise QueryError(f"no such date: {text}", "from") from e
            if fraction:
                when += timedelta(microseconds=int(fraction[:6].ljust(6, "0")))
            if zone and zone != "Z":
                when -= (1 if zone[0] == "+" else -1) * timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:]))
            return when
    today, word = now.replace(hour=0, minute=0, second=0, microsecond=0), text.strip().lower()
    for name, days in (("yesterday", -1), ("today", 0), ("tomorrow", 1)):
        if word and name.startswith(word):
            return today + timedelta(days=days)
    if (period := parse_period(text)) is not None:
        return minus_period(today, period)
    if re.fullmatch(r"-?\d+", word):
        stamp = int(word)
        return datetime.fromtimestamp(stamp if stamp < MOST_SECONDS else stamp / 1000, timezone.utc).replace(tzinfo=None)
    raise QueryError(f"can't read the date {text!r}", "from")


def parse_range(words: list[str], now: datetime) -> tuple[datetime, datetime]:
    """Start and end of the words after the dataset's name."""
    if len(words) == 2:
        texts = words
    elif len(words) == 4:
        texts = [" ".join(words[:2]), " ".join(words[2:])]
    elif len(words) == 3:
        texts = [words[0], " ".join(words[1:])] if "-" in words[1] else [" ".join(words[:2]), words[2]]
    else:
        raise QueryError("a start and an end date are needed, each of one or two words", "from")
    start, end = (parse_date(t, now) for t in texts)
    if not start < end:
        raise QueryError(f"the start {start} is not before the end {end}", "from")
    return start, end
