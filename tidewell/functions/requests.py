"""What a question asks for, parsed once on the driver: date ranges, scope words, terms."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass, field

MONTH = {name.lower(): n for n, name in enumerate(calendar.month_name) if name} | {name.lower(): n for n, name in enumerate(calendar.month_abbr) if name}


@dataclass(frozen=True)
class Request:
    """A parsed question: an inclusive range of days, years, quoted and plain terms."""

    low: dt.date | None = None
    high: dt.date | None = None
    years: tuple[int, ...] = ()
    terms: tuple[str, ...] = field(default=())


def _month(year: int, month: int) -> tuple[dt.date, dt.date]:
    return dt.date(year, month, 1), dt.date(year, month, calendar.monthrange(year, month)[1])


def date_range(question: str, today: dt.date) -> tuple[dt.date, dt.date] | None:
    """The inclusive range of days a question names: a day, a month, a year, a range of years, or a relative phrase
    (weeks begin on Monday); impossible days are no range."""
    q = question.lower()
    if m := re.search(r"\b(\d{4})-(\d{2})-(\d{2})\b", q):
        try:
            day = dt.date(*map(int, m.groups()))
        except ValueError:
            return None
        return day, day
    monday = today - dt.timedelta(days=today.weekday())
    phrases = {
        "today": (today, today), "yesterday": (today - dt.timedelta(days=1),) * 2, "this week": (monday, monday + dt.timedelta(days=6)),
        "last week": (monday - dt.timedelta(days=7), monday - dt.timedelta(days=1)), "this month": _month(today.year, today.month),
        "last month": _month(*((today.year, today.month - 1) if today.month > 1 else (today.year - 1, 12))),
        "this year": (dt.date(today.year, 1, 1), dt.date(today.year, 12, 31)), "last year": (dt.date(today.year - 1, 1, 1), dt.date(today.year - 1, 12, 31)),
    }
    for phrase, span in phrases.items():
        if re.search(rf"\b{phrase}\b", q):
            return span
    if m := re.search(r"\b(" + "|".join(sorted(MONTH, key=len, reverse=True)) + r")\.? (\d{1,2}),? (\d{4})\b", q):
        try:
            day = dt.date(int(m[3]), MONTH[m[1]], int(m[2]))
        except ValueError:
            return None
        return day, day
    if m := re.search(r"\b(" + "|".join(sorted(MONTH, key=len, reverse=True)) + r")\.? (?:of )?((?:19|20)\d{2})\b", q):
        return _month(int(m[2]), MONTH[m[1]])
    if m := re.search(r"\b((?:19|20)\d{2})\s*(?:-|–|to|until|through)\s*((?:19|20)\d{2})\b", q):
        low, high = sorted((int(m[1]), int(m[2])))
        return dt.date(low, 1, 1), dt.date(high, 12, 31)
    if m := re.search(r"\b((?:19|20)\d{2})\b", q):
        return dt.date(int(m[1]), 1, 1), dt.date(int(m[1]), 12, 31)
    return None


def parse(question: str, today: dt.date, *, most: int = 8, stop: frozenset[str] = frozenset()) -> Request:
    """All of it; terms are quoted phrases first, then words of three and more characters, each once, at most ``most``."""
    span = date_range(question, today)
    years = tuple(dict.fromkeys(int(y) for y in re.findall(r"(?<!\d)((?:19|20)\d{2})(?!\d)", question)))
    quoted = re.findall(r"\"([^\"]+)\"|'([^']+)'", question)
    plain = [w for w in re.findall(r"[a-z0-9]{3,}", question.lower()) if w not in stop]
    terms = tuple(dict.fromkeys([*(a or b for a, b in quoted), *plain]))[:most]
    return Request(*(span or (None, None)), years, terms)


def split_years(question: str) -> list[str]:
    """One question per year where it names several, else itself: each keeps its own year only."""
    years = list(dict.fromkeys(re.findall(r"(?<!\d)((?:19|20)\d{2})(?!\d)", question)))
    if len(years) < 2:
        return [question]
    bare = re.sub(r"\s*(?:,|and|or|vs\.?|versus|to|-|–)?\s*(?<!\d)(?:19|20)\d{2}(?!\d)", "", question).strip()
    return [f"{bare} {y}" for y in years]


def since(text: str, now: dt.datetime) -> dt.datetime | None:
    """The moment that '30m', '24h' or '7d' before ``now``, or an ISO date or time, names; without a zone it is UTC."""
    raw = text.strip()
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)([mhd])", raw.lower()):
        return now - dt.timedelta(**{{"m": "minutes", "h": "hours", "d": "days"}[m[2]]: float(m[1])})
    try:
        at = dt.datetime.fromisoformat(raw)
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)


def day_range(text: str) -> tuple[dt.date, dt.date] | None:
    """Two days written 'A:B' or 'A..B', or one day, in order; anything else is none."""
    try:
        days = [dt.date.fromisoformat(p.strip()) for p in re.split(r"\.\.|:", text)]
    except ValueError:
        return None
    return (min(days), max(days)) if 1 <= len(days) <= 2 else None


def range_label(low: dt.date | None, high: dt.date | None) -> str:
    """A range in words: a day, a month, a year, or both ends."""
    if low is None or high is None:
        return "any time"
    if low == high:
        return low.isoformat()
    if (low, high) == _month(low.year, low.month):
        return f"{low:%Y-%m}"
    if (low, high) == (dt.date(low.year, 1, 1), dt.date(low.year, 12, 31)):
        return str(low.year)
    return f"{low.isoformat()} to {high.isoformat()}"
