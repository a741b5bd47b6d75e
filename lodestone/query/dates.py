"""Date arguments to inclusive ranges of epoch seconds, with now and the time zone given."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from lodestone.query.nodes import GE, GT, LE, LT, RANGE, Compare, Never, Node


@dataclass(frozen=True)
class Clock:
    """What "now" is, in epoch seconds, and where."""

    now: int = 1_706_659_200
    zone: str = "UTC"

    def today(self) -> date:
        return datetime.fromtimestamp(self.now, ZoneInfo(self.zone)).date()

    def start(self, day: date) -> int:
        return int(datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(self.zone)).timestamp())

    def end(self, day: date) -> int:
        return int(datetime(day.year, day.month, day.day, 23, 59, 59, tzinfo=ZoneInfo(self.zone)).timestamp())


def _month(year: int, month: int) -> tuple[date, date]:
    year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    return date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1])


def _named(word: str, today: date) -> tuple[date, date] | None:
    sunday = today - timedelta(days=(today.weekday() + 1) % 7)
    week = timedelta(days=6)
    match word:
        case "today":
            return today, today
        case "yesterday":
            return today - timedelta(1), today - timedelta(1)
        case "thisweek":
            return sunday, sunday + week
        case "lastweek":
            return sunday - timedelta(7), sunday - timedelta(1)
        case "thismonth":
            return _month(today.year, today.month)
        case "lastmonth":
            return _month(today.year, today.month - 1)
        case "thisyear":
            return date(today.year, 1, 1), date(today.year, 12, 31)
        case "lastyear":
            return date(today.year - 1, 1, 1), date(today.year - 1, 12, 31)
    return None


def _ago(count: int, unit: str, today: date) -> date | None:
    """So many units before today; a day that the month lacks becomes its last."""
    try:
        if unit in ("day", "week"):
            return today - timedelta(days=count * (7 if unit == "week" else 1))
        months = today.year * 12 + today.month - 1 - count * (12 if unit == "year" else 1)
        year, month = divmod(months, 12)
        return date(year, month + 1, min(today.day, calendar.monthrange(year, month + 1)[1]))
    except (OverflowError, ValueError):
        return None


def period(text: str, clock: Clock) -> tuple[int, int] | None:
    """(first second, last second) of a keyword, lastN<units> or YYYY[-MM[-DD]]; None if it isn't one."""
    text, today = text.lower(), clock.today()
    if named := _named(text, today):
        return clock.start(named[0]), clock.end(named[1])
    if relative := re.fullmatch(r"last(\d+)(day|week|month|year)s?", text, re.ASCII):
        count = int(relative[1])
        first = _ago(count, relative[2], today) if 0 < count <= 100_000_000 else None
        return first and (clock.start(first), clock.now)
    if iso := re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d))?)?", text, re.ASCII):
        year, month, day = (x and int(x) for x in iso.groups())
        try:
            if year < 1900:
                return None
            if month is None:
                return clock.start(date(year, 1, 1)), clock.end(date(year, 12, 31))
            first, last = _month(year, month) if day is None and 1 <= month <= 12 else (date(year, month, day or 0),) * 2
            return clock.start(first), clock.end(last)
        except ValueError:
            return None
    return None


def compare(argument: str, clock: Clock) -> Node:
    """A filter on the modification time. > is after the period's end, < before its start."""
    low, dots, high = argument.partition("..")
    if dots:
        first, last = (period(x, clock) if x else None for x in (low, high))
        if not (low or high) or (low and not first) or (high and not last):
            return Never(invalid=True)
        return Compare("time", RANGE, max(0, first[0]) if first else 0, max(0, last[1]) if last else None)
    op = next((o for o in (GE, LE, GT, LT) if argument.startswith(o)), RANGE)
    found = period(argument[len(op) :] if op != RANGE else argument, clock)
    if not found:
        return Never(invalid=True)
    start, end = (max(0, x) for x in found)
    if op == RANGE:
        return Compare("time", RANGE, start, end)
    return Compare("time", op, end if op in (GT, LE) else start)
