"""Parameters of queries: periods, steps, intervals, site ids and limits."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

SITE_ID = r"^[A-Za-z0-9._:\-]{1,256}$"
MAX_DAYS = 366
#: Days before today of each period.
PERIODS = {"day": 0, "today": 0, "7d": 7, "30d": 30, "90d": 90}
#: Seconds and greatest number of each unit.
UNITS = {"second": (1, 86_400), "minute": (60, 1_440), "hour": (3_600, 720), "day": (86_400, 365), "week": (604_800, 52)}


class ParameterError(ValueError):
    """A parameter that no query takes."""


def check_site_id(site_id: str) -> str:
    if not re.fullmatch(SITE_ID.strip("^$"), site_id or ""):
        raise ParameterError("site_id: 1 to 256 letters, digits, dots, hyphens, underscores or colons")
    return site_id


def site_id_valid(column: Column) -> Column:
    return F.coalesce(column.rlike(SITE_ID), F.lit(False))


def _day(text: str) -> date:
    try:
        return date.fromisoformat(text)
    except (TypeError, ValueError):
        raise ParameterError(f"not a date: {text!r}") from None


def resolve_period(period: str | None = None, start: str | None = None, end: str | None = None, today: date | None = None) -> tuple[str, str]:
    """Half-open (start, end) dates.  Two explicit dates win; with only one, ``period`` (30d if none) counts."""
    if start and end:
        first, last = _day(start), _day(end)
        if last < first:
            raise ParameterError("end is before start")
        if (last - first).days > MAX_DAYS:
            raise ParameterError(f"over {MAX_DAYS} days")
        return first.isoformat(), last.isoformat()
    period = period or "30d"
    if period not in PERIODS:
        raise ParameterError(f"period is one of {', '.join(PERIODS)}")
    today = today or date.today()
    return (today - timedelta(PERIODS[period])).isoformat(), (today + timedelta(1)).isoformat()


def hourly(period: str | None) -> bool:
    """Whether a time series is by hour; the period decides even where explicit dates are given."""
    return period in ("day", "today")


def parse_step(step: str) -> Column:
    """``page:<path>`` or ``event:<name>`` as a condition."""
    kind, _, value = step.strip().partition(":")
    column = {"page": "pathname", "event": "event_name"}.get(kind)
    if not column or not 1 <= len(value.encode()) <= 256:
        raise ParameterError(f"not a step: {step!r}; page:<path> or event:<name> of 1 to 256 bytes")
    return F.col(column) == F.lit(value)


def parse_steps(steps: str, least: int = 1) -> list[Column]:
    """Comma-separated steps; a path with a comma can't be said."""
    found = [parse_step(s) for s in steps.split(",")]
    if len(found) < least:
        raise ParameterError(f"{least} steps at least")
    return found


def parse_interval(text: str) -> int:
    """``N unit`` in seconds."""
    m = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", text or "")
    if not m or m[2] not in UNITS:
        raise ParameterError(f"not an interval: {text!r}")
    n, (seconds, most) = int(m[1]), UNITS[m[2]]
    if not 1 <= n <= most:
        raise ParameterError(f"{m[2]}s: 1 to {most}")
    return n * seconds


def check_limit(limit: int | None) -> int:
    limit = 10 if limit is None else limit
    if not 1 <= limit <= 1000:
        raise ParameterError("limit: 1 to 1000")
    return limit


def check_weeks(weeks: int | None) -> int:
    weeks = 4 if weeks is None else weeks
    if not 1 <= weeks <= 52:
        raise ParameterError("weeks: 1 to 52")
    return weeks


def check_page(page: str) -> str:
    if not 1 <= len(page.encode()) <= 256:
        raise ParameterError("page: 1 to 256 bytes")
    return page
