"""Time specifications: a point or a range of time given in words, and the slots of flow files it selects."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

SLOT_SECONDS = 300

_DATES = ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y")
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def zone_of(name: str | None) -> timezone | ZoneInfo | None:
    """The zone of an option: none given is UTC, ``system`` the machine's own, what is unknown UTC."""
    if not name:
        return timezone.utc
    if name == "system":
        return None
    try:
        return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError):
        return timezone.utc


def _named(token: str, names: tuple[str, ...]) -> int | None:
    word = token.lower()
    return next((i for i, n in enumerate(names) if word in (n, n[:3])), None)


def _parts(token: str, tz) -> dict[str, int]:
    """What a token says: any of year, month, day, weekday, hour, minute, second."""
    for form in _DATES:
        try:
            date = datetime.strptime(token, form)
            return {"year": date.year, "month": date.month, "day": date.day}
        except ValueError:
            continue
    if re.fullmatch(r"\d{1,2}:\d{2}", token):
        clock = datetime.strptime(token, "%H:%M")
        return {"hour": clock.hour, "minute": clock.minute}
    if (weekday := _named(token, _DAYS)) is not None:
        return {"weekday": weekday}
    if (month := _named(token, _MONTHS)) is not None:
        return {"month": month + 1}
    if token.isdigit():
        moment = datetime.fromtimestamp(int(token), tz)
        return {x: getattr(moment, x) for x in ("year", "month", "day", "hour", "minute", "second")}
    raise ValueError(f"invalid time specifier '{token}'")


def parse_time(text: str, zone: str | None = None, now: datetime | None = None) -> int:
    """Epoch seconds of white-space separated date, time, weekday, month or epoch tokens.

    A token replaces those parts of earlier ones that it names: a month that follows a date
    changes its month only, a time that follows an epoch its hour and minute.  Of what is left open:
    a weekday without a date is that day of the last seven, today included; a month without a day is its
    first day, this year or, if it lies ahead, last year; no time is midnight; only a time is today or,
    if its hour is ahead of now, yesterday.  Days past a month's end run into the next.
    """
    tz = zone_of(zone)
    now = (now or datetime.now(timezone.utc)).astimezone(tz)
    given: dict[str, int] = {}
    for token in text.split():
        given |= _parts(token, tz)
    if not given:
        raise ValueError("empty time specification")
    year, month, day = (given.get(x) for x in ("year", "month", "day"))
    today = now.date()
    if month is not None:
        year = year or now.year - (day is None and month > now.month)
        date = datetime(year, month, 1).date() + timedelta(days=(day or 1) - 1)
    elif "weekday" in given:
        date = today - timedelta(days=(now.weekday() - given["weekday"]) % 7)
    else:
        date = today - timedelta(days=int(given.get("hour", 0) > now.hour))
    local = datetime(date.year, date.month, date.day, given.get("hour", 0), given.get("minute", 0), given.get("second", 0))
    moment = local.astimezone() if tz is None else local.replace(tzinfo=tz)
    return int(moment.timestamp())


def point(text: str, zone: str | None = None, now: datetime | None = None, slot: int = SLOT_SECONDS) -> tuple[int, int]:
    """[begin, end) of the one slot that holds the time."""
    begin = parse_time(text, zone, now) // slot * slot
    return begin, begin + slot


def span(text: str, zone: str | None = None, now: datetime | None = None, slot: int = SLOT_SECONDS) -> tuple[int, int]:
    """[begin, end) of ``begin[#end]``, widened to whole slots; no end is now."""
    first, mark, last = text.partition("#")
    if "#" in last:
        raise ValueError(f"more than one end in '{text}'")
    begin = parse_time(first, zone, now)
    end = parse_time(last, zone, now) if mark else int((now or datetime.now(timezone.utc)).timestamp())
    begin, end = begin // slot * slot, -(-end // slot) * slot
    if end <= begin:
        raise ValueError(f"the range '{text}' ends before it begins")
    return begin, end
