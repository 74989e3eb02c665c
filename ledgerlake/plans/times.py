"""Points of time: micros, ISO texts and English phrases (units ago and ahead, weekdays, clock times, months), by a clock."""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from ..functions.values import micros

Clock = Callable[[], datetime]
#: Units of a fixed length in seconds, and calendar units in months.
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "fortnight": 1209600}
_MONTHS = {"month": 1, "quarter": 3, "year": 12, "decade": 120}
_DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
_CLOCK = r"(noon|midnight|\d{1,2}(?::\d{2}){0,2}\s*(?:am|pm)?)"


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _moved(when: datetime, unit: str, count: int) -> datetime:
    if unit in _UNITS:
        return when + timedelta(seconds=count * _UNITS[unit])
    month = when.year * 12 + when.month - 1 + count * _MONTHS[unit]
    year, month = divmod(month, 12)
    return when.replace(year=year, month=month + 1, day=min(when.day, calendar.monthrange(year, month + 1)[1]))


def _of_day(text: str) -> timedelta:
    if text in ("noon", "midnight"):
        return timedelta(hours=12 * (text == "noon"))
    m = re.fullmatch(r"(\d{1,2})(?::(\d{2}))?(?::(\d{2}))?\s*(am|pm)?", text)
    hour = int(m[1])
    if m[4]:
        if not 1 <= hour <= 12:
            raise ValueError(text)
        hour = hour % 12 + 12 * (m[4] == "pm")
    if hour > 23 or int(m[2] or 0) > 59 or int(m[3] or 0) > 59:
        raise ValueError(text)
    return timedelta(hours=hour, minutes=int(m[2] or 0), seconds=int(m[3] or 0))


def _day(text: str, here: datetime) -> datetime | None:
    """Midnight of a day that a phrase names, or None."""
    today = here.replace(hour=0, minute=0, second=0, microsecond=0)
    fixed = {"today": 0, "yesterday": -1, "tomorrow": 1, "the day before yesterday": -2, "the day after tomorrow": 2}
    if text in fixed:
        return today + timedelta(days=fixed[text])
    if m := re.fullmatch(rf"(?:(last|next|this|on) )?({'|'.join(_DAYS)})", text):
        ahead = (_DAYS.index(m[2]) - today.weekday()) % 7
        if m[1] == "next":
            return today + timedelta(days=ahead or 7)
        if m[1] == "this":
            return today + timedelta(days=ahead)
        return today + timedelta(days=ahead - 7) if m[1] == "last" or ahead else today  # the most recent one
    for shape in ("%B %d %Y", "%b %d %Y", "%d %B %Y", "%d %b %Y", "%m/%d/%Y", "%Y-%m-%d"):
        try:
            return datetime.strptime(re.sub(r"(\d)(?:st|nd|rd|th)\b", r"\1", text.replace(",", " ").replace("  ", " ")), shape)
        except ValueError:
            continue
    return None


def to_micros(when: int | str | datetime, clock: Clock = now) -> int:
    if isinstance(when, int):
        return when
    if isinstance(when, datetime):
        return micros(when)
    text = " ".join(when.strip().strip("\"'").lower().split())
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    here = clock()
    if text == "now":
        return micros(here)
    units = "|".join([*_UNITS, *_MONTHS])
    if m := re.fullmatch(rf"(last|next) ({units})", text):
        return micros(_moved(here, m[2], 1 if m[1] == "next" else -1))
    if m := re.fullmatch(rf"(\d+|{'|'.join(_NUMBERS)}) ({units})s? (ago|from now|later|hence)", text) or re.fullmatch(rf"in (\d+|{'|'.join(_NUMBERS)}) ({units})s?()", text):
        count = int(m[1]) if m[1].isdigit() else _NUMBERS[m[1]]
        return micros(_moved(here, m[2], -count if m[3] == "ago" else count))
    try:
        if (day := _day(text, here)) is not None:
            return micros(day)
        if m := re.fullmatch(rf"(?:at )?{_CLOCK}", text):
            return micros(_day("today", here) + _of_day(m[1]))
        if (m := re.fullmatch(rf"(.+?),? at {_CLOCK}", text)) and (day := _day(m[1], here)) is not None:
            return micros(day + _of_day(m[2]))
        if (m := re.fullmatch(rf"{_CLOCK} (?:on )?(.+)", text)) and (day := _day(m[2], here)) is not None:
            return micros(day + _of_day(m[1]))
        return micros(datetime.fromisoformat(text.upper() if "t" in text else text))
    except ValueError:
        raise ValueError(f"not a point of time: {when!r}") from None
