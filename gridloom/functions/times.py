"""Time axes: units with an origin, calendars, and guesses at the unit of bare numbers. Column expressions throughout."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.errors import ExtractError

#: Seconds in a unit, by its names.
UNIT_SECONDS = {
    **dict.fromkeys(("second", "seconds", "sec", "secs", "s"), 1), **dict.fromkeys(("minute", "minutes", "min", "mins"), 60),
    **dict.fromkeys(("hour", "hours", "hr", "hrs", "h"), 3600), **dict.fromkeys(("day", "days", "d"), 86400),
}
#: Calendars and their names.
CALENDARS = {"": "standard", "standard": "standard", "gregorian": "standard", "proleptic_gregorian": "standard", "noleap": "noleap", "365_day": "noleap", "365": "noleap", "360_day": "360_day", "360": "360_day"}
#: Days before each month of a year without a leap day.
MONTH_STARTS = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)

_UNITS = re.compile(
    r"\s*(?P<unit>[a-z]+)\s+since\s+(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})"
    r"(?:[ t](?P<H>\d{1,2}):(?P<M>\d{1,2})(?::(?P<S>\d{1,2}(?:\.\d+)?))?)?\s*(?:(?P<sign>[+-])(?P<zh>\d{1,2}):?(?P<zm>\d{2})?|z)?\s*",
    re.IGNORECASE,
)


@dataclass(frozen=True)
class TimeUnits:
    """``<unit> since <date>``: seconds in a unit, and the origin's date and seconds of the day (UTC)."""

    scale: int
    year: int
    month: int
    day: int
    seconds: float

    @classmethod
    def parse(cls, text: str) -> TimeUnits:
        found = _UNITS.fullmatch(text)
        if not found or found["unit"].lower() not in UNIT_SECONDS:
            raise ExtractError(f"time units {text!r} aren't understood")
        zone = (int(found["zh"] or 0) * 3600 + int(found["zm"] or 0) * 60) * (-1 if found["sign"] == "-" else 1)
        clock = int(found["H"] or 0) * 3600 + int(found["M"] or 0) * 60 + float(found["S"] or 0)
        return cls(UNIT_SECONDS[found["unit"].lower()], int(found["y"]), int(found["m"]), int(found["d"]), clock - zone)

    def origin(self) -> float:
        """Unix seconds of the origin in the standard calendar."""
        return datetime(self.year, self.month, self.day, tzinfo=UTC).timestamp() + self.seconds


def calendar_of(name: str | None) -> str:
    try:
        return CALENDARS[(name or "").lower()]
    except KeyError:
        raise ExtractError(f"calendar {name!r} isn't supported") from None


def decode_seconds(value: Column, units: str) -> Column:
    """Unix seconds (double) of a time value in the standard calendar."""
    u = TimeUnits.parse(units)
    return value.cast("double") * u.scale + u.origin()


def decode_timestamp(value: Column, units: str) -> Column:
    """Timestamp of a time value in the standard calendar."""
    return F.timestamp_micros(F.round(decode_seconds(value, units) * 1e6).cast("long"))


def decode_iso(value: Column, units: str, calendar: str | None = "standard") -> Column:
    """ISO-8601 text of a time value, to the nearest millisecond, without trailing zeros. In the other calendars the day may be one
    that doesn't exist."""
    kind = calendar_of(calendar)
    if kind == "standard":
        milli = F.round(decode_seconds(value, units) * 1000).cast("long")
        return F.concat(F.date_format(F.timestamp_seconds(F.floor(milli / 1000)), "yyyy-MM-dd'T'HH:mm:ss"), _fraction(milli))
    u = TimeUnits.parse(units)
    length = 365 if kind == "noleap" else 360
    before = MONTH_STARTS[u.month - 1] if kind == "noleap" else (u.month - 1) * 30
    milli = F.round((value.cast("double") * u.scale + ((before + u.day - 1) * 86400 + u.seconds)) * 1000).cast("long")
    total = F.floor(milli / 1000).cast("long")
    days, clock = F.floor(total / 86400).cast("long"), F.pmod(total, F.lit(86400))
    year, of_year = F.floor(days / length).cast("long") + u.year, F.pmod(days, F.lit(length))
    if kind == "noleap":
        month = sum((F.when(of_year >= start, 1).otherwise(0) for start in MONTH_STARTS[1:]), F.lit(1))
        day = of_year - F.element_at(F.array(*map(F.lit, MONTH_STARTS)), month.cast("int")) + 1
    else:
        month, day = F.floor(of_year / 30) + 1, of_year % 30 + 1
    parts = (year, month, day, F.floor(clock / 3600), F.floor(clock % 3600 / 60), clock % 60)
    return F.concat(F.format_string("%d-%02d-%02dT%02d:%02d:%02d", *(p.cast("long") for p in parts)), _fraction(milli))


def _fraction(milli: Column) -> Column:
    part = F.pmod(milli, F.lit(1000))
    return F.when(part == 0, "Z").otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(part.cast("string"), 3, "0"), F.lit("0")), F.lit("Z")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def guess_seconds(value: Column) -> Column:
    """Unix seconds of a bare number, whose size tells nanoseconds, microseconds, milliseconds and seconds apart."""
    v = value.cast("double")
    size = F.abs(v)
    # The bounds of each unit.
    scaled = F.when(size > 1e17, v / 1e9).when(size > 1e14, v / 1e6).when(size > 1e11, v / 1e3).otherwise(v)
    return F.when(F.isnan(v), None).otherwise(F.floor(scaled + 0.5).cast("long"))


def date_bounds(start: str, end: str) -> tuple[str, str]:
    """Both ends of a date range as ISO texts, dates alone widened to whole days, reversed ends swapped."""

    def at(text: str, late: bool) -> datetime:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text.strip()):
            day = datetime.fromisoformat(text.strip()).replace(tzinfo=UTC)
            return day + timedelta(days=1, milliseconds=-1) if late else day
        return parse_instant(text)

    low, high = at(start, False), at(end, True)
    if low > high:
        low, high = at(end, False), at(start, True)
    return low.isoformat(), high.isoformat()


def parse_instant(text: str) -> datetime:
    try:
        out = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        raise ExtractError(f"date {text!r} isn't understood") from None
    return out if out.tzinfo else out.replace(tzinfo=UTC)


def grib_valid_time(reference: Column, unit: Column, offset: Column, interval_end: Column | None = None) -> Column:
    """Valid time: the interval's end where there is one, else reference + offset. Unit codes: 0 min, 1 h, 2 day, 13 s."""
    seconds = F.when(unit == 0, 60).when(unit == 2, 86400).when(unit == 13, 1).otherwise(3600)
    own = F.timestamp_seconds(F.unix_timestamp(reference) + offset * seconds)
    return own if interval_end is None else F.coalesce(interval_end, own)
