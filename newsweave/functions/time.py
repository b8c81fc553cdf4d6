"""Time scalars: digest slots, epoch conversion, display formats.

The four daily slots are 21-07, 07-12, 12-17 and 17-21; the night slot belongs
to the *later* calendar date. Slots are half-open, so every instant falls in
exactly one ``(digest_date, part)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Slot start hours for parts 1..4 (part 1 starts on the previous day).
SLOT_START_HOURS = {1: 21, 2: 7, 3: 12, 4: 17}
SLOT_END_HOURS = {1: 7, 2: 12, 3: 17, 4: 21}
# Shift that moves the night slot onto the next date: 24 - 21 hours.
NIGHT_SHIFT_HOURS = 3
# Greeting word per part (part 0 = whole day has none).
PART_GREETING = {1: "morning", 2: "daytime", 3: "evening", 4: "night"}
# Earliest date a digest may be asked for.
FIRST_DIGEST_DATE = "2022-06-28"
# Display formats.
DISPLAY_DATE = "dd MMMM yyyy"
DISPLAY_DATE_TIME = "dd MMMM yyyy - HH:mm:ss"
# ----------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digest_date(ts: Column | str) -> Column:
    """Calendar date of the slot (night slot moves to the next date)."""
    return F.to_date(_c(ts) + F.expr(f"INTERVAL {NIGHT_SHIFT_HOURS} HOURS"))


def slot_part(ts: Column | str) -> Column:
    """Part 1..4 from the hour of day."""
    h = F.hour(_c(ts))
    return (F.when((h >= SLOT_START_HOURS[1]) | (h < SLOT_END_HOURS[1]), F.lit(1))
            .when(h < SLOT_END_HOURS[2], F.lit(2))
            .when(h < SLOT_END_HOURS[3], F.lit(3))
            .otherwise(F.lit(4)))


def slot_bounds(date: Column | str, part: Column | str) -> tuple[Column, Column]:
    """Half-open ``[start, end)`` of a slot. Part 0 is the calendar
    day; part 1 starts at 21:00 of the previous day."""
    d = _c(date).cast("date")
    p = _c(part)
    day_start = d.cast("timestamp_ntz")

    def at(day: Column, hour: int) -> Column:
        return day.cast("timestamp_ntz") + F.make_interval(hours=F.lit(hour))

    start = (F.when(p == 0, day_start)
             .when(p == 1, at(F.date_sub(d, 1), SLOT_START_HOURS[1]))
             .when(p == 2, at(d, SLOT_START_HOURS[2]))
             .when(p == 3, at(d, SLOT_START_HOURS[3]))
             .when(p == 4, at(d, SLOT_START_HOURS[4])))
    end = (F.when(p == 0, F.date_add(d, 1).cast("timestamp_ntz"))
           .when(p == 1, at(d, SLOT_END_HOURS[1]))
           .when(p == 2, at(d, SLOT_END_HOURS[2]))
           .when(p == 3, at(d, SLOT_END_HOURS[3]))
           .when(p == 4, at(d, SLOT_END_HOURS[4])))
    return start, end


EPOCH = "1970-01-01 00:00:00"


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since the epoch of a UTC wall-clock ``timestamp_ntz``
    (independent of the session time zone)."""
    return F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), _c(ts))


def epoch_to_time(seconds: Column | str, tz: str = "UTC") -> Column:
    """Epoch seconds to wall-clock time in ``tz`` (timestamp without zone;
    independent of the session time zone)."""
    utc = F.timestamp_add("SECOND", _c(seconds), F.lit(EPOCH).cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def parse_date(s: Column | str) -> Column:
    """``%Y-%m-%d`` also accepting unpadded month/day; NULL when invalid."""
    return F.when(_c(s).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(_c(s), "y-M-d"))


def display_date(ts: Column | str) -> Column:
    """``dd Month yyyy - HH:MM:SS``."""
    return F.date_format(_c(ts), DISPLAY_DATE_TIME)


def display_day(d: Column | str) -> Column:
    return F.date_format(_c(d), DISPLAY_DATE)


def cut_fraction(ts: Column | str) -> Column:
    """Drop the fraction of a second."""
    return F.date_trunc("second", _c(ts)).cast("timestamp_ntz")


def part_greeting(part: Column | str) -> Column:
    """Greeting word per part; NULL for the whole-day view."""
    out = F.lit(None).cast("string")
    for p in sorted(PART_GREETING, reverse=True):
        out = F.when(_c(part) == p, F.lit(PART_GREETING[p])).otherwise(out)
    return out


def date_guard(d: Column | str, today: str, first_date: str = FIRST_DIGEST_DATE) -> Column:
    """F8: the date is neither in the future nor before the first digest."""
    return _c(d).between(F.lit(first_date).cast("date"), F.lit(today).cast("date"))
