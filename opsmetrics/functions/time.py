"""Time functions that never consult the session time zone.

Wall-clock values are ``timestamp_ntz``; a zone is applied by name, explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names as printed by the long date style.
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)
# Seconds per duration unit (a month counts as 30 days).
DURATION_UNITS = {"M": 60, "h": 3600, "d": 86400, "w": 604800, "m": 2592000}
# Fixed values: (period, offset) in minutes of each maintenance schedule.
SCHEDULES = {"min": (30, 2), "ten_min": (120, 13), "hour": (1440, 43)}

ISO_PREFIX = r"^\d{4}-\d\d-\d\dT"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_of(ntz: Column | str) -> Column:
    """Whole epoch seconds of a wall-clock timestamp read as UTC."""
    t = _col(ntz)
    return (
        F.unix_date(t.cast("date")).cast("bigint") * 86400
        + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    )


def ntz_of(epoch: Column | str) -> Column:
    """Wall-clock UTC timestamp of epoch seconds."""
    s = _col(epoch).cast("bigint")
    day = F.floor(s / F.lit(86400)).cast("int")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        day, F.lit(0), F.lit(0), F.pmod(s, F.lit(86400)).cast("decimal(18,6)")
    )


def iso(ntz: Column | str, minutes: bool = False) -> Column:
    """``YYYY-MM-DDThh:mm[:ss]`` of a wall-clock timestamp, fraction dropped."""
    text = F.substring(_col(ntz).cast("string"), 1, 16 if minutes else 19)
    return F.translate(text, " ", "T")


def parse_iso(text: Column | str) -> Column:
    """ISO text to wall clock; an offset or zone suffix is dropped, bad text is null."""
    return F.regexp_extract(_col(text), r"^(\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d)?)", 1).try_cast("timestamp_ntz")


def is_iso(text: Column | str) -> Column:
    """An ISO time stamp that exists; 30 February is none."""
    return _col(text).rlike(ISO_PREFIX) & parse_iso(text).isNotNull()


def _full_year(y: Column) -> Column:
    return F.when(y < 50, y + 2000).when(y <= 99, y + 1900).otherwise(y)


def _hour24(hour: Column, marker: Column) -> Column:
    m = F.lower(marker)
    return (
        F.when((m == "am") & (hour == 12), F.lit(0))
        .when((m == "pm") & (hour != 12), hour + 12)
        .otherwise(hour)
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _fields(text: Column | str) -> Column:
    """The words of a text."""
    return F.split(F.btrim(_col(text), F.lit(" \t\r\n")), r"[ \t]+")


def _three(word: Column, mark: str) -> Column:
    """The whole numbers between two marks; null if there are not three pieces."""
    return let(F.split(word, mark), lambda p: F.when(F.size(p) == 3, F.transform(p, lambda x: x.try_cast("int"))))


def _first_of_three(words: Column, mark: str) -> Column:
    """The first word that marks cut into three."""
    return F.get(F.filter(words, lambda w: F.size(F.split(w, mark)) == 3), 0)


def _marker(word: Column) -> Column:
    """AM or PM, any other word counts as none."""
    return let(F.lower(word), lambda m: F.when(m.isin("am", "pm"), m))


def parse_us(text: Column | str) -> Column:
    """``MM/DD/YY[YY] hh:mm:ss [AM|PM]``; two-digit years below 50 are 20xx."""
    def of(w: Column) -> Column:
        return let(F.concat(_three(F.get(w, 0), "/"), _three(F.get(w, 1), ":")), lambda n: F.try_make_timestamp_ntz(
            _full_year(n[2]), n[0], n[1], _hour24(n[3], _marker(F.get(w, 2))), n[4], n[5]))
    return let(_fields(text), of)


def parse_long(text: Column | str) -> Column:
    """``Tuesday 06 April 2021 12:17:01 IST``; the zone name is dropped."""
    months = F.array(*[F.lit(m) for m in MONTHS])

    def of(w: Column) -> Column:
        return let(F.array_position(months, F.get(w, 2)).cast("int"), lambda month: let(_three(F.get(w, 4), ":"), lambda n: F.try_make_timestamp_ntz(
            _full_year(F.get(w, 3).try_cast("int")), F.when(month > 0, month), F.get(w, 1).try_cast("int"), n[0], n[1], n[2])))
    return let(_fields(text), of)


def parse_us_date(text: Column | str) -> Column:
    """Midnight of the first word like ``MM/DD/YY[YY]``."""
    return parse_us(F.concat(_first_of_three(_fields(text), "/"), F.lit(" 00:00:00")))


def clock_seconds(text: Column | str) -> Column:
    """Seconds into the day of the first word like ``hh:mm:ss``, the last word being AM or PM."""
    def of(w: Column) -> Column:
        return let(_three(_first_of_three(w, ":"), ":"), lambda n: let(_marker(F.element_at(w, -1)), lambda m: F.when(
            m.isNotNull(), _hour24(n[0], m) * 3600 + n[1] * 60 + n[2])))
    return let(_fields(text), of)


def at_clock(midnight: Column, day_offset: Column, seconds: Column) -> Column:
    """Midnight plus whole days plus seconds into the day."""
    return midnight + F.make_dt_interval(
        day_offset.cast("int"), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )


def epoch_in_zone(ntz: Column | str, zone: str) -> Column:
    """Epoch seconds of a wall clock kept in ``zone``; a repeated hour takes its first pass."""
    return epoch_of(F.convert_timezone(F.lit(zone), F.lit("UTC"), _col(ntz)))


def ntz_in_zone(epoch: Column | str, zone: str) -> Column:
    """Wall clock in ``zone`` of epoch seconds."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ntz_of(epoch))


def ts_min_of(epoch: Column | str) -> Column:
    """Whole minutes since the epoch."""
    return F.floor(_col(epoch) / F.lit(60)).cast("bigint")


def minutes_ago(now_epoch: Column | str, n: int | Column) -> Column:
    return ts_min_of(now_epoch) - n


def duration_seconds(text: Column | str) -> Column:
    """Seconds of a duration literal such as ``4d``; null when malformed."""
    t = _col(text)
    unit = F.create_map(*[F.lit(x) for kv in DURATION_UNITS.items() for x in kv])
    return F.regexp_extract(t, r"^(\d+)([Mhdwm])$", 1).try_cast("bigint") * F.try_element_at(
        unit, F.regexp_extract(t, r"^(\d+)([Mhdwm])$", 2)
    )


def next_boundary(epoch: Column | str, period_minutes: int, offset_minutes: int) -> Column:
    """Epoch of the next schedule boundary strictly after ``epoch``.

    Boundaries lie ``offset`` minutes past every multiple of ``period`` minutes.
    """
    period, offset = period_minutes * 60, offset_minutes * 60
    s = _col(epoch).cast("bigint")
    return s + period - F.pmod(s - offset, F.lit(period))


def defer_for_boundary(epoch: Column | str, longest: Column, period_minutes: int, offset_minutes: int) -> Column:
    """True when the next boundary is closer than the longest job seen so far."""
    return (longest > 0) & (next_boundary(epoch, period_minutes, offset_minutes) - _col(epoch) < longest)
