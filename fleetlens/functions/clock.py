"""Time: epochs, local wall clock, timetable text.

Local time is a zone-less timestamp obtained with ``convert_timezone`` so results do not
depend on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# City time zone; epochs at or below this are synthetic clocks.
CITY_ZONE = "Europe/Warsaw"
REAL_CLOCK_MIN = 100_000_000

_EPOCH0 = "timestamp_ntz'1970-01-01 00:00:00'"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_to_utc(col: Column | str) -> Column:
    """Epoch seconds to a zone-less UTC timestamp."""
    return F.timestamp_add("SECOND", _c(col).cast("long"), F.expr(_EPOCH0))


def utc_to_epoch(col: Column | str) -> Column:
    return F.timestamp_diff("SECOND", F.expr(_EPOCH0), _c(col))


def epoch_to_local(col: Column | str, zone: str = CITY_ZONE) -> Column:
    """Wall clock of an epoch second. Shifted as an instant, which takes a third of the time of a zone conversion of wall clocks and depends on no session zone either."""
    wall = F.from_utc_timestamp(F.timestamp_seconds(_c(col).cast("long")), zone)
    return epoch_to_utc(F.unix_seconds(wall))


def local_to_epoch(col: Column | str, zone: str = CITY_ZONE) -> Column:
    """Wall clock to epoch seconds; an ambiguous hour takes the earlier instant."""
    return utc_to_epoch(F.convert_timezone(F.lit(zone), F.lit("UTC"), _c(col)))


def hour_bucket(ts: Column) -> Column:
    """Start of the hour of a zone-less timestamp, still zone-less."""
    return F.timestamp_add("HOUR", F.hour(ts).cast("long"), F.to_date(ts).cast("timestamp_ntz"))


def day_text(ts: Column) -> Column:
    return F.to_date(ts).cast("string")


def weekday_sunday0(ts: Column) -> Column:
    return F.dayofweek(ts) - 1


def parse_local_text(text: Column | str, tick_ts: Column | str, zone: str = CITY_ZONE) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` local text to epoch; in the repeated autumn hour the candidate
    nearer to the capture tick wins; unreadable text falls back to the tick."""
    tick = _c(tick_ts).cast("long")
    ok = F.trim(_c(text)).rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$")
    wall = F.when(ok, F.trim(_c(text)).try_cast("timestamp_ntz"))
    first = local_to_epoch(wall, zone)
    second = first + 3600
    repeated = (epoch_to_local(second, zone) == wall) & (tick > REAL_CLOCK_MIN)
    later = F.abs(second - tick) < F.abs(first - tick)
    return F.when(wall.isNull(), tick).when(repeated & later, second).otherwise(first)


def _clock_part(text: Column, i: int) -> Column:
    return F.get(F.split(F.trim(text), ":"), F.lit(i)).try_cast("int")


def timetable_seconds(text: Column | str, bad: int | None = 0) -> Column:
    """``HH:MM:SS`` (hours may pass 24) to seconds; malformed text gives ``bad``."""
    t = _c(text)
    secs = _clock_part(t, 0) * 3600 + _clock_part(t, 1) * 60 + _clock_part(t, 2)
    well_formed = F.size(F.split(F.trim(t), ":")) == 3
    return F.coalesce(F.when(well_formed, secs), F.lit(bad).cast("int"))


def timetable_epoch(day: Column | str, text: Column | str, zone: str = CITY_ZONE) -> Column:
    """Service day plus ``HH:MM:SS`` as a wall-clock time (hour mod 24, whole days added) in
    epoch seconds; anything unreadable gives 0."""
    t = _c(text)
    h, m, s = (_clock_part(t, i) for i in range(3))
    date = _c(day).try_cast("date")
    valid = h.isNotNull() & (h >= 0) & m.between(0, 59) & s.between(0, 59) & date.isNotNull()
    whole_days = F.floor(h / F.lit(24)).cast("int")
    midnight = F.date_add(date, whole_days).cast("timestamp_ntz")
    wall = F.timestamp_add("SECOND", ((h % 24) * 3600 + m * 60 + s).cast("long"), midnight)
    return F.coalesce(F.when(valid, local_to_epoch(wall, zone)), F.lit(0).cast("long"))


def next_grid_tick(now: Column | str, period: int) -> Column:
    """First multiple of ``period`` strictly after ``now``."""
    return ((F.floor(_c(now) / F.lit(period)) + 1) * period).cast("long")


def repair_clock_fold(gps: Column | str, tick: Column | str) -> Column:
    """Add the lost hour to a fix whose onboard clock is about one hour behind its tick."""
    g, t = _c(gps), _c(tick)
    return F.when((t > REAL_CLOCK_MIN) & (t - g).between(3400, 3800), g + 3600).otherwise(g)


def clock_is_fresh(gps: Column | str, tick: Column | str, late: int = 300, early: int = 120) -> Column:
    """True unless the fix is over ``late`` s behind or over ``early`` s ahead of its tick."""
    g, t = _c(gps), _c(tick)
    return (t <= REAL_CLOCK_MIN) | ((t - g <= late) & (g - t <= early))
