"""Column expressions for slots, service days, day types and time-of-day windows.

All of them work on TIMESTAMP_NTZ, so no result depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, Clock

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def minutes(n) -> Column:
    """Day-time interval of ``n`` minutes (int or column)."""
    return F.make_dt_interval(F.lit(0), F.lit(0), (n if isinstance(n, Column) else F.lit(int(n))).cast("int"))


def slot_no(ts, clock: Clock = DEFAULT_CLOCK) -> Column:
    """Absolute slot number since 1970, an integer that slot arithmetic can use."""
    ts = _c(ts)
    return (
        F.unix_date(F.to_date(ts)).cast("long") * clock.calendar_slots
        + F.hour(ts) * clock.slots_per_hour
        + F.floor(F.minute(ts) / clock.slot_minutes)
    ).cast("long")


def slot_from_no(n, clock: Clock = DEFAULT_CLOCK) -> Column:
    n = _c(n)
    day = F.date_from_unix_date(F.floor(n / clock.calendar_slots).cast("int")).cast("timestamp_ntz")
    return day + minutes(F.pmod(n, F.lit(clock.calendar_slots)) * clock.slot_minutes)


def slot_floor(ts, clock: Clock = DEFAULT_CLOCK) -> Column:
    ts = _c(ts)
    mins = F.hour(ts) * 60 + F.minute(ts) - F.minute(ts) % clock.slot_minutes
    return F.to_date(ts).cast("timestamp_ntz") + minutes(mins)


def slot_ceil(ts, clock: Clock = DEFAULT_CLOCK) -> Column:
    ts = _c(ts)
    low = slot_floor(ts, clock)
    return F.when(low == ts, low).otherwise(low + minutes(clock.slot_minutes))


def hour_floor(ts) -> Column:
    ts = _c(ts)
    return F.to_date(ts).cast("timestamp_ntz") + minutes(F.hour(ts) * 60)


def service_day(ts, clock: Clock = DEFAULT_CLOCK) -> Column:
    """Date of the service day: early-morning slots belong to the day before."""
    return F.to_date(_c(ts) - minutes(60 * clock.service_start_hour))


def service_minute(ts, clock: Clock = DEFAULT_CLOCK) -> Column:
    """Minutes since the start of service, so that windows may wrap past midnight."""
    ts = _c(ts)
    return F.pmod(F.hour(ts) * 60 + F.minute(ts) - 60 * clock.service_start_hour, F.lit(1440))


def tod(ts, clock: Clock = DEFAULT_CLOCK) -> Column:
    """Position of the slot inside its service day, 0 .. slots_per_day - 1 while in service."""
    return F.floor(service_minute(ts, clock) / clock.slot_minutes).cast("int")


def in_service(ts, clock: Clock = DEFAULT_CLOCK) -> Column:
    return tod(ts, clock) < clock.slots_per_day


def service_running(ts) -> Column:
    """Whether trains run at a minute: the pause is 01:00 up to and including 04:44."""
    ts = _c(ts)
    m = F.hour(ts) * 60 + F.minute(ts)
    return (m < 60) | (m >= 285)


def tod_label(tod_col, clock: Clock = DEFAULT_CLOCK) -> Column:
    """'HH:mm' of a service-day slot position."""
    m = F.pmod(_c(tod_col) * clock.slot_minutes + 60 * clock.service_start_hour, F.lit(1440))
    return F.concat(
        F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0")
    )


def hhmm(ts) -> Column:
    return F.date_format(_c(ts).cast("timestamp_ntz"), "HH:mm")


def day_type(day, clock: Clock = DEFAULT_CLOCK) -> Column:
    """0 weekday, 1 Saturday, 2 Sunday or public holiday."""
    day = _c(day)
    wd = F.weekday(day)
    sunday = wd == 6
    if clock.holidays:
        sunday = sunday | day.cast("string").isin(*clock.holidays)
    return F.when(sunday, F.lit(2)).when(wd == 5, F.lit(1)).otherwise(F.lit(0))


DAY_CLASSES = {"all": (0, 1, 2), "weekday": (0,), "saturday": (1,), "sunday": (2,), "weekend": (1, 2)}


def day_mask(day="day", daytype="daytype", days="all", date_from=None, date_to=None, dates=None) -> Column:
    """Predicate on service days: class of day, date range and explicit dates."""
    if days not in DAY_CLASSES:
        raise ValueError(f"days must be one of {sorted(DAY_CLASSES)}")
    day = _c(day)
    cond = F.lit(True)
    if days != "all":
        cond = cond & _c(daytype).isin(*DAY_CLASSES[days])
    if date_from:
        cond = cond & (day >= F.lit(date_from).cast("date"))
    if date_to:
        cond = cond & (day <= F.lit(date_to).cast("date"))
    if dates:
        cond = cond & day.isin(*[F.lit(d).cast("date") for d in dates])
    return cond


def _minute_of(hhmm_text: str, clock: Clock) -> int:
    h, m = (int(x) for x in hhmm_text.split(":"))
    return (h * 60 + m - 60 * clock.service_start_hour) % 1440


def time_mask(ts, time_from=None, time_to=None, clock: Clock = DEFAULT_CLOCK) -> Column:
    """Half-open time-of-day window in service-day order; it may wrap."""
    a = _minute_of(time_from, clock) if time_from else 0
    b = _minute_of(time_to, clock) if time_to else 1440
    if time_to and b == 0:
        b = 1440
    m = service_minute(ts, clock)
    return ((m >= a) & (m < b)) if a < b else ((m >= a) | (m < b))


def hour_window(ts, hour_from: int = 0, hour_to: int = 24) -> Column:
    """Calendar-hour window [from, to) with the argument check of the tool family."""
    if not 0 <= hour_from < hour_to <= 24:
        raise ValueError("hours must satisfy 0 <= hour_from < hour_to <= 24")
    h = F.hour(_c(ts))
    return (h >= hour_from) & (h < hour_to)


def overlaps(start, end, lo, hi) -> Column:
    """Half-open interval overlap."""
    return (_c(start) < _c(hi)) & (_c(end) > _c(lo))
