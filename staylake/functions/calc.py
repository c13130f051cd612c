"""Column expressions shared by the operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

MONEY = "decimal(18,2)"
WIDE = "decimal(38,2)"

# Billing and hourly rules of the booking model.
BREAKFAST_PRICE = 150000
EARLY_HOUR = 14
ADULT_AGE = 18
PHONE_PATTERN = r"^[0-9]{9,11}$"
BILLED_STATES = ["Completed", "Checked-in"]
OPEN_STATES = ["Active", "Checked-in"]
HOLDING_STATES = ["Pending", "Active", "Checked-in"]
INVOICEABLE_STATES = ["Active", "Checked-in", "Completed"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    return col(c).cast(MONEY)


def wide(c) -> Column:
    """Sums over many bookings."""
    return col(c).cast(WIDE)


def nights(check_in="check_in", check_out="check_out") -> Column:
    """Billed nights: calendar days between the two dates, at least one."""
    return F.greatest(F.datediff(F.to_date(col(check_out)), F.to_date(col(check_in))), F.lit(1))


def held_nights(check_in="check_in", check_out="check_out") -> Column:
    """The dates that take inventory: [check_in date, check_out date). A same-day stay holds none."""
    a, b = F.to_date(col(check_in)), F.to_date(col(check_out))
    return F.when(a < b, F.sequence(a, F.date_sub(b, 1))).otherwise(F.array().cast("array<date>"))


def touched_days(check_in="check_in", check_out="check_out") -> Column:
    """Every calendar date a stay reaches, both ends included."""
    a, b = F.to_date(col(check_in)), F.to_date(col(check_out))
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<date>"))


def second_of_day(ts) -> Column:
    ts = col(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)


def month_of(ts) -> Column:
    return F.trunc(F.to_date(col(ts)), "month")


def timestamp(value) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(str(value)).cast("timestamp_ntz")


def as_date(as_of) -> dt.date:
    if isinstance(as_of, dt.datetime):
        return as_of.date()
    return as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(str(as_of)[:10])


def calendar_age(born, as_of) -> Column:
    """Full years by calendar, so a 29 February birth counts from 1 March in short years."""
    d, born = as_date(as_of), col(born)
    before_birthday = (F.month(born) * 100 + F.dayofmonth(born)) > (d.month * 100 + d.day)
    return F.lit(d.year) - F.year(born) - before_birthday.cast("int")


def percent(part, whole, scale: int) -> Column:
    """part * 100 / whole rounded half up, 0 when whole is 0; decimal all the way."""
    part, whole = col(part), col(whole)
    rate = F.round((part * 100).cast("decimal(18,4)") / F.when(whole != 0, whole).cast("decimal(18,0)"), scale)
    return F.coalesce(rate, F.lit(0)).cast(f"decimal(18,{scale})")


def period_bounds(period: str, as_of) -> tuple[dt.date, dt.date] | None:
    """[start, end) of a reporting period, None for all time and for unknown names."""
    if period not in ("this_month", "last_month", "this_quarter"):
        return None
    d = as_date(as_of)

    def first_of(y: int, m: int) -> dt.date:
        return dt.date(y + (m - 1) // 12, (m - 1) % 12 + 1, 1)

    quarter = 3 * ((d.month - 1) // 3) + 1
    return {
        "this_month": (first_of(d.year, d.month), first_of(d.year, d.month + 1)),
        "last_month": (first_of(d.year, d.month - 1), first_of(d.year, d.month)),
        "this_quarter": (first_of(d.year, quarter), first_of(d.year, quarter + 3)),
    }[period]


def in_period(c, period: str, as_of) -> Column:
    """Range form of the period test, which Parquet can prune by; no function wraps the column."""
    bounds = period_bounds(period, as_of)
    if bounds is None:
        return F.lit(True)
    return (col(c) >= F.lit(bounds[0])) & (col(c) < F.lit(bounds[1]))


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """Two half-open intervals share an instant."""
    return (col(a_start) < col(b_end)) & (col(b_start) < col(a_end))


def live(flag="is_cancelled") -> Column:
    """Rows of room_assignments that are not cancelled; a missing flag means not cancelled."""
    return ~F.coalesce(col(flag), F.lit(False))


