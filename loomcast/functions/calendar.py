"""Calendar arithmetic: a period is a whole number, so no window is needed to number rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STEPS = ("year", "month", "day", "hour")


def position(t: Column | str, step: str) -> Column:
    """Number of the calendar period that holds ``t`` (consecutive periods differ by 1)."""
    t = F.col(t) if isinstance(t, str) else t
    if step == "year":
        pos = F.year(t)
    elif step == "month":
        pos = F.year(t) * 12 + F.month(t) - 1
    elif step == "day":
        pos = F.unix_date(F.to_date(t))
    elif step == "hour":
        pos = F.unix_date(F.to_date(t)).cast("bigint") * 24 + F.hour(t)
    else:
        raise ValueError(f"step must be one of {STEPS}, not {step!r}")
    return pos.cast("bigint")


def period_start(pos: Column | str, step: str) -> Column:
    """First instant of a period as DATE (year, month, day) or TIMESTAMP_NTZ (hour)."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    if step == "year":
        return F.make_date(pos.cast("int"), F.lit(1), F.lit(1))
    if step == "month":
        return F.make_date(
            F.floor(pos / 12).cast("int"), (F.pmod(pos, F.lit(12)) + 1).cast("int"), F.lit(1)
        )
    if step == "day":
        return F.date_from_unix_date(pos.cast("int"))
    if step == "hour":
        day = F.date_from_unix_date(F.floor(pos / 24).cast("int"))
        return F.to_timestamp_ntz(
            F.concat(day.cast("string"), F.lit(" "),
                     F.lpad(F.pmod(pos, F.lit(24)).cast("string"), 2, "0"), F.lit(":00:00"))
        )
    raise ValueError(f"step must be one of {STEPS}, not {step!r}")


def month_year_date(month: Column | str, year: Column | str) -> Column:
    """Text month (no zero pad) + text year -> first day of the month."""
    month = F.col(month) if isinstance(month, str) else month
    year = F.col(year) if isinstance(year, str) else year
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


# English month names to month numbers.
MONTHS = {
    "January": 1, "February": 2, "March": 3, "April": 4, "May": 5, "June": 6,
    "July": 7, "August": 8, "September": 9, "October": 10, "November": 11, "December": 12,
}


def month_number(name: Column | str) -> Column:
    """Month name -> month number, as a map literal instead of a join."""
    name = F.col(name) if isinstance(name, str) else name
    pairs = [F.lit(x) for item in MONTHS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.trim(name))
