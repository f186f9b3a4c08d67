"""Season calendar expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def thanksgiving(year: Column) -> Column:
    """Fourth Thursday of November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "THU"), 21)


def week_number(day: Column, first_day: Column, extra: int = 1) -> Column:
    return (F.floor(F.datediff(day, first_day) / 7) + extra).cast("int")


def season_of(day: Column, first_month: int = 5) -> Column:
    return F.when(F.month(day) < first_month, F.year(day) - 1).otherwise(F.year(day))


def is_thursday(day: Column, holidays: list[Column] | None = None) -> Column:
    """Thursday that is none of the holidays."""
    out = F.weekday(day) == 3
    for h in holidays or []:
        out = out & ~F.coalesce(day == h, F.lit(False))
    return out


def clock_label(ts: Column, zone: str = "America/New_York") -> Column:
    return F.lower(F.date_format(F.from_utc_timestamp(ts, zone), "hh:mm a"))


def safe_date(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Parse; what does not parse becomes null."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")


def start_of_day(ts: Column) -> Column:
    return F.date_trunc("day", ts)
