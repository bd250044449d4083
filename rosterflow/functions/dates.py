"""Dates kept as ISO strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}$"


def iso_date(column: Column) -> Column:
    """The date that an ISO string holds, else null; one-digit months and days count."""
    return F.when(column.rlike(ISO), column.try_cast("date"))


def age_on(column: Column, today: Column) -> Column:
    """Whole years from the ISO date in ``column`` to ``today``; a 29th of February comes after the 28th."""
    born = iso_date(column)
    before = (F.date_format(today, "MMdd") < F.date_format(born, "MMdd")).cast("int")
    return F.year(today) - F.year(born) - before


def compact_to_iso(column: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; null if it is not eight digits."""
    return F.when(column.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(column, 1, 4), F.substring(column, 5, 2), F.substring(column, 7, 2)))
