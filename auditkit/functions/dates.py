"""Month-date text and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_FORMAT = "MMM-yyyy"


def month_date(text: Column) -> Column:
    """``"Dec-2015"`` as a date; text in any other form becomes null."""
    return F.to_date(F.try_to_timestamp(text, F.lit(MONTH_FORMAT)))


def months_between_parts(later: Column, earlier: Column) -> Column:
    """Whole months from year and month parts; days do not count."""
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))
