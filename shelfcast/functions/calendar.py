"""Calendar features: month, ISO week, weekday with Monday = 0, and their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label names, Monday first / January first.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]


def day_of_week(date: Column) -> Column:
    # F.weekday is Monday=0..Sunday=6; F.dayofweek would be Sunday=1.
    return F.weekday(date).cast("int")


def week_of_year(date: Column) -> Column:
    return F.weekofyear(date).cast("int")  # ISO-8601 week


def date_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    d = F.col(date_col)
    return df.withColumns({
        "month": F.month(d).cast("int"),
        "week_of_year": week_of_year(d),
        "day_of_week": day_of_week(d),
    })


def day_name(dow: Column) -> Column:
    """Name of an integer weekday (Monday = 0)."""
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), dow.cast("int") + 1)


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), month.cast("int"))
