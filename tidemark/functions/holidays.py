"""US federal holidays by rule, with the observed weekday of fixed dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values: (name, month, day, first year).
FIXED_DATES = (
    ("New Year's Day", 1, 1, 1871),
    ("Juneteenth National Independence Day", 6, 19, 2021),
    ("Independence Day", 7, 4, 1871),
    ("Veterans Day", 11, 11, 1938),
    ("Christmas Day", 12, 25, 1871),
)
# Fixed values: (name, month, weekday, n-th; -1 is the last, first year).
MOVABLE_DATES = (
    ("Martin Luther King Jr. Day", 1, "MON", 3, 1986),
    ("Washington's Birthday", 2, "MON", 3, 1971),
    ("Memorial Day", 5, "MON", -1, 1971),
    ("Labor Day", 9, "MON", 1, 1894),
    ("Columbus Day", 10, "MON", 2, 1971),
    ("Thanksgiving", 11, "THU", 4, 1942),
)
SATURDAY, SUNDAY = 5, 6


def nth_weekday(year: Column, month: int, weekday: str, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        return F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (n - 1))
    return F.next_day(F.date_sub(F.last_day(first), 7), weekday)


def observed(day: Column) -> Column:
    """Saturday moves to Friday, Sunday to Monday."""
    return (
        F.when(F.weekday(day) == SATURDAY, F.date_sub(day, 1))
        .when(F.weekday(day) == SUNDAY, F.date_add(day, 1))
        .otherwise(day)
    )


def holidays(years: DataFrame) -> DataFrame:
    """``year, holiday, ds`` from a table of years; about a dozen rows a year.

    A fixed date on a weekend contributes both its own and its observed day.
    """
    y = F.col("year")
    days = [
        (name, F.make_date(y, F.lit(m), F.lit(d)), since) for name, m, d, since in FIXED_DATES
    ]
    rows = [F.struct(F.lit(n).alias("holiday"), d.alias("ds"), F.lit(s).alias("since")) for n, d, s in days]
    rows += [
        F.struct(F.lit(f"{n} (observed)").alias("holiday"), observed(d).alias("ds"), F.lit(s).alias("since"))
        for n, d, s in days
    ]
    rows += [
        F.struct(F.lit(n).alias("holiday"), nth_weekday(y, m, w, k).alias("ds"), F.lit(s).alias("since"))
        for n, m, w, k, s in MOVABLE_DATES
    ]
    return (
        years.select("year", F.inline(F.array(*rows)))
        .filter(F.col("year") >= F.col("since"))
        .groupBy("year", "ds")
        .agg(F.min("holiday").alias("holiday"))
        .select("year", "holiday", "ds")
    )


def year_range(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
