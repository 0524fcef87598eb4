"""Weekday arithmetic and calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Calendar-bounded tables up to this many rows may be broadcast.
BROADCAST_ROWS = 200_000


def add_business_days(day: Column, n: int) -> Column:
    """Weekdays only, holidays ignored; +1 from a weekend lands on Monday and -1
    on Friday."""
    dow = F.weekday(day)  # Monday = 0
    if n >= 0:
        # a weekend start counts as the Friday before it
        base = F.date_sub(day, F.greatest(dow - 4, F.lit(0)))
        pos = F.least(dow, F.lit(4)) + n
        return F.date_add(base, (n + 2 * F.floor(pos / 5)).cast("int"))
    m = -n
    # a weekend start counts as the Monday after it
    base = F.when(dow > 4, F.date_add(day, 7 - dow)).otherwise(day)
    pos = F.when(dow > 4, F.lit(0)).otherwise(dow)
    back = m + 2 * F.ceil((m - pos) / 5)
    return F.date_sub(base, F.when(m > pos, back).otherwise(F.lit(m)).cast("int"))


def index_sessions(calendar: DataFrame) -> DataFrame:
    """Number an explicit calendar; the only place where row offsets are made.

    One window without a partition key: a calendar is a few thousand rows.
    """
    return calendar.withColumn(
        "session_idx", (F.row_number().over(Window.orderBy("session")) - 1).cast("int")
    )


def month_end_schedule(calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Last session of each month in range; ``complete`` is false where the
    calendar does not reach into the following month."""
    last_known = calendar.agg(F.max("session")).scalar()
    months = (
        calendar.where((F.col("session") >= F.to_date(F.lit(start))))
        .where(F.col("session") <= F.to_date(F.lit(end)))
        .groupBy(F.trunc("session", "month").alias("month"))
        .agg(F.max("session").alias("month_end"), F.count("*").alias("sessions"))
    )
    return months.select(
        "month",
        "month_end",
        "sessions",
        (last_known > F.last_day("month")).alias("complete"),
    )
