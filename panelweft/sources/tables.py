"""Panels derived from the star-schema tables.

Suppliers stand for securities, weeks for sessions: a 26-week volume-weighted
price is the close, weekly quantity the volume, the supplier's region the sector.
Sums are taken over integer units, so they do not depend on row order.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweft.functions.dates import BROADCAST_ROWS
from panelweft.functions.frames import at, ratio, ts, ts_between
from panelweft.session import cut

# A cross-section up to this many names is handled by one window task.
WIDE_NAMES = 1_000_000


@dataclass(frozen=True)
class Shape:
    """Measured bounds of a panel: names per session and the calendar's ends."""

    names: int
    first: date
    last: date

    @property
    def sessions(self) -> int:
        return (self.last - self.first).days // 7 + 1

    @property
    def wide(self) -> bool:
        return self.names > WIDE_NAMES


_measured: dict[tuple, object] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _once(spark: SparkSession, sf: str, what: str, measure):
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _measured:
        _measured[key] = measure()
    return _measured[key]


def row_count(spark: SparkSession, sf: str, name: str) -> int:
    """Rows of a table, read from the file footers; measured once per session."""
    return _once(spark, sf, f"count {name}", lambda: table(spark, sf, name).count())


def shape(spark: SparkSession, sf: str) -> Shape:
    """Names are bounded by the supplier dimension (a footer count), the calendar
    by the date range of the fact table (a one-column scan); measured once."""

    def measure():
        lo, hi = (
            table(spark, sf, "lineitem")
            .agg(F.min("l_shipdate").cast("date"), F.max("l_shipdate").cast("date"))
            .first()
        )
        monday = [d - timedelta(days=d.weekday()) for d in (lo, hi)]
        return Shape(row_count(spark, sf, "supplier"), *monday)

    return _once(spark, sf, "shape", measure)


def attach(df: DataFrame, series: DataFrame, on, rows: int, how: str = "left") -> DataFrame:
    """Join a session-level table; broadcast only when its row bound allows it,
    otherwise a shuffled join that adaptive execution may split on skew."""
    side = F.broadcast(series) if rows <= BROADCAST_ROWS else series
    return df.join(side, on, how)


def on_calendar(df: DataFrame, sessions: int, by=("security_id",)) -> DataFrame:
    """One row per key and calendar session; a key expands on its own, no pairing."""
    grid = df.select(*by).distinct().withColumn(
        "session_idx", F.explode(F.sequence(F.lit(0), F.lit(sessions - 1)))
    )
    return grid.join(df, [*by, "session_idx"], "left")


def _week(c: str):
    return F.to_date(F.date_trunc("week", F.col(c)))


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly sessions between the first and the last shipment."""
    sh = shape(spark, sf)
    return (
        spark.range(0, sh.sessions, 1, 1)
        .select(F.col("id").cast("int").alias("session_idx"))
        .withColumn("session", F.date_add(F.lit(sh.first), F.col("session_idx") * 7))
    )


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Integer quantity and cents per supplier and week (partial sums first)."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias("security_id"), _week("l_shipdate").alias("session"))
        .agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("q"),
            F.sum(F.rint(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
        )
    )


def _closes(spark: SparkSession, sf: str) -> DataFrame:
    """security_id, session_idx, close, volume, ret. Nearly every panel reads them several times: frozen once a session,
    in parts by security."""

    def measure():
        first = F.lit(shape(spark, sf).first)
        w = weekly(spark, sf).withColumn("session_idx", (F.date_diff("session", first) / 7).cast("int"))
        year = ts(26)
        w = w.withColumn("close", ratio(F.sum("cents").over(year) / F.lit(100.0), F.sum("q").over(year).cast("double")))
        ret = ratio(F.col("close"), at("close", -1)) - 1
        return cut(w.select("security_id", "session_idx", "close", F.col("q").cast("double").alias("volume"), ret.alias("ret")))

    return _once(spark, sf, "closes", measure)


def _ohlc(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    month = ts_between(-3, 0)
    return _closes(spark, sf).select(
        "security_id",
        F.date_add(F.lit(shape(spark, sf).first), F.col("session_idx") * 7).alias("session"),
        "session_idx",
        F.first("close").over(month).alias("open"),
        F.max("close").over(month).alias("high"),
        F.min("close").over(month).alias("low"),
        "close",
        "volume",
        *more,
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """security_id, session, session_idx, open, high, low, close, volume."""
    return _ohlc(spark, sf)


def assets(spark: SparkSession, sf: str) -> DataFrame:
    """security_id, sector (region), sleeve (nation)."""
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").cast("string").alias("security_id"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("sleeve"),
        )
    )


def priced(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with the simple return over one session."""
    return _ohlc(spark, sf, "ret")


def returns(spark: SparkSession, sf: str) -> DataFrame:
    """Priced bars with sector and sleeve."""
    return priced(spark, sf).join(assets(spark, sf), "security_id", "left")


def market_series(r: DataFrame) -> DataFrame:
    """Volume-weighted mean return per session."""
    return r.where(F.col("ret").isNotNull()).groupBy("session_idx").agg(
        ratio(F.sum(F.col("ret") * F.col("volume")), F.sum("volume")).alias("market")
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Returns plus the market return of the session."""
    series = market_series(priced(spark, sf))
    return attach(returns(spark, sf), series, "session_idx", shape(spark, sf).sessions)


def research_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Panel with market moments, prior volatility and eligibility.

    26-week windows with at least 13 observations; eligible once 26 earlier
    returns exist and the current one is present.
    """
    from pyspark.sql import Window

    from panelweft.operators.features import market_moments, with_daily_vol

    r = returns(spark, sf)
    series = market_moments(market_series(priced(spark, sf)), 26, 13)
    past = (
        Window.partitionBy("security_id")
        .orderBy("session_idx")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    r = with_daily_vol(r, 26, 13).withColumn(
        "eligible", F.col("ret").isNotNull() & (F.count("ret").over(past) >= 26)
    )
    return attach(r, series, "session_idx", shape(spark, sf).sessions)


def residual_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Research panel with prior beta and the peer-adjusted residual return."""
    from panelweft.operators.features import residual_returns

    return residual_returns(research_panel(spark, sf), 26, 13, 2, shape(spark, sf).wide)
