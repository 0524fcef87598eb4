"""Futures curve: eligible expiries, carry, held-contract returns, root signals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweft.functions.dates import add_business_days
from panelweft.functions.frames import at, clip, positive, ratio, roll, ts_between, ts_prior
from panelweft.operators.temporal import BUCKET_ROWS, attach_asof, sole


def with_last_eligible(metadata: DataFrame, buffer_days: int = 5) -> DataFrame:
    """Cash-settled contracts trade to the last trade date; physical ones to the
    earlier of first notice and last trade, and not at all without a notice date."""
    physical = F.when(
        F.col("first_notice_date").isNotNull(), F.least("first_notice_date", "last_trade_date")
    )
    deadline = F.when(F.coalesce("cash_settled", F.lit(False)), F.col("last_trade_date")).otherwise(physical)
    return metadata.withColumn("last_eligible_date", add_business_days(deadline, -buffer_days))


def contract_curve(daily: DataFrame, metadata: DataFrame, buffer_days: int = 5) -> DataFrame:
    """Front and next contract per date and root, with annualised log carry."""
    m = with_last_eligible(metadata, buffer_days).select("root", "contract", "expiry_date", "last_eligible_date")
    ok = daily.join(sole(m, ["root", "contract"]), ["root", "contract"]).where(
        F.col("expiry_date").isNotNull() & (F.col("settlement") > 0) & (F.col("date") < F.col("last_eligible_date"))
    )
    w = Window.partitionBy("date", "root").orderBy("expiry_date", "contract")
    ok = ok.withColumn("__rank", F.row_number().over(w)).where("__rank <= 2")
    values = ("contract", "settlement", "expiry_date", "volume", "open_interest")
    picks = [
        F.max(F.when(F.col("__rank") == k, F.col(v))).alias(f"{side}_{v}")
        for k, side in ((1, "front"), (2, "next"))
        for v in values
    ]
    curve = ok.groupBy("date", "root").agg(*picks)
    days = F.date_diff("next_expiry_date", "front_expiry_date")
    carry = F.when(
        (F.col("front_settlement") > 0) & (F.col("next_settlement") > 0) & (days > 0),
        F.ln(F.col("front_settlement") / F.col("next_settlement")) * 365.25 / days,
    )
    return curve.withColumns({"tenor_days": days, "carry_annualized": carry})


def held_contract_returns(curve: DataFrame, daily: DataFrame) -> DataFrame:
    """Return of the contract selected at the root's previous curve date."""
    w = Window.partitionBy("root").orderBy("date")
    sel = curve.select("date", "root", "front_contract").withColumns(
        {"held_contract": F.lag("front_contract").over(w), "previous_date": F.lag("date").over(w)}
    )
    price = daily.select("date", "root", F.col("contract").alias("held_contract"), "settlement")
    now = price.withColumnRenamed("settlement", "current_price")
    then = price.select(
        F.col("date").alias("previous_date"), "root", "held_contract", F.col("settlement").alias("previous_price")
    )
    j = sel.join(now, ["date", "root", "held_contract"], "left").join(
        then, ["previous_date", "root", "held_contract"], "left"
    )
    rolled = F.coalesce(F.col("front_contract") != F.col("held_contract"), F.lit(False))
    return j.select(
        "date", "root", "held_contract",
        (ratio(F.col("current_price"), F.col("previous_price")) - 1).alias("excess_return"),
        rolled.alias("roll_trade"),
    )


def root_signals(
    panel: DataFrame,
    horizons=((63, 0.25), (126, 0.35), (252, 0.40)),
    skip: int = 21,
    vol: tuple[int, int] = (60, 40),
    carry: tuple[int, int] = (252, 126),
    periods: float = 252.0,
    minimum=None,
) -> DataFrame:
    """Skipped trend over floored prior volatility and prior z-score of carry.

    ``panel``: root, session_idx, excess_return, carry_annualized. ``minimum``
    maps a horizon to the observations it needs (all of them by default).
    """
    by = ("root",)
    panel = panel.withColumn("__lr", F.log1p("excess_return"))
    trend = None
    for h, weight in horizons:
        n = h - skip
        k = (minimum or {}).get(h, n)
        part = weight * roll(F.sum, "__lr", ts_between(-(n - 1) - skip, -skip, by), k)
        trend = part if trend is None else trend + part
    pv = roll(F.stddev_samp, "excess_return", ts_prior(vol[0], by), vol[1]) * F.sqrt(F.lit(periods))
    f = ts_prior(carry[0], by)
    mean = roll(F.avg, "carry_annualized", f, carry[1])
    std = roll(F.stddev_pop, "carry_annualized", f, carry[1])
    panel = panel.withColumns({"__trend": trend, "prior_volatility": pv})
    score = ratio(F.col("__trend"), F.greatest("prior_volatility", F.lit(0.08)))
    return panel.withColumns(
        {
            "trend_score": F.when(F.col("prior_volatility").isNotNull(), score),
            "carry_score": clip(ratio(F.col("carry_annualized") - mean, positive(std)), -5.0, 5.0),
        }
    ).drop("__lr", "__trend")


# Statistic type codes.
STAT_NAMES = {
    1: "official_open",
    3: "settlement",
    4: "official_low",
    5: "official_high",
    6: "cleared_volume",
    9: "open_interest",
}


def normalise_messages(
    definitions: DataFrame, bars: DataFrame, statistics: DataFrame, notices: DataFrame | None,
    cash_roots: tuple[str, ...], sleeves: Mapping[str, str] | None = None, rows: int = BUCKET_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Definitions, bars and typed statistics of all roots -> daily, metadata, history.

    Definitions carry ``root``; contracts are unique across roots. ``sleeves`` names the sleeve of each root. Messages meet
    the definition that held then in parts of about ``rows`` messages of an instrument, so a crowded day is several parts.
    """
    d = definitions.where(F.upper("instrument_class").isin("F", "FUTURE", "INSTRUMENTCLASS.FUTURE"))
    unit = F.when(F.col("unit_of_measure_qty") > 0, F.col("unit_of_measure_qty"))
    d = d.select(
        F.col("ts_recv").alias("definition_time"), "root", F.col("raw_symbol").alias("contract"), "instrument_id",
        "security_update_action", "exchange", "currency",
        F.coalesce(unit, F.col("contract_multiplier")).alias("multiplier"),
        F.col("min_price_increment").alias("tick_size"),
        F.to_date("expiration").alias("expiry_date"),
        F.to_date("expiration").alias("last_trade_date"),
        F.col("root").isin(*cash_roots).alias("cash_settled"),
    )
    if notices is not None:
        d = d.join(notices.select("contract", "first_notice_date"), "contract", "left")
    else:
        d = d.withColumn("first_notice_date", F.lit(None).cast("date"))
    named = d.select("instrument_id", "definition_time", "contract", "root")
    ties = ("contract",)
    b = attach_asof(bars, named, "instrument_id", "ts_event", "definition_time", ["contract", "root"], None, ties, rows)
    s = attach_asof(statistics, named, "instrument_id", "ts_recv", "definition_time", ["contract", "root"], None, ties, rows)
    b = b.where(F.col("contract").isNotNull()).groupBy(F.to_date("ts_event").alias("date"), "root", "contract").agg(
        F.max_by(F.struct("open", "high", "low", F.col("volume").alias("bar_volume")), F.struct("ts_event", "instrument_id")).alias("__b")
    ).select("date", "root", "contract", "__b.*")
    amount = F.when(F.col("stat_type").isin(6, 9), F.col("quantity").cast("double")).otherwise(F.col("price"))
    s = s.where(F.col("contract").isNotNull() & F.col("ts_ref").isNotNull()).withColumn("__amount", amount)
    # last statistic per (date, contract, type) wins: one conditional max_by each
    wide = s.groupBy(F.to_date("ts_ref").alias("date"), "root", "contract").agg(
        *[
            F.max_by(
                F.when(F.col("stat_type") == code, F.struct(F.col("__amount").alias("v"))),
                F.when(F.col("stat_type") == code, F.struct("ts_recv", "instrument_id", "__amount")),
            )["v"].alias(name)
            for code, name in STAT_NAMES.items()
        ]
    )
    daily = b.join(wide, ["date", "root", "contract"]).select(
        "date", "root", "contract", "settlement", "open", "high", "low",
        F.coalesce("cleared_volume", F.col("bar_volume").cast("double")).alias("volume"), "open_interest",
    )
    named_sleeves = F.create_map(*(F.lit(x) for pair in sleeves.items() for x in pair))[F.col("root")] if sleeves else F.lit(None).cast("string")
    d = d.withColumn("sleeve", named_sleeves)
    cols = ["sleeve", "exchange", "currency", "multiplier", "tick_size", "expiry_date", "first_notice_date", "last_trade_date", "cash_settled"]
    metadata = d.groupBy("root", "contract").agg(
        F.max_by(F.struct(*cols), F.struct("definition_time", "instrument_id")).alias("__m")
    ).select("root", "contract", "__m.*")
    history = d.select(
        "definition_time", "root", "contract", "instrument_id", "security_update_action", "exchange", "currency",
        "multiplier", "tick_size", "expiry_date", "last_trade_date",
    )
    return daily, metadata, history
