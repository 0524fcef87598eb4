"""Session-level regimes and the scalers derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweft.functions.frames import (
    at,
    clip,
    finite,
    median,
    positive,
    quantile,
    ratio,
    roll,
    truth,
    ts,
    ts_prior,
    ts_upto,
)

ALL = ()


def market_level(series: DataFrame, market: str = "market") -> DataFrame:
    """Price level of a session-level return series, starting at one."""
    return series.withColumn(
        "level", F.exp(F.sum(F.log1p(F.coalesce(market, F.lit(0.0)))).over(ts_upto(ALL)))
    )


def realised(series: DataFrame, window: tuple[int, int], periods: float, market: str = "market") -> DataFrame:
    return series.withColumns(
        {
            "realized": roll(F.stddev_samp, market, ts(window[0], ALL), window[1]) * F.sqrt(F.lit(periods)),
            "drawdown": ratio(F.col("level"), F.max("level").over(ts_upto(ALL))) - 1,
        }
    )


def three_step_scaler(series: DataFrame, reference: tuple[int, int]) -> DataFrame:
    """1.0 / 0.7 / 0.4 by realised volatility percentile and drawdown."""
    f = ts_prior(reference[0], ALL)
    s = series.withColumns(
        {
            "p80": roll(quantile(0.80), "realized", f, reference[1]),
            "p95": roll(quantile(0.95), "realized", f, reference[1]),
        }
    )
    moderate = truth(F.col("realized") > F.col("p80")) | truth(F.col("drawdown") <= -0.10)
    stress = truth(F.col("realized") > F.col("p95")) | truth(F.col("drawdown") <= -0.15)
    return s.withColumn("risk_scaler", F.when(stress, 0.4).when(moderate, 0.7).otherwise(1.0))


def train_quantile_scaler(
    series: DataFrame, train_end: int, peak: tuple[int, int],
    levels: Sequence[float] = (-0.10, -0.20), quantiles: Sequence[float] = (0.90, 0.975),
) -> DataFrame:
    """1 / 0.75 / 0.5 from lagged drawdown and train quantiles of lagged volatility."""
    dd = ratio(F.col("level"), roll(F.max, "level", ts(peak[0], ALL), peak[1])) - 1
    s = series.withColumn("__dd", dd)
    s = s.withColumns({"lag_drawdown": at("__dd", -1, ALL), "lag_vol": at("realized", -1, ALL)}).drop("__dd")
    train = F.when(F.col("session_idx") <= train_end, F.col("lag_vol"))
    # one session-level partition, bounded by the calendar
    cuts = [F.percentile(train, F.lit(q)).over(ts_all()) for q in quantiles]
    s = s.withColumns({"__q0": cuts[0], "__q1": cuts[1]})
    moderate = truth(F.col("lag_drawdown") <= levels[0]) | truth(F.col("lag_vol") >= F.col("__q0"))
    extreme = truth(F.col("lag_drawdown") <= levels[1]) | truth(F.col("lag_vol") >= F.col("__q1"))
    return s.withColumn("stress_scaler", F.when(extreme, 0.5).when(moderate, 0.75).otherwise(1.0)).drop("__q0", "__q1")


def ts_all():
    from pyspark.sql import Window

    return Window.partitionBy()


def risk_off_rule(
    series: DataFrame, average: tuple[int, int], change: int, reference: tuple[int, int]
) -> DataFrame:
    """Below the average, falling over a year, and volatile beyond the 70th percentile."""
    s = series.withColumns(
        {
            "average": roll(F.avg, "level", ts(average[0], ALL), average[1]),
            "change": ratio(F.col("level"), at("level", -change, ALL)) - 1,
            "p70": roll(quantile(0.70), "realized", ts_prior(reference[0], ALL), reference[1]),
        }
    )
    off = truth((F.col("level") < F.col("average")) & (F.col("change") < 0) & (F.col("realized") > F.col("p70")))
    return s.withColumn("risk_off", off).withColumn(
        "regime", F.when(F.col("risk_off"), "risk_off").otherwise("risk_on")
    )


def state_cost_multipliers(series: DataFrame, reference: tuple[int, int]) -> DataFrame:
    """Volatility x liquidity x drawdown multipliers for the next session's costs.

    ``liquidity`` is the session's median relative dollar volume.
    """
    vr = ratio(F.col("realized"), positive(roll(median, "realized", ts(reference[0], ALL), reference[1])))
    s = series.withColumn("__vr", vr)
    s = s.withColumns(
        {
            "volatility_ratio": F.coalesce(finite(at("__vr", -1, ALL)), F.lit(1.0)),
            "liquidity_ratio": F.coalesce(finite(at("liquidity", -1, ALL)), F.lit(1.0)),
            "prior_drawdown": F.coalesce(at("drawdown", -1, ALL), F.lit(0.0)),
        }
    ).drop("__vr")
    vol = F.greatest(F.col("volatility_ratio"), F.lit(1.0))
    liq = F.greatest(ratio(F.lit(1.0), F.col("liquidity_ratio")), F.lit(1.0))
    dd = F.when(F.col("prior_drawdown") <= -0.10, 1.5).otherwise(1.0)
    return s.withColumns(
        {
            "transaction_multiplier": clip(vol * liq * dd, 1.0, 4.0),
            "borrow_multiplier": clip(vol * dd, 1.0, 3.0),
        }
    )


def train_cdf(series: DataFrame, value: str, train_end: int, out: str = "percentile") -> DataFrame:
    """Share of train observations at or below each value of the series."""
    train = F.when(F.col("session_idx") <= train_end, F.col(value))
    upto = F.count(train).over(ts_all().orderBy(value))  # peers included
    share = ratio(upto.cast("double"), F.count(train).over(ts_all()).cast("double"))
    return series.withColumn(out, F.when(F.col(value).isNotNull(), share))


def piecewise(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Straight lines through (x, y) knots, flat beyond the outer ones."""
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(knots[-1][1])))


# Fixed values, as (input, output) knots: gross by the train percentile of volatility; per book mode the
# slope on the dispersion percentile, the factor by drawdown and the bounds; residual-volatility multipliers.
STRESS_KNOTS = ((0.80, 1.00), (0.95, 0.50), (0.99, 0.25))
GROSS_MODES = {
    "mild": (((0.0, 0.80), (1.0, 1.10)), ((-0.15, 0.40), (-0.10, 1.00), (-0.05, 0.80)), (0.35, 1.00)),
    "defensive": (((0.0, 0.70), (1.0, 1.00)), ((-0.15, 0.25), (-0.10, 0.90), (-0.05, 0.70)), (0.25, 0.90)),
}
RESIDUAL_VOL_KNOTS = {
    "none": ((0.0, 1.00),),
    "mild": ((0.0, 0.75), (1.0, 1.25)),
    "strong": ((0.0, 0.50), (1.0, 1.50)),
    "capped": ((0.125, 0.70), (0.875, 1.30)),
}


def stress_scalar(p: Column) -> Column:
    """Continuous gross scaler on the train volatility percentile."""
    return piecewise(p, STRESS_KNOTS)


def gross_scalar(percentile: Column, drawdown: Column, mode: str) -> Column:
    """Book size from the dispersion percentile and the prior drawdown; nothing is held while either is unknown."""
    if mode == "none":
        return F.lit(1.0)
    dispersion, drawn, bounds = GROSS_MODES[mode]
    return F.coalesce(clip(piecewise(percentile, dispersion) * piecewise(drawdown, drawn), *bounds), F.lit(0.0))


def residual_vol_multiplier(p: Column, mode: str) -> Column:
    """Size by the cross-sectional percentile (0 to 1) of residual volatility."""
    return piecewise(p, RESIDUAL_VOL_KNOTS[mode]) if mode != "none" else F.lit(1.0)


def short_multiplier(score: Column, risk_off: Column) -> Column:
    """Halve negative scores unless the regime is risk-off."""
    return score * F.when(truth(score < 0) & ~risk_off, 0.5).otherwise(1.0)


def side_scalers(risk_off: Column) -> tuple[Column, Column]:
    """Long and short gross-cap scalers."""
    return F.when(risk_off, 0.50).otherwise(1.0), F.when(risk_off, 1.0).otherwise(0.25)


def adaptive_exposure(signal: Column, risk_off: Column, growth: Column) -> Column:
    """Long only when risk-on; when risk-off shorts halve and growth longs shrink."""
    up = F.greatest(signal, F.lit(0.0))
    down = F.least(signal, F.lit(0.0)) * 0.50
    off = F.when(growth, up * 0.40).otherwise(up) + down
    return F.when(signal.isNotNull(), F.when(risk_off, off).otherwise(up))


def drawdown_label(prior: Column, form: str = "select") -> Column:
    """Drawdown regime; a missing value takes the default in the select form and
    stays missing in the (right-closed) cut form."""
    if form == "select":
        return (
            F.when(truth(prior < -0.10), "stress_below_10pct")
            .when(truth(prior <= -0.05), "correction_5_to_10pct")
            .otherwise("normal_above_5pct")
        )
    return (
        F.when(prior <= -0.15, "stress_below_15pct")
        .when(prior <= -0.05, "drawdown_5_to_15pct")
        .when(prior.isNotNull(), "normal_above_5pct")
    )


def gross_change_class(change: Column) -> Column:
    return F.when(truth(change < -0.10), "deleveraging").when(truth(change > 0.10), "expansion").otherwise("normal")
