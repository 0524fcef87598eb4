"""Causal time-series and cross-sectional features over a long panel.

A panel row is (security_id, session, session_idx, measures...). Every window is
counted in sessions. ``minimum`` is the number of observations a window needs;
left out, the window must be full.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweft.functions.frames import (
    at,
    clip,
    median,
    peer_mean,
    positive,
    quantile,
    ratio,
    roll,
    rolling_quantiles,
    rolling_tails,
    snap,
    truth,
    ts,
    ts_between,
    ts_prior,
    ts_upto,
    xs_quantile,
    xs_rank,
    xs_stats,
    xs_zscores,
)

ALL = ()  # a session-level series: one row per session, bounded by the calendar


# --- returns and rolling statistics -------------------------------------------------


def simple_return(price, sessions: int = 1, by=("security_id",)) -> Column:
    price = F.col(price) if isinstance(price, str) else price
    return ratio(price, at(price, -sessions, by)) - 1


def log_return(price, sessions: int = 1, by=("security_id",)) -> Column:
    price = F.col(price) if isinstance(price, str) else price
    return F.ln(ratio(price, at(price, -sessions, by)))


def rolling_stats(df: DataFrame, value: str, window: int, minimum: int, prior: bool = False) -> DataFrame:
    """mean, sum, deviation (sample and population), variance, median, maximum, count."""
    f = ts_prior(window) if prior else ts(window)
    k = minimum
    return df.withColumns(
        {
            "roll_mean": roll(F.avg, value, f, k),
            "roll_sum": roll(F.sum, value, f, k),
            "roll_std": roll(F.stddev_samp, value, f, k),
            "roll_pop": roll(F.stddev_pop, value, f, k),
            "roll_var": roll(F.var_samp, value, f, k),
            "roll_median": roll(median, value, f, k),
            "roll_p80": roll(quantile(0.8), value, f, k),
            "roll_max": roll(F.max, value, f, k),
            "roll_n": F.count(value).over(f),
        }
    )


def prior_slope(y: str, x: str, window: int, minimum: int, frame=None) -> Column:
    """cov(y, x) / var(x) over sessions before the current one; the covariance
    counts pairs, the variance counts observations of ``x``."""
    f = frame or ts_prior(window)
    pair = F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1)
    cov = F.when(F.count(pair).over(f) >= minimum, F.covar_samp(y, x).over(f))
    var = roll(F.var_samp, x, f, minimum)
    return ratio(cov, positive(var))


def market_moments(series: DataFrame, window: int, minimum: int, market: str = "market") -> DataFrame:
    """Prior mean and variance of the market series, kept at session level."""
    f = ts_prior(window, ALL)
    return series.withColumns(
        {
            "market_mean": roll(F.avg, market, f, minimum),
            "market_var": roll(F.var_samp, market, f, minimum),
        }
    )


def market_beta(window: int, minimum: int, ret: str = "ret", market: str = "market") -> Column:
    """Prior market beta; needs ``market_var`` from :func:`market_moments`."""
    f = ts_prior(window)
    pair = F.when(F.col(ret).isNotNull() & F.col(market).isNotNull(), 1)
    cov = F.when(F.count(pair).over(f) >= minimum, F.covar_samp(ret, market).over(f))
    return ratio(cov, positive(F.col("market_var")))


def market_residual(df: DataFrame, window: int, minimum: int) -> DataFrame:
    """r - mean(r) - beta (m - mean(m)), all parameters from prior sessions."""
    df = df.withColumns(
        {
            "beta": market_beta(window, minimum),
            "ret_mean": roll(F.avg, "ret", ts_prior(window), minimum),
        }
    )
    move = F.col("market") - F.col("market_mean")
    return df.withColumn("market_residual", F.col("ret") - F.col("ret_mean") - F.col("beta") * move)


def sector_factor_residual(
    df: DataFrame, window: int, minimum: int, min_peers: int = 2, wide: bool = False
) -> DataFrame:
    """Second-stage residual on the leave-one-out sector mean of the residuals."""
    eligible = F.when(F.col("eligible"), F.col("market_residual"))
    df = df.withColumn("__m", eligible)
    df = peer_mean(df, "__m", "sector_factor", wide=wide, min_peers=min_peers).drop("__m")
    f = ts_prior(window)
    df = df.withColumns(
        {
            "sector_beta": prior_slope("market_residual", "sector_factor", window, minimum),
            "__fm": roll(F.avg, "sector_factor", f, minimum),
            "__rm": roll(F.avg, "market_residual", f, minimum),
        }
    )
    resid = (
        F.col("market_residual")
        - F.col("__rm")
        - F.col("sector_beta") * (F.col("sector_factor") - F.col("__fm"))
    )
    return df.withColumn("residual", resid).drop("__fm", "__rm")


def residual_returns(df: DataFrame, window: int, minimum: int, min_peers: int = 2, wide: bool = False) -> DataFrame:
    """r - beta m minus the leave-one-out sector mean; ``min_peers`` is count - 1."""
    df = df.withColumn("beta", market_beta(window, minimum))
    df = df.withColumn("__e", F.col("ret") - F.col("beta") * F.col("market"))
    df = peer_mean(df, "__e", "__peer", wide=wide, min_peers=min_peers)
    return df.withColumn("residual", F.col("__e") - F.col("__peer")).drop("__e", "__peer")


def less_peer_mean(df: DataFrame, value: str, out: str, wide: bool = False, group: str = "sector", min_count: int = 3) -> DataFrame:
    """Eligible value minus the leave-one-out mean of its group of three or more."""
    df = df.withColumn("__v", F.when(F.col("eligible"), F.col(value)))
    df = peer_mean(df, "__v", "__p", group=group, wide=wide, min_peers=min_count - 1)
    return df.withColumn(out, F.col("__v") - F.col("__p")).drop("__v", "__p")


# --- score families -------------------------------------------------------------------


def trailing(value, window: int, minimum: int, skip: int = 0) -> Column:
    """Sum of ``window`` sessions ending ``skip`` sessions ago."""
    return roll(F.sum, value, ts_between(-(window - 1) - skip, -skip), minimum)


def candidate_scores(
    df: DataFrame,
    reversals: Sequence[tuple[int, int]] = ((1, 1), (3, 3), (5, 5), (10, 10)),
    momenta: Sequence[tuple[int, int, int]] = ((21, 5, 21), (63, 5, 63), (126, 21, 126), (252, 21, 252)),
    blend: tuple[str, str] = ("reversal_3", "momentum_63_skip_5"),
    wide: bool = False,
) -> DataFrame:
    """Reversal and skipped momentum sums of ``residual`` plus one rank blend."""
    df = df.withColumns(
        {f"reversal_{n}": -trailing("residual", n, k) for n, k in reversals}
        | {f"momentum_{n}_skip_{s}": trailing("residual", n, k, s) for n, s, k in momenta}
    )
    for name in blend:
        df = df.withColumn(name, snap(name, 9))
        df = xs_rank(df, name, f"__{name}", wide=wide)
    total = F.col(f"__{blend[0]}") + F.col(f"__{blend[1]}") - 1
    return df.withColumn("blend", total).drop(*[f"__{n}" for n in blend])


def path_signals(
    df: DataFrame,
    vols: Sequence[tuple[int, int]],
    high: tuple[int, int],
    trends: Sequence[tuple[int, int]],
    moves: Sequence[tuple[int, int]],
    wide: bool = False,
) -> DataFrame:
    """Low volatility, distance to high, trend, efficiency, overnight and intraday."""
    r = F.col("residual")
    cols: dict[str, Column] = {
        f"low_vol_{n}": -roll(F.stddev_samp, r, ts(n), k) for n, k in vols
    }
    cols[f"to_high_{high[0]}"] = ratio(F.col("close"), roll(F.max, "close", ts(high[0]), high[1]))
    for n, k in trends:
        f = ts(n)
        cols[f"trend_{n}"] = ratio(roll(F.avg, r, f, k), positive(roll(F.stddev_samp, r, f, k)))
        cols[f"efficiency_{n}"] = ratio(roll(F.sum, r, f, k), positive(roll(F.sum, F.abs(r), f, k)))
    df = df.withColumns(cols)
    df = df.withColumns(
        {
            "__on": F.ln(ratio(F.col("open"), at("close", -1))),
            "__id": F.ln(ratio(F.col("close"), F.col("open"))),
        }
    )
    more = {}
    for n, k in moves:
        more[f"overnight_{n}"] = roll(F.sum, "__on", ts(n), k)
        more[f"intraday_{n}"] = roll(F.sum, "__id", ts(n), k)
    df = df.withColumns(more).drop("__on", "__id")
    a, b = f"to_high_{high[0]}", f"low_vol_{vols[0][0]}"
    df = df.withColumns({"__a": snap(a, 9), "__b": snap(b, 9)})
    df = xs_rank(xs_rank(df, "__a", "__ra", wide=wide), "__b", "__rb", wide=wide)
    return df.withColumn("blend_high_defensive", F.col("__ra") + F.col("__rb") - 1).drop(
        "__a", "__b", "__ra", "__rb"
    )


def bar_families(
    df: DataFrame,
    reversals: Sequence[tuple[int, int]],
    momenta: Sequence[tuple[int, int, int, int]],
    volume_window: tuple[int, int],
    high_window: tuple[int, int],
) -> tuple[DataFrame, list[str]]:
    """Raw price and volume families. ``momenta``: long, min, short, min."""
    r = F.col("residual")
    lv = F.log1p("volume")
    surprise = lv - roll(median, lv, ts_prior(volume_window[0]), volume_window[1])
    spread = F.col("high") - F.col("low")
    top = roll(F.max, "high", ts(high_window[0]), high_window[1])
    raw = {f"reversal_{n}": -roll(F.sum, r, ts(n), k) for n, k in reversals}
    for n, k, s, sk in momenta:
        raw[f"momentum_{n}_{s}"] = roll(F.sum, r, ts(n), k) - roll(F.sum, r, ts(s), sk)
    raw["gap_reversal"] = -(ratio(F.col("open"), at("close", -1)) - 1)
    raw["intraday_reversal"] = -(ratio(F.col("close"), F.col("open")) - 1)
    raw["close_location"] = ratio(F.col("close") - F.col("low"), positive(spread)) - 0.5
    raw["volume_shock_reversal"] = -r * F.abs(surprise)
    raw[f"high_{high_window[0]}"] = ratio(F.col("close"), positive(top))
    return df.withColumns(raw), list(raw)


def sector_neutral(df: DataFrame, names: Sequence[str], wide: bool = False, group: str = "sector", min_count: int = 3) -> DataFrame:
    """Each family less its sector peers, then standardised in the cross-section.

    All families share two grouping steps, (session, sector) and session, so the
    narrow plan needs one exchange by session and two windows in total.
    """
    df = df.withColumns({n: eligible_only(F.col(n)) for n in names})
    sums = {f"__s_{n}": F.sum(n) for n in names} | {f"__c_{n}": F.count(n) for n in names}
    df = xs_stats(df, ("session_idx", group), wide, **sums)

    def less_peers(n):
        others = F.col(f"__c_{n}") - 1
        enough = F.col(group).isNotNull() & (others >= min_count - 1)
        return F.col(n) - F.when(enough, ratio(F.col(f"__s_{n}") - F.col(n), others.cast("double")))

    df = df.withColumns({n: less_peers(n) for n in names}).drop(*sums)
    return xs_zscores(df, {n: n for n in names}, wide=wide)


def log_moves(horizons: Mapping[int, float] | Sequence[int], skip: int) -> dict[int, Column]:
    """ln price ``skip`` sessions ago minus ln price ``h`` sessions ago."""
    lp = F.ln("close")
    return {h: at(lp, -skip) - at(lp, -h) for h in horizons}


def trend_composite(weights: Mapping[int, float], skip: int, vol: str) -> Column:
    """Volatility-scaled skipped momentum, weighted over horizons."""
    total = None
    for h, move in log_moves(weights, skip).items():
        part = ratio(move, F.col(vol) * F.sqrt(F.lit(float(h - skip)))) * weights[h]
        total = part if total is None else total + part
    return total


def with_daily_vol(df: DataFrame, window: int, minimum: int, out: str = "vol") -> DataFrame:
    return df.withColumn(out, roll(F.stddev_samp, "ret", ts_prior(window), minimum))


def eligible_only(col: Column) -> Column:
    return F.when(F.col("eligible"), col)


def defensive_tsmom(
    df: DataFrame, weights: Mapping[int, float], skip: int, average: tuple[int, int],
    threshold: float = 0.25, periods: float = 252.0,
) -> DataFrame:
    """Trend confirmed by a moving average, dead zone, inverse-volatility sizing."""
    raw = clip(trend_composite(weights, skip, "vol"), -3, 3)
    df = df.withColumns({"raw_signal": raw, "average": roll(F.avg, "close", ts(average[0]), average[1])})
    s, c, a = F.col("raw_signal"), F.col("close"), F.col("average")
    confirmed = truth(((s > 0) & (c > a)) | ((s < 0) & (c < a)))
    kept = F.when(confirmed, s).otherwise(0.0)
    kept = F.when(truth(F.abs(kept) >= threshold), kept).otherwise(0.0)
    annual = F.col("vol") * F.sqrt(F.lit(periods))
    df = df.withColumns({"signal": eligible_only(kept), "annual_vol": annual})
    return df.withColumn("sizing_score", ratio(F.col("signal"), positive(F.col("annual_vol"))))


def fast_overlay(
    df: DataFrame, vol_window: int, reference: tuple[int, int], fast: tuple[int, int],
    slow: tuple[int, int], change: int, periods: float = 252.0,
) -> DataFrame:
    """1 / 0.5 / 0 multiplier from volatility percentile, drawdown and trend."""
    df = df.withColumn(
        "realized", roll(F.stddev_samp, "ret", ts(vol_window[0]), vol_window[1]) * F.sqrt(F.lit(periods))
    )
    f = ts_prior(reference[0])
    df = df.withColumns(
        {
            "p80": roll(quantile(0.80), "realized", f, reference[1]),
            "p95": roll(quantile(0.95), "realized", f, reference[1]),
            "drawdown": ratio(F.col("close"), F.max("close").over(ts_upto())) - 1,
            "__fast": roll(F.avg, "close", ts(fast[0]), fast[1]),
            "__slow": roll(F.avg, "close", ts(slow[0]), slow[1]),
            "__chg": simple_return("close", change),
        }
    )
    moderate = (
        truth(F.col("realized") > F.col("p80"))
        | truth(F.col("drawdown") < -0.10)
        | (truth(F.col("__fast") < F.col("__slow")) & truth(F.col("__chg") < 0))
    )
    extreme = truth(F.col("drawdown") < -0.15) | truth(F.col("realized") > F.col("p95"))
    return df.withColumn(
        "multiplier", F.when(extreme, 0.0).when(moderate, 0.5).otherwise(1.0)
    ).drop("__fast", "__slow", "__chg")


def floored_volatility(df: DataFrame, floor: float, periods: float = 252.0, wide: bool = False) -> DataFrame:
    """Annual volatility, not below ``floor`` nor the session median / 1.5."""
    df = df.withColumn("annual_vol", F.col("vol") * F.sqrt(F.lit(periods)))
    df = xs_quantile(df, "annual_vol", "__med", 0.5, wide=wide)
    eff = F.when(
        F.col("annual_vol").isNotNull(),
        F.greatest(F.col("annual_vol"), F.lit(floor), F.col("__med") / 1.5),
    )
    return df.withColumn("effective_vol", eff).drop("__med")


def asymmetric_tsmom(
    df: DataFrame, weights: Mapping[int, float], skip: int, average: tuple[int, int],
    long_threshold: float = 0.25, short_threshold: float = -0.5,
    min_negative: int = 2, overlay: bool = True, cash_fallback: bool = True,
) -> DataFrame:
    """Separate long and short rules; needs ``multiplier`` and ``effective_vol``."""
    moves = log_moves(weights, skip)
    negative = None
    for m in moves.values():
        one = F.when(truth(m < 0), 1).otherwise(0)
        negative = one if negative is None else negative + one
    df = df.withColumns(
        {
            "composite": clip(trend_composite(weights, skip, "vol"), -3, 3),
            "average": roll(F.avg, "close", ts(average[0]), average[1]),
            "negative_horizons": negative,
        }
    )
    s, c, a = F.col("composite"), F.col("close"), F.col("average")
    df = df.withColumns(
        {
            "long_active": truth((s > long_threshold) & (c > a)) & F.col("eligible"),
            "short_active": truth((s < short_threshold) & (c < a))
            & (F.col("negative_horizons") >= min_negative)
            & F.col("eligible"),
        }
    )
    active = F.col("long_active") | F.col("short_active")
    mult = F.col("multiplier") if overlay else F.lit(1.0)
    signal = eligible_only(F.when(active, s).otherwise(0.0) * mult)
    scaler = F.when(active, mult).otherwise(0.0) if cash_fallback else mult
    df = df.withColumns({"signal": signal, "name_scaler": F.when(F.col("eligible"), scaler).otherwise(0.0)})
    return df.withColumn("sizing_score", ratio(F.col("signal"), positive(F.col("effective_vol"))))


def standardised_tails(
    df: DataFrame, values: Mapping[str, str], window: int, minimum: int, q: float = 0.70, sign: float = 1.0,
    bound: float = 5.0,
) -> DataFrame:
    """Per value (mapped to an output prefix): prior z-score, a prior quantile of
    its size as threshold, and the tanh of values beyond it."""
    df = rolling_tails(df, {v: (f"{p}z_score", f"{p}threshold") for v, p in values.items()}, window, minimum, q, bound)

    def tail(p):
        zc = F.col(f"{p}z_score")
        return eligible_only(F.when(truth(F.abs(zc) > F.col(f"{p}threshold")), F.tanh(zc) * sign).otherwise(0.0))

    return df.withColumns({f"{p}signal": tail(p) for p in values.values()})


def standardised_tail(
    df: DataFrame, value: str, window: int, minimum: int, q: float = 0.70, sign: float = 1.0
) -> DataFrame:
    return standardised_tails(df, {value: ""}, window, minimum, q, sign)


def symmetric_position(z: Column, threshold: Column, trend: Column) -> Column:
    active = truth((F.abs(z) > threshold) & (F.signum(z) == F.signum(trend)))
    return F.when(active, F.tanh(z)).otherwise(0.0)


def symmetric_tsmom(
    df: DataFrame, weights: Mapping[int, float], skip: int, window: int, minimum: int,
    fast: tuple[int, int], slow: tuple[int, int], q: float = 0.70,
) -> DataFrame:
    """z-score of the composite with a moving threshold and trend confirmation."""
    df = df.withColumn("composite", trend_composite(weights, skip, "vol"))
    df = standardised_tail(df, "composite", window, minimum, q).drop("signal")
    gap = F.ln(ratio(roll(F.avg, "close", ts(fast[0]), fast[1]), roll(F.avg, "close", ts(slow[0]), slow[1])))
    trend = ratio(gap, F.col("vol") * F.sqrt(F.lit(float(slow[0] - fast[0]))))
    df = df.withColumn("trend_strength", trend)
    pos = symmetric_position(F.col("z_score"), F.col("threshold"), F.col("trend_strength"))
    df = df.withColumn("signal", eligible_only(pos))
    return df.withColumn("sizing_score", ratio(F.col("signal"), positive(F.col("effective_vol"))))


def less_group_median(
    df: DataFrame, value: str, out: str, group: str = "sector", wide: bool = False, all_names: bool = False
) -> DataFrame:
    """Value less the median of its group, among eligible names or, for a reading masked later, among all."""
    df = df.withColumn("__v", F.col(value) if all_names else eligible_only(F.col(value)))
    df = xs_quantile(df, "__v", "__med", 0.5, by=("session_idx", group), wide=wide)
    return df.withColumn(out, F.col("__v") - F.col("__med")).drop("__v", "__med")


def dislocation_families(
    df: DataFrame, volume_window: tuple[int, int], window: int, minimum: int, wide: bool = False
) -> DataFrame:
    """Overnight gap, intraday and volume-shock reversal within groups."""
    lv = F.log1p(F.when(F.col("volume") >= 0, F.col("volume")))
    df = df.withColumns(
        {
            "__gap": -F.ln(ratio(F.col("open"), at("close", -1))),
            "__day": -F.ln(ratio(F.col("close"), F.col("open"))),
            "__lv": lv,
        }
    )
    df = rolling_quantiles(df, {"__usual": ("__lv", 0.5)}, -volume_window[0], -1, volume_window[1])
    df = df.withColumn("__sur", F.col("__lv") - F.col("__usual")).drop("__lv", "__usual")
    df = less_group_median(df, "ret", "__grp", wide=wide)
    df = df.withColumn("__shock", -F.col("__grp") * F.abs("__sur"))
    names = {"gap": "__gap", "intraday": "__day", "shock": "__shock"}
    for out, src in names.items():
        df = less_group_median(df, src, f"{out}_raw", wide=wide)
    df = standardised_tails(df, {f"{out}_raw": f"{out}_" for out in names}, window, minimum)
    return df.drop("__gap", "__day", "__sur", "__grp", "__shock")


def residual_mean_reversion(
    df: DataFrame, beta: tuple[int, int], residual: tuple[int, int], window: int, minimum: int,
    group: str = "sector", wide: bool = False,
) -> DataFrame:
    """Beta to the leave-one-out peer return, residual sum, prior z, faded tail."""
    df = df.withColumn("__r", eligible_only(F.col("ret")))
    df = peer_mean(df, "__r", "peer_return", group=group, wide=wide, min_peers=2, own_optional=True)
    df = df.drop("__r").withColumn("peer_beta", prior_slope("ret", "peer_return", *beta))
    df = df.withColumn("residual_return", F.col("ret") - F.col("peer_beta") * F.col("peer_return"))
    df = df.withColumn("residual_sum", roll(F.sum, "residual_return", ts(residual[0]), residual[1]))
    return standardised_tail(df, "residual_sum", window, minimum, sign=-1.0)


def event_yield(cash: Column, prior_close: Column, limit: float = 0.25) -> tuple[Column, Column]:
    """Distribution over prior close, and whether it is rejected as implausible."""
    raw = ratio(cash, positive(prior_close))
    rejected = truth((raw < 0) | (raw > limit))
    return F.when(~rejected, F.greatest(raw, F.lit(0.0))), rejected


def distribution_carry(
    df: DataFrame, window: tuple[int, int], group: str = "sector", periods: float = 252.0, wide: bool = False
) -> DataFrame:
    """Trailing event yield, centred percentile rank in the sleeve, inverse-vol size."""
    df = df.withColumn("trailing_yield", roll(F.sum, "event_yield", ts(window[0]), window[1]))
    df = df.withColumn("__u", eligible_only(snap("trailing_yield", 9)))
    by = ("session_idx", group)
    df = xs_rank(df, "__u", "__r", by=by, wide=wide)
    df = xs_stats(df, by, wide, __n=F.count("__u"), __m=F.avg("__r"))
    df = df.withColumn(
        "carry_score", F.when(F.col("__n") >= 3, (F.col("__r") - F.col("__m")) * 2.0)
    ).drop("__u", "__r", "__n", "__m")
    annual = F.col("vol") * F.sqrt(F.lit(periods))
    return df.withColumn("sizing_score", ratio(F.col("carry_score"), positive(annual)))


def core_reversal(df: DataFrame, spans=((1, 1), (3, 3), (5, 5)), wide: bool = False) -> DataFrame:
    """-(0.5 z1 + 0.3 z3 + 0.2 z5) and -z3 of residual sums."""
    for n, k in spans:
        df = df.withColumn(f"__s{n}", eligible_only(roll(F.sum, "residual", ts(n), k)))
    df = xs_zscores(df, {f"__s{n}": f"__z{n}" for n, _ in spans}, wide=wide)
    z1, z3, z5 = (F.col(f"__z{n}") for n, _ in spans)
    return df.withColumns({"core": -(0.5 * z1 + 0.3 * z3 + 0.2 * z5), "reference": -z3}).drop(
        *[f"__s{n}" for n, _ in spans], *[f"__z{n}" for n, _ in spans]
    )


def side_rank(df: DataFrame, score: str, out: str, wide: bool = False) -> DataFrame:
    """Ranks inside the positive and inside the negative scores, +-(0.5..1]."""
    df = df.withColumns({"__side": F.signum(score).cast("int"), "__size": F.abs(score)})
    df = xs_rank(df, "__size", "__p", by=("session_idx", "__side"), wide=wide)
    val = F.when(F.col("__side") != 0, F.col("__side") * (0.5 + 0.5 * F.col("__p"))).otherwise(0.0)
    return df.withColumn(out, F.coalesce(val, F.lit(0.0))).drop("__side", "__size", "__p")


def sector_projection(df: DataFrame, score: str, beta: str, out: str, by=("session_idx",), group: str = "sector", wide: bool = False) -> DataFrame:
    """Residual of the score on [1, beta, sector dummies] within each session.

    Demeaning by sector absorbs intercept and dummies; one slope remains.
    """
    by = list(by)
    usable = F.col(score).isNotNull() & F.col(beta).isNotNull() & F.col(group).isNotNull()
    df = df.withColumns({"__s": F.when(usable, F.col(score)), "__b": F.when(usable, F.col(beta))})
    df = xs_stats(df, [*by, group], wide, __ms=F.avg("__s"), __mb=F.avg("__b"))
    df = df.withColumns({"__ds": F.col("__s") - F.col("__ms"), "__db": F.col("__b") - F.col("__mb")})
    df = xs_stats(
        df, by, wide, __sb=F.sum(F.col("__ds") * F.col("__db")), __bb=F.sum(F.col("__db") * F.col("__db"))
    )
    # rounding noise of identical betas is not variance
    slope = F.when(F.col("__bb") > 1e-18, F.col("__sb") / F.col("__bb")).otherwise(0.0)
    return df.withColumn(out, F.col("__ds") - slope * F.col("__db")).drop(
        "__s", "__b", "__ms", "__mb", "__ds", "__db", "__sb", "__bb"
    )


# --- labels, runs, spells ----------------------------------------------------------------


def forward_label(ret: str, horizon: int, by=("security_id",)) -> Column:
    """Compounded return of the next ``horizon`` sessions; NULL if any is missing."""
    f = ts_between(1, horizon, by)
    return F.when(F.count(ret).over(f) == horizon, F.product(1 + F.col(ret)).over(f) - 1)


def kept_tails(df: DataFrame, score: str, out: str, fraction: float, wide: bool = False) -> DataFrame:
    """Eligible scores in the lowest or highest ``fraction`` of the session."""
    df = df.withColumn("__v", eligible_only(F.col(score)))
    df = xs_rank(df, "__v", "__p", wide=wide)
    keep = (F.col("__p") <= fraction) | (F.col("__p") > 1 - fraction)
    return df.withColumn(out, F.when(keep, F.col("__v"))).drop("__v", "__p")


def cost_hurdle(
    forecast: Column, vol: Column, adv: Column, costs, nav: float = 100_000.0, traded: float = 0.005, borrow_days: int = 3
) -> Column:
    """What a round trip of ``traded`` of the book costs per unit: both ways at the rates of the ledger's ``costs``,
    and a loan of ``borrow_days`` calendar days for negative forecasts."""
    participation = ratio(F.lit(traded * nav), positive(adv))
    one_way = costs.linear + costs.impact * vol * F.sqrt(participation)
    loan = costs.borrow_annual * borrow_days / 365 * truth(forecast < 0).cast("double")
    return one_way * 2 + loan


def confident(forecast: Column, hurdle: Column, multiplier: float) -> Column:
    return truth(F.abs(forecast) >= multiplier * hurdle)


def weighted_blend(weights: Mapping[str, float]) -> Column:
    """Weighted sum of families; missing in any gives missing."""
    total = None
    for name, w in weights.items():
        part = F.col(name) * w
        total = part if total is None else total + part
    return total


def longest_gap(df: DataFrame, bad: Column, by=("security_id",)) -> DataFrame:
    """Longest run of consecutive sessions with ``bad`` true, per key (0 if none).

    Expects one row per session of interest; groups are bounded by the calendar.
    """
    w = Window.partitionBy(*by).orderBy("session_idx")
    runs = (
        df.withColumn("__bad", bad)
        .where("__bad")
        .withColumn("__island", F.col("session_idx") - F.row_number().over(w))
        .groupBy(*by, "__island")
        .agg(F.count("*").alias("__len"))
        .groupBy(*by)
        .agg(F.max("__len").alias("longest"))
    )
    return df.select(*by).distinct().join(runs, list(by), "left").fillna(0, ["longest"])


def spell_ids(df: DataFrame, state: Column, by) -> DataFrame:
    """Number consecutive stretches of equal ``state`` per key."""
    w = Window.partitionBy(*by).orderBy("session_idx")
    df = df.withColumn("__state", state)
    change = F.when(F.col("__state").eqNullSafe(F.lag("__state").over(w)), 0).otherwise(1)
    df = df.withColumn("__chg", change)
    return df.withColumn("spell", F.sum("__chg").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__chg")


def holding_episodes(weights: DataFrame, last_session: int, by=("experiment", "security_id")) -> DataFrame:
    """Contiguous same-sign holdings: entry, exit (first session after), length."""
    held = weights.where(F.col("weight") != 0)
    w = Window.partitionBy(*by).orderBy("session_idx")
    brk = F.when(
        (F.col("session_idx") == F.lag("session_idx").over(w) + 1)
        & (F.signum("weight") == F.signum(F.lag("weight").over(w))),
        0,
    ).otherwise(1)
    held = held.withColumn("__b", brk).withColumn(
        "__spell", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        held.groupBy(*by, "__spell")
        .agg(
            F.min("session_idx").alias("entry_idx"),
            (F.max("session_idx") + 1).alias("exit_idx"),
            F.count("*").alias("sessions"),
            F.max(F.signum("weight")).cast("int").alias("side"),
        )
        .withColumn("completed", F.col("exit_idx") <= last_session)
        .drop("__spell")
    )


def prior_dispersion(df: DataFrame, value: str = "residual") -> DataFrame:
    """Cross-sectional deviation per session, and its value one session earlier."""
    s = df.groupBy("session_idx").agg(F.stddev_samp(value).alias("dispersion"))
    return s.withColumn("prior_dispersion", at("dispersion", -1, ALL))


def equity_features(df: DataFrame, kalman: DataFrame, market_window, sector_window, reversal, volume_window, max_surprise: float = 5.0, min_peers: int = 2, wide: bool = False) -> DataFrame:
    """Residual reversal, Kalman innovation and volume/volatility dislocation.

    ``df`` is a research panel (market moments, ``vol``, ``eligible``); ``kalman``
    holds the per-name innovations. Windows are (sessions, minimum) pairs.
    """
    df = market_residual(df, *market_window)
    df = sector_factor_residual(df, *sector_window, min_peers=min_peers, wide=wide)
    df = df.join(kalman, ["security_id", "session_idx"], "left")
    df = df.withColumn("__ki", eligible_only(F.col("innovation")))
    df = peer_mean(df, "__ki", "__kp", wide=wide, min_peers=min_peers)
    normal = roll(median, "volume", ts_prior(volume_window[0]), volume_window[1])
    df = df.withColumn("surprise", clip(ratio(F.col("volume"), positive(normal)), 0.0, max_surprise))
    raw = {
        "residual_reversal": -roll(F.sum, "residual", ts(reversal[0]), reversal[1]),
        "kalman_innovation": -(F.col("innovation") - F.col("__kp")),
        "dislocation": ratio(-F.col("residual") * F.col("surprise"), positive(F.col("vol"))),
    }
    df = df.withColumns({n: eligible_only(c) for n, c in raw.items()}).drop("__ki", "__kp")
    return xs_zscores(df, {n: n for n in raw}, wide=wide)
