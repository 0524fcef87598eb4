"""Window and cross-section queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweft.functions import frames as fr
from panelweft.operators import features as ft
from panelweft.operators.ledger import Costs
from panelweft.plans.registry import finish, out, query
from panelweft.plans.sqlbase import (
    PANEL,
    RESEARCH,
    RESIDUAL,
    RETURNS,
    at,
    pct_rank,
    peer,
    roll,
    ts,
    tsp,
    zscore,
)
from panelweft.sources import tables as tb

KEYS = ["session", "security_id"]
K = "session:d security_id:s"
TREND = {13: 0.25, 26: 0.35, 52: 0.40}
SKIP = 4


def pick(df, *cols, digits=6):
    return finish(df.select(*KEYS, *cols), digits)


def keep(df, names):
    """Rows where at least one of the named outputs is present."""
    return df.where(F.coalesce(*[F.col(n).isNotNull().cast("int") for n in names]).isNotNull())


@query(
    "w01_returns",
    out(
        RETURNS,
        f"""SELECT session, security_id, ret AS ret_1, close / {at('close', -4)} - 1 AS ret_4,
        ln(close / {at('close', -1)}) AS log_ret_1 FROM rets""",
        f"{K} ret_1:f ret_4:f log_ret_1:f",
    ),
)
def w01(spark, sf):
    df = tb.returns(spark, sf)
    return pick(
        df, F.col("ret").alias("ret_1"), ft.simple_return("close", 4).alias("ret_4"),
        ft.log_return("close").alias("log_ret_1"),
    )


_STATS = [
    ("roll_mean", "avg({})"), ("roll_sum", "sum({})"), ("roll_std", "stddev_samp({})"),
    ("roll_pop", "stddev_pop({})"), ("roll_var", "var_samp({})"), ("roll_median", "median({})"),
    ("roll_p80", "quantile_cont({}, 0.8)"), ("roll_max", "max({})"),
]


def _stats_sql(frame, k):
    cols = ", ".join(f"{roll(fn, 'ret', frame, k)} AS {n}" for n, fn in _STATS)
    return f"SELECT session, security_id, {cols}, count(ret) OVER {frame} AS roll_n FROM rets"


_STAT_COLS = f"{K} " + " ".join(f"{n}:f" for n, _ in _STATS) + " roll_n:i"


@query("w02_rolling_stats", out(RETURNS, _stats_sql(ts(26), 13), _STAT_COLS))
def w02(spark, sf):
    df = ft.rolling_stats(tb.returns(spark, sf), "ret", 26, 13)
    return pick(df, *[n for n, _ in _STATS], "roll_n")


@query("w02_rolling_stats_prior", out(RETURNS, _stats_sql(tsp(26), 13), _STAT_COLS))
def w02p(spark, sf):
    df = ft.rolling_stats(tb.returns(spark, sf), "ret", 26, 13, prior=True)
    return pick(df, *[n for n, _ in _STATS], "roll_n")


@query("w03_prior_market_beta", out(RESIDUAL, "SELECT session, security_id, beta FROM rs", f"{K} beta:f"))
def w03(spark, sf):
    df = tb.research_panel(spark, sf).withColumn("beta", ft.market_beta(26, 13))
    return pick(df, "beta")


_W4 = (
    RESIDUAL
    + f""",
mr AS (SELECT *, ret - {roll('avg({})', 'ret', tsp(26), 13)} - beta * (market - market_mean) AS market_residual FROM rs)"""
)


@query("w04_market_residual", out(_W4, "SELECT session, security_id, market_residual FROM mr", f"{K} market_residual:f"))
def w04(spark, sf):
    return pick(ft.market_residual(tb.research_panel(spark, sf), 26, 13), "market_residual")


@query(
    "w05_loo_peer_mean",
    out(
        RETURNS,
        f"""SELECT session, security_id, {peer('ret')} AS peer_two, {peer('ret', min_peers=1)} AS peer_one,
        CASE WHEN sector IS NOT NULL AND count(ret) OVER g - (CASE WHEN ret IS NULL THEN 0 ELSE 1 END) >= 2 THEN
          (coalesce(sum(ret) OVER g, 0) - coalesce(ret, 0)) / (count(ret) OVER g - (CASE WHEN ret IS NULL THEN 0 ELSE 1 END)) END AS peer_any
        FROM rets WINDOW g AS (PARTITION BY session_idx, sector)""",
        f"{K} peer_two:f peer_one:f peer_any:f",
    ),
)
def w05(spark, sf):
    wide = tb.shape(spark, sf).wide
    df = tb.returns(spark, sf)
    df = fr.peer_mean(df, "ret", "peer_two", wide=wide)
    df = fr.peer_mean(df, "ret", "peer_one", wide=wide, min_peers=1)
    df = fr.peer_mean(df, "ret", "peer_any", wide=wide, own_optional=True)
    return pick(df, "peer_two", "peer_one", "peer_any")


@query(
    "w06_pct_rank",
    out(RETURNS, f"SELECT session, security_id, {pct_rank('volume')} AS pct_volume, {pct_rank('ret')} AS pct_ret FROM rets",
        f"{K} pct_volume:f pct_ret:f"),
)
def w06(spark, sf):
    wide = tb.shape(spark, sf).wide
    df = fr.xs_rank(tb.returns(spark, sf), "volume", "pct_volume", wide=wide)
    return pick(fr.xs_rank(df, "ret", "pct_ret", wide=wide), "pct_volume", "pct_ret")


@query(
    "w07_xs_zscore",
    out(
        RETURNS
        + f", pr AS (SELECT *, {pct_rank('volume')} AS p FROM rets)",
        f"""SELECT session, security_id, {zscore('ret')} AS z_ret,
        (p - 0.5) / nullif(stddev_samp(p) OVER (PARTITION BY session_idx), 0) AS z_rank FROM pr""",
        f"{K} z_ret:f z_rank:f",
    ),
)
def w07(spark, sf):
    wide = tb.shape(spark, sf).wide
    df = fr.xs_zscore(tb.returns(spark, sf), "ret", "z_ret", wide=wide)
    df = fr.xs_rank(df, "volume", "p", wide=wide)
    df = fr.xs_stats(df, "session_idx", wide, s=F.stddev_samp("p"))
    return pick(df.withColumn("z_rank", (F.col("p") - 0.5) / fr.positive(F.col("s"))), "z_ret", "z_rank")


_W8 = (
    _W4
    + f""",
sf0 AS (SELECT *, CASE WHEN eligible THEN market_residual END AS em FROM mr),
sf1 AS (SELECT *, {peer('em')} AS sector_factor FROM sf0),
sf2 AS (SELECT *, count(CASE WHEN market_residual IS NOT NULL AND sector_factor IS NOT NULL THEN 1 END) OVER {tsp(26)} AS npair,
   covar_samp(market_residual, sector_factor) OVER {tsp(26)} AS cv, {roll('var_samp({})', 'sector_factor', tsp(26), 13)} AS vv,
   {roll('avg({})', 'sector_factor', tsp(26), 13)} AS fm, {roll('avg({})', 'market_residual', tsp(26), 13)} AS rm FROM sf1),
sf3 AS (SELECT *, CASE WHEN npair >= 13 AND vv > 0 THEN cv / vv END AS sector_beta FROM sf2),
two AS (SELECT *, market_residual - rm - sector_beta * (sector_factor - fm) AS residual2 FROM sf3)"""
)


@query(
    "w08_sector_factor_residual",
    out(_W8, "SELECT session, security_id, sector_factor, sector_beta, residual2 AS residual FROM two",
        f"{K} sector_factor:f sector_beta:f residual:f"),
)
def w08(spark, sf):
    df = ft.market_residual(tb.research_panel(spark, sf), 26, 13)
    df = ft.sector_factor_residual(df, 26, 13, wide=tb.shape(spark, sf).wide)
    return pick(df, "sector_factor", "sector_beta", "residual")


@query(
    "w10_residual_returns",
    out(RESIDUAL, "SELECT session, security_id, beta, residual FROM rs", f"{K} beta:f residual:f"),
)
def w10(spark, sf):
    return pick(tb.residual_panel(spark, sf), "beta", "residual")


def _skip_sum(n, skip, k, col="residual"):
    f = f"(PARTITION BY security_id ORDER BY session_idx RANGE BETWEEN {n - 1 + skip} PRECEDING AND {skip} PRECEDING)"
    return roll("sum({})", col, f, k)


_W11 = (
    RESIDUAL
    + f""",
cs AS (SELECT *, round(-{roll('sum({})', 'residual', ts(3), 2).replace('CASE', '(CASE', 1)}), 9) AS reversal_3,
   -residual AS reversal_1, -({roll('sum({})', 'residual', ts(5), 3)}) AS reversal_5,
   round({_skip_sum(13, 2, 6)}, 9) AS momentum_13_skip_2, {_skip_sum(26, 4, 13)} AS momentum_26_skip_4 FROM rs)"""
)


@query(
    "w11_candidate_scores",
    out(
        _W11,
        f"""SELECT session, security_id, reversal_1, reversal_3, reversal_5, momentum_13_skip_2, momentum_26_skip_4,
        {pct_rank('reversal_3')} + {pct_rank('momentum_13_skip_2')} - 1 AS blend FROM cs""",
        f"{K} reversal_1:f reversal_3:f reversal_5:f momentum_13_skip_2:f momentum_26_skip_4:f blend:f",
    ),
)
def w11(spark, sf):
    df = ft.candidate_scores(
        tb.residual_panel(spark, sf), ((1, 1), (3, 2), (5, 3)), ((13, 2, 6), (26, 4, 13)),
        ("reversal_3", "momentum_13_skip_2"), tb.shape(spark, sf).wide,
    )
    return pick(df, "reversal_1", "reversal_3", "reversal_5", "momentum_13_skip_2", "momentum_26_skip_4", "blend")


_W12 = (
    RESIDUAL
    + f""",
v4a AS (SELECT *, ln(open / {at('close', -1)}) AS night, ln(close / open) AS day,
   -({roll('stddev_samp({})', 'residual', ts(26), 13)}) AS low_vol_26,
   close / {roll('max({})', 'close', ts(52), 26)} AS to_high_52,
   ({roll('avg({})', 'residual', ts(26), 13)}) / nullif({roll('stddev_samp({})', 'residual', ts(26), 13)}, 0) AS trend_26,
   ({roll('sum({})', 'residual', ts(26), 13)}) / nullif({roll('sum({})', 'abs(residual)', ts(26), 13)}, 0) AS efficiency_26
   FROM rs),
v4b AS (SELECT *, {roll('sum({})', 'night', ts(13), 6)} AS overnight_13, {roll('sum({})', 'day', ts(13), 6)} AS intraday_13,
   round(to_high_52, 9) AS a, round(low_vol_26, 9) AS b FROM v4a)"""
)


@query(
    "w12_path_signals",
    out(
        _W12,
        f"""SELECT session, security_id, low_vol_26, to_high_52, trend_26, efficiency_26, overnight_13, intraday_13,
        {pct_rank('a')} + {pct_rank('b')} - 1 AS blend_high_defensive FROM v4b""",
        f"{K} low_vol_26:f to_high_52:f trend_26:f efficiency_26:f overnight_13:f intraday_13:f blend_high_defensive:f",
    ),
)
def w12(spark, sf):
    df = ft.path_signals(
        tb.residual_panel(spark, sf), ((26, 13),), (52, 26), ((26, 13),), ((13, 6),), tb.shape(spark, sf).wide
    )
    return pick(df, "low_vol_26", "to_high_52", "trend_26", "efficiency_26", "overnight_13", "intraday_13", "blend_high_defensive")


FAMILIES = [
    "reversal_1", "reversal_3", "momentum_26_4", "gap_reversal", "intraday_reversal",
    "close_location", "volume_shock_reversal", "high_52",
]

LIBRARY_SQL = (
    RESIDUAL
    + f""",
lib0 AS (SELECT *, ln(1 + volume) AS lv FROM rs),
lib1 AS (SELECT *, lv - {roll('median({})', 'lv', tsp(26), 13)} AS sur FROM lib0),
lib2 AS (SELECT session, session_idx, security_id, sector, eligible, ret, volume, close, vol, beta, residual,
   -residual AS reversal_1, -({roll('sum({})', 'residual', ts(3), 2)}) AS reversal_3,
   ({roll('sum({})', 'residual', ts(26), 13)}) - ({roll('sum({})', 'residual', ts(4), 2)}) AS momentum_26_4,
   -(open / {at('close', -1)} - 1) AS gap_reversal, -(close / open - 1) AS intraday_reversal,
   CASE WHEN high > low THEN (close - low) / (high - low) END - 0.5 AS close_location,
   -residual * abs(sur) AS volume_shock_reversal,
   close / {roll('max({})', 'high', ts(52), 26)} AS high_52 FROM lib1),
lib3 AS (SELECT * EXCLUDE ({', '.join(FAMILIES)}), {', '.join(f'CASE WHEN eligible THEN {f} END AS {f}' for f in FAMILIES)} FROM lib2),
lib4 AS (SELECT * EXCLUDE ({', '.join(FAMILIES)}), {', '.join(f'{f} - ({peer(f)}) AS {f}' for f in FAMILIES)} FROM lib3),
lib AS (SELECT * EXCLUDE ({', '.join(FAMILIES)}), {', '.join(f'{zscore(f)} AS {f}' for f in FAMILIES)} FROM lib4)"""
)


def library(spark, sf, upto=None):
    """The families; ``upto`` computes them as if history ended at that session."""
    panel = tb.residual_panel(spark, sf) if upto is None else ft.residual_returns(tb.research_panel(spark, sf).where(F.col("session_idx") <= upto), 26, 13, 2, tb.shape(spark, sf).wide)
    df, names = ft.bar_families(
        panel, ((1, 1), (3, 2)), ((26, 13, 4, 2),), (26, 13), (52, 26)
    )
    assert [n for n in FAMILIES if n not in names] == []
    return ft.sector_neutral(df, FAMILIES, tb.shape(spark, sf).wide)


@query(
    "w13_feature_library",
    out(LIBRARY_SQL, f"SELECT session, security_id, {', '.join(FAMILIES)} FROM lib", f"{K} " + " ".join(f"{f}:f" for f in FAMILIES)),
)
def w13(spark, sf):
    return pick(library(spark, sf), *FAMILIES)


def _comp(weights):
    return " + ".join(
        f"(({at('ln(close)', -SKIP)}) - ({at('ln(close)', -h)})) / (nullif(vol, 0) * sqrt({float(h - SKIP)})) * {w}"
        for h, w in weights.items()
    )


_EQUAL = {h: 1 / 3 for h in TREND}


@query(
    "w14_tsmom_cross_sectional",
    out(
        RESEARCH + f", t0 AS (SELECT *, {_comp(_EQUAL)} AS c FROM ep), t1 AS (SELECT *, CASE WHEN eligible THEN c END AS ec FROM t0)",
        f"SELECT session, security_id, {zscore('ec', min_count=3)} AS trend_xs, greatest(-3, least(3, CASE WHEN ec IS NOT NULL THEN ec END)) AS trend_ts FROM t1 WHERE ec IS NOT NULL",
        f"{K} trend_xs:f trend_ts:f",
    ),
)
def w14(spark, sf):
    df = tb.research_panel(spark, sf)
    df = df.withColumn("c", ft.eligible_only(ft.trend_composite(_EQUAL, SKIP, "vol")))
    df = fr.xs_zscore(df, "c", "trend_xs", wide=tb.shape(spark, sf).wide, min_count=3)
    return pick(df.where(F.col("c").isNotNull()), "trend_xs", fr.clip(F.col("c"), -3, 3).alias("trend_ts"))


DEFENSIVE_SQL = (
    RESEARCH
    + f""",
d0 AS (SELECT *, {_comp(TREND)} AS c0, {roll('avg({})', 'close', ts(40), 20)} AS average FROM ep),
d1 AS (SELECT *, CASE WHEN c0 IS NOT NULL THEN greatest(-3, least(3, c0)) END AS raw_signal FROM d0),
d2 AS (SELECT *, CASE WHEN coalesce((raw_signal > 0 AND close > average) OR (raw_signal < 0 AND close < average), false)
   AND abs(raw_signal) >= 0.25 THEN raw_signal ELSE 0.0 END AS kept FROM d1),
def AS (SELECT *, CASE WHEN eligible THEN kept END AS signal, vol * sqrt(52.0) AS annual_vol FROM d2)"""
)


def defensive(spark, sf):
    return ft.defensive_tsmom(tb.research_panel(spark, sf), TREND, SKIP, (40, 20), periods=52.0)


@query(
    "w14_tsmom_defensive",
    out(DEFENSIVE_SQL, "SELECT session, security_id, raw_signal, signal, signal / nullif(annual_vol, 0) AS sizing_score FROM def",
        f"{K} raw_signal:f signal:f sizing_score:f"),
)
def w14d(spark, sf):
    return pick(defensive(spark, sf), "raw_signal", "signal", "sizing_score")


OVERLAY_SQL = (
    RESEARCH
    + f""",
o0 AS (SELECT *, ({roll('stddev_samp({})', 'ret', ts(13), 6)}) * sqrt(52.0) AS realized,
   close / max(close) OVER (PARTITION BY security_id ORDER BY session_idx ROWS UNBOUNDED PRECEDING) - 1 AS drawdown,
   {roll('avg({})', 'close', ts(10), 5)} AS fast, {roll('avg({})', 'close', ts(40), 20)} AS slow,
   close / {at('close', -4)} - 1 AS chg FROM ep),
o1 AS (SELECT *, {roll('quantile_cont({}, 0.8)', 'realized', tsp(52), 13)} AS p80, {roll('quantile_cont({}, 0.95)', 'realized', tsp(52), 13)} AS p95 FROM o0),
ov AS (SELECT *, CASE WHEN coalesce(drawdown < -0.15, false) OR coalesce(realized > p95, false) THEN 0.0
   WHEN coalesce(realized > p80, false) OR coalesce(drawdown < -0.10, false) OR (coalesce(fast < slow, false) AND coalesce(chg < 0, false)) THEN 0.5
   ELSE 1.0 END AS multiplier FROM o1)"""
)


def overlay(spark, sf):
    return ft.fast_overlay(tb.research_panel(spark, sf), (13, 6), (52, 13), (10, 5), (40, 20), 4, 52.0)


@query(
    "w15_fast_overlay",
    out(OVERLAY_SQL, "SELECT session, security_id, realized, p80, p95, drawdown, multiplier FROM ov",
        f"{K} realized:f p80:f p95:f drawdown:f multiplier:f"),
)
def w15(spark, sf):
    return pick(overlay(spark, sf), "realized", "p80", "p95", "drawdown", "multiplier")


_FLOORED = """SELECT *, vol * sqrt(52.0) AS annual_vol FROM {src}),
{out} AS (SELECT *, CASE WHEN annual_vol IS NOT NULL THEN greatest(annual_vol, 0.08, median(annual_vol) OVER (PARTITION BY session_idx) / 1.5) END AS effective_vol"""

ASYM_SQL = (
    OVERLAY_SQL
    + ", f0 AS (" + _FLOORED.format(src="ov", out="f1") + " FROM f0)"
    + f""",
s0 AS (SELECT *, {_comp(TREND)} AS c0, {roll('avg({})', 'close', ts(40), 20)} AS average,
   {' + '.join(f"CASE WHEN coalesce(({at('ln(close)', -SKIP)}) - ({at('ln(close)', -h)}) < 0, false) THEN 1 ELSE 0 END" for h in TREND)} AS negative_horizons FROM f1),
s1 AS (SELECT *, CASE WHEN c0 IS NOT NULL THEN greatest(-3, least(3, c0)) END AS composite FROM s0),
s2 AS (SELECT *, coalesce(composite > 0.25 AND close > average, false) AND eligible AS long_active,
   coalesce(composite < -0.5 AND close < average, false) AND negative_horizons >= 2 AND eligible AS short_active FROM s1),
asym AS (SELECT *, CASE WHEN eligible THEN (CASE WHEN long_active OR short_active THEN composite ELSE 0.0 END) * multiplier END AS signal,
   CASE WHEN eligible AND (long_active OR short_active) THEN multiplier ELSE 0.0 END AS name_scaler FROM s2)"""
)


def asymmetric(spark, sf):
    df = ft.floored_volatility(overlay(spark, sf), 0.08, 52.0, tb.shape(spark, sf).wide)
    return ft.asymmetric_tsmom(df, TREND, SKIP, (40, 20))


@query(
    "w14_tsmom_asymmetric",
    out(ASYM_SQL, """SELECT session, security_id, composite, long_active, short_active, negative_horizons, signal, name_scaler,
        signal / nullif(effective_vol, 0) AS sizing_score FROM asym""",
        f"{K} composite:f long_active:b short_active:b negative_horizons:i signal:f name_scaler:f sizing_score:f"),
)
def w14a(spark, sf):
    return pick(asymmetric(spark, sf), "composite", "long_active", "short_active", "negative_horizons", "signal", "name_scaler", "sizing_score")


def _tail_sql(src, dst, col, window, k, sign=1.0, prefix=""):
    z, th, sg = f"{prefix}z_score", f"{prefix}threshold", f"{prefix}signal"
    f = tsp(window)
    return f"""
{dst}_0 AS (SELECT *, {roll('avg({})', col, f, k)} AS m_, {roll('stddev_samp({})', col, f, k)} AS s_ FROM {src}),
{dst}_1 AS (SELECT * EXCLUDE (m_, s_), CASE WHEN s_ > 0 AND {col} IS NOT NULL THEN greatest(-5, least(5, ({col} - m_) / s_)) END AS {z} FROM {dst}_0),
{dst}_2 AS (SELECT *, {roll('quantile_cont({}, 0.7)', f'abs({z})', f, k)} AS {th} FROM {dst}_1),
{dst} AS (SELECT *, CASE WHEN eligible THEN (CASE WHEN coalesce(abs({z}) > {th}, false) THEN tanh({z}) * {sign} ELSE 0.0 END) END AS {sg} FROM {dst}_2)"""


SYM_SQL = (
    RESEARCH
    + ", y0 AS (" + _FLOORED.format(src="ep", out="y1") + " FROM y0)"
    + f", y2 AS (SELECT *, {_comp(TREND)} AS composite FROM y1),"
    + _tail_sql("y2", "y3", "composite", 52, 13).replace(" AS signal", " AS tail_signal")
    + f""",
y4 AS (SELECT *, ln(({roll('avg({})', 'close', ts(10), 5)}) / ({roll('avg({})', 'close', ts(40), 20)})) / nullif(vol * sqrt(30.0), 0) AS trend_strength FROM y3),
sym AS (SELECT *, CASE WHEN eligible THEN (CASE WHEN coalesce(abs(z_score) > threshold AND sign(z_score) = sign(trend_strength), false) THEN tanh(z_score) ELSE 0.0 END) END AS signal FROM y4)"""
)


def symmetric(spark, sf):
    df = ft.floored_volatility(tb.research_panel(spark, sf), 0.08, 52.0, tb.shape(spark, sf).wide)
    return ft.symmetric_tsmom(df, TREND, SKIP, 52, 13, (10, 5), (40, 20))


@query(
    "w14_tsmom_symmetric",
    out(SYM_SQL, """SELECT session, security_id, z_score, threshold, trend_strength, signal, effective_vol,
        signal / nullif(effective_vol, 0) AS sizing_score FROM sym""",
        f"{K} z_score:f threshold:f trend_strength:f signal:f effective_vol:f sizing_score:f"),
)
def w14s(spark, sf):
    return pick(symmetric(spark, sf), "z_score", "threshold", "trend_strength", "signal", "effective_vol", "sizing_score")


@query(
    "w17_dispersion",
    out(
        RESIDUAL + ", ds AS (SELECT session_idx, stddev_samp(residual) AS dispersion FROM rs GROUP BY 1)",
        "SELECT session_idx, dispersion, first_value(dispersion) OVER (ORDER BY session_idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prior_dispersion FROM ds",
        "session_idx:i dispersion:f prior_dispersion:f",
    ),
)
def w17(spark, sf):
    return finish(ft.prior_dispersion(tb.residual_panel(spark, sf)).select("session_idx", "dispersion", "prior_dispersion"))


@query(
    "w18_drawdown",
    out(
        RETURNS,
        f"""SELECT session, security_id, close / max(close) OVER (PARTITION BY security_id ORDER BY session_idx ROWS UNBOUNDED PRECEDING) - 1 AS drawdown,
        close / {roll('max({})', 'close', ts(52), 26)} - 1 AS drawdown_52,
        {at('close', -1)} / max(close) OVER (PARTITION BY security_id ORDER BY session_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS prior_drawdown
        FROM rets""",
        f"{K} drawdown:f drawdown_52:f prior_drawdown:f",
    ),
)
def w18(spark, sf):
    before = fr.ts_upto().rowsBetween(-(2**31) + 1, -1)
    df = tb.returns(spark, sf)
    return pick(
        df,
        (F.col("close") / F.max("close").over(fr.ts_upto()) - 1).alias("drawdown"),
        (fr.ratio(F.col("close"), fr.roll(F.max, "close", fr.ts(52), 26)) - 1).alias("drawdown_52"),
        (fr.ratio(fr.at("close", -1), F.max("close").over(before)) - 1).alias("prior_drawdown"),
    )


@query(
    "w21_group_relative",
    out(
        DEFENSIVE_SQL
        + ", g1 AS (SELECT * EXCLUDE (signal), raw_signal - median(raw_signal) OVER (PARTITION BY session_idx, sector) AS rel FROM def),"
        + _tail_sql("g1", "g2", "rel", 52, 13),
        """SELECT session, security_id, CASE WHEN eligible THEN rel END AS rel, CASE WHEN eligible THEN z_score END AS z_score,
        CASE WHEN eligible THEN threshold END AS threshold, CASE WHEN eligible THEN signal END AS signal FROM g2""",
        f"{K} rel:f z_score:f threshold:f signal:f",
    ),
)
def w21(spark, sf):
    df = ft.less_group_median(defensive(spark, sf), "raw_signal", "rel", wide=tb.shape(spark, sf).wide, all_names=True)
    df = ft.standardised_tail(df, "rel", 52, 13)
    return pick(df, *(ft.eligible_only(F.col(c)).alias(c) for c in ("rel", "z_score", "threshold", "signal")))


DISLOC_SQL = (
    RESEARCH
    + f""",
z0 AS (SELECT *, -ln(open / {at('close', -1)}) AS gap0, -ln(close / open) AS day0,
   ln(1 + volume) - {roll('median({})', 'ln(1 + volume)', tsp(26), 13)} AS sur, CASE WHEN eligible THEN ret END AS er FROM ep),
z1 AS (SELECT *, -(er - median(er) OVER (PARTITION BY session_idx, sector)) * abs(sur) AS shock0 FROM z0),
z2 AS (SELECT *, CASE WHEN eligible THEN gap0 END AS g_, CASE WHEN eligible THEN day0 END AS d_, CASE WHEN eligible THEN shock0 END AS k_ FROM z1),
z3 AS (SELECT *, g_ - median(g_) OVER (PARTITION BY session_idx, sector) AS gap_raw, d_ - median(d_) OVER (PARTITION BY session_idx, sector) AS intraday_raw,
   k_ - median(k_) OVER (PARTITION BY session_idx, sector) AS shock_raw FROM z2),"""
    + _tail_sql("z3", "z4", "gap_raw", 52, 13, prefix="gap_") + ","
    + _tail_sql("z4", "z5", "intraday_raw", 52, 13, prefix="intraday_") + ","
    + _tail_sql("z5", "disloc", "shock_raw", 52, 13, prefix="shock_")
)


def dislocations(spark, sf):
    df = tb.research_panel(spark, sf).select("security_id", "session", "session_idx", "sector", "open", "close", "volume", "ret", "eligible")
    return ft.dislocation_families(df, (26, 13), 52, 13, tb.shape(spark, sf).wide)


@query(
    "w22_ohlcv_families",
    out(DISLOC_SQL, "SELECT session, security_id, gap_raw, gap_signal, intraday_raw, intraday_signal, shock_raw, shock_signal FROM disloc",
        f"{K} gap_raw:f gap_signal:f intraday_raw:f intraday_signal:f shock_raw:f shock_signal:f"),
)
def w22(spark, sf):
    return pick(dislocations(spark, sf), "gap_raw", "gap_signal", "intraday_raw", "intraday_signal", "shock_raw", "shock_signal")


MR_SQL = (
    RESEARCH
    + f""",
m0 AS (SELECT *, CASE WHEN eligible THEN ret END AS er FROM ep),
m1 AS (SELECT *, count(er) OVER g - (CASE WHEN er IS NULL THEN 0 ELSE 1 END) AS np, coalesce(sum(er) OVER g, 0) - coalesce(er, 0) AS sp FROM m0
   WINDOW g AS (PARTITION BY session_idx, sector)),
m2 AS (SELECT *, CASE WHEN sector IS NOT NULL AND np >= 2 THEN sp / np END AS peer_return FROM m1),
m3 AS (SELECT *, CASE WHEN count(CASE WHEN ret IS NOT NULL AND peer_return IS NOT NULL THEN 1 END) OVER {tsp(26)} >= 13
   AND count(peer_return) OVER {tsp(26)} >= 13 THEN covar_samp(ret, peer_return) OVER {tsp(26)} / nullif(var_samp(peer_return) OVER {tsp(26)}, 0) END AS peer_beta FROM m2),
m4 AS (SELECT *, ret - peer_beta * peer_return AS rr FROM m3),
m5 AS (SELECT *, {roll('sum({})', 'rr', ts(8), 4)} AS residual_sum FROM m4),"""
    + _tail_sql("m5", "rmr", "residual_sum", 52, 13, sign=-1.0)
)


@query(
    "w23_residual_mean_reversion",
    out(MR_SQL, "SELECT session, security_id, peer_return, peer_beta, residual_sum, z_score, signal FROM rmr",
        f"{K} peer_return:f peer_beta:f residual_sum:f z_score:f signal:f"),
)
def w23(spark, sf):
    df = ft.residual_mean_reversion(tb.research_panel(spark, sf), (26, 13), (8, 4), 52, 13, wide=tb.shape(spark, sf).wide)
    return pick(df, "peer_return", "peer_beta", "residual_sum", "z_score", "signal")


# A cash distribution is 2% of the session's low where the week index is a multiple of 13.
CARRY_SQL = (
    RESEARCH
    + f""",
k0 AS (SELECT *, CASE WHEN session_idx % 13 = 0 THEN 0.02 * low * (1 + session_idx % 5) ELSE 0.0 END / nullif({at('close', -1)}, 0) AS yr FROM ep),
k1 AS (SELECT *, coalesce(yr < 0 OR yr > 0.09, false) AS rejected, CASE WHEN NOT coalesce(yr < 0 OR yr > 0.09, false) THEN greatest(yr, 0.0) END AS event_yield FROM k0),
k2 AS (SELECT *, {roll('sum({})', 'event_yield', ts(52), 26)} AS trailing_yield FROM k1),
k3 AS (SELECT *, CASE WHEN eligible THEN round(trailing_yield, 9) END AS u FROM k2),
k4 AS (SELECT *, {pct_rank('u', 'session_idx, sector')} AS p FROM k3),
carry AS (SELECT *, CASE WHEN count(u) OVER g >= 3 THEN (p - avg(p) OVER g) * 2.0 END AS carry_score FROM k4 WINDOW g AS (PARTITION BY session_idx, sector))"""
)


def carry(spark, sf):
    df = tb.research_panel(spark, sf)
    cash = F.when(F.col("session_idx") % 13 == 0, 0.02 * F.col("low") * (1 + F.col("session_idx") % 5)).otherwise(0.0)
    df = df.withColumn("prior_close", fr.at("close", -1))
    ey, rejected = ft.event_yield(cash, F.col("prior_close"), 0.09)
    df = df.withColumns({"cash": cash, "event_yield": ey, "rejected": rejected})
    return ft.distribution_carry(df, (52, 26), periods=52.0, wide=tb.shape(spark, sf).wide)


@query(
    "w24_distribution_carry",
    out(CARRY_SQL, "SELECT session, security_id, trailing_yield, carry_score, carry_score / nullif(vol * sqrt(52.0), 0) AS sizing_score FROM carry",
        f"{K} trailing_yield:f carry_score:f sizing_score:f"),
)
def w24(spark, sf):
    return pick(carry(spark, sf), "trailing_yield", "carry_score", "sizing_score")


def label_sql(h, key="security_id"):
    f = f"(PARTITION BY {key} ORDER BY session_idx RANGE BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"CASE WHEN count(ret) OVER {f} = {h} THEN product(1 + ret) OVER {f} - 1 END"


@query(
    "w25_forward_labels",
    out(RETURNS, f"""SELECT r.session, r.security_id, {label_sql(3)} AS label_3, c.session AS label_end
        FROM rets r LEFT JOIN cal c ON c.session_idx = r.session_idx + 3""".replace("security_id ORDER", "r.security_id ORDER").replace("BY session_idx RANGE", "BY r.session_idx RANGE"),
        f"{K} label_3:f label_end:d"),
)
def w25(spark, sf):
    cal = tb.calendar(spark, sf).select((F.col("session_idx") - 3).alias("session_idx"), F.col("session").alias("label_end"))
    df = tb.returns(spark, sf).withColumn("label_3", ft.forward_label("ret", 3))
    return pick(tb.attach(df, cal, "session_idx", tb.shape(spark, sf).sessions), "label_3", "label_end")


@query(
    "w27_cost_hurdle",
    out(
        DEFENSIVE_SQL
        + f""",
h0 AS (SELECT *, signal * 0.002 AS forecast, {roll('median({})', 'close * volume', tsp(26), 13)} AS adv FROM def),
h1 AS (SELECT *, 2 * 3.5 / 10000 + 0.2 * vol * sqrt(500.0 / nullif(adv, 0)) + CASE WHEN coalesce(forecast < 0, false) THEN 0.03 * 3 / 365 ELSE 0.0 END AS hurdle FROM h0)""",
        """SELECT session, security_id, hurdle, coalesce(abs(forecast) >= 0.05 * hurdle, false) AS passed,
        CASE WHEN coalesce(abs(forecast) >= 0.05 * hurdle, false) THEN signal END AS score FROM h1""",
        f"{K} hurdle:f passed:b score:f",
    ),
)
def w27(spark, sf):
    df = defensive(spark, sf)
    df = df.withColumn("adv", fr.roll(fr.median, F.col("close") * F.col("volume"), fr.ts_prior(26), 13))
    df = df.withColumn("forecast", F.col("signal") * 0.002)
    df = df.withColumn("hurdle", ft.cost_hurdle(F.col("forecast"), F.col("vol"), F.col("adv"), Costs()))
    df = df.withColumn("passed", ft.confident(F.col("forecast"), F.col("hurdle"), 0.05))
    return pick(df, "hurdle", "passed", F.when(F.col("passed"), F.col("signal")).alias("score"))


@query(
    "w28_blend",
    out(LIBRARY_SQL, """SELECT session, security_id, (reversal_1 + reversal_3) / 2 AS equal_blend,
        0.7 * momentum_26_4 + 0.3 * gap_reversal AS blend_70_30, 0.5 * reversal_1 + 0.5 * high_52 AS blend_50_50,
        0.6 * close_location + 0.4 * intraday_reversal AS blend_60_40 FROM lib""",
        f"{K} equal_blend:f blend_70_30:f blend_50_50:f blend_60_40:f"),
)
def w28(spark, sf):
    df = library(spark, sf)
    return pick(
        df,
        ft.weighted_blend({"reversal_1": 0.5, "reversal_3": 0.5}).alias("equal_blend"),
        ft.weighted_blend({"momentum_26_4": 0.7, "gap_reversal": 0.3}).alias("blend_70_30"),
        ft.weighted_blend({"reversal_1": 0.5, "high_52": 0.5}).alias("blend_50_50"),
        ft.weighted_blend({"close_location": 0.6, "intraday_reversal": 0.4}).alias("blend_60_40"),
    )


def traded_weeks(spark, sf):
    """One row per security and calendar session with the quantity, if any."""
    q = tb.bars(spark, sf).select("security_id", "session_idx", "volume")
    return tb.on_calendar(q, tb.shape(spark, sf).sessions)


_GRID = """
gr AS (SELECT s.security_id, c.session_idx, b.volume FROM (SELECT DISTINCT security_id FROM bars) s CROSS JOIN cal c LEFT JOIN bars b USING (security_id, session_idx))"""


@query(
    "w30_zero_run",
    out(
        RETURNS + "," + _GRID
        + """, zi AS (SELECT security_id, session_idx - row_number() OVER (PARTITION BY security_id ORDER BY session_idx) AS isl FROM gr WHERE coalesce(volume, 0) <= 0),
        zl AS (SELECT security_id, max(n) AS longest FROM (SELECT security_id, isl, count(*) AS n FROM zi GROUP BY 1, 2) GROUP BY 1)""",
        "SELECT security_id, coalesce(longest, 0) AS longest FROM (SELECT DISTINCT security_id FROM bars) LEFT JOIN zl USING (security_id)",
        "security_id:s longest:i",
    ),
)
def w30(spark, sf):
    g = traded_weeks(spark, sf)
    return finish(ft.longest_gap(g, F.coalesce(F.col("volume"), F.lit(0.0)) <= 0))


@query(
    "w31_internal_gap",
    out(
        RETURNS + "," + _GRID
        + """, bd AS (SELECT security_id, min(session_idx) AS lo, max(session_idx) AS hi FROM bars WHERE volume > 0 GROUP BY 1),
        zi AS (SELECT security_id, session_idx - row_number() OVER (PARTITION BY security_id ORDER BY session_idx) AS isl FROM gr JOIN bd USING (security_id)
               WHERE session_idx BETWEEN lo AND hi AND coalesce(volume, 0) <= 0),
        zl AS (SELECT security_id, max(n) AS longest FROM (SELECT security_id, isl, count(*) AS n FROM zi GROUP BY 1, 2) GROUP BY 1)""",
        "SELECT security_id, coalesce(longest, 0) AS longest FROM (SELECT DISTINCT security_id FROM bars) LEFT JOIN zl USING (security_id)",
        "security_id:s longest:i",
    ),
)
def w31(spark, sf):
    from pyspark.sql import Window

    g = traded_weeks(spark, sf)
    seen = F.when(F.coalesce(F.col("volume"), F.lit(0.0)) > 0, F.col("session_idx"))
    w = Window.partitionBy("security_id")
    g = g.withColumns({"lo": F.min(seen).over(w), "hi": F.max(seen).over(w)})
    g = g.where(F.col("session_idx").between(F.col("lo"), F.col("hi")))
    return finish(ft.longest_gap(g, F.coalesce(F.col("volume"), F.lit(0.0)) <= 0))


@query(
    "w33_stale_run",
    out(
        RETURNS + f", st AS (SELECT *, CASE WHEN close - {at('close', -1)} = 0 THEN 1 ELSE 0 END AS same FROM rets)",
        f"SELECT session, security_id, coalesce(sum(same) OVER {ts(2)}, 0) = 2 AS stale FROM st", f"{K} stale:b",
    ),
)
def w33(spark, sf):
    df = tb.returns(spark, sf)
    df = df.withColumn("same", F.when(F.col("close") - fr.at("close", -1) == 0, 1).otherwise(0))
    return pick(df, (F.sum("same").over(fr.ts(2)) == 2).alias("stale"))


@query(
    "w35_rolling_corr",
    out(
        PANEL + f""", c0 AS (SELECT *, count(CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN 1 END) OVER {ts(26)} AS n,
        corr(ret, market) OVER {ts(26)} AS c FROM panel)""",
        "SELECT session, security_id, CASE WHEN n >= 13 AND NOT isnan(c) THEN c END AS corr_26 FROM c0", f"{K} corr_26:f",
    ),
)
def w35(spark, sf):
    df = tb.panel(spark, sf)
    pair = F.when(F.col("ret").isNotNull() & F.col("market").isNotNull(), 1)
    f = fr.ts(26)
    c = F.when(F.count(pair).over(f) >= 13, fr.correlation("ret", "market", f))
    return pick(df, c.alias("corr_26"))


@query(
    "w39_core_reversal",
    out(
        RESIDUAL
        + f""",
q0 AS (SELECT *, CASE WHEN eligible THEN residual END AS s1, CASE WHEN eligible THEN {roll('sum({})', 'residual', ts(3), 2)} END AS s3,
   CASE WHEN eligible THEN {roll('sum({})', 'residual', ts(5), 3)} END AS s5 FROM rs),
q1 AS (SELECT *, {zscore('s1')} AS z1, {zscore('s3')} AS z3, {zscore('s5')} AS z5 FROM q0)""",
        "SELECT session, security_id, -(0.5 * z1 + 0.3 * z3 + 0.2 * z5) AS core, -z3 AS reference FROM q1",
        f"{K} core:f reference:f",
    ),
)
def w39(spark, sf):
    df = ft.core_reversal(tb.residual_panel(spark, sf), ((1, 1), (3, 2), (5, 3)), tb.shape(spark, sf).wide)
    return pick(df, "core", "reference")


ADV = roll("median({})", "close * volume", ts(26), 13)


@query(
    "w40_liquidity_rank",
    out(
        RETURNS + f", ad AS (SELECT *, round({ADV}, 6) AS adv FROM rets)",
        """SELECT session, security_id, adv, CASE WHEN adv IS NOT NULL THEN rank() OVER (PARTITION BY session_idx ORDER BY adv DESC NULLS LAST) END AS liquidity_rank,
        coalesce(rank() OVER (PARTITION BY session_idx ORDER BY adv DESC NULLS LAST) <= 40 AND adv IS NOT NULL, false) AS liquid FROM ad""",
        f"{K} adv:f liquidity_rank:i liquid:b",
    ),
)
def w40(spark, sf):
    df = tb.returns(spark, sf)
    df = df.withColumn("adv", fr.snap(fr.roll(fr.median, F.col("close") * F.col("volume"), fr.ts(26), 13), 6))
    df = fr.xs_min_rank(df, "adv", "liquidity_rank", wide=tb.shape(spark, sf).wide)
    return pick(df, "adv", "liquidity_rank", fr.truth(F.col("liquidity_rank") <= 40).alias("liquid"))


@query(
    "w41_side_rank",
    out(
        RESIDUAL + """, sr AS (SELECT *, CAST(sign(residual) AS INTEGER) AS side, abs(residual) AS size FROM rs)""",
        f"SELECT session, security_id, CASE WHEN side <> 0 THEN side * (0.5 + 0.5 * ({pct_rank('size', 'session_idx, side')})) ELSE 0.0 END AS side_rank FROM sr",
        f"{K} side_rank:f",
    ).replace("ELSE 0.0 END AS side_rank", "ELSE 0.0 END AS side_rank"),
)
def w41(spark, sf):
    return pick(ft.side_rank(tb.residual_panel(spark, sf), "residual", "side_rank", tb.shape(spark, sf).wide), "side_rank")


PROJECT_SQL = """
pj0 AS (SELECT *, CASE WHEN score IS NOT NULL AND beta IS NOT NULL AND sector IS NOT NULL THEN score END AS s_,
  CASE WHEN score IS NOT NULL AND beta IS NOT NULL AND sector IS NOT NULL THEN beta END AS b_ FROM {src}),
pj1 AS (SELECT *, s_ - avg(s_) OVER g AS ds, b_ - avg(b_) OVER g AS db FROM pj0 WINDOW g AS (PARTITION BY {by}, sector)),
{dst} AS (SELECT *, ds - CASE WHEN sum(db * db) OVER x > 1e-18 THEN sum(ds * db) OVER x / sum(db * db) OVER x ELSE 0.0 END * db AS projected
  FROM pj1 WINDOW x AS (PARTITION BY {by}))"""


@query(
    "w42_sector_demeaned_projection",
    out(
        RESIDUAL + f", sc AS (SELECT *, {pct_rank('residual')} - 0.5 AS score FROM rs)," + PROJECT_SQL.format(src="sc", dst="pj", by="session_idx"),
        "SELECT session, security_id, projected FROM pj", f"{K} projected:f",
    ),
)
def w42(spark, sf):
    wide = tb.shape(spark, sf).wide
    df = fr.xs_rank(tb.residual_panel(spark, sf), "residual", "p", wide=wide).withColumn("score", F.col("p") - 0.5)
    return pick(ft.sector_projection(df, "score", "beta", "projected", wide=wide), "projected")
