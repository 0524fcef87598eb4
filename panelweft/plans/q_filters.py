"""Sequential filters, pair signals, orthogonal families and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweft.functions import frames as fr
from panelweft.operators import features as ft
from panelweft.operators import folds as fo
from panelweft.operators import regimes as rg
from panelweft.operators import reports as rp
from panelweft.plans.q_features import _W8, FAMILIES, K, KEYS, LIBRARY_SQL, library, pick, symmetric, SYM_SQL
from panelweft.plans.registry import finish, out, query
from panelweft.plans.sqlbase import PANEL, RESEARCH, at, peer, roll, ts, tsp, zscore
from panelweft.sources import tables as tb

_KAL = """
kin AS (SELECT s.security_id, c.session_idx, p.ret, p.market FROM (SELECT DISTINCT security_id FROM {src}) s CROSS JOIN cal c
  LEFT JOIN {src} p ON p.security_id = s.security_id AND p.session_idx = c.session_idx),
kal AS (
  SELECT security_id, CAST(-1 AS BIGINT) AS session_idx, CAST(1 AS DOUBLE) AS beta, CAST(1 AS DOUBLE) AS p, 0 AS n,
    CAST(NULL AS DOUBLE) AS kalman_beta, CAST(NULL AS DOUBLE) AS innovation FROM (SELECT DISTINCT security_id FROM kin)
  UNION ALL
  SELECT k.security_id, i.session_idx,
    CASE WHEN i.ret IS NOT NULL AND i.market IS NOT NULL THEN k.beta + (k.p + {q}) * i.market / ({r} + (k.p + {q}) * i.market * i.market) * (i.ret - k.beta * i.market) ELSE k.beta END,
    CASE WHEN i.ret IS NOT NULL AND i.market IS NOT NULL THEN (k.p + {q}) * (1 - (k.p + {q}) * i.market / ({r} + (k.p + {q}) * i.market * i.market) * i.market) ELSE k.p + {q} END,
    CASE WHEN i.ret IS NOT NULL AND i.market IS NOT NULL THEN k.n + 1 ELSE k.n END,
    k.beta,
    CASE WHEN i.ret IS NOT NULL AND i.market IS NOT NULL AND k.n >= {w} THEN i.ret - k.beta * i.market END
  FROM kal k JOIN kin i ON i.security_id = k.security_id AND i.session_idx = k.session_idx + 1)"""

KCFG = fo.KalmanSettings(1e-5, 1e-4, 13)


def kalman(spark, sf):
    return fo.kalman_prior(tb.research_panel(spark, sf), "ret", "market", KCFG, names=tb.shape(spark, sf).names)


@query(
    "w19_kalman_prior",
    out(
        PANEL + "," + _KAL.format(src="panel", q=1e-5, r=1e-4, w=13),
        "SELECT r.session, r.security_id, k.kalman_beta, k.innovation FROM rets r JOIN kal k USING (security_id, session_idx)",
        f"{K} kalman_beta:f innovation:f",
    ),
)
def w19(spark, sf):
    df = fo.kalman_prior(tb.panel(spark, sf), "ret", "market", KCFG, names=tb.shape(spark, sf).names)
    first = F.lit(tb.shape(spark, sf).first)
    return pick(df.withColumn("session", F.date_add(first, F.col("session_idx") * 7)), "kalman_beta", "innovation")


@query(
    "w09_equity_features",
    out(
        _W8 + "," + _KAL.format(src="ep", q=1e-5, r=1e-4, w=13)
        + f""",
n0 AS (SELECT t.*, k.innovation, CASE WHEN t.eligible THEN k.innovation END AS ki,
   greatest(0.0, least(5.0, t.volume / nullif({roll('median({})', 't.volume', tsp(26, 't.security_id', 't.session_idx'), 13)}, 0))) AS sur0
   FROM two t LEFT JOIN kal k USING (security_id, session_idx)),
n1 AS (SELECT *, {roll('median({})', 'volume', tsp(26), 13)} AS nv, {peer('ki')} AS kp, {roll('sum({})', 'residual2', ts(3), 2)} AS rv FROM n0),
n2 AS (SELECT *, CASE WHEN eligible THEN -rv END AS a0, CASE WHEN eligible THEN -(innovation - kp) END AS b0,
   CASE WHEN eligible AND nv > 0 THEN -residual2 * sur0 / nullif(vol, 0) END AS c0 FROM n1)""",
        f"""SELECT session, security_id, {zscore('a0')} AS residual_reversal, {zscore('b0')} AS kalman_innovation, {zscore('c0')} AS dislocation FROM n2""",
        f"{K} residual_reversal:f kalman_innovation:f dislocation:f",
    ),
)
def w09(spark, sf):
    df = ft.equity_features(
        tb.research_panel(spark, sf), kalman(spark, sf), (26, 13), (26, 13), (3, 2), (26, 13),
        wide=tb.shape(spark, sf).wide,
    )
    return pick(df, "residual_reversal", "kalman_innovation", "dislocation")


# Adaptive filter as SQL recursion over sessions; {key} names the state key columns.
_AKAL = """
akal AS (
  SELECT {key}, CAST(-1 AS BIGINT) AS session_idx, CAST(1 AS DOUBLE) AS beta, CAST(1 AS DOUBLE) AS p, CAST(1e-4 AS DOUBLE) AS r, 0 AS n,
    CAST(NULL AS DOUBLE) AS signal, CAST(NULL AS DOUBLE) AS beta_prior, CAST(NULL AS DOUBLE) AS q_prior, CAST(NULL AS DOUBLE) AS r_prior
  FROM (SELECT DISTINCT {key} FROM akin)
  UNION ALL
  SELECT {keyp}, session_idx,
    CASE WHEN u THEN beta + p1 * x / (r + p1 * x * x) * err ELSE beta END,
    CASE WHEN u THEN least(10.0, greatest(1e-8, p1 * (1 - p1 * x / (r + p1 * x * x) * x))) ELSE p1 END,
    CASE WHEN u THEN greatest((1 - {alpha}) * r + {alpha} * err * err, 1e-8) ELSE r END,
    CASE WHEN u THEN n + 1 ELSE n END,
    CASE WHEN u AND n >= {w} THEN -err / sqrt(r + p1 * x * x) END, beta, q, r
  FROM (SELECT *, y - beta * x AS err, y IS NOT NULL AND x IS NOT NULL AS u, least(10.0, greatest(1e-8, p + q)) AS p1 FROM (
    SELECT {keyk}, i.session_idx, i.y, i.x, k.beta, k.p, k.r, k.n,
      CASE WHEN i.x_var IS NULL THEN 1e-5 ELSE least(1e-2, greatest(1e-7, 1e-4 * k.r / greatest(i.x_var, 1e-8) *
        CASE WHEN i.x_fast IS NOT NULL AND i.x_slow > 0 THEN least(2.0, greatest(0.5, i.x_fast / i.x_slow)) ELSE 1.0 END)) END AS q
    FROM akal k JOIN akin i ON {on} AND i.session_idx = k.session_idx + 1)))"""

ALPHA = 1 - 0.5 ** (1 / 20.0)
ACFG = fo.AdaptiveSettings(warmup=13)


@query(
    "w19_adaptive_kalman",
    out(
        RESEARCH
        + f""",
mseries AS (SELECT c.session_idx, m.market AS x, {roll('var_samp({})', 'm.market', '(ORDER BY c.session_idx RANGE BETWEEN 26 PRECEDING AND 1 PRECEDING)', 13)} AS x_var,
   {roll('stddev_samp({})', 'm.market', '(ORDER BY c.session_idx RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)', 6)} AS x_fast,
   {roll('stddev_samp({})', 'm.market', '(ORDER BY c.session_idx RANGE BETWEEN 26 PRECEDING AND 1 PRECEDING)', 13)} AS x_slow
   FROM cal c LEFT JOIN mkt m USING (session_idx)),
akin AS (SELECT s.security_id, m.*, p.ret AS y FROM (SELECT DISTINCT security_id FROM ep) s CROSS JOIN mseries m
  LEFT JOIN ep p ON p.security_id = s.security_id AND p.session_idx = m.session_idx),"""
        + _AKAL.format(key="security_id", keyp="security_id", keyk="k.security_id", on="i.security_id = k.security_id", w=13, alpha=ALPHA),
        "SELECT security_id, session_idx, signal, beta_prior, q_prior, r_prior FROM akal WHERE session_idx >= 0",
        "security_id:s session_idx:i signal:f beta_prior:f q_prior:f r_prior:f",
    ),
)
def w19a(spark, sf):
    sh = tb.shape(spark, sf)
    r = tb.returns(spark, sf)
    series = tb.calendar(spark, sf).select("session_idx").join(tb.market_series(tb.priced(spark, sf)), "session_idx", "left")
    series = fo.regime_inputs(series, "market", (), (26, 13), (8, 6), (26, 13))
    grid = tb.on_calendar(r.select("security_id", "session_idx", "ret"), sh.sessions)
    grid = tb.attach(grid, series, "session_idx", sh.sessions)
    df = fo.adaptive_kalman(grid, "ret", "market", ACFG, names=sh.names)
    return finish(df.select("security_id", "session_idx", "signal", "beta_prior", "q_prior", "r_prior"))


@query(
    "w20_pair_scores",
    out(
        RESEARCH
        + f""",
prs AS (SELECT CAST(s_suppkey AS VARCHAR) AS left_id, CAST(s_suppkey + 1 AS VARCHAR) AS right_id FROM supplier
   WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)),
pk AS (SELECT p.*, c.session_idx, a.ret AS y, b.ret AS x, ln(a.close) - ln(b.close) AS log_ratio FROM prs p CROSS JOIN cal c
   LEFT JOIN ep a ON a.security_id = p.left_id AND a.session_idx = c.session_idx
   LEFT JOIN ep b ON b.security_id = p.right_id AND b.session_idx = c.session_idx),
akin AS (SELECT *, {roll('var_samp({})', 'x', tsp(26, 'left_id'), 13)} AS x_var, {roll('stddev_samp({})', 'x', tsp(8, 'left_id'), 6)} AS x_fast,
   {roll('stddev_samp({})', 'x', tsp(26, 'left_id'), 13)} AS x_slow FROM pk),"""
        + _AKAL.format(key="left_id, right_id", keyp="left_id, right_id", keyk="k.left_id, k.right_id", on="i.left_id = k.left_id", w=13, alpha=ALPHA)
        + f""",
rz AS (SELECT left_id, right_id, session_idx, log_ratio, {roll('avg({})', 'log_ratio', tsp(26, 'left_id'), 13)} AS m, {roll('stddev_samp({})', 'log_ratio', tsp(26, 'left_id'), 13)} AS s FROM pk),
sg AS (SELECT a.left_id, a.right_id, a.session_idx, a.signal AS kalman, CASE WHEN z.s > 0 AND z.log_ratio IS NOT NULL THEN greatest(-3, least(3, -(z.log_ratio - z.m) / z.s)) END AS ratio
   FROM akal a JOIN rz z USING (left_id, right_id, session_idx) WHERE a.session_idx >= 0),
lg AS (SELECT session_idx, left_id AS security_id, kalman, ratio FROM sg UNION ALL SELECT session_idx, right_id, -kalman, -ratio FROM sg)""",
        "SELECT session_idx, security_id, avg(kalman) AS kalman_value, avg(ratio) AS ratio_value FROM lg GROUP BY 1, 2",
        "session_idx:i security_id:s kalman_value:f ratio_value:f",
    ),
)
def w20(spark, sf):
    key = ["left_id", "right_id"]
    grid = pair_grid(spark, sf, tb.returns(spark, sf).select("security_id", "session_idx", "ret", "close"))
    grid = fo.regime_inputs(grid, "x", key, (26, 13), (8, 6), (26, 13))
    grid = grid.withColumn("ratio_value", fo.pair_ratio_signal(grid, 26, 13, key))
    kal = fo.adaptive_kalman(grid, "y", "x", ACFG, by=key, names=tb.shape(spark, sf).names).select(*key, "session_idx", F.col("signal").alias("kalman_value"))
    both = grid.select(*key, "session_idx", "ratio_value").join(kal, [*key, "session_idx"])
    return finish(fo.net_pair_scores(both, ["kalman_value", "ratio_value"]))


def pair_grid(spark, sf, r):
    """Neighbouring suppliers as pairs: the returns of both legs and the log price ratio on every session."""
    ids = tb.table(spark, sf, "supplier").select("s_suppkey")
    pairs = ids.join(ids.select((F.col("s_suppkey") - 1).alias("s_suppkey")), "s_suppkey", "left_semi").select(
        F.col("s_suppkey").cast("string").alias("left_id"), (F.col("s_suppkey") + 1).cast("string").alias("right_id")
    )
    left = r.select(F.col("security_id").alias("left_id"), "session_idx", F.col("ret").alias("y"), F.ln("close").alias("__a"))
    right = r.select(F.col("security_id").alias("right_id"), "session_idx", F.col("ret").alias("x"), F.ln("close").alias("__b"))
    grid = pairs.withColumn("session_idx", F.explode(F.sequence(F.lit(0), F.lit(tb.shape(spark, sf).sessions - 1))))
    grid = grid.join(left, ["left_id", "session_idx"], "left").join(right, ["right_id", "session_idx"], "left")
    return grid.withColumn("log_ratio", F.col("__a") - F.col("__b"))


@query(
    "c10_pair_removal",
    out(
        RESEARCH
        + f""",
prs AS (SELECT CAST(s_suppkey AS VARCHAR) AS left_id, CAST(s_suppkey + 1 AS VARCHAR) AS right_id FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)),
pk AS (SELECT p.*, c.session_idx, ln(a.close) - ln(b.close) AS log_ratio FROM prs p CROSS JOIN cal c LEFT JOIN ep a ON a.security_id = p.left_id AND a.session_idx = c.session_idx LEFT JOIN ep b ON b.security_id = p.right_id AND b.session_idx = c.session_idx),
rz AS (SELECT left_id, right_id, session_idx, log_ratio, {roll('avg({})', 'log_ratio', tsp(26, 'left_id'), 13)} AS m, {roll('stddev_samp({})', 'log_ratio', tsp(26, 'left_id'), 13)} AS s FROM pk),
sg AS (SELECT left_id, right_id, session_idx, CASE WHEN s > 0 AND log_ratio IS NOT NULL THEN greatest(-3, least(3, -(log_ratio - m) / s)) END AS ratio FROM rz),
nx AS (SELECT security_id, session_idx - 1 AS session_idx, ret AS nxt FROM rets WHERE ret IS NOT NULL),
lg AS (SELECT l.*, nxt FROM (SELECT session_idx, left_id, right_id, left_id AS security_id, ratio FROM sg UNION ALL SELECT session_idx, left_id, right_id, right_id, -ratio FROM sg) l JOIN nx USING (security_id, session_idx) WHERE ratio IS NOT NULL),
sc AS (SELECT p.left_id, p.right_id, l.session_idx, l.security_id, avg(l.ratio) AS score, max(l.nxt) AS nxt FROM (SELECT DISTINCT left_id, right_id FROM lg) p JOIN lg l ON l.left_id <> p.left_id GROUP BY 1, 2, 3, 4),
bk AS (SELECT left_id, right_id, session_idx, sum(score * nxt) / sum(abs(score)) AS r FROM sc GROUP BY 1, 2, 3 HAVING sum(abs(score)) > 1e-9)""",
        "SELECT left_id, right_id, count(*) AS sessions, avg(r) * 52 AS mean, avg(r) * sqrt(52) / stddev_samp(r) AS sharpe, product(1 + r) - 1 AS total_return, product(1 + r) > 1 AS passed FROM bk GROUP BY 1, 2",
        "left_id:s right_id:s sessions:i mean:f sharpe:f total_return:f passed:b",
    ),
)
def c10_pairs(spark, sf):
    """The relative-value book without each of its pairs."""
    r = tb.returns(spark, sf).select("security_id", "session_idx", "ret", "close")
    grid = pair_grid(spark, sf, r)
    grid = grid.withColumn("ratio_value", fo.pair_ratio_signal(grid, 26, 13, ["left_id", "right_id"]))
    legs = grid.select("left_id", "right_id", "session_idx", F.explode(F.array(
        F.struct(F.col("left_id").alias("security_id"), F.col("ratio_value").alias("signal")), F.struct(F.col("right_id").alias("security_id"), (-F.col("ratio_value")).alias("signal")),
    )).alias("l")).select("left_id", "right_id", "session_idx", "l.*")
    nxt = r.select("security_id", (F.col("session_idx") - 1).alias("session_idx"), F.col("ret").alias("next"))
    got = rp.leave_one_out(legs, nxt, ["left_id", "right_id"], 52.0)
    return finish(got.withColumn("passed", F.col("total_return") > 0))


_FOUR = ["reversal_1", "momentum_26_4", "intraday_reversal", "high_52"]


def _gs_sql(fams, minimum):
    x = "OVER (PARTITION BY session_idx)"
    ok = "eligible AND " + " AND ".join(f"{f} IS NOT NULL" for f in fams)
    t = [f"gs AS (SELECT session, session_idx, security_id, {', '.join(fams)}, ({ok}) AND sum(CASE WHEN {ok} THEN 1 ELSE 0 END) {x} >= {minimum} AS live0 FROM lib)"]
    src, basis = "gs", []
    for k, f in enumerate(fams):
        def proj(v):
            return f"{v} - avg({v}) {x}" + "".join(
                f" - CASE WHEN sum({q} * {q}) {x} > 1e-12 THEN sum({v} * {q}) {x} / sum({q} * {q}) {x} ELSE 0.0 END * {q}" for q in basis)
        t.append(f"gv{k} AS (SELECT *, CASE WHEN live{k} THEN {f} END AS v{k} FROM {src})")
        t.append(f"gr{k} AS (SELECT *, {proj(f'v{k}')} AS r{k} FROM gv{k})")
        t.append(f"gz{k} AS (SELECT *, live{k} AND coalesce(stddev_samp(r{k}) {x} > 1e-12, false) AS live{k + 1}, "
                 f"CASE WHEN live{k} AND stddev_samp(r{k}) {x} > 1e-12 THEN greatest(-3, least(3, (r{k} - avg(r{k}) {x}) / stddev_samp(r{k}) {x})) END AS z{k} FROM gr{k})")
        t.append(f"gq{k} AS (SELECT *, {proj(f'z{k}')} AS q{k} FROM gz{k})")
        basis.append(f"q{k}")
        src = f"gq{k}"
    return ",\n".join(t), src


_GS, _GS_LAST = _gs_sql(_FOUR, 15)


@query(
    "w26_orthogonalize",
    out(LIBRARY_SQL + "," + _GS,
        f"SELECT session, security_id, {', '.join(f'z{k} AS {f}' for k, f in enumerate(_FOUR))} FROM {_GS_LAST}",
        f"{K} " + " ".join(f"{f}:f" for f in _FOUR)),
)
def w26(spark, sf):
    df = fo.orthogonalise(library(spark, sf), _FOUR, 15, wide=tb.shape(spark, sf).wide)
    return pick(df, *_FOUR)


_D = 0.5 ** (1 / 3.0)


@query(
    "w29_ewm",
    out(
        PANEL + f""",
ek AS (SELECT security_id, session_idx, session, ret, row_number() OVER (PARTITION BY security_id ORDER BY session_idx) AS rn FROM panel),
ew AS (
  SELECT security_id, session_idx, session, rn, ret AS y, CASE WHEN ret IS NOT NULL THEN session_idx END AS last FROM ek WHERE rn = 1
  UNION ALL
  SELECT k.security_id, k.session_idx, k.session, k.rn,
    CASE WHEN k.ret IS NULL THEN e.y WHEN e.y IS NULL THEN k.ret
      ELSE (pow({_D}, k.session_idx - e.last) * e.y + {1 - _D} * k.ret) / (pow({_D}, k.session_idx - e.last) + {1 - _D}) END,
    CASE WHEN k.ret IS NOT NULL THEN k.session_idx ELSE e.last END
  FROM ew e JOIN ek k ON k.security_id = e.security_id AND k.rn = e.rn + 1)""",
        "SELECT session, security_id, y AS ewm FROM ew", f"{K} ewm:f",
    ),
)
def w29(spark, sf):
    df = fo.ewm_mean(tb.returns(spark, sf), "ret", 3.0, names=tb.shape(spark, sf).names)
    first = F.lit(tb.shape(spark, sf).first)
    return pick(df.withColumn("session", F.date_add(first, F.col("session_idx") * 7)), "ewm")


# --- regimes ---------------------------------------------------------------------------

_S = "(ORDER BY session_idx RANGE BETWEEN {} PRECEDING AND {})"


def _st(n):
    return f"(ORDER BY session_idx RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _sp(n):
    return f"(ORDER BY session_idx RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _sat(col, k):
    return f"first_value({col}) OVER (ORDER BY session_idx RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)"


TRAIN_END = 178  # half of the weekly calendar

REGIME_SQL = (
    RESEARCH
    + f""",
dv AS (SELECT session_idx, median(rel) AS liquidity FROM (SELECT session_idx, close * volume / nullif({roll('median({})', 'close * volume', ts(26), 13)}, 0) AS rel FROM ep) GROUP BY 1),
g0 AS (SELECT m.session_idx, m.market, d.liquidity, exp(sum(ln(1 + coalesce(market, 0))) OVER (ORDER BY m.session_idx)) AS level FROM mkt m LEFT JOIN dv d USING (session_idx)),
g1 AS (SELECT *, ({roll('stddev_samp({})', 'market', _st(13), 6)}) * sqrt(52.0) AS realized, level / max(level) OVER (ORDER BY session_idx) - 1 AS drawdown FROM g0),
g2 AS (SELECT *, {roll('quantile_cont({}, 0.8)', 'realized', _sp(52), 13)} AS p80, {roll('quantile_cont({}, 0.95)', 'realized', _sp(52), 13)} AS p95,
  {roll('quantile_cont({}, 0.7)', 'realized', _sp(52), 13)} AS p70, {roll('avg({})', 'level', _st(40), 20)} AS average, level / {_sat('level', 52)} - 1 AS change,
  level / {roll('max({})', 'level', _st(52), 26)} - 1 AS dd52, realized / nullif({roll('median({})', 'realized', _st(52), 13)}, 0) AS vr FROM g1),
g3 AS (SELECT *, CASE WHEN coalesce(realized > p95, false) OR drawdown <= -0.15 THEN 0.4 WHEN coalesce(realized > p80, false) OR drawdown <= -0.10 THEN 0.7 ELSE 1.0 END AS risk_scaler,
  {_sat('dd52', 1)} AS lag_drawdown, {_sat('realized', 1)} AS lag_vol, coalesce(level < average AND change < 0 AND realized > p70, false) AS risk_off,
  coalesce({_sat('vr', 1)}, 1.0) AS volatility_ratio, coalesce({_sat('liquidity', 1)}, 1.0) AS liquidity_ratio, coalesce({_sat('drawdown', 1)}, 0.0) AS prior_drawdown FROM g2),
g4 AS (SELECT *, quantile_cont(lag_vol, 0.9) FILTER (WHERE session_idx <= {TRAIN_END}) OVER () AS q0, quantile_cont(lag_vol, 0.975) FILTER (WHERE session_idx <= {TRAIN_END}) OVER () AS q1 FROM g3),
rgm AS (SELECT *, CASE WHEN coalesce(lag_drawdown <= -0.20, false) OR coalesce(lag_vol >= q1, false) THEN 0.5
    WHEN coalesce(lag_drawdown <= -0.10, false) OR coalesce(lag_vol >= q0, false) THEN 0.75 ELSE 1.0 END AS stress_scaler,
  least(4.0, greatest(1.0, greatest(volatility_ratio, 1.0) * greatest(1.0 / liquidity_ratio, 1.0) * CASE WHEN prior_drawdown <= -0.10 THEN 1.5 ELSE 1.0 END)) AS transaction_multiplier,
  least(3.0, greatest(1.0, greatest(volatility_ratio, 1.0) * CASE WHEN prior_drawdown <= -0.10 THEN 1.5 ELSE 1.0 END)) AS borrow_multiplier,
  CASE WHEN lag_vol IS NOT NULL THEN CAST((SELECT count(*) FROM g3 z WHERE z.session_idx <= {TRAIN_END} AND z.lag_vol <= g4.lag_vol) AS DOUBLE) / (SELECT count(lag_vol) FROM g3 WHERE session_idx <= {TRAIN_END}) END AS vol_pct
  FROM g4)"""
)


def regimes(spark, sf):
    """One row per session with every regime column."""
    sh = tb.shape(spark, sf)
    r = tb.bars(spark, sf).select("security_id", "session_idx", (F.col("close") * F.col("volume")).alias("__dollar"))
    r = fr.rolling_quantiles(r, {"__usual": ("__dollar", 0.5)}, -25, 0, 13)
    names = r.select("session_idx", fr.ratio(F.col("__dollar"), fr.positive(F.col("__usual"))).alias("__rel"))
    if sh.wide:
        names = fr.xs_quantile(names, "__rel", "__med", 0.5, wide=True)
        liq = names.groupBy("session_idx").agg(F.max("__med").alias("liquidity"))
    else:
        liq = names.groupBy("session_idx").agg(F.percentile("__rel", F.lit(0.5)).alias("liquidity"))
    s = tb.market_series(tb.priced(spark, sf)).join(liq, "session_idx", "left")
    s = rg.realised(rg.market_level(s), (13, 6), 52.0)
    s = rg.three_step_scaler(s, (52, 13))
    s = rg.train_quantile_scaler(s, TRAIN_END, (52, 26))
    s = rg.risk_off_rule(s, (40, 20), 52, (52, 13))
    s = rg.state_cost_multipliers(s, (52, 13))
    return rg.train_cdf(s, "lag_vol", TRAIN_END, "vol_pct")


_RG = ["risk_scaler", "stress_scaler", "volatility_ratio", "liquidity_ratio", "prior_drawdown", "transaction_multiplier", "borrow_multiplier"]


@query(
    "w16_regime_scalers",
    out(
        REGIME_SQL,
        f"""SELECT session_idx, {', '.join(_RG)}, risk_off, CASE WHEN vol_pct IS NULL THEN NULL WHEN vol_pct <= 0.8 THEN 1.0 WHEN vol_pct <= 0.95 THEN 1 - (vol_pct - 0.8) / 0.15 * 0.5
          WHEN vol_pct <= 0.99 THEN 0.5 - (vol_pct - 0.95) / 0.04 * 0.25 ELSE 0.25 END AS stress_gross,
        CASE WHEN vol_pct IS NULL THEN 0.0 ELSE least(1.0, greatest(0.35, (0.8 + 0.3 * vol_pct) * CASE WHEN prior_drawdown >= -0.05 THEN 0.8
          WHEN prior_drawdown >= -0.10 THEN 0.8 + (-prior_drawdown - 0.05) / 0.05 * 0.2 WHEN prior_drawdown >= -0.15 THEN 1.0 + (-prior_drawdown - 0.10) / 0.05 * (-0.6) ELSE 0.4 END)) END AS mild_gross,
        CASE WHEN vol_pct IS NULL THEN 0.0 ELSE least(0.9, greatest(0.25, (0.7 + 0.3 * vol_pct) * CASE WHEN prior_drawdown >= -0.05 THEN 0.7
          WHEN prior_drawdown >= -0.10 THEN 0.7 + (-prior_drawdown - 0.05) / 0.05 * 0.2 WHEN prior_drawdown >= -0.15 THEN 0.9 + (-prior_drawdown - 0.10) / 0.05 * (-0.65) ELSE 0.25 END)) END AS defensive_gross,
        0.75 + 0.5 * vol_pct AS vol_mild, 0.5 + vol_pct AS vol_strong, CASE WHEN vol_pct IS NOT NULL THEN least(1.3, greatest(0.7, 0.6 + 0.8 * vol_pct)) END AS vol_capped
        FROM rgm""",
        "session_idx:i " + " ".join(f"{c}:f" for c in _RG) + " risk_off:b stress_gross:f mild_gross:f defensive_gross:f vol_mild:f vol_strong:f vol_capped:f",
    ),
)
def w16(spark, sf):
    s = regimes(spark, sf)
    return finish(
        s.select(
            "session_idx", *_RG, "risk_off",
            rg.stress_scalar(F.col("vol_pct")).alias("stress_gross"),
            *(rg.gross_scalar(F.col("vol_pct"), F.col("prior_drawdown"), m).alias(f"{m}_gross") for m in ("mild", "defensive")),
            *(rg.residual_vol_multiplier(F.col("vol_pct"), m).alias(f"vol_{m}") for m in ("mild", "strong", "capped")),
        )
    )


@query(
    "p12_symmetric_position",
    out(SYM_SQL, """SELECT session, security_id, CASE WHEN coalesce(abs(z_score) > threshold AND sign(z_score) = sign(trend_strength), false) THEN tanh(z_score) ELSE 0.0 END AS position
        FROM sym WHERE z_score IS NOT NULL""", f"{K} position:f"),
)
def p12(spark, sf):
    df = symmetric(spark, sf).where(F.col("z_score").isNotNull())
    return pick(df, ft.symmetric_position(F.col("z_score"), F.col("threshold"), F.col("trend_strength")).alias("position"))


def _with_regime(spark, sf, df):
    return tb.attach(df, regimes(spark, sf).select("session_idx", "risk_off", "prior_drawdown"), "session_idx", tb.shape(spark, sf).sessions)


@query(
    "p13_short_multiplier",
    out(
        REGIME_SQL,
        """SELECT e.session, e.security_id, e.ret * CASE WHEN coalesce(e.ret < 0, false) AND NOT g.risk_off THEN 0.5 ELSE 1.0 END AS score,
        CASE WHEN g.risk_off THEN 0.5 ELSE 1.0 END AS long_cap, CASE WHEN g.risk_off THEN 1.0 ELSE 0.25 END AS short_cap
        FROM ep e JOIN rgm g USING (session_idx)""",
        f"{K} score:f long_cap:f short_cap:f",
    ),
)
def p13(spark, sf):
    df = _with_regime(spark, sf, tb.returns(spark, sf)).where(F.col("risk_off").isNotNull())
    lo, sh = rg.side_scalers(F.col("risk_off"))
    return pick(df, rg.short_multiplier(F.col("ret"), F.col("risk_off")).alias("score"), lo.alias("long_cap"), sh.alias("short_cap"))


@query(
    "p14_adaptive_exposure",
    out(
        REGIME_SQL,
        """SELECT e.session, e.security_id, CASE WHEN e.ret IS NULL THEN NULL WHEN NOT g.risk_off THEN greatest(e.ret, 0.0)
        ELSE greatest(e.ret, 0.0) * CASE WHEN e.sector IN ('ASIA', 'AMERICA') THEN 0.4 ELSE 1.0 END + least(e.ret, 0.0) * 0.5 END AS exposure
        FROM ep e JOIN rgm g USING (session_idx)""",
        f"{K} exposure:f",
    ),
)
def p14(spark, sf):
    df = _with_regime(spark, sf, tb.returns(spark, sf)).where(F.col("risk_off").isNotNull())
    growth = F.col("sector").isin("ASIA", "AMERICA")
    return pick(df, rg.adaptive_exposure(F.col("ret"), F.col("risk_off"), growth).alias("exposure"))


@query(
    "p15_drawdown_regime",
    out(
        REGIME_SQL + f", dd AS (SELECT session_idx, {_sat('drawdown', 1)} AS pd FROM rgm)",
        """SELECT session_idx, CASE WHEN pd < -0.10 THEN 'stress_below_10pct' WHEN pd <= -0.05 THEN 'correction_5_to_10pct' ELSE 'normal_above_5pct' END AS select_label,
        CASE WHEN pd <= -0.15 THEN 'stress_below_15pct' WHEN pd <= -0.05 THEN 'drawdown_5_to_15pct' WHEN pd IS NOT NULL THEN 'normal_above_5pct' END AS cut_label FROM dd""",
        "session_idx:i select_label:s cut_label:s",
    ),
)
def p15(spark, sf):
    s = regimes(spark, sf).withColumn("pd", fr.at("drawdown", -1, ()))
    return finish(s.select("session_idx", rg.drawdown_label(F.col("pd")).alias("select_label"), rg.drawdown_label(F.col("pd"), "cut").alias("cut_label")))


@query(
    "p16_gross_change_class",
    out(
        RESEARCH + f", gc AS (SELECT session, security_id, volume / {at('volume', -1)} - 1 AS change FROM ep)",
        "SELECT session, security_id, change, CASE WHEN change < -0.10 THEN 'deleveraging' WHEN change > 0.10 THEN 'expansion' ELSE 'normal' END AS label FROM gc",
        f"{K} change:f label:s",
    ),
)
def p16(spark, sf):
    df = tb.bars(spark, sf).withColumn("change", ft.simple_return("volume"))
    return pick(df, "change", rg.gross_change_class(F.col("change")).alias("label"))
