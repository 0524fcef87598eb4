"""Report queries over ledgers, holdings, scores and raw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweft.functions import frames as fr
from panelweft.operators import features as ft
from panelweft.operators import ledger as lg
from panelweft.operators import regimes as rg
from panelweft.operators import reports as rp
from panelweft.operators import research as rs
from panelweft.plans.q_features import CARRY_SQL, DEFENSIVE_SQL, K, OVERLAY_SQL, carry, defensive, overlay, pick
from panelweft.plans.q_filters import _AKAL, ALPHA, REGIME_SQL, regimes, w19a
from panelweft.plans.q_ledger import BOOKS_SQL, BUDGET_TAIL, EVERY, LEDGER_SQL, TARGET_SQL, _STATE_SQL, books, budget_usage, ledger, scenario_ledgers, scenario_sql, state_ledger, targets
from panelweft.plans.q_research import TRAIN_END, _hac_sql
from panelweft.plans.registry import finish, out, query
from panelweft.plans.sqlbase import RESEARCH, RESIDUAL, RETURNS, at, pct_rank, roll, ts, tsp
from panelweft.session import cut
from panelweft.sources import tables as tb

SEGMENTS = [("train", "1995-01-01", "1998-12-31"), ("development", "1999-01-01", "2000-06-30"), ("test", "2000-07-03", "2001-06-30")]
SEG_SQL = "CASE " + " ".join(f"WHEN session BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in SEGMENTS) + " ELSE 'outside' END"

SLEEVE_SQL = (
    RETURNS
    + f""",
sl0 AS (SELECT sector AS experiment, session, session_idx, avg(ret) AS gross_return, CASE WHEN session_idx % 4 = 0 THEN 0.0002 * (1 + session_idx % 3) ELSE 0 END AS transaction_cost,
   0.00002 AS borrow_cost, CASE WHEN session_idx % 4 = 0 THEN 0.3 ELSE 0 END AS turnover, count(*) / 100.0::DOUBLE AS gross, avg(sign(ret)) AS net FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2, 3),
sl AS (SELECT *, gross_return - transaction_cost - borrow_cost AS net_return, {SEG_SQL} AS segment FROM sl0)"""
)


def sleeve_ledger(spark, sf):
    """Equal-weight sector books as a ledger with scheduled trading costs."""
    r = tb.returns(spark, sf).where(F.col("ret").isNotNull())
    trades = F.col("session_idx") % 4 == 0
    d = r.groupBy(F.col("sector").alias("experiment"), "session", "session_idx").agg(
        F.avg("ret").alias("gross_return"), (F.count("*") / 100.0).alias("gross"), F.avg(F.signum("ret")).alias("net")
    )
    d = d.withColumns(
        {
            "transaction_cost": F.when(trades, 0.0002 * (1 + F.col("session_idx") % 3)).otherwise(0.0),
            "borrow_cost": F.lit(0.00002),
            "turnover": F.when(trades, 0.3).otherwise(0.0),
        }
    )
    d = d.withColumn("net_return", F.col("gross_return") - F.col("transaction_cost") - F.col("borrow_cost"))
    return rp.label_segments(d, rp.segments(spark, SEGMENTS))


def perf_sql(src, by, ret="net_return", periods=52.0, dst="pf"):
    w = f"(PARTITION BY {by} ORDER BY session_idx ROWS UNBOUNDED PRECEDING)"
    return f"""
{dst}_0 AS (SELECT *, product(1 + {ret}) OVER {w} AS nav FROM {src} WHERE {ret} IS NOT NULL),
{dst}_1 AS (SELECT *, nav / max(nav) OVER {w} - 1 AS dd FROM {dst}_0),
{dst} AS (SELECT {by}, count(*) AS sessions, product(1 + {ret}) - 1 AS total_return, pow(product(1 + {ret}), {periods} / count(*)) - 1 AS cagr, stddev_samp({ret}) * sqrt({periods}) AS annual_volatility,
   avg({ret}) * {periods} / nullif(stddev_samp({ret}) * sqrt({periods}), 0) AS sharpe, min(dd) AS max_drawdown, avg(CASE WHEN {ret} > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate FROM {dst}_1 GROUP BY {by})"""


_PF = ["total_return", "cagr", "annual_volatility", "sharpe", "max_drawdown", "positive_rate"]
_PFC = "sessions:i " + " ".join(f"{c}:f" for c in _PF)
ES = ["experiment", "segment"]


@query("a01_performance", out(SLEEVE_SQL + "," + perf_sql("sl", "experiment, segment"), f"SELECT experiment, segment, sessions, {', '.join(_PF)} FROM pf", f"experiment:s segment:s {_PFC}"))
def a01(spark, sf):
    return finish(rp.performance(sleeve_ledger(spark, sf), ES, periods=52.0).select(*ES, "sessions", *_PF))


_SEGM = (
    SLEEVE_SQL + "," + perf_sql("sl", "experiment, segment") + "," + perf_sql("sl", "experiment, segment", "gross_return", dst="pg")
    + """,
ss AS (SELECT experiment, segment, avg(turnover) * 52 AS annual_turnover, sum(transaction_cost) AS transaction_cost, sum(borrow_cost) AS borrow_cost, avg(gross) AS average_gross, max(abs(net)) AS max_abs_net FROM sl GROUP BY 1, 2),
yr AS (SELECT experiment, segment, year(session) AS y, product(1 + net_return) - 1 AS r FROM sl GROUP BY 1, 2, 3),
wy AS (SELECT experiment, segment, min(r) AS worst_year FROM yr GROUP BY 1, 2),
sm AS (SELECT p.*, g.sharpe AS gross_sharpe, s.annual_turnover, s.transaction_cost, s.borrow_cost, s.average_gross, s.max_abs_net, w.worst_year FROM pf p JOIN pg g USING (experiment, segment) JOIN ss s USING (experiment, segment) JOIN wy w USING (experiment, segment))"""
)
_SM = ["gross_sharpe", "annual_turnover", "transaction_cost", "borrow_cost", "average_gross", "max_abs_net", "worst_year"]


def seg_metrics(spark, sf):
    return rp.segment_metrics(sleeve_ledger(spark, sf), periods=52.0)


@query("a02_segment_metrics", out(_SEGM, f"SELECT experiment, segment, sessions, sharpe, {', '.join(_SM)} FROM sm", "experiment:s segment:s sessions:i sharpe:f " + " ".join(f"{c}:f" for c in _SM)))
def a02(spark, sf):
    return finish(seg_metrics(spark, sf).select(*ES, "sessions", "sharpe", *_SM))


_Y = ["gross_return", "transaction_cost", "borrow_cost", "net_arithmetic", "net_compounded"]


@query(
    "a03_yearly_tables",
    out(SLEEVE_SQL, """SELECT experiment, year(session) AS year, count(*) AS sessions, sum(gross_return) AS gross_return, sum(transaction_cost) AS transaction_cost, sum(borrow_cost) AS borrow_cost,
        sum(net_return) AS net_arithmetic, product(1 + net_return) - 1 AS net_compounded FROM sl GROUP BY 1, 2""", "experiment:s year:i sessions:i " + " ".join(f"{c}:f" for c in _Y)),
)
def a03(spark, sf):
    return finish(rp.yearly_table(sleeve_ledger(spark, sf)).select("experiment", "year", "sessions", *_Y))


@query("p09_segment_label", out(RETURNS, f"SELECT session, {SEG_SQL} AS segment, count(*) AS rows FROM rets GROUP BY 1, 2", "session:d segment:s rows:i"))
def p09(spark, sf):
    d = tb.bars(spark, sf).groupBy("session").agg(F.count("*").alias("rows"))
    return finish(rp.label_segments(d, rp.segments(spark, SEGMENTS)).select("session", "segment", "rows"))


@query("a46_fixed_regime_table", out(SLEEVE_SQL, "SELECT experiment, segment, sum(gross_return) AS gross, sum(net_return) AS net, sum(turnover) AS turnover FROM sl GROUP BY 1, 2", "experiment:s segment:s gross:f net:f turnover:f"))
def a46(spark, sf):
    return finish(sleeve_ledger(spark, sf).groupBy(*ES).agg(F.sum("gross_return").alias("gross"), F.sum("net_return").alias("net"), F.sum("turnover").alias("turnover")))


# --- books -------------------------------------------------------------------------------

_BM_SQL = (
    BOOKS_SQL
    + """,
ub AS (SELECT experiment, session_idx, 'long' AS book, long_gross_return AS gross_return, long_transaction_cost AS transaction_cost, 0.0 AS borrow_cost, long_net_return AS net_return, long_gross_exposure AS exposure FROM bok
  UNION ALL BY NAME SELECT experiment, session_idx, 'short' AS book, short_gross_return AS gross_return, short_transaction_cost AS transaction_cost, borrow_cost, short_net_return AS net_return, short_gross_exposure AS exposure FROM bok),"""
    + perf_sql("ub", "experiment, book")
    + """,
bm AS (SELECT experiment, book, sum(gross_return) AS gross_contribution, sum(transaction_cost) AS transaction_cost, sum(borrow_cost) AS borrow_cost, sum(net_return) AS net_arithmetic, avg(net_return) * 52 AS expectancy, avg(exposure) AS average_exposure FROM ub GROUP BY 1, 2)"""
)
_BM = ["gross_contribution", "transaction_cost", "borrow_cost", "net_arithmetic", "expectancy", "average_exposure"]


def book_table(spark, sf):
    return rp.book_metrics(rp.unpivot_books(books(spark, sf)), ["experiment", "book"], 52.0)


@query("a19_book_metrics", out(_BM_SQL, f"SELECT experiment, book, {', '.join(_BM)}, p.sessions, p.sharpe, p.max_drawdown FROM bm JOIN pf p USING (experiment, book)",
    "experiment:s book:s " + " ".join(f"{c}:f" for c in _BM) + " sessions:i sharpe:f max_drawdown:f"))
def a19(spark, sf):
    return finish(book_table(spark, sf).select("experiment", "book", *_BM, "sessions", "sharpe", "max_drawdown"))


@query(
    "a22_cost_waterfall",
    out(_BM_SQL, """SELECT experiment, book, gross_contribution * 52.0 / p.sessions AS gross_expectancy, transaction_cost * 52.0 / p.sessions AS transaction_drag, borrow_cost * 52.0 / p.sessions AS borrow_drag,
        (gross_contribution - transaction_cost) * 52.0 / p.sessions AS borrow_free, coalesce((gross_contribution - transaction_cost) > 0 AND expectancy <= 0, false) AS flips_sign FROM bm JOIN pf p USING (experiment, book)""",
        "experiment:s book:s gross_expectancy:f transaction_drag:f borrow_drag:f borrow_free:f flips_sign:b"),
)
def a22(spark, sf):
    return finish(rp.cost_waterfall(book_table(spark, sf), 52.0).select("experiment", "book", "gross_expectancy", "transaction_drag", "borrow_drag", "borrow_free", "flips_sign"))


_STREAMS = ["net_return", "long_net_return", "short_net_return"]
_STREAM_SQL = (
    BOOKS_SQL + ", st0 AS (SELECT b.*, m.market FROM bok b LEFT JOIN mkt m USING (session_idx)), st1 AS (UNPIVOT (SELECT experiment, session_idx, market, net_return, long_net_return, short_net_return FROM st0) ON net_return, long_net_return, short_net_return INTO NAME stream VALUE value)"
)


def streams(spark, sf):
    b = books(spark, sf).select("experiment", "session_idx", *_STREAMS)
    b = tb.attach(b, tb.market_series(tb.priced(spark, sf)), "session_idx", tb.shape(spark, sf).sessions)
    return b.unpivot(["experiment", "session_idx", "market"], _STREAMS, "stream", "value")


@query(
    "a23_stream_stats",
    out(
        _STREAM_SQL
        + """, st2 AS (SELECT *, unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN market > 0 THEN 'market_up' END, CASE WHEN market < 0 THEN 'market_down' END], lambda z: z IS NOT NULL)) AS regime FROM st1)""",
        """SELECT experiment, stream, regime, count(*) AS sessions, sum(value) AS arithmetic, avg(value) * 52 AS expectancy, stddev_samp(value) * sqrt(52.0) AS volatility,
        avg(value) * 52 / nullif(stddev_samp(value) * sqrt(52.0), 0) AS sharpe, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate FROM st2 GROUP BY 1, 2, 3""",
        "experiment:s stream:s regime:s sessions:i arithmetic:f expectancy:f volatility:f sharpe:f positive_rate:f",
    ),
)
def a23(spark, sf):
    rows = rp.masked(streams(spark, sf), {"all": F.lit(True), "market_up": F.col("market") > 0, "market_down": F.col("market") < 0})
    s = rp.stream_stats(rows, ["experiment", "stream", "regime"], periods=52.0)
    return finish(s.select("experiment", "stream", "regime", "sessions", "arithmetic", "expectancy", "volatility", "sharpe", "positive_rate"))


@query(
    "a24_book_beta",
    out(_STREAM_SQL + "," + _hac_sql("st1", "value", "market", "experiment, stream"),
        "SELECT experiment, stream, sessions, market_beta, beta_tstat, r_squared FROM hac", "experiment:s stream:s sessions:i market_beta:f beta_tstat:f r_squared:f", 5),
)
def a24b(spark, sf):
    h = rs.hac_regression(streams(spark, sf), "value", "market", ["experiment", "stream"], periods=52.0)
    return finish(h.select("experiment", "stream", "sessions", "market_beta", "beta_tstat", "r_squared"), 5)


def _hold(spark, sf, led=None):
    led = led or ledger(spark, sf)
    h = lg.attribute_pnl(led.held)
    first = F.lit(tb.shape(spark, sf).first)
    h = h.withColumn("year", F.year(F.date_add(first, F.col("session_idx") * 7)).cast("string"))
    return h.join(tb.assets(spark, sf), "security_id", "left").withColumn("leg", F.when(F.col("weight") > 0, "long").otherwise("short"))


_CT_SQL = (
    LEDGER_SQL
    + """,
ct AS (SELECT h.experiment, h.session_idx, h.security_id, a.sector, a.sleeve, CAST(year(c.session) AS VARCHAR) AS year, CASE WHEN weight > 0 THEN 'long' ELSE 'short' END AS leg, weight, weight * coalesce(ret, 0) AS contribution
   FROM hld h JOIN cal c USING (session_idx) LEFT JOIN assets a USING (security_id)),
cg AS ("""
    + " UNION ALL ".join(
        f"""SELECT experiment, '{d}' AS dimension, {d} AS value, sum(contribution) AS contribution, sum(CASE WHEN weight > 0 THEN contribution ELSE 0 END) AS long_contribution,
        sum(CASE WHEN weight < 0 THEN contribution ELSE 0 END) AS short_contribution, avg(abs(weight)) AS average_weight, count(*) AS rows FROM ct GROUP BY experiment, {d}"""
        for d in ("year", "security_id", "sector", "leg")
    )
    + ")"
)
_DIMS = ["year", "security_id", "sector", "leg"]


def contributions(spark, sf):
    return rp.contribution_sets(_hold(spark, sf), _DIMS)


@query(
    "a20_contribution_tables",
    out(_CT_SQL, "SELECT experiment, dimension, value, contribution, long_contribution, short_contribution, average_weight, rows FROM cg",
        "experiment:s dimension:s value:s contribution:f long_contribution:f short_contribution:f average_weight:f rows:i"),
)
def a20(spark, sf):
    return finish(contributions(spark, sf))


_TOP_SQL = (
    _CT_SQL
    + """,
tn0 AS (SELECT experiment, value, contribution, row_number() OVER (PARTITION BY experiment ORDER BY round(abs(contribution), 12) DESC, value) AS rk, sum(abs(contribution)) OVER (PARTITION BY experiment) AS tot FROM cg WHERE dimension = 'security_id'),
tn AS (SELECT experiment, string_agg(value, ',' ORDER BY rk) AS top_names, sum(abs(contribution)) / max(tot) AS top_share FROM tn0 WHERE rk <= 5 GROUP BY 1)"""
)


@query("t03_top_contributors", out(_TOP_SQL, "SELECT experiment, top_names, top_share FROM tn", "experiment:s top_names:s top_share:f"))
def t03(spark, sf):
    totals = _hold(spark, sf).groupBy("experiment", F.col("security_id").alias("value")).agg(F.sum("contribution").alias("contribution"))
    return finish(rp.concentration(totals, ["experiment"]).select("experiment", "top_names", "top_share"))


@query(
    "t04_largest_fraction",
    out(
        _CT_SQL + ", tf AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY round(contribution, 12) DESC, value) AS rank, count(*) OVER (PARTITION BY experiment) AS n FROM cg WHERE dimension = 'security_id')",
        "SELECT experiment, value, contribution, rank FROM tf WHERE rank <= ceil(n * 0.05)", "experiment:s value:s contribution:f rank:i",
    ),
)
def t04(spark, sf):
    totals = _hold(spark, sf).groupBy("experiment", F.col("security_id").alias("value")).agg(F.sum("contribution").alias("contribution"))
    return finish(rp.top_fraction(totals, ["experiment"], "contribution", "value").select("experiment", "value", "contribution", "rank"))


@query(
    "a21_candidate_diagnostics",
    out(
        _TOP_SQL
        + ", dn AS (SELECT *, 'all' AS segment FROM dly),"
        + perf_sql("dn", "experiment")
        + """, lb AS (SELECT d.experiment, regr_slope(d.net_return, m.market) AS market_beta, max(d.gross) AS max_gross, avg(d.turnover) * 52 AS annual_turnover FROM dly d LEFT JOIN mkt m USING (session_idx) GROUP BY 1)""",
        "SELECT p.experiment, p.sessions, p.sharpe, p.max_drawdown, l.market_beta, l.max_gross, l.annual_turnover, t.top_share FROM pf p JOIN lb l USING (experiment) JOIN tn t USING (experiment)",
        "experiment:s sessions:i sharpe:f max_drawdown:f market_beta:f max_gross:f annual_turnover:f top_share:f",
    ),
)
def a21(spark, sf):
    led = ledger(spark, sf)
    perf = rp.performance(led.daily, ["experiment"], periods=52.0)
    m = tb.attach(led.daily, tb.market_series(tb.priced(spark, sf)), "session_idx", tb.shape(spark, sf).sessions)
    beta = m.groupBy("experiment").agg(
        F.regr_slope(F.col("net_return"), F.col("market")).alias("market_beta"), F.max("gross").alias("max_gross"), (F.avg("turnover") * 52).alias("annual_turnover")
    )
    totals = _hold(spark, sf, led).groupBy("experiment", F.col("security_id").alias("value")).agg(F.sum("contribution").alias("contribution"))
    top = rp.concentration(totals, ["experiment"]).select("experiment", "top_share")
    got = perf.join(beta, "experiment").join(top, "experiment")
    return finish(got.select("experiment", "sessions", "sharpe", "max_drawdown", "market_beta", "max_gross", "annual_turnover", "top_share"))


_DIAG_SQL = (
    BOOKS_SQL + "," + BUDGET_TAIL
    + f""",
dsg AS (SELECT d.*, c.session, {SEG_SQL} AS segment, m.market FROM dly d JOIN cal c USING (session_idx) LEFT JOIN mkt m USING (session_idx)),"""
    + perf_sql("dsg", "experiment, segment") + "," + perf_sql("dsg", "experiment, segment", "gross_return", dst="pg")
    + """,
dco AS (SELECT experiment, segment, sum(turnover) * 52 / count(*) AS annual_turnover, sum(transaction_cost) * 52 / count(*) AS annual_transaction_cost, sum(borrow_cost) * 52 / count(*) AS annual_borrow_cost, avg(gross) AS average_gross, max(gross) AS maximum_gross,
   max_by(session_idx, struct_pack(a := round(gross, 9), b := -session_idx)) AS maximum_gross_session, max(abs(net)) AS maximum_abs_net, regr_slope(net_return, market) AS market_beta, regr_r2(net_return, market) AS r_squared FROM dsg GROUP BY 1, 2),
dbk AS (SELECT experiment, segment, sum(long_net_return) AS long_contribution, sum(short_net_return) AS short_contribution, avg(short_net_return) * 52 AS short_expectancy, avg(long_gross_exposure) AS average_long_exposure, avg(short_gross_exposure) AS average_short_exposure
   FROM bok JOIN (SELECT experiment, session_idx, segment FROM dsg) USING (experiment, session_idx) GROUP BY 1, 2),
dnm AS (SELECT h.experiment, segment, h.security_id, a.sleeve, sum(weight * coalesce(ret, 0)) AS c FROM hld h JOIN (SELECT experiment, session_idx, segment FROM dsg) USING (experiment, session_idx) LEFT JOIN assets a ON a.security_id = h.security_id GROUP BY 1, 2, 3, 4),
dtp AS (SELECT *, row_number() OVER (PARTITION BY experiment, segment ORDER BY abs(round(c, 12)) DESC, security_id) AS k FROM dnm),
dsh AS (SELECT experiment, segment, sum(abs(c)) FILTER (k <= 5) / sum(abs(c)) AS top_share, list(security_id ORDER BY k) FILTER (k <= 5) AS top_names FROM dtp GROUP BY 1, 2),
dps AS (SELECT experiment, segment, count(*) FILTER (round(c, 12) > 0) AS positive_sleeves FROM (SELECT experiment, segment, sleeve, sum(c) AS c FROM dnm GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
)
_DG = ["cagr", "max_drawdown", "gross_sharpe", "gross_cagr", "annual_turnover", "annual_transaction_cost", "annual_borrow_cost", "average_gross", "maximum_gross", "maximum_abs_net", "market_beta", "r_squared", "long_contribution", "short_contribution", "short_expectancy", "average_long_exposure", "average_short_exposure", "top_share"]


def _segmented(spark, sf, df):
    cal = tb.calendar(spark, sf)
    dated = df if "session" in df.columns else tb.attach(df, cal, "session_idx", tb.shape(spark, sf).sessions)
    return rp.label_segments(dated, rp.segments(spark, SEGMENTS))


@query(
    "a21_segment_diagnostics",
    out(
        _DIAG_SQL,
        """SELECT p.experiment, p.segment, p.sessions, p.sharpe, p.cagr, p.max_drawdown, g.sharpe AS gross_sharpe, g.cagr AS gross_cagr, c.* EXCLUDE (experiment, segment), b.* EXCLUDE (experiment, segment), h.top_share, h.top_names, s.positive_sleeves
        FROM pf p JOIN pg g USING (experiment, segment) JOIN dco c USING (experiment, segment) LEFT JOIN dbk b USING (experiment, segment) LEFT JOIN dsh h USING (experiment, segment) LEFT JOIN dps s USING (experiment, segment)""",
        "experiment:s segment:s sessions:i sharpe:f maximum_gross_session:i top_names:a positive_sleeves:i " + " ".join(f"{c}:f" for c in _DG),
    ),
)
def a21_segments(spark, sf):
    """Performance, costs, books, concentration and market beta of each book in each segment."""
    led = ledger(spark, sf)
    daily, held = cut(_segmented(spark, sf, led.daily)), lg.attribute_pnl(led.held)
    tags = daily.select("experiment", "session_idx", "segment")
    b = books(spark, sf, led).join(tags, ["experiment", "session_idx"])
    h = held.join(tags, ["experiment", "session_idx"]).join(tb.assets(spark, sf).select("security_id", "sleeve"), "security_id", "left")
    market = tb.market_series(tb.priced(spark, sf))
    d = rp.segment_diagnostics(daily, b, h, market, periods=52.0)
    return finish(d.select("experiment", "segment", "sessions", "sharpe", "maximum_gross_session", "top_names", "positive_sleeves", *_DG))


@query(
    "a21_budget_maxima",
    out(
        _DIAG_SQL,
        f"""SELECT experiment, segment, kind, name, count(*) AS rebalances, max(usage) AS maximum_usage, max_by(session_idx, struct_pack(a := round(usage, 9), b := -session_idx)) AS at_session, max(excess) AS maximum_excess,
        sum(CASE WHEN effective_cap > cap THEN 1 ELSE 0 END) AS relaxed FROM (SELECT b.*, {SEG_SQL} AS segment FROM bu b JOIN cal USING (session_idx)) GROUP BY 1, 2, 3, 4""",
        "experiment:s segment:s kind:s name:s rebalances:i maximum_usage:f at_session:i maximum_excess:f relaxed:i",
    ),
)
def a21_budgets(spark, sf):
    """The largest usage of every budget in each segment, and the rebalance that it falls on."""
    m = rp.budget_maxima(_segmented(spark, sf, budget_usage(spark, sf)))
    return finish(m.select("experiment", "segment", "kind", "name", "rebalances", "maximum_usage", "at_session", "maximum_excess", "relaxed"))


#: The security whose sessions are the market reference.
BENCHMARK = "7"


@query(
    "a25_market_reference",
    out(
        RETURNS + f""", ms AS (SELECT c.session_idx, c.session, b.close FROM cal c LEFT JOIN bars b ON b.security_id = '{BENCHMARK}' AND b.session_idx = c.session_idx),
        mr AS (SELECT session, close / first_value(close) OVER (ORDER BY session_idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS market_return,
          first_value(close) OVER (ORDER BY session_idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) / max(close) OVER (ORDER BY session_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS prior_drawdown FROM ms)""",
        "SELECT session, market_return, prior_drawdown, market_return IS NOT NULL AND prior_drawdown IS NOT NULL AS covered FROM mr",
        "session:d market_return:f prior_drawdown:f covered:b",
    ),
)
def a25(spark, sf):
    """One-session returns of the benchmark on every calendar session; sessions it doesn't cover are marked."""
    own = tb.bars(spark, sf).where(F.col("security_id") == BENCHMARK).select("session_idx", "close")
    return finish(rp.market_reference(tb.calendar(spark, sf), own))


_IE_SQL = (
    _STATE_SQL
    + """,
ie0 AS (SELECT h.experiment, h.session_idx, sum(abs(h.weight * (1 + coalesce(h.ret, 0)) / (1 + d.net_return))) AS gross_before FROM hld h JOIN dly d USING (experiment, session_idx) GROUP BY 1, 2),
ie AS (SELECT i.*, d.session_idx AS execution_idx, d.gross AS gross_after, (d.gross - i.gross_before) / nullif(i.gross_before, 0) AS gross_change, d.turnover, d.transaction_cost AS baseline_cost, d.transaction_cost * g.transaction_multiplier AS state_cost,
   d.net_return AS execution_return, g.transaction_multiplier FROM ie0 i JOIN dly d ON d.experiment = i.experiment AND d.block = i.session_idx AND d.session_idx = i.session_idx + 1 LEFT JOIN rgm g ON g.session_idx = d.session_idx),
ix AS (SELECT *, CASE WHEN gross_change < -0.10 THEN 'deleveraging' WHEN gross_change > 0.10 THEN 'expansion' ELSE 'normal' END AS state, CASE WHEN gross_change < 0 THEN 'reduction' ELSE 'non_reduction' END AS direction FROM ie),
iy AS (SELECT *, 'threshold_state' AS grouping, state AS grp FROM ix UNION ALL SELECT *, 'gross_direction' AS grouping, direction AS grp FROM ix)"""
)


def interactions(spark, sf):
    led = ledger(spark, sf)
    return rp.interaction_events(led.held, led.daily, state_ledger(spark, sf, led), regimes(spark, sf))


@query("a26_interaction_events", out(_IE_SQL, "SELECT experiment, session_idx, gross_before, gross_after, gross_change, turnover, baseline_cost, state_cost, transaction_multiplier, state FROM ix",
    "experiment:s session_idx:i gross_before:f gross_after:f gross_change:f turnover:f baseline_cost:f state_cost:f transaction_multiplier:f state:s"))
def a26(spark, sf):
    return finish(interactions(spark, sf).select("experiment", "session_idx", "gross_before", "gross_after", "gross_change", "turnover", "baseline_cost", "state_cost", "transaction_multiplier", "state"))


_IS = ["mean_gross_change", "mean_multiplier", "p95_multiplier", "mean_turnover", "baseline_cost", "state_cost", "incremental_cost", "execution_return"]


@query(
    "a27_interaction_summary",
    out(_IE_SQL, """SELECT experiment, grouping, grp AS "group", count(*) AS events, avg(gross_change) AS mean_gross_change, avg(transaction_multiplier) AS mean_multiplier, quantile_cont(transaction_multiplier, 0.95) AS p95_multiplier,
        avg(turnover) AS mean_turnover, sum(baseline_cost) AS baseline_cost, sum(state_cost) AS state_cost, sum(state_cost - baseline_cost) AS incremental_cost, sum(execution_return) AS execution_return FROM iy GROUP BY 1, 2, 3""",
        "experiment:s grouping:s group:s events:i " + " ".join(f"{c}:f" for c in _IS)).replace("CAST(group AS VARCHAR) AS group", 'CAST("group" AS VARCHAR) AS "group"').replace("CAST(grouping AS VARCHAR) AS grouping", 'CAST("grouping" AS VARCHAR) AS "grouping"').replace("'threshold_state' AS grouping", "'threshold_state' AS \"grouping\"").replace("'gross_direction' AS grouping", "'gross_direction' AS \"grouping\"").replace("SELECT experiment, grouping,", 'SELECT experiment, "grouping",'),
)
def a27(spark, sf):
    return finish(rp.interaction_summary(interactions(spark, sf)).select("experiment", "grouping", "group", "events", *_IS))


@query(
    "a27_interaction_correlation",
    out(
        _IE_SQL + f", ir AS (SELECT experiment, gross_change, transaction_multiplier, {pct_rank('round(gross_change, 9)', 'experiment')} AS a, {pct_rank('round(transaction_multiplier, 9)', 'experiment')} AS b FROM ix WHERE gross_change IS NOT NULL AND transaction_multiplier IS NOT NULL)",
        "SELECT experiment, corr(gross_change, transaction_multiplier) AS pearson, corr(a, b) AS spearman, regr_slope(transaction_multiplier, gross_change) AS ols_slope FROM ir GROUP BY 1",
        "experiment:s pearson:f spearman:f ols_slope:f",
    ),
)
def a27c(spark, sf):
    e = interactions(spark, sf)
    ic = rs.daily_ic(e, "gross_change", "transaction_multiplier", ["experiment"])
    sl = e.groupBy("experiment").agg(F.regr_slope(F.col("transaction_multiplier"), F.col("gross_change")).alias("ols_slope"))
    return finish(ic.join(sl, "experiment").select("experiment", F.col("ic").alias("pearson"), F.col("rank_ic").alias("spearman"), "ols_slope"))


@query(
    "a28_bucket_pnl",
    out(
        LEDGER_SQL
        + f""", bq0 AS (SELECT h.experiment, h.session_idx, h.weight * coalesce(h.ret, 0) AS contribution, round(s.vol, 9) AS v FROM hld h JOIN scd0 s ON s.security_id = h.security_id AND s.session_idx = h.session_idx WHERE s.vol IS NOT NULL),
        bq AS (SELECT *, ceil(5 * ({pct_rank('v', 'experiment, session_idx')}) - 1e-12) AS bucket FROM bq0)""",
        "SELECT experiment, bucket, sum(contribution) AS contribution, count(*) AS rows FROM bq GROUP BY 1, 2", "experiment:s bucket:i contribution:f rows:i",
    ),
)
def a28(spark, sf):
    h = lg.attribute_pnl(ledger(spark, sf).held)
    v = tb.research_panel(spark, sf).where(F.col("vol").isNotNull()).select("security_id", "session_idx", fr.snap("vol", 9).alias("v"))
    h = fr.xs_rank(h.join(v, ["security_id", "session_idx"]), "v", "p", ("experiment", "session_idx"), tb.shape(spark, sf).wide)
    h = h.withColumn("bucket", F.ceil(5 * F.col("p") - 1e-12))
    return finish(h.groupBy("experiment", "bucket").agg(F.sum("contribution").alias("contribution"), F.count("*").alias("rows")))


@query(
    "a29_regime_attribution",
    out(
        LEDGER_SQL
        + f""", dp AS (SELECT session_idx, stddev_samp(residual) AS dispersion FROM rs GROUP BY 1),
        dq AS (SELECT session_idx, first_value(dispersion) OVER (ORDER BY session_idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS pd FROM dp),
        dc AS (SELECT quantile_cont(pd, 1.0/3) AS a, quantile_cont(pd, 2.0/3) AS b FROM dq WHERE session_idx <= {TRAIN_END}),
        dr AS (SELECT session_idx, CASE WHEN pd IS NULL THEN NULL WHEN pd <= a THEN 'low' WHEN pd <= b THEN 'middle' ELSE 'high' END AS regime FROM dq, dc)""",
        "SELECT experiment, regime, count(*) AS sessions, avg(net_return) * 1e4 AS net_bps, avg(d.gross_return) * 1e4 AS gross_bps, avg(transaction_cost + borrow_cost) * 1e4 AS cost_bps FROM dly d JOIN dr USING (session_idx) WHERE regime IS NOT NULL GROUP BY 1, 2",
        "experiment:s regime:s sessions:i net_bps:f gross_bps:f cost_bps:f", 5,
    ),
)
def a29(spark, sf):
    s = ft.prior_dispersion(tb.residual_panel(spark, sf))
    train = F.when(F.col("session_idx") <= TRAIN_END, F.col("prior_dispersion"))
    s = s.withColumns({"a": F.percentile(train, F.lit(1.0 / 3)).over(rg.ts_all()), "b": F.percentile(train, F.lit(2.0 / 3)).over(rg.ts_all())})
    p = F.col("prior_dispersion")
    s = s.where(p.isNotNull()).select("session_idx", F.when(p <= F.col("a"), "low").when(p <= F.col("b"), "middle").otherwise("high").alias("regime"))
    d = tb.attach(ledger(spark, sf).daily, s, "session_idx", tb.shape(spark, sf).sessions, "inner")
    return finish(
        d.groupBy("experiment", "regime").agg(
            F.count("*").alias("sessions"), (F.avg("net_return") * 1e4).alias("net_bps"), (F.avg("gross_return") * 1e4).alias("gross_bps"),
            (F.avg(F.col("transaction_cost") + F.col("borrow_cost")) * 1e4).alias("cost_bps"),
        ), 5,
    )


_EP_SQL = (
    LEDGER_SQL
    + """,
hs0 AS (SELECT *, CASE WHEN lag(session_idx) OVER w = session_idx - 1 AND sign(lag(weight) OVER w) = sign(weight) THEN 0 ELSE 1 END AS brk FROM hld WHERE weight <> 0 WINDOW w AS (PARTITION BY experiment, security_id ORDER BY session_idx)),
hs1 AS (SELECT *, sum(brk) OVER (PARTITION BY experiment, security_id ORDER BY session_idx) AS spell FROM hs0),
epi AS (SELECT experiment, security_id, min(session_idx) AS entry_idx, max(session_idx) + 1 AS exit_idx, count(*) AS sessions, max(sign(weight)) AS side, max(session_idx) + 1 <= (SELECT max(session_idx) FROM cal) AS completed FROM hs1 GROUP BY experiment, security_id, spell)"""
)


def episodes(spark, sf):
    return ft.holding_episodes(ledger(spark, sf).held, tb.shape(spark, sf).sessions - 1)


@query("w32_holding_episodes", out(_EP_SQL, "SELECT experiment, security_id, entry_idx, exit_idx, sessions, side, completed FROM epi", "experiment:s security_id:s entry_idx:i exit_idx:i sessions:i side:i completed:b"))
def w32(spark, sf):
    return finish(episodes(spark, sf).select("experiment", "security_id", "entry_idx", "exit_idx", "sessions", "side", "completed"))


@query(
    "a30_holding_stats",
    out(_EP_SQL, "SELECT e.experiment, year(c.session) AS year, side, avg(sessions) AS mean_sessions, median(sessions) AS median_sessions, count(*) AS spells FROM epi e JOIN cal c ON c.session_idx = e.entry_idx WHERE completed GROUP BY 1, 2, 3",
        "experiment:s year:i side:i mean_sessions:f median_sessions:f spells:i"),
)
def a30(spark, sf):
    first = F.lit(tb.shape(spark, sf).first)
    e = episodes(spark, sf).where("completed").withColumn("year", F.year(F.date_add(first, F.col("entry_idx") * 7)))
    # spell lengths are small integers: the exact median keeps one counter per length
    return finish(e.groupBy("experiment", "year", "side").agg(F.avg("sessions").alias("mean_sessions"), F.percentile("sessions", F.lit(0.5)).alias("median_sessions"), F.count("*").alias("spells")))


@query(
    "a31_exposure_checks",
    out(
        TARGET_SQL
        + """, ec0 AS (SELECT experiment, session_idx, any_value(session) AS session, abs(sum(weight)) AS net, abs(sum(weight * beta)) AS beta, count(*) AS names FROM tgt GROUP BY 1, 2),
        es AS (SELECT experiment, session_idx, max(abs(w)) AS sector FROM (SELECT experiment, session_idx, sector, sum(weight) AS w FROM tgt GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
        "SELECT experiment, year(session) AS year, max(net) AS max_abs_net, max(beta) AS max_abs_beta, max(sector) AS max_abs_sector, avg(names) AS mean_names FROM ec0 JOIN es USING (experiment, session_idx) GROUP BY 1, 2",
        "experiment:s year:i max_abs_net:f max_abs_beta:f max_abs_sector:f mean_names:f",
    ),
)
def a31(spark, sf):
    t = targets(spark, sf)
    by_sector = t.groupBy("experiment", "session_idx", "sector").agg(
        F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("beta")).alias("b"), F.count("*").alias("n"), F.max("session").alias("session")
    )
    s = by_sector.groupBy("experiment", "session_idx").agg(
        F.abs(F.sum("w")).alias("net"), F.abs(F.sum("b")).alias("beta"), F.max(F.abs("w")).alias("sector"), F.sum("n").alias("names"), F.max("session").alias("session")
    )
    return finish(
        s.groupBy("experiment", F.year("session").alias("year")).agg(
            F.max("net").alias("max_abs_net"), F.max("beta").alias("max_abs_beta"), F.max("sector").alias("max_abs_sector"), F.avg("names").alias("mean_names")
        )
    )


@query(
    "a32_neutralization",
    out(
        TARGET_SQL + ", nb AS (SELECT t.experiment, t.session_idx, t.sector, t.weight, t.beta, b.score / sum(abs(b.score)) OVER (PARTITION BY t.experiment, t.session_idx) AS raw FROM tgt t JOIN bk3 b USING (experiment, session_idx, security_id))",
        "SELECT experiment, sector, avg(r) AS raw_exposure, avg(w) AS final_exposure, avg(rb) AS raw_beta, avg(wb) AS final_beta FROM (SELECT experiment, session_idx, sector, sum(raw) AS r, sum(weight) AS w, sum(raw * beta) AS rb, sum(weight * beta) AS wb FROM nb GROUP BY 1, 2, 3) GROUP BY 1, 2",
        "experiment:s sector:s raw_exposure:f final_exposure:f raw_beta:f final_beta:f",
    ),
)
def a32(spark, sf):
    wide = tb.shape(spark, sf).wide
    by = ("experiment", "session_idx")
    t = fr.xs_rank(targets(spark, sf), "score", "p", by, wide)
    ends = F.when(F.col("p") <= F.col("tail"), -1.0).when(F.col("p") >= 1 - F.col("tail"), 1.0).otherwise(0.0)
    t = t.withColumn("ranked", F.when(F.col("tail").isNull(), F.col("p") - 0.5).otherwise(ends))
    t = fr.xs_stats(t, by, wide, g=F.sum(F.abs("ranked"))).withColumn("raw", F.col("ranked") / F.col("g"))
    s = t.groupBy(*by, "sector").agg(
        F.sum("raw").alias("r"), F.sum("weight").alias("w"), F.sum(F.col("raw") * F.col("beta")).alias("rb"), F.sum(F.col("weight") * F.col("beta")).alias("wb")
    )
    return finish(
        s.groupBy("experiment", "sector").agg(F.avg("r").alias("raw_exposure"), F.avg("w").alias("final_exposure"), F.avg("rb").alias("raw_beta"), F.avg("wb").alias("final_beta"))
    )


@query(
    "a33_exposures",
    out(
        TARGET_SQL,
        """SELECT experiment, session_idx, 'beta' AS exposure, sum(weight * beta) AS value FROM tgt GROUP BY 1, 2 UNION ALL SELECT experiment, session_idx, 'vol', sum(weight * vol) FROM tgt GROUP BY 1, 2
        UNION ALL SELECT experiment, session_idx, 'sector:' || sector, sum(weight) FROM tgt GROUP BY 1, 2, 3""",
        "experiment:s session_idx:i exposure:s value:f",
    ),
)
def a33(spark, sf):
    t = targets(spark, sf)
    rows = F.array(
        F.struct(F.lit("beta").alias("exposure"), F.col("beta").alias("loading")), F.struct(F.lit("vol").alias("exposure"), F.col("vol").alias("loading")),
        F.struct(F.concat(F.lit("sector:"), "sector").alias("exposure"), F.lit(1.0).alias("loading")),
    )
    t = t.select("experiment", "session_idx", "weight", F.explode(rows).alias("x"))
    return finish(t.groupBy("experiment", "session_idx", "x.exposure").agg(F.sum(F.col("weight") * F.col("x.loading")).alias("value")))


# --- group covariance ----------------------------------------------------------------------

_GP_SQL = (
    RETURNS
    + f""",
gp AS (SELECT session_idx, sector, avg(ret) AS r FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2),
gc AS (SELECT c.session_idx AS decision, a.sector AS i, b.sector AS j, covar_samp(a.r, b.r) AS covariance, count(*) AS n FROM cal c JOIN gp a ON a.session_idx < c.session_idx AND a.session_idx >= c.session_idx - 60
   JOIN gp b ON b.session_idx = a.session_idx AND a.sector <= b.sector WHERE c.session_idx % {EVERY} = 0 AND c.session_idx >= 60 GROUP BY 1, 2, 3)"""
)


def group_covariance(spark, sf):
    """Prior 60-session covariance of group mean returns at each rebalance."""
    from pyspark.sql import Window

    sh = tb.shape(spark, sf)
    g = tb.returns(spark, sf).where(F.col("ret").isNotNull()).groupBy("session_idx", "sector").agg(F.avg("ret").alias("r"))
    # a handful of groups per session: pairs of groups, not of names
    a = g.select("session_idx", F.col("sector").alias("i"), F.col("r").alias("x"))
    b = g.select("session_idx", F.col("sector").alias("j"), F.col("r").alias("y"))
    p = a.join(b, "session_idx").where("i <= j")
    # a return serves the rebalances within the 60 sessions after it
    first = (F.floor(F.col("session_idx") / EVERY) + 1) * EVERY
    last = F.least(F.col("session_idx") + 60, F.lit(sh.sessions - 1))
    p = p.withColumn("decision", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"), F.lit(EVERY)))))
    return p.where(F.col("decision") >= 60).groupBy("decision", "i", "j").agg(F.covar_samp("x", "y").alias("covariance"), F.count("*").alias("n"))


@query("a35_group_proxy_covariance", out(_GP_SQL, "SELECT decision, i, j, covariance, n FROM gc", "decision:i i:s j:s covariance:f n:i", 9))
def a35(spark, sf):
    return finish(group_covariance(spark, sf).select("decision", "i", "j", "covariance", "n"), 9)


@query(
    "a34_group_risk_contribution",
    out(
        TARGET_SQL
        + """, rw AS (SELECT t.experiment, t.session_idx AS decision, c.session_idx AS day, t.sector, sum(t.weight * coalesce(r.ret, 0)) AS g
          FROM tgt t JOIN cal c ON c.session_idx BETWEEN t.session_idx - 60 AND t.session_idx - 1 LEFT JOIN rets r ON r.security_id = t.security_id AND r.session_idx = c.session_idx
          WHERE t.session_idx >= 60 GROUP BY 1, 2, 3, 4),
        rb AS (SELECT *, sum(g) OVER (PARTITION BY experiment, decision, day) AS b FROM rw)""",
        "SELECT experiment, decision, sector, covar_samp(g, b) / var_samp(b) AS risk_share FROM rb GROUP BY 1, 2, 3 HAVING var_samp(b) > 0", "experiment:s decision:i sector:s risk_share:f",
    ),
)
def a34(spark, sf):
    """Share of each group in the variance of the signed book, held fixed over the 60 sessions before its decision.

    A missing return counts as no move. Sums over the sessions present suffice, as absent ones add nothing.
    """
    from pyspark.sql import Window

    sh = tb.shape(spark, sf)
    r = tb.returns(spark, sf).where(F.col("ret").isNotNull()).select("security_id", "session_idx", "ret")
    first = (F.floor(F.col("session_idx") / EVERY) + 1) * EVERY
    last = F.least(F.col("session_idx") + 60, F.lit(sh.sessions - 1))
    r = r.withColumn("decision", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"), F.lit(EVERY)))))
    w = targets(spark, sf).select("experiment", F.col("session_idx").alias("decision"), "security_id", "sector", "weight").where("decision >= 60")
    g = w.join(r, ["security_id", "decision"]).groupBy("experiment", "decision", "session_idx", "sector").agg(F.sum(F.col("weight") * F.col("ret")).alias("g"))
    # a handful of groups per session
    g = g.withColumn("b", F.sum("g").over(Window.partitionBy("experiment", "decision", "session_idx")))
    own = g.groupBy("experiment", "decision", "sector").agg(F.sum("g").alias("g"), F.sum("b").alias("own_b"), F.sum(F.col("g") * F.col("b")).alias("gb"))
    book = g.groupBy("experiment", "decision", "session_idx").agg(F.first("b").alias("b")).groupBy("experiment", "decision").agg(F.sum("b").alias("b"), F.sum(F.col("b") ** 2).alias("bb"))
    n = 60.0
    j = own.join(book, ["experiment", "decision"]).withColumn("variance", F.col("bb") - F.col("b") ** 2 / n).where("variance > 0")
    return finish(j.select("experiment", "decision", "sector", ((F.col("gb") - F.col("g") * F.col("b") / n) / F.col("variance")).alias("risk_share")))


# --- distributions, selection, gates -----------------------------------------------------------

_QS = [0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0]
_QN = ["q_min", "q_p01", "q_p05", "q_median", "q_p95", "q_p99", "q_max"]


@query(
    "a37_distribution_quantiles",
    out(
        OVERLAY_SQL + ", aq AS (SELECT year(session) AS year, quantile_cont(round(realized, 6), [0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0]) AS q, avg(CASE WHEN multiplier = 1 THEN 1.0 ELSE 0.0 END) AS pass_rate FROM ov GROUP BY 1)",
        "SELECT year, pass_rate, " + ", ".join(f"q[{i + 1}] AS {n}" for i, n in enumerate(_QN)) + " FROM aq",
        "year:i pass_rate:f " + " ".join(f"{n}:f" for n in _QN),
    ),
)
def a37(spark, sf):
    df = overlay(spark, sf).withColumns({"year": F.year("session"), "v": fr.snap("realized", 6)})
    # percentile keeps a counter per distinct rounded value, merged map-side
    g = df.groupBy("year").agg(F.percentile("v", F.array(*[F.lit(q) for q in _QS])).alias("q"), F.avg((F.col("multiplier") == 1).cast("double")).alias("pass_rate"))
    return finish(g.select("year", "pass_rate", *[F.col("q")[i].alias(n) for i, n in enumerate(_QN)]))


@query(
    "a37_multiplier_summary",
    out(REGIME_SQL, "SELECT avg(transaction_multiplier) AS mean, quantile_cont(transaction_multiplier, 0.95) AS p95, max(transaction_multiplier) AS max_value FROM rgm", "mean:f p95:f max_value:f"),
)
def a37m(spark, sf):
    m = F.col("transaction_multiplier")
    return finish(regimes(spark, sf).agg(F.avg(m).alias("mean"), F.percentile(m, F.lit(0.95)).alias("p95"), F.max(m).alias("max_value")))


@query(
    "a38_metric_deltas",
    out(_SEGM, "SELECT a.experiment, a.segment, a.sharpe - b.sharpe AS sharpe_delta, a.max_drawdown - b.max_drawdown AS max_drawdown_delta FROM sm a JOIN sm b ON b.segment = a.segment AND b.experiment = 'ASIA'",
        "experiment:s segment:s sharpe_delta:f max_drawdown_delta:f"),
)
def a38(spark, sf):
    return finish(rp.metric_deltas(seg_metrics(spark, sf), "ASIA", ["sharpe", "max_drawdown"], ["segment"]))


_SEL = _SEGM + ", se AS (SELECT *, sharpe > 0 AND max_drawdown > -0.9 AS eligible FROM sm WHERE segment = 'train')"


@query(
    "a39_selection_table",
    out(
        _SEL + ", sk AS (SELECT *, row_number() OVER (ORDER BY eligible DESC, round(sharpe, 9) DESC NULLS LAST, worst_year DESC NULLS LAST, experiment) AS rank, max(CASE WHEN eligible THEN sharpe END) OVER () AS best FROM se)",
        "SELECT experiment, eligible, rank, rank = 1 AND eligible AS first_eligible, coalesce(experiment = min(CASE WHEN eligible AND sharpe >= best - 0.5 THEN experiment END) OVER (), false) AS near_tie_choice FROM sk",
        "experiment:s eligible:b rank:i first_eligible:b near_tie_choice:b",
    ),
)
def a39(spark, sf):
    m = seg_metrics(spark, sf).where("segment = 'train'").withColumn("eligible", (F.col("sharpe") > 0) & (F.col("max_drawdown") > -0.9))
    order = [F.col("eligible").desc(), fr.snap("sharpe", 9).desc_nulls_last(), F.col("worst_year").desc_nulls_last(), F.col("experiment")]
    a = rp.selection_table(m, order).withColumnRenamed("selected", "first_eligible")
    b = rp.selection_table(m, order, "sharpe", 0.5).select("experiment", F.col("selected").alias("near_tie_choice"))
    return finish(a.join(b, "experiment").select("experiment", "eligible", "rank", "first_eligible", "near_tie_choice"))


@query(
    "t02_multi_key_order",
    out(_SEGM, "SELECT experiment, segment, row_number() OVER (ORDER BY segment, round(sharpe, 9) DESC NULLS LAST, worst_year DESC NULLS LAST, experiment) AS position FROM sm", "experiment:s segment:s position:i"),
)
def t02(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy().orderBy("segment", fr.snap("sharpe", 9).desc_nulls_last(), F.col("worst_year").desc_nulls_last(), "experiment")
    return finish(seg_metrics(spark, sf).select("experiment", "segment", F.row_number().over(w).alias("position")))


RULES = [("sharpe_floor", "sharpe", ">=", 0.5), ("drawdown_limit", "max_drawdown", ">=", -0.2), ("turnover_limit", "annual_turnover", "<=", 10.0), ("worst_year", "worst_year", ">", -0.1)]


@query(
    "p23_gate",
    out(
        _SEGM + ", gt AS (SELECT experiment, segment, list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({m} {o} {b}, false) THEN '{r}' END" for r, m, o, b in RULES) + "], lambda z: z IS NOT NULL) AS failed FROM sm)",
        "SELECT experiment, segment, failed, len(failed) = 0 AS passed FROM gt", "experiment:s segment:s failed:a passed:b",
    ),
)
def p23(spark, sf):
    return finish(rp.gate(seg_metrics(spark, sf), RULES).select("experiment", "segment", "failed", "passed"))


@query(
    "p23_promotion",
    out(
        _SEGM + """, pm AS (SELECT experiment, max(sharpe) FILTER (WHERE segment = 'train') AS ts, max(max_drawdown) FILTER (WHERE segment = 'train') AS td, max(sharpe) FILTER (WHERE segment = 'development') AS vs,
          max(max_drawdown) FILTER (WHERE segment = 'development') AS vd, sum(CASE WHEN segment NOT IN ('train', 'development') THEN sessions ELSE 0 END) AS paper FROM sm GROUP BY 1),
        pr AS (SELECT experiment, list_filter([CASE WHEN NOT coalesce(ts >= 0.5, false) THEN 'TRAIN_SHARPE_BELOW_GATE' END, CASE WHEN NOT coalesce(td >= -0.2, false) THEN 'TRAIN_DRAWDOWN_EXCEEDS_GATE' END,
          CASE WHEN NOT coalesce(vs >= 0.5, false) THEN 'VALIDATION_SHARPE_BELOW_GATE' END, CASE WHEN NOT coalesce(vd >= -0.2, false) THEN 'VALIDATION_DRAWDOWN_EXCEEDS_GATE' END,
          CASE WHEN paper < 42 THEN 'INSUFFICIENT_PROSPECTIVE_PAPER_SESSIONS' END], lambda z: z IS NOT NULL) AS reasons FROM pm)""",
        "SELECT experiment, CASE WHEN len(reasons) = 0 THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, len(reasons) = 0 AS orders_allowed, reasons FROM pr",
        "experiment:s status:s orders_allowed:b reasons:a",
    ),
)
def p23p(spark, sf):
    """Both development segments, and the sessions after them as the paper record."""
    return finish(rp.promotion(seg_metrics(spark, sf), 0.5, 0.2, 42, {"train": "TRAIN", "development": "VALIDATION"}))


@query(
    "a41_distribution_quality",
    out(
        CARRY_SQL + """, dqa AS (SELECT security_id, sector, sum(CASE WHEN yr > 0 THEN 1 ELSE 0 END) AS positive_events, sum(CASE WHEN rejected THEN 1 ELSE 0 END) AS rejected_events FROM carry GROUP BY 1, 2),
        dqs AS (SELECT sector, sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS sessions FROM (SELECT sector, session_idx, count(carry_score) AS n FROM carry GROUP BY 1, 2) GROUP BY 1)""",
        "SELECT sector, count(*) AS assets, sum(CASE WHEN positive_events > 0 THEN 1 ELSE 0 END) AS assets_with_events, sum(positive_events) AS positive_events, sum(rejected_events) AS rejected_events, max(s.sessions) AS cross_section_sessions FROM dqa JOIN dqs s USING (sector) GROUP BY 1",
        "sector:s assets:i assets_with_events:i positive_events:i rejected_events:i cross_section_sessions:i",
    ),
)
def a41(spark, sf):
    df = carry(spark, sf)
    paid = fr.truth((F.col("cash") > 0) & F.col("prior_close").isNotNull())
    a = df.groupBy("security_id", "sector").agg(F.sum(paid.cast("int")).alias("p"), F.sum(F.col("rejected").cast("int")).alias("r"))
    a = a.groupBy("sector").agg(F.count("*").alias("assets"), F.sum((F.col("p") > 0).cast("int")).alias("assets_with_events"), F.sum("p").alias("positive_events"), F.sum("r").alias("rejected_events"))
    s = df.groupBy("sector", "session_idx").agg(F.count("carry_score").alias("n")).groupBy("sector").agg(F.sum((F.col("n") >= 3).cast("int")).alias("cross_section_sessions"))
    return finish(a.join(s, "sector"))


@query("a42_coverage_tables", out(RETURNS, "SELECT security_id, min(session) AS first, max(session) AS last, count(*) AS rows FROM rets GROUP BY 1", "security_id:s first:d last:d rows:i"))
def a42(spark, sf):
    return finish(rp.coverage(tb.weekly(spark, sf), "security_id", "session"))


@query(
    "a47_single_sleeve_table",
    out(SLEEVE_SQL + ", mk AS (SELECT session_idx, sum(ret * volume) / sum(volume) AS market FROM rets WHERE ret IS NOT NULL GROUP BY 1)," + perf_sql("sl", "experiment, segment") + ", cr AS (SELECT experiment, segment, corr(net_return, market) AS c FROM sl LEFT JOIN mk USING (session_idx) GROUP BY 1, 2)",
        "SELECT experiment, segment, sessions, sharpe, total_return, c AS market_correlation FROM pf JOIN cr USING (experiment, segment)",
        "experiment:s segment:s sessions:i sharpe:f total_return:f market_correlation:f"),
)
def a47(spark, sf):
    d = sleeve_ledger(spark, sf)
    perf = rp.performance(d, ES, periods=52.0)
    m = tb.attach(d, tb.market_series(tb.priced(spark, sf)), "session_idx", tb.shape(spark, sf).sessions)
    c = m.groupBy(*ES).agg(fr.correlation("net_return", "market").alias("market_correlation"))
    return finish(perf.join(c, ES).select(*ES, "sessions", "sharpe", "total_return", "market_correlation"))


@query(
    "a47_sleeve_nav",
    out(SLEEVE_SQL, "SELECT experiment, session, product(1 + net_return) OVER (PARTITION BY experiment ORDER BY session_idx) AS nav FROM sl", "experiment:s session:d nav:f"),
)
def a47n(spark, sf):
    d = sleeve_ledger(spark, sf)
    return finish(d.select("experiment", "session", F.exp(F.sum(F.log1p("net_return")).over(fr.ts_upto(("experiment",)))).alias("nav")))


_CM = SLEEVE_SQL + """, cm0 AS (SELECT experiment, avg(net_return) AS m FROM sl WHERE session_idx < 126 GROUP BY 1), cm1 AS (SELECT *, row_number() OVER (ORDER BY round(m, 12) DESC, experiment) AS rn FROM cm0)"""


@query("a48_capped_greedy_mean", out(_CM, "SELECT sum(greatest(least(0.6, 1 - 0.6 * (rn - 1)), 0) * m) AS best_mean, sum(greatest(least(0.6, 1 - 0.6 * (rn - 1)), 0)) AS invested FROM cm1", "best_mean:f invested:f", 9))
def a48(spark, sf):
    m = sleeve_ledger(spark, sf).where("session_idx < 126").groupBy("experiment").agg(F.avg("net_return").alias("m"))
    g = rp.capped_greedy_mean(m.withColumn("one", F.lit(1)), "m", "experiment", ["one"])
    return finish(g.select("best_mean", "invested"), 9)


@query(
    "a49_return_floor_table",
    out(_CM + ", mk AS (SELECT session_idx, sum(ret * volume) / sum(volume) AS market FROM rets WHERE ret IS NOT NULL GROUP BY 1)",
        """SELECT 'market mean' AS floor, avg(market) AS session_mean FROM mk WHERE session_idx < 126 UNION ALL SELECT 'zero', 0.0 UNION ALL SELECT 'equal-weight mean', avg(m) FROM (SELECT session_idx, avg(net_return) AS m FROM sl WHERE session_idx < 126 GROUP BY 1)
        UNION ALL SELECT 'maximum feasible', sum(greatest(least(0.6, 1 - 0.6 * (rn - 1)), 0) * m) FROM cm1""", "floor:s session_mean:f", 9).replace("CAST(floor AS VARCHAR) AS floor", 'CAST("floor" AS VARCHAR) AS "floor"'),
)
def a49(spark, sf):
    d = sleeve_ledger(spark, sf).where("session_idx < 126")
    mk = tb.market_series(tb.priced(spark, sf)).where("session_idx < 126").agg(F.avg("market").alias("session_mean")).withColumn("floor", F.lit("market mean"))
    zero = mk.select(F.lit(0.0).alias("session_mean"), F.lit("zero").alias("floor"))
    eq = d.groupBy("session_idx").agg(F.avg("net_return").alias("m")).agg(F.avg("m").alias("session_mean")).withColumn("floor", F.lit("equal-weight mean"))
    m = d.groupBy("experiment").agg(F.avg("net_return").alias("m")).withColumn("one", F.lit(1))
    top = rp.capped_greedy_mean(m, "m", "experiment", ["one"]).select(F.col("best_mean").alias("session_mean"), F.lit("maximum feasible").alias("floor"))
    return finish(mk.unionByName(zero).unionByName(eq).unionByName(top), 9)


@query("a50_overlay_frequency", out(OVERLAY_SQL, "SELECT multiplier, count(*) AS rows FROM ov GROUP BY 1", "multiplier:f rows:i"))
def a50(spark, sf):
    return finish(overlay(spark, sf).groupBy("multiplier").agg(F.count("*").alias("rows")))


@query(
    "c10_robustness_sweep",
    out(scenario_sql() + "," + perf_sql("dly_s", "experiment"), "SELECT experiment AS scenario, sessions, sharpe, total_return, max_drawdown FROM pf", "scenario:s sessions:i sharpe:f total_return:f max_drawdown:f"),
)
def c10(spark, sf):
    """Costs, delay, rebalance interval and removals, each through targets and ledger of its own."""
    p = rp.performance(scenario_ledgers(spark, sf), ["experiment"], "net_return", 52.0)
    return finish(p.select(F.col("experiment").alias("scenario"), "sessions", "sharpe", "total_return", "max_drawdown"))


@query(
    "c11_order_plan",
    out(
        TARGET_SQL
        + """, op AS (SELECT t.experiment, t.session_idx, t.security_id, t.weight, b.close AS price, CAST(CAST(t.security_id AS BIGINT) % 7 AS DOUBLE) AS shares FROM tgt t JOIN bars b USING (security_id, session_idx))""",
        "SELECT experiment, session_idx, security_id, round_even(weight * 1e7 / price, 0) - shares AS delta FROM op WHERE experiment = 'rank' AND round_even(weight * 1e7 / price, 0) <> shares",
        "experiment:s session_idx:i security_id:s delta:f",
    ),
)
def c11(spark, sf):
    t = targets(spark, sf).select("experiment", "session_idx", "security_id", "weight", F.col("close").alias("price"), (F.col("security_id").cast("bigint") % 7).cast("double").alias("shares"))
    return finish(rp.order_plan(t, 1e7, F.col("experiment") == "rank").select("experiment", "session_idx", "security_id", "delta"))


_PLAN_SQL = (
    TARGET_SQL
    + """, op AS (SELECT t.experiment, t.session_idx, t.security_id, t.weight, CASE WHEN t.session_idx % 12 = 4 AND CAST(t.security_id AS BIGINT) % 9 = 0 THEN NULL WHEN t.session_idx % 20 = 8 AND CAST(t.security_id AS BIGINT) % 11 = 0 THEN 0.0 ELSE b.close END AS price,
      CASE WHEN t.session_idx % 28 = 0 AND CAST(t.security_id AS BIGINT) % 13 = 0 THEN NULL ELSE CAST(CAST(t.security_id AS BIGINT) % 7 AS DOUBLE) END AS shares FROM tgt t JOIN bars b USING (security_id, session_idx)),
    os AS (SELECT experiment, session_idx, count(*) AS names, sum(CASE WHEN NOT coalesce(price > 0, false) OR shares IS NULL THEN 1 ELSE 0 END) AS violations FROM op GROUP BY 1, 2),
    ot AS (SELECT *, CASE WHEN experiment <> 'rank' THEN 'NOT_ALLOWED' WHEN violations > 0 THEN 'REFUSED' ELSE 'READY' END AS status FROM os)"""
)


def plan_book(spark, sf):
    """Targets with marks and holdings, of which some are missing at some rebalances."""
    k, i = F.col("security_id").cast("bigint"), F.col("session_idx")
    price = F.when((i % 12 == 4) & (k % 9 == 0), F.lit(None)).when((i % 20 == 8) & (k % 11 == 0), 0.0).otherwise(F.col("close"))
    shares = F.when((i % 28 == 0) & (k % 13 == 0), F.lit(None)).otherwise((k % 7).cast("double"))
    return targets(spark, sf).select("experiment", "session_idx", "security_id", "weight", price.alias("price"), shares.alias("shares"))


@query("c11_plan_status", out(_PLAN_SQL, "SELECT experiment, session_idx, names, violations, status FROM ot", "experiment:s session_idx:i names:i violations:i status:s"))
def c11_status(spark, sf):
    return finish(rp.plan_status(plan_book(spark, sf), F.col("experiment") == "rank"))


@query(
    "c11_gated_plan",
    out(_PLAN_SQL, "SELECT experiment, session_idx, security_id, round_even(weight * 1e7 / price, 0) - shares AS delta FROM op JOIN ot USING (experiment, session_idx) WHERE status = 'READY' AND round_even(weight * 1e7 / price, 0) <> shares",
        "experiment:s session_idx:i security_id:s delta:f"),
)
def c11_gated(spark, sf):
    """Orders of the books that are allowed and have no row that no order can be made of."""
    return finish(rp.order_plan(plan_book(spark, sf), 1e7, F.col("experiment") == "rank", rp.BOOK).select("experiment", "session_idx", "security_id", "delta"))


@query(
    "c11_order_violations",
    out(
        TARGET_SQL
        + """, ov AS (SELECT t.experiment || '/' || t.session_idx || '/' || t.security_id AS key, CASE WHEN t.session_idx % 8 = 4 AND CAST(t.security_id AS BIGINT) % 9 = 0 THEN NULL WHEN CAST(t.security_id AS BIGINT) % 31 = 0 THEN 0.0 ELSE b.close END AS price
          FROM tgt t JOIN bars b USING (security_id, session_idx) WHERE experiment = 'rank')""",
        "SELECT key, 'price_positive' AS rule FROM ov WHERE NOT coalesce(price > 0, false)", "key:s rule:s",
    ),
)
def c11v(spark, sf):
    k = F.col("security_id").cast("bigint")
    price = F.when((F.col("session_idx") % 8 == 4) & (k % 9 == 0), F.lit(None)).when(k % 31 == 0, 0.0).otherwise(F.col("close"))
    t = targets(spark, sf).withColumn("price", price)
    return finish(rp.order_violations(t, F.concat_ws("/", "experiment", "session_idx", "security_id"), F.col("experiment") == "rank").select("key", "rule"))


@query(
    "c12_shadow_targets",
    out(
        TARGET_SQL + ", sh AS (SELECT *, experiment = 'rank' AS ok, session_idx % 7 AS age FROM tgt)",
        "SELECT experiment, session_idx, security_id, weight, CASE WHEN ok AND age <= 4 THEN weight ELSE 0.0 END AS approved_weight, list_filter([CASE WHEN NOT ok THEN 'PROMOTION_DECISION_REJECTED' END, CASE WHEN age > 4 THEN 'MARKET_DATA_STALE' END], lambda z: z IS NOT NULL) AS reasons FROM sh",
        "experiment:s session_idx:i security_id:s weight:f approved_weight:f reasons:a",
    ),
)
def c12(spark, sf):
    t = rp.shadow_targets(targets(spark, sf), F.col("experiment") == "rank", F.col("session_idx") % 7)
    return finish(t.select("experiment", "session_idx", "security_id", "weight", "approved_weight", "reasons"))


@query(
    "c14_version_comparison",
    out(LEDGER_SQL + "," + perf_sql("dly", "experiment"), "SELECT 'v1' AS version, sessions, sharpe, total_return, CAST(NULL AS DOUBLE) AS max_drawdown FROM pf WHERE experiment = 'rank' UNION ALL SELECT 'v2', sessions, sharpe, total_return, max_drawdown FROM pf WHERE experiment = 'tail'",
        "version:s sessions:i sharpe:f total_return:f max_drawdown:f"),
)
def c14(spark, sf):
    """Results of two versions of the book side by side; the first reports no drawdown."""
    m = rp.performance(ledger(spark, sf).daily, ["experiment"], "net_return", 52.0)
    a = m.where("experiment = 'rank'").select(F.lit("v1").alias("version"), "sessions", "sharpe", "total_return")
    b = m.where("experiment = 'tail'").select(F.lit("v2").alias("version"), "sessions", "sharpe", "total_return", "max_drawdown")
    return finish(a.unionByName(b, allowMissingColumns=True).select("version", "sessions", "sharpe", "total_return", "max_drawdown"))

