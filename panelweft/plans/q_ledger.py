"""Target, cost, ledger and attribution queries."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from panelweft.functions import frames as fr
from panelweft.operators import ledger as lg
from panelweft.operators.quality import hash_dropped
from panelweft.plans.q_features import ADV, PROJECT_SQL
from panelweft.plans.q_filters import REGIME_SQL, regimes
from panelweft.plans.registry import finish, out, query
from panelweft.plans.sqlbase import RESIDUAL, pct_rank, roll, ts
from panelweft.session import cut
from panelweft.sources import tables as tb

EVERY, START, NAV, MIN_NAMES, MAX_NAME = 4, 60, 10_000.0, 20, 0.05
COSTS = lg.Costs()


#: What a ledger reads of the scored panel.
LEDGER_COLS = ("security_id", "session_idx", "sector", "ret", "beta", "vol")


def scored_panel(spark, sf, keep=("security_id", "session", "session_idx", "sector", "sleeve", "close", "volume", "ret", "market", "beta", "vol")):
    """Columns of the residual panel with a reversal score and trailing dollar volume."""
    df = tb.residual_panel(spark, sf).withColumn("score", fr.snap(-fr.roll(F.sum, "residual", fr.ts(3), 2), 9))
    df = df.select(*keep, "score", (F.col("close") * F.col("volume")).alias("__dollar"))
    return fr.rolling_quantiles(df, {"adv": ("__dollar", 0.5)}, -25, 0, 13).drop("__dollar")


def targets(spark, sf, df=None, every=EVERY):
    """Rank and tail books on the rebalance sessions."""
    df = scored_panel(spark, sf) if df is None else df
    df = df.where((F.col("session_idx") % every == 0) & (F.col("session_idx") >= START))
    grid = F.array(
        F.struct(F.lit("rank").alias("experiment"), F.lit(None).cast("double").alias("tail")),
        F.struct(F.lit("tail").alias("experiment"), F.lit(0.2).alias("tail")),
    )
    df = df.withColumn("__e", F.explode(grid)).select("*", "__e.*").drop("__e")
    return lg.neutral_target(
        df, min_names=MIN_NAMES, max_name=MAX_NAME, tail=F.col("tail"), wide=tb.shape(spark, sf).wide
    )


def ledger(spark, sf):
    sh = tb.shape(spark, sf)
    # read by targets, returns and risk: frozen once instead of derived three times
    scored = cut(scored_panel(spark, sf, LEDGER_COLS))
    t = targets(spark, sf, scored).select("experiment", "session_idx", "security_id", "weight")
    returns = scored.select("security_id", "session_idx", "ret")
    risk = scored.select("security_id", "session_idx", "vol", "adv")
    return lg.pnl_ledger(t, returns, risk, sh.sessions - 1, 7, NAV, COSTS)


#: Robustness scenarios of the rank book: sessions between rebalances, sessions by which the score is late, cost multiplier; and
#: of the tail book, whose fraction is scaled.
TAIL = 0.2
SCENARIOS = {
    "base": (EVERY, 0, 1.0, None), "costs_x2": (EVERY, 0, 2.0, None), "signal_delay_1": (EVERY, 1, 1.0, None), "rebalance_10": (10, 0, 1.0, None), "rebalance_21": (21, 0, 1.0, None),
    "drop_deterministic_20pct": (EVERY, 0, 1.0, None), "remove_best_5pct": (EVERY, 0, 1.0, None), "tail_0.8x": (EVERY, 0, 1.0, 0.8 * TAIL), "tail_1.0x": (EVERY, 0, 1.0, TAIL), "tail_1.2x": (EVERY, 0, 1.0, 1.2 * TAIL),
}
BEST = 0.05
#: Sessions whose contributions choose the names that ``remove_best_5pct`` leaves out.
BEST_FROM, BEST_TO = 179, 260


def scenario_ledgers(spark, sf):
    """Daily returns of every scenario, each rebuilt from its own targets through its own costs."""
    sh = tb.shape(spark, sf)
    scored = scored_panel(spark, sf, LEDGER_COLS).withColumn("late", fr.at("score", -1))
    scored = cut(scored.select("security_id", "session_idx", "sector", "ret", "beta", "vol", "adv", "score", "late"))
    returns = scored.select("security_id", "session_idx", "ret")
    risk = scored.select("security_id", "session_idx", "vol", "adv")
    first = scored.where(F.col("session_idx") >= START)

    def run(df, names, costs):
        rows = F.array(*[F.struct(F.lit(n).alias("experiment"), F.lit(SCENARIOS[n][0]).alias("every"), F.lit(SCENARIOS[n][1]).alias("lag"), F.lit(SCENARIOS[n][3]).cast("double").alias("tail")) for n in names])
        df = df.withColumn("__e", F.explode(rows)).select("*", "__e.*").where(F.col("session_idx") % F.col("every") == 0)
        df = df.where((F.col("experiment") != "drop_deterministic_20pct") | ~hash_dropped(F.col("security_id"), full=True))
        df = df.withColumn("score", F.when(F.col("lag") == 1, F.col("late")).otherwise(F.col("score")))
        t = lg.neutral_target(df, min_names=MIN_NAMES, max_name=MAX_NAME, tail=F.col("tail"), wide=sh.wide).select("experiment", "session_idx", "security_id", "weight")
        return lg.pnl_ledger(t, returns, risk, sh.sessions - 1, 7, NAV, costs)

    plain = run(first, [n for n in SCENARIOS if n not in ("costs_x2", "remove_best_5pct")], COSTS)
    dear = run(first, ["costs_x2"], replace(COSTS, multiplier=SCENARIOS["costs_x2"][2]))
    held = plain.held.where((F.col("experiment") == "base") & F.col("session_idx").between(BEST_FROM, BEST_TO))
    gains = lg.attribute_pnl(held).groupBy("security_id").agg(F.sum("contribution").alias("gain"))
    count = max(1, int(BEST * sh.names))
    best = gains.orderBy(fr.snap("gain", 9).desc(), "security_id").limit(count).select("security_id")
    rest = run(first.join(best, "security_id", "left_anti"), ["remove_best_5pct"], COSTS)
    parts = [x.daily.select("experiment", "session_idx", "net_return") for x in (plain, dear, rest)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


TARGET_SQL = (
    RESIDUAL
    + f""",
scd0 AS (SELECT *, round(-({roll('sum({})', 'residual', ts(3), 2)}), 9) AS score, {ADV} AS adv FROM rs),
bk0 AS (SELECT e.experiment, e.tail, s.* FROM scd0 s CROSS JOIN (SELECT 'rank' AS experiment, CAST(NULL AS DOUBLE) AS tail UNION ALL SELECT 'tail', 0.2) e
   WHERE session_idx % {EVERY} = 0 AND session_idx >= {START} AND score IS NOT NULL AND beta IS NOT NULL AND sector IS NOT NULL AND adv > 0),
bk1 AS (SELECT *, count(*) OVER (PARTITION BY experiment, session_idx) AS n, {pct_rank('score', 'experiment, session_idx')} AS p FROM bk0),
bk2 AS (SELECT * EXCLUDE (score), CASE WHEN tail IS NULL THEN p - 0.5 WHEN p <= tail THEN -1.0 WHEN p >= 1 - tail THEN 1.0 ELSE 0.0 END AS score FROM bk1 WHERE n >= {MIN_NAMES}),"""
    + PROJECT_SQL.format(src="bk2", dst="bk3", by="experiment, session_idx")
    + f""",
tgt AS (SELECT experiment, session_idx, session, security_id, sector, beta, vol, adv, projected * least(1.0 / sum(abs(projected)) OVER x, {MAX_NAME} / max(abs(projected)) OVER x) AS weight
   FROM bk3 WINDOW x AS (PARTITION BY experiment, session_idx))"""
)

_LIN = COSTS.linear


def _cost(trade):
    return f"abs({trade}) * {_LIN} + coalesce(abs({trade}) * 0.1 * coalesce(vol, 0) * sqrt(abs({trade}) * {NAV} / CASE WHEN adv > 0 THEN adv END), 0)"


LEDGER_SQL = (
    TARGET_SQL
    + f""",
lastc AS (SELECT max(session_idx) AS last FROM cal),
sch AS (SELECT experiment, block, coalesce(lead(block) OVER w, (SELECT last FROM lastc)) AS until, lag(block) OVER w AS prev FROM (SELECT DISTINCT experiment, session_idx AS block FROM tgt) WINDOW w AS (PARTITION BY experiment ORDER BY block)),
pth0 AS (SELECT t.experiment, t.session_idx AS block, s.until, c.session_idx, t.security_id, t.weight AS w0, r.ret FROM tgt t JOIN sch s ON s.experiment = t.experiment AND s.block = t.session_idx
   JOIN cal c ON c.session_idx > t.session_idx AND c.session_idx <= s.until LEFT JOIN rets r ON r.security_id = t.security_id AND r.session_idx = c.session_idx),
pth AS (SELECT *, w0 * coalesce(product(1 + coalesce(ret, 0)) OVER (PARTITION BY experiment, block, security_id ORDER BY session_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS u FROM pth0),
sms AS (SELECT experiment, block, session_idx, sum(u * coalesce(ret, 0)) AS a, sum(greatest(-u, 0)) * {COSTS.borrow_annual} * 7 / 365 AS b, sum(abs(u)) AS gu, sum(u) AS nu, sum(CASE WHEN ret IS NULL AND u <> 0 THEN 1 ELSE 0 END) AS missing_held FROM pth GROUP BY 1, 2, 3),
bsum AS (SELECT experiment, block, sum(a - b) AS earned FROM sms GROUP BY 1, 2),
trd0 AS (SELECT experiment, block, security_id, sum(drift) AS drift, sum(goal) AS goal FROM (
   SELECT p.experiment, p.until AS block, p.security_id, p.u * (1 + coalesce(p.ret, 0)) AS drift, 0.0 AS goal FROM pth p JOIN sch s ON s.experiment = p.experiment AND s.block = p.until WHERE p.session_idx = p.until
   UNION ALL BY NAME SELECT experiment, session_idx AS block, security_id, 0.0 AS drift, weight AS goal FROM tgt) GROUP BY 1, 2, 3),
trd AS (SELECT t.*, s.vol, s.adv FROM trd0 t LEFT JOIN scd0 s ON s.security_id = t.security_id AND s.session_idx = t.block),
nth AS (SELECT s.experiment, s.block, row_number() OVER (PARTITION BY s.experiment ORDER BY s.block) AS nth, q.earned FROM sch s LEFT JOIN bsum q ON q.experiment = s.experiment AND q.block = s.prev),
cst AS (
  SELECT t.experiment, n.block, n.nth, sum({_cost('t.goal - t.drift')}) AS cost, sum(abs(t.goal - t.drift)) AS turnover FROM nth n JOIN trd t USING (experiment, block) WHERE n.nth = 1 GROUP BY 1, 2, 3
  UNION ALL
  SELECT t.experiment, n.block, n.nth, sum({_cost('(t.goal - t.drift / (1 + n.earned - c.cost))')}) AS cost, sum(abs(t.goal - t.drift / (1 + n.earned - c.cost))) AS turnover
    FROM cst c JOIN nth n ON n.experiment = c.experiment AND n.nth = c.nth + 1 JOIN trd t ON t.experiment = n.experiment AND t.block = n.block GROUP BY 1, 2, 3),
dl0 AS (SELECT s.*, c.cost, c.turnover, s.session_idx = s.block + 1 AS fst, coalesce(sum(a - b) OVER (PARTITION BY s.experiment, s.block ORDER BY s.session_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
   FROM sms s JOIN cst c USING (experiment, block)),
dl1 AS (SELECT *, CASE WHEN fst THEN 1.0 ELSE 1 - cost + run END AS v FROM dl0),
dly0 AS (SELECT experiment, block, session_idx, a / v AS gross_return, CASE WHEN fst THEN cost ELSE 0.0 END AS transaction_cost, b / v AS borrow_cost, gu / v AS gross, nu / v AS net,
   CASE WHEN fst THEN turnover ELSE 0.0 END AS turnover, missing_held, v FROM dl1),
dly AS (SELECT *, gross_return - transaction_cost - borrow_cost AS net_return FROM dly0),
hld AS (SELECT p.experiment, p.session_idx, p.security_id, p.u / d.v AS weight, p.ret FROM pth p JOIN dly d USING (experiment, block, session_idx))"""
)



def scenario_sql():
    """The ledger's oracle over the scenarios; the best names come from a first run of the base alone."""
    books = "(SELECT 'rank' AS experiment, CAST(NULL AS DOUBLE) AS tail UNION ALL SELECT 'tail', 0.2) e"
    every = f"session_idx % {EVERY} = 0"
    dropped = "list_sum(list_transform(string_split(sha256(security_id), ''), lambda z: CASE WHEN z = '' THEN 0 ELSE CAST(concat('0x', z) AS BIGINT) END)) % 5 = 0"
    late = f"at1 AS (SELECT * EXCLUDE (score), score AS plain, first_value(score) OVER (PARTITION BY security_id ORDER BY session_idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS late FROM scd0)"
    own = ["bk0", "bk1", "bk2", "bk3", "pj0", "pj1", "tgt", "lastc", "sch", "pth0", "pth", "sms", "bsum", "trd0", "trd", "nth", "cst", "dl0", "dl1", "dly0", "dly", "hld"]
    shared = LEDGER_SQL[: LEDGER_SQL.index("bk0 AS")]
    body = LEDGER_SQL[LEDGER_SQL.index("bk0 AS") :]
    base = body.replace(books, "(SELECT 'base' AS experiment, CAST(NULL AS DOUBLE) AS tail) e")
    rows = " UNION ALL ".join(f"SELECT '{n}' AS experiment, CAST({'NULL' if t is None else t} AS DOUBLE) AS tail, {e} AS every, {d} AS lag" for n, (e, d, _, t) in SCENARIOS.items())
    again = re.sub(r"\b(" + "|".join(own) + r")\b", r"\1_s", body.replace(books, f"({rows}) e").replace(every, "session_idx % every = 0"))
    again = again.replace("SELECT e.experiment, e.tail, s.* FROM scd0 s", "SELECT * FROM (SELECT e.experiment, e.tail, e.every, CASE WHEN e.lag = 1 THEN late ELSE plain END AS score, s.* FROM at1 s")
    again = again.replace("WHERE session_idx % every = 0", f") WHERE (experiment <> 'drop_deterministic_20pct' OR NOT ({dropped})) AND (experiment <> 'remove_best_5pct' OR security_id NOT IN (SELECT security_id FROM best)) AND session_idx % every = 0")
    twice = "CASE WHEN experiment = 'costs_x2' THEN 2.0 ELSE 1.0 END"
    again = again.replace(f"* {COSTS.borrow_annual} * 7 / 365 AS b", f"* {COSTS.borrow_annual} * 7 / 365 * {twice} AS b")
    again = again.replace("n.nth_s, sum(", f"n.nth_s, {twice.replace('experiment', 't.experiment')} * sum(")
    best = f"""best AS (SELECT security_id FROM (SELECT security_id, sum(weight * coalesce(ret, 0)) AS gain FROM hld WHERE session_idx BETWEEN {BEST_FROM} AND {BEST_TO} GROUP BY 1)
      ORDER BY round(gain, 9) DESC, security_id LIMIT (SELECT greatest(1, CAST(floor({BEST} * count(*)) AS BIGINT)) FROM supplier))"""
    return shared + base + ",\n" + late + ",\n" + best + ",\n" + again


B = "experiment:s session_idx:i"


@query(
    "c06_neutral_target",
    out(TARGET_SQL, "SELECT experiment, session_idx, security_id, weight FROM tgt", f"{B} security_id:s weight:f"),
)
def c06(spark, sf):
    return finish(targets(spark, sf).select("experiment", "session_idx", "security_id", "weight"))


@query(
    "d16_experiment_grid",
    out(
        TARGET_SQL,
        """SELECT experiment, session_idx, count(*) AS names, sum(abs(weight)) AS gross, abs(sum(weight)) < 1e-9 AS dollar_neutral, abs(sum(weight * beta)) < 1e-9 AS beta_neutral, max(abs(weight)) AS largest
        FROM tgt GROUP BY 1, 2""",
        f"{B} names:i gross:f dollar_neutral:b beta_neutral:b largest:f",
    ),
)
def d16(spark, sf):
    t = targets(spark, sf)
    return finish(
        t.groupBy("experiment", "session_idx").agg(
            F.count("*").alias("names"), F.sum(F.abs("weight")).alias("gross"),
            (F.abs(F.sum("weight")) < 1e-9).alias("dollar_neutral"),
            (F.abs(F.sum(F.col("weight") * F.col("beta"))) < 1e-9).alias("beta_neutral"),
            F.max(F.abs("weight")).alias("largest"),
        )
    )


@query(
    "a16_pnl_ledger",
    out(LEDGER_SQL, "SELECT experiment, session_idx, gross_return, transaction_cost, borrow_cost, net_return, gross, net, turnover, missing_held FROM dly",
        f"{B} gross_return:f transaction_cost:f borrow_cost:f net_return:f gross:f net:f turnover:f missing_held:i", 8),
)
def a16(spark, sf):
    d = ledger(spark, sf).daily
    return finish(d.select("experiment", "session_idx", "gross_return", "transaction_cost", "borrow_cost", "net_return", "gross", "net", "turnover", "missing_held"), 8)


@query(
    "a15_attribute_pnl",
    out(LEDGER_SQL, "SELECT experiment, session_idx, security_id, weight, weight * coalesce(ret, 0) AS contribution FROM hld", f"{B} security_id:s weight:f contribution:f", 8),
)
def a15(spark, sf):
    h = lg.attribute_pnl(ledger(spark, sf).held)
    return finish(h.select("experiment", "session_idx", "security_id", "weight", "contribution"), 8)


@query(
    "j17_weights_x_returns",
    out(LEDGER_SQL, """SELECT h.experiment, h.session_idx, sum(h.weight * coalesce(h.ret, 0)) AS contribution, max(abs(0.0)) < 1e-10 AND abs(sum(h.weight * coalesce(h.ret, 0)) - max(d.gross_return)) < 1e-10 AS reconciles
        FROM hld h JOIN dly d USING (experiment, session_idx) GROUP BY 1, 2""", f"{B} contribution:f reconciles:b", 8),
)
def j17(spark, sf):
    led = ledger(spark, sf)
    s = lg.attribute_pnl(led.held).groupBy("experiment", "session_idx").agg(F.sum("contribution").alias("contribution"))
    s = s.join(led.daily.select("experiment", "session_idx", "gross_return"), ["experiment", "session_idx"])
    return finish(s.select("experiment", "session_idx", "contribution", (F.abs(F.col("contribution") - F.col("gross_return")) < 1e-10).alias("reconciles")), 8)


_A14 = ["commission", "spread", "slippage", "impact", "borrow", "transaction", "total"]


@query(
    "a14_estimate_costs",
    out(
        TARGET_SQL,
        f"""SELECT experiment, session_idx, sum(abs(weight)) * 0.5 / 10000 AS commission, sum(abs(weight)) * 2.0 / 10000 AS spread, sum(abs(weight)) * 1.0 / 10000 AS slippage,
        sum(coalesce(abs(weight) * 0.1 * vol * sqrt(abs(weight) * {NAV} / adv), 0)) AS impact, sum(greatest(-weight, 0)) * 0.03 * 7 / 365 AS borrow, 0 AS unpriced,
        sum(abs(weight)) * 3.5 / 10000 + sum(coalesce(abs(weight) * 0.1 * vol * sqrt(abs(weight) * {NAV} / adv), 0)) AS transaction,
        sum(abs(weight)) * 3.5 / 10000 + sum(coalesce(abs(weight) * 0.1 * vol * sqrt(abs(weight) * {NAV} / adv), 0)) + sum(greatest(-weight, 0)) * 0.03 * 7 / 365 AS total
        FROM tgt GROUP BY 1, 2""",
        f"{B} " + " ".join(f"{c}:f" for c in _A14) + " unpriced:i", 8,
    ),
)
def a14(spark, sf):
    t = targets(spark, sf).select("experiment", "session_idx", F.lit(0.0).alias("previous"), F.col("weight").alias("target"), "vol", "adv")
    return finish(lg.estimate_costs(t, NAV, COSTS, 7.0).select("experiment", "session_idx", *_A14, "unpriced"), 8)


def state_ledger(spark, sf, led):
    m = regimes(spark, sf).select("session_idx", "transaction_multiplier", "borrow_multiplier")
    d = tb.attach(led.daily, m, "session_idx", tb.shape(spark, sf).sessions)
    return lg.stress_costs(d, F.col("transaction_multiplier"), F.col("borrow_multiplier"))


# the two oracles share their leading tables
_STATE_SQL = LEDGER_SQL + "," + REGIME_SQL[REGIME_SQL.index("\ndv AS"):]


@query(
    "a17_cost_stress",
    out(
        _STATE_SQL,
        """SELECT d.experiment, d.session_idx, d.gross_return - 2 * d.transaction_cost - d.borrow_cost AS double_cost,
        d.gross_return - d.transaction_cost * g.transaction_multiplier - d.borrow_cost * g.borrow_multiplier AS state_cost
        FROM dly d LEFT JOIN rgm g USING (session_idx)""",
        f"{B} double_cost:f state_cost:f", 8,
    ),
)
def a17(spark, sf):
    led = ledger(spark, sf)
    two = lg.stress_costs(led.daily, F.lit(2.0), F.lit(1.0)).select("experiment", "session_idx", F.col("net_return").alias("double_cost"))
    st = state_ledger(spark, sf, led).select("experiment", "session_idx", F.col("net_return").alias("state_cost"))
    return finish(two.join(st, ["experiment", "session_idx"]), 8)


BOOKS_SQL = (
    LEDGER_SQL
    + """,
ab0 AS (SELECT experiment, session_idx, security_id, sum(w) AS w, sum(r) AS r, sum(pre) AS pre FROM (
   SELECT experiment, session_idx, security_id, weight AS w, coalesce(ret, 0) AS r, 0.0 AS pre FROM hld
   UNION ALL BY NAME SELECT h.experiment, h.session_idx + 1 AS session_idx, h.security_id, 0.0 AS w, 0.0 AS r, h.weight * (1 + coalesce(h.ret, 0)) / (1 + d.net_return) AS pre
     FROM hld h JOIN dly d USING (experiment, session_idx) WHERE EXISTS (SELECT 1 FROM dly e WHERE e.experiment = h.experiment AND e.session_idx = h.session_idx + 1)) GROUP BY 1, 2, 3),
ab1 AS (SELECT experiment, session_idx, sum(CASE WHEN w > 0 THEN w * r ELSE 0 END) AS long_gross_return, sum(CASE WHEN w < 0 THEN w * r ELSE 0 END) AS short_gross_return,
   sum(abs(greatest(w, 0) - greatest(pre, 0))) AS long_turnover, sum(abs(least(w, 0) - least(pre, 0))) AS short_turnover, sum(greatest(w, 0)) AS long_gross_exposure, sum(-least(w, 0)) AS short_gross_exposure FROM ab0 GROUP BY 1, 2),
abk AS (SELECT a.*, d.borrow_cost, d.net_return, d.transaction_cost,
   d.transaction_cost * CASE WHEN long_turnover + short_turnover > 0 THEN long_turnover / (long_turnover + short_turnover) ELSE 0 END AS long_transaction_cost,
   d.transaction_cost * CASE WHEN long_turnover + short_turnover > 0 THEN short_turnover / (long_turnover + short_turnover) ELSE 0 END AS short_transaction_cost FROM ab1 a JOIN dly d USING (experiment, session_idx)),
bok AS (SELECT *, long_gross_return - long_transaction_cost AS long_net_return, short_gross_return - short_transaction_cost - borrow_cost AS short_net_return FROM abk)"""
)
_A18 = ["long_gross_return", "short_gross_return", "long_transaction_cost", "short_transaction_cost", "long_net_return", "short_net_return", "long_gross_exposure", "short_gross_exposure"]


def books(spark, sf, led=None):
    led = led or ledger(spark, sf)
    return lg.book_attribution(led.daily, led.held)


@query(
    "a18_book_attribution",
    out(BOOKS_SQL, f"SELECT experiment, session_idx, {', '.join(_A18)}, abs(long_net_return + short_net_return - net_return) < 1e-10 AS reconciles FROM bok",
        f"{B} " + " ".join(f"{c}:f" for c in _A18) + " reconciles:b"),
)
def a18(spark, sf):
    b = books(spark, sf)
    rec = F.abs(F.col("long_net_return") + F.col("short_net_return") - F.col("net_return")) < 1e-10
    return finish(b.select("experiment", "session_idx", *_A18, rec.alias("reconciles")))


# Caps of the audited budgets: gross 1, names 5%, factors 2%, one sector 30%.
CAPS = [("gross", "all", 1.0), ("net", "all", 0.02), ("long", "all", 0.6), ("short", "all", 0.6), ("name", "all", 0.05), ("factor", "beta", 0.02), ("factor", "size", 0.5)]


@query(
    "c09_budget_audit",
    out(
        TARGET_SQL
        + """,
u0 AS (SELECT experiment, session_idx, sum(abs(weight)) AS gross, abs(sum(weight)) AS net, sum(greatest(weight, 0)) AS lng, sum(greatest(-weight, 0)) AS sht, max(abs(weight)) AS nm,
   abs(sum(weight * (CAST(security_id AS BIGINT) % 10) / 10.0::DOUBLE)) AS sz FROM tgt GROUP BY 1, 2),
u1 AS (SELECT experiment, session_idx, 'gross' AS kind, 'all' AS name, gross AS used, 1.0 AS cap FROM u0 UNION ALL SELECT experiment, session_idx, 'net', 'all', net, 0.02 FROM u0
   UNION ALL SELECT experiment, session_idx, 'long', 'all', lng, 0.6 FROM u0 UNION ALL SELECT experiment, session_idx, 'short', 'all', sht, 0.6 FROM u0
   UNION ALL SELECT experiment, session_idx, 'name', 'all', nm, 0.05 FROM u0 UNION ALL SELECT experiment, session_idx, 'factor', 'size', sz, 0.5 FROM u0)""",
        "SELECT experiment, session_idx, kind, name, used, used / cap AS usage FROM u1",
        f"{B} kind:s name:s used:f usage:f",
    ),
)
def c09(spark, sf):
    t = targets(spark, sf).select("experiment", "session_idx", "security_id", "weight")
    load = tb.assets(spark, sf).select(
        "security_id", F.lit("factor").alias("kind"), F.lit("size").alias("name"), (F.col("security_id").cast("bigint") % 10 / 10.0).alias("loading")
    )
    caps = spark.createDataFrame(CAPS, "kind string, name string, cap double")
    return finish(lg.budget_audit(t, load, caps).select("experiment", "session_idx", "kind", "name", "used", "usage"))


#: The tail book must stay neutral to beta within this; a book that isn't is corrected in full or stays.
NEUTRAL_WITHIN = 0.02
STEP = lg.StepLimits(max_name=0.06, max_turnover=0.7, max_participation=0.5)


@query(
    "c07_step_search",
    out(
        TARGET_SQL
        + f""",
pb AS (SELECT t.experiment, t.session_idx, t.security_id, coalesce(p.weight, 0.0) AS previous, t.weight AS desired, t.weight - coalesce(p.weight, 0.0) AS mv, t.vol, t.adv, t.beta, t.weight * 0.01 AS forecast
   FROM tgt t LEFT JOIN tgt p ON p.experiment = t.experiment AND p.security_id = t.security_id AND p.session_idx = t.session_idx - {EVERY}),
sr AS (SELECT b.experiment, b.session_idx, r.session_idx AS day, sum(previous * ret) AS x, sum(mv * ret) AS y FROM pb b JOIN rets r ON r.security_id = b.security_id AND r.session_idx BETWEEN b.session_idx - 52 AND b.session_idx - 1 WHERE ret IS NOT NULL AND (previous <> 0 OR mv <> 0) GROUP BY 1, 2, 3),
rk AS (SELECT b.experiment, b.session_idx, 0.8 * coalesce(c00, 0) + 0.2 * d00 AS v00, 0.8 * coalesce(c01, 0) + 0.2 * d01 AS v01, 0.8 * coalesce(c11, 0) + 0.2 * d11 AS v11
   FROM (SELECT experiment, session_idx, sum(previous * previous * coalesce(vol * vol, 0)) AS d00, sum(previous * mv * coalesce(vol * vol, 0)) AS d01, sum(mv * mv * coalesce(vol * vol, 0)) AS d11 FROM pb GROUP BY 1, 2) b
   LEFT JOIN (SELECT experiment, session_idx, var_samp(x) AS c00, covar_samp(x, y) AS c01, var_samp(y) AS c11 FROM sr GROUP BY 1, 2) s USING (experiment, session_idx)),
o1 AS (SELECT experiment, session_idx, experiment <> 'tail' OR abs(sum(previous * beta)) <= {NEUTRAL_WITHIN} AS neutral,
   greatest(0, least(1.0, coalesce({STEP.max_turnover} / nullif(sum(abs(mv)), 0), 1.0), coalesce(min(CASE WHEN abs(mv) > 1e-7 THEN coalesce(adv, 0) * {STEP.max_participation} / {NAV} / abs(mv) END), 1.0))) AS max_step FROM pb GROUP BY 1, 2),
o2 AS (SELECT *, CASE WHEN neutral THEN 0.0 ELSE 1.0 END AS min_step, NOT neutral AND max_step < 1 - 1e-7 AS stuck FROM o1),
gd AS (SELECT b.*, k, min_step + k * (greatest(max_step, min_step) - min_step) / 100.0::DOUBLE AS step, previous + (min_step + k * (greatest(max_step, min_step) - min_step) / 100.0::DOUBLE) * mv AS target,
   (min_step + k * (greatest(max_step, min_step) - min_step) / 100.0::DOUBLE) * mv AS trade FROM pb b JOIN o2 USING (experiment, session_idx) CROSS JOIN (SELECT unnest(range(0, 101)) AS k) WHERE NOT stuck),
ag AS (SELECT experiment, session_idx, k, max(step) AS step, sum(abs(target)) AS gross, max(abs(target)) AS big, sum(abs(trade)) AS turnover, sum({_cost('trade')}) + sum(greatest(-target, 0)) * 0.03 / 365 AS cost, sum(forecast * target) AS expected FROM gd GROUP BY 1, 2, 3),
fe AS (SELECT a.*, v00 + 2 * step * v01 + step * step * v11 AS variance, round(expected - {STEP.risk_aversion} * (v00 + 2 * step * v01 + step * step * v11) - cost, 12) AS obj FROM ag a JOIN rk USING (experiment, session_idx)
   WHERE 1 - cost > 0 AND gross / (1 - cost) <= 1 + 1e-7 AND big / (1 - cost) <= {STEP.max_name} + 1e-7 AND turnover <= {STEP.max_turnover} + 1e-7),
bs AS (SELECT *, row_number() OVER (PARTITION BY experiment, session_idx ORDER BY obj DESC, k) AS rn, count(*) OVER (PARTITION BY experiment, session_idx) AS feasible FROM fe)""",
        """SELECT o.experiment, o.session_idx, CASE WHEN stuck THEN 'CANNOT_NEUTRALIZE' WHEN step IS NULL THEN 'NO_FEASIBLE_STEP' WHEN turnover <= 1e-7 THEN 'NO_ECONOMIC_TRADE' ELSE 'STEP' END AS status, max_step, coalesce(feasible, 0) AS feasible,
        step, gross, turnover, cost, variance, obj AS objective FROM o2 o LEFT JOIN (SELECT * FROM bs WHERE rn = 1) b USING (experiment, session_idx)""",
        f"{B} status:s max_step:f feasible:i step:f gross:f turnover:f cost:f variance:f objective:f", 8,
    ),
)
def c07(spark, sf):
    t = targets(spark, sf).select("experiment", "session_idx", "security_id", "weight", "vol", "adv", "beta")
    before = t.select("experiment", (F.col("session_idx") + EVERY).alias("session_idx"), "security_id", F.col("weight").alias("previous"))
    b = t.join(before, ["experiment", "session_idx", "security_id"], "left").withColumn("previous", F.coalesce("previous", F.lit(0.0)))
    b = cut(b.select("experiment", "session_idx", "security_id", "previous", F.col("weight").alias("desired"), "vol", "adv", "beta", (F.col("weight") * 0.01).alias("forecast")))
    tilt = b.groupBy("experiment", "session_idx").agg(((F.col("experiment") != "tail") | (F.abs(F.sum(F.col("previous") * F.col("beta"))) <= NEUTRAL_WITHIN)).alias("neutral"))
    risk = lg.book_variance(b, tb.priced(spark, sf), 52)
    got = lg.step_search(b.join(tilt, ["experiment", "session_idx"]), risk, NAV, COSTS, STEP)
    return finish(got.select("experiment", "session_idx", "status", "max_step", "feasible", "step", "gross", "turnover", "cost", "variance", "objective"), 8)


#: Budgets of the audited books; sleeves are sectors, and the loadings beta and size. Caps halve after a fall of the market over a rebalance interval.
BUDGETS = lg.Budgets(max_gross=0.9, net=0.02, long_gross=0.4, short_gross=0.5, max_name=0.05, max_turnover=0.25, max_participation=0.004, volatility=0.10, periods=52.0, nav=NAV)
FACTOR_CAPS = [("factor", "beta", 0.05), ("factor", "size", 0.2), *(("sleeve", r, 0.25) for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))]
_GROUP_SQL = f"""
gp AS (SELECT session_idx, sector, avg(ret) AS r FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2),
gc AS (SELECT c.session_idx AS decision, a.sector AS i, b.sector AS j, covar_samp(a.r, b.r) AS covariance FROM cal c JOIN gp a ON a.session_idx < c.session_idx AND a.session_idx >= c.session_idx - 60
   JOIN gp b ON b.session_idx = a.session_idx AND a.sector <= b.sector WHERE c.session_idx % {EVERY} = 0 AND c.session_idx >= 60 GROUP BY 1, 2, 3)"""
_U = BUDGETS
BUDGET_TAIL = (
    _GROUP_SQL
    + f""",
fall AS (SELECT c.session_idx, CASE WHEN coalesce(sum(m.market), 0) < 0 THEN 0.5 ELSE 1.0 END AS scale FROM cal c LEFT JOIN mkt m ON m.session_idx BETWEEN c.session_idx - {EVERY - 1} AND c.session_idx GROUP BY 1),
bq0 AS (SELECT coalesce(t.experiment, p.experiment) AS experiment, coalesce(t.session_idx, p.session_idx + {EVERY}) AS session_idx, coalesce(t.security_id, p.security_id) AS security_id, coalesce(p.weight, 0.0) AS previous, coalesce(t.weight, 0.0) AS target, coalesce(t.weight IS NOT NULL AND t.adv > 0, false) AS usable, coalesce(t.adv, 0) AS adv
   FROM tgt t FULL JOIN tgt p ON p.experiment = t.experiment AND p.security_id = t.security_id AND p.session_idx = t.session_idx - {EVERY}),
bq1 AS (SELECT b.* EXCLUDE (target), CASE WHEN usable THEN target ELSE previous END AS target, a.sector, coalesce(r.beta, 0) AS beta, (CAST(b.security_id AS BIGINT) % 10) / 10.0::DOUBLE AS size, scale, CASE WHEN CAST(b.security_id AS BIGINT) % 7 = 0 THEN 0.5 ELSE 1.0 END AS name_scale,
   adv * {_U.max_participation} / {NAV} AS room, {_U.max_name} * scale * CASE WHEN CAST(b.security_id AS BIGINT) % 7 = 0 THEN 0.5 ELSE 1.0 END AS lim
   FROM bq0 b JOIN fall USING (session_idx) JOIN assets a USING (security_id) LEFT JOIN rs r ON r.security_id = b.security_id AND r.session_idx = b.session_idx
   WHERE EXISTS (SELECT 1 FROM tgt x WHERE x.experiment = b.experiment AND x.session_idx = b.session_idx)),
bq2 AS (SELECT *, CASE WHEN previous - room > lim THEN previous - room WHEN previous + room < -lim THEN previous + room ELSE -lim END AS lo, CASE WHEN previous - room > lim THEN previous - room WHEN previous + room < -lim THEN previous + room ELSE lim END AS hi FROM bq1),
bq3 AS (SELECT *, greatest(lo, previous - room) AS rlo, least(hi, previous + room) AS rhi, least(greatest(previous, lo), hi) AS clp FROM bq2),
sm AS (SELECT experiment, session_idx, max(scale) AS scale,
   sum(abs(previous)) FILTER (NOT usable) AS fg, sum(previous) FILTER (NOT usable) AS fn, sum(greatest(previous, 0)) FILTER (NOT usable) AS fl, sum(greatest(-previous, 0)) FILTER (NOT usable) AS fs,
   sum(CASE WHEN rlo > 0 THEN rlo WHEN rhi < 0 THEN -rhi ELSE 0 END) FILTER (usable) AS lg, sum(rlo) FILTER (usable) AS rl, sum(rhi) FILTER (usable) AS rh, sum(greatest(rlo, 0)) FILTER (usable) AS ll_, sum(greatest(-rhi, 0)) FILTER (usable) AS ls,
   sum(abs(previous)) FILTER (usable) AS pg, sum(previous) FILTER (usable) AS pn, sum(greatest(previous, 0)) FILTER (usable) AS pl, sum(greatest(-previous, 0)) FILTER (usable) AS ps, sum(greatest(abs(previous) - lim, 0)) FILTER (usable) AS ov,
   sum(abs(clp)) FILTER (usable) AS cg, sum(clp) FILTER (usable) AS cn, sum(greatest(clp, 0)) FILTER (usable) AS cl, sum(greatest(-clp, 0)) FILTER (usable) AS cs, sum(abs(clp - previous)) FILTER (usable) AS forced,
   sum(abs(target)) AS gross, abs(sum(target)) AS net, sum(greatest(target, 0)) AS lng, sum(greatest(-target, 0)) AS sht, sum(abs(target - previous)) AS turnover,
   max(abs(target)) FILTER (usable) AS big, max(greatest(abs(target) - lim, 0)) FILTER (usable) AS nx, max(lim) FILTER (usable) AS nc, max(abs(target) / lim) FILTER (usable) AS nu FROM bq3 GROUP BY 1, 2),
sn AS (SELECT * REPLACE (coalesce(fg, 0) AS fg, coalesce(fn, 0) AS fn, coalesce(fl, 0) AS fl, coalesce(fs, 0) AS fs) FROM sm),
so AS (SELECT *, CASE WHEN rl + fn <= 0 AND rh + fn >= 0 THEN 0 ELSE least(abs(rl + fn), abs(rh + fn)) END AS ln_ FROM sn),
sp AS (SELECT *, greatest({_U.max_gross} * scale, lg + fg) AS eg, greatest({_U.net} * scale, ln_) AS en, greatest({_U.long_gross} * scale, ll_ + fl) AS el, greatest({_U.short_gross} * scale, ls + fs) AS es FROM so),
ld AS (SELECT *, unnest([{{'kind': 'factor', 'name': 'beta', 'w': beta}}, {{'kind': 'factor', 'name': 'size', 'w': size}}, {{'kind': 'sleeve', 'name': sector, 'w': 1.0}}]) AS l FROM bq3),
lq AS (SELECT experiment, session_idx, l.kind AS kind, l.name AS name, max(scale) AS scale, sum(CASE WHEN l.kind = 'sleeve' THEN abs(target) ELSE target * l.w END) AS u, coalesce(sum(CASE WHEN l.kind = 'sleeve' THEN abs(previous) ELSE previous * l.w END) FILTER (usable), 0) AS p,
   coalesce(sum(CASE WHEN l.kind = 'sleeve' THEN abs(clp) ELSE clp * l.w END) FILTER (usable), 0) AS k, coalesce(sum(CASE WHEN l.kind = 'sleeve' THEN abs(previous) ELSE previous * l.w END) FILTER (NOT usable), 0) AS f,
   coalesce(sum(CASE WHEN l.kind = 'sleeve' THEN greatest(abs(previous) - room, 0) ELSE 0 END) FILTER (usable), 0) AS lst, greatest(coalesce(max(abs(l.w)) FILTER (usable), 0), 1e-12) AS steep FROM ld GROUP BY 1, 2, 3, 4),
lr AS (SELECT q.*, c.cap * scale AS cap, CASE WHEN q.kind = 'sleeve' THEN greatest(c.cap * scale, lst + f) ELSE c.cap * scale END AS eff, CASE WHEN q.kind = 'sleeve' THEN 1.0 ELSE steep END AS div
   FROM lq q JOIN (VALUES {', '.join(f"('{k}', '{n}', {v})" for k, n, v in FACTOR_CAPS)}) AS c(kind, name, cap) ON c.kind = q.kind AND c.name = q.name),
lt AS (SELECT experiment, session_idx, max(greatest(abs(p + f) - eff, 0) / div) AS bef, max(greatest(abs(k + f) - eff, 0) / div) AS aft FROM lr GROUP BY 1, 2),
gw AS (SELECT experiment, session_idx, sector, sum(target) AS x FROM bq3 GROUP BY 1, 2, 3),
vq AS (SELECT a.experiment, a.session_idx, sum(a.x * b.x * covariance * CASE WHEN a.sector = b.sector THEN 1 ELSE 2 END) AS v FROM gw a JOIN gw b ON a.experiment = b.experiment AND a.session_idx = b.session_idx AND a.sector <= b.sector JOIN gc ON gc.decision = a.session_idx AND gc.i = a.sector AND gc.j = b.sector GROUP BY 1, 2),
su AS (SELECT s.*, sqrt(greatest(v, 0) * 52) AS vola, greatest({_U.max_turnover}, greatest(
     greatest(greatest(pg - greatest(eg - fg, 0), 0), greatest(abs(pn + fn) - en, 0), ov, greatest(pl + fl - el, 0), greatest(ps + fs - es, 0), coalesce(bef, 0)),
     forced + greatest(greatest(cg + fg - eg, 0), greatest(abs(cn + fn) - en, 0), greatest(cl + fl - el, 0), greatest(cs + fs - es, 0), coalesce(aft, 0))) + 1e-7) AS et FROM sp s LEFT JOIN lt USING (experiment, session_idx) LEFT JOIN vq USING (experiment, session_idx)),
bu AS (SELECT experiment, session_idx, 'gross' AS kind, 'all' AS name, gross AS used, {_U.max_gross} * scale AS cap, eg AS effective_cap, gross / ({_U.max_gross} * scale) AS usage, greatest(gross - {_U.max_gross} * scale, 0) AS excess FROM su
   UNION ALL SELECT experiment, session_idx, 'net', 'all', net, {_U.net} * scale, en, net / ({_U.net} * scale), greatest(net - {_U.net} * scale, 0) FROM su
   UNION ALL SELECT experiment, session_idx, 'long', 'all', lng, {_U.long_gross} * scale, el, lng / ({_U.long_gross} * scale), greatest(lng - {_U.long_gross} * scale, 0) FROM su
   UNION ALL SELECT experiment, session_idx, 'short', 'all', sht, {_U.short_gross} * scale, es, sht / ({_U.short_gross} * scale), greatest(sht - {_U.short_gross} * scale, 0) FROM su
   UNION ALL SELECT experiment, session_idx, 'name', 'all', big, nc, nc, nu, nx FROM su
   UNION ALL SELECT experiment, session_idx, 'turnover', 'all', turnover, {_U.max_turnover}, et, turnover / {_U.max_turnover}, greatest(turnover - {_U.max_turnover}, 0) FROM su
   UNION ALL SELECT experiment, session_idx, 'volatility', 'all', vola, {_U.volatility}, {_U.volatility}, vola / {_U.volatility}, greatest(vola - {_U.volatility}, 0) FROM su
   UNION ALL SELECT experiment, session_idx, kind, name, abs(u), cap, eff, abs(u) / cap, greatest(abs(u) - cap, 0) FROM lr)"""
)
BUDGET_SQL = TARGET_SQL + "," + BUDGET_TAIL


@query("c09_effective_budgets", out(BUDGET_SQL, "SELECT experiment, session_idx, kind, name, used, cap, effective_cap, usage, excess FROM bu", f"{B} kind:s name:s used:f cap:f effective_cap:f usage:f excess:f"))
def c09_effective(spark, sf):
    """Usage of every budget by each book against its scaled cap, and the cap that holdings and liquidity leave reachable."""
    return finish(budget_usage(spark, sf).select("experiment", "session_idx", "kind", "name", "used", "cap", "effective_cap", "usage", "excess"))


def budget_usage(spark, sf):
    from panelweft.plans.q_reports import group_covariance  # imports this module

    panel = cut(scored_panel(spark, sf).select("security_id", "session_idx", "sector", "ret", "beta", "vol", "adv", "score", "market"))
    t = targets(spark, sf, panel).select("experiment", "session_idx", "security_id", F.col("weight").alias("target"), "adv")
    before = t.select("experiment", (F.col("session_idx") + EVERY).alias("session_idx"), "security_id", F.col("target").alias("previous"))
    keys = ["experiment", "session_idx", "security_id"]
    b = t.join(before, keys, "full").join(t.select(*keys[:2]).distinct(), keys[:2], "left_semi")
    b = b.withColumns({"usable": fr.truth(F.col("target").isNotNull() & (F.col("adv") > 0)), "previous": F.coalesce("previous", F.lit(0.0)), "target": F.coalesce("target", F.lit(0.0)), "adv": F.coalesce("adv", F.lit(0.0))})
    market = panel.where(F.col("market").isNotNull()).groupBy("session_idx").agg(F.max("market").alias("market"))
    falls = market.select("market", F.explode(F.sequence("session_idx", F.col("session_idx") + EVERY - 1)).alias("session_idx")).groupBy("session_idx").agg(F.sum("market").alias("__m"))
    b = tb.attach(b, falls, "session_idx", tb.shape(spark, sf).sessions).withColumn("scale", F.when(F.coalesce("__m", F.lit(0.0)) < 0, 0.5).otherwise(1.0))
    b = b.join(tb.assets(spark, sf).select("security_id", F.col("sector").alias("group")), "security_id").join(panel.select("security_id", "session_idx", "beta"), ["security_id", "session_idx"], "left")
    k = F.col("security_id").cast("bigint")
    load = lambda kind, name, w: F.struct(F.lit(kind).alias("kind"), name.alias("name"), w.cast("double").alias("loading"))
    loads = F.array(load("factor", F.lit("beta"), F.coalesce("beta", F.lit(0.0))), load("factor", F.lit("size"), k % 10 / 10.0), load("sleeve", F.col("group"), F.lit(1.0)))
    b = b.withColumns({"long_scale": F.lit(1.0), "short_scale": F.lit(1.0), "name_scale": F.when(k % 7 == 0, 0.5).otherwise(1.0), "loads": loads})
    cov = group_covariance(spark, sf).select(F.col("decision").alias("session_idx"), "i", "j", "covariance")
    return lg.effective_budgets(b, spark.createDataFrame(FACTOR_CAPS, "kind string, name string, cap double"), cov, BUDGETS)
