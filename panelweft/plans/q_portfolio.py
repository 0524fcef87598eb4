"""Covariance, direction and target inputs of every rebalance decision, over the eligible names of its universe."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelweft.functions import frames as fr
from panelweft.operators import research as rs
from panelweft.plans.q_quality import UNIVERSE_TAIL, _shared, eligible_members
from panelweft.plans.q_research import _TWO, LABEL_SQL, labelled_library
from panelweft.plans.registry import finish, out, query
from panelweft.plans.sqlbase import RESIDUAL, roll, ts
from panelweft.session import cut
from panelweft.sources import tables as tb

COVARIANCE = rs.CovariancePolicy(lookback=104, least=20)


def covariances(spark, sf):
    """(shrunk covariances of the decisions that have one, status of all), frozen once a session."""

    def measure():
        m = eligible_members(spark, sf)
        pairs = cut(rs.window_covariance(tb.priced(spark, sf), m, COVARIANCE.lookback))
        status = cut(rs.covariance_status(pairs, m, COVARIANCE.least))
        return rs.shrink(pairs.join(status.where("ready").select("decision"), "decision", "left_semi"), COVARIANCE.shrinkage), status

    return tb._once(spark, sf, "covariances", measure)


COV_SQL = (
    RESIDUAL + "," + UNIVERSE_TAIL
    + f""",
pst AS (SELECT m.decision, m.position, r.session_idx, r.ret FROM mem m JOIN rets r ON r.security_id = m.security_id AND r.session_idx < m.decision AND r.session_idx >= m.decision - {COVARIANCE.lookback} WHERE r.ret IS NOT NULL),
prc AS (SELECT a.decision, a.position AS i, b.position AS j, covar_samp(a.ret, b.ret) AS covariance, count(*) AS pairs FROM pst a JOIN pst b ON a.decision = b.decision AND a.session_idx = b.session_idx AND a.position <= b.position GROUP BY 1, 2, 3),
cst AS (SELECT m.decision, any_value(m.size) AS names, any_value(m.size * (m.size + 1) // 2) - coalesce(any_value(f.n), 0) AS short_pairs FROM mem m
  LEFT JOIN (SELECT decision, count(*) AS n FROM prc WHERE pairs >= {COVARIANCE.least} AND (i <> j OR covariance > 0) GROUP BY 1) f USING (decision) GROUP BY 1),
cvr AS (SELECT decision, i, j, CASE WHEN i = j THEN covariance ELSE 0.8 * covariance END AS covariance, pairs FROM prc JOIN cst USING (decision) WHERE short_pairs = 0)"""
)


@query("a13_shrinkage_covariance", out(COV_SQL, "SELECT decision, i, j, covariance, pairs FROM cvr", "decision:i i:i j:i covariance:f pairs:i", 9))
def a13(spark, sf):
    return finish(covariances(spark, sf)[0].select("decision", "i", "j", "covariance", "pairs"), 9)


@query("a13_covariance_status", out(COV_SQL, "SELECT decision, names, short_pairs, short_pairs = 0 AS ready FROM cst", "decision:i names:i short_pairs:i ready:b"))
def a13s(spark, sf):
    """Which decisions have a covariance: one short pair refuses all of a decision."""
    return finish(covariances(spark, sf)[1])


# eigenvalue repair has no SQL form; tests compare it with a dense solve
@query("a13_repaired_covariance")
def a13r(spark, sf):
    rep = rs.repair_covariance(covariances(spark, sf)[0], floor_ratio=COVARIANCE.floor_ratio)
    return finish(rep.select("decision", "i", "j", "covariance", "repaired"), 9)


def mv_inputs(spark, sf):
    df = tb.residual_panel(spark, sf).select("security_id", F.col("session_idx").alias("decision"), fr.snap(-F.col("residual"), 9).alias("alpha"), "beta")
    names = eligible_members(spark, sf).join(df, ["decision", "security_id"])
    return covariances(spark, sf)[0], names.select("decision", F.col("position").cast("int").alias("position"), "alpha", "beta", F.lit(1.0).alias("one"))


#: Gauss-Jordan steps on all decisions at once: one row per name holds its covariances, its alpha and its exposures.
_SOLVE_SQL = """,
nm AS (SELECT m.decision, m.position, round(-r.residual, 9) AS alpha, r.beta FROM mem m JOIN rs r ON r.security_id = m.security_id AND r.session_idx = m.decision JOIN cst c ON c.decision = m.decision AND short_pairs = 0 WHERE r.residual IS NOT NULL AND r.beta IS NOT NULL),
nmk AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY position) AS q, count(*) OVER (PARTITION BY decision) AS n FROM nm),
dgn AS (SELECT n.decision, greatest(median(c.covariance) * 1e-6, 1e-12) AS ridge FROM nmk n JOIN cvr c ON c.decision = n.decision AND c.i = n.position AND c.j = n.position GROUP BY 1),
sqr AS (SELECT a.decision, a.q, b.q AS p, c.covariance + CASE WHEN a.q = b.q THEN ridge ELSE 0 END AS v FROM nmk a JOIN nmk b ON a.decision = b.decision JOIN dgn d ON d.decision = a.decision
  JOIN cvr c ON c.decision = a.decision AND c.i = least(a.position, b.position) AND c.j = greatest(a.position, b.position)),
gjr AS (SELECT s.decision, s.q, any_value(n) AS n, list_concat(list(v ORDER BY p), [any_value(alpha), 1.0, any_value(beta)]) AS r FROM sqr s JOIN nmk k USING (decision, q) GROUP BY 1, 2),
gj AS (
  SELECT decision, 1 AS k, q, n, r FROM gjr
  UNION ALL
  SELECT a.decision, a.k + 1, a.q, a.n, CASE WHEN a.q = a.k THEN list_transform(a.r, lambda x: x / a.r[a.k]) ELSE list_transform(list_zip(a.r, b.r), lambda z: z[1] - a.r[a.k] / b.r[a.k] * z[2]) END
  FROM gj a JOIN gj b ON a.decision = b.decision AND b.q = a.k WHERE a.k <= a.n),
slv AS (SELECT g.decision, g.q, k.position, k.beta, r[n_ + 1] AS pa, r[n_ + 2] AS p1, r[n_ + 3] AS p2 FROM (SELECT *, n AS n_ FROM gj WHERE k = n + 1) g JOIN nmk k USING (decision, q)),
prj AS (SELECT decision, sum(p1) AS s11, sum(p2) AS s12, sum(beta * p2) AS s22, sum(pa) AS t1, sum(beta * pa) AS t2 FROM slv GROUP BY 1)"""


@query(
    "c08_mv_direction",
    out(
        COV_SQL + _SOLVE_SQL,
        """SELECT s.decision, position, CASE WHEN abs(s11 * s22 - s12 * s12) <= 1e-9 * s11 * s22 THEN 0.0 ELSE
            (pa - p1 * (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) - p2 * (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12)) / 10.0 END AS direction FROM slv s JOIN prj p USING (decision)""",
        "decision:i position:i direction:f", 4,
    ),
)
def c08(spark, sf):
    cov, names = mv_inputs(spark, sf)
    return finish(rs.mv_direction(cov, names, ["one", "beta"]).select("decision", "position", "direction"), 4)


#: Ends of the train rows of the frozen fits, and the sessions that a forecast is for.
FIT_ENDS, HORIZON = (130, 182, 234, 286), 5


def frozen_fits(spark, sf):
    """The fits, written as a table and read back: later queries apply what was stored."""

    def measure():
        path = f"{_shared(spark)}/fits-{uuid.uuid4().hex}"
        rs.fit_table(labelled_library(spark, sf), _TWO, "label", "label_end", FIT_ENDS).coalesce(1).write.parquet(path)
        return spark.read.parquet(path)

    return tb._once(spark, sf, "frozen fits", measure)


_FITS_SQL = f""",
fe AS (SELECT unnest([{', '.join(map(str, FIT_ENDS))}]) AS train_end, unnest(range(1, {len(FIT_ENDS) + 1})) AS version),
tr AS (SELECT e.version, e.train_end, reversal_3 AS a, momentum_26_4 AS b, label AS y FROM ll JOIN fe e ON label_end <= e.train_end WHERE reversal_3 IS NOT NULL AND momentum_26_4 IS NOT NULL AND label IS NOT NULL),
fit0 AS (SELECT version, train_end, count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, avg(y) AS my, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM tr GROUP BY 1, 2 HAVING count(*) >= 500),
fit1 AS (SELECT *, cab / (sa * sb) AS g, cay / sa AS ra, cby / sb AS rb FROM fit0),
fit AS (SELECT *, (1.1 * ra - g * rb) / (1.1 * 1.1 - g * g) AS ca, (1.1 * rb - g * ra) / (1.1 * 1.1 - g * g) AS cb FROM fit1)"""


@query(
    "c13_frozen_fits",
    out(LABEL_SQL + _FITS_SQL, "SELECT version, train_end, n AS observations, my AS intercept, ma AS mean_1, mb AS mean_2, sa AS scale_1, sb AS scale_2, ca AS coefficient_1, cb AS coefficient_2 FROM fit",
        "version:i train_end:i observations:i intercept:f mean_1:f mean_2:f scale_1:f scale_2:f coefficient_1:f coefficient_2:f", 8),
)
def c13f(spark, sf):
    f = frozen_fits(spark, sf)
    cols = [F.col(c)[i].alias(f"{n}_{i + 1}") for c, n in (("means", "mean"), ("scales", "scale"), ("coefficients", "coefficient")) for i in (0, 1)]
    return finish(f.select("version", "train_end", "observations", "intercept", *cols), 8)


TARGET_INPUTS_SQL = (
    LABEL_SQL + _FITS_SQL + "," + UNIVERSE_TAIL
    + f""",
adv_ AS (SELECT security_id, session_idx, {roll('median({})', 'close * volume', ts(26), 13)} AS adv FROM bars),
app AS (SELECT m.decision, m.security_id, m.position, f.version, f.my + (l.reversal_3 - f.ma) / f.sa * f.ca + (l.momentum_26_4 - f.mb) / f.sb * f.cb AS alpha, l.beta, l.vol, l.sector, a.adv
  FROM mem m LEFT JOIN ll l ON l.security_id = m.security_id AND l.session_idx = m.decision LEFT JOIN adv_ a ON a.security_id = m.security_id AND a.session_idx = m.decision
  LEFT JOIN (SELECT d.decision, max(train_end) AS train_end FROM dc d JOIN fit ON train_end < d.decision GROUP BY 1) w ON w.decision = m.decision LEFT JOIN fit f ON f.train_end = w.train_end)"""
)


@query(
    "c13_optimized_target_inputs",
    out(TARGET_INPUTS_SQL, "SELECT decision, security_id, position, version, alpha, adv, beta, vol, sector, alpha IS NOT NULL AND beta IS NOT NULL AND vol IS NOT NULL AND adv > 0 AND sector IS NOT NULL AS usable FROM app",
                "decision:i security_id:s position:i version:i alpha:f adv:f beta:f vol:f sector:s usable:b", 8),
)
def c13(spark, sf):
    """Per name of each decision: the forecast of the fit that held, liquidity, and loadings on beta, volatility and sector."""
    lib = labelled_library(spark, sf).select("security_id", F.col("session_idx").alias("decision"), *_TWO, "beta", "vol", "sector")
    adv = tb.bars(spark, sf).select("security_id", F.col("session_idx").alias("decision"), fr.roll(fr.median, F.col("close") * F.col("volume"), fr.ts(26), 13).alias("adv"))
    rows = eligible_members(spark, sf).join(lib, ["decision", "security_id"], "left").join(adv, ["decision", "security_id"], "left")
    rows = rs.apply_fits(rows, frozen_fits(spark, sf), _TWO, tb.shape(spark, sf).sessions)
    usable = F.lit(True)
    for c in ("alpha", "beta", "vol", "adv", "sector"):
        usable = usable & F.col(c).isNotNull()
    rows = rows.withColumn("usable", usable & fr.truth(F.col("adv") > 0))
    return finish(rows.select("decision", "security_id", "position", "version", "alpha", "adv", "beta", "vol", "sector", "usable"), 8)


@query("c13_target_covariance", out(COV_SQL, f"SELECT decision, i, j, {HORIZON} * covariance AS horizon_covariance FROM cvr", "decision:i i:i j:i horizon_covariance:f", 8))
def c13c(spark, sf):
    """The whole covariance of each decision over the forecast's horizon."""
    return finish(covariances(spark, sf)[0].select("decision", "i", "j", (HORIZON * F.col("covariance")).alias("horizon_covariance")), 8)
