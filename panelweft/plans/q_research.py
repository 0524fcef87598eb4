"""Calibration, information coefficient, covariance and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweft.functions import frames as fr
from panelweft.operators import features as ft
from panelweft.operators import research as rs
from panelweft.plans.q_features import FAMILIES, LIBRARY_SQL, label_sql, library
from panelweft.plans.q_ledger import BOOKS_SQL, EVERY, START, books, ledger
from panelweft.plans.registry import finish, out, query
from panelweft.plans.sqlbase import RESIDUAL, pct_rank, roll, ts
from panelweft.session import cut
from panelweft.sources import tables as tb

TRAIN_END = 200
H = 3


def labelled_library(spark, sf, upto=None):
    """Sector-neutral families with the forward label and its completion."""
    df = library(spark, sf, upto)
    return df.withColumns({"label": ft.forward_label("ret", H), "label_end": F.col("session_idx") + H})


LABEL_SQL = LIBRARY_SQL + f", ll AS (SELECT *, {label_sql(H)} AS label, session_idx + {H} AS label_end FROM lib)"


def ic_sql(src, score, label, dst, by="session_idx", extra=""):
    """Daily IC tables ``dst`` from table ``src``."""
    return f"""
{dst}_a AS (SELECT {by}, {score} AS s, {label} AS l, round({score}, 9) AS s9, round({label}, 9) AS l9 FROM {src} WHERE {score} IS NOT NULL AND {label} IS NOT NULL {extra}),
{dst}_b AS (SELECT *, {pct_rank('s9', by)} AS ps, {pct_rank('l9', by)} AS pl FROM {dst}_a),
{dst} AS (SELECT {by}, CASE WHEN isnan(corr(s, l)) THEN NULL ELSE corr(s, l) END AS ic, CASE WHEN isnan(corr(ps, pl)) THEN NULL ELSE corr(ps, pl) END AS rank_ic, count(*) AS names FROM {dst}_b GROUP BY {by})"""


_REV = (
    RESIDUAL
    + f""",
rv AS (SELECT *, -({roll('sum({})', 'residual', ts(3), 2)}) AS score, {label_sql(H)} AS label FROM rs),"""
    + ic_sql("rv", "score", "label", "dic")
)


def reversal_ic(spark, sf, min_peers=2):
    from panelweft.operators.features import residual_returns

    wide = tb.shape(spark, sf).wide
    df = residual_returns(tb.research_panel(spark, sf), 26, 13, min_peers, wide)
    df = df.withColumns({"score": -fr.roll(F.sum, "residual", fr.ts(3), 2), "label": ft.forward_label("ret", H)})
    return rs.daily_ic(df, "score", "label", wide=wide)


def flagship(spark, sf):
    """Mean rank IC of the three-session residual reversal by year."""
    first = F.lit(tb.shape(spark, sf).first)
    ic = reversal_ic(spark, sf, min_peers=1)
    year = F.year(F.date_add(first, F.col("session_idx") * 7))
    return finish(
        ic.groupBy(year.alias("year")).agg(F.avg("rank_ic").alias("mean_rank_ic"), F.count("rank_ic").alias("sessions"))
    )


@query("a04_daily_ic", out(_REV, "SELECT session_idx, ic, rank_ic, names FROM dic", "session_idx:i ic:f rank_ic:f names:i"))
def a04(spark, sf):
    return finish(reversal_ic(spark, sf))


@query(
    "a04_reversal_ic_by_year",
    out(_REV, "SELECT year(c.session) AS year, avg(rank_ic) AS mean_rank_ic, count(rank_ic) AS sessions FROM dic JOIN cal c USING (session_idx) GROUP BY 1",
        "year:i mean_rank_ic:f sessions:i"),
)
def a04y(spark, sf):
    first = F.lit(tb.shape(spark, sf).first)
    year = F.year(F.date_add(first, F.col("session_idx") * 7))
    return finish(
        reversal_ic(spark, sf).groupBy(year.alias("year")).agg(F.avg("rank_ic").alias("mean_rank_ic"), F.count("rank_ic").alias("sessions"))
    )


_FAM_SQL = (
    LABEL_SQL
    + ", fl AS (UNPIVOT (SELECT session_idx, label, label_end, " + ", ".join(FAMILIES) + " FROM ll) ON " + ", ".join(FAMILIES) + " INTO NAME family VALUE score),"
    + ic_sql("fl", "score", "label", "fic", "family, session_idx", f"AND label_end <= {TRAIN_END}")
    + """,
fy AS (SELECT family, year(c.session) AS y, avg(rank_ic) AS m FROM fic JOIN cal c USING (session_idx) GROUP BY 1, 2),
fq AS (SELECT f.family, avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS ic_std, count(rank_ic) AS sessions, max(p.py) AS positive_years FROM fic f
   JOIN (SELECT family, sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) AS py FROM fy GROUP BY 1) p USING (family) GROUP BY 1),
fz AS (SELECT *, mean_rank_ic / nullif(ic_std, 0) AS icir FROM fq),
fc AS (SELECT a.family AS l, b.family AS r, corr(a.rank_ic, b.rank_ic) AS c FROM fic a JOIN fic b USING (session_idx) WHERE a.family < b.family GROUP BY 1, 2)"""
)


def family_ics(spark, sf, train=True):
    """Daily rank IC per family over completed train labels."""
    wide = tb.shape(spark, sf).wide
    # families look back only, and no label of the train segment ends after it: later sessions have no part in it
    df = labelled_library(spark, sf, TRAIN_END if train else None)
    if train:
        df = df.where(F.col("label_end") <= TRAIN_END)
    rows = rs.long_families(df, FAMILIES, ["session_idx", "security_id", "label"])
    return rs.daily_ic(rows, "score", "label", ("family", "session_idx"), wide)


def _year(spark, sf):
    return F.year(F.date_add(F.lit(tb.shape(spark, sf).first), F.col("session_idx") * 7))


@query(
    "a05_ic_qualification",
    out(_FAM_SQL, """SELECT family, mean_rank_ic, ic_std, icir, positive_years, sessions, coalesce(mean_rank_ic > 0 AND icir >= 0.02 AND positive_years >= 2, false) AS qualified_raw FROM fz""",
        "family:s mean_rank_ic:f ic_std:f icir:f positive_years:i sessions:i qualified_raw:b"),
)
def a05(spark, sf):
    q = rs.qualification(family_ics(spark, sf), _year(spark, sf), min_years=2)
    return finish(q.select("family", "mean_rank_ic", "ic_std", "icir", "positive_years", "sessions", "qualified_raw"))


@query("a05_ic_correlation", out(_FAM_SQL, "SELECT l AS left_family, r AS right_family, c AS correlation FROM fc", "left_family:s right_family:s correlation:f"))
def a05c(spark, sf):
    c = rs.family_correlation(family_ics(spark, sf))
    return finish(c.select(F.col("left").alias("left_family"), F.col("right").alias("right_family"), "correlation"))


# greedy admission: a family enters if no better one already admitted is too close
@query(
    "a05_admitted",
    out(
        _FAM_SQL
        + """,
qo AS (SELECT family, row_number() OVER (ORDER BY icir DESC, mean_rank_ic DESC) AS o FROM fz WHERE coalesce(mean_rank_ic > 0 AND icir >= 0.02 AND positive_years >= 2, false)),
adm AS (
  SELECT CAST(0 AS BIGINT) AS o, CAST([] AS VARCHAR[]) AS chosen
  UNION ALL
  SELECT q.o, CASE WHEN len(a.chosen) < 4 AND (SELECT count(*) FROM fc WHERE abs(c) >= 0.75 AND ((l = q.family AND list_contains(a.chosen, r)) OR (r = q.family AND list_contains(a.chosen, l)))) = 0
     THEN list_append(a.chosen, q.family) ELSE a.chosen END FROM adm a JOIN qo q ON q.o = a.o + 1)""",
        "SELECT unnest(chosen) AS family FROM (SELECT * FROM adm ORDER BY o DESC LIMIT 1)",
        "family:s",
    ),
)
def a05a(spark, sf):
    ics = cut(family_ics(spark, sf).select("family", "session_idx", "rank_ic"))  # families x calendar, read four times
    q = rs.qualification(ics, _year(spark, sf), min_years=2).where("qualified_raw")
    rows = [(r["family"], r["icir"], r["mean_rank_ic"]) for r in q.collect()]  # a dozen families
    corr = {(r["left"], r["right"]): r["correlation"] for r in rs.family_correlation(ics).collect()}
    return spark.createDataFrame([(n,) for n in rs.admit(rows, corr)], T.StructType([T.StructField("family", T.StringType())]))


#: The horizon, in sessions, that each family forecasts.
HORIZONS = dict(zip(FAMILIES, (1, 3, 8, 1, 1, 3, 3, 8)))
_HZ_SQL = (
    LIBRARY_SQL
    + ",\nhz0 AS (SELECT *, " + ", ".join(f"{label_sql(h)} AS l{h}" for h in sorted(set(HORIZONS.values()))) + " FROM lib),\nhz AS ("
    + " UNION ALL ".join(f"SELECT session_idx, '{f}' AS family, {h} AS horizon, {f} AS score, l{h} AS label FROM hz0 WHERE session_idx + {h} <= {TRAIN_END}" for f, h in HORIZONS.items()) + "),"
    + ic_sql("hz", "score", "label", "hic", "family, session_idx")
    + """,
hy AS (SELECT family, year(c.session) AS y, avg(rank_ic) AS m FROM hic JOIN cal c USING (session_idx) GROUP BY 1, 2),
hq AS (SELECT f.family, avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS ic_std, count(rank_ic) AS sessions, max(p.py) AS positive_years FROM hic f
   JOIN (SELECT family, sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) AS py FROM hy GROUP BY 1) p USING (family) GROUP BY 1),
hx AS (SELECT *, mean_rank_ic / nullif(ic_std, 0) AS icir FROM hq),
hw AS (SELECT *, coalesce(mean_rank_ic > 0 AND icir >= 0.02 AND positive_years >= 2, false) AS raw FROM hx),
hc AS (SELECT a.family AS l, b.family AS r, corr(a.rank_ic, b.rank_ic) AS c FROM hic a JOIN hic b USING (session_idx) WHERE a.family < b.family GROUP BY 1, 2),
ho AS (SELECT family, row_number() OVER (ORDER BY icir DESC, mean_rank_ic DESC) AS o FROM hw WHERE raw),
sizes AS (SELECT unnest([2, 4]) AS most),
had AS (
  SELECT most, CAST(0 AS BIGINT) AS o, CAST([] AS VARCHAR[]) AS chosen FROM sizes
  UNION ALL
  SELECT a.most, q.o, CASE WHEN len(a.chosen) < a.most AND (SELECT count(*) FROM hc WHERE abs(c) >= 0.75 AND ((l = q.family AND list_contains(a.chosen, r)) OR (r = q.family AND list_contains(a.chosen, l)))) = 0
     THEN list_append(a.chosen, q.family) ELSE a.chosen END FROM had a JOIN ho q ON q.o = a.o + 1),
hl AS (SELECT most, chosen FROM had QUALIFY row_number() OVER (PARTITION BY most ORDER BY o DESC) = 1)"""
)


@query(
    "a05_horizon_qualification",
    out(
        _HZ_SQL,
        f"""SELECT family, CASE family {' '.join(f"WHEN '{f}' THEN {h}" for f, h in HORIZONS.items())} END AS horizon, mean_rank_ic, ic_std, icir, positive_years, sessions, raw AS qualified_raw,
        list_contains((SELECT chosen FROM hl WHERE most = 4), family) AS admitted_of_4, list_contains((SELECT chosen FROM hl WHERE most = 2), family) AS admitted_of_2 FROM hw""",
        "family:s horizon:i mean_rank_ic:f ic_std:f icir:f positive_years:i sessions:i qualified_raw:b admitted_of_4:b admitted_of_2:b",
    ),
)
def a05h(spark, sf):
    """Each family against the label of its own horizon, and the families admitted of at most four and at most two."""
    rows = rs.horizon_rows(library(spark, sf), HORIZONS, lambda h: ft.forward_label("ret", h), 0, TRAIN_END)
    ics = cut(rs.daily_ic(rows, "score", "label", ("family", "horizon", "session_idx"), tb.shape(spark, sf).wide))
    q = rs.qualification(ics, _year(spark, sf), min_years=2)
    ranked = [(r["family"], r["icir"], r["mean_rank_ic"]) for r in q.where("qualified_raw").collect()]  # a dozen families
    corr = {(r["left"], r["right"]): r["correlation"] for r in rs.family_correlation(ics).collect()}
    horizon = F.create_map(*(F.lit(x) for f, h in HORIZONS.items() for x in (f, h)))[F.col("family")]
    for most in (4, 2):
        chosen = rs.admit(ranked, corr, most=most)
        q = q.withColumn(f"admitted_of_{most}", F.col("family").isin(chosen) if chosen else F.lit(False))
    return finish(q.select("family", horizon.alias("horizon"), "mean_rank_ic", "ic_std", "icir", "positive_years", "sessions", "qualified_raw", "admitted_of_4", "admitted_of_2"))


@query("a11_icir_weights", out(_FAM_SQL + ", fw AS (SELECT *, greatest(coalesce(icir, 0), 0) AS raw FROM fz)",
    "SELECT family, mean_rank_ic, icir, CASE WHEN sum(CASE WHEN raw > 0 THEN 1 ELSE 0 END) OVER () >= 2 THEN raw / nullif(sum(raw) OVER (), 0) END AS weight FROM fw",
    "family:s mean_rank_ic:f icir:f weight:f"))
def a11(spark, sf):
    return finish(rs.icir_weights(family_ics(spark, sf)).select("family", "mean_rank_ic", "icir", "weight"))


@query(
    "a07_family_ic_by_year",
    out(
        _FAM_SQL.replace(f"AND label_end <= {TRAIN_END}", ""),
        "SELECT family, CASE WHEN session_idx <= 200 THEN 'train' ELSE 'test' END AS segment, year(c.session) AS year, avg(ic) AS mean_ic, avg(rank_ic) AS mean_rank_ic FROM fic JOIN cal c USING (session_idx) GROUP BY 1, 2, 3",
        "family:s segment:s year:i mean_ic:f mean_rank_ic:f",
    ),
)
def a07(spark, sf):
    seg = F.when(F.col("session_idx") <= TRAIN_END, "train").otherwise("test")
    g = family_ics(spark, sf, train=False).groupBy("family", seg.alias("segment"), _year(spark, sf).alias("year"))
    return finish(g.agg(F.avg("ic").alias("mean_ic"), F.avg("rank_ic").alias("mean_rank_ic")))


_HS = (1, 2, 4)


def _decay_sql():
    parts, ctes = [], []
    for h in _HS:
        ctes.append(f"hz{h} AS (SELECT session_idx, score, {label_sql(h)} AS label FROM rv)")
        ctes.append(ic_sql(f"hz{h}", "score", "label", f"hi{h}").strip())
        parts.append(f"SELECT {h} AS horizon, CASE WHEN session_idx <= {TRAIN_END} THEN 'train' ELSE 'test' END AS segment, avg(ic) AS mean_ic, avg(rank_ic) AS mean_rank_ic FROM hi{h} GROUP BY 2")
    return _REV.replace("SELECT *, -(", "SELECT *, -(") + "," + ",\n".join(ctes), " UNION ALL ".join(parts)


_DEC = _decay_sql()


@query("a06_ic_decay", out(_DEC[0], _DEC[1], "horizon:i segment:s mean_ic:f mean_rank_ic:f"))
def a06(spark, sf):
    wide = tb.shape(spark, sf).wide
    df = tb.residual_panel(spark, sf)
    df = df.withColumn("score", -fr.roll(F.sum, "residual", fr.ts(3), 2))
    df = df.withColumns({f"label_{h}": ft.forward_label("ret", h) for h in _HS})
    grid = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"label_{h}").alias("label")) for h in _HS])
    df = df.select("session_idx", "security_id", "score", F.explode(grid).alias("__h")).select("session_idx", "score", "__h.*")
    ic = rs.daily_ic(df, "score", "label", ("horizon", "session_idx"), wide)
    seg = F.when(F.col("session_idx") <= TRAIN_END, "train").otherwise("test")
    return finish(ic.groupBy("horizon", seg.alias("segment")).agg(F.avg("ic").alias("mean_ic"), F.avg("rank_ic").alias("mean_rank_ic")))


_TWO = ["reversal_3", "momentum_26_4"]
_RIDGE = f"""
tr AS (SELECT reversal_3 AS a, momentum_26_4 AS b, label AS y FROM ll WHERE reversal_3 IS NOT NULL AND momentum_26_4 IS NOT NULL AND label IS NOT NULL AND label_end <= {TRAIN_END}),
fit0 AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, avg(y) AS my, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM tr),
fit1 AS (SELECT *, cab / (sa * sb) AS g, cay / sa AS ra, cby / sb AS rb FROM fit0),
fit AS (SELECT *, (1.1 * ra - g * rb) / (1.1 * 1.1 - g * g) AS ca, (1.1 * rb - g * ra) / (1.1 * 1.1 - g * g) AS cb FROM fit1)"""


@query(
    "a08_ridge_calibration",
    out(
        LABEL_SQL + "," + _RIDGE,
        f"""SELECT l.session_idx, l.security_id, f.my + (l.reversal_3 - f.ma) / f.sa * f.ca + (l.momentum_26_4 - f.mb) / f.sb * f.cb AS prediction
        FROM ll l CROSS JOIN fit f WHERE l.session_idx > {TRAIN_END}""",
        "session_idx:i security_id:s prediction:f", 8,
    ),
)
def a08(spark, sf):
    df = labelled_library(spark, sf)
    fit = rs.ridge_calibration(df, _TWO, "label", "label_end", 0, TRAIN_END, 0.1, 500)
    later = df.where(F.col("session_idx") > fit.train_end)
    return finish(later.select("session_idx", "security_id", fit.predict().alias("prediction")), 8)


@query(
    "a09_walk_forward",
    out(
        LABEL_SQL
        + """,
bl AS (SELECT DISTINCT CAST(floor((session_idx - 150) / 21.0) AS INTEGER) AS block FROM ll WHERE session_idx >= 150),
tr AS (SELECT b.block, l.reversal_3 AS a, l.momentum_26_4 AS b, l.label AS y FROM bl b JOIN ll l ON l.label_end <= 149 + 21 * b.block WHERE reversal_3 IS NOT NULL AND momentum_26_4 IS NOT NULL AND label IS NOT NULL),
fit0 AS (SELECT block, count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, avg(y) AS my, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM tr GROUP BY 1),
fit1 AS (SELECT *, cab / (sa * sb) AS g, cay / sa AS ra, cby / sb AS rb FROM fit0),
fit AS (SELECT *, (1.1 * ra - g * rb) / (1.1 * 1.1 - g * g) AS ca, (1.1 * rb - g * ra) / (1.1 * 1.1 - g * g) AS cb FROM fit1)""",
        """SELECT l.session_idx, l.security_id, f.n AS train_samples, f.my + (l.reversal_3 - f.ma) / f.sa * f.ca + (l.momentum_26_4 - f.mb) / f.sb * f.cb AS prediction
        FROM ll l JOIN fit f ON f.block = CAST(floor((l.session_idx - 150) / 21.0) AS INTEGER) WHERE l.session_idx >= 150""",
        "session_idx:i security_id:s train_samples:i prediction:f", 8,
    ),
)
def a09(spark, sf):
    got = rs.walk_forward(labelled_library(spark, sf), _TWO, "label", "label_end", 150, 21, 0.1, 500)
    return finish(got.select("session_idx", "security_id", "train_samples", "prediction"), 8)


_SLOPE = f"""SELECT CASE WHEN session_idx <= {TRAIN_END} THEN 'train' ELSE 'test' END AS segment, sum(reversal_3 * {{y}}) / (sum(reversal_3 * reversal_3) + 1e-6) AS slope, count(*) AS observations,
  corr(reversal_3, {{y}}) AS pooled_correlation, avg(CASE WHEN sign(reversal_3) = sign({{y}}) THEN 1.0 ELSE 0.0 END) AS directional_accuracy
  FROM {{src}} WHERE reversal_3 IS NOT NULL AND {{y}} IS NOT NULL GROUP BY 1"""
_SC = "segment:s slope:f observations:i pooled_correlation:f directional_accuracy:f"


def _segmented(df):
    return df.withColumn("segment", F.when(F.col("session_idx") <= TRAIN_END, "train").otherwise("test"))


@query("a10_zero_intercept_slope", out(LABEL_SQL, _SLOPE.format(y="label", src="ll"), _SC))
def a10(spark, sf):
    s = rs.zero_intercept_slope(_segmented(labelled_library(spark, sf)), "reversal_3", "label", ["segment"])
    return finish(s.select("segment", "slope", "observations", "pooled_correlation", "directional_accuracy"))


@query(
    "a10_demeaned_slope",
    out(LABEL_SQL + ", dm AS (SELECT *, label - avg(label) OVER (PARTITION BY session_idx) AS dl FROM ll)", _SLOPE.format(y="dl", src="dm"), _SC),
)
def a10d(spark, sf):
    df = fr.xs_stats(labelled_library(spark, sf), "session_idx", tb.shape(spark, sf).wide, __m=F.avg("label"))
    df = df.withColumn("dl", F.col("label") - F.col("__m"))
    s = rs.zero_intercept_slope(_segmented(df), "reversal_3", "dl", ["segment"])
    return finish(s.select("segment", "slope", "observations", "pooled_correlation", "directional_accuracy"))


@query(
    "a12_content_digest",
    out(
        "",
        """SELECT l_returnflag AS flag, bit_xor(CAST(concat('0x', substr(md5(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(round(l_quantity * 100) AS BIGINT) AS VARCHAR)), 1, 15)) AS BIGINT)) AS digest,
        count(*) AS rows, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS total FROM lineitem GROUP BY 1""",
        "flag:s digest:i rows:i total:i",
    ),
)
def a12(spark, sf):
    li = tb.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return finish(rs.content_digest(li, ["l_extendedprice", "l_quantity"], ["flag"], 100))


@query(
    "a51_freeze_check",
    out(
        LABEL_SQL + f""", fz AS (SELECT sum(reversal_3 * label) / (sum(reversal_3 * reversal_3) + 1e-6) AS slope, count(*) AS n FROM ll WHERE label_end <= {TRAIN_END} AND reversal_3 IS NOT NULL AND label IS NOT NULL)""",
        "SELECT slope AS slope_then, slope AS slope_now, n AS rows_then, n AS rows_now, true AS digest_unchanged FROM fz", "slope_then:f slope_now:f rows_then:i rows_now:i digest_unchanged:b",
    ),
)
def a51(spark, sf):
    """Slope and digest of the train rows, from features of the history up to the train end and of the whole."""

    def fit(upto, tag):
        df = labelled_library(spark, sf, upto).where((F.col("label_end") <= TRAIN_END) & F.col("reversal_3").isNotNull() & F.col("label").isNotNull()).withColumn("one", F.lit(1))
        d = rs.content_digest(df, ["reversal_3", "label"], ["one"])
        s = rs.zero_intercept_slope(df, "reversal_3", "label", ["one"])
        return d.join(s, "one").select("one", F.col("digest").alias(f"d_{tag}"), F.col("slope").alias(f"slope_{tag}"), F.col("rows").alias(f"rows_{tag}"))

    j = fit(TRAIN_END, "then").join(fit(None, "now"), "one")
    return finish(j.select("slope_then", "slope_now", "rows_then", "rows_now", (F.col("d_then") == F.col("d_now")).alias("digest_unchanged")))


def _hac_sql(src, y, x, by, lags=10):
    u = ", ".join(f"lag(u, {k}) OVER o AS u{k}, lag(u * {x}, {k}) OVER o AS x{k}" for k in range(1, lags + 1))
    w = {k: 1 - k / (lags + 1) for k in range(1, lags + 1)}
    s00 = "u * u" + "".join(f" + 2 * {w[k]} * u * coalesce(u{k}, 0)" for k in w)
    s01 = f"u * u * {x}" + "".join(f" + {w[k]} * (u * coalesce(x{k}, 0) + u * {x} * coalesce(u{k}, 0))" for k in w)
    s11 = f"u * {x} * u * {x}" + "".join(f" + 2 * {w[k]} * u * {x} * coalesce(x{k}, 0)" for k in w)
    return f"""
hc0 AS (SELECT *, regr_slope({y}, {x}) OVER p AS b_, regr_intercept({y}, {x}) OVER p AS a_ FROM {src} WHERE {y} IS NOT NULL AND {x} IS NOT NULL WINDOW p AS (PARTITION BY {by})),
hc1 AS (SELECT *, {y} - a_ - b_ * {x} AS u FROM hc0),
hc2 AS (SELECT *, {u} FROM hc1 WINDOW o AS (PARTITION BY {by} ORDER BY session_idx)),
hc3 AS (SELECT {by}, count(*) AS n, sum({x}) AS sx, sum({x} * {x}) AS sxx, max(a_) AS a_, max(b_) AS b_, regr_r2({y}, {x}) AS r2, corr({y}, {x}) AS co, sum({s00}) AS s00, sum({s01}) AS s01, sum({s11}) AS s11 FROM hc2 GROUP BY {by}),
hc4 AS (SELECT *, sxx / (n * sxx - sx * sx) AS p, -sx / (n * sxx - sx * sx) AS q, n / (n * sxx - sx * sx) AS r FROM hc3),
hac AS (SELECT {by}, n AS sessions, a_ * 52 AS annualized_alpha, a_ / sqrt(p * p * s00 + 2 * p * q * s01 + q * q * s11) AS alpha_tstat, b_ AS market_beta,
   b_ / sqrt(q * q * s00 + 2 * q * r * s01 + r * r * s11) AS beta_tstat, r2 AS r_squared, co AS correlation FROM hc4)"""


HAC_COLS = "sector:s sessions:i annualized_alpha:f alpha_tstat:f market_beta:f beta_tstat:f r_squared:f correlation:f"


@query(
    "a24_hac_regression",
    out(
        RESIDUAL + ", sst AS (SELECT sector, session_idx, avg(ret) AS y, max(market) AS x FROM ep WHERE ret IS NOT NULL GROUP BY 1, 2)," + _hac_sql("sst", "y", "x", "sector"),
        "SELECT * FROM hac", HAC_COLS, 5,
    ),
)
def a24(spark, sf):
    p = tb.panel(spark, sf).where(F.col("ret").isNotNull())
    s = p.groupBy("sector", "session_idx").agg(F.avg("ret").alias("y"), F.max("market").alias("x"))
    return finish(rs.hac_regression(s, "y", "x", ["sector"], periods=52.0), 5)


@query(
    "a36_score_correlation",
    out(
        LIBRARY_SQL + ", pc AS (SELECT session_idx, corr(reversal_3, high_52) AS c FROM lib GROUP BY 1)",
        "SELECT (SELECT corr(reversal_3, high_52) FROM lib) AS pooled, (SELECT avg(CASE WHEN NOT isnan(c) THEN c END) FROM pc) AS daily_mean, (SELECT count(CASE WHEN NOT isnan(c) THEN c END) FROM pc) AS sessions",
        "pooled:f daily_mean:f sessions:i",
    ),
)
def a36(spark, sf):
    df = library(spark, sf)
    daily = df.groupBy("session_idx").agg(
        fr.correlation("reversal_3", "high_52").alias("c"),
        *[F.sum(x).alias(n) for n, x in {
            "n": F.when(F.col("reversal_3").isNotNull() & F.col("high_52").isNotNull(), 1),
            "sx": F.when(F.col("high_52").isNotNull(), F.col("reversal_3")),
            "sy": F.when(F.col("reversal_3").isNotNull(), F.col("high_52")),
            "sxy": F.col("reversal_3") * F.col("high_52"),
            "sxx": F.when(F.col("high_52").isNotNull(), F.col("reversal_3") * F.col("reversal_3")),
            "syy": F.when(F.col("reversal_3").isNotNull(), F.col("high_52") * F.col("high_52")),
        }.items()],
    )
    # pooled correlation from the per-session moments: one pass over the panel
    n, sx, sy, sxy, sxx, syy = (F.sum(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy"))
    pooled = (n * sxy - sx * sy) / F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return finish(daily.agg(pooled.alias("pooled"), F.avg("c").alias("daily_mean"), F.count("c").alias("sessions")))
