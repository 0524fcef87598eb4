"""As-of, interval, bitemporal, fundamental and futures queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweft.functions.dates import index_sessions
from panelweft.operators import fundamentals as fd
from panelweft.operators import futures as fu
from panelweft.operators import temporal as tp
from panelweft.plans.registry import finish, out, query
from panelweft.plans.sqlbase import WEEKLY, at, pct_rank, roll
from panelweft.sources import events as ev
from panelweft.sources import tables as tb

REV_SQL = """
rev AS (SELECT l_orderkey AS event_id, o_custkey AS security_id, o_orderdate AS effective_at, l_shipdate AS available_at,
  CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN 'DELISTED' WHEN l_returnflag = 'N' THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate),
vis AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY available_at DESC, status DESC, price DESC) AS rn
  FROM rev WHERE available_at <= TIMESTAMP '1999-01-01' AND effective_at <= TIMESTAMP '1999-01-01') WHERE rn = 1)"""

FIL_SQL = """
fil AS (SELECT o_custkey AS symbol, c_mktsegment AS sector, CAST(o_orderdate AS DATE) AS available_at, o_orderkey AS accession,
  (o_orderkey % 97) / 97.0::DOUBLE AS profitability, (o_orderkey % 89) / 89.0::DOUBLE AS gross_profitability,
  CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 83) / 83.0::DOUBLE END AS cash_profitability,
  ((o_custkey * 31 + o_orderkey) % 101) / 101.0::DOUBLE AS accrual_quality,
  CASE WHEN o_orderkey % 11 <> 0 THEN -round(o_totalprice) / 100000.0::DOUBLE END AS asset_growth,
  CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 79) / 79.0::DOUBLE END AS revenue_growth
  FROM orders JOIN customer ON o_custkey = c_custkey),
fil1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, available_at ORDER BY accession DESC) AS rn FROM fil) WHERE rn = 1),
fil2 AS (SELECT *, lead(available_at) OVER (PARTITION BY symbol ORDER BY available_at) AS nxt FROM fil1),
asf AS (SELECT f.*, c.session, c.session_idx, date_diff('day', f.available_at, c.session) AS age FROM fil2 f JOIN cal c
  ON c.session >= f.available_at AND c.session < coalesce(f.nxt, DATE '2100-01-01') AND date_diff('day', f.available_at, c.session) <= 400)"""

SCD_SQL = """
scd AS (SELECT c_custkey AS entity_id, CAST(c_custkey AS VARCHAR) AS cik, c_mktsegment AS sector, (c_custkey % 10) <> 9 AS is_primary_ticker,
    'A' || c_custkey AS symbol, DATE '1990-01-01' AS valid_from, DATE '1996-01-01' + CAST(c_custkey % 700 AS INTEGER) - 1 AS valid_to FROM customer
  UNION ALL
  SELECT c_custkey, CAST(c_custkey AS VARCHAR), c_mktsegment, (c_custkey % 10) <> 9, 'B' || c_custkey, DATE '1996-01-01' + CAST(c_custkey % 700 AS INTEGER), CAST(NULL AS DATE) FROM customer),
mem AS (SELECT CASE WHEN o_custkey % 6 = 0 THEN 'Mid Cap' WHEN o_custkey % 6 = 1 THEN 'large cap' WHEN o_custkey % 6 = 2 THEN 'LargeCap' ELSE 'Large Cap' END AS index_name, CAST(o_custkey AS VARCHAR) AS cik,
   CASE WHEN o_custkey % 11 = 0 THEN e - 18262 ELSE e END AS effective_date, CASE WHEN o_custkey % 4 <> 0 THEN e + CAST((o_custkey % 5 + 1) * 200 AS INTEGER) END AS removal_date
  FROM (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS e FROM orders GROUP BY 1)),
md AS (SELECT c.session, c.session_idx, m.cik, s.entity_id, s.symbol, s.sector FROM mem m JOIN cal c ON upper(replace(m.index_name, ' ', '')) = 'LARGECAP' AND m.effective_date <= c.session AND (m.removal_date IS NULL OR m.removal_date > c.session)
  JOIN scd s ON s.cik = m.cik AND s.is_primary_ticker AND s.valid_from <= c.session AND (s.valid_to IS NULL OR s.valid_to >= c.session))"""


def days(spark, sf):
    sh = tb.shape(spark, sf)
    return tp.day_map(tb.calendar(spark, sf), sh.first, sh.last)


def _asof_filings(spark, sf, carry):
    f = ev.filing_events(spark, sf)
    return carry(f, "symbol", "available_at", days(spark, sf), 400, ev.horizon(spark, sf), ("accession",))


def with_session(spark, sf, df):
    return tb.attach(df, tb.calendar(spark, sf), "session_idx", tb.shape(spark, sf).sessions)


def expanded_filings(spark, sf):
    """Latest filing per symbol and session, at most 400 days old."""
    e = with_session(spark, sf, _asof_filings(spark, sf, tp.asof_events))
    return e.withColumn("age", F.date_diff("session", "available_at"))


@query(
    "j01_asof_filings",
    out(WEEKLY + "," + FIL_SQL, "SELECT symbol, session, available_at, accession, age, profitability, revenue_growth FROM asf",
        "symbol:i session:d available_at:d accession:i age:i profitability:f revenue_growth:f"),
)
def j01(spark, sf):
    return finish(expanded_filings(spark, sf).select("symbol", "session", "available_at", "accession", "age", "profitability", "revenue_growth"))


@query(
    "j02_asof_contract",
    out(
        """df AS (SELECT user_id, ts, event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'signup'),
        ex AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type <> 'signup' AND user_id IN (SELECT user_id FROM df)),
        jn AS (SELECT e.user_id, e.event_id, e.value, d.event_id AS def_id, d.k, row_number() OVER (PARTITION BY e.event_id ORDER BY d.ts DESC, d.event_id DESC NULLS LAST) AS rn
          FROM ex e LEFT JOIN df d ON d.user_id = e.user_id AND d.ts <= e.ts)""",
        "SELECT user_id AS instrument_id, event_id, value, def_id, k FROM jn WHERE rn = 1",
        "instrument_id:i event_id:i value:f def_id:i k:i",
    ),
)
def j02(spark, sf):
    e, d = ev.messages(spark, sf)
    got = tp.attach_asof(e, d, "instrument_id", "ts_event", "def_ts", ["def_id", "k"], None, ("def_id",))
    return finish(got.select("instrument_id", "event_id", "value", "def_id", "k"))


@query(
    "j03_scd_interval_join",
    out(
        WEEKLY + "," + FIL_SQL + "," + SCD_SQL,
        """SELECT f.symbol AS entity_id, f.accession, s.symbol, s.is_primary_ticker FROM fil f JOIN scd s ON s.entity_id = f.symbol
        AND s.valid_from <= f.available_at AND (s.valid_to IS NULL OR s.valid_to >= f.available_at)""",
        "entity_id:i accession:i symbol:s is_primary_ticker:b",
    ),
)
def j03(spark, sf):
    f = ev.filing_events(spark, sf).select(F.col("symbol").alias("entity_id"), "accession", "available_at")
    got = tp.scd_join(f, ev.scd_map(spark, sf).select("entity_id", "symbol", "valid_from", "valid_to", "is_primary_ticker"), "entity_id", "available_at")
    return finish(got.select("entity_id", "accession", "symbol", "is_primary_ticker"))


def members(spark, sf):
    return tp.membership_daily(
        ev.membership(spark, sf), ev.scd_map(spark, sf), days(spark, sf),
        tp.Bounded(tb.calendar(spark, sf), tb.shape(spark, sf).sessions), ev.horizon(spark, sf), ["Large Cap"],
    )


@query("j04_membership_daily", out(WEEKLY + "," + SCD_SQL, "SELECT session, cik, entity_id, symbol, sector FROM md", "session:d cik:s entity_id:i symbol:s sector:s"))
def j04(spark, sf):
    return finish(members(spark, sf).select("session", "cik", "entity_id", "symbol", "sector"))


@query(
    "j05_security_map",
    out(
        "",
        """sec AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 17 <> 0 THEN s_suppkey END AS entity_id, s_name AS symbol, s_nationkey FROM supplier),
        refr AS (SELECT o.id, min(struct_pack(cik := CAST(n AS VARCHAR), sector := r_name)) AS r FROM (SELECT s_suppkey AS id, s_nationkey AS n FROM supplier WHERE s_suppkey % 13 <> 0) o
          JOIN nation ON n_nationkey = n JOIN region ON r_regionkey = n_regionkey GROUP BY 1)
        SELECT sec.id, sec.entity_id, sec.symbol, refr.r.cik AS cik, refr.r.sector AS sector FROM sec JOIN refr USING (id) WHERE entity_id IS NOT NULL""".replace(
            "SELECT sec.id", "SELECT sec.id"
        ),
        "id:i entity_id:i symbol:s cik:s sector:s",
    ).replace("WITH final AS (\nsec AS", "WITH sec AS", 1).replace("GROUP BY 1)\n        SELECT", "GROUP BY 1),\nfinal AS (SELECT", 1),
)
def j05(spark, sf):
    s = tb.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    sec = s.select(k.alias("id"), F.when(k % 17 != 0, k).alias("entity_id"), F.col("s_name").alias("symbol"), F.lit("1990-01-01").cast("date").alias("valid_from"))
    once = s.where(k % 13 != 0).join(tb.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        tb.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(k.alias("security_id"), F.col("s_nationkey").cast("string").alias("cik"), F.col("r_name").alias("sector"))
    got = tp.security_map(sec, once.unionByName(once))
    return finish(got.select("id", "entity_id", "symbol", "cik", "sector"))


@query(
    "j06_validated_join",
    out(
        "",
        """SELECT count(*) AS rows_left, count(o_orderkey) AS matched, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys
        FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o_orderkey""",
        "rows_left:i matched:i duplicate_keys:i",
    ),
)
def j06(spark, sf):
    li = tb.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    od = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    joined = tp.validated_left_join(li, od.where("o_orderstatus <> 'P'").select("key"), ["key"])
    a = joined.agg(F.count("*").alias("rows_left"), F.sum(F.col("matched").cast("int")).alias("matched"))
    b = tp.key_violations(od, ["key"]).agg(F.count("*").alias("duplicate_keys"))
    return finish(a.withColumn("duplicate_keys", b.scalar()))


@query(
    "j07_visible_as_of",
    out(REV_SQL, "SELECT event_id, security_id, effective_at, available_at, status, price FROM vis",
        "event_id:i security_id:i effective_at:t available_at:t status:s price:i"),
)
def j07(spark, sf):
    v = tp.visible_as_of(ev.revisions(spark, sf), F.lit(ev.DECISION).cast("timestamp"), ties=("status", "price"))
    return finish(v.select("event_id", "security_id", "effective_at", "available_at", "status", "price"))


@query(
    "j07_current_state",
    out(REV_SQL, """SELECT security_id, event_id, effective_at, status FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY effective_at DESC, event_id DESC) AS rn FROM vis) WHERE rn = 1""",
        "security_id:i event_id:i effective_at:t status:s"),
)
def j07b(spark, sf):
    v = tp.visible_as_of(ev.revisions(spark, sf), F.lit(ev.DECISION).cast("timestamp"), ties=("status", "price"))
    return finish(tp.current_state(v, ties=("event_id",)).select("security_id", "event_id", "effective_at", "status"))


@query(
    "j08_status_asof_session",
    out(
        WEEKLY + "," + REV_SQL
        + """, st AS (SELECT * EXCLUDE (rn), lead(d) OVER (PARTITION BY security_id ORDER BY d) AS nxt FROM (SELECT *, CAST(effective_at AS DATE) AS d,
          row_number() OVER (PARTITION BY security_id, CAST(effective_at AS DATE) ORDER BY event_id DESC) AS rn FROM vis) WHERE rn = 1)""",
        "SELECT s.security_id, c.session, s.status FROM st s JOIN cal c ON c.session >= s.d AND c.session < coalesce(s.nxt, DATE '2100-01-01')",
        "security_id:i session:d status:s",
    ),
)
def j08(spark, sf):
    v = tp.visible_as_of(ev.revisions(spark, sf), F.lit(ev.DECISION).cast("timestamp"), ties=("status", "price"))
    v = v.select("security_id", F.to_date("effective_at").alias("day"), "event_id", "status")
    e = tp.asof_events(v, "security_id", "day", days(spark, sf), None, ev.horizon(spark, sf), ("event_id",))
    e = tb.attach(e, tb.calendar(spark, sf), "session_idx", tb.shape(spark, sf).sessions)
    return finish(e.select("security_id", "session", "status"))


@query(
    "j09_reconcile_outer",
    out(
        """a AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS security_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS session FROM lineitem WHERE l_returnflag <> 'R'),
        b AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS security_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS session FROM lineitem WHERE l_returnflag <> 'A')""",
        """SELECT coalesce(a.security_id, b.security_id) AS security_id, coalesce(a.session, b.session) AS session, CASE WHEN b.session IS NULL THEN 'left_only' ELSE 'right_only' END AS side
        FROM a FULL JOIN b ON a.security_id = b.security_id AND a.session = b.session WHERE a.session IS NULL OR b.session IS NULL""",
        "security_id:s session:d side:s",
    ),
)
def j09(spark, sf):
    li = tb.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("security_id"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("session"), "l_returnflag"
    )
    return finish(tp.reconcile(li.where("l_returnflag <> 'R'"), li.where("l_returnflag <> 'A'"), ["security_id", "session"]))


FACT_SQL = (
    """
fct AS (SELECT o_custkey AS entity_id, l_orderkey AS accession_id,
   CASE l_partkey % 6 WHEN 0 THEN 'assets' WHEN 1 THEN 'revenue' WHEN 2 THEN 'gross_profit' WHEN 3 THEN 'net_income' WHEN 4 THEN 'operating_cash_flow' END AS concept,
   l_linenumber AS priority, round(l_extendedprice) - 20000 AS value, l_quantity > 5 AS same_period, l_suppkey % 100 + 340 AS span,
   make_date(year(o_orderdate) - 1, 12, 31) AS period_end, greatest(l_shipdate, o_orderdate) AS accepted_at,
   CASE WHEN o_orderkey % 10 < 7 THEN '10-K' WHEN o_orderkey % 10 = 7 THEN '10-k/a' ELSE '10-Q' END AS form_type, o_orderkey % 10 = 7 AS is_amendment
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fct1 AS (SELECT *, CAST(accepted_at AS DATE) + CASE isodow(accepted_at) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS availability_date FROM fct
   WHERE form_type <> '10-Q' AND same_period AND (concept IS NULL OR concept = 'assets' OR span BETWEEN 300 AND 430)),
fct2 AS (SELECT f.*, s.symbol, s.cik, s.sector, s.is_primary_ticker FROM fct1 f JOIN scd s ON s.entity_id = f.entity_id AND s.valid_from <= f.availability_date
   AND (s.valid_to IS NULL OR s.valid_to >= f.availability_date) WHERE concept IS NOT NULL),
fct3 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, accession_id, concept ORDER BY NOT is_primary_ticker, priority, symbol, availability_date, value) AS rn FROM fct2) WHERE rn = 1),
fe0 AS (SELECT symbol, cik, sector, entity_id, accession_id, form_type, is_amendment, availability_date, period_end, """
    + ", ".join(f"min(value) FILTER (WHERE concept = '{m}') AS {m}" for m in fd.MEASURES)
    + """ FROM fct3 GROUP BY ALL),
fe1 AS (SELECT *, CASE WHEN assets > 0 THEN net_income / assets END AS profitability, CASE WHEN assets > 0 THEN gross_profit / assets END AS gross_profitability,
   CASE WHEN assets > 0 THEN operating_cash_flow / assets END AS cash_profitability, CASE WHEN assets > 0 THEN (operating_cash_flow - net_income) / assets END AS accrual_quality FROM fe0),
fe2 AS (SELECT a.entity_id, a.accession_id, a.availability_date AS ad, b.period_end, b.assets, b.revenue,
   row_number() OVER (PARTITION BY a.entity_id, a.accession_id, a.availability_date ORDER BY b.period_end DESC, b.availability_date DESC, b.accession_id DESC) AS rn
   FROM fe1 a JOIN fe1 b ON a.entity_id = b.entity_id AND b.period_end < a.period_end AND b.availability_date <= a.availability_date),
fev AS (SELECT e.*, CASE WHEN p.assets > 0 THEN -(e.assets / p.assets - 1) END AS asset_growth, CASE WHEN p.revenue > 0 THEN e.revenue / p.revenue - 1 END AS revenue_growth
   FROM fe1 e LEFT JOIN fe2 p ON p.entity_id = e.entity_id AND p.accession_id = e.accession_id AND p.ad = e.availability_date AND p.rn = 1)"""
)


def filing_table(spark, sf):
    facts, filings = ev.facts(spark, sf)
    return fd.fundamental_events(facts, filings, ev.scd_map(spark, sf))


@query(
    "c05_fundamental_events",
    out(
        WEEKLY + "," + SCD_SQL + "," + FACT_SQL,
        """SELECT symbol, entity_id, accession_id, availability_date, period_end, assets, revenue, profitability, gross_profitability, cash_profitability,
        accrual_quality, asset_growth, revenue_growth, is_amendment AS restatement_flag FROM fev""",
        "symbol:s entity_id:i accession_id:i availability_date:d period_end:d assets:f revenue:f profitability:f gross_profitability:f cash_profitability:f accrual_quality:f asset_growth:f revenue_growth:f restatement_flag:b",
    ),
)
def c05(spark, sf):
    return finish(
        filing_table(spark, sf).select(
            "symbol", "entity_id", "accession_id", "availability_date", "period_end", "assets", "revenue", "profitability",
            "gross_profitability", "cash_profitability", "accrual_quality", "asset_growth", "revenue_growth", "restatement_flag",
        )
    )


@query(
    "j10_prior_vintage",
    out(
        """ft AS (SELECT o_custkey AS entity_id, o_orderkey AS accession, CAST(o_orderdate AS DATE) AS filed, make_date(year(o_orderdate) - CAST(o_orderkey % 3 AS INTEGER), 12, 31) AS period_end,
          round(o_totalprice) - 30000 AS assets FROM orders),
        pv AS (SELECT a.accession, b.period_end AS pp, b.assets AS pa, row_number() OVER (PARTITION BY a.accession ORDER BY b.period_end DESC, b.filed DESC, b.accession DESC) AS rn
          FROM ft a JOIN ft b ON a.entity_id = b.entity_id AND b.period_end < a.period_end AND b.filed <= a.filed)""",
        """SELECT f.entity_id, f.accession, p.pp AS prior_period, CASE WHEN p.pa > 0 THEN -(f.assets / p.pa - 1) END AS asset_growth
        FROM ft f LEFT JOIN pv p ON p.accession = f.accession AND p.rn = 1""",
        "entity_id:i accession:i prior_period:d asset_growth:f",
    ),
)
def j10(spark, sf):
    o = tb.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("accession"), F.to_date("o_orderdate").alias("filed"),
        F.make_date((F.year("o_orderdate") - F.col("o_orderkey") % 3).cast("int"), F.lit(12), F.lit(31)).alias("period_end"),
        (F.round("o_totalprice") - 30000).alias("assets"),
    )
    got = tp.prior_vintage_growth(o, "entity_id", "filed", {"asset_growth": ("assets", -1.0)}, "accession")
    return finish(got.select("entity_id", "accession", "prior_period", "asset_growth"))


@query(
    "a45_filing_ratios",
    out(WEEKLY + "," + SCD_SQL + "," + FACT_SQL,
        "SELECT entity_id, accession_id, symbol, availability_date, profitability, gross_profitability, cash_profitability, accrual_quality FROM fe1",
        "entity_id:i accession_id:i symbol:s availability_date:d profitability:f gross_profitability:f cash_profitability:f accrual_quality:f"),
)
def a45(spark, sf):
    return finish(filing_table(spark, sf).select("entity_id", "accession_id", "symbol", "availability_date", "profitability", "gross_profitability", "cash_profitability", "accrual_quality"))


@query(
    "j16_annual_filings_join",
    out(WEEKLY + "," + SCD_SQL + "," + FACT_SQL,
        "SELECT entity_id, accession_id, concept, priority, value, accepted_at, availability_date FROM fct1",
        "entity_id:i accession_id:i concept:s priority:i value:f accepted_at:t availability_date:d"),
)
def j16(spark, sf):
    facts, filings = ev.facts(spark, sf)
    got = fd.annual_facts(facts, filings)
    return finish(got.select("entity_id", "accession_id", "concept", "priority", "value", "accepted_at", "availability_date"))


def _frank(c):
    return f"""CASE WHEN count(v_{c}) OVER g >= 5 THEN (({pct_rank(f'v_{c}', 'session_idx, sector')}) * count(v_{c}) OVER g - (count(v_{c}) OVER g + 1) / 2.0) / ((count(v_{c}) OVER g - 1) / 2.0) END AS k_{c}"""


_C = fd.COMPONENTS
SCORES_SQL = (
    FIL_SQL
    + ", fs0 AS (SELECT *, "
    + ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, quantile_cont({c}, 0.01) OVER g), quantile_cont({c}, 0.99) OVER g) END, 9) AS v_{c}" for c in _C)
    + " FROM asf WINDOW g AS (PARTITION BY session_idx, sector)), fs1 AS (SELECT *, "
    + ", ".join(_frank(c) for c in _C)
    + ", count(*) OVER (PARTITION BY session_idx) AS names FROM fs0 WINDOW g AS (PARTITION BY session_idx, sector)), fs2 AS (SELECT *, "
    + " + ".join(f"(k_{c} IS NOT NULL)::INT" for c in _C[:4]) + " AS qn, " + " + ".join(f"(k_{c} IS NOT NULL)::INT" for c in _C[4:]) + " AS gn, "
    + " + ".join(f"coalesce(k_{c}, 0)" for c in _C[:4]) + " AS qs, " + " + ".join(f"coalesce(k_{c}, 0)" for c in _C[4:]) + " AS gsum FROM fs1)"
)


#: Most names of a sector whose six numbers one task holds and ranks, session after session: some 500 bytes a name that counts at a time.
SCORED_NAMES = 4_000_000


def fundamental_scores(spark, sf):
    most = tb._once(spark, sf, "largest segment", lambda: tb.table(spark, sf, "customer").groupBy("c_mktsegment").count().agg(F.max("count")).first()[0] or 0)
    if most > SCORED_NAMES:
        return fd.fundamental_scores(expanded_filings(spark, sf).select("symbol", "session", "session_idx", "sector", *fd.COMPONENTS), 100, wide=True)
    return with_session(spark, sf, fd.span_scores(_asof_filings(spark, sf, tp.asof_spans), 100))


@query(
    "w38_fundamental_scores",
    out(
        WEEKLY + "," + SCORES_SQL,
        """SELECT symbol, session, qn AS quality_components, gn AS growth_components, CASE WHEN names >= 100 AND qn >= 2 THEN qs / qn END AS quality_score,
        CASE WHEN names >= 100 AND gn >= 2 THEN gsum / gn END AS conservative_growth_score FROM fs2""",
        "symbol:i session:d quality_components:i growth_components:i quality_score:f conservative_growth_score:f",
    ),
)
def w38(spark, sf):
    return finish(fundamental_scores(spark, sf).select("symbol", "session", "quality_components", "growth_components", "quality_score", "conservative_growth_score"))


FUT_SQL = """
fd0 AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, p_brand AS root, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS expiry_date,
   CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS settlement,
   sum(CAST(l_quantity AS BIGINT)) AS volume, count(*) AS open_interest
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
   WHERE date_trunc('quarter', l_shipdate) > date_trunc('week', o_orderdate) GROUP BY 1, 2, 3),
fdl AS (SELECT *, root || '_' || strftime(expiry_date, '%Y%m') AS contract FROM fd0),
fm0 AS (SELECT DISTINCT root, contract, expiry_date, expiry_date - 3 AS ltd, CASE WHEN month(expiry_date) <> 7 THEN expiry_date - 10 END AS fnd, month(expiry_date) = 4 AS cash FROM fdl),
fm1 AS (SELECT *, CASE WHEN cash THEN ltd WHEN fnd IS NOT NULL THEN least(fnd, ltd) END AS deadline FROM fm0),
fm AS (SELECT *, deadline - CASE isodow(deadline) WHEN 6 THEN 5 + 0 + CASE WHEN true THEN 0 END WHEN 7 THEN 6 + 0 ELSE 7 END AS last_eligible FROM fm1),
cv0 AS (SELECT d.*, m.last_eligible, row_number() OVER (PARTITION BY d.date, d.root ORDER BY d.expiry_date, d.contract) AS rk FROM fdl d JOIN fm m USING (root, contract)
   WHERE d.settlement > 0 AND d.date < m.last_eligible),
crv AS (SELECT a.date, a.root, a.contract AS front_contract, a.settlement AS front_settlement, a.expiry_date AS front_expiry, b.contract AS next_contract, b.settlement AS next_settlement,
   date_diff('day', a.expiry_date, b.expiry_date) AS tenor_days, ln(a.settlement / b.settlement) * 365.25 / date_diff('day', a.expiry_date, b.expiry_date) AS carry_annualized
   FROM cv0 a LEFT JOIN cv0 b ON a.date = b.date AND a.root = b.root AND b.rk = 2 WHERE a.rk = 1),
hl0 AS (SELECT *, lag(front_contract) OVER (PARTITION BY root ORDER BY date) AS held, lag(date) OVER (PARTITION BY root ORDER BY date) AS pdate FROM crv),
hld AS (SELECT h.date, h.root, h.held AS held_contract, c.settlement / p.settlement - 1 AS excess_return, coalesce(h.front_contract <> h.held, false) AS roll_trade
   FROM hl0 h LEFT JOIN fdl c ON c.date = h.date AND c.root = h.root AND c.contract = h.held LEFT JOIN fdl p ON p.date = h.pdate AND p.root = h.root AND p.contract = h.held)"""


@query(
    "w36_contract_curve",
    out(FUT_SQL, "SELECT date, root, front_contract, front_settlement, next_contract, next_settlement, tenor_days, carry_annualized FROM crv",
        "date:d root:s front_contract:s front_settlement:f next_contract:s next_settlement:f tenor_days:i carry_annualized:f"),
)
def w36(spark, sf):
    c = fu.contract_curve(*ev.futures(spark, sf))
    return finish(c.select("date", "root", "front_contract", "front_settlement", "next_contract", "next_settlement", "tenor_days", "carry_annualized"))


@query(
    "j12_front_next",
    out(FUT_SQL, "SELECT date, root, front_contract, front_expiry AS front_expiry_date, next_contract FROM crv", "date:d root:s front_contract:s front_expiry_date:d next_contract:s"),
)
def j12(spark, sf):
    return finish(fu.contract_curve(*ev.futures(spark, sf)).select("date", "root", "front_contract", "front_expiry_date", "next_contract"))


@query(
    "j11_held_contract_prices",
    out(FUT_SQL, "SELECT date, root, held_contract, excess_return, roll_trade FROM hld", "date:d root:s held_contract:s excess_return:f roll_trade:b"),
)
def j11(spark, sf):
    daily, meta = ev.futures(spark, sf)
    return finish(fu.held_contract_returns(fu.contract_curve(daily, meta), daily))


_RS = "(PARTITION BY root ORDER BY session_idx RANGE BETWEEN {} PRECEDING AND {})"


def _rsum(h):
    n = h - 4
    return roll("sum({})", "ln(1 + excess_return)", _RS.format(n + 3, "4 PRECEDING"), max(1, n // 12))


@query(
    "w37_root_signals",
    out(
        FUT_SQL
        + f""",
rc AS (SELECT DISTINCT date FROM crv), ri AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session_idx FROM rc),
rp AS (SELECT c.date, c.root, CAST(i.session_idx AS BIGINT) AS session_idx, h.excess_return, c.carry_annualized FROM crv c JOIN ri i USING (date) LEFT JOIN hld h USING (date, root)),
rq AS (SELECT *, 0.25 * ({_rsum(13)}) + 0.35 * ({_rsum(26)}) + 0.4 * ({_rsum(52)}) AS trend, ({roll('stddev_samp({})', 'excess_return', _RS.format(26, '1 PRECEDING'), 4)}) * sqrt(52.0) AS pv,
  {roll('avg({})', 'carry_annualized', _RS.format(52, '1 PRECEDING'), 26)} AS cm, {roll('stddev_pop({})', 'carry_annualized', _RS.format(52, '1 PRECEDING'), 26)} AS cs FROM rp)""",
        """SELECT date, root, CASE WHEN pv IS NOT NULL THEN trend / greatest(pv, 0.08) END AS trend_score, CASE WHEN carry_annualized IS NOT NULL AND cs > 0 THEN greatest(-5, least(5, (carry_annualized - cm) / cs)) END AS carry_score,
        pv AS prior_volatility FROM rq""",
        "date:d root:s trend_score:f carry_score:f prior_volatility:f",
    ),
)
def w37(spark, sf):
    daily, meta = ev.futures(spark, sf)
    curve = fu.contract_curve(daily, meta)
    held = fu.held_contract_returns(curve, daily)
    cal = index_sessions(curve.select(F.col("date").alias("session")).distinct()).withColumnRenamed("session", "date")
    p = curve.select("date", "root", "carry_annualized").join(held.select("date", "root", "excess_return"), ["date", "root"], "left")
    p = tb.attach(p, cal, "date", tb.shape(spark, sf).sessions)
    p = fu.root_signals(p, ((13, 0.25), (26, 0.35), (52, 0.40)), 4, (26, 4), (52, 26), 52.0, {13: 1, 26: 1, 52: 4})
    return finish(p.select("date", "root", "trend_score", "carry_score", "prior_volatility"))


@query(
    "w34_terminal_reuse",
    out(
        REV_SQL + """, tf AS (SELECT security_id, min(struct_pack(e := effective_at, i := event_id)) AS f FROM vis WHERE status = 'DELISTED' GROUP BY 1)""",
        """SELECT v.security_id, v.event_id, v.effective_at, v.status FROM vis v JOIN tf USING (security_id)
        WHERE v.status <> 'DELISTED' AND struct_pack(e := v.effective_at, i := v.event_id) > tf.f""",
        "security_id:i event_id:i effective_at:t status:s",
    ),
)
def w34(spark, sf):
    v = tp.visible_as_of(ev.revisions(spark, sf), F.lit(ev.DECISION).cast("timestamp"), ties=("status", "price"))
    got = tp.terminal_reuse(v, ["DELISTED"], ties=("event_id",))
    return finish(got.select("security_id", "event_id", "effective_at", "status"))


@query(
    "j13_densify",
    out(
        WEEKLY + ", gr AS (SELECT s.security_id, c.session, l.q FROM (SELECT DISTINCT security_id FROM lwi) s CROSS JOIN cal c LEFT JOIN lwi l ON l.security_id = s.security_id AND l.session_idx = c.session_idx)",
        "SELECT security_id, count(*) AS cells, count(q) AS present, count(q) / CAST(count(*) AS DOUBLE) AS coverage FROM gr GROUP BY 1",
        "security_id:s cells:i present:i coverage:f",
    ),
)
def j13(spark, sf):
    g = tb.on_calendar(tb.bars(spark, sf).select("security_id", "session_idx", "volume"), tb.shape(spark, sf).sessions)
    return finish(
        g.groupBy("security_id").agg(
            F.count("*").alias("cells"), F.count("volume").alias("present"), (F.count("volume") / F.count("*")).alias("coverage")
        )
    )


@query(
    "j15_subset_check",
    out(
        "",
        "SELECT o_custkey AS key, 'order_without_urgent' AS rule FROM (SELECT DISTINCT o_custkey FROM orders) o WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
        "key:i rule:s",
    ),
)
def j15(spark, sf):
    o = tb.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), "o_orderpriority")
    got = tp.subset_violations(o, o.where("o_orderpriority = '1-URGENT'"), ["key"])
    return finish(got.withColumn("rule", F.lit("order_without_urgent")))


# --- message normaliser ------------------------------------------------------------------


def message_tables(spark, sf):
    """Definitions, bars and statistics built from the events table."""
    e = tb.table(spark, sf, "events")
    k = F.from_json("props", "k INT")["k"]
    root = F.concat(F.lit("R"), (F.col("user_id") % 7).cast("string"))
    sym = F.concat_ws("_", root, F.col("user_id").cast("string"), (k % 3).cast("string"))
    defs = e.where("event_type = 'signup'").select(
        F.col("ts").alias("ts_recv"), root.alias("root"), F.col("user_id").alias("instrument_id"), sym.alias("raw_symbol"),
        F.when(F.col("event_id") % 5 == 0, "FUTURE").otherwise("F").alias("instrument_class"), F.lit("A").alias("security_update_action"),
        F.date_add(F.to_date("ts"), (90 + k % 30)).cast("timestamp").alias("expiration"), (F.col("value") / 100).alias("min_price_increment"),
        F.when(k % 2 == 0, k.cast("double")).otherwise(0.0).alias("unit_of_measure_qty"), F.lit(50.0).alias("contract_multiplier"),
        F.lit("X").alias("exchange"), F.lit("USD").alias("currency"),
    )
    v = F.col("value")
    bars = e.where("event_type in ('view', 'click', 'error')").select(
        F.col("ts").alias("ts_event"), F.col("user_id").alias("instrument_id"), v.alias("open"), (v + 1).alias("high"), (v - 1).alias("low"), v.alias("close"),
        (k + 1).cast("bigint").alias("volume"),
    )
    code = F.element_at(F.array(*[F.lit(c) for c in (3, 6, 9, 1, 4, 5, 2)]), (k % 7 + 1))
    stats = e.where("event_type <> 'signup'").select(
        F.col("ts").alias("ts_recv"), F.col("ts").alias("ts_ref"), F.col("user_id").alias("instrument_id"), code.alias("stat_type"),
        v.alias("price"), (k * 10).cast("bigint").alias("quantity"),
    )
    return defs, bars, stats


C04_SQL = """
me AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, 'R' || (user_id % 7) AS root FROM events),
mdf AS (SELECT ts, user_id, event_id, root, root || '_' || user_id || '_' || (k % 3) AS contract, value / 100 AS tick, CASE WHEN k % 2 = 0 AND k > 0 THEN CAST(k AS DOUBLE) ELSE 50.0 END AS multiplier,
   CAST(ts AS DATE) + 90 + k % 30 AS expiry_date FROM me WHERE event_type = 'signup'),
mev AS (SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, e.k, e.root, d.contract, row_number() OVER (PARTITION BY e.event_id ORDER BY d.ts DESC NULLS LAST, d.contract DESC) AS rn
   FROM me e JOIN mdf d ON d.user_id = e.user_id AND d.ts <= e.ts WHERE e.event_type <> 'signup'),
mbr AS (SELECT CAST(ts AS DATE) AS date, root, contract, max_by(struct_pack(o := value, v := k + 1), struct_pack(t := ts, u := user_id)) AS b FROM mev
   WHERE rn = 1 AND event_type IN ('view', 'click', 'error') GROUP BY 1, 2, 3),
mst AS (SELECT CAST(ts AS DATE) AS date, root, contract, CASE k % 7 WHEN 0 THEN 'settlement' WHEN 1 THEN 'cleared_volume' WHEN 2 THEN 'open_interest' END AS name,
   max_by(CASE WHEN k % 7 IN (1, 2) THEN CAST(k * 10 AS DOUBLE) ELSE value END, struct_pack(t := ts, u := user_id, a := CASE WHEN k % 7 IN (1, 2) THEN CAST(k * 10 AS DOUBLE) ELSE value END)) AS v
   FROM mev WHERE rn = 1 GROUP BY 1, 2, 3, 4),
msp AS (SELECT date, root, contract, max(v) FILTER (WHERE name = 'settlement') AS settlement, max(v) FILTER (WHERE name = 'cleared_volume') AS cleared, max(v) FILTER (WHERE name = 'open_interest') AS open_interest FROM mst GROUP BY 1, 2, 3)"""


@query(
    "c04_futures_normalize",
    out(C04_SQL, "SELECT b.date, b.root, b.contract, s.settlement, b.b.o AS open, coalesce(s.cleared, CAST(b.b.v AS DOUBLE)) AS volume, s.open_interest FROM mbr b JOIN msp s USING (date, root, contract)",
        "date:d root:s contract:s settlement:f open:f volume:f open_interest:f"),
)
def c04(spark, sf):
    daily, _, _ = fu.normalise_messages(*message_tables(spark, sf), None, ("R0", "R1"))
    return finish(daily.select("date", "root", "contract", "settlement", "open", "volume", "open_interest"))


@query(
    "c04_futures_metadata",
    out(C04_SQL, """SELECT root, contract, ['rates', 'energy', 'metals'][CAST(right(root, 1) AS INTEGER) % 3 + 1] AS sleeve, tick AS tick_size, multiplier, expiry_date, root IN ('R0', 'R1') AS cash_settled FROM
        (SELECT *, row_number() OVER (PARTITION BY root, contract ORDER BY ts DESC, user_id DESC) AS rn FROM mdf) WHERE rn = 1""",
        "root:s contract:s sleeve:s tick_size:f multiplier:f expiry_date:d cash_settled:b"),
)
def c04m(spark, sf):
    _, meta, _ = fu.normalise_messages(*message_tables(spark, sf), None, ("R0", "R1"), {f"R{i}": ("rates", "energy", "metals")[i % 3] for i in range(7)})
    return finish(meta.select("root", "contract", "sleeve", "tick_size", "multiplier", "expiry_date", "cash_settled"))
