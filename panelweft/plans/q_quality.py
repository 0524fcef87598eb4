"""Source, data-quality, universe, sort and set queries."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from panelweft.functions import frames as fr
from panelweft.functions.dates import add_business_days, index_sessions, month_end_schedule
from panelweft.operators import features as ft
from panelweft.operators import gates as gt
from panelweft.operators import quality as qa
from panelweft.operators import reports as rp
from panelweft.operators import temporal as tp
from panelweft.operators import universe as un
from panelweft.plans.q_features import ADV, K, pick
from panelweft.plans.q_ledger import EVERY, START
from panelweft.plans.q_reports import SLEEVE_SQL, sleeve_ledger
from panelweft.plans.q_temporal import FACT_SQL, FIL_SQL, FUT_SQL, SCD_SQL, days, filing_table, members
from panelweft.plans.registry import finish, out, query
from panelweft.plans.sqlbase import BARS, PANEL, RESEARCH, RETURNS, WEEKLY, at, pct_rank, roll, ts, tsp
from panelweft.session import cut
from panelweft.sources import events as ev
from panelweft.sources import readers as rd
from panelweft.sources import tables as tb

# --- sources -------------------------------------------------------------------------------


@query(
    "s01_scan_bars",
    out(
        """sb AS (SELECT 'U' || (user_id % 50) AS symbol, ts, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS session FROM events)""",
        "SELECT symbol, session, count(*) AS rows, sum(round(value, 2)) AS close_sum, sum(k) AS volume FROM sb WHERE symbol <> 'U7' AND isodow(session) <= 5 GROUP BY 1, 2",
        "symbol:s session:d rows:i close_sum:f volume:i", 4,
    ),
)
def s01(spark, sf):
    e = tb.table(spark, sf, "events")
    k = F.from_json("props", "k INT")["k"]
    v = F.round("value", 2)
    line = F.to_csv(F.struct(
        F.concat(F.lit("U"), F.col("user_id") % 50).alias("symbol"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("t"),
        v.alias("o"), (v + 1).alias("h"), (v - 1).alias("l"), v.alias("c"), k.cast("double").alias("v"),
    ))
    bars = rd.parse_bars(e.select(line.alias("value")))
    symbols = bars.select("symbol").distinct().where("symbol <> 'U7'")
    span = e.agg(F.date_sub(F.to_date(F.min("ts")), 1).alias("a"), F.to_date(F.max("ts")).alias("b"))
    cal = span.select(F.explode(F.sequence("a", "b")).alias("session")).where(F.weekday("session") < 5)
    got = rd.restrict(bars, symbols, cal)
    return finish(got.groupBy("symbol", "session").agg(F.count("*").alias("rows"), F.sum("c").alias("close_sum"), F.sum("v").cast("bigint").alias("volume")), 4)


@query(
    "s02_scan_etf_panel",
    out(
        BARS
        + f""",
rc AS (SELECT session, CAST(row_number() OVER (ORDER BY session) - 1 AS INTEGER) AS idx FROM bars WHERE security_id = '7'),
ep0 AS (SELECT b.security_id, b.session, r.idx AS session_idx, b.close, b.volume FROM bars b JOIN rc r USING (session)),
ep1 AS (SELECT *, close / {at('close', -1)} - 1 AS ret, {roll('median({})', 'close * volume', tsp(26), 13)} AS adv FROM ep0)""",
        """SELECT security_id, session, ret, adv, coalesce(ret IS NOT NULL AND volume > 0 AND adv > 0 AND count(ret) OVER (PARTITION BY security_id ORDER BY session_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 52, false) AS eligible FROM ep1""",
        f"{K} ret:f adv:f eligible:b", 4,
    ),
)
def s02(spark, sf):
    """Sessions of one reference symbol form the calendar; ADV is prior-only."""
    from pyspark.sql import Window

    b = tb.bars(spark, sf).drop("session_idx")
    cal = index_sessions(b.where("security_id = '7'").select("session"))
    p = tb.attach(b, cal, "session", tb.shape(spark, sf).sessions, "inner")
    p = p.withColumns({"ret": ft.simple_return("close"), "adv": fr.roll(fr.median, F.col("close") * F.col("volume"), fr.ts_prior(26), 13)})
    past = Window.partitionBy("security_id").orderBy("session_idx").rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col("ret").isNotNull() & (F.col("volume") > 0) & (F.col("adv") > 0) & (F.count("ret").over(past) >= 52)
    return pick(p, "ret", "adv", fr.truth(ok).alias("eligible"), digits=4)


@query(
    "s03_scan_adjusted_ohlcv",
    out(BARS, "SELECT session, security_id, open * f AS adj_open, high * f AS adj_high, low * f AS adj_low FROM (SELECT *, (close * (1 - (session_idx % 7) / 100.0::DOUBLE)) / close AS f FROM bars)",
        f"{K} adj_open:f adj_high:f adj_low:f", 4),
)
def s03(spark, sf):
    b = tb.bars(spark, sf).withColumn("adj_close", F.col("close") * (1 - (F.col("session_idx") % 7) / 100.0))
    return pick(rd.adjusted_ohlcv(b), "adj_open", "adj_high", "adj_low", digits=4)


@query("s04_scan_table", out("", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer", "c_custkey:i c_name:s c_mktsegment:s c_acctbal:f"))
def s04(spark, sf):
    return finish(rd.scan_table(spark, f"{sf}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"))


@query("s05_scan_fact_subset", out("", "SELECT l_orderkey, l_returnflag, l_extendedprice FROM lineitem WHERE l_returnflag IN ('R', 'A')", "l_orderkey:i l_returnflag:s l_extendedprice:f"))
def s05(spark, sf):
    return finish(rd.scan_fact_subset(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_returnflag", "l_extendedprice"], "l_returnflag", ["R", "A"]))


# One facts document per line item: the tag follows the part, the span the supplier.
_TAGS = ["Assets", "Revenues", "SalesRevenueNet", "GrossProfit", "NetIncomeLoss", "ProfitLoss", "NetCashProvidedByUsedInOperatingActivities", "Unknown"]


@query(
    "s06_scan_company_facts",
    out(
        """cf AS (SELECT o_custkey AS cik, CAST(l_orderkey AS VARCHAR) AS accession, CAST(l_shipdate AS DATE) AS period_end, CAST(l_shipdate AS DATE) - CAST(l_suppkey % 200 + 280 AS INTEGER) AS period_start, l_suppkey % 200 + 280 AS span,
          round(l_extendedprice) AS value, CASE l_partkey % 8 WHEN 0 THEN 'assets' WHEN 1 THEN 'revenue' WHEN 2 THEN 'revenue' WHEN 3 THEN 'gross_profit' WHEN 4 THEN 'net_income' WHEN 5 THEN 'net_income' WHEN 6 THEN 'operating_cash_flow' END AS concept,
          CASE WHEN l_partkey % 8 IN (2) THEN 2 WHEN l_partkey % 8 IN (1, 5) THEN 1 ELSE 0 END AS pri, CASE WHEN l_linenumber = 7 THEN '10-Q' ELSE '10-K' END AS form, CASE WHEN l_quantity >= 48 THEN 'Q2' ELSE 'FY' END AS fp
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        cg AS (SELECT * FROM cf WHERE concept IS NOT NULL AND form = '10-K' AND fp = 'FY' AND (concept = 'assets' OR span BETWEEN 300 AND 430)),
        ch AS (SELECT *, max(period_end) OVER (PARTITION BY cik, accession) AS newest, row_number() OVER (PARTITION BY cik, accession, period_end, concept ORDER BY pri, period_start, value) AS rn FROM cg)""",
        "SELECT cik, accession, concept, period_end, value FROM ch WHERE period_end = newest AND rn = 1",
        "cik:i accession:s concept:s period_end:d value:f",
    ),
)
def s06(spark, sf):
    li = tb.table(spark, sf, "lineitem")
    o = tb.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    end = F.to_date("l_shipdate")
    fact = F.struct(
        F.round("l_extendedprice").alias("val"), F.date_format(F.date_add(end, 40), "yyyy-MM-dd").alias("filed"), F.date_format(end, "yyyy-MM-dd").alias("end"),
        F.date_format(F.date_sub(end, (F.col("l_suppkey") % 200 + 280).cast("int")), "yyyy-MM-dd").alias("start"), F.col("l_orderkey").cast("string").alias("accn"),
        F.when(F.col("l_linenumber") == 7, "10-Q").otherwise("10-K").alias("form"), F.when(F.col("l_quantity") >= 48, "Q2").otherwise("FY").alias("fp"), F.year(end).alias("fy"),
    )
    tag = F.element_at(F.array(*[F.lit(t) for t in _TAGS]), (F.col("l_partkey") % 8 + 1).cast("int"))
    units = F.struct(F.create_map(F.lit("USD"), F.array(fact)).alias("units"))
    doc = F.to_json(F.struct(F.col("o_custkey").alias("cik"), F.lit("Entity").alias("entityName"), F.create_map(F.lit("us-gaap"), F.create_map(tag, units)).alias("facts")))
    return finish(rd.parse_company_facts(j.select(doc.alias("value"))).select("cik", "accession", "concept", "period_end", "value"))


def holdings_docs(spark, sf):
    """Part catalogue in snapshots of 500: dates, gaps and a wrong date by block."""
    p = tb.table(spark, sf, "part")
    k = F.col("p_partkey")
    p = p.withColumns({"block": F.floor(k / 500), "isin": F.when(k % 9 == 0, "--").otherwise(F.concat(F.lit("IS"), k % 400)), "cusip": F.when(k % 27 == 0, "").otherwise(F.concat(F.lit("CU"), k))})
    # part keys are unique, so a block holds at most 500 rows
    rows = F.array_sort(F.collect_list(F.struct(k.alias("k"), "p_name", "p_type", "p_brand", "p_size", "p_retailprice", "cusip", "isin")))
    b = p.groupBy("block").agg(rows.alias("r"))
    asof = F.date_add(F.lit("2020-01-01").cast("date"), F.col("block").cast("int"))

    def col(f):
        return F.struct(F.transform("r", f).alias("value"))

    points = F.struct(
        F.struct(F.date_format(F.when(F.col("block") % 4 == 3, F.date_add(asof, 1)).otherwise(asof), "yyyyMMdd").alias("value")).alias("asOfDate"),
        col(lambda r: F.concat(F.lit("T"), r["k"])).alias("ticker"), col(lambda r: r["p_name"]).alias("issueName"),
        col(lambda r: F.when(r["k"] % 50 == 0, "Cash").otherwise("Equity")).alias("assetClass"), col(lambda r: r["p_type"]).alias("sectorName"),
        col(lambda r: r["cusip"]).alias("cusip"), col(lambda r: r["isin"]).alias("isin"),
        col(lambda r: F.when(r["k"] % 10 == 0, "N/A").otherwise(F.concat(F.lit(" SE"), r["k"]))).alias("sedol"), col(lambda r: F.lit("United States")).alias("countryOfRisk"),
        col(lambda r: r["p_brand"]).alias("exchange"), col(lambda r: r["p_size"] / 4).alias("holdingPercent"), col(lambda r: F.floor(r["p_retailprice"])).alias("unitPrice"),
        col(lambda r: r["p_size"]).alias("unitsHeld"), col(lambda r: F.floor(r["p_retailprice"]) * r["p_size"]).alias("marketValue"), col(lambda r: F.lit("USD")).alias("currencyCode"),
    )
    nest = points
    for name in ("dataPointsByNameMap", "all", "containersByNameMap", "holdings", "componentsByNameMap"):
        nest = F.struct(nest.alias(name))
    return b.select(asof.alias("requested_asof"), F.to_json(nest).alias("value"))


_HOLD = """
hd AS (SELECT *, CAST(floor(p_partkey / 500.0) AS INTEGER) AS block, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'IS' || (p_partkey % 400) END AS isin, CASE WHEN p_partkey % 27 = 0 THEN '' ELSE 'CU' || p_partkey END AS cusip, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 'SE' || p_partkey END AS sedol,
  CASE WHEN p_partkey % 50 = 0 THEN 'Cash' ELSE 'Equity' END AS asset_class FROM part),
hb AS (SELECT block, sum(CASE WHEN asset_class = 'Equity' THEN 1 ELSE 0 END) AS eq FROM hd GROUP BY 1),
hg AS (SELECT hd.*, DATE '2020-01-01' + block AS requested_asof, CASE WHEN isin <> '' THEN 'ISIN:' || isin WHEN cusip <> '' THEN 'CUSIP:' || cusip ELSE '' END AS reference_id FROM hd JOIN hb USING (block) WHERE block % 4 <> 3 AND eq BETWEEN 450 AND 550)"""


@query("s07_scan_holdings_json", out(_HOLD, """SELECT requested_asof, 'T' || p_partkey AS ticker, asset_class, p_type AS sector, reference_id, sedol, 'United States' AS country_of_risk, p_brand AS exchange, p_size / 4.0 AS weight_percent,
    floor(p_retailprice) AS issuer_valuation_price, p_size AS shares_held, floor(p_retailprice) * p_size AS market_value, 'USD' AS currency FROM hg""",
    "requested_asof:d ticker:s asset_class:s sector:s reference_id:s sedol:s country_of_risk:s exchange:s weight_percent:f issuer_valuation_price:f shares_held:f market_value:f currency:s"))
def s07(spark, sf):
    good, _ = rd.parse_holdings(holdings_docs(spark, sf))
    numbers = ("weight_percent", "issuer_valuation_price", "shares_held", "market_value")
    good = good.withColumns({c: F.col(c).try_cast("double") for c in numbers})
    return finish(good.select("requested_asof", "ticker", "asset_class", "sector", "reference_id", "sedol", "country_of_risk", "exchange", *numbers, "currency"))


@query("s07_holdings_quarantine", out(_HOLD, "SELECT DATE '2020-01-01' + block AS requested_asof, CASE WHEN block % 4 = 3 THEN 'DATE_MISMATCH' ELSE 'UNEXPECTED_EQUITY_COUNT' END AS reason FROM hb WHERE block % 4 = 3 OR eq NOT BETWEEN 450 AND 550", "requested_asof:d reason:s"))
def s07q(spark, sf):
    _, bad = rd.parse_holdings(holdings_docs(spark, sf))
    return finish(bad.select("requested_asof", "reason"))


@query(
    "s08_scan_ticker_map",
    out(
        "tm AS (SELECT c_custkey AS cik, CASE WHEN c_custkey % 40 = 0 THEN ' aa.b ' ELSE 'k.' || c_custkey END AS ticker, c_mktsegment AS exchange FROM customer), tn AS (SELECT *, replace(replace(upper(trim(ticker)), '.', '-'), '/', '-') AS canonical_symbol FROM tm)",
        "SELECT cik, canonical_symbol, exchange, count(*) OVER (PARTITION BY canonical_symbol) > 1 AS mapping_ambiguous FROM tn",
        "cik:i canonical_symbol:s exchange:s mapping_ambiguous:b",
    ),
)
def s08(spark, sf):
    c = tb.table(spark, sf, "customer")
    k = F.col("c_custkey")
    tick = F.when(k % 40 == 0, " aa.b ").otherwise(F.concat(F.lit("k."), k))
    row = F.array(k.cast("string"), F.col("c_name"), tick, F.col("c_mktsegment"))
    # customer keys are unique: a document holds at most 200 rows
    docs = c.groupBy(F.floor(k / 200).alias("b")).agg(F.collect_list(row).alias("data"))
    fields = F.array(*[F.lit(x) for x in ("cik", "name", "ticker", "exchange")])
    m = rd.parse_ticker_map(docs.select(F.to_json(F.struct(fields.alias("fields"), "data")).alias("value")))
    return finish(m.select("cik", "canonical_symbol", "exchange", "mapping_ambiguous"))


_CSV = """
hc AS (SELECT *, 'F' || CAST(floor(c_custkey / 500.0) AS BIGINT) AS file, c_custkey % 20 <> 0 AS equity, c_custkey % 33 = 0 AS broken FROM customer),
hn AS (SELECT file, sum(CASE WHEN equity AND NOT broken THEN 1 ELSE 0 END) AS n FROM hc GROUP BY 1)"""


def holdings_lines(spark, sf):
    """Customers as issuer files of 500: names with commas and quotes, five columns, rows that are too wide."""
    c = tb.table(spark, sf, "customer")
    k = F.col("c_custkey")
    file = F.concat(F.lit("F"), F.floor(k / 500))
    name = F.concat(F.lit('"'), "c_name", F.lit(', ""Inc"" "'))
    text = F.concat_ws(",", F.concat(F.lit("C"), k), name, F.col("c_mktsegment"), F.when(k % 20 == 0, "Cash").otherwise("Equity"), F.concat(F.lit('"1,'), (k % 900 + 100).cast("string"), F.lit('"')))
    body = c.select(file.alias("file"), (k + 10).alias("line"), F.when(k % 33 == 0, F.concat(text, F.lit(",x"))).otherwise(text).alias("value"))
    pre = c.select(file.alias("file")).distinct().select("file", F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("line"), F.lit('\ufeffFund Holdings as of,"Jan 02, 2020"').alias("value")),
        F.struct(F.lit(1).cast("bigint").alias("line"), F.lit("Ticker,Name,Sector,Asset Class,Market Value").alias("value")),
    )).alias("x")).select("file", "x.*")
    return pre.unionByName(body)


@query(
    "s09_scan_holdings_csv",
    out(_CSV, """SELECT file, 'Jan 02, 2020' AS as_of, 'C' || c_custkey AS ticker, c_name || ', "Inc" ' AS name, c_mktsegment AS sector, '1,' || (c_custkey % 900 + 100) AS market_value
        FROM hc JOIN hn USING (file) WHERE equity AND NOT broken AND n BETWEEN 450 AND 550""", "file:s as_of:s ticker:s name:s sector:s market_value:s"),
)
def s09(spark, sf):
    good, _ = rd.parse_holdings_csv(holdings_lines(spark, sf))
    cells = {"ticker": "Ticker", "name": "Name", "sector": "Sector", "market_value": "Market Value"}
    return finish(good.select("file", F.col("asof").alias("as_of"), *[F.col("cells")[h].alias(c) for c, h in cells.items()]))


@query(
    "s09_csv_rejects",
    out(_CSV, """SELECT file, c_custkey + 10 AS line, 'WIDTH' AS reason FROM hc WHERE broken
        UNION SELECT file, NULL, 'UNEXPECTED_EQUITY_COUNT' FROM hn WHERE n NOT BETWEEN 450 AND 550""", "file:s line:i reason:s"),
)
def s09r(spark, sf):
    _, bad = rd.parse_holdings_csv(holdings_lines(spark, sf))
    return finish(bad.select("file", "line", "reason"))


@query("s10_scan_corporate_actions", out("", "SELECT CAST(floor(event_id / 100.0) AS BIGINT) AS page, event_type AS action_type, count(*) AS actions FROM events GROUP BY 1, 2", "page:i action_type:s actions:i"))
def s10(spark, sf):
    e = tb.table(spark, sf, "events")
    item = F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("user"), F.col("user_id").cast("string"))
    # event ids are unique: a page holds at most 100 actions
    g = e.groupBy(F.floor(F.col("event_id") / 100).alias("page"), "event_type").agg(F.collect_list(item).alias("items"))
    d = g.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "items"))).alias("corporate_actions"))
    return finish(rd.parse_corporate_actions(d.select("page", F.to_json(F.struct("corporate_actions")).alias("value"))))


@query(
    "s11_scan_request_journal",
    out(
        "jr AS (SELECT event_id AS line, CASE WHEN event_type IN ('view', 'purchase') THEN 'accepted_historical_snapshot' ELSE event_type END AS status, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS requested_asof FROM events)",
        "SELECT requested_asof, max_by(status, line) AS status, max(line) AS line, count(*) AS attempts FROM jr WHERE status <> 'accepted_historical_snapshot' GROUP BY 1",
        "requested_asof:s status:s line:i attempts:i",
    ),
)
def s11(spark, sf):
    e = tb.table(spark, sf, "events")
    st = F.when(F.col("event_type").isin("view", "purchase"), "accepted_historical_snapshot").otherwise(F.col("event_type"))
    line = F.to_json(F.struct(st.alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("requested_asof"), F.lit("x").alias("reason")))
    return finish(rd.parse_journal(e.select(F.col("event_id").alias("line"), line.alias("value"))).select("requested_asof", "status", "line", "attempts"))


_SF1 = """
sq AS (SELECT 'c.' || o_custkey AS ticker, CASE WHEN o_orderstatus = 'F' THEN 'ary' ELSE 'MRY' END AS dimension, CAST(o_orderdate AS DATE) AS filed, make_date(year(o_orderdate) - 1, 12, 31) AS period_end,
   max(round(o_totalprice)) AS assets, max(round(o_totalprice) - 1000) AS revenue FROM orders GROUP BY 1, 2, 3, 4),
sr AS (SELECT replace(upper(ticker), '.', '-') AS symbol, c_mktsegment AS sector, filed, period_end, assets, revenue FROM sq JOIN customer ON 'c.' || c_custkey = ticker AND c_custkey % 3 <> 0 WHERE upper(dimension) = 'ARY')"""


def sf1_tables(spark, sf):
    o = tb.table(spark, sf, "orders")
    wide = o.groupBy(
        F.concat(F.lit("c."), "o_custkey").alias("ticker"), F.when(F.col("o_orderstatus") == "F", "ary").otherwise("MRY").alias("dimension"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("datekey"), F.date_format(F.make_date(F.year("o_orderdate") - 1, F.lit(12), F.lit(31)), "yyyy-MM-dd").alias("reportperiod"),
    ).agg(F.max(F.round("o_totalprice")).alias("assets"), F.max(F.round("o_totalprice") - 1000).alias("revenue"))
    none = F.lit(None).cast("double")
    wide = wide.withColumns({"gp": none, "netinc": none, "ncfo": none})
    cand = tb.table(spark, sf, "customer").where(F.col("c_custkey") % 3 != 0).select(F.concat(F.lit("c."), "c_custkey").alias("symbol"), F.col("c_mktsegment").alias("sector"))
    return wide, cand


@query(
    "s12_scan_sf1",
    out(_SF1, """SELECT symbol, sector, 'SF1-ARY-' || symbol || '-' || strftime(period_end, '%Y%m%d') || '-' || strftime(filed, '%Y%m%d') AS accession, 'assets' AS concept, assets AS value FROM sr
        UNION ALL SELECT symbol, sector, 'SF1-ARY-' || symbol || '-' || strftime(period_end, '%Y%m%d') || '-' || strftime(filed, '%Y%m%d'), 'revenue', revenue FROM sr""",
        "symbol:s sector:s accession:s concept:s value:f"),
)
def s12(spark, sf):
    return finish(rd.sf1_facts(rd.sf1_rows(*sf1_tables(spark, sf))).select("symbol", "sector", "accession", "concept", "value"))


@query("s13_scan_sleeve_returns", out(RETURNS, "SELECT session, count(*) AS present, avg(r) AS mean_return, count(*) < 5 AS incomplete FROM (SELECT session, sector, avg(ret) AS r FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2) GROUP BY 1", "session:d present:i mean_return:f incomplete:b"))
def s13(spark, sf):
    """One CSV file per sleeve, written to the shared folder and read back."""
    r = sleeve_ledger(spark, sf).select(F.col("experiment").alias("sleeve"), "session", F.col("gross_return").alias("ret"))
    names = [x[0] for x in tb.table(spark, sf, "region").select("r_name").collect()]  # a sleeve per region
    paths = {n: f"{_shared(spark)}/sleeve-{uuid.uuid4().hex}.csv" for n in names}
    for n, path in paths.items():
        rd.write_table(r.where(F.col("sleeve") == n).select("session", "ret"), path, "csv")
    r = rd.scan_sleeve_returns(spark, paths)
    g = r.groupBy("session").agg(F.count("ret").alias("present"), F.avg("ret").alias("mean_return"))
    bad = rd.incomplete_sessions(r, 5).select("session", F.lit(True).alias("incomplete"))
    return finish(g.join(bad, "session", "left").fillna(False, ["incomplete"]))


def _shared(spark):
    from panelweft.session import _checkpoint_dir

    _checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


@query("s14_file_manifest", out("", "SELECT CAST(page_id AS VARCHAR) AS file, octet_length(encode(html)) AS bytes, sha256(html) AS sha256 FROM pages", "file:s bytes:i sha256:s"))
def s14(spark, sf):
    """Pages as the files of a snapshot."""
    pages = tb.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("file"), "html")
    return finish(rd.content_manifest(pages, "file", "html"))


ALL_TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query(
    "s15_row_count",
    out("", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ALL_TABLES), "name:s rows:i"),
)
def s15(spark, sf):
    got = None
    for t in ALL_TABLES:
        one = tb.table(spark, sf, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows")
        got = one if got is None else got.unionByName(one)
    return finish(got)


@query(
    "s16_month_end_schedule",
    out(
        WEEKLY,
        """SELECT CAST(date_trunc('month', session) AS DATE) AS month, max(session) AS month_end, count(*) AS sessions, (SELECT max(session) FROM cal) > last_day(any_value(session)) AS complete
        FROM cal WHERE session BETWEEN DATE '1996-01-01' AND DATE '2001-12-31' GROUP BY 1""",
        "month:d month_end:d sessions:i complete:b",
    ),
)
def s16(spark, sf):
    return finish(month_end_schedule(tb.calendar(spark, sf), "1996-01-01", "2001-12-31"))


@query("s17_sink_round_trip", out(WEEKLY, "SELECT year(session) AS year, count(*) AS rows, sum(q) AS quantity FROM lw GROUP BY 1", "year:i rows:i quantity:i"))
def s17(spark, sf):
    """Write a year-partitioned table to the shared folder and read it back."""
    path = f"{_shared(spark)}/sink-{uuid.uuid4().hex}"
    rd.write_table(tb.weekly(spark, sf).withColumn("year", F.year("session")), path, "parquet", ["year"])
    return finish(spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("rows"), F.sum("q").alias("quantity")))


# --- rules ------------------------------------------------------------------------------------


@query("p01_require_columns", out("", "SELECT o_orderkey, o_custkey FROM orders", "o_orderkey:i o_custkey:i"))
def p01(spark, sf):
    o = qa.require_columns(tb.table(spark, sf, "orders"), ["o_orderkey", "o_custkey"], "orders")
    return finish(o.select("o_orderkey", "o_custkey"))


@query(
    "p02_typed_checks",
    out("", """SELECT rule, count(*) AS rows FROM (SELECT unnest(list_filter([CASE WHEN event_id % 10 = 0 THEN 'at_instant' END, CASE WHEN event_id % 15 = 0 THEN 'day_date' END, CASE WHEN user_id % 25 = 0 THEN 'name_nonempty' END,
        CASE WHEN event_type = 'error' THEN 'flag_boolean' END], lambda z: z IS NOT NULL)) AS rule FROM events) GROUP BY 1""", "rule:s rows:i"),
)
def p02(spark, sf):
    e = tb.table(spark, sf, "events")
    k = F.col("event_id")
    raw = e.select(
        k, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 10 == 0, "").otherwise("Z")).alias("at"),
        F.when(k % 15 == 0, "2024-02-31").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.when(F.col("user_id") % 25 == 0, "  ").otherwise("x").alias("name"), F.when(F.col("event_type") == "error", "1").otherwise("true").alias("flag"),
    )
    bad = qa.violations(raw, k, qa.typed_rules(["at"], ["day"], ["name"], ["flag"]))
    return finish(bad.groupBy("rule").agg(F.count("*").alias("rows")))


@query(
    "p03_panel_checks",
    out(
        BARS + f""", pk AS (SELECT security_id, session, CASE WHEN session_idx % 50 = 0 THEN -2.0 ELSE close / {at('close', -1)} - 1 END AS ret, CASE WHEN session_idx % 90 = 1 THEN -volume ELSE volume END AS volume, session_idx FROM bars),
        pz AS (SELECT * FROM pk UNION ALL SELECT * FROM pk WHERE session_idx % 120 = 3)""",
        """SELECT security_id || '/' || CAST(session AS VARCHAR) AS key, 'duplicate_key' AS rule FROM pz GROUP BY security_id, session HAVING count(*) > 1
        UNION ALL SELECT security_id || '/' || CAST(session AS VARCHAR), 'return_floor' FROM pz WHERE ret < -1 UNION ALL SELECT security_id || '/' || CAST(session AS VARCHAR), 'volume_sign' FROM pz WHERE volume < 0""",
        "key:s rule:s",
    ),
)
def p03(spark, sf):
    b = tb.bars(spark, sf)
    i = F.col("session_idx")
    b = b.withColumns({"ret": F.when(i % 50 == 0, -2.0).otherwise(ft.simple_return("close")), "volume": F.when(i % 90 == 1, -F.col("volume")).otherwise(F.col("volume"))})
    b = b.unionByName(b.where(i % 120 == 3))
    return finish(qa.panel_violations(b))


MANIFEST_DAY = "1998-01-01"


@query(
    "p04_policy_check",
    out(
        f"""mf AS (SELECT o_orderkey AS k, o_orderkey % 41 <> 0 AS sources, o_orderkey % 43 <> 0 AS permanent, o_orderkey % 47 <> 0 AS evidenced,
          CASE WHEN o_orderstatus = 'F' THEN 'historical_verified' WHEN o_orderstatus = 'O' THEN 'prospective_only' ELSE 'P' END AS scope,
          ['historical_event_history', 'archived_snapshots', 'current_snapshot', 'dated'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS kind, o_orderkey % 5 <> 0 AS terminated, CAST(o_orderdate AS DATE) AS valid_from FROM orders)""",
        f"""SELECT k, unnest(list_filter([CASE WHEN NOT sources THEN 'sources_named' END, CASE WHEN NOT permanent THEN 'identifier_permanent' END, CASE WHEN NOT evidenced THEN 'availability_evidenced' END,
          CASE WHEN scope = 'P' THEN 'scope_known' END, CASE WHEN scope = 'historical_verified' AND kind IN ('current_snapshot', 'dated') THEN 'history_kind' END,
          CASE WHEN scope = 'historical_verified' AND NOT terminated THEN 'terminated_included' END, CASE WHEN scope = 'prospective_only' AND kind = 'dated' THEN 'snapshot_kind' END,
          CASE WHEN scope = 'prospective_only' AND valid_from > DATE '{MANIFEST_DAY}' THEN 'decision_covered' END], lambda z: z IS NOT NULL)) AS rule FROM mf""",
        "k:s rule:s",
    ),
)
def p04(spark, sf):
    """A manifest per order; what each breaks."""
    o, k = tb.table(spark, sf, "orders"), F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ["historical_event_history", "archived_snapshots", "current_snapshot", "dated"]))
    m = o.select(
        k, F.when(k % 41 != 0, "issuer").otherwise(" ").alias("source"), F.lit("exchange").alias("calendar_source"), F.when(k % 43 != 0, "permanent").otherwise("ticker").alias("security_id_kind"),
        F.when(k % 47 != 0, "evidenced_publication_or_capture").otherwise("evidenced").alias("availability_basis"),
        F.when(F.col("o_orderstatus") == "F", "historical_verified").when(F.col("o_orderstatus") == "O", "prospective_only").otherwise("P").alias("scope"),
        F.get(kinds, (k % 4).cast("int")).alias("master_kind"), (k % 5 != 0).alias("includes_terminated"), F.to_date("o_orderdate").alias("valid_from"),
    )
    return finish(qa.violations(m, k, qa.manifest_rules(F.lit(MANIFEST_DAY).cast("date"))).select(F.col("key").alias("k"), "rule"))


@query(
    "c01_publication_evidence",
    out(
        """pu AS (SELECT o_orderkey AS p, CAST(o_orderdate AS DATE) AS published, o_orderstatus <> 'P' AS verified, o_orderkey % 37 <> 0 AS typed, CASE WHEN o_orderkey % 53 = 0 THEN 2 ELSE 1 END AS n FROM orders WHERE o_orderkey % 29 <> 0),
        ln AS (SELECT l_orderkey || '/' || l_linenumber AS key, CAST(l_shipdate AS DATE) - 20 AS available, pu.* FROM lineitem LEFT JOIN pu ON p = l_orderkey)""",
        """SELECT key, 'publication_present' AS rule FROM ln WHERE p IS NULL UNION ALL SELECT key, 'publication_verified' FROM ln WHERE NOT verified
        UNION ALL SELECT key, 'available_after_publication' FROM ln WHERE available < published
        UNION ALL SELECT CAST(p AS VARCHAR), 'publication_unique' FROM pu WHERE n > 1 UNION ALL SELECT CAST(p AS VARCHAR), 'evidence_type' FROM pu WHERE NOT typed""",
        "key:s rule:s",
    ),
)
def c01e(spark, sf):
    """Line items as facts, orders as their publications: some absent, unverified, repeated, late or of an unknown type."""
    o, k = tb.table(spark, sf, "orders"), F.col("o_orderkey")
    p = o.where(k % 29 != 0).select(
        k.alias("publication_id"), F.to_date("o_orderdate").alias("published_at"), (F.col("o_orderstatus") != "P").alias("verified"),
        F.when(k % 37 != 0, "source_publication").otherwise("retrospective").alias("evidence_type"), F.explode(F.sequence(F.lit(1), F.when(k % 53 == 0, 2).otherwise(1))).alias("copy"),
    )
    li = tb.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("publication_id"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("fact"), F.date_sub(F.to_date("l_shipdate"), 20).alias("available_at"))
    return finish(qa.evidence_violations(li, p.drop("copy"), F.col("fact")).select("key", "rule"))


_OH = (
    BARS
    + """, oh0 AS (SELECT security_id, session, session_idx, open, CASE WHEN session_idx % 40 = 5 THEN low * 0.5 ELSE high END AS high, low, close, CASE WHEN session_idx % 60 = 7 THEN 0.0 ELSE volume END AS volume FROM bars),
oh1 AS (SELECT * FROM oh0 UNION ALL SELECT * FROM oh0 WHERE session_idx % 100 = 11),
oh AS (SELECT *, open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND high >= greatest(open, low, close) AND low <= least(open, high, close) AS valid, count(*) OVER (PARTITION BY security_id, session) > 1 AS duplicate, session_idx % 77 = 13 AS off_calendar FROM oh1)"""
)


def dirty_bars(spark, sf):
    i = F.col("session_idx")
    b = tb.bars(spark, sf)
    b = b.withColumns({"high": F.when(i % 40 == 5, F.col("low") * 0.5).otherwise(F.col("high")), "volume": F.when(i % 60 == 7, 0.0).otherwise(F.col("volume"))})
    b = b.unionByName(b.where(i % 100 == 11))
    cal = tb.calendar(spark, sf).where(F.col("session_idx") % 77 != 13)
    return qa.ohlcv_flags(b, cal)


@query("p05_ohlcv_checks", out(_OH, "SELECT session, security_id, valid, duplicate, off_calendar, valid AND NOT duplicate AND NOT off_calendar AND volume > 0 AS usable FROM oh", f"{K} valid:b duplicate:b off_calendar:b usable:b"))
def p05(spark, sf):
    return pick(dirty_bars(spark, sf), "valid", "duplicate", "off_calendar", "usable")


@query("p06_canonical_ticker", out("", "SELECT p_partkey, replace(replace(upper(trim(' ' || replace(p_name, ' ', '.') || '/a ')), '.', '-'), '/', '-') AS symbol FROM part", "p_partkey:i symbol:s"))
def p06(spark, sf):
    p = tb.table(spark, sf, "part")
    raw = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("/a "))
    return finish(p.select("p_partkey", qa.canonical_ticker(raw).alias("symbol")))


@query("p07_clean_identifier", out("", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '' ELSE p_brand END AS identifier FROM part", "p_partkey:i identifier:s"))
def p07(spark, sf):
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, " - ").when(k == 1, "N/A").when(k == 2, "--").when(k == 3, F.lit(None)).otherwise(F.col("p_brand"))
    return finish(tb.table(spark, sf, "part").select("p_partkey", qa.clean_identifier(raw).alias("identifier")))


_PV = """
kn AS (SELECT DISTINCT CASE WHEN length(p_name) % 3 = 0 THEN replace(p_name, ' ', '.') ELSE replace(p_name, ' ', '-') END AS symbol FROM part UNION SELECT replace(p_name, ' ', '.') FROM part WHERE p_partkey % 50 = 1),
vr AS (SELECT p_partkey, p_name, unnest(list_distinct([p_name, replace(p_name, ' ', '.'), replace(p_name, ' ', '-')])) AS symbol FROM part),
vh AS (SELECT p_partkey, count(*) AS n, min(symbol) AS s FROM vr JOIN kn USING (symbol) GROUP BY 1)"""


@query("p08_resolve_symbol_variants", out(_PV, "SELECT p_partkey, CASE WHEN n = 1 THEN s END AS resolved_symbol, CASE WHEN coalesce(n, 0) <> 1 THEN 'unresolved_or_ambiguous' END AS reason FROM part LEFT JOIN vh USING (p_partkey)", "p_partkey:i resolved_symbol:s reason:s"))
def p08(spark, sf):
    p = tb.table(spark, sf, "part")
    dot, dash = F.replace("p_name", F.lit(" "), F.lit(".")), F.replace("p_name", F.lit(" "), F.lit("-"))
    known = p.select(F.when(F.length("p_name") % 3 == 0, dot).otherwise(dash).alias("symbol")).union(p.where("p_partkey % 50 = 1").select(dot.alias("symbol")))
    names = p.select(F.col("p_name").alias("ticker")).distinct()
    got = qa.resolve_variants(names, known, "ticker")
    return finish(p.join(got, p.p_name == got.ticker).select("p_partkey", "resolved_symbol", "reason"))


@query(
    "p10_tail_select",
    out(
        RESEARCH + f", pt AS (SELECT *, CASE WHEN eligible THEN ret END AS v FROM ep), pu AS (SELECT *, {pct_rank('v')} AS p FROM pt)",
        "SELECT session, security_id, CASE WHEN p <= 0.15 OR p > 0.85 THEN v END AS kept FROM pu", f"{K} kept:f",
    ),
)
def p10(spark, sf):
    return pick(ft.kept_tails(tb.research_panel(spark, sf), "ret", "kept", 0.15, tb.shape(spark, sf).wide), "kept")


@query(
    "p11_confidence_filter",
    out(RESEARCH, "SELECT session, security_id, coalesce(abs(ret) >= 1.5 * vol, false) AS passed, CASE WHEN abs(ret) >= 1.5 * vol THEN ret END AS score FROM ep", f"{K} passed:b score:f"),
)
def p11(spark, sf):
    df = tb.research_panel(spark, sf).withColumn("passed", ft.confident(F.col("ret"), F.col("vol"), 1.5))
    return pick(df, "passed", F.when(F.col("passed"), F.col("ret")).alias("score"))


@query(
    "p17_hash_drop",
    out("", """SELECT c_custkey, CAST(concat('0x', substr(sha256(c_name), 1, 8)) AS BIGINT) % 5 = 0 AS dropped,
        list_sum(list_transform(string_split(sha256(c_name), ''), lambda d: CAST(concat('0x', d) AS BIGINT))) % 5 = 0 AS dropped_full FROM customer""", "c_custkey:i dropped:b dropped_full:b"),
)
def p17(spark, sf):
    c = tb.table(spark, sf, "customer")
    return finish(c.select("c_custkey", qa.hash_dropped(F.col("c_name")).alias("dropped"), qa.hash_dropped(F.col("c_name"), True).alias("dropped_full")))


@query(
    "p18_subset_universe",
    out(RETURNS + ", sd AS (SELECT session_idx, stddev_samp(ret) AS dispersion, count(ret) AS names FROM rets WHERE CAST(concat('0x', substr(sha256(security_id), 1, 8)) AS BIGINT) % 5 <> 0 GROUP BY 1)",
        "SELECT session_idx, names, dispersion, first_value(dispersion) OVER (ORDER BY session_idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prior_dispersion FROM sd", "session_idx:i names:i dispersion:f prior_dispersion:f"),
)
def p18(spark, sf):
    keep = tb.assets(spark, sf).where(~qa.hash_dropped(F.col("security_id"))).select("security_id")
    r = tb.returns(spark, sf).join(keep, "security_id", "left_semi")
    n = r.groupBy("session_idx").agg(F.count("ret").alias("names"))
    return finish(ft.prior_dispersion(r, "ret").join(n, "session_idx").select("session_idx", "names", "dispersion", "prior_dispersion"))


@query(
    "p19_quarantine_discontinuity",
    out(RETURNS, "SELECT security_id, count(*) AS rows, max(abs(ret)) AS largest_move, sum(CASE WHEN abs(ret) > 0.12 THEN 1 ELSE 0 END) AS breaks, count(*) >= 280 AND sum(CASE WHEN abs(ret) > 0.12 THEN 1 ELSE 0 END) = 0 AS kept FROM rets GROUP BY 1",
        "security_id:s rows:i largest_move:f breaks:i kept:b"),
)
def p19(spark, sf):
    return finish(qa.continuous_names(tb.returns(spark, sf), 280, 0.12))


@query("p20_large_return_report", out(RETURNS, "SELECT session, security_id, ret FROM rets WHERE abs(ret) > 0.1", f"{K} ret:f"))
def p20(spark, sf):
    return pick(qa.large_returns(tb.returns(spark, sf), 0.1), "ret")


@query(
    "p21_event_yield",
    out(BARS + f", ye AS (SELECT *, (CASE WHEN session_idx % 13 = 0 THEN 0.02 * low * (session_idx % 5 - 1) ELSE 0.0 END) / nullif({at('close', -1)}, 0) AS y FROM bars)",
        "SELECT session, security_id, coalesce(y < 0 OR y > 0.05, false) AS rejected, CASE WHEN NOT coalesce(y < 0 OR y > 0.05, false) THEN greatest(y, 0.0) END AS event_yield FROM ye", f"{K} rejected:b event_yield:f"),
)
def p21(spark, sf):
    b = tb.bars(spark, sf)
    cash = F.when(F.col("session_idx") % 13 == 0, 0.02 * F.col("low") * (F.col("session_idx") % 5 - 1)).otherwise(0.0)
    b = b.withColumn("prior", fr.at("close", -1))
    y, bad = ft.event_yield(cash, F.col("prior"), 0.05)
    return pick(b, bad.alias("rejected"), y.alias("event_yield"))


@query("p22_schema_audit", out("", "SELECT 'orders' AS name, 0 AS missing, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', 2, count(*) FROM lineitem", "name:s missing:i rows:i"))
def p22(spark, sf):
    got = None
    need = {"orders": {"o_orderkey", "o_orderdate"}, "lineitem": {"l_orderkey", "accession", "filed"}}
    for name, cols in need.items():
        df = tb.table(spark, sf, name)
        miss = len(qa.schema_audit(set(df.columns), {name: cols})[name])
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), F.lit(miss).alias("missing"), "rows")
        got = one if got is None else got.unionByName(one)
    return finish(got)


# --- maps, gates, unions ------------------------------------------------------------------


@query(
    "j14_candidate_map",
    out(
        "cc AS (SELECT CASE WHEN c_custkey % 40 = 0 THEN 'AA-B' ELSE 'K-' || c_custkey END AS symbol FROM customer), cn AS (SELECT symbol, count(*) AS n FROM cc GROUP BY 1), cd AS (SELECT 'K-' || s_suppkey * 2 AS symbol FROM supplier UNION ALL SELECT 'AA-B')",
        "SELECT count(DISTINCT d.symbol) AS candidates, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS mapped, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS ambiguous FROM cd d LEFT JOIN cn USING (symbol)",
        "candidates:i mapped:i ambiguous:i",
    ),
)
def j14(spark, sf):
    k = F.col("c_custkey")
    comp = tb.table(spark, sf, "customer").select(F.when(k % 40 == 0, "aa.b").otherwise(F.concat(F.lit("k/"), k)).alias("t"))
    n = comp.groupBy(qa.canonical_ticker(F.col("t")).alias("symbol")).agg(F.count("*").alias("n"))
    cand = tb.table(spark, sf, "supplier").select(F.concat(F.lit("k."), F.col("s_suppkey") * 2).alias("t"))
    extra = tb.table(spark, sf, "region").where("r_regionkey = 0").select(F.lit("AA.B").alias("t"))
    c = cand.union(extra).select(qa.canonical_ticker(F.col("t")).alias("symbol")).join(n, "symbol", "left")
    return finish(c.agg(F.countDistinct("symbol").alias("candidates"), F.sum(fr.truth(F.col("n") == 1).cast("int")).alias("mapped"), F.sum(fr.truth(F.col("n") > 1).cast("int")).alias("ambiguous")))


_TR = "BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"


@query(
    "a40_data_gate",
    out(
        WEEKLY + "," + SCD_SQL + "," + FACT_SQL
        + f""", g1 AS (SELECT entity_id, count(DISTINCT accession_id) AS n FROM fev WHERE availability_date {_TR} GROUP BY 1),
        g2 AS (SELECT session, count(DISTINCT cik) AS n FROM md WHERE session {_TR} GROUP BY 1),
        g3 AS (SELECT sector, count(DISTINCT entity_id) AS n FROM md WHERE session {_TR} AND entity_id IN (SELECT entity_id FROM g1) GROUP BY 1),
        gm AS (SELECT (SELECT count(*) FROM g1) AS one_event, (SELECT count(*) FROM g1 WHERE n >= 3) AS three_events, (SELECT count(*) FROM g2 WHERE n >= 400) AS deep_sessions, (SELECT count(*) FROM g3 WHERE n >= 10) AS deep_sectors)""",
        """SELECT *, list_filter([CASE WHEN NOT one_event >= 250 THEN 'one_train_event' END, CASE WHEN NOT three_events >= 100000 THEN 'three_train_events' END, CASE WHEN NOT deep_sectors >= 5 THEN 'sector_depth' END], lambda z: z IS NOT NULL) AS failed FROM gm""",
        "one_event:i three_events:i deep_sessions:i deep_sectors:i failed:a",
    ),
)
def a40(spark, sf):
    lo, hi = F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date")
    e = filing_table(spark, sf).where(F.col("availability_date").between(lo, hi))
    per = e.select("entity_id", "accession_id").distinct().groupBy("entity_id").agg(F.count("*").alias("n"))
    m = members(spark, sf).where(F.col("session").between(lo, hi))
    deep = m.groupBy("session").agg(F.count("*").alias("n"))
    sec = m.join(per, "entity_id", "left_semi").select("sector", "entity_id").distinct().groupBy("sector").agg(F.count("*").alias("n"))
    a = per.agg(F.count("*").alias("one_event"), F.sum((F.col("n") >= 3).cast("int")).alias("three_events"))
    b = deep.agg(F.sum((F.col("n") >= 400).cast("int")).alias("deep_sessions"))
    c = sec.agg(F.sum((F.col("n") >= 10).cast("int")).alias("deep_sectors"))
    one = a.withColumns({"deep_sessions": b.scalar(), "deep_sectors": c.scalar()})
    rules = [("one_train_event", "one_event", ">=", 250), ("three_train_events", "three_events", ">=", 100000), ("sector_depth", "deep_sectors", ">=", 5)]
    return finish(rp.gate(one, rules).drop("passed"))


@query(
    "a40_futures_gate",
    out(
        FUT_SQL + ", fw AS (SELECT root, date, count(DISTINCT contract) AS n FROM fdl GROUP BY 1, 2)",
        "SELECT root, min(date) AS first_date, max(date) AS last_date, count(*) AS observed, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) AS two_expiry_share, (SELECT count(*) FROM (SELECT date, contract FROM fdl GROUP BY 1, 2 HAVING count(*) > 1)) AS duplicates FROM fw GROUP BY 1",
        "root:s first_date:d last_date:d observed:i two_expiry_share:f duplicates:i",
    ),
)
def a40f(spark, sf):
    d, _ = ev.futures(spark, sf)
    dup = tp.key_violations(d, ["date", "contract"]).agg(F.count("*").alias("duplicates"))
    g = d.groupBy("root", "date").agg(F.count("*").alias("n")).groupBy("root").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("observed"), F.avg((F.col("n") >= 2).cast("double")).alias("two_expiry_share")
    )
    return finish(g.withColumn("duplicates", dup.scalar()))


#: The study of the futures gates: weekly sessions between two Mondays, roots by brand and sleeves by its last digit.
FUTURES_POLICY = gt.FuturesPolicy(date(1995, 1, 9), date(2000, 11, 6), (0,), 0.92, 0.60, 5, 2)


def futures_archives(spark, sf):
    """Daily rows and metadata of two archives: one clean, and one in which every rule is broken somewhere."""
    daily, meta = ev.futures(spark, sf)
    r, week = F.regexp_extract("root", r"(\d+)$", 1).cast("int"), F.floor(F.date_diff("date", F.lit("1995-01-02").cast("date")) / 7)
    d = daily.select("date", "root", "contract", "settlement", (F.col("settlement") * 0.99).alias("open"), (F.col("settlement") * 1.02).alias("high"), (F.col("settlement") * 0.98).alias("low"), F.col("volume").cast("double").alias("volume"), F.col("open_interest").cast("double").alias("open_interest"))
    d = d.withColumns({"__r": r, "__w": week})
    bad = d.where("__w = 20 and __r = 5").unionByName(d).withColumns({
        "settlement": F.when((F.col("__w") % 50 == 7) & (F.col("__r") % 5 == 1), -F.col("settlement")).otherwise(F.col("settlement")), "low": F.when((F.col("__w") % 60 == 9) & (F.col("__r") == 2), F.lit(None)).otherwise(F.col("low")),
        "volume": F.when((F.col("__w") % 70 == 11) & (F.col("__r") % 4 == 0), -1.0).otherwise(F.col("volume")), "open_interest": F.when((F.col("__w") == 100) & (F.col("__r") == 3), F.lit(float("nan"))).otherwise(F.col("open_interest")),
        "root": F.when(F.col("__r") == 25, "Other").otherwise(F.col("root")), "date": F.when((F.col("__w") == 30) & (F.col("__r") == 7), F.lit(None)).otherwise(F.col("date")),
    }).where("__r not between 6 and 20 or __w < 200")
    drop = ["__r", "__w"]
    daily = d.drop(*drop).withColumn("archive", F.lit("clean")).unionByName(bad.drop(*drop).withColumn("archive", F.lit("dirty")))
    m = meta.select(
        "root", "contract", F.concat(F.lit("sleeve"), F.regexp_extract("root", r"(\d)$", 1)).alias("sleeve"), F.lit("X").alias("exchange"), F.lit("USD").alias("currency"), F.lit(1000.0).alias("multiplier"), F.lit(0.01).alias("tick_size"),
        "expiry_date", "first_notice_date", "last_trade_date", "cash_settled",
    ).withColumn("__r", r)
    fine = m.withColumn("first_notice_date", F.coalesce("first_notice_date", F.date_sub("expiry_date", 10)))
    odd = m.where("__r <> 9 or month(expiry_date) <> 10").unionByName(m.where("__r = 10 and month(expiry_date) = 1")).withColumns({
        "multiplier": F.when(F.col("__r") == 11, 0.0).otherwise(F.col("multiplier")), "expiry_date": F.when(F.col("__r") == 13, F.lit(None)).otherwise(F.col("expiry_date")), "root": F.when(F.col("__r") == 24, "Other").otherwise(F.col("root")),
    })
    meta = fine.drop("__r").withColumn("archive", F.lit("clean")).unionByName(odd.drop("__r").withColumn("archive", F.lit("dirty")))
    return daily, meta, m.select("root", "sleeve").distinct()


def futures_gates(spark, sf):
    return gt.futures_gate(*futures_archives(spark, sf), FUTURES_POLICY)


_R = "CAST(regexp_extract(root, '(\\d+)$', 1) AS INTEGER)"
FUTURES_GATE_SQL = (
    FUT_SQL
    + f""",
fg0 AS (SELECT date, root, contract, settlement, settlement * 0.99 AS open, settlement * 1.02 AS high, settlement * 0.98 AS low, CAST(volume AS DOUBLE) AS volume, CAST(open_interest AS DOUBLE) AS open_interest, {_R} AS r, floor(date_diff('day', DATE '1995-01-02', date) / 7.0) AS w FROM fdl),
fg1 AS (SELECT 'clean' AS archive, * FROM fg0 UNION ALL SELECT 'dirty', * FROM (SELECT * FROM fg0 UNION ALL SELECT * FROM fg0 WHERE w = 20 AND r = 5) x WHERE r NOT BETWEEN 6 AND 20 OR w < 200),
fgd AS (SELECT archive, CASE WHEN archive = 'dirty' AND w = 30 AND r = 7 THEN NULL ELSE date END AS date, CASE WHEN archive = 'dirty' AND r = 25 THEN 'Other' ELSE root END AS root, contract,
   CASE WHEN archive = 'dirty' AND w % 50 = 7 AND r % 5 = 1 THEN -settlement ELSE settlement END AS settlement, CASE WHEN archive = 'dirty' AND w % 60 = 9 AND r = 2 THEN NULL ELSE low END AS low,
   CASE WHEN archive = 'dirty' AND w % 70 = 11 AND r % 4 = 0 THEN -1 ELSE volume END AS volume, CASE WHEN archive = 'dirty' AND w = 100 AND r = 3 THEN NULL ELSE open_interest END AS open_interest FROM fg1),
fm2 AS (SELECT *, {_R} AS r, 'sleeve' || right(root, 1) AS sleeve FROM fm0),
fgm AS (SELECT 'clean' AS archive, root, contract, 1000.0 AS multiplier, expiry_date, coalesce(fnd, expiry_date - 10) AS fnd, cash FROM fm2
   UNION ALL SELECT 'dirty', CASE WHEN r = 24 THEN 'Other' ELSE root END, contract, CASE WHEN r = 11 THEN 0.0 ELSE 1000.0 END, CASE WHEN r = 13 THEN NULL ELSE expiry_date END, fnd, cash
     FROM (SELECT * FROM fm2 WHERE r <> 9 OR month(expiry_date) <> 10 UNION ALL SELECT * FROM fm2 WHERE r = 10 AND month(expiry_date) = 1) y),
fgu AS (SELECT DISTINCT root, sleeve FROM fm2),
fgw AS (SELECT archive, root, date, count(DISTINCT contract) AS n FROM fgd WHERE date BETWEEN DATE '1995-01-09' AND DATE '2000-11-06' GROUP BY 1, 2, 3),
fgp AS (SELECT a.archive, u.root, u.sleeve, min(date) AS first_date, max(date) AS last_date, count(date) AS observed_sessions, count(date) / 305.0::DOUBLE AS session_coverage, coalesce(avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE date IS NOT NULL), 0) AS two_expiry_session_share,
   (SELECT count(DISTINCT contract) FROM fgd d WHERE d.archive = a.archive AND d.root = u.root AND d.date BETWEEN DATE '1995-01-09' AND DATE '2000-11-06') AS contracts
   FROM (SELECT DISTINCT archive FROM fgd) a CROSS JOIN fgu u LEFT JOIN fgw w ON w.archive = a.archive AND w.root = u.root GROUP BY 1, 2, 3),
fga AS (SELECT *, coalesce(session_coverage >= 0.92 AND two_expiry_session_share >= 0.6 AND first_date <= DATE '1995-01-09' AND last_date >= DATE '2000-11-06', false) AS admitted FROM fgp),
fgr AS (
  SELECT archive, 'date_invalid' AS rule, count(*) FILTER (date IS NULL) AS rows FROM fgd GROUP BY 1 UNION ALL SELECT archive, 'daily_root_unknown', count(*) FILTER (root NOT IN (SELECT root FROM fgu)) FROM fgd GROUP BY 1
  UNION ALL SELECT archive, 'price_invalid', count(*) FILTER (NOT coalesce(settlement > 0 AND low > 0, false)) FROM fgd GROUP BY 1 UNION ALL SELECT archive, 'activity_invalid', count(*) FILTER (NOT coalesce(volume >= 0 AND open_interest >= 0, false)) FROM fgd GROUP BY 1
  UNION ALL SELECT archive, 'metadata_root_unknown', count(*) FILTER (root NOT IN (SELECT root FROM fgu)) FROM fgm GROUP BY 1 UNION ALL SELECT archive, 'scale_invalid', count(*) FILTER (multiplier <= 0) FROM fgm GROUP BY 1
  UNION ALL SELECT archive, 'notice_missing', count(*) FILTER (fnd IS NULL AND NOT cash) FROM fgm GROUP BY 1 UNION ALL SELECT archive, 'expiry_missing', count(*) FILTER (expiry_date IS NULL) FROM fgm GROUP BY 1
  UNION ALL SELECT archive, 'contract_date_repeated', sum(n - 1) FROM (SELECT archive, date, contract, count(*) AS n FROM fgd GROUP BY 1, 2, 3) z GROUP BY 1 UNION ALL SELECT archive, 'metadata_repeated', sum(n - 1) FROM (SELECT archive, contract, count(*) AS n FROM fgm GROUP BY 1, 2) z GROUP BY 1
  UNION ALL SELECT d.archive, 'contract_without_metadata', count(*) FILTER (NOT EXISTS (SELECT 1 FROM fgm m WHERE m.archive = d.archive AND m.contract = d.contract)) FROM fgd d GROUP BY 1
  UNION ALL SELECT archive, 'too_few_roots', greatest(5 - count(*) FILTER (admitted), 0) FROM fga GROUP BY 1 UNION ALL SELECT archive, 'too_few_sleeves', greatest(2 - count(DISTINCT sleeve) FILTER (admitted), 0) FROM fga GROUP BY 1)"""
)


@query("a40_futures_rules", out(FUTURES_GATE_SQL, "SELECT archive, rule, rows, rows > 0 AS broken FROM fgr", "archive:s rule:s rows:i broken:b"))
def a40_rules(spark, sf):
    return finish(futures_gates(spark, sf).rules)


@query(
    "a40_futures_roots",
    out(FUTURES_GATE_SQL, "SELECT archive, root, sleeve, first_date, last_date, contracts, observed_sessions, session_coverage, two_expiry_session_share, admitted FROM fga",
        "archive:s root:s sleeve:s first_date:d last_date:d contracts:i observed_sessions:i session_coverage:f two_expiry_session_share:f admitted:b"),
)
def a40_roots(spark, sf):
    g = futures_gates(spark, sf).parts
    return finish(g.select("archive", "root", "sleeve", "first_date", "last_date", "contracts", "observed_sessions", "session_coverage", "two_expiry_session_share", "admitted"))


@query(
    "a40_futures_status",
    out(
        FUTURES_GATE_SQL,
        """SELECT r.archive, CASE WHEN count(*) FILTER (rows > 0) = 0 THEN 'ADMITTED' ELSE 'BLOCKED' END AS status, coalesce(list_sort(list(rule) FILTER (rows > 0)), []) AS problems,
        (SELECT coalesce(list_sort(list(root)), []) FROM fga a WHERE a.archive = r.archive AND admitted) AS admitted_roots, (SELECT coalesce(list_sort(list(DISTINCT sleeve)), []) FROM fga a WHERE a.archive = r.archive AND admitted) AS admitted_sleeves FROM fgr r GROUP BY 1""",
        "archive:s status:s problems:a admitted_roots:a admitted_sleeves:a",
    ),
)
def a40_status(spark, sf):
    return finish(futures_gates(spark, sf).status.select("archive", "status", "problems", "admitted_roots", "admitted_sleeves"))


#: Two readings of the filing archive: thresholds that it meets, and those of a large archive.
FILING_POLICIES = {
    "small": gt.FilingPolicy(date(1996, 1, 1), date(1999, 12, 31), (0,), 20, 0.50, 10, 5, 2, 3), "large": gt.FilingPolicy(date(1996, 1, 1), date(1999, 12, 31), (0,), 100_000, 0.95, 100_000, 100_000, 100_000, 8),
}


def _filing_sql(name, p):
    n = gt.expected_sessions(p.start, p.end, p.days)
    return f"""SELECT '{name}' AS policy, (SELECT count(*) FROM g1) AS entities_with_one_event, (SELECT count(*) FROM g1 WHERE n >= 3) AS entities_with_three_events, (SELECT sum(rows) FROM g1) AS train_events, (SELECT count(*) FROM g2) AS train_sessions,
      (SELECT count(*) FROM g2 WHERE n >= {p.members}) AS deep_sessions, (SELECT count(*) FROM g3 WHERE n >= {p.names_per_sector}) AS deep_sectors, (SELECT sum(n - 1) FROM g4) AS repeated_availability, (SELECT min(availability_date) FROM fev) AS first_event, (SELECT max(availability_date) FROM fev) AS last_event,
      {int(p.min_session_share * n)} AS need_sessions, {p.one_event} AS need_one, {p.three_events} AS need_three, {p.sectors} AS need_sectors"""


@query(
    "a40_filing_gate",
    out(
        WEEKLY + "," + SCD_SQL + "," + FACT_SQL
        + f""", g1 AS (SELECT entity_id, count(DISTINCT accession_id) AS n, count(*) AS rows FROM fev WHERE availability_date {_TR} GROUP BY 1), g2 AS (SELECT session, count(DISTINCT cik) AS n FROM md WHERE session {_TR} GROUP BY 1),
        g3 AS (SELECT sector, count(DISTINCT entity_id) AS n FROM md WHERE session {_TR} AND entity_id IN (SELECT entity_id FROM g1) GROUP BY 1), g4 AS (SELECT count(*) AS n FROM fev GROUP BY entity_id, availability_date),
        gm AS ({" UNION ALL ".join(_filing_sql(n, p) for n, p in FILING_POLICIES.items())}),
        gp AS (SELECT *, list_sort(list_filter([CASE WHEN deep_sessions < need_sessions THEN 'membership_session_coverage' END, CASE WHEN entities_with_one_event < need_one THEN 'one_train_event' END, CASE WHEN entities_with_three_events < need_three THEN 'three_train_events' END,
          CASE WHEN deep_sectors < need_sectors THEN 'sector_depth' END, CASE WHEN repeated_availability > 0 THEN 'unique_entity_availability' END], lambda z: z IS NOT NULL)) AS problems FROM gm)""",
        "SELECT policy, CASE WHEN len(problems) = 0 THEN 'ADMITTED' ELSE 'BLOCKED' END AS status, problems, train_events, entities_with_one_event, entities_with_three_events, train_sessions, deep_sessions, deep_sectors, repeated_availability, first_event, last_event FROM gp",
        "policy:s status:s problems:a train_events:i entities_with_one_event:i entities_with_three_events:i train_sessions:i deep_sessions:i deep_sectors:i repeated_availability:i first_event:d last_event:d",
    ),
)
def a40_filings(spark, sf):
    e = filing_table(spark, sf)
    m = members(spark, sf).withColumnRenamed("session", "date")
    got = None
    for name, policy in FILING_POLICIES.items():
        one = gt.filing_gate(e, m, policy).status.withColumn("policy", F.lit(name))
        got = one if got is None else got.unionByName(one)
    return finish(got.select("policy", "status", "problems", "train_events", "entities_with_one_event", "entities_with_three_events", "train_sessions", "deep_sessions", "deep_sectors", "repeated_availability", "first_event", "last_event"))


@query(
    "a42_yearly_events",
    out(
        WEEKLY + "," + FIL_SQL + "," + SCD_SQL
        + """, ye AS (SELECT year(available_at) AS year, count(*) AS events, count(DISTINCT symbol) AS entities FROM fil GROUP BY 1),
        ym AS (SELECT year(session) AS year, min(n) AS low, median(n) AS mid, max(n) AS high FROM (SELECT session, count(*) AS n FROM md GROUP BY 1) GROUP BY 1)""",
        "SELECT coalesce(ye.year, ym.year) AS year, events, entities, low, mid, high FROM ye FULL JOIN ym ON ye.year = ym.year",
        "year:i events:i entities:i low:i mid:f high:i",
    ),
)
def a42y(spark, sf):
    f = ev.filing_events(spark, sf)
    e = f.groupBy(F.year("available_at").alias("year"), "symbol").agg(F.count("*").alias("n")).groupBy("year").agg(F.sum("n").alias("events"), F.count("*").alias("entities"))
    m = members(spark, sf).groupBy("session").agg(F.count("*").alias("n")).groupBy(F.year("session").alias("year")).agg(
        F.min("n").alias("low"), F.percentile("n", F.lit(0.5)).alias("mid"), F.max("n").alias("high")
    )
    return finish(e.join(m, "year", "full"))


@query(
    "a43_equity_union",
    out(
        _HOLD + ", hl AS (SELECT max(requested_asof) AS last FROM hg)",
        """SELECT reference_id, string_agg(DISTINCT isin, '|' ORDER BY isin) AS isin, string_agg(DISTINCT cusip, '|' ORDER BY cusip) AS cusips_observed, string_agg(DISTINCT 'T' || p_partkey, '|' ORDER BY 'T' || p_partkey) AS tickers_observed,
        string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS names_observed, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS sectors_observed, min(requested_asof) AS first_snapshot, max(requested_asof) AS last_snapshot,
        count(DISTINCT requested_asof) AS snapshot_count, bool_or(requested_asof = last) AS present_in_latest_snapshot, 'not_inferred_from_holdings_absence' AS delisting_status, false AS permanent_lineage_verified
        FROM hg, hl WHERE asset_class = 'Equity' AND reference_id <> '' GROUP BY 1""",
        "reference_id:s isin:s cusips_observed:s tickers_observed:s names_observed:s sectors_observed:s first_snapshot:d last_snapshot:d snapshot_count:i present_in_latest_snapshot:b delisting_status:s permanent_lineage_verified:b",
    ),
)
def a43(spark, sf):
    good, _ = rd.parse_holdings(holdings_docs(spark, sf))
    # the latest snapshot of all, not only of those with equities
    e = good.withColumn("last", good.agg(F.max("returned_asof")).scalar()).where("asset_class = 'Equity' AND reference_id <> ''")
    # a reference has a few labels per snapshot
    seen = {"isin": "isin", "cusips_observed": "cusip", "tickers_observed": "ticker", "names_observed": "name", "sectors_observed": "sector"}
    g = e.groupBy("reference_id").agg(
        *(rp.distinct_text(c).alias(n) for n, c in seen.items()), F.min("returned_asof").alias("first_snapshot"), F.max("returned_asof").alias("last_snapshot"),
        F.countDistinct("returned_asof").alias("snapshot_count"), F.max(F.col("returned_asof") == F.col("last")).alias("present_in_latest_snapshot"),
    )
    return finish(g.withColumns({"delisting_status": F.lit("not_inferred_from_holdings_absence"), "permanent_lineage_verified": F.lit(False)}))


@query(
    "a44_snapshot_audit",
    out(
        _HOLD + ", dz AS (SELECT requested_asof, reference_id, count(*) AS n FROM hg WHERE asset_class = 'Equity' AND reference_id <> '' GROUP BY 1, 2)",
        """SELECT g.requested_asof, count(*) AS rows, sum(CASE WHEN asset_class = 'Equity' THEN 1 ELSE 0 END) AS equity_rows, sum(CASE WHEN asset_class = 'Equity' AND isin = '' THEN 1 ELSE 0 END) AS missing_isin,
        sum(CASE WHEN asset_class = 'Equity' AND cusip = '' THEN 1 ELSE 0 END) AS missing_cusip, (SELECT sum(n - 1) FROM dz WHERE dz.requested_asof = g.requested_asof) AS duplicate_ids FROM hg g GROUP BY g.requested_asof""",
        "requested_asof:d rows:i equity_rows:i missing_isin:i missing_cusip:i duplicate_ids:i",
    ),
)
def a44(spark, sf):
    good, _ = rd.parse_holdings(holdings_docs(spark, sf))
    eq = F.col("asset_class") == "Equity"
    per = good.groupBy("requested_asof", "reference_id").agg(
        F.count("*").alias("n"), F.sum(eq.cast("int")).alias("e"), F.sum((eq & (F.col("isin") == "")).cast("int")).alias("mi"), F.sum((eq & (F.col("cusip") == "")).cast("int")).alias("mc")
    )
    extra = F.when((F.col("reference_id") != "") & (F.col("e") > 0), F.col("e") - 1).otherwise(0)
    return finish(per.groupBy("requested_asof").agg(F.sum("n").alias("rows"), F.sum("e").alias("equity_rows"), F.sum("mi").alias("missing_isin"), F.sum("mc").alias("missing_cusip"), F.sum(extra).alias("duplicate_ids")))


# --- universes ------------------------------------------------------------------------------------

POLICY = un.UniversePolicy(target_size=30, min_members=10, liquidity_sessions=26, min_observations=100, min_coverage=0.75, min_close=5.0, min_dollar_volume=50_000.0, stale_sessions=2)
DEC_IDX = 240


def universe_inputs(spark, sf):
    """Master and bars. Suppliers as securities: a listing event each, some suspended or delisted;
    every bar has a first version and some a later revision."""
    s = tb.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    listed = F.struct(F.lit(0).alias("n"), F.lit("1994-12-01").cast("timestamp").alias("effective_at"), F.lit("ACTIVE").alias("status"))
    later = F.struct(
        F.lit(1).alias("n"), F.lit("1999-02-01").cast("timestamp").alias("effective_at"), F.when(k % 19 == 0, "DELISTED").when(k % 23 == 0, "SUSPENDED").alias("status")
    )
    m = s.select(k, "s_name", F.explode(F.array(listed, later)).alias("e")).select("s_suppkey", "s_name", "e.*").where("status is not null")
    master = m.select(
        k.cast("string").alias("security_id"), (k * 2 + F.col("n")).alias("event_id"), "effective_at", "effective_at", F.col("s_name").alias("ticker"),
        F.when(k % 29 == 0, "ETF").otherwise("COMMON_STOCK").alias("security_type"), F.lit("US").alias("listing_country"), F.when(k % 31 == 0, "XTSE").otherwise("XNAS").alias("exchange"), "status",
    ).toDF("security_id", "event_id", "effective_at", "available_at", "ticker", "security_type", "listing_country", "exchange", "status")
    b = tb.bars(spark, sf)
    i = F.col("session_idx")
    close_at = F.date_add("session", 4).cast("timestamp")
    first = F.struct(close_at.alias("available_at"), F.col("close").alias("c"))
    revised = F.struct(F.date_add("session", 60).cast("timestamp").alias("available_at"), (F.col("close") * 1.01).alias("c"))
    b = b.select("security_id", "session", "session_idx", "volume", close_at.alias("effective_at"), F.explode(F.when(i % 3 == 0, F.array(first, revised)).otherwise(F.array(first))).alias("v"))
    b = b.select("security_id", "session", "session_idx", "volume", "effective_at", "v.available_at", F.col("v.c").alias("close"), F.lit(False).alias("is_stale"), (i % 50 == 49).alias("is_suspended"))
    return master, b


def closes(spark, sf):
    return tb.calendar(spark, sf).withColumn("close_at", F.date_add("session", 4).cast("timestamp"))


def universe_audit(spark, sf):
    master, b = universe_inputs(spark, sf)
    dec = F.date_add(F.lit(tb.shape(spark, sf).first), DEC_IDX * 7 + 5).cast("timestamp")
    # read several times by the choice of members: a row a security
    return cut(un.build_universe(master, b, closes(spark, sf), dec, POLICY))


C01_SQL = (
    BARS
    + f""",
dcs AS (SELECT CAST((SELECT min(session) FROM lw) + {DEC_IDX * 7 + 5} AS TIMESTAMP) AS dec),
ub0 AS (SELECT security_id, session, session_idx, volume, CASE WHEN session_idx % 3 = 0 AND CAST(session + 60 AS TIMESTAMP) <= (SELECT dec FROM dcs) THEN close * 1.01 ELSE close END AS close, session_idx % 50 = 49 AS susp FROM bars WHERE session_idx <= {DEC_IDX}),
ub1 AS (SELECT *, CASE WHEN close - {at('close', -1)} = 0 THEN 1 ELSE 0 END AS same FROM ub0),
ub2 AS (SELECT *, coalesce(sum(same) OVER {ts(2)}, 0) = 2 AS stale, CAST(security_id AS BIGINT) AS k FROM ub1),
ub3 AS (SELECT *, close > 0 AND volume > 0 AND NOT susp AND NOT stale AND NOT (session >= DATE '1999-02-01' AND (k % 19 = 0 OR k % 23 = 0)) AS valid FROM ub2),
ub4 AS (SELECT security_id, max(close) FILTER (WHERE session_idx = {DEC_IDX}) AS latest_close, median(close * volume) FILTER (WHERE valid AND session_idx > {DEC_IDX} - 26) AS mdv,
   sum(CASE WHEN valid AND session_idx > {DEC_IDX} - 26 THEN 1 ELSE 0 END) / 26.0::DOUBLE AS coverage, sum(CASE WHEN valid THEN 1 ELSE 0 END) AS obs,
   coalesce(bool_or(stale) FILTER (WHERE session_idx = {DEC_IDX}), false) AS is_stale, coalesce(bool_or(valid) FILTER (WHERE session_idx = {DEC_IDX}), false) AS lok FROM ub3 GROUP BY 1),
ub5 AS (SELECT CAST(s_suppkey AS VARCHAR) AS security_id, CASE WHEN (SELECT dec FROM dcs) >= TIMESTAMP '1999-02-01' AND s_suppkey % 19 = 0 THEN 'DELISTED' WHEN (SELECT dec FROM dcs) >= TIMESTAMP '1999-02-01' AND s_suppkey % 23 = 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status,
   s_suppkey % 29 = 0 AS etf, s_suppkey % 31 = 0 AS foreign_ FROM supplier),
uba AS (SELECT u.security_id, status, latest_close, mdv, coalesce(coverage, 0) AS coverage, coalesce(obs, 0) AS obs, list_filter([CASE WHEN status <> 'ACTIVE' THEN 'inactive_or_suspended' END, CASE WHEN etf THEN 'not_common_stock' END, CASE WHEN foreign_ THEN 'not_us_listed_stock' END,
   CASE WHEN NOT coalesce(lok, false) THEN 'missing_stale_or_invalid_latest_bar' END, CASE WHEN is_stale THEN 'stale' END, CASE WHEN NOT coalesce(latest_close >= 5, false) THEN 'raw_close_below_floor' END,
   CASE WHEN NOT coalesce(mdv >= 50000, false) THEN 'sip_liquidity_below_floor' END, CASE WHEN coalesce(obs, 0) < 100 THEN 'insufficient_valid_observations' END, CASE WHEN coalesce(coverage, 0) < 0.75 THEN 'session_coverage_below_floor' END], lambda z: z IS NOT NULL) AS reasons
   FROM ub5 u LEFT JOIN ub4 USING (security_id)),
ubs AS (SELECT *, len(reasons) = 0 AS eligible, row_number() OVER (ORDER BY len(reasons) > 0, round(mdv, 6) DESC NULLS LAST, security_id) AS rk, sum(CASE WHEN len(reasons) = 0 THEN 1 ELSE 0 END) OVER () AS n FROM uba)"""
)


@query(
    "c01_build_universe",
    out(C01_SQL, "SELECT security_id, status, latest_close, mdv AS median_dollar_volume, coverage, obs AS valid_observations, eligible, reasons AS exclusion_reasons, eligible AND rk <= 30 AND n >= 10 AS selected FROM ubs",
        "security_id:s status:s latest_close:f median_dollar_volume:f coverage:f valid_observations:i eligible:b exclusion_reasons:a selected:b", 4),
)
def c01(spark, sf):
    a = un.select_top(universe_audit(spark, sf), POLICY.target_size, POLICY.min_members)
    return finish(a.select("security_id", "status", "latest_close", "median_dollar_volume", "coverage", "valid_observations", "eligible", "exclusion_reasons", "selected"), 4)


# --- the universe of every rebalance decision, its gate and its evidence --------------------------------

#: Sessions whose bars lack a publication, have an unverified one, are available before it, or come from another feed.
MISSING_AT, UNVERIFIED_AT, LATE_AT, FEED_AT = 340, 345, 350, 352


def rebalance_decisions(spark, sf):
    d = tb.calendar(spark, sf).where((F.col("session_idx") % EVERY == 0) & (F.col("session_idx") >= START))
    return d.select(F.col("session_idx").alias("decision"), F.date_add("session", 5).cast("timestamp").alias("decision_at"))


def universe_history(spark, sf):
    """Master with suspensions known late or corrected later, delistings, and a few securities that come back; bars of which
    some are revised, with the publication and the feed of each version."""
    t = lambda day: F.lit(day).cast("timestamp")
    k = F.col("s_suppkey")

    def event(n, effective, available, status, when):
        return F.when(when, F.struct(F.lit(n).alias("n"), t(effective).alias("effective_at"), t(available).alias("available_at"), F.lit(status).alias("status")))

    all_ = [
        event(0, "1994-12-01", "1994-12-01", "ACTIVE", F.lit(True)), event(1, "1997-03-03", "1997-03-13", "SUSPENDED", k % 7 == 0), event(1, "1997-03-03", "1997-06-02", "ACTIVE", k % 14 == 0),
        event(2, "1997-09-01", "1997-08-25", "ACTIVE", k % 7 == 0), event(3, "1999-02-01", "1999-02-01", "DELISTED", k % 19 == 0), event(3, "1999-02-01", "1999-02-01", "SUSPENDED", (k % 23 == 0) & (k % 19 != 0)),
        event(4, "2001-06-04", "2001-06-04", "ACTIVE", k % 95 == 0),
    ]
    m = tb.table(spark, sf, "supplier").select(k, "s_name", F.explode(F.array_compact(F.array(*all_))).alias("e")).select("s_suppkey", "s_name", "e.*")
    event_id = k * 8 + F.col("n")
    master = m.select(
        k.cast("string").alias("security_id"), event_id.alias("event_id"), "effective_at", "available_at", F.col("s_name").alias("ticker"), F.when(k % 29 == 0, "ETF").otherwise("COMMON_STOCK").alias("security_type"),
        F.lit("US").alias("listing_country"), F.when(k % 31 == 0, "XTSE").otherwise("XNAS").alias("exchange"), "status", F.concat_ws("/", F.lit("m"), event_id, F.date_format("available_at", "yyyyMMdd")).alias("publication_id"),
    )
    i = F.col("session_idx")
    _, b = universe_inputs(spark, sf)
    revised = F.col("available_at") > F.col("effective_at")
    b = b.withColumn("publication_id", F.concat_ws("/", F.lit("b"), i, revised.cast("int")))
    b = b.withColumn("feed", F.when((i == FEED_AT) & (F.col("security_id").cast("long") % 10 == 3), "IEX").otherwise("SIP"))
    say = lambda df: df.select("publication_id", "available_at").distinct()
    # a publication a session and version, and one an event and version
    p = say(b.where((i != MISSING_AT) | revised)).withColumn("__i", F.split("publication_id", "/")[1].cast("int"))
    p = p.select("publication_id", F.when(F.col("__i") == LATE_AT, F.col("available_at") + F.expr("interval 3 days")).otherwise(F.col("available_at")).alias("published_at"), (F.col("__i") != UNVERIFIED_AT).alias("verified"))
    p = p.unionByName(say(master).select("publication_id", F.col("available_at").alias("published_at"), F.lit(True).alias("verified")))
    return master, b, p.withColumn("evidence_type", F.lit("source_publication"))


def universe_manifest(spark):
    return spark.range(1).select(
        F.lit("issuer").alias("source"), F.lit("exchange").alias("calendar_source"), F.lit("permanent").alias("security_id_kind"), F.lit(qa.AVAILABILITY).alias("availability_basis"), F.lit("historical_verified").alias("scope"),
        F.lit("historical_event_history").alias("master_kind"), F.lit(True).alias("includes_terminated"), F.lit(None).cast("date").alias("valid_from"),
    )


def universe_of_decisions(spark, sf):
    """(audit, status of each decision, members) of all rebalance decisions; frozen once a session for the queries that rest on them."""

    def measure():
        master, b, pub = universe_history(spark, sf)
        dec, cal = rebalance_decisions(spark, sf), closes(spark, sf)
        audit = cut(un.universes(master, b, cal, dec, POLICY))
        gates = un.gate_rules(master, b, pub, cal, dec, universe_manifest(spark), POLICY)
        status = cut(un.universe_status(audit, gates, dec, POLICY))
        return audit, status, cut(un.members(audit, status, POLICY))

    return tb._once(spark, sf, "universe of decisions", measure)


#: Most names of a portfolio's inputs, and fewest: they need no gate on the number of names to trade.
UNIVERSE_SIZE, UNIVERSE_LEAST = 400, 2


def eligible_members(spark, sf):
    """(decision, security_id, position, size) of all eligible names, at decisions that no rule on data forbids."""
    audit, status, _ = universe_of_decisions(spark, sf)
    open_ = status.where("size(array_except(gates, array('too_few_members'))) = 0").select("decision")
    return un.top_of_each(audit, UNIVERSE_SIZE, UNIVERSE_LEAST).join(open_, "decision", "left_semi")


_DK = "decision, security_id"
UNIVERSE_TAIL = (
    f"""
dc AS (SELECT session_idx AS decision, CAST(session + 5 AS TIMESTAMP) AS at_ FROM cal WHERE session_idx % {EVERY} = 0 AND session_idx >= {START}),
mv AS (
  SELECT s_suppkey AS k, ev, CAST(eff AS DATE) AS eff, CAST(av AS DATE) AS av, status FROM supplier, (VALUES
    (0, '1994-12-01', '1994-12-01', 'ACTIVE', 1), (1, '1997-03-03', '1997-03-13', 'SUSPENDED', 7), (1, '1997-03-03', '1997-06-02', 'ACTIVE', 14), (2, '1997-09-01', '1997-08-25', 'ACTIVE', 7),
    (3, '1999-02-01', '1999-02-01', 'DELISTED', 19), (3, '1999-02-01', '1999-02-01', 'SUSPENDED', 23), (4, '2001-06-04', '2001-06-04', 'ACTIVE', 95)) AS v(ev, eff, av, status, of_) WHERE s_suppkey % of_ = 0 AND (of_ <> 23 OR s_suppkey % 19 <> 0)),
ms AS (SELECT decision, k, ev, eff, arg_max(status, (av, status)) AS status FROM mv JOIN dc ON av <= at_ AND eff <= at_ GROUP BY 1, 2, 3, 4),
now_ AS (SELECT decision, k, arg_max(status, (eff, ev)) AS status FROM ms GROUP BY 1, 2),
ud0 AS (SELECT decision, security_id, CAST(security_id AS BIGINT) AS k, session, session_idx, volume, CASE WHEN session_idx % 3 = 0 AND CAST(session + 60 AS TIMESTAMP) <= at_ THEN close * 1.01 ELSE close END AS close, session_idx % 50 = 49 AS susp
  FROM bars JOIN dc ON session_idx <= decision),
ud1 AS (SELECT *, CASE WHEN close - {at('close', -1, _DK)} = 0 THEN 1 ELSE 0 END AS same FROM ud0),
ud2 AS (SELECT *, coalesce(sum(same) OVER {ts(2, _DK)}, 0) = 2 AS stale FROM ud1),
ud2s AS (SELECT u.*, m.status AS then_ FROM ud2 u ASOF LEFT JOIN ms m ON u.decision = m.decision AND u.k = m.k AND u.session + 4 >= m.eff),
ud3 AS (SELECT *, close > 0 AND volume > 0 AND NOT susp AND NOT stale AND coalesce(then_ = 'ACTIVE', false) AS valid FROM ud2s),
ud4 AS (SELECT decision, k, max(close) FILTER (WHERE session_idx = decision) AS latest_close, median(close * volume) FILTER (WHERE valid AND session_idx > decision - 26) AS mdv,
   sum(CASE WHEN valid AND session_idx > decision - 26 THEN 1 ELSE 0 END) / 26.0::DOUBLE AS coverage, sum(CASE WHEN valid THEN 1 ELSE 0 END) AS obs,
   coalesce(bool_or(stale) FILTER (WHERE session_idx = decision), false) AS is_stale, coalesce(bool_or(valid) FILTER (WHERE session_idx = decision), false) AS lok FROM ud3 GROUP BY 1, 2),
uda AS (SELECT n.decision, n.k, CAST(n.k AS VARCHAR) AS security_id, status, latest_close, mdv, coalesce(coverage, 0) AS coverage, coalesce(obs, 0) AS obs, list_filter([CASE WHEN status <> 'ACTIVE' THEN 'inactive_or_suspended' END, CASE WHEN n.k % 29 = 0 THEN 'not_common_stock' END, CASE WHEN n.k % 31 = 0 THEN 'not_us_listed_stock' END,
   CASE WHEN NOT coalesce(lok, false) THEN 'missing_stale_or_invalid_latest_bar' END, CASE WHEN is_stale THEN 'stale' END, CASE WHEN NOT coalesce(latest_close >= 5, false) THEN 'raw_close_below_floor' END,
   CASE WHEN NOT coalesce(mdv >= 50000, false) THEN 'sip_liquidity_below_floor' END, CASE WHEN coalesce(obs, 0) < 100 THEN 'insufficient_valid_observations' END, CASE WHEN coalesce(coverage, 0) < 0.75 THEN 'session_coverage_below_floor' END], lambda z: z IS NOT NULL) AS reasons
   FROM now_ n LEFT JOIN ud4 USING (decision, k)),
bar_seen AS (SELECT session_idx AS i, min(session + 4) AS seen, max(CASE WHEN CAST(security_id AS BIGINT) % 10 = 3 THEN 1 ELSE 0 END) AS iex FROM bars GROUP BY 1),
counts AS (SELECT dc.decision, at_, count(k) AS audited, coalesce(sum(CASE WHEN len(reasons) = 0 THEN 1 ELSE 0 END), 0) AS eligible FROM dc LEFT JOIN uda USING (decision) GROUP BY 1, 2),
gated AS (SELECT decision, audited, eligible, list_sort(list_filter([
   CASE WHEN EXISTS (SELECT 1 FROM bar_seen WHERE i = {MISSING_AT} AND seen <= at_) THEN 'bar_evidence_missing' END, CASE WHEN EXISTS (SELECT 1 FROM bar_seen WHERE i = {UNVERIFIED_AT} AND seen <= at_) THEN 'bar_evidence_unverified' END,
   CASE WHEN EXISTS (SELECT 1 FROM bar_seen WHERE i = {LATE_AT} AND seen <= at_) THEN 'bar_evidence_late' END, CASE WHEN EXISTS (SELECT 1 FROM bar_seen WHERE i = {FEED_AT} AND iex = 1 AND seen <= at_) THEN 'feed_not_consolidated' END,
   CASE WHEN EXISTS (SELECT 1 FROM mv a JOIN mv b USING (k) WHERE a.ev = 3 AND a.status = 'DELISTED' AND b.ev = 4 AND b.av <= at_) THEN 'security_reactivated' END,
   CASE WHEN decision + 1 < 100 THEN 'too_few_completed_sessions' END, CASE WHEN decision + 1 >= (SELECT count(*) FROM cal) THEN 'calendar_ends_before_decision' END, CASE WHEN eligible < 10 THEN 'too_few_members' END], lambda z: z IS NOT NULL)) AS gates FROM counts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY len(reasons) > 0, round(mdv, 6) DESC NULLS LAST, security_id) AS rk FROM uda),
chosen AS (SELECT decision, security_id, row_number() OVER (PARTITION BY decision ORDER BY security_id) - 1 AS position FROM ranked JOIN gated USING (decision) WHERE len(reasons) = 0 AND rk <= 30 AND len(gates) = 0),
mem AS (SELECT decision, security_id, row_number() OVER (PARTITION BY decision ORDER BY security_id) - 1 AS position, count(*) OVER (PARTITION BY decision) AS size FROM ranked JOIN gated USING (decision)
  WHERE len(reasons) = 0 AND rk <= 400 AND eligible >= 2 AND len(list_filter(gates, lambda z: z <> 'too_few_members')) = 0)"""
)
UNIVERSE_SQL = BARS + "," + UNIVERSE_TAIL


@query(
    "c01_universes",
    out(UNIVERSE_SQL, "SELECT decision, security_id, status, latest_close, mdv AS median_dollar_volume, coverage, obs AS valid_observations, len(reasons) = 0 AS eligible, reasons AS exclusion_reasons, c.position IS NOT NULL AS selected FROM uda LEFT JOIN chosen c USING (decision, security_id)",
        "decision:i security_id:s status:s latest_close:f median_dollar_volume:f coverage:f valid_observations:i eligible:b exclusion_reasons:a selected:b", 4),
)
def c01_all(spark, sf):
    """The audit of every security at every rebalance decision; members only where no gate is closed."""
    audit, _, chosen = universe_of_decisions(spark, sf)
    a = audit.join(chosen.select("decision", "security_id", F.lit(True).alias("selected")), ["decision", "security_id"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    return finish(a.select("decision", "security_id", "status", "latest_close", "median_dollar_volume", "coverage", "valid_observations", "eligible", "exclusion_reasons", "selected"), 4)


@query(
    "c01_universe_status",
    out(UNIVERSE_SQL, "SELECT decision, CASE WHEN len(gates) = 0 THEN 'READY' ELSE 'DATA_GATE' END AS status, gates, audited, eligible, CASE WHEN len(gates) = 0 THEN least(eligible, 30) ELSE 0 END AS members FROM gated",
        "decision:i status:s gates:a audited:i eligible:i members:i"),
)
def c01_status(spark, sf):
    return finish(universe_of_decisions(spark, sf)[1])


@query("t01_top_by_liquidity", out(C01_SQL, "SELECT security_id, mdv AS median_dollar_volume FROM ubs WHERE eligible AND rk <= 30", "security_id:s median_dollar_volume:f", 4))
def t01(spark, sf):
    a = universe_audit(spark, sf).where("eligible")
    return finish(a.orderBy(fr.snap("median_dollar_volume", 6).desc(), "security_id").limit(30).select("security_id", "median_dollar_volume"), 4)


@query(
    "c02_equity_snapshot_screen",
    out(
        _OH
        + f""", us0 AS (SELECT *, valid AND NOT duplicate AND NOT off_calendar AND volume > 0 AS usable FROM oh), us1 AS (SELECT * FROM us0 QUALIFY row_number() OVER (PARTITION BY security_id, session) = 1),
        us2 AS (SELECT *, CASE WHEN close - {at('close', -1)} = 0 THEN 1 ELSE 0 END AS same FROM us1), us3 AS (SELECT *, usable AND NOT coalesce(sum(same) OVER {ts(2)} = 2, false) AS v FROM us2),
        us4 AS (SELECT security_id, sum(v::INT) AS obs, sum((v AND session_idx > {DEC_IDX} - 26)::INT) / 26.0::DOUBLE AS coverage, median(close * volume) FILTER (WHERE v AND session_idx > {DEC_IDX} - 26) AS mdv, max(close) FILTER (WHERE session_idx = {DEC_IDX}) AS lc,
          coalesce(bool_or(v) FILTER (WHERE session_idx = {DEC_IDX}), false) AS ok FROM us3 WHERE session_idx <= {DEC_IDX} GROUP BY 1)""",
        """SELECT security_id, obs AS valid_observations, coverage, mdv AS median_dollar_volume, list_filter([CASE WHEN NOT coalesce(lc >= 5, false) THEN 'price_below_floor_or_missing' END, CASE WHEN NOT ok THEN 'missing_zero_volume_stale_or_invalid_latest' END,
        CASE WHEN obs < 100 THEN 'history_too_short' END, CASE WHEN coverage < 0.75 THEN 'coverage_below_floor' END, CASE WHEN NOT coalesce(mdv >= 50000, false) THEN 'liquidity_below_floor' END], lambda z: z IS NOT NULL) AS exclusion_reasons FROM us4""",
        "security_id:s valid_observations:i coverage:f median_dollar_volume:f exclusion_reasons:a", 4,
    ),
)
def c02(spark, sf):
    b = dirty_bars(spark, sf).where(F.col("session_idx") <= DEC_IDX)
    b = qa.keep_latest(b, ["security_id", "session"], ["close", "volume", "open", "high", "low"])  # repeated bars are unusable either way
    a = un.screen(b, DEC_IDX, 26, POLICY)
    return finish(a.select("security_id", "valid_observations", "coverage", "median_dollar_volume", "exclusion_reasons"), 4)


@query(
    "c03_expanded_panel",
    out(
        RETURNS
        + f""", ex0 AS (SELECT *, count(ret) OVER (PARTITION BY security_id ORDER BY session_idx ROWS UNBOUNDED PRECEDING) AS history, round({ADV}, 6) AS adv FROM rets),
        ex1 AS (SELECT *, coalesce(history >= 52 AND close >= 5 AND adv IS NOT NULL AND rank() OVER (PARTITION BY session_idx ORDER BY adv DESC NULLS LAST) <= 60, false) AS eligible FROM ex0)""",
        "SELECT security_id, min(CASE WHEN eligible THEN session END) AS first_eligible, sum(CASE WHEN eligible THEN 1 ELSE 0 END) AS eligible_sessions, sum(CASE WHEN eligible AND session_idx <= 178 THEN 1 ELSE 0 END) AS train_sessions FROM ex1 GROUP BY 1",
        "security_id:s first_eligible:d eligible_sessions:i train_sessions:i",
    ),
)
def c03(spark, sf):
    df = un.dynamic_eligibility(tb.returns(spark, sf), 52, 5.0, (26, 13), 60, tb.shape(spark, sf).wide)
    return finish(
        df.groupBy("security_id").agg(
            F.min(F.when(F.col("eligible"), F.col("session"))).alias("first_eligible"), F.sum(F.col("eligible").cast("int")).alias("eligible_sessions"),
            F.sum((F.col("eligible") & (F.col("session_idx") <= 178)).cast("int")).alias("train_sessions"),
        )
    )


# --- sorts and sets ------------------------------------------------------------------------------


@query(
    "t05_keep_last_per_key",
    out("", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1", "o_custkey:i o_orderkey:i o_totalprice:f"),
)
def t05(spark, sf):
    o = tb.table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return finish(qa.keep_latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice"))


@query("t06_sorted_output", out("", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey", "o_custkey:i o_orderkey:i o_orderdate:t"))
def t06(spark, sf):
    o = tb.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate").orderBy("o_custkey", "o_orderdate", "o_orderkey")
    return finish(o)


@query(
    "e01_row_union",
    out("", "SELECT 'order' AS kind, o_custkey AS key, o_totalprice AS amount, NULL AS note FROM orders UNION ALL SELECT 'customer', c_custkey, c_acctbal, c_mktsegment FROM customer", "kind:s key:i amount:f note:s"),
)
def e01(spark, sf):
    a = tb.table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("amount"))
    b = tb.table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("note"))
    return finish(a.unionByName(b, allowMissingColumns=True).select("kind", "key", "amount", "note"))


@query("e02_set_difference", out("", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'", "key:i"))
def e02(spark, sf):
    c = tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    o = tb.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    return finish(tp.subset_violations(c, o, ["key"]))


@query("e03_intersection", out(FUT_SQL, "SELECT date, root FROM crv WHERE carry_annualized IS NOT NULL INTERSECT SELECT date, root FROM hld WHERE excess_return IS NOT NULL", "date:d root:s"))
def e03(spark, sf):
    from panelweft.operators import futures as fu

    d, m = ev.futures(spark, sf)
    c = fu.contract_curve(d, m)
    h = fu.held_contract_returns(c, d)
    return finish(c.where("carry_annualized IS NOT NULL").select("date", "root").intersect(h.where("excess_return IS NOT NULL").select("date", "root")))


@query("e04_distinct_union", out("", "SELECT p_brand AS symbol FROM part UNION SELECT p_type FROM part UNION SELECT c_mktsegment FROM customer", "symbol:s"))
def e04(spark, sf):
    p, c = tb.table(spark, sf, "part"), tb.table(spark, sf, "customer")
    u = p.select(F.col("p_brand").alias("symbol")).union(p.select("p_type")).union(c.select("c_mktsegment"))
    return finish(u.distinct())


@query(
    "d62_business_days",
    out("", """SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE isodow(o_orderdate) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS next_day,
        CAST(o_orderdate AS DATE) - CASE WHEN isodow(o_orderdate) = 6 THEN 5 WHEN isodow(o_orderdate) = 7 THEN 6 ELSE 7 END AS five_before FROM orders""".replace("= 6 THEN 5", "= 6 THEN 5").replace("= 7 THEN 6", "= 7 THEN 6"),
        "o_orderkey:i next_day:d five_before:d"),
)
def d62(spark, sf):
    day = F.to_date("o_orderdate")
    return finish(tb.table(spark, sf, "orders").select("o_orderkey", add_business_days(day, 1).alias("next_day"), add_business_days(day, -5).alias("five_before")))
