"""Event, filing and futures tables derived from orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweft.session import cut
from panelweft.sources.tables import shape, table

# Day after which every open interval is cut; parameters of the derived tables.
DECISION = "1999-01-01"


def cents(col: str):
    return F.rint(F.col(col) * 100).cast("bigint")


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as bitemporal revisions of the order's event."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag", "l_quantity", "l_extendedprice")
    od = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    status = (
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49), "DELISTED")
        .when(F.col("l_returnflag") == "N", "SUSPENDED")
        .otherwise("ACTIVE")
    )
    return (
        li.join(od, li.l_orderkey == od.o_orderkey)
        .where(F.col("l_shipdate") >= F.col("o_orderdate"))
        .select(
            F.col("l_orderkey").alias("event_id"),
            F.col("o_custkey").alias("security_id"),
            F.col("o_orderdate").alias("effective_at"),
            F.col("l_shipdate").alias("available_at"),
            status.alias("status"),
            cents("l_extendedprice").alias("price"),
        )
    )


def filing_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as filings: symbol, sector, available_at, six components."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_custkey").alias("symbol"),
        F.col("c_mktsegment").alias("sector"),
        F.to_date("o_orderdate").alias("available_at"),
        k.alias("accession"),
        ((k % 97) / 97.0).alias("profitability"),
        ((k % 89) / 89.0).alias("gross_profitability"),
        F.when(k % 7 != 0, (k % 83) / 83.0).alias("cash_profitability"),
        (((F.col("o_custkey") * 31 + k) % 101) / 101.0).alias("accrual_quality"),
        F.when(k % 11 != 0, -F.round("o_totalprice") / 100000.0).alias("asset_growth"),
        F.when(k % 3 != 0, (k % 79) / 79.0).alias("revenue_growth"),
    )


def messages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events as messages, sign-ups as instrument definitions."""
    e = table(spark, sf, "events")
    k = F.from_json("props", "k INT")["k"]
    defs = e.where("event_type = 'signup'").select(
        F.col("user_id").alias("instrument_id"), F.col("ts").alias("def_ts"), F.col("event_id").alias("def_id"), k.alias("k")
    )
    rest = e.where("event_type <> 'signup'").select(
        F.col("user_id").alias("instrument_id"), F.col("ts").alias("ts_event"), "event_id", "event_type", "value"
    )
    return rest, defs


def scd_map(spark: SparkSession, sf: str) -> DataFrame:
    """Two ticker versions per customer, the second one open."""
    c = table(spark, sf, "customer")
    switch = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 700).cast("int"))
    both = F.array(
        F.struct(
            F.concat(F.lit("A"), F.col("c_custkey")).alias("symbol"),
            F.lit("1990-01-01").cast("date").alias("valid_from"),
            F.date_sub(switch, 1).alias("valid_to"),
        ),
        F.struct(
            F.concat(F.lit("B"), F.col("c_custkey")).alias("symbol"),
            switch.alias("valid_from"),
            F.lit(None).cast("date").alias("valid_to"),
        ),
    )
    return c.select(
        F.col("c_custkey").alias("entity_id"), F.col("c_custkey").cast("string").alias("cik"),
        F.col("c_mktsegment").alias("sector"), F.explode(both).alias("v"),
        ((F.col("c_custkey") % 10) != 9).alias("is_primary_ticker"),
    ).select("entity_id", "cik", "sector", "v.*", "is_primary_ticker")


def membership(spark: SparkSession, sf: str) -> DataFrame:
    """Membership of two indices, names spelt in several ways, from each customer's first order; some joined 50 years earlier, some are removed."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("effective_date"))
    k = F.col("o_custkey")
    name = F.element_at(F.array(*map(F.lit, ["Mid Cap", "large cap", "LargeCap", "Large Cap", "Large Cap", "Large Cap"])), (k % 6 + 1).cast("int"))
    return o.select(
        name.alias("index_name"), k.cast("string").alias("cik"), F.when(k % 11 == 0, F.date_sub("effective_date", 18262)).otherwise(F.col("effective_date")).alias("effective_date"),
        F.when(k % 4 != 0, F.date_add("effective_date", ((k % 5 + 1) * 200).cast("int"))).alias("removal_date"),
    )


def facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Line items as filing facts, orders as filings."""
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    report = F.make_date(F.year("o_orderdate") - 1, F.lit(12), F.lit(31))
    filings = o.select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("accession_id"),
        F.to_date("o_orderdate").alias("filing_date"),
        F.when(F.col("o_orderkey") % 10 < 7, "10-K").when(F.col("o_orderkey") % 10 == 7, "10-k/a").otherwise("10-Q").alias("form_type"),
        (F.col("o_orderkey") % 10 == 7).alias("is_amendment"),
        F.col("o_orderdate").alias("accepted_at"), report.alias("report_date"),
    )
    names = F.array(*[F.lit(n) for n in ("TotalAssets", "TotalRevenue", "GrossProfit", "NetIncome", "OperatingCashFlow", "Other")])
    j = li.join(o.select("o_orderkey", "o_custkey", "o_orderdate"), li.l_orderkey == F.col("o_orderkey"))
    f = j.select(
        F.col("o_custkey").alias("entity_id"), F.col("l_orderkey").alias("accession_id"),
        F.element_at(names, (F.col("l_partkey") % 6 + 1).cast("int")).alias("standard_concept"),
        F.col("l_linenumber").alias("priority"),
        (F.round("l_extendedprice") - 20000).alias("value_as_filed"),
        F.when(F.col("l_quantity") > 5, report).otherwise(F.date_sub(report, 1)).alias("period_end"),
        (F.year("o_orderdate") - 1).alias("fiscal_year"),
        F.col("l_shipdate").alias("accepted_at"),
        (F.col("l_suppkey") % 100 + 340).cast("int").alias("period_span_days"),
    )
    return f, filings


def futures(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Brands as roots, shipping quarters as contracts, order weeks as dates."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    expiry = F.to_date(F.date_trunc("quarter", "l_shipdate"))
    date = F.to_date(F.date_trunc("week", "o_orderdate"))
    daily = (
        j.withColumns({"date": date, "expiry_date": expiry})
        .where(F.col("expiry_date") > F.col("date"))
        .groupBy("date", F.col("p_brand").alias("root"), "expiry_date")
        .agg(
            (F.sum(cents("l_extendedprice")) / F.lit(100.0) / F.sum(F.col("l_quantity").cast("bigint"))).alias("settlement"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("volume"),
            F.count("*").alias("open_interest"),
        )
        .withColumn("contract", F.concat_ws("_", "root", F.date_format("expiry_date", "yyyyMM")))
    )
    # both outputs and every caller read the aggregate: frozen once
    daily = cut(daily)
    meta = daily.select("root", "contract", "expiry_date").distinct().withColumns(
        {
            "first_notice_date": F.when(F.month("expiry_date") != 7, F.date_sub("expiry_date", 10)),
            "last_trade_date": F.date_sub("expiry_date", 3),
            "cash_settled": F.month("expiry_date") == 4,
        }
    )
    return daily.drop("expiry_date"), meta


def horizon(spark: SparkSession, sf: str):
    """Day after the last session."""
    return F.date_add(F.lit(shape(spark, sf).last), 1)
