"""Readers for the file formats: each reads with Spark and hands text rows to a
parser that works on any DataFrame of documents or lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweft.operators.quality import canonical_ticker, clean_identifier

BAR_SCHEMA = "symbol STRING, t STRING, o DOUBLE, h DOUBLE, l DOUBLE, c DOUBLE, v DOUBLE"


def scan_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, CSV or JSON by suffix."""
    bare = path.rstrip("/").removesuffix(".gz")
    if bare.endswith(".csv"):
        r = spark.read.option("header", True)
        return (r.schema(schema) if schema else r).csv(path)
    if bare.endswith((".json", ".jsonl")):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    return spark.read.parquet(path)


def session_date(instant: Column, zone: str = "America/New_York") -> Column:
    """Exchange-local date of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def parse_bars(lines: DataFrame, value: str = "value") -> DataFrame:
    """CSV bar lines ``symbol,t,o,h,l,c,v`` to bars with their New York session."""
    b = lines.select(F.from_csv(F.col(value), BAR_SCHEMA).alias("b")).select("b.*")
    return b.withColumn("session", session_date(F.try_to_timestamp("t")))


def scan_bars(spark: SparkSession, path: str, symbols: DataFrame, calendar: DataFrame) -> DataFrame:
    b = spark.read.option("header", True).schema(BAR_SCHEMA).csv(path)
    return restrict(b.withColumn("session", session_date(F.try_to_timestamp("t"))), symbols, calendar)


def restrict(bars: DataFrame, symbols: DataFrame, calendar: DataFrame) -> DataFrame:
    """Keep listed symbols and calendar sessions."""
    return bars.join(symbols.select("symbol"), "symbol", "left_semi").join(calendar, "session")


def adjusted_ohlcv(df: DataFrame) -> DataFrame:
    """Scale open, high and low by adjusted over raw close."""
    k = F.try_divide("adj_close", F.when(F.col("close") > 0, F.col("close")))
    cols = {f"adj_{c}": F.col(c) * k for c in ("open", "high", "low")}
    return df.withColumns(cols)


def scan_fact_subset(spark: SparkSession, path: str, columns: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Column list and membership filter, both reaching the Parquet scan."""
    return spark.read.parquet(path).where(F.col(column).isin(*values)).select(*columns)


# Taxonomy tags per measure, in order of preference.
TAGS = {
    "assets": ("Assets",),
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"),
    "gross_profit": ("GrossProfit",),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities",),
}
FACT_FORMS = ("10-K", "10-K/A")
_FACT = "struct<val: double, filed: string, end: string, start: string, accn: string, form: string, fp: string, fy: int>"
FACTS_SCHEMA = (
    "cik BIGINT, entityName STRING, "
    f"facts MAP<STRING, MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<{_FACT}>>>>>"
)


def parse_company_facts(docs: DataFrame, value: str = "value") -> DataFrame:
    """Facts documents to annual fact rows.

    Per accession only the latest reported period counts; within it the most
    preferred tag of each measure. Rows are reduced per (accession, period,
    measure) first, so what an accession's window sees is bounded by its periods.
    """
    from pyspark.sql import Window

    d = docs.select(F.from_json(F.col(value), FACTS_SCHEMA).alias("d")).select("d.*")
    tags = d.select("cik", "entityName", F.explode(F.col("facts")["us-gaap"]).alias("tag", "body"))
    order = [(t, c, i) for c, ts in TAGS.items() for i, t in enumerate(ts)]
    concept = F.create_map(*[F.lit(x) for t, c, _ in order for x in (t, c)])
    rank = F.create_map(*[F.lit(x) for t, _, i in order for x in (t, i)])
    tags = tags.withColumns({"concept": F.element_at(concept, F.col("tag")), "tag_priority": F.element_at(rank, F.col("tag"))})
    rows = tags.where(F.col("concept").isNotNull()).select(
        "cik", F.col("entityName").alias("entity_name"), "concept", "tag", "tag_priority", F.explode(F.col("body")["units"]["USD"]).alias("f")
    )
    rows = rows.select(
        "cik", "entity_name", "concept", "tag", "tag_priority", F.col("f.accn").alias("accession"), F.col("f.form").alias("form"),
        F.col("f.fp").alias("fp"), F.col("f.fy").alias("fiscal_year"), F.expr("try_cast(f.start AS DATE)").alias("period_start"),
        F.expr("try_cast(f.end AS DATE)").alias("period_end"), F.expr("try_cast(f.filed AS DATE)").alias("filed"), F.col("f.val").alias("value"),
    )
    span = F.date_diff("period_end", "period_start")
    flow = F.col("concept") != "assets"
    rows = rows.where(
        F.col("form").isin(*FACT_FORMS) & (F.col("fp") == "FY") & F.col("filed").isNotNull() & F.col("period_end").isNotNull()
        & F.col("value").isNotNull() & F.col("accession").isNotNull() & (~flow | F.coalesce(span.between(300, 430), F.lit(False)))
    )
    best = F.min_by(
        F.struct("entity_name", "tag", "form", "fiscal_year", "period_start", "filed", "value"),
        F.struct("tag_priority", "period_start", "filed", "value"),
    )
    one = rows.groupBy("cik", "accession", "period_end", "concept").agg(best.alias("__p"))
    newest = F.max("period_end").over(Window.partitionBy("cik", "accession"))
    return one.withColumn("__new", newest).where("period_end = __new").select(
        "cik", "accession", "period_end", "concept", "__p.*"
    )


def scan_company_facts(spark: SparkSession, path: str) -> DataFrame:
    return parse_company_facts(spark.read.text(path, wholetext=True))


# The vendor's data points and their columns.
HOLDING_FIELDS = {
    "ticker": "ticker", "issueName": "name", "assetClass": "asset_class", "sectorName": "sector", "cusip": "cusip", "isin": "isin",
    "sedol": "sedol", "countryOfRisk": "country_of_risk", "exchange": "exchange", "holdingPercent": "weight_percent",
    "unitPrice": "issuer_valuation_price", "unitsHeld": "shares_held", "marketValue": "market_value", "currencyCode": "currency",
}
_COLUMN = "STRUCT<value: ARRAY<STRING>>"
_POINTS = "asOfDate: STRUCT<value: STRING>, " + ", ".join(f"{f}: {_COLUMN}" for f in HOLDING_FIELDS)
HOLDINGS_SCHEMA = (
    "componentsByNameMap STRUCT<holdings: STRUCT<containersByNameMap: STRUCT<all: STRUCT<dataPointsByNameMap: "
    f"STRUCT<{_POINTS}>>>>>"
)


def parse_holdings(docs: DataFrame, requested: str = "requested_asof", value: str = "value", low: int = 450, high: int = 550) -> tuple[DataFrame, DataFrame]:
    """Parallel-array snapshots to (rows, quarantine with a reason).

    The internal date must equal the requested one, all arrays must have one
    length and the equity count must lie in range.
    """
    p = F.from_json(F.col(value), HOLDINGS_SCHEMA)["componentsByNameMap"]["holdings"]["containersByNameMap"]["all"]["dataPointsByNameMap"]
    d = docs.withColumn("p", p)
    arrays = [F.col(f"p.{f}.value") for f in HOLDING_FIELDS]
    sizes = F.array_distinct(F.array(*[F.coalesce(F.size(a), F.lit(-1)) for a in arrays]))
    asof = F.to_date(F.when(F.col("p.asOfDate.value").rlike(r"^\d{8}$"), F.col("p.asOfDate.value")), "yyyyMMdd")
    absent = F.lit(False)
    for a in arrays:
        absent = absent | a.isNull()
    equities = F.size(F.filter(F.col("p.assetClass.value"), lambda c: c == "Equity"))
    d = d.withColumns({"returned_asof": asof, "equity_rows": equities})
    reason = (
        F.when(F.col("p").isNull(), "NOT_HOLDINGS_JSON")
        .when(F.col("returned_asof").isNull(), "INVALID_ASOF_DATE")
        .when(F.col("returned_asof") != F.col(requested), "DATE_MISMATCH")
        .when(absent, "MISSING_COLUMN")
        .when(F.size(sizes) > 1, "UNEQUAL_LENGTHS")
        .when(~F.col("equity_rows").between(low, high), "UNEXPECTED_EQUITY_COUNT")
    )
    d = d.withColumn("reason", reason)
    zipped = F.arrays_zip(*[a.alias(t) for a, t in zip(arrays, HOLDING_FIELDS.values())])
    good = d.where("reason IS NULL").select(requested, "returned_asof", F.posexplode(zipped).alias("line", "h"))
    good = good.select(requested, "returned_asof", "line", *[F.col("h")[t].alias(t) for t in HOLDING_FIELDS.values()])
    for c in ("ticker", "cusip", "isin", "sedol"):
        good = good.withColumn(c, clean_identifier(F.col(c)))
    ref = F.when(F.col("isin") != "", F.concat(F.lit("ISIN:"), "isin")).when(F.col("cusip") != "", F.concat(F.lit("CUSIP:"), "cusip")).otherwise("")
    return good.withColumn("reference_id", ref), d.where("reason IS NOT NULL").select(requested, "returned_asof", "reason")


def scan_holdings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Snapshot files named ``...YYYY-MM-DD.json``."""
    docs = spark.read.text(path, wholetext=True).withColumn(
        "requested_asof", F.to_date(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})\.json$", 1))
    )
    return parse_holdings(docs)


def parse_ticker_map(docs: DataFrame, value: str = "value") -> DataFrame:
    """``{fields, data}`` documents to rows with an ambiguity flag per symbol."""
    d = docs.select(F.from_json(F.col(value), "fields ARRAY<STRING>, data ARRAY<ARRAY<STRING>>").alias("d")).select("d.fields", F.explode("d.data").alias("row"))

    def field(name):
        return F.try_element_at("row", F.array_position("fields", name).cast("int"))

    rows = d.select(
        F.expr("try_cast(try_element_at(row, cast(array_position(fields, 'cik') as int)) as bigint)").alias("cik"),
        field("name").alias("name"), field("ticker").alias("ticker"), field("exchange").alias("exchange"),
    ).withColumn("canonical_symbol", canonical_ticker(F.col("ticker")))
    n = rows.groupBy("canonical_symbol").agg(F.count("*").alias("__n"))
    return rows.join(n, "canonical_symbol").withColumn("mapping_ambiguous", F.col("__n") > 1).drop("__n")


def scan_ticker_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_ticker_map(spark.read.text(path, wholetext=True))


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line: commas inside quotes don't part cells, doubled quotes stand for one."""
    raw = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    quoted = lambda c: c.startswith('"') & c.endswith('"') & (F.length(c) > 1)
    return F.transform(raw, lambda c: F.when(quoted(c), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def parse_holdings_csv(
    lines: DataFrame, file: str = "file", line: str = "line", value: str = "value", low: int = 450, high: int = 550
) -> tuple[DataFrame, DataFrame]:
    """Issuer CSV files to (equity rows, rejects).

    The header is the first line that starts with Ticker and Name; its own names and width hold for the file.
    Rows: file, asof (from the preamble) and ``cells``, a map by header name. Rejects: file, line and reason, for
    rows of another width and, without a line, for files lacking a header or with an unlikely number of equities.
    """
    parts = csv_cells(F.regexp_replace(F.col(value), "^\ufeff|\r$", ""))
    rows = lines.select(F.col(file).alias("file"), F.col(line).alias("line"), parts.alias("__c"))
    first = F.get("__c", F.lit(0))
    is_head = (first == "Ticker") & (F.get("__c", F.lit(1)) == "Name")
    heads = rows.groupBy("file").agg(
        F.min(F.when(is_head, F.struct("line", "__c"))).alias("__h"), F.min(F.when(first == "Fund Holdings as of", F.struct("line", F.get("__c", F.lit(1)).alias("day")))).alias("__d")
    )
    body = rows.join(heads, "file").where(F.col("line") > F.col("__h.line"))
    fits = F.size("__c") == F.size("__h.__c")
    named = body.where(fits).select("file", F.col("__d.day").alias("asof"), "line", F.map_from_arrays("__h.__c", "__c").alias("cells"))
    equity = named.where(F.col("cells")["Asset Class"] == "Equity")
    counted = heads.join(equity.groupBy("file").agg(F.count("*").alias("n")), "file", "left").select("file", F.col("__h").isNull().alias("headless"), F.coalesce("n", F.lit(0)).alias("n"))
    judged = counted.withColumn("reason", F.when(F.col("headless"), "NOT_HOLDINGS_CSV").when(~F.col("n").between(low, high), "UNEXPECTED_EQUITY_COUNT"))
    rejects = judged.where("reason is not null").select("file", F.lit(None).cast("bigint").alias("line"), "reason")
    rejects = rejects.unionByName(body.where(~fits & (F.trim(F.array_join("__c", "")) != "")).select("file", F.col("line").cast("bigint").alias("line"), F.lit("WIDTH").alias("reason")))
    return equity.join(judged.where("reason is null").select("file"), "file"), rejects


def parse_corporate_actions(docs: DataFrame, page: str = "page", value: str = "value") -> DataFrame:
    """Actions per page and type."""
    d = docs.select(page, F.from_json(F.col(value), "corporate_actions MAP<STRING, ARRAY<MAP<STRING, STRING>>>").alias("d"))
    return d.select(page, F.explode("d.corporate_actions").alias("action_type", "items")).select(page, "action_type", F.size("items").alias("actions"))


def parse_journal(lines: DataFrame, value: str = "value", order: str = "line") -> DataFrame:
    """Latest failed attempt per requested date."""
    j = lines.select(order, F.from_json(F.col(value), "status STRING, requested_asof STRING, reason STRING").alias("j")).select(order, "j.*")
    failed = j.where(F.col("status") != "accepted_historical_snapshot")
    return failed.groupBy("requested_asof").agg(
        F.max_by("status", order).alias("status"), F.max_by("reason", order).alias("reason"), F.max(order).alias("line"), F.count("*").alias("attempts")
    )


# Vendor fields and the measures they feed.
SF1_FIELDS = {"assets": "assets", "revenue": "revenue", "gp": "gross_profit", "netinc": "net_income", "ncfo": "operating_cash_flow"}


def sf1_rows(sf1: DataFrame, candidates: DataFrame) -> DataFrame:
    """As-reported annual rows of candidate symbols."""
    a = sf1.where(F.upper("dimension") == "ARY").select(
        canonical_ticker(F.col("ticker")).alias("symbol"), F.expr("try_cast(datekey AS DATE)").alias("filed"),
        F.expr("try_cast(reportperiod AS DATE)").alias("period_end"), *[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in SF1_FIELDS],
    ).dropna(subset=["symbol", "filed", "period_end"])
    c = candidates.select(canonical_ticker(F.col("symbol")).alias("symbol"), "sector")
    return a.join(c, "symbol")


def sf1_duplicates(rows: DataFrame) -> DataFrame:
    """Repeated vintages; any makes the import invalid."""
    return rows.groupBy("symbol", "filed", "period_end").agg(F.count("*").alias("copies")).where("copies > 1")


def sf1_facts(rows: DataFrame) -> DataFrame:
    """Wide rows to concept rows with a synthetic accession."""
    acc = F.concat_ws("-", F.lit("SF1-ARY"), "symbol", F.date_format("period_end", "yyyyMMdd"), F.date_format("filed", "yyyyMMdd"))
    keys = ["symbol", "sector", "accession", "period_end", "filed"]
    long = rows.withColumn("accession", acc).unpivot(keys, list(SF1_FIELDS), "source", "value")
    names = F.create_map(*[F.lit(x) for kv in SF1_FIELDS.items() for x in kv])
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("concept", F.element_at(names, F.col("source"))).drop("source")


def scan_sleeve_returns(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Return files, one per sleeve, as one table."""
    out = None
    for sleeve, path in paths.items():
        one = scan_table(spark, path, "session DATE, ret DOUBLE").select(F.lit(sleeve).alias("sleeve"), "session", "ret")
        out = one if out is None else out.unionByName(one)
    return out


def incomplete_sessions(rows: DataFrame, sleeves: int) -> DataFrame:
    """Sessions on which not every sleeve has a value."""
    return rows.groupBy("session").agg(F.count("ret").alias("present")).where(F.col("present") < sleeves)


def content_manifest(df: DataFrame, name: str, content: str) -> DataFrame:
    """Name, size and SHA-256 of every row's content."""
    raw = F.col(content).cast("binary")
    return df.select(F.col(name).alias("file"), F.octet_length(raw).alias("bytes"), F.sha2(raw, 256).alias("sha256"))


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """:func:`content_manifest` of the files below a folder."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return content_manifest(b.withColumn("file", F.element_at(F.split("path", "/"), -1)), "file", "content")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Parquet, CSV (gzip for ``csv.gz``) or JSON sink."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt in ("csv", "csv.gz"):
        w.option("header", True).option("compression", "gzip" if fmt.endswith("gz") else "none").csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"unknown sink format {fmt}")
