"""Data gates: rule tables over whole archives, admission of what passes, and a status that follows from both.

Every rule counts the rows that break it, per archive, in one aggregate of its table; rules over keys (repeats, rows
without a partner) are counted by grouped keys and hash joins. Admission feeds back: roots that pass their own rules are
admitted, sleeves are counted over admitted roots only, and both counts are rules themselves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweft.functions.frames import join_safe, truth

ADMITTED, BLOCKED = "ADMITTED", "BLOCKED"

# Columns of a contract archive.
DAILY_COLUMNS = ("date", "root", "contract", "settlement", "open", "high", "low", "volume", "open_interest")
METADATA_COLUMNS = ("root", "contract", "sleeve", "exchange", "currency", "multiplier", "tick_size", "expiry_date", "first_notice_date", "last_trade_date")


def expected_sessions(start: date, end: date, days: Sequence[int] = (0, 1, 2, 3, 4)) -> int:
    """Dates from start to end that fall on one of the weekdays (Monday = 0); holidays are ignored."""
    return sum((start + timedelta(days=i)).weekday() in days for i in range((end - start).days + 1))


def missing_columns(columns: Sequence[str], needed: Sequence[str], table: str) -> list[str]:
    return [f"{table}_column_missing:{c}" for c in sorted(set(needed) - set(columns))]


def broken_rows(df: DataFrame, by: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(keys, rule, rows): how many rows break each rule; a missing outcome breaks it."""
    sums = df.groupBy(*by).agg(*(F.sum((~truth(ok)).cast("long")).alias(n) for n, ok in rules.items()))
    return sums.unpivot(list(by), list(rules), "rule", "rows")


def repeated_keys(df: DataFrame, by: Sequence[str], keys: Sequence[str], rule: str) -> DataFrame:
    """(keys, rule, rows): rows beyond the first of each key."""
    n = df.groupBy(*by, *keys).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.sum(F.col("n") - 1).alias("rows")).select(*by, F.lit(rule).alias("rule"), "rows")


def _number(c: str, least: float, strict: bool) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & ((x > least) if strict else (x >= least))


@dataclass(frozen=True)
class FuturesPolicy:
    start: date
    end: date
    days: tuple[int, ...] = (0, 1, 2, 3, 4)
    min_coverage: float = 0.95
    min_curve_share: float = 0.60
    min_roots: int = 12
    min_sleeves: int = 3


@dataclass
class Gate:
    """``rules``: keys, rule, rows, broken. ``parts``: what was judged for admission. ``status``: keys, status, problems and what is admitted."""

    rules: DataFrame
    parts: DataFrame
    status: DataFrame


def futures_gate(daily: DataFrame, metadata: DataFrame, universe: DataFrame, policy: FuturesPolicy, by: Sequence[str] = ("archive",)) -> Gate:
    """Whether a contract archive supports a study of the roots of ``universe`` (root, sleeve).

    A root is admitted with enough sessions, two expiries on enough of them, and data from the first to the last day.
    Raises where columns are missing: nothing else can be judged then.
    """
    by = list(by)
    missing = missing_columns(daily.columns, [*by, *DAILY_COLUMNS], "daily") + missing_columns(metadata.columns, [*by, *METADATA_COLUMNS], "metadata")
    if missing:
        raise ValueError(f"{BLOCKED}: " + ", ".join(missing))
    known = universe.select("root", "sleeve").dropDuplicates(["root"])  # the frozen roots of a study, some dozens
    names = known.select("root", F.lit(True).alias("__known"))
    d, m = daily.join(names, "root", "left"), metadata.join(names, "root", "left")
    cash = F.coalesce(F.col("cash_settled"), F.lit(False)) if "cash_settled" in metadata.columns else F.lit(False)
    rules = broken_rows(d, by, {
        "date_invalid": F.col("date").isNotNull(), "daily_root_unknown": F.col("__known"),
        "price_invalid": _number("settlement", 0, True) & _number("open", 0, True) & _number("high", 0, True) & _number("low", 0, True),
        "activity_invalid": _number("volume", 0, False) & _number("open_interest", 0, False),
    })
    rules = rules.unionByName(broken_rows(m, by, {
        "metadata_root_unknown": F.col("__known"), "scale_invalid": _number("multiplier", 0, True) & _number("tick_size", 0, True),
        "notice_missing": F.col("first_notice_date").isNotNull() | cash, "expiry_missing": F.col("expiry_date").isNotNull() & F.col("last_trade_date").isNotNull(),
    }))
    rules = rules.unionByName(repeated_keys(daily, by, ["date", "contract"], "contract_date_repeated")).unionByName(repeated_keys(metadata, by, ["contract"], "metadata_repeated"))
    traded = daily.groupBy(*by, "contract").agg(F.count("*").alias("n"))
    described = metadata.select(*by, "contract").distinct().withColumn("__m", F.lit(True))
    bare = join_safe(traded, described, [*by, "contract"]).groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("__m").isNull(), F.col("n"))), F.lit(0)).alias("rows"))
    rules = rules.unionByName(bare.select(*by, F.lit("contract_without_metadata").alias("rule"), "rows"))

    lo, hi = F.lit(policy.start), F.lit(policy.end)
    inside = daily.where(F.col("date").between(lo, hi))
    per_day = inside.groupBy(*by, "root", "date").agg(F.countDistinct("contract").alias("n"))
    seen = per_day.groupBy(*by, "root").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("observed_sessions"), F.avg((F.col("n") >= 2).cast("double")).alias("two_expiry_session_share")
    ).join(inside.groupBy(*by, "root").agg(F.countDistinct("contract").alias("contracts")), [*by, "root"])
    archives = daily.select(*by).distinct()
    every = archives.withColumn("__one", F.lit(1)).join(known.withColumn("__one", F.lit(1)), "__one").drop("__one")  # archives times some dozens of roots
    parts = every.join(seen, [*by, "root"], "left").fillna(0, ["observed_sessions", "contracts"]).fillna(0.0, ["two_expiry_session_share"])
    parts = parts.withColumn("session_coverage", F.col("observed_sessions") / F.lit(float(expected_sessions(policy.start, policy.end, policy.days))))
    passed = (F.col("session_coverage") >= policy.min_coverage) & (F.col("two_expiry_session_share") >= policy.min_curve_share) & truth(F.col("first_date") <= lo) & truth(F.col("last_date") >= hi)
    parts = parts.withColumn("admitted", passed)
    admitted = parts.groupBy(*by).agg(
        F.array_sort(F.collect_set(F.when(F.col("admitted"), F.col("root")))).alias("admitted_roots"), F.array_sort(F.collect_set(F.when(F.col("admitted"), F.col("sleeve")))).alias("admitted_sleeves")
    )
    roots, sleeves = F.size("admitted_roots"), F.size("admitted_sleeves")
    few = admitted.select(*by, F.explode(F.array(
        F.struct(F.lit("too_few_roots").alias("rule"), F.greatest(F.lit(policy.min_roots) - roots, F.lit(0)).cast("long").alias("rows")),
        F.struct(F.lit("too_few_sleeves").alias("rule"), F.greatest(F.lit(policy.min_sleeves) - sleeves, F.lit(0)).cast("long").alias("rows")),
    )).alias("r")).select(*by, "r.*")
    rules = rules.unionByName(few).withColumn("broken", F.col("rows") > 0)
    return Gate(rules, parts, _status(rules, admitted, by))


def _status(rules: DataFrame, admitted: DataFrame, by: list[str]) -> DataFrame:
    """A row per archive: nothing broken admits it; what it admits in parts stays listed either way."""
    problems = rules.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("broken"), F.col("rule")))).alias("problems"))
    return problems.join(admitted, by, "left").withColumn("status", F.when(F.size("problems") == 0, ADMITTED).otherwise(BLOCKED))


@dataclass(frozen=True)
class FilingPolicy:
    """Thresholds of a filing archive over its train dates."""

    start: date
    end: date
    days: tuple[int, ...] = (0, 1, 2, 3, 4)
    members: int = 400
    min_session_share: float = 0.95
    one_event: int = 250
    three_events: int = 200
    names_per_sector: int = 10
    sectors: int = 8


def filing_gate(events: DataFrame, membership: DataFrame, policy: FilingPolicy) -> Gate:
    """Whether filings cover an index: ``events`` (entity_id, accession_id, availability_date), ``membership`` (date, cik, entity_id, sector)."""
    lo, hi = F.lit(policy.start), F.lit(policy.end)
    train = events.where(F.col("availability_date").between(lo, hi))
    per = train.groupBy("entity_id").agg(F.countDistinct("accession_id").alias("n"), F.count("*").alias("rows"))
    counts = per.agg(F.count("*").alias("entities_with_one_event"), F.coalesce(F.sum((F.col("n") >= 3).cast("long")), F.lit(0)).alias("entities_with_three_events"), F.coalesce(F.sum("rows"), F.lit(0)).alias("train_events"))
    held = membership.where(F.col("date").between(lo, hi))
    deep = held.groupBy("date").agg(F.countDistinct("cik").alias("n")).agg(F.count("*").alias("train_sessions"), F.coalesce(F.sum((F.col("n") >= policy.members).cast("long")), F.lit(0)).alias("deep_sessions"))
    covered = held.join(per.select("entity_id"), "entity_id", "left_semi").groupBy("sector").agg(F.countDistinct("entity_id").alias("n"))
    sectors = covered.agg(F.coalesce(F.sum((F.col("n") >= policy.names_per_sector).cast("long")), F.lit(0)).alias("deep_sectors"))
    again = events.groupBy("entity_id", "availability_date").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_availability"))
    ends = events.agg(F.min("availability_date").alias("first_event"), F.max("availability_date").alias("last_event"))
    one = counts
    for side in (deep, sectors, again, ends):  # one row each
        one = one.withColumn("__one", F.lit(1)).join(side.withColumn("__one", F.lit(1)), "__one").drop("__one")
    needed = int(policy.min_session_share * expected_sessions(policy.start, policy.end, policy.days))
    components = {
        "membership_session_coverage": (F.col("deep_sessions"), needed), "one_train_event": (F.col("entities_with_one_event"), policy.one_event), "three_train_events": (F.col("entities_with_three_events"), policy.three_events),
        "sector_depth": (F.col("deep_sectors"), policy.sectors),
    }
    rows = [F.struct(F.lit(n).alias("rule"), F.greatest(F.lit(least) - have, F.lit(0)).cast("long").alias("rows")) for n, (have, least) in components.items()]
    rows.append(F.struct(F.lit("unique_entity_availability").alias("rule"), F.col("repeated_availability").cast("long").alias("rows")))
    rules = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("broken", F.col("rows") > 0)
    return Gate(rules, covered, _status(rules.withColumn("__one", F.lit(1)), one.withColumn("__one", F.lit(1)), ["__one"]).drop("__one"))

