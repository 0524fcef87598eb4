"""Data-quality rules, identifiers and deterministic filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweft.functions.frames import truth


def require_columns(df: DataFrame, needed: Sequence[str], name: str) -> DataFrame:
    """Fail before planning if a column is missing."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing columns: {', '.join(missing)}")
    return df


def violations(df: DataFrame, key: Column, rules: Mapping[str, Column]) -> DataFrame:
    """One row per broken rule: rule name and key. A missing outcome breaks it."""
    broken = F.array_compact(F.array(*[F.when(~truth(ok), F.lit(n)) for n, ok in rules.items()]))
    return df.select(key.cast("string").alias("key"), F.explode(broken).alias("rule"))


def fail_on(bad: DataFrame, name: str) -> None:
    """Raise with a few examples if any violation exists."""
    rows = bad.limit(5).collect()
    if rows:
        raise ValueError(f"{name}: " + "; ".join(f"{r['rule']} at {r['key']}" for r in rows))


def typed_rules(instants: Sequence[str] = (), dates: Sequence[str] = (), texts: Sequence[str] = (), flags: Sequence[str] = ()) -> dict[str, Column]:
    """Rules over raw text columns: instants carry an offset, dates are midnight,
    strings are nonempty, booleans explicit."""
    offset = r"(Z|[+-]\d{2}:?\d{2})$"
    rules: dict[str, Column] = {}
    for c in instants:
        rules[f"{c}_instant"] = F.col(c).rlike(offset) & F.try_to_timestamp(F.col(c)).isNotNull()
    for c in dates:
        rules[f"{c}_date"] = F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.expr(f"try_cast({c} AS DATE)").isNotNull()
    for c in texts:
        rules[f"{c}_nonempty"] = F.length(F.trim(c)) > 0
    for c in flags:
        rules[f"{c}_boolean"] = F.lower(F.col(c)).isin("true", "false")
    return rules


def panel_violations(df: DataFrame, keys: Sequence[str] = ("security_id", "session"), ret: str = "ret", volume: str = "volume") -> DataFrame:
    """Duplicate keys, NaN or infinite measures, returns below -1, negative volume."""
    key = F.concat_ws("/", *keys)
    dup = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(key.alias("key"), F.lit("duplicate_key").alias("rule"))
    inf = F.lit(float("inf"))
    rules = {
        "finite_return": F.col(ret).isNull() | (~F.isnan(ret) & (F.abs(ret) != inf)),
        "return_floor": F.col(ret).isNull() | (F.col(ret) >= -1),
        "finite_volume": F.col(volume).isNull() | (~F.isnan(volume) & (F.abs(volume) != inf)),
        "volume_sign": F.col(volume).isNull() | (F.col(volume) >= 0),
    }
    return dup.unionByName(violations(df, key, rules))


# What a manifest may say of its master and of how availability is known.
HISTORY_KINDS = ("historical_event_history", "archived_snapshots")
SCOPES = ("historical_verified", "prospective_only")
AVAILABILITY = "evidenced_publication_or_capture"
EVIDENCE_TYPES = ("source_publication", "contemporaneous_capture")


def manifest_rules(decision: Column) -> dict[str, Column]:
    """Rules over a table of manifests (source, calendar_source, security_id_kind, availability_basis, scope,
    master_kind, includes_terminated, valid_from): what a universe decided at ``decision`` may rest on."""
    c = F.col
    historical, prospective = c("scope") == "historical_verified", c("scope") == "prospective_only"
    said = lambda x: F.length(F.trim(c(x))) > 0
    return {
        "sources_named": said("source") & said("calendar_source"),
        "identifier_permanent": c("security_id_kind") == "permanent",
        "availability_evidenced": c("availability_basis") == AVAILABILITY,
        "scope_known": c("scope").isin(*SCOPES),
        "history_kind": ~historical | c("master_kind").isin(*HISTORY_KINDS),
        "terminated_included": ~historical | truth(c("includes_terminated")),
        "snapshot_kind": ~prospective | c("master_kind").isin("current_snapshot", *HISTORY_KINDS),
        "decision_covered": ~prospective | truth(c("valid_from") <= decision),
    }


def evidence_violations(rows: DataFrame, publications: DataFrame, key: Column) -> DataFrame:
    """Rows (publication_id, available_at) without a publication, with an unverified one, or available before it;
    and publications that aren't unique or of an accepted type."""
    known = publications.groupBy("publication_id").agg(
        F.count("*").alias("__copies"), F.min("published_at").alias("__published"), F.bool_and("verified").alias("__verified"),
        F.bool_and(truth(F.col("evidence_type").isin(*EVIDENCE_TYPES))).alias("__typed"),
    )
    linked = rows.join(known, "publication_id", "left")
    there = F.col("__copies").isNotNull()
    rules = {
        "publication_present": there,
        "publication_verified": ~there | F.col("__verified"),
        "available_after_publication": ~there | (F.col("available_at") >= F.col("__published")),
    }
    own = {"publication_unique": F.col("__copies") == 1, "evidence_type": F.col("__typed")}
    return violations(linked, key, rules).unionByName(violations(known, F.col("publication_id"), own))


def ohlcv_flags(bars: DataFrame, calendar: DataFrame, keys: Sequence[str] = ("security_id", "session")) -> DataFrame:
    """Per bar: valid, duplicate, off_calendar and usable.

    Repeats are found by a map-side combined count per key.
    """
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    fin = F.lit(True)
    for x in (o, h, l, c, v):
        fin = fin & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    valid = truth(fin & (o > 0) & (h > 0) & (l > 0) & (c > 0) & (v >= 0) & (h >= F.greatest(o, l, c)) & (l <= F.least(o, h, c)))
    copies = bars.groupBy(*keys).agg(F.count("*").alias("__n"))
    known = calendar.select("session").distinct().withColumn("__cal", F.lit(True))
    df = bars.withColumn("valid", valid).join(copies, list(keys)).join(known, "session", "left")
    df = df.withColumns({"duplicate": F.col("__n") > 1, "off_calendar": F.col("__cal").isNull()}).drop("__n", "__cal")
    return df.withColumn("usable", F.col("valid") & ~F.col("duplicate") & ~F.col("off_calendar") & truth(v > 0))


def canonical_ticker(col: Column) -> Column:
    return F.translate(F.upper(F.trim(col)), "./", "--")


# Texts that stand for a missing identifier.
SENTINELS = ("", "-", "--", "N/A", "None")


def clean_identifier(col: Column) -> Column:
    text = F.trim(F.coalesce(col.cast("string"), F.lit("")))
    return F.when(text.isin(*SENTINELS), "").otherwise(text)


def resolve_variants(names: DataFrame, known: DataFrame, symbol: str = "ticker") -> DataFrame:
    """Match the raw symbol or its dot / dash variant; exactly one hit resolves.

    Each row has at most three variants, so the explosion is bounded.
    """
    raw = F.col(symbol)
    variants = F.array_distinct(F.array(raw, F.replace(raw, F.lit(" "), F.lit(".")), F.replace(raw, F.lit(" "), F.lit("-"))))
    v = names.select(symbol, F.explode(variants).alias("symbol"))
    hits = v.join(known.select("symbol").distinct(), "symbol").groupBy(symbol).agg(
        F.countDistinct("symbol").alias("__hits"), F.min("symbol").alias("__symbol")
    )
    got = names.join(hits, symbol, "left")
    one = truth(F.col("__hits") == 1)
    return got.withColumns(
        {"resolved_symbol": F.when(one, F.col("__symbol")), "reason": F.when(~one, F.lit("unresolved_or_ambiguous"))}
    ).drop("__hits", "__symbol")


def hash_dropped(name: Column, full: bool = False) -> Column:
    """Deterministic 20% removal by SHA-256 modulo five: the first eight hex
    digits, or the whole digest (16 = 1 modulo 5, so the digit sum decides)."""
    digest = F.sha2(name, 256)
    if not full:
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 5 == 0
    digits = F.split(digest, "")
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + F.coalesce(F.conv(d, 16, 10).cast("int"), F.lit(0)))
    return total % 5 == 0


def continuous_names(df: DataFrame, sessions: int, limit: float = 0.5) -> DataFrame:
    """Names with every session present and no absolute return above ``limit``."""
    g = df.groupBy("security_id").agg(
        F.count("*").alias("rows"), F.max(F.abs("ret")).alias("largest_move"), F.sum(truth(F.abs("ret") > limit).cast("int")).alias("breaks")
    )
    return g.withColumn("kept", (F.col("rows") >= sessions) & (F.col("breaks") == 0))


def large_returns(df: DataFrame, limit: float = 0.30) -> DataFrame:
    return df.where(F.abs("ret") > limit)


def schema_audit(columns: set[str], needed: Mapping[str, set[str]]) -> dict[str, list[str]]:
    """Missing columns per requirement (driver-side set logic)."""
    return {name: sorted(req - columns) for name, req in needed.items()}


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = True) -> DataFrame:
    """First or last row per key under a total order, as one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("__p")).select(*keys, "__p.*")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
