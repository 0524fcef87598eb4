"""Filing facts to events, ratios and sector-neutral scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweft.functions.dates import add_business_days
from panelweft.functions.frames import join_safe, positive, ratio, snap, xs_quantiles, xs_rank, xs_stats
from panelweft.operators.temporal import prior_vintage_growth, scd_join, sole

# Standard concept names and the measures they feed.
CONCEPTS = {
    "TotalAssets": "assets",
    "TotalRevenue": "revenue",
    "GrossProfit": "gross_profit",
    "NetIncome": "net_income",
    "OperatingCashFlow": "operating_cash_flow",
}
MEASURES = tuple(CONCEPTS.values())
FLOWS = ("revenue", "gross_profit", "net_income", "operating_cash_flow")
ANNUAL_FORMS = ("10-K", "10-K/A")
# Names of the scored components.
COMPONENTS = (
    "profitability", "gross_profitability", "cash_profitability", "accrual_quality",
    "asset_growth", "revenue_growth",
)


def lookup(key: Column, mapping: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def annual_facts(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts of annual filings for the reported period, with the availability
    date: the later acceptance plus one weekday."""
    annual = filings.where(F.upper("form_type").isin(*ANNUAL_FORMS)).withColumnRenamed(
        "accepted_at", "filing_accepted_at"
    )
    j = facts.join(sole(annual, ["entity_id", "accession_id"]), ["entity_id", "accession_id"])
    j = j.withColumns(
        {
            "accepted_at": F.greatest("accepted_at", "filing_accepted_at"),
            "value": F.col("value_as_filed").cast("double"),
            "concept": lookup(F.col("standard_concept"), CONCEPTS),
        }
    ).drop("filing_accepted_at")
    flow_ok = F.coalesce(F.col("period_span_days").between(300, 430), F.lit(False))
    j = j.where(
        F.col("accepted_at").isNotNull()
        & (F.col("period_end") == F.col("report_date"))
        & F.col("value").isNotNull()
        & ~F.isnan("value")
        & (F.abs("value") != float("inf"))
        & (~F.coalesce(F.col("concept").isin(*FLOWS), F.lit(False)) | flow_ok)
    )
    return j.withColumn("availability_date", add_business_days(F.to_date("accepted_at"), 1))


def filing_ratios(events: DataFrame) -> DataFrame:
    """Four ratios on positive assets."""
    a = positive(F.col("assets"))
    return events.withColumns(
        {
            "profitability": ratio(F.col("net_income"), a),
            "gross_profitability": ratio(F.col("gross_profit"), a),
            "cash_profitability": ratio(F.col("operating_cash_flow"), a),
            "accrual_quality": ratio(F.col("operating_cash_flow") - F.col("net_income"), a),
        }
    )


def pivot_concepts(facts: DataFrame, index: Sequence[str]) -> DataFrame:
    """One row per filing with a column per measure (smallest of repeats)."""
    return facts.groupBy(*index).agg(
        *[F.min(F.when(F.col("concept") == m, F.col("value"))).alias(m) for m in MEASURES]
    )


# Columns that identify an event.
EVENT_INDEX = (
    "symbol", "cik", "sector", "entity_id", "accession_id", "form_type", "is_amendment", "filing_date",
    "availability_date", "period_end", "fiscal_year",
)


def fundamental_events(facts: DataFrame, filings: DataFrame, mapping: DataFrame) -> DataFrame:
    """As-filed annual events with SCD tickers, ratios and prior-vintage growth."""
    j = scd_join(annual_facts(facts, filings), mapping, "entity_id", "availability_date")
    j = j.where(F.col("concept").isNotNull())
    best = F.struct(
        (~F.coalesce("is_primary_ticker", F.lit(False))).alias("secondary"),
        F.coalesce(F.col("priority").cast("double"), F.lit(999.0)).alias("priority"),
        "symbol", "availability_date", "value",
    )
    cols = [c for c in EVENT_INDEX if c not in ("entity_id", "accession_id")]
    chosen = j.groupBy("entity_id", "accession_id", "concept").agg(
        F.min_by(F.struct(*cols, "value"), best).alias("__p")
    ).select("entity_id", "accession_id", "concept", "__p.*")
    events = filing_ratios(pivot_concepts(chosen, EVENT_INDEX))
    events = prior_vintage_growth(
        events, "entity_id", "availability_date",
        {"asset_growth": ("assets", -1.0), "revenue_growth": ("revenue", 1.0)}, "accession_id",
    ).drop("prior_period", "prior_assets", "prior_revenue")
    return events.withColumn("restatement_flag", F.coalesce("is_amendment", F.lit(False)))


def _interpolated(ordered: np.ndarray, q: float) -> float:
    place = (len(ordered) - 1) * q
    low, high = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
    return low if low == high else (np.ceil(place) - place) * low + (place - np.floor(place)) * high


def _centred(value: np.ndarray) -> np.ndarray:
    """Ranks of the winsorised values, from -1 to 1."""
    order, n = np.argsort(value), len(value)
    v = value[order]
    # both steps keep the order, so the values are sorted once
    v = np.fmin(np.maximum(v, _interpolated(v, 0.01)), _interpolated(v, 0.99))
    v = np.sign(v) * np.floor(np.abs(v) * 1e9 + 0.5) / 1e9
    start = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))))
    stop = np.append(start[1:], n)
    k = np.empty(n)
    k[order] = np.repeat((start + 1 + stop) / 2.0, stop - start)  # ties share their mean
    return (k - (n + 1) / 2) / ((n - 1) / 2)


#: Sessions that a task ranks one after the other from the same rows.
BLOCK = 16


def _ranked_sessions(batches, keep: Sequence[str], components: Sequence[str]):
    """Batches of (session, sector) after (session, sector) from spans sorted by sector, block and ``__s``.

    Only rows that count in the session at hand or later ones are held: one for each name of a sector, and a batch.
    """
    key, held, at = None, None, 0
    needed = list(dict.fromkeys([*keep, *components, "__s", "__e"]))

    def ranked(first: int, stop: int):
        start, end = held["__s"].to_numpy(), held["__e"].to_numpy()
        for session in range(first, min(stop, int(end.max(initial=0)))):
            now = held.filter(pa.array((start <= session) & (session < end)))
            if not now.num_rows:
                continue
            columns = [now[c] for c in keep] + [pa.array(np.full(now.num_rows, session, dtype=np.int32))]
            for c in components:
                own = now[c].combine_chunks()
                there = own.is_valid().to_numpy(zero_copy_only=False)
                few = there.sum() < 5
                rank = np.full(len(own), np.nan)
                if not few:
                    rank[there] = _centred(own.drop_null().cast(pa.float64()).to_numpy(zero_copy_only=False))
                columns.append(pa.array(rank, mask=~there | few))
            yield from pa.Table.from_arrays(columns, names=[*keep, "session_idx", *(f"{c}_rank" for c in components)]).to_batches(1 << 16)

    for batch in batches:
        if not batch.num_rows:
            continue
        sector = batch["sector"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        block = batch["__block"].to_numpy()
        edges = [0, *(np.flatnonzero((sector[1:] != sector[:-1]) | (block[1:] != block[:-1])) + 1), len(block)]
        for low, high in zip(edges, edges[1:]):
            rows = pa.Table.from_batches([batch.slice(low, high - low).select(needed)])
            mine = (batch["sector"][low].as_py(), int(block[low]))
            if mine != key:
                if held is not None:
                    yield from ranked(at, (key[1] + 1) * BLOCK)
                key, held, at = mine, rows.slice(0, 0), mine[1] * BLOCK
            held = pa.concat_tables([held, rows])
            seen = rows["__s"][-1].as_py()  # sessions before it have all their rows
            if seen > at:
                yield from ranked(at, seen)
                held, at = held.filter(pa.array(held["__e"].to_numpy() > seen)).combine_chunks(), seen
    if held is not None:
        yield from ranked(at, (key[1] + 1) * BLOCK)


def _ranks_of_each(spans: DataFrame, components: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row per session of each span with ``keep``, session_idx and the winsorised rank of each component in its (session,
    sector). Spans go to the blocks of sessions they reach, so no row of a single session is shuffled."""
    blocks = F.sequence(F.floor(F.col("__s") / BLOCK).cast("int"), F.floor((F.col("__e") - 1) / BLOCK).cast("int"))
    rows = spans.select(*dict.fromkeys([*keep, "sector", *components]), "__s", "__e", F.explode(blocks).alias("__block"))
    rows = rows.withColumns({"__s": F.greatest("__s", F.col("__block") * BLOCK), "__e": F.least("__e", (F.col("__block") + 1) * BLOCK)})
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["session_idx int"] + [f"`{c}_rank` double" for c in components])
    rows = rows.repartition("sector", "__block").sortWithinPartitions("sector", "__block", "__s")
    return rows.mapInArrow(lambda batches: _ranked_sessions(batches, keep, components), schema)


def _ranks_of_all(expanded: DataFrame, components: Sequence[str]) -> DataFrame:
    """:func:`_ranks_of_each` for cross-sections of any size: components become rows, and one tiled sort, one rank and one
    count serve them all."""
    by = ("session_idx", "sector", "component")
    rows = F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("value")) for c in components))
    long_ = expanded.select("session_idx", "sector", "symbol", F.explode(rows).alias("__r")).select("session_idx", "sector", "symbol", "__r.*").where("value is not null")
    long_ = xs_quantiles(long_, {"__lo": ("value", 0.01), "__hi": ("value", 0.99)}, by, True)
    long_ = long_.withColumn("__v", snap(F.least(F.greatest("value", "__lo"), F.col("__hi")), 9)).drop("__lo", "__hi", "value")
    long_ = xs_stats(xs_rank(long_, "__v", "__k", by, True, pct=False), by, True, __n=F.count("__v"))
    rank = F.when(F.col("__n") >= 5, (F.col("__k") - (F.col("__n") + 1) / 2) / ((F.col("__n") - 1) / 2))
    each = long_.groupBy("session_idx", "symbol").agg(*(F.max(F.when(F.col("component") == c, rank)).alias(f"{c}_rank") for c in components))
    return join_safe(expanded, each, ["session_idx", "symbol"])


def _scored(df: DataFrame, names: DataFrame, minimum: int, components: Sequence[str]) -> DataFrame:
    """Means of the ranks of both families, where a session has ``minimum`` names (session_idx, __names)."""
    ranks = [F.col(f"{c}_rank") for c in components]

    def mean(cols, out):
        present = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
        total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
        return present.alias(f"{out}_components"), F.when(present >= 2, total / present)

    qn, q = mean(ranks[:4], "quality")
    gn, g = mean(ranks[4:], "growth")
    # a row a session, calendar-bounded
    df = join_safe(df, F.broadcast(names), ["session_idx"])
    big = F.col("__names") >= minimum
    return df.withColumns(
        {
            "quality_components": qn,
            "growth_components": gn,
            "quality_score": F.when(big, q),
            "conservative_growth_score": F.when(big, g),
        }
    ).drop("__names", *[f"{c}_rank" for c in components])


def span_scores(
    spans: DataFrame, minimum: int = 100, components: Sequence[str] = COMPONENTS, keep: Sequence[str] = ("symbol",)
) -> DataFrame:
    """:func:`fundamental_scores` of values that count from session ``__s`` up to the one before ``__e``: a row per session of
    each span, with ``keep`` and session_idx. Spans of a symbol don't overlap."""
    # equal spans are counted once before they expand
    alike = spans.groupBy("__s", "__e").agg(F.count("*").alias("__n"))
    each = alike.select(F.explode(F.sequence(F.col("__s"), F.col("__e") - 1)).alias("session_idx"), "__n")
    names = each.groupBy("session_idx").agg(F.sum("__n").alias("__names"))
    return _scored(_ranks_of_each(spans, components, keep), names, minimum, components)


def fundamental_scores(
    expanded: DataFrame, minimum: int = 100, components: Sequence[str] = COMPONENTS, wide: bool = False
) -> DataFrame:
    """Sector-neutral quality and conservative-growth scores per session.

    Values are winsorised at the 1st and 99th percentile of (session, sector),
    ranked to [-1, 1] where five or more names are present, then averaged.
    """
    if not wide:
        spans = expanded.withColumns({"__s": F.col("session_idx").cast("int"), "__e": (F.col("session_idx") + 1).cast("int")})
        return span_scores(spans.drop("session_idx"), minimum, components, [c for c in expanded.columns if c != "session_idx"])
    # one row per (session, symbol): the row count is the number of symbols
    names = expanded.groupBy("session_idx").agg(F.count("*").alias("__names"))
    return _scored(_ranks_of_all(expanded, components), names, minimum, components)
