"""Performance, contribution, regime and selection tables.

Inputs are result tables: a daily ledger per experiment and session, holdings,
metrics rows. Series are bounded by the calendar, metrics by the grid.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweft.functions.frames import cumulative, finite, join_safe, positive, ratio, snap, truth
from panelweft.operators.quality import violations
from panelweft.session import cut


BOOK = ("experiment", "session_idx")


def segments(spark: SparkSession, table: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Segment names with inclusive first and last dates."""
    df = spark.createDataFrame(list(table), "segment string, first string, last string")
    return df.select("segment", F.to_date("first").alias("__first"), F.to_date("last").alias("__last"))


def label_segments(df: DataFrame, seg: DataFrame, day: str = "session") -> DataFrame:
    """Attach the segment of each row's date, ``outside`` where none applies."""
    cond = (F.col(day) >= F.col("__first")) & (F.col(day) <= F.col("__last"))
    return (
        df.join(F.broadcast(seg), cond, "left")  # a handful of rows
        .withColumn("segment", F.coalesce("segment", F.lit("outside")))
        .drop("__first", "__last")
    )


def performance(df: DataFrame, by: Sequence[str], ret: str = "net_return", periods: float = 252.0) -> DataFrame:
    """Return, volatility, Sharpe, drawdown and hit rate per group."""
    by = list(by)
    d = df.where(F.col(ret).isNotNull())
    w = Window.partitionBy(*by).orderBy("session_idx").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__nav", F.exp(F.sum(F.log1p(ret)).over(w)))
    d = d.withColumn("__dd", F.col("__nav") / F.max("__nav").over(w) - 1)
    g = d.groupBy(*by).agg(
        F.count("*").alias("sessions"),
        (F.exp(F.sum(F.log1p(ret))) - 1).alias("total_return"),
        (F.stddev_samp(ret) * F.sqrt(F.lit(periods))).alias("annual_volatility"),
        F.avg(ret).alias("__m"),
        F.min("__dd").alias("max_drawdown"),
        F.avg((F.col(ret) > 0).cast("double")).alias("positive_rate"),
    )
    return g.withColumns(
        {
            "cagr": F.pow(1 + F.col("total_return"), periods / F.col("sessions")) - 1,
            "sharpe": ratio(F.col("__m") * periods, positive(F.col("annual_volatility"))),
        }
    ).drop("__m")


def compounded(ret: str) -> Column:
    return F.exp(F.sum(F.log1p(ret))) - 1


def segment_metrics(daily: DataFrame, by: Sequence[str] = ("experiment", "segment"), periods: float = 252.0) -> DataFrame:
    """Net and gross performance, turnover, costs, exposure and the worst year."""
    by = list(by)
    net = performance(daily, by, "net_return", periods)
    gross = performance(daily, by, "gross_return", periods).select(*by, F.col("sharpe").alias("gross_sharpe"))
    sums = daily.groupBy(*by).agg(
        (F.avg("turnover") * periods).alias("annual_turnover"), F.sum("transaction_cost").alias("transaction_cost"),
        F.sum("borrow_cost").alias("borrow_cost"), F.avg("gross").alias("average_gross"), F.max(F.abs("net")).alias("max_abs_net"),
    )
    yearly = daily.groupBy(*by, F.year("session").alias("year")).agg(compounded("net_return").alias("y"))
    worst = yearly.groupBy(*by).agg(F.min("y").alias("worst_year"))
    return net.join(gross, by).join(sums, by).join(worst, by)


def budget_maxima(usage: DataFrame, by: Sequence[str] = ("experiment", "segment")) -> DataFrame:
    """(keys, kind, name, rebalances, maximum_usage, at_session, maximum_excess, relaxed) of a table of budgets used at rebalances.

    The session of a maximum is the first that reaches it; ``relaxed`` counts the rebalances whose cap liquidity lifted.
    """
    first = F.max_by("session_idx", F.struct(snap("usage", 9), -F.col("session_idx")))
    return usage.groupBy(*by, "kind", "name").agg(
        F.count("*").alias("rebalances"), F.max("usage").alias("maximum_usage"), first.alias("at_session"), F.max("excess").alias("maximum_excess"), F.sum((F.col("effective_cap") > F.col("cap")).cast("int")).alias("relaxed")
    )


def segment_diagnostics(
    daily: DataFrame, books: DataFrame, held: DataFrame, market: DataFrame, sleeve: str = "sleeve", by: Sequence[str] = ("experiment", "segment"), periods: float = 252.0, largest: int = 5,
) -> DataFrame:
    """One row per segment: performance, costs a year, books, concentration, sleeves and market beta.

    ``daily`` and ``books`` have a row per book and session, ``held`` one per holding with ``contribution`` and ``sleeve``;
    all carry the keys. ``market``: session_idx, market. Every table is grouped by the keys once; names are summed first.
    """
    by = list(by)
    years = F.count("*") / periods
    cost = daily.join(market, "session_idx", "left").groupBy(*by).agg(
        (F.sum("turnover") / years).alias("annual_turnover"), (F.sum("transaction_cost") / years).alias("annual_transaction_cost"), (F.sum("borrow_cost") / years).alias("annual_borrow_cost"),
        F.avg("gross").alias("average_gross"), F.max("gross").alias("maximum_gross"), F.max_by("session_idx", F.struct(snap("gross", 9), -F.col("session_idx"))).alias("maximum_gross_session"), F.max(F.abs("net")).alias("maximum_abs_net"),
        finite(F.regr_slope(F.col("net_return"), F.col("market"))).alias("market_beta"), finite(F.regr_r2(F.col("net_return"), F.col("market"))).alias("r_squared"),
    )
    gross = performance(daily, by, "gross_return", periods).select(*by, F.col("sharpe").alias("gross_sharpe"), F.col("cagr").alias("gross_cagr"))
    sides = books.groupBy(*by).agg(
        F.sum("long_net_return").alias("long_contribution"), F.sum("short_net_return").alias("short_contribution"), (F.avg("short_net_return") * periods).alias("short_expectancy"),
        F.avg("long_gross_exposure").alias("average_long_exposure"), F.avg("short_gross_exposure").alias("average_short_exposure"),
    )
    names = held.groupBy(*by, "security_id", sleeve).agg(F.sum("contribution").alias("c"))
    size = F.abs(snap("c", 12))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(size.desc(), "security_id"))
    totals = names.groupBy(*by).agg(F.sum(F.abs("c")).alias("all"))
    top = names.withColumn("__k", rank).where(F.col("__k") <= largest).groupBy(*by).agg(F.sum(F.abs("c")).alias("top"), F.array_sort(F.collect_list(F.struct("__k", "security_id"))).alias("__t"))
    share = totals.join(top, by).select(*by, ratio(F.col("top"), positive(F.col("all"))).alias("top_share"), F.col("__t.security_id").alias("top_names"))
    gains = names.groupBy(*by, sleeve).agg(F.sum("c").alias("c")).groupBy(*by).agg(F.sum((snap("c", 12) > 0).cast("int")).alias("positive_sleeves"))
    out = performance(daily, by, "net_return", periods)
    for side in (gross, cost, sides, share, gains):
        out = out.join(side, by, "left")
    return out


def leave_one_out(legs: DataFrame, nxt: DataFrame, pair: Sequence[str], periods: float = 252.0) -> DataFrame:
    """(pair, sessions, mean, sharpe, total_return) of the book of all pairs but one, for every pair.

    ``legs``: session_idx, pair, security_id and the pair's signed signal; a name's score is the mean of its legs, and a
    session's book holds names by their score, scaled to a gross of one. ``nxt``: session_idx, security_id and the return
    that the session's book earns.

    No book is built again: without a pair only the scores of its own names change, by the leg that leaves their sums and
    counts. So a pair costs its legs, and its book's returns are the whole book's but for those sessions.
    """
    pair = list(pair)
    legs = legs.where(F.col("signal").isNotNull()).join(nxt.where(F.col("next").isNotNull()), ["session_idx", "security_id"])
    names = legs.groupBy("session_idx", "security_id").agg(F.sum("signal").alias("s"), F.count("*").alias("n"), F.max("next").alias("__next"))
    score = F.col("s") / F.col("n")
    whole = names.groupBy("session_idx").agg(F.sum(F.abs(score)).alias("g"), F.sum(score * F.col("__next")).alias("r"))
    less = F.when(F.col("n") > 1, (F.col("s") - F.col("signal")) / (F.col("n") - 1)).otherwise(0.0)
    changed = legs.join(names, ["session_idx", "security_id"]).groupBy(*pair, "session_idx").agg(F.sum(F.abs(less) - F.abs(score)).alias("dg"), F.sum((less - score) * F.col("__next")).alias("dr"))

    def earned(g: Column, r: Column) -> Column:
        return F.when(g > 1e-9, r / g)

    def sums(x: Column) -> Column:
        return F.struct(F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("x"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("xx"), F.coalesce(F.sum(F.log1p(x)), F.lit(0.0)).alias("log"))

    base = whole.agg(sums(earned(F.col("g"), F.col("r"))).alias("all")).withColumn("__one", F.lit(1))  # one row
    both = changed.join(whole, "session_idx").withColumns({"was": earned(F.col("g"), F.col("r")), "is": earned(F.col("g") + F.col("dg"), F.col("r") + F.col("dr"))})
    out = both.groupBy(*pair).agg(sums(F.col("was")).alias("was"), sums(F.col("is")).alias("is")).withColumn("__one", F.lit(1)).join(base, "__one")
    n, x, xx, log = (F.col(f"all.{c}") - F.col(f"was.{c}") + F.col(f"is.{c}") for c in ("n", "x", "xx", "log"))
    deviation = F.sqrt(F.greatest((xx - x * x / n) / (n - 1), F.lit(0.0)))
    return out.where(n > 1).select(*pair, n.alias("sessions"), (x / n * periods).alias("mean"), ratio(x / n * F.sqrt(F.lit(periods)), positive(deviation)).alias("sharpe"), (F.exp(log) - 1).alias("total_return"))


def yearly_table(daily: DataFrame, by: Sequence[str] = ("experiment",)) -> DataFrame:
    return daily.groupBy(*by, F.year("session").alias("year")).agg(
        F.count("*").alias("sessions"), F.sum("gross_return").alias("gross_return"), F.sum("transaction_cost").alias("transaction_cost"),
        F.sum("borrow_cost").alias("borrow_cost"), F.sum("net_return").alias("net_arithmetic"), compounded("net_return").alias("net_compounded"),
    )


def unpivot_books(books: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Long and short books as rows."""
    def side(name, borrow):
        return F.struct(
            F.lit(name).alias("book"), F.col(f"{name}_gross_return").alias("gross_return"),
            F.col(f"{name}_transaction_cost").alias("transaction_cost"), borrow.alias("borrow_cost"),
            F.col(f"{name}_net_return").alias("net_return"), F.col(f"{name}_gross_exposure").alias("exposure"),
        )
    both = F.array(side("long", F.lit(0.0)), side("short", F.col("borrow_cost").cast("double")))
    return books.select("experiment", "session_idx", *extra, F.explode(both).alias("__b")).select(
        "experiment", "session_idx", *extra, "__b.*"
    )


def book_metrics(rows: DataFrame, by: Sequence[str], periods: float = 252.0) -> DataFrame:
    sums = rows.groupBy(*by).agg(
        F.sum("gross_return").alias("gross_contribution"), F.sum("transaction_cost").alias("transaction_cost"),
        F.sum("borrow_cost").alias("borrow_cost"), F.sum("net_return").alias("net_arithmetic"),
        (F.avg("net_return") * periods).alias("expectancy"), F.avg("exposure").alias("average_exposure"),
    )
    return sums.join(performance(rows, by, "net_return", periods), list(by))


def contribution_sets(held: DataFrame, dims: Sequence[str], by: Sequence[str] = ("experiment",)) -> DataFrame:
    """Additive contribution by each dimension in one GROUPING SETS pass.

    ``held`` carries ``contribution`` and ``weight``; the output names the
    dimension and its value.
    """
    by = list(by)
    sets = [[*[F.col(b) for b in by], F.col(d)] for d in dims]
    cols = [*by, *dims]
    g = held.groupingSets(sets, *[F.col(c) for c in cols]).agg(
        F.grouping_id(*cols).alias("__gid"),
        F.sum("contribution").alias("contribution"),
        F.sum(F.when(F.col("weight") > 0, F.col("contribution")).otherwise(0.0)).alias("long_contribution"),
        F.sum(F.when(F.col("weight") < 0, F.col("contribution")).otherwise(0.0)).alias("short_contribution"),
        F.avg(F.abs("weight")).alias("average_weight"),
        F.count("*").alias("rows"),
    )
    n = len(dims)
    name = F.element_at(F.array(*[F.lit(d) for d in dims]), 1)
    value = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        only = (2**n - 1) ^ (1 << (n - 1 - i))
        name = F.when(F.col("__gid") == only, d).otherwise(name)
        value = F.when(F.col("__gid") == only, F.col(d).cast("string")).otherwise(value)
    return g.select(*by, name.alias("dimension"), value.alias("value"), "contribution", "long_contribution", "short_contribution", "average_weight", "rows")


def concentration(totals: DataFrame, by: Sequence[str], name: str = "value", amount: str = "contribution", top: int = 5) -> DataFrame:
    """Share and names of the largest absolute contributors per group.

    The leaders come from a bounded ordered aggregate, so a group of any size
    only passes ``top`` rows on.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(snap(F.abs(F.col(amount)), 12).desc(), F.col(name))
    lead = totals.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= top)
    names = lead.groupBy(*by).agg(
        F.sum(F.abs(F.col(amount))).alias("__top"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rk", name))), lambda s: s[name]), ",").alias("top_names"),
    )
    whole = totals.groupBy(*by).agg(
        F.sum(F.abs(F.col(amount))).alias("__all"),
        F.max_by(name, F.struct(snap(amount, 12), name)).alias("largest_positive"),
        F.min_by(name, F.struct(snap(amount, 12), name)).alias("largest_negative"),
    )
    return names.join(whole, by).withColumn("top_share", ratio(F.col("__top"), positive(F.col("__all")))).drop("__top", "__all")


def top_fraction(totals: DataFrame, by: Sequence[str], amount: str, name: str, fraction: float = 0.05, floor: bool = False) -> DataFrame:
    """The largest ``fraction`` of contributors (rounded up, or down), ties by name; missing amounts don't count.

    Ranks come from cumulative counts over tiles of distinct amounts, so that only equal amounts meet in a task.
    """
    by = list(by)
    v = cut(totals.where(F.col(amount).isNotNull()).withColumn("__v", snap(amount, 12)))
    placed = join_safe(v, cumulative(v, by, "__v"), [*by, "__v"], "inner")
    n = F.col("__total")
    most = F.floor(n * fraction) if floor else F.ceil(n * fraction)
    above = n - F.col("__upto")
    ties = Window.partitionBy(*by, "__v").orderBy(name)
    ranked = placed.where(above < most).withColumn("rank", (above + F.row_number().over(ties)).cast("int"))
    return ranked.where(F.col("rank") <= most).drop("__v", "__n", "__upto", "__total")


def cost_waterfall(metrics: DataFrame, periods: float = 252.0) -> DataFrame:
    """Annualised drags and whether removing borrow alone flips the sign."""
    k = periods / F.col("sessions")
    m = metrics.withColumns(
        {
            "gross_expectancy": F.col("gross_contribution") * k,
            "transaction_drag": F.col("transaction_cost") * k,
            "borrow_drag": F.col("borrow_cost") * k,
        }
    )
    free = F.col("gross_expectancy") - F.col("transaction_drag")
    return m.withColumns(
        {"borrow_free": free, "flips_sign": truth((free > 0) & (F.col("expectancy") <= 0))}
    )


def stream_stats(rows: DataFrame, by: Sequence[str], value: str = "value", periods: float = 252.0) -> DataFrame:
    """Arithmetic statistics of contribution streams."""
    g = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("sessions"), F.sum(value).alias("arithmetic"), (F.avg(value) * periods).alias("expectancy"),
        (F.stddev_samp(value) * F.sqrt(F.lit(periods))).alias("volatility"), F.avg((F.col(value) > 0).cast("double")).alias("positive_rate"),
    )
    return g.withColumn("sharpe", ratio(F.col("expectancy"), positive(F.col("volatility"))))


def masked(rows: DataFrame, masks: Mapping[str, Column]) -> DataFrame:
    """Repeat each row under every mask that holds for it."""
    names = F.array_compact(F.array(*[F.when(truth(c), F.lit(n)) for n, c in masks.items()]))
    return rows.withColumn("regime", F.explode(names))


def interaction_events(held: DataFrame, daily: DataFrame, state: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Per rebalance: drifted gross before, gross after, next-session costs.

    The last session of a block is its rebalance decision; the first session of
    the next block executes it.
    """
    r0 = F.coalesce("ret", F.lit(0.0))
    nets = daily.select("experiment", "session_idx", "net_return")
    drift = held.groupBy("experiment", "session_idx").agg(F.sum(F.abs(F.col("weight") * (1 + r0))).alias("drifted"))
    drift = drift.join(nets, ["experiment", "session_idx"]).select(
        "experiment", "session_idx", (F.col("drifted") / F.abs(1 + F.col("net_return"))).alias("gross_before")
    )
    first = daily.where(F.col("session_idx") == F.col("block") + 1)
    after = first.select(
        "experiment", F.col("block").alias("session_idx"), F.col("session_idx").alias("execution_idx"), F.col("gross").alias("gross_after"),
        "turnover", F.col("transaction_cost").alias("baseline_cost"), F.col("net_return").alias("execution_return"),
    )
    st = state.select("experiment", F.col("session_idx").alias("execution_idx"), F.col("transaction_cost").alias("state_cost"))
    m = multipliers.select(
        F.col("session_idx").alias("execution_idx"), "volatility_ratio", "liquidity_ratio", "prior_drawdown", "transaction_multiplier"
    )
    e = drift.join(after, ["experiment", "session_idx"]).join(st, ["experiment", "execution_idx"]).join(m, "execution_idx", "left")
    change = ratio(F.col("gross_after") - F.col("gross_before"), positive(F.col("gross_before")))
    e = e.withColumn("gross_change", change)
    label = F.when(truth(F.col("gross_change") < -0.10), "deleveraging").when(truth(F.col("gross_change") > 0.10), "expansion").otherwise("normal")
    return e.withColumns(
        {
            "state": label,
            "direction": F.when(truth(F.col("gross_change") < 0), "reduction").otherwise("non_reduction"),
            "incremental_cost": F.col("state_cost") - F.col("baseline_cost"),
        }
    )


def interaction_summary(events: DataFrame, by: Sequence[str] = ("experiment",)) -> DataFrame:
    """Two groupings of the rebalances (threshold state, direction) in one pass."""
    both = events.withColumn(
        "__g",
        F.explode(
            F.array(
                F.struct(F.lit("threshold_state").alias("grouping"), F.col("state").alias("group")),
                F.struct(F.lit("gross_direction").alias("grouping"), F.col("direction").alias("group")),
            )
        ),
    ).select("*", "__g.*")
    return both.groupBy(*by, "grouping", "group").agg(
        F.count("*").alias("events"), F.avg("gross_change").alias("mean_gross_change"),
        F.avg("transaction_multiplier").alias("mean_multiplier"), F.percentile("transaction_multiplier", F.lit(0.95)).alias("p95_multiplier"),
        F.avg("turnover").alias("mean_turnover"), F.sum("baseline_cost").alias("baseline_cost"),
        F.sum("state_cost").alias("state_cost"), F.sum("incremental_cost").alias("incremental_cost"), F.sum("execution_return").alias("execution_return"),
    )


def metric_deltas(metrics: DataFrame, reference: str, values: Sequence[str], by: Sequence[str], key: str = "experiment") -> DataFrame:
    """Candidate minus reference metrics within each ``by`` group."""
    by = list(by)
    ref = metrics.where(F.col(key) == reference).select(*by, *[F.col(v).alias(f"__{v}") for v in values])
    return metrics.join(ref, by).select(key, *by, *[(F.col(v) - F.col(f"__{v}")).alias(f"{v}_delta") for v in values])


def selection_table(metrics: DataFrame, order: Sequence[Column], near: str | None = None, tolerance: float = 0.02, key: str = "experiment") -> DataFrame:
    """Rank candidates (a handful of metrics rows) and mark the winner; with
    ``near`` the smallest name within ``tolerance`` of the best wins."""
    w = Window.partitionBy()  # metrics rows of one grid
    m = metrics.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    if near is None:
        return m.withColumn("selected", (F.col("rank") == 1) & F.col("eligible"))
    best = F.max(F.when(F.col("eligible"), F.col(near))).over(w)
    close = truth(F.col("eligible") & (F.col(near) >= best - tolerance))
    m = m.withColumn("__c", F.when(close, F.col(key)))
    return m.withColumn("selected", truth(F.col(key) == F.min("__c").over(w))).drop("__c")


def gate(metrics: DataFrame, rules: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """Named conditions ``(rule, metric, op, bound)`` over a metrics row.

    A missing or NaN metric fails its rule.
    """
    ops = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__"}
    failed = []
    for rule, metric, op, bound in rules:
        value = finite(F.col(metric).cast("double"))
        failed.append(F.when(~truth(getattr(value, ops[op])(F.lit(float(bound)))), F.lit(rule)))
    m = metrics.withColumn("failed", F.array_compact(F.array(*failed)))
    return m.withColumn("passed", F.size("failed") == 0)


def promotion(metrics: DataFrame, sharpe: float, drawdown: float, paper: int, segments: Mapping[str, str]) -> DataFrame:
    """Whether each experiment's segments stay above a Sharpe ratio and within a drawdown, and enough sessions
    lie outside of them. A missing measure fails. ``segments`` maps a segment to its name in the reasons, which
    are fixed values."""
    reasons, columns = [], {}
    for seg, name in segments.items():
        own = F.col("segment") == seg
        columns |= {f"__s_{seg}": F.max(F.when(own, finite(F.col("sharpe")))), f"__d_{seg}": F.max(F.when(own, finite(F.col("max_drawdown"))))}
        reasons.append(F.when(~truth(F.col(f"__s_{seg}") >= sharpe), f"{name}_SHARPE_BELOW_GATE"))
        reasons.append(F.when(~truth(F.col(f"__d_{seg}") >= -drawdown), f"{name}_DRAWDOWN_EXCEEDS_GATE"))
    columns["__paper"] = F.sum(F.when(~F.col("segment").isin(*segments), F.col("sessions")).otherwise(0))
    reasons.append(F.when(F.col("__paper") < paper, "INSUFFICIENT_PROSPECTIVE_PAPER_SESSIONS"))
    m = metrics.groupBy("experiment").agg(*[c.alias(n) for n, c in columns.items()]).withColumn("reasons", F.array_compact(F.array(*reasons)))
    allowed = F.size("reasons") == 0
    return m.select("experiment", F.when(allowed, "ACCEPTED").otherwise("REJECTED").alias("status"), allowed.alias("orders_allowed"), "reasons")


def market_reference(calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """Return since the session before and prior drawdown of one security (session_idx, close), on every session of a calendar."""
    w = Window.orderBy("session_idx")  # calendar only
    before = F.first("close").over(w.rangeBetween(-1, -1))
    peak = F.max("close").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = calendar.select("session_idx", "session").join(prices, "session_idx", "left")
    s = s.select("session", (F.col("close") / before - 1).alias("market_return"), (before / peak - 1).alias("prior_drawdown"))
    return s.withColumn("covered", F.col("market_return").isNotNull() & F.col("prior_drawdown").isNotNull())


def capped_greedy_mean(rows: DataFrame, value: str, name: str, by: Sequence[str], cap: float = 0.6) -> DataFrame:
    """Largest mean reachable with at most ``cap`` per sleeve: fill in order."""
    w = Window.partitionBy(*by).orderBy(snap(value, 12).desc(), F.col(name))
    rank = F.row_number().over(w)
    weight = F.greatest(F.least(F.lit(cap), 1 - cap * (rank - 1)), F.lit(0.0))
    ranked = rows.where(F.col(value).isNotNull()).withColumn("__w", weight)
    return ranked.groupBy(*by).agg(F.sum(F.col("__w") * F.col(value)).alias("best_mean"), F.sum("__w").alias("invested"))


def coverage(df: DataFrame, key: str, day: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("rows"))


def distinct_text(col: str) -> Column:
    """Distinct values joined with a bar, in order."""
    return F.array_join(F.array_sort(F.collect_set(col)), "|")


def order_violations(book: DataFrame, key: Column, allowed: Column) -> DataFrame:
    """Allowed rows that no order can be made of: any of them makes the plan invalid."""
    price, weight = finite(F.col("price").cast("double")), finite(F.col("weight").cast("double"))
    return violations(book.where(allowed), key, {"price_positive": price > 0, "weight_known": weight.isNotNull()})


def plan_status(book: DataFrame, allowed: Column, by: Sequence[str] = BOOK, name: str = "security_id") -> DataFrame:
    """(keys, names, violations, status) of each book: NOT_ALLOWED, REFUSED if a row has no usable price, weight or holding or a name comes twice, else READY."""
    by = list(by)
    number = lambda c: finite(F.col(c).cast("double"))
    fine = truth(number("price") > 0) & number("weight").isNotNull() & number("shares").isNotNull()
    per = book.withColumn("__ok", truth(allowed)).groupBy(*by, name).agg(F.bool_and("__ok").alias("__ok"), F.count("*").alias("__n"), F.sum((~fine).cast("int")).alias("__bad"))
    s = per.groupBy(*by).agg(F.bool_and("__ok").alias("__ok"), F.count("*").alias("names"), F.sum(F.col("__bad") + F.col("__n") - 1).alias("violations"))
    return s.select(*by, "names", "violations", F.when(~F.col("__ok"), "NOT_ALLOWED").when(F.col("violations") > 0, "REFUSED").otherwise("READY").alias("status"))


def order_plan(book: DataFrame, nav: float, allowed: Column, by: Sequence[str] | None = None) -> DataFrame:
    """Whole-share deltas from target weights, prices and current shares; empty
    unless allowed. Shares round half to even. With ``by``, a book has a plan only
    if :func:`plan_status` is READY: one row that no order can be made of refuses
    all of it."""
    if by is not None:
        by = list(by)
        book = book.join(plan_status(book, allowed, by).where("status = 'READY'").select(*by), by, "left_semi")
    goal = F.bround(ratio(F.col("weight") * nav, positive(F.col("price"))), 0)
    held = F.bround(F.coalesce("shares", F.lit(0.0)), 0)
    b = book.where(allowed).withColumn("target_shares", goal).withColumn("delta", F.col("target_shares") - held)
    return b.where(F.col("delta") != 0)


def shadow_targets(book: DataFrame, accepted: Column, age_days: Column, max_age: int = 4) -> DataFrame:
    """The approved weight equals the theoretical one only for an accepted decision
    on data at most ``max_age`` days old."""
    fresh = truth(age_days <= max_age)
    ok = truth(accepted)
    reasons = F.array_compact(
        F.array(
            F.when(~ok, F.lit("PROMOTION_DECISION_REJECTED")), F.when(~fresh, F.lit("MARKET_DATA_STALE"))
        )
    )
    return book.withColumns(
        {"approved_weight": F.when(ok & fresh, F.col("weight")).otherwise(0.0), "reasons": reasons}
    )
