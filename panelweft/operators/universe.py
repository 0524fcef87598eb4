"""Point-in-time universe selection and eligibility screens."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweft.functions.frames import at, finite, roll, snap, truth, ts
from panelweft.operators.quality import EVIDENCE_TYPES, manifest_rules
from panelweft.operators.temporal import Bounded
from panelweft.session import cut


@dataclass(frozen=True)
class UniversePolicy:
    target_size: int = 400
    min_members: int = 200
    liquidity_sessions: int = 60
    min_observations: int = 252
    min_coverage: float = 0.95
    min_close: float = 5.0
    min_dollar_volume: float = 20_000_000.0
    stale_sessions: int = 5

    def __post_init__(self):
        if not 1 <= self.min_members <= self.target_size:
            raise ValueError("require 1 <= min_members <= target_size")
        if min(self.liquidity_sessions, self.min_observations, self.stale_sessions) < 1:
            raise ValueError("session counts must be positive")
        if not 0 <= self.min_coverage <= 1:
            raise ValueError("coverage must lie in [0, 1]")


# Exchanges of listed common stock.
US_EXCHANGES = ("XNAS", "XNYS", "XASE", "ARCX", "BATS", "IEXG")


def unchanged() -> Column:
    """1 where the close equals that of the session before."""
    return F.when(F.col("close") - at("close", -1) == 0, 1).otherwise(0)


class Instants(NamedTuple):
    """Sorted instants of a calendar-bounded table, by day: how many lie before it, and those of the day."""

    days: Bounded
    first: date
    last: date
    count: int

    def before(self, df: DataFrame, time: Column, name: str) -> DataFrame:
        """Adds how many of the instants lie before ``time``; all of them where it is missing."""
        day = F.least(F.greatest(F.to_date(time), F.lit(self.first)), F.date_add(F.lit(self.last), 1))
        df = df.withColumn("__day", F.when(time.isNotNull(), day)).join(self.days.side(F.col("day").alias("__day"), "__base", "__times"), "__day", "left")
        n = F.col("__base") + F.size(F.filter("__times", lambda t: t < time))
        return df.withColumn(name, F.coalesce(n, F.lit(self.count)).cast("int")).drop("__day", "__base", "__times")


def instants(df: DataFrame, time: str) -> Instants:
    """``df`` holds one row an instant, as many as a calendar has."""
    first, last, count = df.agg(F.to_date(F.min(time)), F.to_date(F.max(time)), F.count(time)).first()
    if not count:
        raise ValueError("a universe needs at least one decision and one session")
    per_day = df.groupBy(F.to_date(time).alias("day")).agg(F.collect_list(time).alias("__times"))
    n = (last - first).days + 2
    spread = df.sparkSession.range(0, n, 1, 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day")).join(per_day, "day", "left")
    ahead = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # days of the calendar
    size = F.coalesce(F.size("__times"), F.lit(0))
    spread = spread.withColumn("__base", F.coalesce(F.sum(F.when(F.col("__times").isNull(), 0).otherwise(size)).over(ahead), F.lit(0)))
    return Instants(Bounded(spread.withColumn("__times", F.coalesce("__times", F.array().cast("array<timestamp>"))), n), first, last, count)


class Timeline(NamedTuple):
    """Decisions in order (``place``, decision, decision_at, latest_idx), and which of them have closed a session."""

    decisions: Bounded
    instants: Instants
    closes: Instants
    sessions: Bounded  # session_idx, opens: the first place that has closed it; left: that has closed ``recent`` more
    count: int


def timeline(calendar: DataFrame, decisions: DataFrame, recent: int) -> Timeline:
    """``calendar``: session_idx from 0 on without gaps, close_at. ``decisions``: decision, decision_at."""
    order = Window.orderBy("decision_at", "decision")  # at most some decisions a session
    d = decisions.select("decision", "decision_at", (F.row_number().over(order) - 1).alias("place"))
    closes, made = instants(calendar, "close_at"), instants(decisions, "decision_at")
    # a session that closes at the decision counts
    d = closes.before(d.withColumn("__after", F.col("decision_at") + F.expr("interval 1 microsecond")), F.col("__after"), "__closed").drop("__after")
    d = d.withColumn("latest_idx", F.col("__closed") - 1).drop("__closed")
    sessions = made.before(calendar, F.col("close_at"), "opens").select("session_idx", "opens")
    later = F.lead("opens", recent, made.count).over(Window.orderBy("session_idx"))
    following = F.lead("opens", 1, made.count).over(Window.orderBy("session_idx"))
    sessions = sessions.select("session_idx", "opens", later.alias("left"), following.alias("next"))
    return Timeline(Bounded(d, made.count), made, closes, Bounded(sessions, closes.count), made.count)


def versions(df: DataFrame, line: Timeline, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds the places ``from`` and ``to`` between which each version is the latest of its key that a decision knows.

    A version is known once it is available and effective. One without either time never is.
    """
    known = F.when(F.col("available_at").isNotNull() & F.col("effective_at").isNotNull(), F.greatest("available_at", "effective_at"))
    df = line.instants.before(df, known, "from")
    after = Window.partitionBy(*key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("to", F.coalesce(F.min("from").over(after), F.lit(line.count))).where("from < to")


def _between(t: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as arrays; what is missing is NaN among doubles and False among booleans."""
    out = []
    for n in names:
        c = t.column(n)
        out.append(c.fill_null(False).to_numpy(zero_copy_only=False).astype(bool) if pa.types.is_boolean(c.type) else c.to_numpy())
    return out


def _worth(events: pa.Table, bars: pa.Table, opens: np.ndarray, count: int, policy: UniversePolicy, historical: bool) -> dict[str, np.ndarray]:
    """What a security's versions of events and bars say at every place: a table of sessions by places, filled version by version."""
    sessions, places = len(opens), np.arange(count)
    start, stop, eff, active = _between(events, "from", "to", "eff_idx", "active")
    state, then = np.full(count, -1), np.zeros((sessions, count), bool)
    for k in range(len(start)):  # in the order of states: a later one covers an earlier one
        state[start[k] : stop[k]] = k
        then[eff[k] :, start[k] : stop[k]] = active[k]
    close, volume = np.full((sessions, count), np.nan), np.full((sessions, count), np.nan)
    said, halted, known = (np.zeros((sessions, count), bool) for _ in range(3))
    if bars.num_rows:
        start, session, c, v, is_said, is_halted = _between(bars, "from", "session_idx", "close", "volume", "said", "halted")
        there = bars.column("close").is_valid().to_numpy()
        order = np.lexsort((c, there, bars.column("available_at").cast(pa.int64()).to_numpy(), session))
        until = np.full(sessions, count)
        end = np.empty(len(start), np.int64)
        for k in order[::-1]:  # a version holds until a later one of its session is known
            end[k] = until[session[k]]
            until[session[k]] = min(until[session[k]], start[k])
        for k in order:
            if start[k] < end[k]:
                at_ = session[k], slice(start[k], end[k])
                close[at_], volume[at_], said[at_], halted[at_], known[at_] = c[k], v[k], is_said[k], is_halted[k], True
    with np.errstate(all="ignore"):
        same = np.zeros((sessions, count), bool)
        same[1:] = close[1:] - close[:-1] == 0
        flat = same.copy()
        for k in range(1, policy.stale_sessions):
            flat[k:] &= same[:-k]
            flat[:k] = False
        stale = known & (said | flat)
        number = lambda x: (x > 0) & (x < np.inf)
        valid = known & number(close) & number(volume) & ~halted & ~stale & (places >= opens[:, None])
        if historical:
            valid &= then
        latest = np.searchsorted(opens, places, side="right") - 1  # the last session closed by then
        n = policy.liquidity_sessions
        window = latest[:, None] - np.arange(n)
        inside, window = window >= 0, np.maximum(window, 0)
        good = valid[window, places[:, None]] & inside
        amount = np.sort(np.where(good, (close * volume)[window, places[:, None]], np.nan), axis=1)  # NaN last
        m = good.sum(axis=1)
        low, high = amount[places, np.maximum(m - 1, 0) // 2], amount[places, np.minimum(m // 2, n - 1)]
        median = np.where(m > 0, 0.5 * low + 0.5 * high, np.nan)
    here, last = latest >= 0, np.maximum(latest, 0)
    return {
        "place": places, "state": state, "valid_observations": valid.sum(axis=0), "latest_close": np.where(here, close[last, places], np.nan), "median_dollar_volume": median,
        "coverage": m / float(n), "is_stale": here & stale[last, places], "__latest_ok": here & valid[last, places],
    }


def universes(
    master: DataFrame, bars: DataFrame, calendar: DataFrame, decisions: DataFrame, policy: UniversePolicy, historical: bool = True,
) -> DataFrame:
    """Audit of every security known at each decision, with its exclusion reasons.

    ``master``: security_id, event_id, effective_at, available_at, ticker, security_type, listing_country, exchange,
    status. ``bars``: security_id, session_idx, effective_at, available_at, close, volume, is_stale, is_suspended.
    ``calendar``: session_idx (0, 1, ...), close_at. ``decisions``: decision (any integer), decision_at.

    No row meets every decision. A version of an event or bar is the latest known one between two decisions; a task
    takes a security at a time, with the bars of a calendar and a few events, and fills a table of sessions by
    decisions from its versions, of which observations, coverage and medians are sums and sorts. All of it is
    partitioned by security, once, and sessions without a bar stay gaps.
    """
    line = timeline(calendar, decisions, policy.liquidity_sessions)
    e = versions(master, line, ["event_id"], ["available_at", "status"])
    e = line.closes.before(e, F.col("effective_at"), "eff_idx")
    state = F.struct("effective_at", "event_id", "status", "ticker", "security_type", "listing_country", "exchange")
    e = e.groupBy("security_id").agg(F.array_sort(F.collect_list(F.struct(state.alias("state"), "from", "to", "eff_idx"))).alias("__e"))
    rows = e.select("security_id", F.explode("__e").alias("x")).select("security_id", "x.from", "x.to", "x.eff_idx", truth(F.col("x.state.status") == "ACTIVE").alias("active"))

    b = bars.where(F.col("session_idx").between(0, line.closes.count - 1))
    b = line.instants.before(b, F.when(F.col("available_at").isNotNull() & F.col("effective_at").isNotNull(), F.greatest("available_at", "effective_at")), "from")
    b = b.select("security_id", F.col("session_idx").cast("int"), "from", "available_at", F.col("close").cast("double"), F.col("volume").cast("double"), truth(F.col("is_stale")).alias("said"), truth(F.col("is_suspended")).alias("halted"))
    opens = np.array([r[0] for r in line.sessions.df.orderBy("session_idx").select("opens").collect()], np.int64)  # a number a session
    count = line.count
    kinds = "security_id string, place int, state int, valid_observations long, latest_close double, median_dollar_volume double, coverage double, is_stale boolean, __latest_ok boolean"
    fields = {"place": pa.int32(), "state": pa.int32(), "valid_observations": pa.int64(), "latest_close": pa.float64(), "median_dollar_volume": pa.float64(), "coverage": pa.float64(), "is_stale": pa.bool_(), "__latest_ok": pa.bool_()}

    def run(events: pa.Table, own: pa.Table) -> pa.Table:
        got = _worth(events, own, opens, count, policy, historical) if events.num_rows else {c: np.zeros(0) for c in fields}
        there = got["state"] >= 0
        key = np.repeat(events.column("security_id")[0].as_py(), int(there.sum())) if events.num_rows else []
        return pa.table({"security_id": pa.array(key, pa.string()), **{c: pa.array(got[c][there]).cast(t) for c, t in fields.items()}})

    g = rows.groupBy("security_id").cogroup(b.groupBy("security_id")).applyInArrow(run, kinds)
    g = g.join(e, "security_id").withColumn("state", F.col("__e")[F.col("state")]["state"]).drop("__e")
    g = g.withColumns({c: finite(F.col(c)) for c in ("latest_close", "median_dollar_volume")})
    g = g.join(line.decisions.side("place", "decision", "decision_at", "latest_idx"), "place").select("*", "state.*").drop("state", "place")
    return _audit(g, policy)


def build_universe(master: DataFrame, bars: DataFrame, calendar: DataFrame, decision_at: Column, policy: UniversePolicy, historical: bool = True) -> DataFrame:
    """:func:`universes` at a single time."""
    one = master.sparkSession.range(1).select(F.lit(0).alias("decision"), decision_at.alias("decision_at"))
    return universes(master, bars, calendar, one, policy, historical).drop("decision")


# Statuses of a security, and those after which its id can't come back.
STATUSES = ("ACTIVE", "SUSPENDED", "DELISTED", "MERGED", "LIQUIDATED")
TERMINAL = STATUSES[2:]
FEED = "SIP"


def _seen(broken: DataFrame, rule: str, start: str = "from", stop: Column | None = None) -> DataFrame:
    """When a rule is broken: from the first decision that sees the row, to the end unless the row is replaced."""
    return broken.select(F.lit(rule).alias("rule"), F.col(start).alias("start"), (F.lit(None).cast("int") if stop is None else stop).alias("stop"), (F.col("__rows") if "__rows" in broken.columns else F.lit(1).cast("long")).alias("__rows"))


def gate_rules(
    master: DataFrame, bars: DataFrame, publications: DataFrame, calendar: DataFrame, decisions: DataFrame, manifest: DataFrame, policy: UniversePolicy,
) -> DataFrame:
    """(decision, rule, rows) of what forbids a universe at each decision.

    Adds to the inputs of :func:`universes` the columns publication_id (both), session and feed of bars, session of the calendar, the
    publications (publication_id, published_at, verified, evidence_type) and a ``manifest`` of one row.
    Only rows visible at a decision count against it. A broken rule is broken from the decision on that first sees all
    rows it takes, and, where a rule is about states, until one of them is replaced; so each broken row is looked at
    once, in the join that its rule needs, and becomes an interval of decisions.
    """
    line = timeline(calendar, decisions, policy.liquidity_sessions)
    n = F.lit(line.count)
    known = F.when(F.col("available_at").isNotNull() & F.col("effective_at").isNotNull(), F.greatest("available_at", "effective_at"))
    m = line.instants.before(master, known, "from").where(F.col("from") < n)
    b = line.instants.before(bars, known, "from").where(F.col("from") < n)
    # the rules on single bars need only what they say, and how many say it
    said = cut(b.groupBy("publication_id", "session", "effective_at", "available_at", "feed", "from").agg(F.count("*").alias("__rows")))
    found = []

    # evidence: one row a publication, joined by its hash
    p = publications.groupBy("publication_id").agg(
        F.count("*").alias("__copies"), F.min("published_at").alias("__published"), F.bool_and(truth(F.col("verified"))).alias("__verified"), F.bool_and(truth(F.col("evidence_type").isin(*EVIDENCE_TYPES))).alias("__typed"),
    )
    for name, df in (("master", m.withColumn("__rows", F.lit(1).cast("long"))), ("bar", said)):
        linked = df.groupBy("publication_id", "available_at", "from").agg(F.sum("__rows").alias("__rows")).join(p, "publication_id", "left")
        verdict = F.when(F.col("__copies").isNull(), "missing").when(F.col("__copies") > 1, "repeated").when(~F.col("__typed"), "of_unknown_type").when(~F.col("__verified"), "unverified").when(F.col("available_at") < F.col("__published"), "late")
        found.append(linked.withColumn("__verdict", verdict).where("__verdict is not null").select(F.concat_ws("_", F.lit(name), F.lit("evidence"), "__verdict").alias("rule"), F.col("from").alias("start"), F.lit(None).cast("int").alias("stop"), "__rows"))

    # revisions and identity of events; a rule over several rows holds once the second of them is seen
    second = lambda: F.get(F.array_sort(F.collect_list("from")), F.lit(1))
    again = m.groupBy("event_id", "available_at").agg(second().alias("from")).where("`from` is not null")
    found.append(_seen(again, "master_revision_ambiguous"))
    first = m.groupBy("event_id", "security_id", "effective_at").agg(F.min("from").alias("from")).groupBy("event_id").agg(second().alias("from")).where("`from` is not null")
    found.append(_seen(first, "event_identity_changed"))
    e = versions(master, line, ["event_id"], ["available_at", "status"])
    found.append(_seen(e.where(~truth(F.col("status").isin(*STATUSES))), "status_unknown", stop=F.col("to")))
    e = e.select("security_id", "effective_at", "event_id", "status", "from", "to")
    # a security's events, few, side by side: two states at one time, or life after a terminal one
    events = e.groupBy("security_id").agg(F.collect_list(F.struct("effective_at", "event_id", "status", "from", "to")).alias("__e"))
    pair = events.select(F.explode("__e").alias("x"), "__e").select("x", F.explode(F.filter("__e", lambda y: y["event_id"] != F.col("x.event_id"))).alias("y"))
    pair = pair.withColumns({"from": F.greatest("x.from", "y.from"), "to": F.least("x.to", "y.to")}).where("`from` < `to`")
    found.append(_seen(pair.where("x.effective_at = y.effective_at and x.event_id < y.event_id"), "state_ambiguous", stop=F.col("to")))
    revived = pair.where(F.col("x.status").isin(*TERMINAL) & ~F.col("y.status").isin(*TERMINAL) & (F.col("x.effective_at") < F.col("y.effective_at")))
    found.append(_seen(revived, "security_reactivated", stop=F.col("to")))

    # bars
    found.append(_seen(said.where(~truth(F.col("feed") == FEED)), "feed_not_consolidated"))
    # of a security: when it is first seen, and the revisions that share a time
    per = b.groupBy("security_id", "session", "available_at").agg(F.min("from").alias("from"), F.count("*").alias("__n"), F.collect_list("from").alias("__froms"))
    twice = F.when(F.col("__n") > 1, F.get(F.array_sort("__froms"), F.lit(1)))
    per = cut(per.groupBy("security_id").agg(F.min("from").alias("from"), F.collect_list(twice).alias("__again")))
    found.append(_seen(per.select(F.explode("__again").alias("from")), "bar_revision_ambiguous"))
    born = m.groupBy("security_id").agg(F.min("from").alias("__born"))
    early = per.select("security_id", "from").join(born, "security_id", "left").where("__born is null or `from` < __born")
    found.append(_seen(early, "bar_without_master", stop=F.coalesce("__born", n)))
    dated = said.join(calendar.select("session", "close_at"), "session", "left")
    rules = {
        "bar_off_calendar": F.col("close_at").isNull(),
        "bar_not_at_close": F.col("close_at").isNotNull() & (F.col("effective_at") != F.col("close_at")),
        "bar_before_close": F.col("close_at").isNotNull() & (F.col("available_at") < F.col("effective_at")),
    }
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    found.append(dated.select(F.explode(broken).alias("rule"), F.col("from").alias("start"), F.lit(None).cast("int").alias("stop"), "__rows"))

    spans = found[0]
    for f in found[1:]:
        spans = spans.unionByName(f)
    # rows by interval first: as many as pairs of places, however many rows are broken
    spans = spans.groupBy("rule", "start", F.coalesce("stop", n).alias("stop")).agg(F.sum("__rows").alias("rows")).where("start < stop")
    steps = spans.select("rule", F.explode(F.array(F.struct(F.col("start").alias("place"), F.col("rows").alias("step")), F.struct(F.col("stop").alias("place"), (-F.col("rows")).alias("step")))).alias("s")).select("rule", "s.*").groupBy("rule", "place").agg(F.sum("step").alias("step"))
    d = line.decisions
    grid = spans.select("rule").distinct().select("rule", F.explode(F.sequence(F.lit(0), n - 1)).alias("place"), F.lit(0).cast("long").alias("step"))
    upto = Window.partitionBy("rule").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # a row a decision
    per = grid.unionByName(steps).groupBy("rule", "place").agg(F.sum("step").alias("step")).withColumn("rows", F.sum("step").over(upto)).where("rows > 0").where(F.col("place") < n)
    held = per.join(d.side("place", "decision"), "place").select("decision", "rule", "rows")

    # the state of the whole: manifest, calendar
    made = d.df.select("decision", "decision_at", "latest_idx")
    declared = made.withColumn("__one", F.lit(1)).join(manifest.withColumn("__one", F.lit(1)), "__one")  # one row
    wrong = F.array_compact(F.array(*(F.when(~truth(ok), F.lit(f"manifest_{name}")) for name, ok in manifest_rules(F.col("decision_at")).items())))
    whole = {
        "calendar_ends_before_decision": F.col("__open") <= 0,
        "too_few_completed_sessions": F.col("latest_idx") + 1 < max(policy.min_observations, policy.liquidity_sessions),
    }
    ends = line.closes.count
    sized = declared.withColumn("__open", F.lit(ends) - (F.col("latest_idx") + 1))
    short = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in whole.items())))
    return held.unionByName(sized.select("decision", F.explode(F.concat(wrong, short)).alias("rule"), F.lit(1).cast("long").alias("rows")))


def universe_status(audit: DataFrame, gates: DataFrame, decisions: DataFrame, policy: UniversePolicy) -> DataFrame:
    """(decision, status, gates, audited, eligible, members): READY, or DATA_GATE with the broken rules and no members.

    Two live securities with one ticker, and fewer eligible names than ``min_members``, are gates too.
    """
    live = audit.where(F.col("status").isin("ACTIVE", "SUSPENDED")).groupBy("decision", "ticker").agg(F.count("*").alias("n")).where("n > 1")
    unclear = live.groupBy("decision").agg(F.lit("ticker_ambiguous").alias("rule"))
    counts = audit.groupBy("decision").agg(F.count("*").alias("audited"), F.sum(F.col("eligible").cast("int")).alias("eligible"))
    counts = decisions.select("decision").join(counts, "decision", "left").fillna(0, ["audited", "eligible"])
    few = counts.where(F.col("eligible") < policy.min_members).select("decision", F.lit("too_few_members").alias("rule"))
    rules = gates.select("decision", "rule").unionByName(unclear).unionByName(few).groupBy("decision").agg(F.array_sort(F.collect_set("rule")).alias("gates"))
    out = counts.join(rules, "decision", "left").withColumn("gates", F.coalesce("gates", F.array().cast("array<string>")))
    ready = F.size("gates") == 0
    return out.select("decision", F.when(ready, "READY").otherwise("DATA_GATE").alias("status"), "gates", "audited", "eligible", F.when(ready, F.least("eligible", F.lit(policy.target_size))).otherwise(0).alias("members"))


def members(audit: DataFrame, status: DataFrame, policy: UniversePolicy) -> DataFrame:
    """(decision, security_id, position, size) of the universes of decisions that are READY."""
    ready = status.where("status = 'READY'").select("decision")
    return top_of_each(audit, policy.target_size, policy.min_members).join(ready, "decision", "left_semi")


def _audit(a: DataFrame, policy: UniversePolicy) -> DataFrame:
    a = a.fillna(
        {"coverage": 0.0, "valid_observations": 0, "is_stale": False, "__latest_ok": False}
    )
    reasons = {
        "inactive_or_suspended": F.col("status") != "ACTIVE",
        "not_common_stock": F.col("security_type") != "COMMON_STOCK",
        "not_us_listed_stock": (F.col("listing_country") != "US") | ~F.col("exchange").isin(*US_EXCHANGES),
        "missing_stale_or_invalid_latest_bar": ~F.col("__latest_ok"),
        "stale": F.col("is_stale"),
        "raw_close_below_floor": ~truth(F.col("latest_close") >= policy.min_close),
        "sip_liquidity_below_floor": ~truth(F.col("median_dollar_volume") >= policy.min_dollar_volume),
        "insufficient_valid_observations": F.col("valid_observations") < policy.min_observations,
        "session_coverage_below_floor": F.col("coverage") < policy.min_coverage,
    }
    return with_reasons(a, reasons).drop("__latest_ok")


def top_of_each(audit: DataFrame, size: int, minimum: int, amount: str = "median_dollar_volume", name: str = "security_id") -> DataFrame:
    """(decision, name, position, size) of the ``size`` most liquid eligible names of each decision; none where fewer than ``minimum`` are eligible."""
    w = Window.partitionBy("decision")
    best = audit.where("eligible").withColumns({"__rank": F.row_number().over(w.orderBy(snap(amount, 6).desc(), name)), "__n": F.count("*").over(w)})
    best = best.where((F.col("__rank") <= size) & (F.col("__n") >= minimum)).select("decision", name)
    return best.withColumns({"position": F.row_number().over(w.orderBy(name)) - 1, "size": F.count("*").over(w)})


def with_reasons(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    df = df.withColumn("exclusion_reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()])))
    return df.withColumn("eligible", F.size("exclusion_reasons") == 0)


def select_top(audit: DataFrame, size: int, minimum: int, amount: str = "median_dollar_volume", name: str = "security_id") -> DataFrame:
    """Mark the ``size`` most liquid eligible names; none if fewer than
    ``minimum`` are eligible."""
    best = audit.where("eligible").orderBy(snap(amount, 6).desc(), name).limit(size).select(name)
    enough = best.agg(F.count("*") >= minimum).scalar()
    # at most ``size`` names
    marked = audit.join(F.broadcast(best.withColumn("__top", F.lit(True))), name, "left")
    return marked.withColumn("selected", truth(F.col("__top") & enough)).drop("__top")


def screen(df: DataFrame, latest_idx: int, recent: int, policy: UniversePolicy) -> DataFrame:
    """Snapshot eligibility from flagged bars (``usable``), no bitemporal part."""
    df = df.withColumn("__same", unchanged())
    stale = truth(F.sum("__same").over(ts(policy.stale_sessions)) == policy.stale_sessions)
    df = df.withColumn("valid", F.col("usable") & ~stale)
    late = F.col("session_idx") > latest_idx - recent
    last = F.col("session_idx") == latest_idx
    g = df.groupBy("security_id").agg(
        F.sum(F.col("valid").cast("int")).alias("valid_observations"),
        (F.sum((late & F.col("valid")).cast("int")) / F.lit(float(recent))).alias("coverage"),
        F.percentile(F.when(late & F.col("valid"), F.col("close") * F.col("volume")), F.lit(0.5)).alias("median_dollar_volume"),
        F.max(F.when(last, F.col("close"))).alias("latest_close"),
        F.coalesce(F.max(F.when(last, F.col("valid"))), F.lit(False)).alias("__ok"),
    )
    reasons = {
        "price_below_floor_or_missing": ~truth(F.col("latest_close") >= policy.min_close),
        "missing_zero_volume_stale_or_invalid_latest": ~F.col("__ok"),
        "history_too_short": F.col("valid_observations") < policy.min_observations,
        "coverage_below_floor": F.col("coverage") < policy.min_coverage,
        "liquidity_below_floor": ~truth(F.col("median_dollar_volume") >= policy.min_dollar_volume),
    }
    return with_reasons(g, reasons).drop("__ok")


def dynamic_eligibility(df: DataFrame, history: int, min_close: float, adv: tuple[int, int], most: int, wide: bool = False) -> DataFrame:
    """Eligibility that changes by session: history, price, liquidity and its rank."""
    from pyspark.sql import Window

    from panelweft.functions.frames import median, xs_min_rank

    w = Window.partitionBy("security_id").orderBy("session_idx").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns(
        {
            "history": F.count("ret").over(w),
            "adv": snap(roll(median, F.col("close") * F.col("volume"), ts(adv[0]), adv[1]), 6),
        }
    )
    df = xs_min_rank(df, "adv", "adv_rank", wide=wide)
    ok = (F.col("history") >= history) & (F.col("close") >= min_close) & (F.col("adv_rank") <= most)
    return df.withColumn("eligible", truth(ok))
