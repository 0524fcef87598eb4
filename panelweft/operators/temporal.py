"""As-of, interval and bitemporal joins.

No join here compares all rows of a key with each other. Revisions that share a
key and a date are reduced first (map-side combined), so what a window sees per
key is bounded by the calendar; finer event times are split into time buckets
whose last state is carried forward on its own small table.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweft.functions.dates import BROADCAST_ROWS
from panelweft.session import cut


class Bounded(NamedTuple):
    """A small table with a measured bound on its rows."""

    df: DataFrame
    rows: int

    def side(self, *cols) -> DataFrame:
        """Columns for a join; broadcast only while the bound allows it."""
        picked = self.df.select(*cols)
        return F.broadcast(picked) if self.rows <= BROADCAST_ROWS else picked


def visible_as_of(revisions: DataFrame, decision: Column, event: str = "event_id", ties: Sequence[str] = ()) -> DataFrame:
    """Rows known and effective at ``decision``, reduced to the latest revision
    of each event. Future versions are hidden before anything else."""
    seen = revisions.where((F.col("available_at") <= decision) & (F.col("effective_at") <= decision))
    payload = F.struct(*[c for c in revisions.columns if c != event])
    order = F.struct("available_at", *ties)
    return seen.groupBy(event).agg(F.max_by(payload, order).alias("__p")).select(event, "__p.*")


def current_state(events: DataFrame, key: str = "security_id", ties: Sequence[str] = ()) -> DataFrame:
    """Latest event per key by effective time."""
    payload = F.struct(*[c for c in events.columns if c != key])
    order = F.struct("effective_at", *ties)
    return events.groupBy(key).agg(F.max_by(payload, order).alias("__p")).select(key, "__p.*")


class DayMap(NamedTuple):
    """Every day of a calendar's span with the index of the first session on or after it; the day after the last session has the next index."""

    days: Bounded
    first: date
    last: date

    def index(self, day: Column) -> Column:
        """The mapped day that stands for ``day``: earlier days act from the first session on, later ones end after the last."""
        return F.least(F.greatest(day, F.lit(self.first)), F.date_add(F.lit(self.last), 1))


def day_map(calendar: DataFrame, first: date, last: date) -> DayMap:
    """Turns dates into session positions by an equality join. ``first`` and ``last`` are the calendar's measured ends."""
    w = Window.orderBy("session")  # calendar only
    start = F.coalesce(F.date_add(F.lag("session").over(w), 1), F.col("session"))
    days = calendar.withColumn("__start", start).select(
        F.explode(F.sequence("__start", "session")).alias("day"), F.col("session_idx").alias("from_idx")
    )
    beyond = calendar.agg(F.date_add(F.max("session"), 1).alias("day"), (F.max("session_idx") + 1).alias("from_idx"))
    return DayMap(Bounded(days.unionByName(beyond), (last - first).days + 2), first, last)


def session_spans(df: DataFrame, days: DayMap, start: str, stop: str) -> DataFrame:
    """Adds ``__s`` and ``__e``: the sessions of ``[start, stop)``, wherever the interval begins and ends, are those from ``__s``
    up to the one before ``__e``. Rows without a session or a date are dropped."""
    s = days.days.side(F.col("day").alias("__from"), F.col("from_idx").alias("__s"))
    e = days.days.side(F.col("day").alias("__to"), F.col("from_idx").alias("__e"))
    df = df.where(F.col(start).isNotNull() & F.col(stop).isNotNull())
    df = df.withColumns({"__from": days.index(F.col(start)), "__to": days.index(F.col(stop))}).join(s, "__from").join(e, "__to")
    return df.where(F.col("__s") < F.col("__e")).drop("__from", "__to")


def expand_intervals(df: DataFrame, days: DayMap, start: str, stop: str) -> DataFrame:
    """One row per session of ``[start, stop)``, wherever the interval begins and ends; without a date there are none."""
    df = session_spans(df, days, start, stop)
    return df.withColumn("session_idx", F.explode(F.sequence(F.col("__s"), F.col("__e") - 1))).drop("__s", "__e")


def _carried(events: DataFrame, key: str, at: str, max_age_days: int | None, horizon: Column, ties: Sequence[str]) -> DataFrame:
    """The last event of each key and day with ``__until``, the day from which it no longer counts."""
    payload = F.struct(*[c for c in events.columns if c not in (key, at)])
    one = events.groupBy(key, at).agg(F.max_by(payload, F.struct(*ties) if ties else F.lit(1)).alias("__p"))
    nxt = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    until = F.coalesce(nxt, horizon)
    if max_age_days is not None:
        until = F.least(until, F.date_add(F.col(at), max_age_days + 1))
    until = F.least(until, horizon)
    return one.withColumn("__until", until).where(F.col(at) < F.col("__until"))


def asof_events(
    events: DataFrame, key: str, at: str, days: DayMap, max_age_days: int | None,
    horizon: Column, ties: Sequence[str] = (),
) -> DataFrame:
    """Carry each key's latest event onto sessions while it is no older than
    ``max_age_days``. Among events of one day the last in tie order counts.

    ``horizon`` is the day after the last session: an open event ends there.
    """
    one = _carried(events, key, at, max_age_days, horizon, ties)
    return expand_intervals(one, days, at, "__until").select(key, at, "session_idx", "__p.*")


def asof_spans(
    events: DataFrame, key: str, at: str, days: DayMap, max_age_days: int | None,
    horizon: Column, ties: Sequence[str] = (),
) -> DataFrame:
    """:func:`asof_events` with a row per event that any session sees: it counts from session ``__s`` up to the one before ``__e``."""
    one = _carried(events, key, at, max_age_days, horizon, ties)
    return session_spans(one, days, at, "__until").select(key, at, "__s", "__e", "__p.*")


#: Events of a key that one task searches, and the most parts that a key's events are cut into.
BUCKET_ROWS, TILES = 1_000_000, 1024


def split_points(events: DataFrame, keys: Sequence[str], time: str, rows: int) -> DataFrame | None:
    """(keys, __splits): times that cut the events of each key with more than ``rows`` of them into parts of about ``rows``; None if there is no such key.

    A sketch of each such key gives the times, merged before it is shuffled; they only decide who searches, so they needn't be exact.
    """
    crowded = cut(events.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > rows))
    if crowded.isEmpty():
        return None
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    g = events.join(crowded, keys).groupBy(*keys).agg(F.first("__n").alias("__n"), F.percentile_approx(micros, [i / TILES for i in range(1, TILES)], 20 * TILES).alias("__q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(float(TILES) * rows) / F.col("__n")).cast("int"))
    return cut(g.withColumn("__step", step).select(*keys, F.array_distinct(F.filter("__q", lambda x, i: (i + 1) % F.col("__step") == 0)).alias("__splits")))


def attach_asof(
    events: DataFrame, definitions: DataFrame, key: str | Sequence[str], time: str, def_time: str,
    values: Sequence[str], bucket: str | None = "hour", ties: Sequence[str] = (), rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Attach to each event the latest definition at or before it.

    Events of keys without any definition are dropped; events before the first
    keep NULL. The search runs inside (key, time bucket); the state at the end of
    each bucket is carried over buckets on one row per (key, bucket), so a key
    holding a large share of all rows is spread over its buckets. Buckets are
    ``bucket`` long, or, if it is None, as long as a key has ``rows`` events, however
    closely they follow each other.
    """
    keys = [key] if isinstance(key, str) else list(key)
    known = definitions.select(*keys).distinct()
    ev = events.join(known, keys, "left_semi")
    if bucket is None:
        splits = split_points(ev, keys, time, rows)

        def place(df: DataFrame) -> DataFrame:
            if splits is None:
                return df.withColumn("__bucket", F.lit(0))
            at = F.unix_micros(F.col("__t").cast("timestamp"))
            return df.join(splits, keys, "left").withColumn("__bucket", F.when(F.col("__splits").isNull(), 0).otherwise(F.size(F.filter("__splits", lambda x: x < at)))).drop("__splits")
    else:

        def place(df: DataFrame) -> DataFrame:
            return df.withColumn("__bucket", F.date_trunc(bucket, F.col("__t")))

    val = F.struct(F.col(def_time).alias("definition_time"), *values)
    d = definitions.select(
        *keys, F.col(def_time).alias("__t"), val.alias("__val"),
        F.struct(F.col(def_time), *ties).alias("__ord"), F.lit(0).alias("__is_event"),
    )
    d = place(d)
    row = F.struct(*[c for c in events.columns if c not in keys])
    e = place(ev.select(*keys, F.col(time).alias("__t"), row.alias("__row"), F.lit(1).alias("__is_event")))
    closing = d.groupBy(*keys, "__bucket").agg(F.max_by("__val", "__ord").alias("__close"))
    touched = e.select(*keys, "__bucket").distinct()
    states = touched.join(closing, [*keys, "__bucket"], "full")
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = states.withColumn("__carry", F.last("__close", True).over(before)).select(*keys, "__bucket", "__carry")
    both = e.unionByName(d, allowMissingColumns=True)
    inside = (
        Window.partitionBy(*keys, "__bucket")
        .orderBy("__t", "__is_event", "__ord")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    both = both.withColumn("__in", F.last("__val", True).over(inside)).where("__is_event = 1")
    res = both.join(carried, [*keys, "__bucket"], "left").withColumn("__v", F.coalesce("__in", "__carry"))
    return res.select(*keys, "__row.*", "__v.definition_time", *[F.col(f"__v.{v}") for v in values])


def scd_join(left: DataFrame, scd: DataFrame, key: str, day: str, inclusive: bool = True) -> DataFrame:
    """Rows valid on ``day``: valid_from <= day <= valid_to (open if NULL).

    The key hashes the join; the range is a residual filter over the few versions
    a key has.
    """
    upper = F.col("valid_to") >= F.col(day) if inclusive else F.col("valid_to") > F.col(day)
    cond = (F.col("valid_from") <= F.col(day)) & (F.col("valid_to").isNull() | upper)
    return left.join(scd, key).where(cond)


def plain_name(name: Column) -> Column:
    """An index name without case and blanks."""
    return F.replace(F.upper(name), F.lit(" "), F.lit(""))


def membership_daily(
    membership: DataFrame, scd: DataFrame, days: DayMap, calendar: Bounded, horizon: Column, names: Sequence[str]
) -> DataFrame:
    """Members per session with the ticker valid that day, one row per member.

    Only rows whose index is one of ``names``, up to case and blanks, count.
    ``membership``: index_name, cik, effective_date, removal_date (exclusive). ``scd``: cik,
    entity_id, symbol, sector, valid_from, valid_to (inclusive), is_primary_ticker.
    """
    wanted = [n.upper().replace(" ", "") for n in names]
    m = membership.where(plain_name(F.col("index_name")).isin(wanted))
    m = m.withColumn("__stop", F.least(F.coalesce("removal_date", horizon), horizon))
    m = m.where(F.col("effective_date") < F.col("__stop"))
    per_session = expand_intervals(m, days, "effective_date", "__stop").select("cik", "session_idx").distinct()
    per_session = per_session.join(calendar.side("session_idx", "session"), "session_idx")
    primary = scd.where(F.coalesce("is_primary_ticker", F.lit(False)))
    got = scd_join(per_session, primary, "cik", "session")
    pick = F.min_by(F.struct("entity_id", "symbol", "sector"), F.struct("valid_from", "symbol"))
    return got.groupBy("session", "session_idx", "cik").agg(pick.alias("__p")).select(
        "session", "session_idx", "cik", "__p.*"
    )


def security_map(security: DataFrame, references: DataFrame) -> DataFrame:
    """Securities with the sector of their reference; rows lacking keys dropped."""
    ref = references.where(F.col("security_id").isNotNull()).groupBy(F.col("security_id").alias("id")).agg(
        F.min_by(F.struct("cik", "sector"), F.struct("cik", "sector")).alias("__r")
    )
    m = security.join(ref, "id", "left").select(*security.columns, "__r.*")
    return m.dropna(subset=["entity_id", "symbol", "cik", "valid_from"])


def key_violations(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that a many-to-one join must not repeat."""
    return right.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def sole(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table, which fails when it is read if a key comes twice."""
    rest = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(F.count("*").alias("__n"), F.any_value(F.struct(*rest) if rest else F.lit(1)).alias("__p"))
    message = F.concat(F.lit("the right side of a many-to-one join repeats "), F.to_json(F.struct(*keys)))
    fine = F.assert_true(F.col("__n") == 1, message).isNull()
    return once.where(fine).select(*keys, *([f"__p.{c}" for c in rest]))


def validated_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to unique keys that marks unmatched rows; repeated right keys fail the query."""
    marked = sole(right, list(keys)).withColumn("__hit", F.lit(True))
    return left.join(marked, list(keys), "left").withColumn("matched", F.coalesce("__hit", F.lit(False))).drop("__hit")


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left_only")).unionByName(
        b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right_only"))
    )


def subset_violations(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child keys absent from the parent; empty means the subset holds."""
    return child.select(*keys).distinct().join(parent.select(*keys), list(keys), "left_anti")


def prior_vintage_growth(events: DataFrame, entity: str, known: str, measures: dict[str, tuple[str, float]], tie: str) -> DataFrame:
    """Growth against the greatest earlier period known by then, in its latest
    vintage. ``measures``: output -> (column, sign).

    Per entity only the distinct periods with their first known date travel (a
    calendar-bounded array); the prior vintage itself comes from an as-of join on
    (entity, period).
    """
    events = cut(events)  # read four times below
    periods = events.groupBy(entity, "period_end").agg(F.min(known).alias("first_known"))
    lists = periods.groupBy(entity).agg(F.collect_list(F.struct("period_end", "first_known")).alias("__periods"))
    earlier = F.filter(
        "__periods",
        lambda p: (p["period_end"] < F.col("period_end")) & (p["first_known"] <= F.col(known)),
    )
    ev = events.join(lists, entity).withColumn(
        "prior_period", F.array_max(F.transform(earlier, lambda p: p["period_end"]))
    ).drop("__periods")
    cols = [c for c, _ in measures.values()]
    vintages = events.groupBy(entity, F.col("period_end").alias("prior_period"), F.col(known).alias("__vt")).agg(
        F.max_by(F.struct(*[F.col(c).alias(f"prior_{c}") for c in cols]), F.col(tie)).alias("__p")
    ).select(entity, "prior_period", F.col("__vt").cast("timestamp").alias("__vt"), "__p.*")
    dated = ev.where("prior_period is not null").withColumn("__et", F.col(known).cast("timestamp"))
    got = attach_asof(
        dated, vintages, [entity, "prior_period"], "__et", "__vt", [f"prior_{c}" for c in cols], "year"
    ).drop("__et", "definition_time")
    rest = ev.where("prior_period is null")
    full = got.unionByName(rest, allowMissingColumns=True)
    growth = {}
    for out, (c, sign) in measures.items():
        g = sign * (F.try_divide(F.col(c), F.when(F.col(f"prior_{c}") > 0, F.col(f"prior_{c}"))) - 1)
        growth[out] = g
    return full.withColumns(growth)


def terminal_reuse(events: DataFrame, terminal: Sequence[str], key: str = "security_id", ties: Sequence[str] = ()) -> DataFrame:
    """Events that revive a key after a terminal status.

    The first terminal position per key is an aggregate; comparing with it needs
    no ordering of a key's whole history.
    """
    order = F.struct("effective_at", *ties)
    first = events.where(F.col("status").isin(*terminal)).groupBy(key).agg(F.min(order).alias("__first"))
    return events.where(~F.col("status").isin(*terminal)).join(first, key).where(order > F.col("__first")).drop("__first")
