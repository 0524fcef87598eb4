"""Universes of many decisions against a loop over decisions that looks at what each can see."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from panelweft.operators import universe as un

T0 = dt.datetime(2020, 1, 6)
SESSIONS = 40
POLICY = un.UniversePolicy(target_size=4, min_members=2, liquidity_sessions=6, min_observations=8, min_coverage=0.5, min_close=5.0, min_dollar_volume=100.0, stale_sessions=2)
MASTER = "security_id string, event_id long, effective_at timestamp, available_at timestamp, ticker string, security_type string, listing_country string, exchange string, status string, publication_id string"
BARS = "security_id string, session date, session_idx int, effective_at timestamp, available_at timestamp, close double, volume double, is_stale boolean, is_suspended boolean, publication_id string, feed string"
PUBLICATIONS = "publication_id string, published_at timestamp, verified boolean, evidence_type string"
MANIFEST = "source string, calendar_source string, security_id_kind string, availability_basis string, scope string, master_kind string, includes_terminated boolean, valid_from date"


def day(i, hours=0.0):
    return T0 + dt.timedelta(days=i, hours=hours)


def close_at(i):
    return day(i, 21)


def world(seed, broken=False):
    r = random.Random(seed)
    master, bars, pubs = [], [], {}
    for k in range(12):
        sid, n = f"x{k}", 0
        changes = [(-5.0, "ACTIVE")] + sorted((r.uniform(0, SESSIONS), r.choice(["SUSPENDED", "ACTIVE"])) for _ in range(r.randrange(4)))
        if k == 3:
            changes.append((30.0, "DELISTED"))
        if broken and k == 3:
            changes.append((35.0, "ACTIVE"))
        for at, status in changes:
            eff = day(0) + dt.timedelta(days=at)
            for v in range(1 + (r.random() < 0.4)):
                av = eff + dt.timedelta(hours=r.uniform(-30, 60) + 90 * v)
                state = status if v == 0 or r.random() < 0.5 else "ACTIVE"
                pid = f"m{k}/{n}/{v}"
                master.append([sid, 100 * k + n, eff, av, "same" if broken and k in (5, 6) and at > 20 else sid, "ETF" if k == 9 else "COMMON_STOCK", "US", "XLON" if k == 10 else "XNYS", state, pid])
                pubs[pid] = [pid, av, True, "source_publication"]
            n += 1
        price, flat = r.uniform(4.5, 30), r.random() < 0.3
        for i in range(SESSIONS):
            if r.random() < 0.1:
                continue
            if not (flat and r.random() < 0.5):
                price = round(price * r.choice([0.97, 1.0, 1.02]), 3)
            for v in range(1 + (r.random() < 0.2) + (r.random() < 0.1)):
                av = close_at(i) + dt.timedelta(hours=r.uniform(0, 3) + 50 * v * r.random())
                pid = f"b{i}/{k}/{v}"
                bars.append([sid, day(i).date(), i, close_at(i), av, price * (1 + 0.01 * v) if r.random() < 0.98 else float("nan"), float(r.choice([0, 10, 20, 50])) if r.random() < 0.1 else 50.0, r.random() < 0.03, r.random() < 0.03, pid, "SIP"])
                pubs[pid] = [pid, av, True, "contemporaneous_capture"]
    bars.append(["x1", day(3).date(), 3, close_at(3), None, 9.0, 9.0, False, False, "never", "SIP"])  # never available
    if broken:
        pubs.pop(next(b[9] for b in bars if b[2] == 20))
        pubs[next(b[9] for b in bars if b[2] == 22)][2] = False
        late = pubs[next(b[9] for b in bars if b[2] == 24)]
        late[1] += dt.timedelta(hours=1)
        pubs[next(b[9] for b in bars if b[2] == 25)][3] = "hearsay"
        bars[next(i for i, b in enumerate(bars) if b[2] == 26)][10] = "IEX"
        one = next(b for b in bars if b[2] == 27)
        bars.append([*one[:5], 1.0, *one[6:]])
        wrong = next(b for b in bars if b[2] == 28)
        wrong[3] = wrong[3] - dt.timedelta(hours=1)
        odd = next(b for b in bars if b[2] == 29)
        bars.append(["ghost", *odd[1:]])
        early = next(b for b in bars if b[2] == 15 and b[4] is not None)
        early[4] = close_at(15) - dt.timedelta(minutes=5)
        pubs[early[9]][1] = early[4]
        master.append(["x2", 777, day(33), day(33), "x2", "COMMON_STOCK", "US", "XNYS", "LOST", "m0/0/0"])
        master.append(["x2", 777, day(33), day(36), "x2", "COMMON_STOCK", "US", "XNYS", "ACTIVE", "m0/0/0"])
        master.append(["x7", 700, day(1), day(34), "x7", "COMMON_STOCK", "US", "XNYS", "ACTIVE", "m0/0/0"])
    times = sorted([day(-30), day(2), day(2, 3), day(9, 21), *(day(i, 21.5 + (i % 5)) for i in range(4, SESSIONS, 3)), day(37, 21), day(SESSIONS + 1)])
    return master, bars, list(pubs.values()), times


def tables(spark, seed, broken=False):
    master, bars, pubs, times = world(seed, broken)
    cal = [(i, day(i).date(), close_at(i)) for i in range(SESSIONS)]
    return (
        spark.createDataFrame(master, MASTER).repartition(3), spark.createDataFrame(bars, BARS).repartition(3), spark.createDataFrame(pubs, PUBLICATIONS),
        spark.createDataFrame(cal, "session_idx int, session date, close_at timestamp"), spark.createDataFrame(list(enumerate(times, 500)), "decision int, decision_at timestamp"),
    )


def visible(rows, eff, av, at):
    return [r for r in rows if r[av] is not None and r[av] <= at and r[eff] <= at]


def audit_at(master, bars, at):
    """security -> (status, latest close, median, coverage, observations, stale, reasons) at one decision."""
    events = {}
    for r in sorted(visible(master, 2, 3, at), key=lambda r: (r[3], r[8])):
        events[r[1]] = r
    seen = {}
    for b in sorted(visible(bars, 3, 4, at), key=lambda b: (b[4], -1 if b[5] != b[5] else b[5])):
        seen[b[0], b[2]] = b
    latest = max((i for i in range(SESSIONS) if close_at(i) <= at), default=-1)
    out = {}
    for sid in {r[0] for r in events.values()}:
        history = sorted((r for r in events.values() if r[0] == sid), key=lambda r: (r[2], r[1]))
        state, valid, stale, dv = history[-1], {}, {}, {}
        for i in range(latest + 1):
            b = seen.get((sid, i))
            if not b:
                continue
            run = [seen.get((sid, i - k)) for k in range(POLICY.stale_sessions + 1)]
            stale[i] = b[7] or all(run) and len({x[5] for x in run}) == 1 and run[0][5] == run[0][5]
            then = [r[8] for r in history if r[2] <= close_at(i)]
            valid[i] = b[5] > 0 and b[6] > 0 and not b[8] and not stale[i] and bool(then) and then[-1] == "ACTIVE"
            dv[i] = b[5] * b[6]
        recent = [i for i in valid if valid[i] and i > latest - POLICY.liquidity_sessions]
        last = seen.get((sid, latest))
        price = last[5] if last and last[5] == last[5] else None
        median = statistics.median(dv[i] for i in recent) if recent else None
        n, coverage = sum(valid.values()), len(recent) / POLICY.liquidity_sessions
        why = [name for name, bad in [
            ("inactive_or_suspended", state[8] != "ACTIVE"), ("not_common_stock", state[5] != "COMMON_STOCK"), ("not_us_listed_stock", state[7] == "XLON"), ("missing_stale_or_invalid_latest_bar", not valid.get(latest)), ("stale", stale.get(latest, False)),
            ("raw_close_below_floor", price is None or price < 5), ("sip_liquidity_below_floor", median is None or median < 100), ("insufficient_valid_observations", n < 8), ("session_coverage_below_floor", coverage < 0.5),
        ] if bad]
        out[sid] = (state[8], price, median, coverage, n, stale.get(latest, False), why)
    return out, events, latest


@pytest.mark.parametrize("seed,broken", [(1, False), (2, False), (3, True)])
def test_audit_of_every_decision(spark, seed, broken):
    master, bars, _, times = world(seed, broken)
    if broken:  # which of two versions of one time counts is a matter of the gate
        bars = [b for b in bars if b[0] != "ghost"]
    m, b, _, cal, dec = tables(spark, seed, broken)
    got = {}
    for r in un.universes(m, b.where("security_id <> 'ghost'"), cal, dec, POLICY).collect():
        got.setdefault(r["decision"], {})[r["security_id"]] = (r["status"], r["latest_close"], r["median_dollar_volume"], r["coverage"], r["valid_observations"], r["is_stale"], r["exclusion_reasons"])
    eligible = 0
    for d, at in enumerate(times, 500):
        want, _, _ = audit_at(master, bars, at)
        mine = got.get(d, {})
        assert set(mine) == set(want), at
        for sid, x in want.items():
            y = mine[sid]
            assert x[0] == y[0] and x[4:] == y[4:], (at, sid, x, y)
            assert all(p == q if p is None or q is None else abs(p - q) < 1e-9 for p, q in zip(x[1:4], y[1:4])), (at, sid, x, y)
            eligible += not x[-1]
    assert eligible > 10
    one = un.build_universe(m, b, cal, F.lit(times[-4]).cast("timestamp"), POLICY)
    assert one.count() == len(audit_at(master, bars, times[-4])[0])


def rules_at(master, bars, pubs, at):
    out = set()
    known = {p[0]: p for p in pubs}
    m, b = visible(master, 2, 3, at), visible(bars, 3, 4, at)
    for name, rows, pid, av in (("master", m, 9, 3), ("bar", b, 9, 4)):
        for r in rows:
            p = known.get(r[pid])
            verdict = "missing" if p is None else "of_unknown_type" if p[3] == "hearsay" else "unverified" if not p[2] else "late" if r[av] < p[1] else None
            out |= {f"{name}_evidence_{verdict}"} if verdict else set()
    twice = lambda keys: len(keys) > len(set(keys))
    latest = {}
    for r in sorted(m, key=lambda r: (r[3], r[8])):
        latest[r[1]] = r
    checks = {
        "master_revision_ambiguous": twice([(r[1], r[3]) for r in m]), "event_identity_changed": twice([e for e, _, _ in {(r[1], r[0], r[2]) for r in m}]), "status_unknown": any(r[8] == "LOST" for r in latest.values()),
        "state_ambiguous": twice([(r[0], r[2]) for r in latest.values()]), "feed_not_consolidated": any(x[10] != "SIP" for x in b), "bar_revision_ambiguous": twice([(x[0], x[1], x[4]) for x in b]),
        "security_reactivated": any(x[8] == "DELISTED" and y[8] != "DELISTED" and x[0] == y[0] and x[2] < y[2] for x in latest.values() for y in latest.values()), "bar_without_master": bool({x[0] for x in b} - {r[0] for r in m}),
        "bar_not_at_close": any(x[3] != close_at(x[2]) for x in b), "bar_before_close": any(x[4] < x[3] for x in b),
    }
    sessions = [i for i in range(SESSIONS) if close_at(i) <= at]
    checks |= {"calendar_ends_before_decision": len(sessions) == SESSIONS, "too_few_completed_sessions": len(sessions) < 8}
    return out | {k for k, v in checks.items() if v}


def test_gates(spark):
    """Every rule closes the gate from the decision on that first sees it, and opens it again where the state is replaced."""
    master, bars, pubs, times = world(3, True)
    m, b, p, cal, dec = tables(spark, 3, True)
    manifest = spark.createDataFrame([("a", "b", "permanent", "evidenced_publication_or_capture", "historical_verified", "archived_snapshots", True, None)], MANIFEST)
    gates = un.gate_rules(m, b, p, cal, dec, manifest, POLICY).cache()
    got = {}
    for r in gates.collect():
        got.setdefault(r["decision"], set()).add(r["rule"])
    seen = set()
    for d, at in enumerate(times, 500):
        want = rules_at(master, bars, pubs, at)
        assert got.get(d, set()) == want, at
        seen |= want
    assert len(seen) > 12
    audit = un.universes(m, b, cal, dec, POLICY)
    status = un.universe_status(audit, gates, dec, POLICY)
    by = {r["decision"]: r for r in status.collect()}
    for d, at in enumerate(times, 500):
        states = audit_at(master, bars, at)[0]
        ready = not got.get(d) and sum(not x[-1] for x in states.values()) >= 2
        tickers = [r[4] for r in {r[0]: r for r in sorted(audit_at(master, bars, at)[1].values(), key=lambda r: (r[2], r[1]))}.values() if r[8] in ("ACTIVE", "SUSPENDED")]
        ready = ready and len(tickers) == len(set(tickers))
        assert (by[d]["status"] == "READY") == ready and (by[d]["members"] > 0) == ready, at
    # a clean world is ready, and its members are the most liquid eligible names
    m, b, p, cal, dec = tables(spark, 1)
    audit, bad = un.universes(m, b, cal, dec, POLICY), manifest.withColumn("includes_terminated", F.lit(False))
    status = un.universe_status(audit, un.gate_rules(m, b, p, cal, dec, manifest, POLICY), dec, POLICY)
    assert status.where("status = 'READY'").count() > 5
    assert un.members(audit, status, POLICY).groupBy("decision").count().where("count > 4 or count < 2").count() == 0
    closed = un.universe_status(audit, un.gate_rules(m, b, p, cal, dec, bad, POLICY), dec, POLICY)
    assert {r["status"] for r in closed.collect()} == {"DATA_GATE"} and un.members(audit, closed, POLICY).count() == 0
