"""Literal fixtures and dense reference computations."""

import datetime as dt
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweft.functions.dates import add_business_days
from panelweft.operators import futures as fu
from panelweft.operators import ledger as lg
from panelweft.operators import quality as qa
from panelweft.operators import regimes as rg
from panelweft.operators import reports as rp
from panelweft.operators import research as rs
from panelweft.operators import temporal as tp
from panelweft.operators import universe as un
from panelweft.plans import q_portfolio, q_quality
from panelweft.sources import readers as rd
from panelweft.sources import tables as tb

D = dt.date


def test_business_days(spark):
    days = [D(2024, 3, d) for d in range(1, 15)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for n in (1, 3, 7, -1, -5, -6):
        got = [r[0] for r in df.select(add_business_days(F.col("d"), n)).collect()]
        want = [(pd.Timestamp(d) + pd.offsets.BDay(n)).date() for d in days]
        assert got == want, n


def test_futures_curve(spark):
    """Contracts of two roots with holes in their prices: front, next, carry and held returns against a loop over days."""
    rng = np.random.default_rng(47)
    days = [d.date() for d in pd.bdate_range("2022-09-05", periods=50)]
    kinds = {"Q1": True, "Q2": False, "Q3": None}
    meta, price = [], {}
    for root, cash in kinds.items():
        for k, month in enumerate((9, 10, 11, 12)):
            last = D(2022, month, 22 + k)
            notice = None if cash or (root == "Q3" and k == 1) else last - dt.timedelta(days=3 * k - 2)
            meta.append((root, f"{root}-{month}", last + dt.timedelta(days=1), notice, last, cash))
            for d in days:
                if rng.random() < 0.85:
                    price[d, root, f"{root}-{month}"] = float(np.round(50 + 4 * k + rng.normal(), 2)) * (-1 if rng.random() < 0.03 else 1)
    daily = spark.createDataFrame([(*key, v, 1, 1) for key, v in price.items()], "date date, root string, contract string, settlement double, volume long, open_interest long")
    m = spark.createDataFrame(meta, "root string, contract string, expiry_date date, first_notice_date date, last_trade_date date, cash_settled boolean")
    curve = fu.contract_curve(daily, m, 3)
    got = {(r["root"], r["date"]): r for r in curve.collect()}
    held = {(r["root"], r["date"]): r for r in fu.held_contract_returns(curve, daily).collect()}
    seen = 0
    for root in kinds:
        before = None
        for d in days:
            open_ = []
            for r, contract, expiry, notice, last, cash in meta:
                end = last if cash else min(notice, last) if notice else None
                if r == root and end and d < (pd.Timestamp(end) - 3 * pd.offsets.BDay()).date() and price.get((d, r, contract), 0) > 0:
                    open_.append((expiry, contract))
            if not open_:
                assert (root, d) not in got
                continue
            (e1, front), (e2, nxt) = [*sorted(open_), (None, None)][:2]
            r, h = got[root, d], held[root, d]
            assert (r["front_contract"], r["next_contract"]) == (front, nxt)
            if nxt:
                seen += 1
                assert r["carry_annualized"] == pytest.approx(np.log(price[d, root, front] / price[d, root, nxt]) * 365.25 / (e2 - e1).days)
            was, now = (price.get((day, root, before[1])) if before else None for day in (before[0] if before else d, d))
            assert h["held_contract"] == (before[1] if before else None) and h["roll_trade"] == bool(before and before[1] != front)
            assert h["excess_return"] == (pytest.approx(now / was - 1) if was is not None and now is not None else None)
            before = (d, front)
    assert seen > 40 and any(r["roll_trade"] for r in held.values())


def test_gross_change_classes(spark):
    df = spark.createDataFrame([(c,) for c in (-0.11, -0.10, 0.0, 0.10, 0.11)], "c double")
    got = [r[0] for r in df.select(rg.gross_change_class(F.col("c"))).collect()]
    assert got == ["deleveraging", "normal", "normal", "normal", "expansion"]


def test_revisions_after_the_decision_stay_invisible(spark):
    t = dt.datetime
    rows = [("e1", "s", t(2020, 1, 1), t(2020, 1, 2), "ACTIVE"), ("e1", "s", t(2020, 1, 1), t(2020, 3, 1), "DELISTED"), ("e2", "s", t(2020, 5, 1), t(2020, 1, 3), "SUSPENDED")]
    df = spark.createDataFrame(rows, "event_id string, security_id string, effective_at timestamp, available_at timestamp, status string")
    v = tp.visible_as_of(df, F.lit("2020-02-01").cast("timestamp")).collect()
    assert [(r["event_id"], r["status"]) for r in v] == [("e1", "ACTIVE")]
    later = tp.visible_as_of(df, F.lit("2020-06-01").cast("timestamp"))
    assert tp.terminal_reuse(later, ["DELISTED"]).count() == 1


def test_asof_spreads_a_hot_key(spark):
    rng = np.random.default_rng(2)
    t0 = pd.Timestamp("2024-01-01")
    ev = pd.DataFrame({"k": np.where(rng.random(600) < 0.6, 1, rng.integers(2, 9, 600)), "t": t0 + pd.to_timedelta(rng.integers(0, 10**6, 600), unit="s"), "i": np.arange(600)})
    de = pd.DataFrame({"k": rng.integers(1, 7, 60), "d": t0 + pd.to_timedelta(rng.integers(0, 10**6, 60), unit="s"), "v": np.arange(60)})
    got = tp.attach_asof(spark.createDataFrame(ev), spark.createDataFrame(de), "k", "t", "d", ["v"], "hour", ("v",)).toPandas().sort_values("i")
    want = pd.merge_asof(ev[ev["k"].isin(de["k"])].sort_values("t"), de.sort_values(["d", "v"]), left_on="t", right_on="d", by="k").sort_values("i")
    np.testing.assert_array_equal(got["i"], want["i"])
    np.testing.assert_allclose(got["v"].astype(float), want["v"], equal_nan=True)


def test_membership_removal_is_exclusive(spark):
    cal = spark.createDataFrame([(i, D(2020, 1, 6 + i)) for i in range(5)], "session_idx int, session date")
    days = tp.day_map(cal, D(2020, 1, 6), D(2020, 1, 10))
    mem = spark.createDataFrame([("Large cap", "1", D(1970, 1, 1), D(2020, 1, 8)), ("Other", "1", D(2020, 1, 1), None)], "index_name string, cik string, effective_date date, removal_date date")
    scd = spark.createDataFrame([("1", 1, "AA", "x", D(2019, 1, 1), None, True)], "cik string, entity_id int, symbol string, sector string, valid_from date, valid_to date, is_primary_ticker boolean")
    got = tp.membership_daily(mem, scd, days, tp.Bounded(cal, 5), F.lit("2020-01-11").cast("date"), ["LARGE CAP"])
    assert sorted(r["session"] for r in got.collect()) == [D(2020, 1, 6), D(2020, 1, 7)]


def test_intervals_reach_beyond_the_calendar(spark):
    cal = spark.createDataFrame([(i, D(2020, 1, 6 + 2 * i)) for i in range(3)], "session_idx int, session date")
    days = tp.day_map(cal, D(2020, 1, 6), D(2020, 1, 10))
    rows = [
        ("old", D(1960, 1, 1), D(1961, 1, 1)), ("all", D(1960, 1, 1), D(2090, 1, 1)), ("until", D(1960, 1, 1), D(2020, 1, 8)), ("between", D(2020, 1, 7), D(2020, 1, 8)),
        ("late", D(2020, 1, 9), D(2090, 1, 1)), ("after", D(2020, 1, 11), D(2090, 1, 1)), ("open", None, D(2090, 1, 1)),
    ]
    got = tp.expand_intervals(spark.createDataFrame(rows, "k string, a date, b date"), days, "a", "b").collect()
    found = {k: sorted(r["session_idx"] for r in got if r["k"] == k) for k, _, _ in rows}
    assert found == {"old": [], "all": [0, 1, 2], "until": [0], "between": [], "late": [2], "after": [], "open": []}
    events = spark.createDataFrame([("x", D(1970, 5, 1), "listed"), ("x", D(2020, 1, 8), "gone")], "k string, day date, status string")
    carried = tp.asof_events(events, "k", "day", days, None, F.lit(D(2020, 1, 11)))
    assert sorted((r["session_idx"], r["status"]) for r in carried.collect()) == [(0, "listed"), (1, "gone"), (2, "gone")]


def test_ledger_equals_a_session_loop(spark):
    rng = np.random.default_rng(9)
    names, T, every, nav = 6, 13, 4, 1e6
    ret = rng.normal(0, 0.03, (T, names))
    target = {t: rng.normal(0, 0.1, names) for t in range(0, T, every)}
    vol, adv = rng.uniform(0.01, 0.03, names), rng.uniform(1e6, 1e7, names)
    c = lg.Costs()
    rows = []
    active, cost = np.zeros(names), 0.0
    for t in range(T):
        gross, borrow = active @ ret[t], np.maximum(-active, 0).sum() * c.borrow_annual * 7 / 365
        net = gross - cost - borrow
        if t > 0:
            rows.append((t, gross, cost, borrow, net, np.abs(active).sum()))
        active = active * (1 + ret[t]) / (1 + net)
        cost = 0.0
        if t in target:
            d = np.abs(target[t] - active)
            cost = (d * c.linear + d * c.impact * vol * np.sqrt(d * nav / adv)).sum()
            active = target[t]
    tg = spark.createDataFrame([("e", t, f"n{i}", float(w[i])) for t, w in target.items() for i in range(names)], "experiment string, session_idx int, security_id string, weight double")
    rt = spark.createDataFrame([(f"n{i}", t, float(ret[t, i])) for t in range(T) for i in range(names)], "security_id string, session_idx int, ret double")
    rk = spark.createDataFrame([(f"n{i}", t, float(vol[i]), float(adv[i])) for t in range(T) for i in range(names)], "security_id string, session_idx int, vol double, adv double")
    led = lg.pnl_ledger(tg, rt, rk, T - 1, 7, nav, c)
    got = led.daily.orderBy("session_idx").toPandas()
    want = pd.DataFrame(rows, columns=["session_idx", "gross_return", "transaction_cost", "borrow_cost", "net_return", "gross"])
    for col in want.columns:
        np.testing.assert_allclose(got[col], want[col], atol=1e-11)
    books = lg.book_attribution(led.daily, led.held).toPandas()
    np.testing.assert_allclose(books["long_net_return"] + books["short_net_return"], books["net_return"], atol=1e-12)


def test_covariance_blocks_repair_and_direction(spark):
    rng = np.random.default_rng(4)
    n, t = 23, 12
    x = rng.normal(size=(t, n))
    x[rng.random((t, n)) < 0.15] = np.nan
    rows = [(f"n{i:02}", s, float(x[s, i])) for s in range(t) for i in range(n) if np.isfinite(x[s, i])]
    r = spark.createDataFrame(rows, "security_id string, session_idx int, ret double")
    own = spark.createDataFrame([(t, f"n{i:02}", i) for i in range(n)], "decision int, security_id string, position int")
    got = rs.window_covariance(r, own, t, tile=5).withColumn("decision", F.lit(1)).toPandas()
    want = pd.DataFrame(x).cov()
    assert len(got) == n * (n + 1) // 2
    np.testing.assert_allclose(got["covariance"], [want.iloc[i, j] for i, j in zip(got["i"], got["j"])], atol=1e-12)
    fixed = rs.repair_covariance(rs.shrink(spark.createDataFrame(got), 0.0)).toPandas()
    m = np.zeros((n, n))
    m[fixed["i"], fixed["j"]] = m[fixed["j"], fixed["i"]] = fixed["covariance"]
    assert np.linalg.eigvalsh(m).min() > 0 and fixed["repaired"].iloc[0] > 0
    alpha, beta = rng.normal(size=n), rng.normal(1, 0.2, n)
    names = spark.createDataFrame([(1, i, float(alpha[i]), 1.0, float(beta[i])) for i in range(n)], "decision int, position int, alpha double, one double, beta double")
    d = rs.mv_direction(spark.createDataFrame(fixed), names, ["one", "beta"]).toPandas().set_index("position")["direction"]
    assert abs(d.sum()) < 1e-6 * np.abs(d).sum() + 1e-9 and abs((d * beta[d.index]).sum()) < 1e-6 * np.abs(d).sum() + 1e-9


def test_universe_at_one_time_is_that_of_many(spark, small):
    """Each decision's audit is that of the decision alone."""
    master, bars = q_quality.universe_inputs(spark, small)
    first, cal = tb.shape(spark, small).first, q_quality.closes(spark, small)
    at = {d: F.date_add(F.lit(first), d * 7 + 5).cast("timestamp") for d in (160, 240)}
    dec = spark.createDataFrame([(d,) for d in at], "decision int").withColumn("decision_at", F.date_add(F.lit(first), F.col("decision") * 7 + 5).cast("timestamp"))
    audit = un.universes(master, bars, cal, dec, q_quality.POLICY)
    cols = ["security_id", "status", "latest_close", "median_dollar_volume", "coverage", "valid_observations", "eligible", "exclusion_reasons"]
    for d, when in at.items():
        one = un.build_universe(master, bars, cal, when, q_quality.POLICY)
        assert sorted(map(str, audit.where(F.col("decision") == d).select(*cols).collect())) == sorted(map(str, one.select(*cols).collect()))
    rows = [(d, f"s{i}", float(i), i != 3) for d, n in ((1, 6), (2, 2)) for i in range(n)]
    top = un.top_of_each(spark.createDataFrame(rows, "decision int, security_id string, median_dollar_volume double, eligible boolean"), 3, 3)
    assert sorted(map(tuple, top.collect())) == [(1, "s2", 0, 3), (1, "s4", 1, 3), (1, "s5", 2, 3)]


def test_asof_spreads_a_crowded_day(spark):
    """A key with all its events in one minute is cut into parts by counts; every event gets the definition that held."""
    rng = np.random.default_rng(43)
    start = dt.datetime(2024, 3, 1, 12)
    at = lambda us: start + dt.timedelta(microseconds=int(us))
    events = [("hot", at(u), i) for i, u in enumerate(rng.integers(0, 60_000_000, 6000))] + [("cold", at(u * 1000), 10_000 + i) for i, u in enumerate(rng.integers(0, 10**9, 50))] + [("bare", start, 20_000)]
    events += [("hot", at(30_000_000), 30_000 + i) for i in range(700)]  # one moment with more events than a part
    defs = [("hot", at(u), f"h{i}") for i, u in enumerate(rng.integers(2_000_000, 60_000_000, 40))] + [("hot", at(30_000_000), "tie1"), ("hot", at(30_000_000), "tie2"), ("cold", at(-5), "c0"), ("cold", at(5 * 10**11), "c1")]
    e, d = spark.createDataFrame(events, "k string, t timestamp, i int").repartition(4), spark.createDataFrame(defs, "k string, d timestamp, v string")
    splits = {r["k"]: r["__splits"] for r in tp.split_points(e, ["k"], "t", 500).collect()}
    assert set(splits) == {"hot"} and len(splits["hot"]) >= 8
    size = np.bincount(np.searchsorted(splits["hot"], [int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for k, t, _ in events if k == "hot"]))
    assert size.max() < 1500
    got = {r["i"]: r["v"] for r in tp.attach_asof(e, d, "k", "t", "d", ["v"], None, ("v",), 500).collect()}
    want = {}
    for k, t, i in events:
        known = [(s, v) for q, s, v in defs if q == k and s <= t]
        if any(q == k for q, _, _ in defs):
            want[i] = max(known)[1] if known else None
    assert got == want


def test_covariance_windows(spark):
    """Windows of many decisions with changing members, gaps and names without returns, against a table per window."""
    rng = np.random.default_rng(14)
    t, n, look = 60, 17, 20
    x = rng.normal(0, 0.02, (t, n))
    x[rng.random((t, n)) < 0.3] = np.nan
    x[:, 3] = np.nan
    x[:30, 4] = np.nan
    r = spark.createDataFrame([(f"n{i:02}", s + 5, float(x[s, i])) for s in range(t) for i in range(n) if np.isfinite(x[s, i])] + [("other", 9, 0.5), ("n01", 7, None)], "security_id string, session_idx int, ret double")
    members, want = [], {}
    for d in (3, 5, 9, 26, 30, 33, 50, 64, 65, 90):
        chosen = sorted(rng.choice(n, rng.integers(2, n), replace=False))
        members += [(d, f"n{i:02}", k) for k, i in enumerate(chosen)]
        window = x[max(d - look - 5, 0) : max(d - 5, 0)]
        for a, i in enumerate(chosen):
            for b, j in enumerate(chosen):
                both = np.isfinite(window[:, i]) & np.isfinite(window[:, j])
                if a <= b and both.sum() >= 2:
                    want[d, a, b] = (np.cov(window[both, i], window[both, j])[0, 1], both.sum())
    m = spark.createDataFrame(members, "decision int, security_id string, position int")
    pairs = rs.window_covariance(r, m, look, tile=4).cache()
    got = {(p["decision"], p["i"], p["j"]): (p["covariance"], p["pairs"]) for p in pairs.collect()}
    assert set(got) == set(want)
    for k, (c, count) in want.items():
        assert got[k][1] == count and abs(got[k][0] - c) < 1e-12
    status = {s["decision"]: s for s in rs.covariance_status(pairs, m, 6).collect()}
    for d in {k for k, _, _ in members}:
        size = sum(k == d for k, _, _ in members)
        fine = sum(1 for (k, i, j), (c, count) in want.items() if k == d and count >= 6 and (i != j or c > 0))
        assert status[d]["short_pairs"] == size * (size + 1) // 2 - fine and status[d]["ready"] == (status[d]["short_pairs"] == 0)
    assert rs.window_covariance(r, m.limit(0), look).count() == 0
    with pytest.raises(ValueError):
        rs.CovariancePolicy(lookback=10, least=11)


def test_covariance_and_direction_of_every_decision(spark, small):
    """One row per pair of a decision that has a covariance, none of one that has not; the repaired ones are positive definite."""
    status = {r["decision"]: r for r in q_portfolio.covariances(spark, small)[1].collect()}
    assert len(status) > 20 and any(r["ready"] for r in status.values())
    got = q_portfolio.a13r(spark, small).toPandas()
    assert set(got["decision"]) == {d for d, r in status.items() if r["ready"]}
    for d, g in got.groupby("decision"):
        n = status[d]["names"]
        assert len(g) == n * (n + 1) // 2
        m = np.zeros((n, n))
        m[g["i"], g["j"]] = m[g["j"], g["i"]] = g["covariance"]
        assert np.linalg.eigvalsh(m).min() > 0
    assert set(r["decision"] for r in q_portfolio.c08(spark, small).select("decision").distinct().collect()) <= set(got["decision"])


def test_fits_are_frozen(spark):
    """Each fit is the one of its own train rows, a decision meets the last that ended before it, and a changed fit is refused."""
    rng = np.random.default_rng(21)
    rows = [(f"s{k}", t, float(a), float(b), float(0.3 * a - 0.1 * b + e) if t < 57 else None, t + 3) for t in range(60) for k in range(20) for a, b, e in [rng.normal(size=3)]]
    df = spark.createDataFrame(rows, "security_id string, session_idx int, f1 double, f2 double, label double, label_end int")
    fits = rs.fit_table(df, ["f1", "f2"], "label", "label_end", [40, 20, 2], 0.1, 100).cache()
    assert [r["train_end"] for r in fits.orderBy("version").collect()] == [20, 40]  # the first end has no rows
    for r in fits.collect():
        one = rs.ridge_calibration(df, ["f1", "f2"], "label", "label_end", 0, r["train_end"], 0.1, 100)
        np.testing.assert_allclose([r["intercept"], *r["means"], *r["scales"], *r["coefficients"], r["observations"]], [one.intercept, *one.means, *one.scales, *one.coefficients, one.observations], rtol=1e-9)
    got = rs.apply_fits(df.withColumnRenamed("session_idx", "decision"), fits, ["f1", "f2"], 60)
    seen = {r["decision"]: r["version"] for r in got.select("decision", "version").distinct().collect()}
    assert seen == {t: None if t <= 20 else 2 if t <= 40 else 3 for t in range(60)}
    last = rs.ridge_calibration(df, ["f1", "f2"], "label", "label_end", 0, 40, 0.1, 100)
    want = {(r["security_id"], r["session_idx"]): r["p"] for r in df.where("session_idx > 40").withColumn("p", last.predict()).collect()}
    for r in got.where("decision > 40").collect():
        assert abs(r["alpha"] - want[r["security_id"], r["decision"]]) < 1e-9
    changed = fits.withColumn("intercept", F.when(F.col("version") == 3, F.col("intercept") + 1e-6).otherwise(F.col("intercept")))
    with pytest.raises(Exception, match="digest"):
        rs.apply_fits(df.withColumnRenamed("session_idx", "decision"), changed, ["f1", "f2"], 60).collect()


def test_hac_recovers_a_known_beta(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 0.01, 400)
    y = 0.0002 + 0.5 * x + rng.normal(0, 0.001, 400)
    df = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "k string, session_idx int, y double, x double")
    r = rs.hac_regression(df, "y", "x", ["k"]).first()
    assert r["market_beta"] == pytest.approx(0.5, abs=0.02) and r["beta_tstat"] > 50


def test_gate_fails_closed(spark):
    df = spark.createDataFrame([("a", 1.0, -0.1), ("b", float("nan"), None)], "experiment string, sharpe double, max_drawdown double")
    rows = {r["experiment"]: r for r in rp.gate(df, [("s", "sharpe", ">", 0.5), ("d", "max_drawdown", ">=", -0.2)]).collect()}
    assert rows["a"]["passed"] and not rows["b"]["passed"] and rows["b"]["failed"] == ["s", "d"]


def test_largest_fraction_of_a_hot_experiment(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"e": np.where(rng.random(500) < 0.6, "hot", rng.choice(["a", "b", "c"], 500)), "name": [f"n{i:03d}" for i in range(500)], "x": rng.integers(-9, 9, 500) / 4.0})
    got = rp.top_fraction(spark.createDataFrame(pdf), ["e"], "x", "name", 0.1).toPandas()
    want = pdf.sort_values(["x", "name"], ascending=[False, True])
    want["rank"] = want.groupby("e").cumcount() + 1
    want = want[want["rank"] <= np.ceil(want.groupby("e")["x"].transform("size") * 0.1)]
    cols = ["e", "rank", "name"]
    assert sorted(map(tuple, got[cols].values)) == sorted(map(tuple, want[cols].values))


def test_policies_and_columns(spark):
    with pytest.raises(ValueError):
        un.UniversePolicy(min_members=500)
    schema = "source string, calendar_source string, security_id_kind string, availability_basis string, scope string, master_kind string, includes_terminated boolean, valid_from date"
    basis = "evidenced_publication_or_capture"
    rows = [
        ("a", "b", "permanent", basis, "historical_verified", "archived_snapshots", True, None), ("a", "b", "permanent", basis, "historical_verified", "current_snapshot", None, None),
        (" ", None, "ticker", "inferred", "unknown", "dated", True, None), ("a", "b", "permanent", basis, "prospective_only", "current_snapshot", False, D(2021, 1, 1)),
        ("a", "b", "permanent", basis, "prospective_only", "current_snapshot", False, D(2019, 1, 1)),
    ]
    m = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    found = sorted((r["key"], r["rule"]) for r in qa.violations(m, F.col("i"), qa.manifest_rules(F.lit("2020-01-01").cast("date"))).collect())
    assert found == [
        ("1", "history_kind"), ("1", "terminated_included"), ("2", "availability_evidenced"), ("2", "identifier_permanent"), ("2", "scope_known"), ("2", "sources_named"), ("3", "decision_covered"),
    ]
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    with pytest.raises(Exception, match="repeats"):
        tp.validated_left_join(spark.range(3).select(F.col("id").cast("int").alias("k")), twice, ["k"]).collect()
    ok = tp.validated_left_join(spark.range(3).select(F.col("id").cast("int").alias("k")), twice.where("v != 'x'"), ["k"]).orderBy("k").collect()
    assert [(r["k"], r["v"], r["matched"]) for r in ok] == [(0, None, False), (1, "y", True), (2, "z", True)]
    with pytest.raises(ValueError):
        qa.require_columns(spark.range(1), ["x"], "t")
    bad = qa.violations(spark.range(3), F.col("id"), {"small": F.col("id") < 2})
    with pytest.raises(ValueError):
        qa.fail_on(bad, "ids")


def test_canonical_tickers(spark):
    df = spark.createDataFrame([(" brk.b ",), ("BRK-B",), ("brk/b",)], "t string")
    assert {r[0] for r in df.select(qa.canonical_ticker(F.col("t"))).collect()} == {"BRK-B"}


def test_company_facts_file(spark, tmp_path):
    def item(val, start, end, accn="A1", form="10-K", fp="FY"):
        return {"val": val, "filed": "2022-02-25", "start": start, "end": end, "accn": accn, "form": form, "fp": fp, "fy": 2021}

    usd = lambda *items: {"units": {"USD": list(items)}}
    doc = {"cik": 7, "entityName": "Z", "facts": {"us-gaap": {
        "Assets": usd(item(100, None, "2021-12-31"), item(90, None, "2020-12-31")),
        "NetIncomeLoss": usd(item(10, "2021-01-01", "2021-12-31"), item(3, "2021-10-01", "2021-12-31")),
        "ProfitLoss": usd(item(11, "2021-01-01", "2021-12-31")), "Other": usd(item(1, None, "2021-12-31"))}}}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    rows = {r["concept"]: r["value"] for r in rd.scan_company_facts(spark, str(tmp_path / "f.json")).collect()}
    assert rows == {"assets": 100.0, "net_income": 10.0}


def test_bar_file_uses_the_new_york_date(spark, tmp_path):
    (tmp_path / "b.csv").write_text("symbol,t,o,h,l,c,v\nA,2024-01-03T02:00:00Z,1,2,1,2,5\nB,2024-01-03T15:00:00Z,1,2,1,2,5\n")
    cal = spark.createDataFrame([(D(2024, 1, 2),), (D(2024, 1, 3),)], "session date")
    sym = spark.createDataFrame([("A",), ("B",)], "symbol string")
    got = {r["symbol"]: r["session"] for r in rd.scan_bars(spark, str(tmp_path / "b.csv"), sym, cal).collect()}
    assert got == {"A": D(2024, 1, 2), "B": D(2024, 1, 3)}


def test_sf1_rejects_duplicates_and_sinks_round_trip(spark, tmp_path):
    sf1 = spark.createDataFrame([("brk.b", "ARY", "2022-02-28", "2021-12-31", 5.0), ("brk.b", "MRY", "2022-02-28", "2021-12-31", 6.0)], "ticker string, dimension string, datekey string, reportperiod string, assets double")
    for c in ("revenue", "gp", "netinc", "ncfo"):
        sf1 = sf1.withColumn(c, F.lit(None).cast("double"))
    cand = spark.createDataFrame([("BRK-B", "x")], "symbol string, sector string")
    rows = rd.sf1_rows(sf1, cand)
    assert rd.sf1_duplicates(rows).count() == 0 and rd.sf1_duplicates(rows.union(rows)).count() == 1
    fact = rd.sf1_facts(rows).first()
    assert (fact["accession"], fact["concept"], fact["value"]) == ("SF1-ARY-BRK-B-20211231-20220228", "assets", 5.0)
    for fmt in ("parquet", "csv.gz", "json"):
        rd.write_table(rows, str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1
    blob = tmp_path / "x.bin"
    blob.write_bytes(b"abc")
    m = rd.file_manifest(spark, str(tmp_path), "*.bin").first()
    assert (m["file"], m["bytes"], m["sha256"]) == ("x.bin", 3, hashlib.sha256(b"abc").hexdigest())
