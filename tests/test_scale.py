"""Work of steps that grew faster than their input, or held too much of it."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweft.functions import frames as fr
from panelweft.operators import features as ft
from panelweft.operators import fundamentals as fd
from panelweft.operators import ledger as lg
from panelweft.operators import research as rs
from panelweft.plans import q_research, q_temporal


def test_covariance_follows_members(spark):
    """Returns of names that no decision holds at the time never reach a task, and tiles change nothing."""
    rng = np.random.default_rng(3)
    names, sessions, lookback = 60, 40, 8
    ret = {(n, s): float(rng.normal()) for n in range(names) for s in range(sessions) if rng.random() > 0.1}
    r = spark.createDataFrame([(f"n{n:02d}", s, v) for (n, s), v in ret.items()], "security_id string, session_idx int, ret double")
    held = {d: [(d + 7 * k) % names for k in range(6)] for d in (10, 20, 30)}
    m = spark.createDataFrame([(d, f"n{n:02d}", p) for d, ns in held.items() for p, n in enumerate(ns)], "decision int, security_id string, position int")
    for tile in (2, 512):
        got = rs.window_covariance(r, m, lookback, tile)
        mine = {(x["decision"], x["i"], x["j"]): (x["covariance"], x["pairs"]) for x in got.collect()}
        want = {}
        for d, ns in held.items():
            for i in range(6):
                for j in range(i, 6):
                    both = [(ret[ns[i], s], ret[ns[j], s]) for s in range(d - lookback, d) if (ns[i], s) in ret and (ns[j], s) in ret]
                    if len(both) > 1:
                        want[d, i, j] = np.cov(*zip(*both))[0, 1], len(both)
        assert mine.keys() == want.keys()
        assert all(mine[k][1] == want[k][1] and mine[k][0] == pytest.approx(want[k][0], abs=1e-12) for k in want)
    # a third of the names are never held: their returns once went to every tile
    plan = rs.window_covariance(r, m, lookback, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and plan.index("FlatMapGroupsInArrow") < plan.index("Join")


def test_scores_hold_one_group_of_numbers(spark):
    """Ranks need no window over a sector's rows, whose percentile maps held gigabytes, and equal those of the tiled plan."""
    rng = np.random.default_rng(5)
    rows = [(s, "a" if k % 3 else None, k, *(None if rng.random() < 0.2 else float(rng.integers(0, 9)) / 3 for _ in fd.COMPONENTS)) for s in (1, 2) for k in range(60)]
    df = spark.createDataFrame(rows, "session_idx int, sector string, symbol int, " + ", ".join(f"{c} double" for c in fd.COMPONENTS))
    each = fd.fundamental_scores(df, 50)
    assert "Window" not in each._jdf.queryExecution().optimizedPlan().toString()
    keyed = lambda d: {(r["session_idx"], r["symbol"]): r for r in d.collect()}
    a, b = keyed(each), keyed(fd.fundamental_scores(df, 50, wide=True))
    assert a.keys() == b.keys() and len(a) == 120
    for k in a:
        for c in ("quality_components", "growth_components", "quality_score", "conservative_growth_score"):
            assert a[k][c] == (None if b[k][c] is None else pytest.approx(b[k][c], abs=1e-12))


def test_scores_shuffle_spans_not_sessions(spark, small):
    """Scores of spans equal the tiled plan's on a row per session, over blocks, batches, gaps, revisions, missing and odd values;
    the query expands filings to sessions in the task that ranks them."""
    rng = np.random.default_rng(4)
    odd = (None, 0.0, float("inf"), float("nan"))
    rows = []
    for k in range(45):
        cuts = sorted(rng.choice(60, 6, replace=False).tolist())
        for low, high in [(0, 60)] if k % 9 == 0 else [(a, b) for a, b in zip(cuts, cuts[1:]) if rng.random() > 0.2]:
            rows.append((k, None if k % 3 == 0 else f"s{k % 2}", low, high, *(odd[k % 4] if rng.random() < 0.2 else float(rng.integers(0, 9)) / 3 for _ in fd.COMPONENTS)))
    spans = spark.createDataFrame(rows, "symbol int, sector string, __s int, __e int, " + ", ".join(f"{c} double" for c in fd.COMPONENTS))
    expanded = spans.select("symbol", "sector", F.explode(F.sequence("__s", F.col("__e") - 1)).alias("session_idx"), *fd.COMPONENTS)
    keyed = lambda d: {(r["session_idx"], r["symbol"]): r for r in d.collect()}
    want = keyed(fd.fundamental_scores(expanded, 30, wide=True))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("7", size):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            rowed = fd.span_scores(spans, 30).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {(r["session_idx"], r["symbol"]): r for r in rowed}
        assert len(rowed) == len(got) and got.keys() == want.keys() and {s for s, _ in got} == set(range(60))
        assert len({r["quality_score"] is None for r in rowed}) == 2
        for k in got:
            for c in ("quality_components", "growth_components", "quality_score", "conservative_growth_score"):
                assert got[k][c] == (None if want[k][c] is None else pytest.approx(want[k][c], abs=1e-12, nan_ok=True)), (k, c)
    plan = q_temporal.w38(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"explode\(sequence\(__s#[^\n]*\n\W*(\w+)", plan) == ["Aggregate"]


def test_ledger_reads_each_history_once(spark):
    """Paths come from one row a name: sparse returns count as flat, a total loss stays one, and no path row is joined or shuffled."""
    tg = [("e", 1, "a", 0.5), ("e", 1, "b", -0.5), ("e", 3, "b", 0.25), ("e", 3, "c", 0.25), ("f", 2, "a", 0.5)]
    ret = {("a", 2): 0.1, ("a", 3): -1.0, ("b", 2): -0.2, ("b", 4): 0.5, ("b", 0): 0.3}
    targets = spark.createDataFrame(tg, "experiment string, session_idx int, security_id string, weight double")
    returns = spark.createDataFrame([(n, s, v) for (n, s), v in ret.items()], "security_id string, session_idx int, ret double")
    risk = spark.createDataFrame([(n, s, 0.01, 1e6) for n in "abc" for s in range(6)], "security_id string, session_idx int, vol double, adv double")
    led = lg.pnl_ledger(targets, returns, risk, 5, 7, 1e4, lg.Costs(0, 0, 0, 0, 0))
    day = {(r["experiment"], r["session_idx"]): r for r in led.daily.collect()}
    assert sorted(day) == [("e", 2), ("e", 3), ("e", 4), ("e", 5), ("f", 3), ("f", 4), ("f", 5)]
    assert day["e", 2]["gross_return"] == pytest.approx(0.5 * 0.1 + 0.5 * 0.2) and day["e", 2]["missing_held"] == 0
    assert day["e", 3]["gross_return"] == pytest.approx(-0.55 / 1.15) and day["e", 3]["missing_held"] == 1
    assert day["e", 4]["gross_return"] == pytest.approx(0.125) and day["e", 4]["missing_held"] == 1
    assert day["f", 3]["gross_return"] == -0.5 and day["f", 4]["gross_return"] == 0.0
    turnover = {(r["experiment"], r["block"]): r["turnover"] for r in led.blocks.collect()}
    # at session 3 the loss has taken "a" whole; -0.4 of "b" is -0.4 / 0.6 of what is left
    assert turnover["e", 1] == 1.0 and turnover["e", 3] == pytest.approx(0.25 + 0.4 / 0.6 + 0.25)
    plan = led.held._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Join") == 1


def test_rolling_quantiles_equal_the_sliding_aggregate(spark):
    """Also over batches, gaps, missing values, infinities and rows without a name."""
    rng = np.random.default_rng(8)
    odd = [None, float("inf"), -1.0, -1.0]
    rows = [(None if k == 4 else f"n{k}", s, odd[s % 4] if rng.random() < 0.3 else float(rng.normal())) for k in range(5) for s in range(60) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "security_id string, session_idx int, x double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for lo, hi, k in ((-9, 0, 4), (-12, -1, 3)):
            outs = {"a": ("x", 0.5), "b": ("x", 0.7)}
            want = df.withColumns({o: fr.roll(fr.quantile(q), v, fr.ts_between(lo, hi), k) for o, (v, q) in outs.items()})
            got = fr.rolling_quantiles(df, outs, lo, hi, k)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where(F.col("a").isNotNull()).count() > 50
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_train_segment_derives_no_later_session(spark, small):
    """Families of the train segment are cut at its end before their windows, not after; results are those of the whole."""
    ics = q_research.family_ics(spark, small)
    assert re.search(rf"session_idx#\d+ <= {q_research.TRAIN_END}\b", ics._jdf.queryExecution().optimizedPlan().toString())
    whole = q_research.family_ics(spark, small, train=False).where(F.col("session_idx") + q_research.H <= q_research.TRAIN_END)
    keyed = lambda d: {(r["family"], r["session_idx"]): (r["names"], r["rank_ic"]) for r in d.collect()}
    a, b = keyed(ics), keyed(whole)
    assert a.keys() == b.keys() and len(a) > 100
    assert all(a[k][0] == b[k][0] and (a[k][1] == b[k][1] or a[k][1] == pytest.approx(b[k][1], abs=1e-12)) for k in a)


def test_tails_need_no_sliding_aggregate(spark):
    """Scores and thresholds equal those of sliding windows, also where a window doesn't vary; none is planned."""
    rng = np.random.default_rng(2)
    rows = [(f"n{k}", s, True, 0.1 if k == 0 and s < 30 else None if rng.random() < 0.1 else float(rng.normal())) for k in range(4) for s in range(80) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "security_id string, session_idx int, eligible boolean, x double")
    got = ft.standardised_tail(df, "x", 12, 5)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    f = fr.ts_prior(12)
    z = fr.clip(fr.ratio(F.col("x") - fr.roll(F.avg, "x", f, 5), fr.positive(fr.roll(F.stddev_samp, "x", f, 5))), -5.0, 5.0)
    want = df.withColumn("z_score", z).withColumn("threshold", fr.roll(fr.quantile(0.7), F.abs(F.col("z_score")), f, 5))
    keyed = lambda d: {(r["security_id"], r["session_idx"]): (r["z_score"], r["threshold"]) for r in d.collect()}
    a, b = keyed(got), keyed(want)
    assert a.keys() == b.keys() and sum(v[1] is not None for v in a.values()) > 100
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert x == (None if y is None else pytest.approx(y, abs=1e-9)), k
