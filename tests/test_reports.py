"""Leave-one-out books, horizons per family and segment tables against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweft.functions import frames as fr
from panelweft.operators import reports as rp
from panelweft.operators import research as rs


def test_leave_one_out(spark):
    """The book without a pair, built again from the other pairs; a pair that holds a session alone takes the session with it."""
    rng = np.random.default_rng(37)
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e")]
    names = list("abcde")
    legs, nxt, sessions = [], {}, range(30)
    for t in sessions:
        for i, x in enumerate(names):
            if rng.random() < 0.9:
                nxt[t, x] = float(rng.normal(0, 0.03))
        for left, right in pairs:
            if t < 4 and left != "d":
                continue  # the pair (d, e) alone
            s = float(rng.normal()) if rng.random() < 0.85 else None
            legs += [(t, left, right, left, s), (t, left, right, right, None if s is None else -s)]
    df = spark.createDataFrame(legs, "session_idx int, left string, right string, security_id string, signal double").repartition(3)
    nx = spark.createDataFrame([(t, x, v) for (t, x), v in nxt.items()] + [(0, "zz", None)], "session_idx int, security_id string, next double")
    got = {(r["left"], r["right"]): r for r in rp.leave_one_out(df, nx, ["left", "right"], 52.0).collect()}
    assert set(got) == set(pairs)
    for gone in pairs:
        earned = []
        for t in sessions:
            by = {}
            for u, left, right, x, s in legs:
                if u == t and (left, right) != gone and s is not None and (t, x) in nxt:
                    by.setdefault(x, []).append(s)
            score = {x: np.mean(v) for x, v in by.items()}
            if sum(map(abs, score.values())) > 1e-9:
                earned.append(sum(v * nxt[t, x] for x, v in score.items()) / sum(map(abs, score.values())))
        r, e = got[gone], np.array(earned)
        assert r["sessions"] == len(e)
        np.testing.assert_allclose([r["mean"], r["sharpe"], r["total_return"]], [e.mean() * 52, e.mean() / e.std(ddof=1) * np.sqrt(52), np.prod(1 + e) - 1], rtol=1e-8)
    assert got["d", "e"]["sessions"] < got["a", "b"]["sessions"]


def test_horizons(spark):
    """Each family meets the label of its horizon, and its rows end with its own complete labels."""
    rows = [(f"s{k}", t, float(k + t), float(k * t), 0.01 * (t + 1)) for t in range(20) for k in range(3)]
    df = spark.createDataFrame(rows, "security_id string, session_idx int, f1 double, f2 double, ret double")
    label = lambda h: F.sum("ret").over(fr.ts_between(1, h))
    got = rs.horizon_rows(df, {"f1": 1, "f2": 5}, label, 2, 15).toPandas()
    for family, h, value in (("f1", 1, lambda k, t: k + t), ("f2", 5, lambda k, t: k * t)):
        own = got[got["family"] == family]
        assert (own["session_idx"].min(), own["session_idx"].max()) == (2, 15 - h) and (own["horizon"] == h).all() and len(own) == 3 * (14 - h)
        for _, r in own.iterrows():
            t, k = r["session_idx"], int(r["security_id"][1])
            assert r["score"] == value(k, t) and r["label"] == pytest.approx(sum(0.01 * (u + 1) for u in range(t + 1, t + h + 1)))


def test_segment_diagnostics(spark):
    rng = np.random.default_rng(41)
    days, names = 40, [("n1", "x"), ("n2", "x"), ("n3", "y"), ("n4", None), ("n5", "y"), ("n6", "z"), ("n7", "z")]
    d = pd.DataFrame({"experiment": "e", "session_idx": range(days), "session": pd.date_range("2020-12-20", periods=days), "segment": ["one"] * 25 + ["two"] * 15})
    for c, scale in (("gross_return", 0.02), ("transaction_cost", 0.001), ("borrow_cost", 0.0001), ("turnover", 0.3), ("gross", 1.0), ("net", 0.1)):
        d[c] = rng.normal(0, scale, days) if c in ("gross_return", "net") else rng.uniform(0, scale, days)
    d.loc[[3, 9], "gross"] = 5.0  # a tie: the first session counts
    d["net_return"] = d["gross_return"] - d["transaction_cost"] - d["borrow_cost"]
    market = pd.DataFrame({"session_idx": range(0, days, 2), "market": rng.normal(0, 0.02, days // 2)})
    books = d[["experiment", "session_idx", "segment"]].assign(**{c: rng.normal(0, 0.01, days) for c in ("long_net_return", "short_net_return", "long_gross_exposure", "short_gross_exposure")})
    held = pd.DataFrame([("e", s, t, n, z, float(rng.normal(0, 0.01))) for t, s in zip(range(days), d["segment"]) for n, z in names], columns=["experiment", "segment", "session_idx", "security_id", "sleeve", "contribution"])
    frame = lambda x, **k: spark.createDataFrame(x.astype(object).where(x.notna(), None), **k)
    got = rp.segment_diagnostics(
        spark.createDataFrame(d), spark.createDataFrame(books), frame(held, schema="experiment string, segment string, session_idx int, security_id string, sleeve string, contribution double"), spark.createDataFrame(market), periods=52.0, largest=3,
    ).toPandas().set_index("segment")
    for s, x in d.groupby("segment"):
        r, years = got.loc[s], len(x) / 52
        m = x.merge(market, on="session_idx")
        slope, cut = np.polyfit(m["market"], m["net_return"], 1)
        fit = 1 - ((m["net_return"] - cut - slope * m["market"]) ** 2).sum() / ((m["net_return"] - m["net_return"].mean()) ** 2).sum()
        b, c = books[books["segment"] == s], held[held["segment"] == s].groupby("security_id")["contribution"].sum()
        top = c.abs().sort_values(ascending=False)
        sleeves = held[held["segment"] == s].groupby("sleeve", dropna=False)["contribution"].sum()
        want = {
            "sessions": len(x), "annual_turnover": x["turnover"].sum() / years, "annual_transaction_cost": x["transaction_cost"].sum() / years, "annual_borrow_cost": x["borrow_cost"].sum() / years, "average_gross": x["gross"].mean(),
            "maximum_gross": x["gross"].max(), "maximum_gross_session": x.loc[x["gross"].idxmax(), "session_idx"], "maximum_abs_net": x["net"].abs().max(), "market_beta": slope, "r_squared": fit, "long_contribution": b["long_net_return"].sum(),
            "short_contribution": b["short_net_return"].sum(), "short_expectancy": b["short_net_return"].mean() * 52, "average_long_exposure": b["long_gross_exposure"].mean(), "average_short_exposure": b["short_gross_exposure"].mean(),
            "top_share": top[:3].sum() / top.sum(), "positive_sleeves": (sleeves > 0).sum(), "sharpe": x["net_return"].mean() / x["net_return"].std() * np.sqrt(52), "gross_sharpe": x["gross_return"].mean() / x["gross_return"].std() * np.sqrt(52),
        }
        for k, v in want.items():
            assert r[k] == pytest.approx(v, rel=1e-9, abs=1e-12), (s, k)
        assert list(r["top_names"]) == list(top.index[:3])


def test_budget_maxima(spark):
    rows = [("e", "one", t, "net", "all", u, max(u - 1, 0.0), 1.0, 1.0 + (t == 4)) for t, u in enumerate([0.5, 1.5, 1.5, 0.2, 1.1])] + [("e", "two", 9, "net", "all", 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "experiment string, segment string, session_idx int, kind string, name string, usage double, excess double, cap double, effective_cap double")
    got = {r["segment"]: (r["rebalances"], r["maximum_usage"], r["at_session"], r["maximum_excess"], r["relaxed"]) for r in rp.budget_maxima(df).collect()}
    assert got == {"one": (5, 1.5, 1, 0.5, 1), "two": (1, 0.0, 9, 0.0, 0)}


def test_one_bad_row_refuses_a_plan(spark):
    rows = [
        ("ok", 1, "a", 0.1, 10.0, 3.0), ("ok", 1, "b", -0.2, 7.0, 0.0), ("noprice", 1, "a", 0.1, None, 3.0), ("noprice", 1, "b", 0.1, 5.0, 3.0), ("zero", 1, "a", 0.1, 0.0, 3.0), ("nan", 1, "a", float("nan"), 5.0, 3.0),
        ("inf", 1, "a", 0.1, float("inf"), 3.0), ("held", 1, "a", 0.1, 5.0, None), ("twice", 1, "a", 0.1, 5.0, 1.0), ("twice", 1, "a", 0.1, 5.0, 1.0), ("shut", 1, "a", 0.1, 5.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "experiment string, session_idx int, security_id string, weight double, price double, shares double")
    allowed = F.col("experiment") != "shut"
    got = {r["experiment"]: (r["status"], r["violations"]) for r in rp.plan_status(df, allowed).collect()}
    assert got == {"ok": ("READY", 0), "noprice": ("REFUSED", 1), "zero": ("REFUSED", 1), "nan": ("REFUSED", 1), "inf": ("REFUSED", 1), "held": ("REFUSED", 1), "twice": ("REFUSED", 1), "shut": ("NOT_ALLOWED", 0)}
    plan = {(r["experiment"], r["security_id"]): r["delta"] for r in rp.order_plan(df, 1000.0, allowed, rp.BOOK).collect()}
    assert plan == {("ok", "a"): 7.0, ("ok", "b"): -29.0}
