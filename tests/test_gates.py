"""Data gates: each rule broken alone, admission that feeds back, and thresholds at their borders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelweft.operators import gates as gt

D = dt.date
DAILY = "archive string, date date, root string, contract string, settlement double, open double, high double, low double, volume double, open_interest double"
META = "archive string, root string, contract string, sleeve string, exchange string, currency string, multiplier double, tick_size double, expiry_date date, first_notice_date date, last_trade_date date, cash_settled boolean"
START, END = D(2024, 1, 1), D(2024, 1, 26)
ROOTS = {"AA": "x", "BB": "x", "CC": "y"}


def archive(name="a", skip=()):
    """Twenty weekdays of two contracts a root."""
    daily, meta = [], []
    for root, sleeve in ROOTS.items():
        for k in (1, 2):
            meta.append([name, root, f"{root}{k}", sleeve, "E", "USD", 50.0, 0.25, D(2024, 2 + k, 15), D(2024, 2 + k, 10), D(2024, 2 + k, 14), False])
            day = START
            while day <= END:
                if day.weekday() < 5 and (root, day) not in skip:
                    daily.append([name, day, root, f"{root}{k}", 100.0, 99.0, 101.0, 98.0, 10.0, 5.0])
                day += dt.timedelta(days=1)
    return daily, meta


def judged(spark, daily, meta, **policy):
    universe = spark.createDataFrame(list(ROOTS.items()), "root string, sleeve string")
    p = gt.FuturesPolicy(START, END, **{"min_roots": 3, "min_sleeves": 2, **policy})
    return gt.futures_gate(spark.createDataFrame(daily, DAILY), spark.createDataFrame(meta, META), universe, p)


def problems(gate):
    return {r["archive"]: (r["status"], r["problems"]) for r in gate.status.collect()}


def test_each_rule_blocks_alone(spark):
    """One archive per broken rule, all judged together; the clean one is admitted."""
    changes = {
        "date_invalid": (0, lambda r: r.__setitem__(1, None)), "price_invalid": (0, lambda r: r.__setitem__(7, 0.0)), "activity_invalid": (0, lambda r: r.__setitem__(9, float("nan"))),
        "scale_invalid": (1, lambda r: r.__setitem__(7, None)), "notice_missing": (1, lambda r: r.__setitem__(9, None)), "expiry_missing": (1, lambda r: r.__setitem__(10, None)),
    }
    daily, meta = archive("clean")
    want = {"clean": ("ADMITTED", [])}
    for rule, (table, change) in changes.items():
        own = archive(rule)
        change(own[table][-1])
        daily, meta, want[rule] = daily + own[0], meta + own[1], ("BLOCKED", [rule])
    for rule in ("contract_date_repeated", "metadata_repeated", "contract_without_metadata", "daily_root_unknown", "metadata_root_unknown"):
        d, m = archive(rule)
        if rule == "contract_date_repeated":
            d.append(d[0])
        elif rule == "metadata_repeated":
            m.append(m[0])
        elif rule == "contract_without_metadata":
            d.append([rule, START, "AA", "AA9", *d[0][4:]])
        elif rule == "daily_root_unknown":
            d.append([rule, START, "ZZ", "AA1x", *d[0][4:]])
            m.append([rule, "AA", "AA1x", *m[0][3:]])
        else:
            m.append([rule, "ZZ", "ZZ1", *m[0][3:]])
        daily, meta, want[rule] = daily + d, meta + m, ("BLOCKED", [rule])
    d, m = archive("cash")
    m[0][9], m[0][11] = None, True  # settled in cash: no notice needed
    want["cash"] = ("ADMITTED", [])
    assert problems(judged(spark, daily + d, meta + m)) == want


def test_admission_feeds_back(spark):
    """A root without depth isn't admitted, its sleeve isn't counted, and both counts decide the status."""
    days = [START + dt.timedelta(days=i) for i in range(26) if (START + dt.timedelta(days=i)).weekday() < 5]
    daily, meta = archive("a", skip={("CC", days[7]), ("CC", days[8])})  # 18 of 20 sessions
    gate = judged(spark, daily, meta)
    assert problems(gate) == {"a": ("BLOCKED", ["too_few_roots", "too_few_sleeves"])}
    s = gate.status.first()
    assert s["admitted_roots"] == ["AA", "BB"] and s["admitted_sleeves"] == ["x"]
    parts = {r["root"]: r for r in gate.parts.collect()}
    assert parts["CC"]["session_coverage"] == pytest.approx(0.9) and not parts["CC"]["admitted"] and parts["AA"]["contracts"] == 2
    assert problems(judged(spark, daily, meta, min_coverage=0.9))["a"] == ("ADMITTED", [])
    assert problems(judged(spark, daily, meta, min_roots=2, min_sleeves=1))["a"] == ("ADMITTED", [])
    late = [r for r in archive("a")[0] if not (r[2] == "BB" and r[1] == END)]
    assert problems(judged(spark, late, meta, min_coverage=0.5))["a"] == ("BLOCKED", ["too_few_roots"])
    thin = [r for r in archive("a")[0] if not (r[3] == "AA2" and r[1] > days[10])]  # two expiries on 11 of 20 sessions
    assert problems(judged(spark, thin, meta))["a"][1] == ["too_few_roots"] and problems(judged(spark, thin, meta, min_curve_share=0.55))["a"][1] == []
    none = [r for r in archive("a")[0] if r[2] != "CC"]
    assert {r["root"]: r["observed_sessions"] for r in judged(spark, none, meta).parts.collect()} == {"AA": 20, "BB": 20, "CC": 0}
    with pytest.raises(ValueError, match="daily_column_missing:low"):
        universe = spark.createDataFrame(list(ROOTS.items()), "root string, sleeve string")
        gt.futures_gate(spark.createDataFrame(daily, DAILY).drop("low"), spark.createDataFrame(meta, META), universe, gt.FuturesPolicy(START, END))
    assert gt.expected_sessions(START, END) == 20 and gt.expected_sessions(START, END, (0,)) == 4


def test_filing_gate(spark):
    days = [START + dt.timedelta(days=i) for i in range(26) if (START + dt.timedelta(days=i)).weekday() < 5]
    events = [(e, 10 * e + k, days[k + e % 3]) for e in range(6) for k in range(1 + 3 * (e % 2))] + [(99, 1, D(2023, 1, 1))]
    members = [(d, str(e), e, "s" if e < 4 else "t") for d in days for e in range(6) if not (e == 5 and d > days[14])]
    ev = spark.createDataFrame(events, "entity_id int, accession_id int, availability_date date")
    mem = spark.createDataFrame(members, "date date, cik string, entity_id int, sector string")
    fine = dict(members=6, min_session_share=0.75, one_event=6, three_events=3, names_per_sector=2, sectors=2)
    gate = gt.filing_gate(ev, mem, gt.FilingPolicy(START, END, **fine))
    s = gate.status.first()
    assert (s["status"], s["problems"], s["deep_sessions"], s["train_sessions"], s["first_event"]) == ("ADMITTED", [], 15, 20, D(2023, 1, 1))
    for rule, change in {
        "membership_session_coverage": {"min_session_share": 0.8}, "one_train_event": {"one_event": 7}, "three_train_events": {"three_events": 4}, "sector_depth": {"names_per_sector": 3},
    }.items():
        s = gt.filing_gate(ev, mem, gt.FilingPolicy(START, END, **(fine | change))).status.first()
        assert (s["status"], s["problems"]) == ("BLOCKED", [rule])
    again = ev.unionByName(ev.where("entity_id = 99").withColumn("accession_id", F.lit(2)))
    assert gt.filing_gate(again, mem, gt.FilingPolicy(START, END, **fine)).status.first()["problems"] == ["unique_entity_availability"]
    empty = gt.filing_gate(ev.limit(0), mem.limit(0), gt.FilingPolicy(START, END, **fine)).status.first()
    assert empty["status"] == "BLOCKED" and len(empty["problems"]) == 4
