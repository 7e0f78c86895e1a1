import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import rolling_busy, rules, scans
from ledgerlens.operators.rolling import FeatureConfig, rolling_features, rolling_features_after, with_defaults
from ledgerlens.schemas import FEATURES
from make import frame, tx
from replay import replay

DAY = 86400


def mixed_rows(n=260, seed=5):
    """Ties, gaps beyond 35 days, few devices, window-edge times, one dominant sender."""
    rnd = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rnd.choice([0, 0, 1, 600, 3600, 3600, 21600, DAY, 7 * DAY // 20])
        if i == n // 2:
            at += 36 * DAY
        rows.append(tx(i, at, s=rnd.choice(["A", "A", "A", "B", "C"]), r=rnd.choice("VWXYZ"), amount=rnd.choice([0.05, 5, 100000, 900000, 123.45, 77777]),
                       sender_country=rnd.choice(["IN", "US", "AE"]), receiver_country=rnd.choice(["IN", "US", "PK"]), device_id=rnd.choice(["", "D1", "D2", "D3"]),
                       ip_address=rnd.choice(["1", "2", "3"]), geo_latitude=rnd.choice([19.0, 51.5]), geo_longitude=rnd.choice([72.8, -0.1]),
                       transaction_status=rnd.choice(["Success", "Failed"]), payment_channel=rnd.choice(["Web", "ATM", "Mobile"])))
    return rows


def check(got, want):
    assert {r["transaction_id"] for r in got} == set(want)
    for r in got:
        for f in FEATURES:
            assert r[f] == pytest.approx(want[r["transaction_id"]][f], rel=1e-6, abs=1e-6), (r["transaction_id"], f)


@pytest.mark.parametrize("busy_rows", [1000, 0, 60], ids=["frames", "scans", "mixed"])
def test_both_plans_equal_the_replay(spark, busy_rows):
    rows = mixed_rows()
    cfg = FeatureConfig(busy_rows=busy_rows)
    check(rolling_features(frame(spark, rows), cfg).collect(), replay(rows))


def test_shuffled_senders_beyond_the_broadcast_limit(spark):
    rows = mixed_rows(80, seed=9)
    cfg = FeatureConfig(busy_rows=0, broadcast_limit=0)
    check(rolling_features(frame(spark, rows), cfg).collect(), replay(rows))


def test_last_200_amounts(spark):
    rows = [tx(i, i * 60, amount=(i * 37) % 900 + 1) for i in range(450)]
    want = replay(rows)
    for busy in (1000, 0):
        got = rolling_features(frame(spark, rows), FeatureConfig(busy_rows=busy)).select("transaction_id", "benford_chi2_score").collect()
        for r in got:
            assert r["benford_chi2_score"] == pytest.approx(want[r["transaction_id"]]["benford_chi2_score"], rel=1e-9)


def test_warm_start_equals_full_replay(spark):
    rows = sorted(mixed_rows(120, seed=3), key=lambda r: (r["timestamp"], r["transaction_id"]))
    got = rolling_features_after(frame(spark, rows[:70]), frame(spark, rows[70:])).collect()
    want = replay(rows)
    check(got, {r["transaction_id"]: want[r["transaction_id"]] for r in rows[70:]})


def sequences():
    """Per rule: (earlier rows, trigger, near miss) as full histories on own accounts."""
    far = dict(geo_latitude=51.5, geo_longitude=-0.1)
    known = dict(device_id="KNOWN")
    out = {
        "R01": ([tx(0, amount=1_000_001)], [tx(0, amount=1_000_000)]),
        "R02": ([tx(i, i * 60) for i in range(3)] + [tx(9, 600, amount=900_000)], [tx(i, i * 60) for i in range(2)] + [tx(9, 600, amount=900_000)]),
        "R03": ([tx(i, i * 60) for i in range(12)], [tx(i, i * 60) for i in range(11)]),
        "R04": ([tx(0), tx(1, 15_552_001, amount=100_001)], [tx(0), tx(1, 15_552_000, amount=100_001)]),
        "R05": ([tx(0), tx(1, 1800, **far)], [tx(0), tx(1, 20 * 3600, **far)]),
        "R06": ([tx(0, receiver_country="PK")], [tx(0, sender_country="PK", receiver_country="PK")]),
        "R07": ([tx(0, amount=200_001)], [tx(0, **known), tx(1, 60, amount=200_001, **known)]),
        "R08": ([tx(i, i, s=f"S{i}") for i in range(6)] + [tx(9, 60)], [tx(i, i, s=f"S{i}") for i in range(5)] + [tx(9, 60)]),
        "R09": ([tx(i, i * 3600, r=f"R{i}") for i in range(21)] + [tx(30, 22 * 3600)], [tx(i, i * 3600, r=f"R{i}") for i in range(20)] + [tx(30, 22 * 3600)]),
        "R11": ([tx(i, i * 600) for i in range(6)] + [tx(9, 7200, amount=200_000)], [tx(i, i * 600) for i in range(5)] + [tx(9, 7200, amount=200_000)]),
        "R12": ([tx(0, kyc_level=0, amount=500_001)], [tx(0, kyc_level=0, amount=500_000)]),
        "R13": ([tx(i, i * 3600, amount=9000 + i) for i in range(5)] + [tx(9, 9 * 3600)], [tx(i, i * 3600, amount=9000 + i) for i in range(4)] + [tx(9, 9 * 3600)]),
    }
    return out


def test_hand_made_rule_sequences(spark):
    """Every history runs on its own accounts and devices, all in one job."""
    rows, expect = [], {}
    for rule, cases in sequences().items():
        for hit, history in zip((True, False), cases):
            tag = f"{rule}{'+' if hit else '-'}"
            for r in history:
                r = {**r, "transaction_id": f"{tag}{r['transaction_id']}", "sender_account": tag + r["sender_account"], "device_id": tag + r["device_id"]}
                rows.append(r)
            expect[rows[-1]["transaction_id"]] = (rule, hit)
    got = rules.evaluate_rules(rolling_features(frame(spark, rows))).where(F.col("transaction_id").isin(*expect)).collect()
    assert len(got) == len(expect)
    for r in got:
        rule, hit = expect[r["transaction_id"]]
        assert (rule in r["triggered_rules"]) == hit, (rule, hit, r["triggered_rules"])


def test_window_edge_is_inclusive(spark):
    rows = [tx(0, 0), tx(1, 3600), tx(2, 3601)]
    got = {r["transaction_id"]: r["tx_velocity_1h"] for r in rolling_features(frame(spark, rows)).collect()}
    assert got == {"T00000": 0, "T00001": 1, "T00002": 1}


def test_last_digits_grow_and_equal_a_replay(spark):
    """Digits are counted by frames that only grow, also where a sender has more rows than the depth."""
    from pyspark.sql import Window

    from ledgerlens.operators.rolling import last_digits

    digits = [1 + (i * i + i // 7) % 9 for i in range(90)]
    df = spark.createDataFrame(list(enumerate(digits)), "i int, digit int")
    counted = df.withColumns(last_digits(F.col("digit"), Window.partitionBy(F.lit(0)).orderBy("i"), 20))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$(), -1" in plan and "unboundedpreceding$(), -21" in plan and "RowFrame, -20" not in plan
    for r in counted.collect():
        before = digits[max(0, r["i"] - 20):r["i"]]
        assert [r[f"_d{d}"] for d in range(1, 10)] == [before.count(d) for d in range(1, 10)]


def test_wide_projections_are_generated_in_small_methods(spark):
    from ledgerlens.session import use_utc

    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    assert use_utc(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_running_plan_stores_only_what_is_read(spark, monkeypatch):
    """Six events a row are stored, with their thirteen deltas in one number, and the rounds over neighbours without columns nobody reads."""
    stored = []
    keep = lambda df: stored.append(df.columns) or df
    base = with_defaults(frame(spark, mixed_rows(40))).withColumn("at", F.unix_micros("timestamp"))
    for module in (rolling_busy, scans):
        monkeypatch.setattr(module, "cut_lineage", keep)
    rolling_busy._counts(rolling_busy._neighbours(base, 3600), 3600).columns
    events = [c for c in stored if "deltas" in c]
    assert len(events) == 1 and set(events[0]) == {"transaction_id", "sender_account", "at", "phase", "deltas", "g", "_slot"}
    assert all(not {"kyc_level", "amount", "sender_country", "geo_latitude"} & set(c) for c in stored)
