import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import evaluation as V
from ledgerlens.operators import fusion
from ledgerlens.operators.ingest import assign_sequence_ids, normalise, parse_json_events, timestamp_of, validate_contract
from ledgerlens.sources import readers, sinks
from make import T0, frame, tx


def test_csv_and_parquet_round_trip(spark, tmp_path):
    df = normalise(frame(spark, [tx(i, i, amount=i + 0.5) for i in range(20)]).withColumn("is_international", F.lit("true")))
    sinks.write_table(df, str(tmp_path / "p"))
    df.write.option("header", True).csv(str(tmp_path / "c"))
    cols = ["transaction_id", "timestamp", "amount", "kyc_level", "transaction_type", "is_international", "amount_leading_digit"]
    want = sorted(map(tuple, df.select(*cols).collect()))
    for fmt, p in (("parquet", "p"), ("csv", "c")):
        assert sorted(map(tuple, readers.read_transactions(spark, str(tmp_path / p), fmt).select(*cols).collect())) == want


def test_time_forms(spark):
    forms = ["2024-03-04T10:00:00Z", "2024-03-04T12:00:00+02:00", "2024-03-04 10:00:00", "1709546400", "1709546400.5", "junk", None]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "t string").select(F.unix_micros(timestamp_of(F.col("t")))).collect()]
    base = 1709546400 * 10**6
    assert got == [base, base, base, base, base + 500000, None, None]


def test_json_payloads_and_quarantine(spark):
    good = {"transaction_id": "1", "timestamp": "2024-03-04T10:00:00Z", "sender_account": "a", "receiver_account": "b", "amount": "12.5", "transaction_type": "swift-transfer", "kyc_level": 3}
    lines = [json.dumps(good), json.dumps({**good, "kyc_level": 4}), json.dumps({**good, "timestamp": "x"}), "{broken"]
    ok, bad = parse_json_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    r = ok.first()
    assert ok.count() == 1 and (r["amount"], r["transaction_type"], r["device_id"], r["amount_leading_digit"]) == (12.5, "Wire", "", 1)
    assert sorted(b["violations"][0] for b in bad.collect()) == ["kyc_level out of range", "timestamp missing", "transaction_id missing"]


def test_unknown_enum_is_rejected_without_normalising(spark):
    ok, bad = validate_contract(frame(spark, [tx(0), tx(1, transaction_type="Barter"), tx(2, kyc_level=4)]))
    assert ok.count() == 1 and {tuple(r["violations"]) for r in bad.collect()} == {("transaction_type unknown",), ("kyc_level out of range",)}


def alerts(spark):
    none = F.array().cast("array<string>")
    scores = spark.createDataFrame([("T1", 46.0, 1, "a"), ("T2", 60.0, 1, "b"), ("T3", 44.99, 2, "c"), ("T4", 45.0, 2, "d")], "transaction_id string, s double, community_id long, sender_account string")
    df = scores.withColumns({"rule_score": F.col("s"), "ensemble_anomaly_score": F.col("s"), "gnn_anomaly_score": F.col("s"), "sender_community_risk_score": F.col("s"),
                             "edge_creates_cycle": F.lit(False), "triggered_rules": F.array(F.lit("R01"), F.lit("R07")), "rule_explanations": F.array(F.lit("first"), F.lit("second")),
                             "anomaly_drivers": none, "structural_anomaly_explanations": none, "timestamp": F.lit(T0) + F.expr("make_interval(0, 0, 0, 0, 0, cast(substring(transaction_id, 2, 1) as int))")})
    return fusion.group_risk(fusion.create_alerts(fusion.fuse(df)))


def test_alert_files_tables_and_records(spark, tmp_path):
    a = alerts(spark).cache()
    got = {r["transaction_id"]: r for r in a.collect()}
    assert set(got) == {"T1", "T2", "T4"} and got["T4"]["risk_level"] == "Medium" and got["T2"]["risk_level"] == "Critical"
    assert [got[t]["group_risk_score"] for t in ("T1", "T2", "T4")] == [46.0, 60.0, 45.0]
    assert got["T1"]["explanation"] == "Transaction risk 46/100 (primary driver: gnn). first"
    sinks.write_alerts_csv(a, str(tmp_path / "csv"))
    sinks.write_alerts_csv(a, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["alert_id", "transaction_id", "sender_account", "community_id", "transaction_risk_score", "group_risk_score", "risk_level", "risk_level_group", "triggered_patterns",
                            "rule_explanations", "anomaly_drivers", "structural_anomaly_explanations", "explanation", "alert_status", "created_at"]
    assert back.count() == 6 and back.where("transaction_id = 'T1'").first()["triggered_patterns"] == "R01|R07"
    for _ in range(2):
        sinks.write_alerts_table(a, str(tmp_path / "t"), 3)
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.count() == 3 and json.loads(table.where("transaction_id = 'T1'").first()["triggered_patterns"]) == ["R01", "R07"]
    sinks.write_scored_jsonl(a, str(tmp_path / "j"))
    scored = readers.score_components(readers.read_scored_jsonl(spark, str(tmp_path / "j")))
    assert scored.where("transaction_id = 'T2'").first()["gnn"] == 60.0


def test_status_log_keeps_the_assignee(spark):
    a = alerts(spark)
    i = a.orderBy("transaction_id").first()["alert_id"]
    log = spark.createDataFrame([(i, "Investigating", "ann", T0), (i, "Closed", None, T0.replace(hour=12))], "alert_id string, status string, assigned_to string, updated_at timestamp")
    r = fusion.update_status(a, log).where(F.col("alert_id") == i).first()
    assert (r["alert_status"], r["assigned_to"], r["updated_at"]) == ("Closed", "ann", T0.replace(hour=12))
    n = {r["name"]: r["n"] for r in fusion.alert_counts(fusion.update_status(a, log)).collect()}
    assert n["total"] == 3 and n["Closed"] == 1 and n["SAR_Filed"] == 0 and n["Low"] == 0


def test_pattern_texts(spark):
    rows = [("1", "R01| R02"), ("2", "['R01', 'cycle_closure']"), ("3", "R09"), ("4", None), ("5", "")]
    a = spark.createDataFrame(rows, "transaction_id string, triggered_patterns string")
    t = spark.createDataFrame([("1",), ("3",)], "transaction_id string")
    got = {r["pattern"]: (r["triggered"], r["true_fraud"]) for r in V.rule_precision(a, t).collect()}
    assert got == {"R01": (2, 1), "R02": (1, 1), "cycle_closure": (1, 0), "R09": (1, 1)}


def test_alert_file_refuses_other_columns(spark, tmp_path):
    path = str(tmp_path / "other")
    spark.createDataFrame([("x", "y")], "alert_id string, note string").write.option("header", True).csv(path)
    rows = spark.range(1).select(*[F.lit("a").alias(c) for c in sinks.schemas.ALERT_COLUMNS])
    with pytest.raises(ValueError, match="other columns"):
        sinks.write_alerts_csv(rows, path)


def test_eval_frame_priorities(spark):
    t = spark.createDataFrame([(x, "r", "fan_in", "High") for x in ("a", "b", "c")], "transaction_id string, fraud_ring_id string, synthetic_pattern_type string, scenario_severity string")
    al = spark.createDataFrame([("a", 50.0, "Critical"), ("a", 70.0, "Critical"), ("x", 46.0, "Medium"), ("y", 47.0, "High")], "transaction_id string, transaction_risk_score double, risk_level string")
    sc = spark.createDataFrame([("a", 10.0, 0), ("b", 44.0, 1), ("x", 12.0, 0), ("z", 9.0, 0)], "transaction_id string, y_score double, y_pred int")
    got = {r["transaction_id"]: (r["y_true"], r["y_pred"], r["y_score"], r["risk_level"]) for r in V.eval_frame(t, al, sc).collect()}
    assert got == {"a": (1, 1, 70.0, "Critical"), "b": (1, 1, 44.0, None), "c": (1, 0, 0.0, None), "x": (0, 0, 12.0, None), "y": (0, 1, 47.0, "High"), "z": (0, 0, 9.0, None)}
    table = {(r["section"], r["name"], r["metric"]): r["value"] for r in V.evaluation_table(V.eval_frame(t, al, sc)).collect()}
    assert [table["dataset", "all", m] for m in ("n_total", "n_fraud", "n_normal", "n_alerted")] == [6, 3, 3, 3]
    assert table["operational", "all", "TP"] == 1 and table["threshold", "45.0", "TP"] == 1 and ("latency", "all", "n") not in table
    report = V.evaluation_report(V.eval_frame(t, al, sc), al.withColumn("triggered_patterns", F.lit("R01|R02")), t)
    assert report["operational_metrics"]["TP"] == 1 and len(report["threshold_sweep"]) == 101 and len(report["per_typology"]) == 10


def test_sequence_ids(spark):
    df = spark.range(50).select(((F.col("id") * 31) % 50).alias("t"))
    got = assign_sequence_ids(df.withColumn("transaction_id", F.lit("")), ["t"]).orderBy("t").collect()
    assert [r["transaction_id"] for r in got[:2]] == ["TXN_F00000001", "TXN_F00000002"]


def test_leading_digits(spark):
    from ledgerlens.functions.scalars import leading_digit, leading_digit_2dp
    vals = [0.0, -5.0, 0.05, 1.0, 9.99, 10.0, 999999.995, 1e12, 0.0000001]
    got = [tuple(r) for r in spark.createDataFrame([(v,) for v in vals], "v double").select(leading_digit(F.col("v")), leading_digit_2dp(F.col("v"))).collect()]
    assert [g[0] for g in got] == [1, 1, 5, 1, 9, 1, 9, 1, 1]
    assert [g[1] for g in got][:6] == [1, 1, 9, 1, 9, 1]
