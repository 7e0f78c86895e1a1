"""Ingest, rolling features, rules, profiles and samples as registered queries."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.functions import scalars as S
from ledgerlens.operators import ingest, profiles, rules
from ledgerlens.operators.rolling import FeatureConfig, feature_vector, rolling_features, rolling_features_after
from ledgerlens.plans import views
from ledgerlens.plans.registry import CTES, register, with_ctes
from ledgerlens.session import cut_lineage, shared_dir
from ledgerlens.sources.readers import read_transactions
from ledgerlens.sources.sinks import write_table

START = datetime(2024, 1, 1)

_DIGIT = """CASE WHEN {a} <= 0 THEN 1 ELSE greatest(1, CAST(substr(CAST(CAST(floor(CASE WHEN {a} >= 1 THEN {a} ELSE {a} * 1000000 END)
 AS BIGINT) AS VARCHAR), 1, 1) AS INTEGER)) END"""
_US = "(epoch_us({a}) - epoch_us({b}))"


# ---------------------------------------------------------------- ingest

@register("read_transactions", with_ctes(["txn"], """
SELECT transaction_id, epoch_us(timestamp) AS timestamp, sender_account, receiver_account, round(amount, 4) AS amount,
       transaction_type, payment_channel, transaction_status, kyc_level FROM txn"""))
def _read(spark, d):
    path = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    write_table(views.txn(spark, d), path)
    return read_transactions(spark, path).select("transaction_id", "timestamp", "sender_account", "receiver_account", "amount",
                                      "transaction_type", "payment_channel", "transaction_status", "kyc_level")


_RAW_TYPE = "CASE event_id % 7 WHEN 0 THEN 'transfer' WHEN 1 THEN 'Swift-Transfer' WHEN 2 THEN 'card' WHEN 3 THEN 'upi' WHEN 4 THEN 'wire' WHEN 5 THEN 'RTGS' ELSE 'barter' END"
_RAW_CHANNEL = "CASE event_id % 6 WHEN 0 THEN 'neft' WHEN 1 THEN 'upi' WHEN 2 THEN 'atm' WHEN 3 THEN 'Branch' WHEN 4 THEN 'swift' ELSE 'pigeon' END"
_RAW_STATUS = "CASE event_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'FAILURE' WHEN 2 THEN 'pending' WHEN 3 THEN 'failed' ELSE 'lost' END"


def _raw(spark, d):
    """Untyped event text with mixed time formats, as a feed would deliver it."""
    e = views.table(spark, d, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stamp = (F.when(F.col("event_id") % 3 == 0, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 3 == 1, iso)
             .otherwise(F.floor(micros / 1_000_000).cast("string")))
    text = lambda c: F.col(c).cast("string")
    return e.select(
        text("event_id").alias("transaction_id"), stamp.alias("timestamp"), text("user_id").alias("sender_account"),
        F.concat(F.lit("R"), text("user_id")).alias("receiver_account"), F.lit("IN").alias("sender_country"),
        F.when(F.col("event_id") % 2 == 0, "IN").otherwise("US").alias("receiver_country"), text("value").alias("amount"),
        F.expr(_RAW_TYPE).alias("transaction_type"), F.expr(_RAW_CHANNEL).alias("payment_channel"), F.expr(_RAW_STATUS).alias("transaction_status"),
        F.when(F.col("event_id") % 4 == 0, None).otherwise("dev").alias("device_id"), (F.col("event_id") % 5).cast("string").alias("kyc_level"))


_NORMALISED = f"""
SELECT CAST(event_id AS VARCHAR) AS transaction_id,
       CASE WHEN event_id % 3 < 2 THEN epoch_us(ts) ELSE CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000000 END AS timestamp,
       round(value, 4) AS amount,
       CASE {_RAW_TYPE} WHEN 'Swift-Transfer' THEN 'Wire' WHEN 'card' THEN 'Card' WHEN 'upi' THEN 'UPI' WHEN 'wire' THEN 'Wire'
            WHEN 'RTGS' THEN 'RTGS' ELSE 'NEFT' END AS transaction_type,
       CASE {_RAW_CHANNEL} WHEN 'upi' THEN 'Mobile' WHEN 'atm' THEN 'ATM' WHEN 'Branch' THEN 'Branch' ELSE 'Web' END AS payment_channel,
       CASE {_RAW_STATUS} WHEN 'FAILURE' THEN 'Failed' WHEN 'failed' THEN 'Failed' WHEN 'pending' THEN 'Pending' ELSE 'Success' END AS transaction_status,
       CASE WHEN event_id % 4 = 0 THEN '' ELSE 'dev' END AS device_id, CAST(event_id % 5 AS INTEGER) AS kyc_level,
       event_id % 2 <> 0 AS is_international, {_DIGIT.format(a='value')} AS amount_leading_digit FROM events"""
_OUT = ["transaction_id", "timestamp", "amount", "transaction_type", "payment_channel", "transaction_status",
        "device_id", "kyc_level", "is_international", "amount_leading_digit"]


@register("quarantined_events", f"""SELECT 'out of contract' AS why, count(*) AS n FROM ({_NORMALISED}) WHERE kyc_level > 3
UNION ALL SELECT 'parsed', count(*) FROM ({_NORMALISED}) WHERE kyc_level <= 3""")
def _quarantined(spark, d):
    """Both sides of the JSON reader: every payload is on one of them."""
    payloads = _raw(spark, d).select(F.to_json(F.struct("*")).alias("value"))
    good, bad = ingest.parse_json_events(payloads)
    count = lambda df, why: df.groupBy().agg(F.lit(why).alias("why"), F.count(F.lit(1)).alias("n"))
    return count(bad, "out of contract").unionByName(count(good, "parsed"))


@register("normalise_events", _NORMALISED)
def _normalise(spark, d):
    return ingest.normalise(_raw(spark, d)).select(*_OUT)


@register("parse_json_events", f"SELECT * FROM ({_NORMALISED}) WHERE kyc_level <= 3")
def _parse_json(spark, d):
    payloads = _raw(spark, d).select(F.to_json(F.struct("*")).alias("value"))
    return ingest.parse_json_events(payloads)[0].select(*_OUT)


@register("validate_contract", f"""SELECT transaction_id, CASE WHEN kyc_level > 3 THEN 'kyc_level out of range' ELSE '' END AS violations
FROM ({_NORMALISED})""")
def _validate(spark, d):
    good, bad = ingest.validate_contract(ingest.normalise(_raw(spark, d)))
    ok = good.select("transaction_id", F.array().cast("array<string>").alias("violations"))
    return ok.unionByName(bad.select("transaction_id", "violations"))


@register("leading_digits", f"""SELECT l_orderkey, l_linenumber, {_DIGIT.format(a='l_extendedprice')} AS digit, {_DIGIT.format(a='(l_discount / 10)')} AS digit_small,
 CASE WHEN l_tax <= 0 THEN 1 ELSE coalesce(nullif(CAST(nullif(substr(replace(ltrim(printf('%.2f', l_tax), '0'), '.', ''), 1, 1), '') AS INTEGER), 0), 9) END AS digit_2dp
FROM lineitem""")
def _digits(spark, d):
    li = views.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", S.leading_digit(F.col("l_extendedprice")).alias("digit"),
                     S.leading_digit(F.col("l_discount") / 10).alias("digit_small"), S.leading_digit_2dp(F.col("l_tax")).alias("digit_2dp"))


@register("benford_chi2_by_customer", f"""
SELECT o_custkey, round(CASE WHEN sum(c) < 5 THEN 0 ELSE sum(CAST(pow(c - n * log10(1 + 1.0 / digit), 2) / (n * log10(1 + 1.0 / digit) + 1e-9) AS DOUBLE)) END, 4) AS chi2
FROM (SELECT k.o_custkey, k.digit, coalesce(g.c, 0) AS c, sum(coalesce(g.c, 0)) OVER (PARTITION BY k.o_custkey) AS n
      FROM (SELECT DISTINCT o_custkey, digit FROM orders, range(1, 10) r(digit)) k
      LEFT JOIN (SELECT o_custkey, {_DIGIT.format(a='o_totalprice')} AS digit, count(*) AS c FROM orders GROUP BY 1, 2) g USING (o_custkey, digit))
GROUP BY o_custkey""")
def _benford(spark, d):
    o = views.table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(S.benford_chi2_agg(S.leading_digit(F.col("o_totalprice"))).alias("chi2"))


@register("enrich_with_accounts", """
SELECT o_orderkey, s.c_name AS sender_name, sn.n_name AS sender_country, r.c_name AS receiver_name, rn.n_name AS receiver_country,
       sn.n_name <> rn.n_name AS is_international, CASE WHEN sn.n_name = 'IN' THEN 'INR' ELSE 'USD' END AS currency
FROM orders JOIN customer s ON s.c_custkey = o_custkey JOIN nation sn ON sn.n_nationkey = s.c_nationkey
JOIN customer r ON r.c_custkey = o_orderkey % 100 JOIN nation rn ON rn.n_nationkey = r.c_nationkey""")
def _enrich(spark, d):
    c, n, o = (views.table(spark, d, t) for t in ("customer", "nation", "orders"))
    acc = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("account_id"), F.col("c_name").alias("account_name"), F.col("c_mktsegment").alias("bank"), F.col("n_name").alias("country"))
    t = o.select("o_orderkey", F.col("o_custkey").alias("sender_account"), (F.col("o_orderkey") % 100).alias("receiver_account"))
    return ingest.enrich_with_accounts(t, acc).select("o_orderkey", "sender_name", "sender_country", "receiver_name", "receiver_country", "is_international", "currency")


def labelled(spark, d):
    t = views.truth(spark, d)
    return views.txn(spark, d).join(t, "transaction_id", "left").withColumn("is_fraud", F.col("fraud_ring_id").isNotNull())


@register("split_history_stream", with_ctes(["txn", "truth"], """
SELECT 'history' AS part, count(*) AS n, round(sum(amount), 2) AS total FROM txn WHERE timestamp < TIMESTAMP '2024-01-21'
UNION ALL SELECT 'stream', count(*), round(sum(amount), 2) FROM txn WHERE timestamp >= TIMESTAMP '2024-01-21' AND timestamp < TIMESTAMP '2024-01-28'
UNION ALL SELECT 'truth', count(*), round(sum(amount), 2) FROM txn JOIN truth USING (transaction_id)
  WHERE timestamp >= TIMESTAMP '2024-01-21' AND timestamp < TIMESTAMP '2024-01-28'"""), total=2)
def _split(spark, d):
    parts = ingest.split_history_stream(labelled(spark, d), START, 20, 7)
    sums = [p.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
            for n, p in zip(("history", "stream", "truth"), parts)]
    return sums[0].union(sums[1]).union(sums[2])


@register("union_labelled_with_ids", with_ctes(["txn", "truth"], """
SELECT 'TXN_F' || lpad(CAST(row_number() OVER (ORDER BY timestamp, transaction_id) AS VARCHAR), 8, '0') AS transaction_id,
       transaction_id AS original_id, fraud_ring_id IS NOT NULL AS is_fraud FROM txn LEFT JOIN truth USING (transaction_id)"""))
def _union(spark, d):
    all_rows = labelled(spark, d)
    normal = all_rows.where("NOT is_fraud").drop("is_fraud", "fraud_ring_id", "synthetic_pattern_type", "scenario_severity")
    both = ingest.union_labelled(normal, all_rows.where("is_fraud")).withColumn("original_id", F.col("transaction_id"))
    return ingest.assign_sequence_ids(both, ["timestamp", "original_id"]).select("transaction_id", "original_id", "is_fraud")


@register("ring_summary", with_ctes(["txn", "truth"], """
, r AS (SELECT * FROM txn JOIN truth USING (transaction_id)),
m AS (SELECT fraud_ring_id, count(DISTINCT a) AS n_members FROM (SELECT fraud_ring_id, sender_account AS a FROM r UNION SELECT fraud_ring_id, receiver_account FROM r) GROUP BY 1)
SELECT fraud_ring_id, arg_min(sender_account, timestamp) AS entry_account, arg_max(receiver_account, timestamp) AS exit_account, count(*) AS num_hops,
       round(sum(amount), 2) AS total_value, any_value(n_members) AS n_members,
       CASE WHEN sum(amount) >= 5000000 THEN 'Critical' WHEN sum(amount) >= 1000000 THEN 'High' WHEN sum(amount) >= 200000 THEN 'Medium' ELSE 'Low' END AS severity
FROM r JOIN m USING (fraud_ring_id) GROUP BY fraud_ring_id""".lstrip()), total_value=2)
def _rings(spark, d):
    return ingest.ring_summary(labelled(spark, d))


@register("sanitise_nulls", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 4) END AS share FROM lineitem")
def _sanitise(spark, d):
    li = views.table(spark, d, "lineitem")
    share = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax") / F.col("l_discount"))
    return ingest.sanitise_nulls(li.select("l_orderkey", "l_linenumber", share.alias("share")))


# ---------------------------------------------------------------- rolling features

_W = {"1h": 3600, "6h": 21600, "24h": 86400, "7d": 604800, "30d": 2592000}
_in = lambda w: f"FILTER (WHERE age <= {_W[w] * 1_000_000})"
_HAV = "6371.0 * 2 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(t.geo_latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(t.geo_latitude)) * pow(sin(radians(t.geo_longitude - lon) / 2), 2)))))"

CTES["earlier"] = f"""
SELECT t.transaction_id AS id, t.sender_country AS sc, t.device_id AS my_device, {_US.format(a='t.timestamp', b='p.timestamp')} AS age,
       p.transaction_id AS pid, p.timestamp AS pts, p.amount, p.receiver_account AS recv, p.receiver_country AS ctry, p.device_id AS dev,
       p.ip_address AS ip, p.transaction_status AS st, p.geo_latitude AS lat, p.geo_longitude AS lon, {_DIGIT.format(a='p.amount')} AS dg,
       row_number() OVER (PARTITION BY t.transaction_id ORDER BY p.timestamp DESC, p.transaction_id DESC) AS back
FROM txn t JOIN txn p ON p.sender_account = t.sender_account
 AND (p.timestamp < t.timestamp OR (p.timestamp = t.timestamp AND p.transaction_id < t.transaction_id))"""
CTES["past"] = f"""
SELECT id, count(*) {_in('1h')} AS n1, count(*) {_in('6h')} AS n6, count(*) {_in('24h')} AS n24, count(*) {_in('7d')} AS n7, count(*) {_in('30d')} AS n30,
       avg(amount) {_in('7d')} AS avg7, stddev_pop(amount) {_in('7d')} AS std7, max(amount) {_in('7d')} AS max7, min(amount) {_in('7d')} AS min7,
       sum(amount) {_in('30d')} AS sum30, avg(CASE WHEN hour(pts) >= 22 OR hour(pts) <= 5 THEN 1.0 ELSE 0 END) {_in('7d')} AS night,
       avg(CASE WHEN isodow(pts) >= 6 THEN 1.0 ELSE 0 END) {_in('7d')} AS weekend, avg(CASE WHEN st = 'Success' THEN 1.0 ELSE 0 END) {_in('7d')} AS ok,
       count(DISTINCT recv) {_in('7d')} AS ben7, count(DISTINCT recv) {_in('30d')} AS ben30, count(DISTINCT dev) {_in('7d')} AS dev7,
       count(DISTINCT ip) {_in('24h')} AS ip24, count(*) FILTER (WHERE age <= {_W['30d'] * 1_000_000} AND ctry <> sc) AS abroad,
       max(pts) AS prev_ts, max(lat) FILTER (WHERE back = 1) AS lat, max(lon) FILTER (WHERE back = 1) AS lon, count(*) FILTER (WHERE dev = my_device) AS same_dev,
       {', '.join(f'count(*) FILTER (WHERE back <= 200 AND dg = {k}) AS d{k}' for k in range(1, 10))}
FROM earlier GROUP BY id"""
CTES["switches"] = f"""SELECT id, count(*) FILTER (WHERE prev <> ctry) AS sw FROM (SELECT id, ctry, lag(ctry) OVER (PARTITION BY id ORDER BY pts, pid) AS prev
FROM earlier WHERE age <= {_W['7d'] * 1_000_000}) GROUP BY id"""
CTES["entropy"] = f"""SELECT id, -sum(c / n * log2(c / n + 1e-12)) AS ent FROM (SELECT id, recv, CAST(count(*) AS DOUBLE) AS c, CAST(sum(count(*)) OVER (PARTITION BY id) AS DOUBLE) AS n
FROM earlier WHERE age <= {_W['7d'] * 1_000_000} GROUP BY id, recv) GROUP BY id"""
CTES["sharing"] = """SELECT t.transaction_id AS id, count(DISTINCT p.sender_account) AS shared FROM txn t JOIN txn p ON p.device_id = t.device_id
 AND (p.timestamp < t.timestamp OR (p.timestamp = t.timestamp AND p.transaction_id < t.transaction_id)) GROUP BY 1"""
_N = "(" + " + ".join(f"d{k}" for k in range(1, 10)) + ")"
_CHI = " + ".join(f"pow(d{k} - {_N} * log10(1 + 1.0 / {k}), 2) / ({_N} * log10(1 + 1.0 / {k}) + 1e-9)" for k in range(1, 10))
_DEFS = {
    "tx_velocity_1h": "coalesce(n1, 0)", "tx_velocity_6h": "coalesce(n6, 0)", "tx_velocity_24h": "coalesce(n24, 0)", "tx_velocity_7d": "coalesce(n7, 0)",
    "avg_amount_7d": "coalesce(avg7, 0)", "std_amount_7d": "coalesce(std7, 0)",
    "tx_gap_seconds": "coalesce((epoch_us(t.timestamp) - epoch_us(prev_ts)) / 1000000.0, 86400)", "night_tx_ratio": "coalesce(night, 0)",
    "weekend_tx_ratio": "coalesce(weekend, 0)", "hour_of_day": "hour(t.timestamp)", "day_of_week": "isodow(t.timestamp) - 1",
    "beneficiary_count_7d": "coalesce(ben7, 0)", "beneficiary_count_30d": "coalesce(ben30, 0)", "receiver_entropy": "coalesce(ent, 0)",
    "amount_zscore": "CASE WHEN coalesce(std7, 0) > 0 THEN (t.amount - avg7) / (std7 + 1e-6) ELSE 0 END", "avg_daily_volume_30d": "coalesce(sum30, 0) / 30",
    "round_amount_flag": "CASE WHEN t.amount >= 100000 AND t.amount % 100000 = 0 THEN 1 ELSE 0 END",
    "sub_threshold_flag": "CASE WHEN t.amount >= 850000 AND t.amount < 1000000 THEN 1 ELSE 0 END", "amount_leading_digit": _DIGIT.format(a="t.amount"),
    "benford_chi2_score": f"CASE WHEN coalesce({_N}, 0) >= 5 THEN {_CHI} ELSE 0 END", "geo_distance_km": f"CASE WHEN lat IS NULL THEN 0 ELSE {_HAV} END",
    "country_switch_count_7d": "coalesce(sw, 0)",
    "impossible_travel_flag": f"CASE WHEN lat IS NOT NULL AND t.timestamp > prev_ts AND {_HAV} / ((epoch_us(t.timestamp) - epoch_us(prev_ts)) / 3600000000.0) > 900 THEN 1 ELSE 0 END",
    "high_risk_country_flag": "CASE WHEN t.sender_country IN ('AE','MU','CN','NG','PK','CH') OR t.receiver_country IN ('AE','MU','CN','NG','PK','CH') THEN 1 ELSE 0 END",
    "cross_border_ratio_30d": "CASE WHEN coalesce(n30, 0) > 0 THEN abroad / n30 ELSE 0 END", "device_change_count_7d": "coalesce(dev7, 0)",
    "new_device_flag": "CASE WHEN coalesce(same_dev, 0) = 0 THEN 1 ELSE 0 END", "shared_device_count": "coalesce(shared, 0)",
    "ip_change_count_24h": "coalesce(ip24, 0)", "kyc_level": "t.kyc_level", "amount_ratio_7d": "CASE WHEN coalesce(avg7, 0) > 0 THEN t.amount / avg7 ELSE 1 END",
    "balance_utilization": "t.amount / (t.amount + 1)", "same_bank_flag": "CASE WHEN t.sender_bank = t.receiver_bank THEN 1 ELSE 0 END",
    "is_international": "CASE WHEN t.sender_country <> t.receiver_country THEN 1 ELSE 0 END",
    "tx_type_encoded": "CASE t.transaction_type WHEN 'UPI' THEN 4 WHEN 'Wire' THEN 3 WHEN 'IMPS' THEN 2 ELSE 0 END",
    "channel_encoded": "CASE t.payment_channel WHEN 'Web' THEN 1 WHEN 'ATM' THEN 2 WHEN 'Branch' THEN 3 ELSE 0 END",
    "hour_sin": "sin(2 * pi() * hour(t.timestamp) / 24)", "hour_cos": "cos(2 * pi() * hour(t.timestamp) / 24)",
    "dow_sin": "sin(2 * pi() * (isodow(t.timestamp) - 1) / 7)", "dow_cos": "cos(2 * pi() * (isodow(t.timestamp) - 1) / 7)", "day_of_month": "day(t.timestamp)",
    "success_rate_7d": "coalesce(ok, 1)", "max_amount_7d": "coalesce(max7, t.amount)", "min_amount_7d": "coalesce(min7, t.amount)",
    "amount_to_max_ratio": "CASE WHEN coalesce(max7, t.amount) > 0 THEN t.amount / coalesce(max7, t.amount) ELSE 1 END",
}
CTES["feat"] = f"""SELECT t.transaction_id, t.timestamp, t.sender_account, t.receiver_account, t.amount, {', '.join(f'CAST({_DEFS[f]} AS DOUBLE) AS {f}' for f in schemas.FEATURES)}
FROM txn t LEFT JOIN past p ON p.id = t.transaction_id LEFT JOIN switches s ON s.id = t.transaction_id
LEFT JOIN entropy e ON e.id = t.transaction_id LEFT JOIN sharing h ON h.id = t.transaction_id"""
FEAT = ["txn", "earlier", "past", "switches", "entropy", "sharing", "feat"]
_ROUNDED = ", ".join(f"round({f} + 1e-7, 4) + 0.0 AS {f}" for f in schemas.FEATURES)


@register("rolling_features", with_ctes(FEAT, f"SELECT transaction_id, {_ROUNDED} FROM feat"), nudge=True)
def _features(spark, d):
    return rolling_features(views.txn(spark, d)).select("transaction_id", *schemas.FEATURES)


@register("warm_start_features", with_ctes(FEAT, f"SELECT transaction_id, {_ROUNDED} FROM feat WHERE timestamp >= TIMESTAMP '2024-01-21'"), nudge=True)
def _warm(spark, d):
    t = views.txn(spark, d)
    cut = F.lit("2024-01-21").cast("timestamp")
    return rolling_features_after(t.where(F.col("timestamp") < cut), t.where(F.col("timestamp") >= cut)).select("transaction_id", *schemas.FEATURES)


_POSITIONS = ", ".join(f"round({f} + 1e-7, 4) + 0.0 AS v{i}" for i, f in enumerate(schemas.FEATURES))


@register("feature_vector", with_ctes(FEAT, f"SELECT transaction_id, 45 AS n, {_POSITIONS} FROM feat"), nudge=True)
def _vector(spark, d):
    v = feature_vector(rolling_features(views.txn(spark, d)))
    return v.select("transaction_id", F.size("features").alias("n"), *[F.col("features")[i].alias(f"v{i}") for i in range(len(schemas.FEATURES))])


# ---------------------------------------------------------------- rules

RULES = [
    ("R01", "1.0", "amount > 1000000"), ("R02", "1.0", "sub_threshold_flag = 1 AND tx_velocity_1h >= 3"),
    ("R03", "0.8", "tx_velocity_1h > 10 OR tx_velocity_24h > 50"), ("R04", "0.9", "tx_gap_seconds > 15552000 AND amount > 100000"),
    ("R05", "CASE WHEN geo_distance_km > 5000 THEN 0.9 WHEN geo_distance_km > 2000 THEN 0.75 ELSE 0.6 END", "impossible_travel_flag = 1"),
    ("R06", "0.7", "high_risk_country_flag = 1 AND is_international = 1"), ("R07", "0.6", "new_device_flag = 1 AND amount > 200000"),
    ("R08", "0.7", "shared_device_count > 5"), ("R09", "0.8", "beneficiary_count_7d > 20"),
    ("R10", "CASE WHEN cycle_length <= 3 THEN 1.0 ELSE 0.85 END", "cycle_length > 0"), ("R11", "0.6", "round_amount_flag = 1 AND tx_velocity_24h > 5"),
    ("R12", "0.8", "kyc_level = 0 AND amount > 500000"), ("R13", "0.7", "benford_chi2_score > 3.84"),
    ("R14", "0.8", "receiver_in_degree_unique >= 3"), ("R15", "0.9", "sender_in_degree >= 1 AND amount >= 500000"),
]
_GRAPH_RULES = ("R10", "R14", "R15")


def rules_sql(table: str, graph: bool, cols: str = "transaction_id") -> str:
    use = [r for r in RULES if graph or r[0] not in _GRAPH_RULES]
    total = " + ".join(f"CASE WHEN {p} THEN CAST({w} AS DOUBLE) ELSE 0 END" for _, w, p in use)
    ids = ", ".join(f"CASE WHEN {p} THEN '{i}' END" for i, _, p in use)
    count = " + ".join(f"CASE WHEN {p} THEN 1 ELSE 0 END" for _, _, p in use)
    return f"SELECT {cols}, least(100.0, round(({total}) / 12.2 * 100, 2)) AS rule_score, concat_ws('|', {ids}) AS triggered_rules, {count} AS rule_count FROM {table}"


@register("rules_without_graph", with_ctes(FEAT, rules_sql("feat", False)))
def _rules(spark, d):
    return rules.evaluate_rules(rolling_features(views.txn(spark, d))).select("transaction_id", "rule_score", "triggered_rules", "rule_count")


_BURSTS = {"txn": views.BURSTS_SQL}


@register("rolling_features_busy", with_ctes(FEAT, f"SELECT transaction_id, {_ROUNDED} FROM feat", _BURSTS), nudge=True)
def _features_busy(spark, d):
    """Senders with over a thousand rows a month, so that the running plan is used."""
    return rolling_features(views.bursts(spark, d)).select("transaction_id", *schemas.FEATURES)


@register("rolling_features_one_plan", with_ctes(FEAT, f"SELECT transaction_id, {_ROUNDED} FROM feat"), nudge=True)
def _features_one_plan(spark, d):
    """The same rows as ``rolling_features``, all by the running plan."""
    return rolling_features(views.txn(spark, d), FeatureConfig(busy_rows=1)).select("transaction_id", *schemas.FEATURES)


@register("rules_busy", with_ctes(FEAT, rules_sql("feat", False), _BURSTS))
def _rules_busy(spark, d):
    """Bursts, dispersion and dormant accounts: R02, R03, R04 and R09 fire here."""
    return rules.evaluate_rules(rolling_features(views.bursts(spark, d))).select("transaction_id", "rule_score", "triggered_rules", "rule_count")


@register("riskiest_accounts", with_ctes(FEAT, f"""
SELECT sender_account, round(max(rule_score), 4) AS top_score, sum(rule_count)::BIGINT AS fired, count(*) AS n FROM ({rules_sql('feat', False, 'sender_account')})
GROUP BY sender_account"""))
def riskiest_accounts(spark, d):
    """Which accounts fire most rules, in that order."""
    scored = rules.evaluate_rules(rolling_features(views.txn(spark, d)))
    return scored.groupBy("sender_account").agg(
        F.max("rule_score").alias("top_score"), F.sum(F.col("rule_count").cast("bigint")).alias("fired"), F.count(F.lit(1)).alias("n")
    ).orderBy(F.col("fired").desc(), "sender_account")


# ---------------------------------------------------------------- profiles and samples

_PROFILE = """SELECT sender_account AS account_id, count(*) AS tx_count, round(sum(amount), 2) AS total_sent, round(avg(amount), 4) AS mean_amount,
 round(coalesce(stddev_samp(amount), 0), 4) AS std_amount, round(max(amount), 4) AS max_amount, round(min(amount), 4) AS min_amount,
 count(DISTINCT receiver_account) AS unique_receivers, count(DISTINCT receiver_bank) AS unique_banks, count(DISTINCT receiver_country) AS unique_countries,
 round(avg(CASE WHEN hour(timestamp) <= 5 OR hour(timestamp) >= 22 THEN 1.0 ELSE 0 END), 4) AS night_tx_ratio,
 round(avg(CASE WHEN isodow(timestamp) >= 6 THEN 1.0 ELSE 0 END), 4) AS weekend_tx_ratio, round(avg(CASE WHEN transaction_status = 'Success' THEN 1.0 ELSE 0 END), 4) AS success_rate,
 count(*) FILTER (WHERE amount < 1000000) AS sub_threshold_count FROM txn GROUP BY 1"""


@register("account_profiles", with_ctes(["txn"], f""", p AS ({_PROFILE}),
ch AS (SELECT account_id, v FROM (SELECT sender_account AS account_id, payment_channel AS v, row_number() OVER (PARTITION BY sender_account ORDER BY count(*) DESC, payment_channel) AS r FROM txn GROUP BY 1, 2) WHERE r = 1),
co AS (SELECT account_id, v FROM (SELECT sender_account AS account_id, receiver_country AS v, row_number() OVER (PARTITION BY sender_account ORDER BY count(*) DESC, receiver_country) AS r FROM txn GROUP BY 1, 2) WHERE r = 1)
SELECT p.*, ch.v AS primary_channel, co.v AS primary_country, CASE WHEN tx_count > 1000 OR max_amount > 5000000 THEN 'elevated'
 WHEN night_tx_ratio > 0.5 OR unique_countries > 5 THEN 'suspicious' ELSE 'normal' END AS risk_tier
FROM p JOIN ch USING (account_id) JOIN co USING (account_id)"""), total_sent=2)
def _profiles(spark, d):
    return profiles.account_profiles(views.txn(spark, d))


@register("order_account_profiles", """
SELECT 'C' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS account_id, count(*) AS tx_count, round(sum(o_totalprice), 2) AS total_sent,
       round(coalesce(stddev_samp(o_totalprice), 0), 4) AS std_amount, count(*) FILTER (WHERE o_totalprice < 1000000) AS sub_threshold_count
FROM orders GROUP BY 1""", total_sent=2)
def _order_profiles(spark, d):
    t = views.ledger(spark, d).withColumns({"receiver_bank": F.lit("B"), "receiver_country": F.lit("IN"), "payment_channel": F.lit("Web"), "transaction_status": F.lit("Success")})
    return profiles.account_profiles(t).select("account_id", "tx_count", "total_sent", "std_amount", "sub_threshold_count")


@register("account_profile_lookup", with_ctes(["txn"], f"SELECT account_id, tx_count, total_sent, unique_receivers FROM ({_PROFILE}) WHERE account_id = (SELECT max(sender_account) FROM txn)"), total_sent=2)
def _profile_lookup(spark, d):
    t = views.txn(spark, d)
    last = t.agg(F.max("sender_account")).first()[0]
    return profiles.account_profile(profiles.account_profiles(t), last).select("account_id", "tx_count", "total_sent", "unique_receivers")


_H = "md5('{seed}:' || transaction_id)"


@register("sample_transactions", with_ctes(["txn"], f"SELECT transaction_id FROM txn ORDER BY {_H.format(seed=42)}, transaction_id LIMIT 500"))
def _sample(spark, d):
    return profiles.sample_transactions(views.txn(spark, d), 500).select("transaction_id")


@register("sample_per_account", with_ctes(["txn"], f"""
SELECT transaction_id, sender_account FROM (SELECT *, row_number() OVER (PARTITION BY sender_account ORDER BY {_H.format(seed=42)}, transaction_id) AS r FROM txn)
WHERE r <= 5 ORDER BY {_H.format(seed=43)}, transaction_id LIMIT 400"""))
def _sample_account(spark, d):
    return profiles.sample_per_account(views.txn(spark, d), 5, 400).select("transaction_id", "sender_account")


@register("ordered_eval_sample", with_ctes(FEAT + ["truth"], f"""
, n AS (SELECT transaction_id, tx_velocity_7d FROM (SELECT *, row_number() OVER (PARTITION BY sender_account ORDER BY {_H.format(seed=42)}, transaction_id) AS r
 FROM feat WHERE transaction_id NOT IN (SELECT transaction_id FROM truth)) WHERE r <= 10 ORDER BY {_H.format(seed=43)}, transaction_id LIMIT 3000)
SELECT transaction_id, tx_velocity_7d, 0 AS y_true FROM n UNION ALL SELECT transaction_id, tx_velocity_7d, 1 FROM feat JOIN truth USING (transaction_id)"""))
def _eval_sample(spark, d):
    return profiles.ordered_eval_sample(rolling_features(views.txn(spark, d)), views.truth(spark, d)).select("transaction_id", "tx_velocity_7d", "y_true")


_SCALED = ["amount_zscore", "tx_velocity_7d", "receiver_entropy", "amount_leading_digit", "sub_threshold_flag"]
_STATS = "SELECT " + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in _SCALED) + " FROM feat"


@register("scaled_features", with_ctes(FEAT, f""", st AS ({_STATS}) SELECT transaction_id, {', '.join(f'round(({c} - m_{c}) / s_{c}, 4) + 0.0 AS {c}' for c in _SCALED)} FROM feat, st"""))
def _scale(spark, d):
    f = cut_lineage(profiles.finite_rows(rolling_features(views.txn(spark, d)), _SCALED))
    return profiles.apply_scaler(f, profiles.fit_scaler(f, _SCALED)).select("transaction_id", *_SCALED)


@register("anomaly_drivers", with_ctes(FEAT, f""", st AS ({_STATS}), z AS (SELECT transaction_id, unnest([{', '.join(f"{{'a': abs(({c} - m_{c}) / s_{c}), 'i': {i}, 'n': '{c}'}}" for i, c in enumerate(_SCALED))}]) AS v FROM feat, st)
SELECT transaction_id, string_agg(v.n, '|' ORDER BY r) AS drivers FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY v.a DESC, v.i DESC) AS r FROM z) WHERE r <= 3 GROUP BY transaction_id"""))
def _drivers(spark, d):
    f = cut_lineage(rolling_features(views.txn(spark, d)))
    scaled = profiles.apply_scaler(f, profiles.fit_scaler(f, _SCALED))
    return scaled.select("transaction_id", profiles.top_drivers(_SCALED).alias("drivers"))


@register("train_val_split", with_ctes(["txn"], f"""SELECT transaction_id, CASE WHEN CAST('0x' || substr({_H.format(seed=42)}, 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'val' ELSE 'train' END AS part FROM txn"""))
def _split_train(spark, d):
    train, val = profiles.train_val_split(views.txn(spark, d))
    return train.select("transaction_id", F.lit("train").alias("part")).union(val.select("transaction_id", F.lit("val").alias("part")))


@register("feature_drift_report", with_ctes(FEAT + ["truth"], f""", st AS ({_STATS}), b AS (SELECT f.*, CASE WHEN t.transaction_id IS NOT NULL THEN 'fraud' WHEN f.timestamp < TIMESTAMP '2024-01-21' THEN 'train' ELSE 'normal' END AS bucket
 FROM feat f LEFT JOIN truth t USING (transaction_id)), z AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, bucket, abs(({c} - m_{c}) / s_{c}) AS v FROM b, st" for c in _SCALED)})
SELECT feature, round(avg(v) FILTER (WHERE bucket = 'train'), 4) AS train, round(avg(v) FILTER (WHERE bucket = 'normal'), 4) AS normal, round(avg(v) FILTER (WHERE bucket = 'fraud'), 4) AS fraud,
 greatest(avg(v) FILTER (WHERE bucket = 'normal'), avg(v) FILTER (WHERE bucket = 'fraud')) > 5 AS blows_up FROM z GROUP BY feature"""))
def _drift(spark, d):
    f = cut_lineage(rolling_features(views.txn(spark, d)))
    ids = views.truth(spark, d).select("transaction_id", F.lit(1).alias("_t"))
    bucket = F.when(F.col("_t") == 1, "fraud").when(F.col("timestamp") < F.lit("2024-01-21").cast("timestamp"), "train").otherwise("normal")
    scaled = profiles.apply_scaler(f, profiles.fit_scaler(f, _SCALED))
    return profiles.feature_drift_report(scaled.join(ids, "transaction_id", "left").withColumn("bucket", bucket), "bucket", _SCALED)
