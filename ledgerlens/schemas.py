"""Column contracts of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Fixed values, as are the layouts below: the field names that feeds and stored tables use.
TXN = _struct(
    ("transaction_id", _S), ("timestamp", T.TimestampType()),
    ("sender_account", _S), ("receiver_account", _S),
    ("sender_name", _S), ("receiver_name", _S),
    ("sender_bank", _S), ("receiver_bank", _S),
    ("sender_country", _S), ("receiver_country", _S),
    ("amount", _D), ("currency", _S),
    ("transaction_type", _S), ("payment_channel", _S),
    ("device_id", _S), ("ip_address", _S),
    ("geo_latitude", _D), ("geo_longitude", _D),
    ("merchant_category", _S), ("transaction_status", _S),
    ("sender_balance_before", _D), ("sender_balance_after", _D),
    ("receiver_balance_before", _D), ("receiver_balance_after", _D),
    ("kyc_level", _I), ("is_international", _B),
    ("remarks", _S), ("amount_leading_digit", _I),
)

# Payloads arrive untyped: every scalar is read as text, then normalised.
RAW_TXN = T.StructType([T.StructField(f.name, _S, True) for f in TXN.fields])

LABELS = _struct(
    ("is_fraud", _B), ("fraud_ring_id", _S),
    ("synthetic_pattern_type", _S), ("scenario_severity", _S),
)
TXN_LABELLED = T.StructType(TXN.fields + LABELS.fields)

ACCOUNT = _struct(
    ("account_id", _S), ("account_name", _S), ("bank", _S), ("country", _S),
    ("kyc_level", _I), ("initial_balance", _D), ("device_id", _S), ("ip_address", _S),
    ("geo_latitude", _D), ("geo_longitude", _D), ("account_age_days", _I), ("activity_weight", _D),
)

BREAKDOWN = _struct(
    ("rule", _D), ("behavioral", _D), ("gnn", _D), ("graph_boost", _D),
    ("weights", _struct(("rule", _D), ("behavioral", _D), ("gnn", _D), ("graph", _D))),
)

SCORED = _struct(
    ("transaction_id", _S), ("sender_account", _S),
    ("transaction_risk_score", _D), ("risk_level", _S),
    ("triggered_patterns", T.ArrayType(_S)), ("score_breakdown", BREAKDOWN),
)

# The alert file layout other tools read.
ALERT_COLUMNS = [
    "alert_id", "transaction_id", "sender_account", "community_id",
    "transaction_risk_score", "group_risk_score", "risk_level", "risk_level_group",
    "triggered_patterns", "rule_explanations", "anomaly_drivers",
    "structural_anomaly_explanations", "explanation", "alert_status", "created_at",
]

# The 45 rolling features in their contract order.
FEATURES = [
    "tx_velocity_1h", "tx_velocity_6h", "tx_velocity_24h", "tx_velocity_7d",
    "avg_amount_7d", "std_amount_7d", "tx_gap_seconds", "night_tx_ratio",
    "weekend_tx_ratio", "hour_of_day", "day_of_week",
    "beneficiary_count_7d", "beneficiary_count_30d", "receiver_entropy",
    "amount_zscore", "avg_daily_volume_30d", "round_amount_flag",
    "sub_threshold_flag", "amount_leading_digit", "benford_chi2_score",
    "geo_distance_km", "country_switch_count_7d", "impossible_travel_flag",
    "high_risk_country_flag", "cross_border_ratio_30d",
    "device_change_count_7d", "new_device_flag", "shared_device_count",
    "ip_change_count_24h",
    "kyc_level", "amount_ratio_7d", "balance_utilization", "same_bank_flag",
    "is_international", "tx_type_encoded", "channel_encoded",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    "day_of_month", "success_rate_7d", "max_amount_7d", "min_amount_7d",
    "amount_to_max_ratio",
]
# The graph columns a model row takes besides.
GRAPH_FEATURES = [
    "pagerank", "betweenness", "fan_in_score", "fan_out_score",
    "community_density", "benford_chi2_community", "volume_asymmetry",
]
