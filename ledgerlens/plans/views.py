"""Transaction tables derived from the given star-schema tables.

The projections are plain SQL understood by Spark and by the checking engine,
so both sides start from the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import use_utc

_V = "VARCHAR(20)"
# Receivers grow with the senders: groups of 97, joined by every eleventh payment.
_RECEIVER = ("((user_id * 17 + (event_id % 11) * 13 + 1) % 97"
             " + CASE WHEN event_id % 11 = 0 THEN 0 ELSE user_id - user_id % 97 END)")
COUNTRIES = ["NL", "AE", "BR", "CH", "KE", "MU", "FI", "PK", "CA", "AT"]


def _country(number: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{code}'" for i, code in enumerate(COUNTRIES))
    return f"CASE CAST({number} % {len(COUNTRIES)} AS INT) {cases} END"


TXN_SQL = f"""
SELECT concat('T', lpad(CAST(event_id AS {_V}), 10, '0')) AS transaction_id,
       ts AS timestamp,
       concat('A', lpad(CAST(user_id AS {_V}), 6, '0')) AS sender_account,
       concat('A', lpad(CAST({_RECEIVER} AS {_V}), 6, '0')) AS receiver_account,
       concat('B', CAST(user_id % 8 AS {_V})) AS sender_bank,
       concat('B', CAST({_RECEIVER} % 8 AS {_V})) AS receiver_bank,
       {_country("user_id")} AS sender_country,
       {_country(_RECEIVER)} AS receiver_country,
       CASE WHEN event_id % 9 = 0 THEN ceil(value / 5.0) * 100000.0 ELSE round(value * 20000.0, 2) END AS amount,
       CASE event_type WHEN 'click' THEN 'NEFT' WHEN 'view' THEN 'UPI' WHEN 'error' THEN 'Wire' ELSE 'IMPS' END
           AS transaction_type,
       CASE event_id % 4 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Web' WHEN 2 THEN 'ATM' ELSE 'Branch' END
           AS payment_channel,
       concat('D', regexp_extract(props, '([0-9]+)', 1)) AS device_id,
       concat('10.0.0.', CAST(event_id % 5 AS {_V})) AS ip_address,
       CAST(20.0 + (event_id % 7) * 9.0 AS DOUBLE) AS geo_latitude,
       CAST(70.0 - (event_id % 7) * 20.0 AS DOUBLE) AS geo_longitude,
       CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Success' END AS transaction_status,
       CAST(user_id % 4 AS INT) AS kyc_level
FROM events
"""

# Payments between customers of the same group of 12, from orders: many separate
# communities; every third group only ever pays forward, so it has no cycles.
LEDGER_SQL = f"""
SELECT concat('O', lpad(CAST(o_orderkey AS {_V}), 10, '0')) AS transaction_id,
       o_orderdate AS timestamp,
       concat('C', lpad(CAST(o_custkey AS {_V}), 8, '0')) AS sender_account,
       CASE WHEN CAST(floor(o_custkey / 12) AS BIGINT) % 3 = 0
            THEN CASE WHEN o_custkey % 12 + 1 + o_orderkey % 3 > 11
                      THEN concat('X', lpad(CAST(CAST(floor(o_custkey / 12) AS BIGINT) AS {_V}), 8, '0'))
                      ELSE concat('C', lpad(CAST(o_custkey + 1 + o_orderkey % 3 AS {_V}), 8, '0')) END
            ELSE concat('C', lpad(CAST(o_custkey - o_custkey % 12 + (o_orderkey * 5 + 3) % 12 AS {_V}), 8, '0'))
       END AS receiver_account,
       o_totalprice AS amount,
       o_orderkey % 37 = 0 AS is_fraud
FROM orders
"""

# Busy senders of 1,200 orders each: three payments at a time, fifteen an hour over some days, to forty
# receivers, many just below the reporting threshold; then 200 days of silence, then hourly ones.
_TURN = "(o_orderkey % 1200)"
BURSTS_SQL = f"""
SELECT concat('O', lpad(CAST(o_orderkey AS {_V}), 10, '0')) AS transaction_id,
       TIMESTAMP '2023-01-01 00:00:00' + CAST(CASE WHEN {_TURN} < 1100 THEN ({_TURN} - {_TURN} % 3) * 240
            ELSE 17280000 + {_TURN} * 3600 END AS INT) * INTERVAL '1' SECOND AS timestamp,
       concat('L', lpad(CAST(o_orderkey - {_TURN} AS {_V}), 10, '0')) AS sender_account,
       concat('P', CAST(o_custkey % 40 AS {_V})) AS receiver_account,
       concat('B', CAST(o_orderkey % 8 AS {_V})) AS sender_bank,
       concat('B', CAST(o_custkey % 8 AS {_V})) AS receiver_bank,
       {_country("(o_orderkey - o_orderkey % 1200)")} AS sender_country,
       {_country("o_custkey")} AS receiver_country,
       CASE WHEN o_orderkey % 5 = 0 THEN 900000.0 + o_custkey ELSE round(CAST(o_totalprice AS DOUBLE) * 3.0, 2) END AS amount,
       CASE o_orderkey % 3 WHEN 0 THEN 'NEFT' WHEN 1 THEN 'UPI' ELSE 'Wire' END AS transaction_type,
       CASE o_orderkey % 2 WHEN 0 THEN 'Mobile' ELSE 'Branch' END AS payment_channel,
       concat('D', CAST(o_custkey % 25 AS {_V})) AS device_id,
       concat('10.0.1.', CAST(o_custkey % 9 AS {_V})) AS ip_address,
       CAST(10.0 + (o_custkey % 6) * 8.0 AS DOUBLE) AS geo_latitude,
       CAST(5.0 + (o_custkey % 6) * 11.0 AS DOUBLE) AS geo_longitude,
       CASE WHEN o_orderkey % 11 = 0 THEN 'Failed' ELSE 'Success' END AS transaction_status,
       CAST(o_orderkey % 4 AS INT) AS kyc_level
FROM orders
"""

TRUTH_SQL = f"""
SELECT transaction_id,
       concat('RING_', CAST(event_id % 13 AS {_V})) AS fraud_ring_id,
       CASE event_id % 5 WHEN 0 THEN 'structuring' WHEN 1 THEN 'fan_in' WHEN 2 THEN 'fan_out'
            WHEN 3 THEN 'layering_chain' ELSE 'velocity_burst' END AS synthetic_pattern_type,
       'High' AS scenario_severity
FROM (SELECT t.*, CAST(substr(transaction_id, 2) AS BIGINT) AS event_id FROM txn t) x
WHERE event_id % 29 = 0
"""

SCORED_SQL = """
SELECT transaction_id,
       round(CAST((event_id * 37) % 1000 AS DOUBLE) / 20.0
             + CASE WHEN event_id % 29 = 0 THEN 30.0 ELSE 0.0 END, 2) AS y_score,
       CAST((event_id * 37) % 1000 AS DOUBLE) / 10.0 AS rule,
       CAST((event_id * 53) % 1000 AS DOUBLE) / 10.0 AS behavioral,
       CAST((event_id * 71) % 1000 AS DOUBLE) / 10.0 AS gnn,
       CAST((event_id * 91) % 1000 AS DOUBLE) / 10.0 AS graph_boost
FROM (SELECT transaction_id, CAST(substr(transaction_id, 2) AS BIGINT) AS event_id FROM txn) x
"""

# For the evaluation's outer join alone: labels without a stored score, so that every case of it
# (unscored label, scored normal, alert) occurs.
STORED_SQL = "SELECT * FROM scored WHERE CAST(substr(transaction_id, 2) AS BIGINT) % 3 <> 1"
ALERTS_SQL = "SELECT transaction_id, y_score AS transaction_risk_score FROM stored WHERE y_score >= 45"


def _project(df: DataFrame, sql: str, source: str) -> DataFrame:
    """Run a one-table SELECT over ``df`` without registering a view."""
    return df.sparkSession.sql(sql.replace(f"FROM {source}", "FROM {src}"), src=df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _project(table(spark, sf_dir, "orders"), BURSTS_SQL, "orders")
    return view.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("amount", F.col("amount").cast("double"))


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _project(table(spark, sf_dir, "events"), TXN_SQL, "events")
    return view.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn(
        "amount", F.col("amount").cast("double"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _project(table(spark, sf_dir, "orders"), LEDGER_SQL, "orders")
    return view.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(txn(spark, sf_dir), TRUTH_SQL, "txn")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(txn(spark, sf_dir), SCORED_SQL, "txn")


def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(scored(spark, sf_dir), STORED_SQL, "scored")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(stored_scores(spark, sf_dir), ALERTS_SQL, "stored")
