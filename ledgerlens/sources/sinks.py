"""Writers of tables, alerts and scored events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import schemas


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _flatten(df: DataFrame, how) -> DataFrame:
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.select(*[how(c).alias(c) if kinds[c] in ("array", "struct", "map") else F.col(c) for c in df.columns])


def alerts_csv_rows(alerts: DataFrame) -> DataFrame:
    """The 15 file columns; lists become text joined with ``|``."""
    return _flatten(alerts.select(*schemas.ALERT_COLUMNS), lambda c: F.array_join(c, "|"))


#: Texts may hold quotes and line ends; times keep their microseconds.
CSV = {"header": True, "multiLine": True, "escape": '"', "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def write_alerts_csv(alerts: DataFrame, path: str) -> None:
    """Append to the alert file, after a check that what is there has the same columns in the same order."""
    rows = alerts_csv_rows(alerts)
    jvm, spark = alerts.sparkSession._jvm, alerts.sparkSession
    there = jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        known = spark.read.options(**CSV).csv(path).columns
        if known and known != rows.columns:
            raise ValueError(f"{path} has other columns: {known}")
    rows.write.mode("append").options(**CSV).csv(path)


def alerts_table_rows(alerts: DataFrame) -> DataFrame:
    """Relational form: nested columns as JSON text, one row per alert_id."""
    return _flatten(alerts.dropDuplicates(["alert_id"]), F.to_json)


def write_alerts_table(alerts: DataFrame, path: str, batch_id: int = 0) -> None:
    """Idempotent per batch: rewriting a batch replaces only its own folder."""
    alerts_table_rows(alerts).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_alerts_jdbc(alerts: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Append to a relational table; the table's key on alert_id rejects repeats."""
    alerts_table_rows(alerts).write.jdbc(url, table, mode="append", properties=properties)


def scored_records(scored: DataFrame) -> DataFrame:
    """Nested event records: score, level, patterns, breakdown and layer outputs."""
    have = set(scored.columns)
    group = lambda name, cols: F.struct(*[c for c in cols if c in have]).alias(name)
    top = [c for c in ("transaction_id", "sender_account", "transaction_risk_score", "risk_level",
                       "triggered_patterns", "score_breakdown", "explanation") if c in have]
    return scored.select(
        *top,
        group("rule_out", ["rule_score", "triggered_rules", "rule_explanations", "rule_count"]),
        group("behav_out", ["iso_forest_score", "lof_score", "autoencoder_score", "ensemble_anomaly_score", "anomaly_drivers"]),
        group("gnn_out", ["link_score", "gnn_anomaly_score", "src_known", "dst_known", "structural_anomaly_explanations"]))


def write_scored_jsonl(scored: DataFrame, path: str, mode: str = "append") -> None:
    scored_records(scored).write.mode(mode).json(path)
