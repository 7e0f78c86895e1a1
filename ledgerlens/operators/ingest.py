"""Normalisation, contract checks, enrichment and splitting of transactions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.functions import scalars as S
from ledgerlens.operators.scans import global_index

# String fields whose nulls become empty, and enum domains.
BLANKABLE = ("remarks", "device_id", "ip_address", "merchant_category", "sender_name", "receiver_name")
TYPES = ("UPI", "IMPS", "NEFT", "RTGS", "Wire", "Card")
CHANNELS = ("Mobile", "Web", "ATM", "Branch")
STATUSES = ("Success", "Failed", "Pending")
REQUIRED = ("transaction_id", "timestamp", "sender_account", "receiver_account", "amount")


def timestamp_of(col: Column) -> Column:
    """ISO text (``Z`` or offset; naive means UTC) or epoch seconds to a timestamp."""
    text = F.trim(col.cast("string"))
    return F.coalesce(F.timestamp_micros((text.try_cast("double") * 1_000_000).cast("bigint")), text.try_cast("timestamp"))


def flag_of(col: Column) -> Column:
    """Truthiness of a boolean given as text, number or boolean."""
    text = F.lower(F.trim(col.cast("string")))
    return F.when(text.isNull(), None).otherwise(~text.isin("false", "0", "0.0", ""))


def normalise(df: DataFrame) -> DataFrame:
    """Raw event columns to the typed event contract; absent columns become null."""
    have = set(df.columns)
    raw = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    fields = {}
    for f in schemas.TXN.fields:
        kind = f.dataType.simpleString()
        c = raw(f.name)
        fields[f.name] = c.try_cast(kind) if kind in ("double", "int") else c.cast("string")
    amount = F.coalesce(fields["amount"], F.lit(0.0))
    fields |= {
        "timestamp": timestamp_of(raw("timestamp")),
        "amount": amount,
        "amount_leading_digit": F.coalesce(fields["amount_leading_digit"], S.leading_digit(amount)),
        "is_international": F.coalesce(flag_of(raw("is_international")),
                                       F.coalesce(raw("sender_country"), F.lit("")) != F.coalesce(raw("receiver_country"), F.lit(""))),
        "transaction_type": S.transaction_type_name(raw("transaction_type")),
        "payment_channel": S.payment_channel_name(raw("payment_channel")),
        "transaction_status": S.status_name(raw("transaction_status")),
        **{n: F.when(F.lower(raw(n)) == "nan", "").otherwise(F.coalesce(raw(n), F.lit(""))) for n in BLANKABLE},
    }
    extra = [F.col(c) for c in df.columns if c not in fields]
    return df.select(*[fields[f.name].alias(f.name) for f in schemas.TXN.fields], *extra)


def _violations(df: DataFrame) -> Column:
    have = set(df.columns)
    checks = {f"{n} missing": F.col(n).isNull() for n in REQUIRED if n in have}
    domains = {"transaction_type": TYPES, "payment_channel": CHANNELS, "transaction_status": STATUSES}
    checks |= {f"{n} unknown": ~F.col(n).isin(*d) for n, d in domains.items() if n in have}
    ranges = {"kyc_level": (0, 3), "amount_leading_digit": (1, 9)}
    checks |= {f"{n} out of range": ~F.col(n).between(*r) for n, r in ranges.items() if n in have}
    return F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(m)) for m, p in checks.items()]))


def validate_contract(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); rejected rows carry the list of their violations."""
    checked = df.withColumn("violations", _violations(df))
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def parse_json_events(df: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) from a column of JSON payloads."""
    parsed = df.select(F.col(col).cast("string").alias("payload")).withColumn(
        "e", F.from_json("payload", schemas.RAW_TXN, {"mode": "PERMISSIVE"}))
    events = normalise(parsed.select("payload", "e.*"))
    good, bad = validate_contract(events)
    return good.drop("payload"), bad.select("payload", "violations")


def enrich_with_accounts(txn: DataFrame, accounts: DataFrame) -> DataFrame:
    """Attach both parties' attributes; derive is_international and currency.

    Plain equi-joins: Spark broadcasts the dimension while it is below its own
    threshold and otherwise shuffles, splitting skewed senders.
    """
    sender_only = ("kyc_level", "device_id", "ip_address", "geo_latitude", "geo_longitude")
    have = set(accounts.columns)
    s = accounts.select(
        F.col("account_id").alias("sender_account"), F.col("account_name").alias("sender_name"),
        F.col("bank").alias("sender_bank"), F.col("country").alias("sender_country"),
        *[c for c in sender_only if c in have])
    r = accounts.select(
        F.col("account_id").alias("receiver_account"), F.col("account_name").alias("receiver_name"),
        F.col("bank").alias("receiver_bank"), F.col("country").alias("receiver_country"))
    given = set(s.columns) | set(r.columns) | {"currency", "is_international"}
    keep = [c for c in txn.columns if c not in given or c in ("sender_account", "receiver_account")]
    return (txn.select(*keep).join(s, "sender_account").join(r, "receiver_account")
            .withColumns({"is_international": F.col("sender_country") != F.col("receiver_country"),
                          "currency": F.when(F.col("sender_country") == "IN", "INR").otherwise("USD")}))


def split_history_stream(df: DataFrame, start: datetime, history_days: int,
                         stream_days: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history, public stream without labels, truth = fraud rows of the stream)."""
    cutoff, end = start + timedelta(days=history_days), start + timedelta(days=history_days + stream_days)
    stream = df.where((F.col("timestamp") >= cutoff) & (F.col("timestamp") < end))
    return df.where(F.col("timestamp") < cutoff), stream.drop(*schemas.LABELS.fieldNames()), stream.where("is_fraud")


def union_labelled(normal: DataFrame, fraud: DataFrame) -> DataFrame:
    """Align columns, fill the missing labels of normal rows, order by time."""
    both = normal.unionByName(fraud, allowMissingColumns=True)
    return both.withColumn("is_fraud", F.coalesce("is_fraud", F.lit(False))).orderBy("timestamp", "transaction_id")


def assign_sequence_ids(df: DataFrame, order: list[str], prefix: str = "TXN_F", width: int = 8) -> DataFrame:
    """transaction_id = prefix + 1-based position in ``order``."""
    numbered = global_index(df, order, "_i")
    return numbered.withColumn("transaction_id", F.concat(F.lit(prefix), F.lpad((F.col("_i") + 1).cast("string"), width, "0"))).drop("_i")


def sanitise_nulls(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column."""
    floats = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def ring_members(labelled: DataFrame) -> DataFrame:
    rows = labelled.where(F.col("fraud_ring_id").isNotNull())
    side = lambda c: rows.select("fraud_ring_id", F.col(c).alias("account_id"))
    return side("sender_account").union(side("receiver_account")).distinct()


def ring_summary(labelled: DataFrame) -> DataFrame:
    """Per ring: members, entry and exit account, hops, total value, severity.

    Members are counted, not collected; ``ring_members`` lists them.
    """
    at = F.struct("timestamp", "transaction_id")
    rows = labelled.where(F.col("fraud_ring_id").isNotNull())
    flows = rows.groupBy("fraud_ring_id").agg(
        F.min_by("sender_account", at).alias("entry_account"), F.max_by("receiver_account", at).alias("exit_account"),
        F.count(F.lit(1)).alias("num_hops"), F.sum("amount").alias("total_value"))
    members = ring_members(labelled).groupBy("fraud_ring_id").agg(F.count(F.lit(1)).alias("n_members"))
    return flows.join(members, "fraud_ring_id").withColumn("severity", S.severity_band(F.col("total_value")))
