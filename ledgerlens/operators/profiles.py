"""Behavioural profiles, samples, scaling and drift."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.operators.scans import running
from ledgerlens.session import cut_lineage

MODEL_COLUMNS = schemas.FEATURES + schemas.GRAPH_FEATURES


def account_profiles(txn: DataFrame) -> DataFrame:
    """Per-sender behaviour in one grouped pass (17 columns)."""
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    hour = F.hour("timestamp")
    tier = (F.when((F.col("tx_count") > 1000) | (F.col("max_amount") > 5_000_000), "elevated")
            .when((F.col("night_tx_ratio") > 0.5) | (F.col("unique_countries") > 5), "suspicious").otherwise("normal"))
    return txn.groupBy(F.col("sender_account").alias("account_id")).agg(
        F.count(F.lit(1)).alias("tx_count"), F.sum("amount").alias("total_sent"), F.avg("amount").alias("mean_amount"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("std_amount"),
        F.max("amount").alias("max_amount"), F.min("amount").alias("min_amount"),
        F.countDistinct("receiver_account").alias("unique_receivers"),
        F.countDistinct("receiver_bank").alias("unique_banks"),
        F.countDistinct("receiver_country").alias("unique_countries"),
        share((hour <= 5) | (hour >= 22)).alias("night_tx_ratio"),
        share(F.weekday("timestamp") >= 5).alias("weekend_tx_ratio"),
        share(F.col("transaction_status") == "Success").alias("success_rate"),
        F.count(F.when(F.col("amount") < 1_000_000, 1)).alias("sub_threshold_count"),
        F.mode("payment_channel", deterministic=True).alias("primary_channel"),
        F.mode("receiver_country", deterministic=True).alias("primary_country"),
    ).withColumn("risk_tier", tier)


def account_profile(profiles: DataFrame, account: str) -> DataFrame:
    """Point lookup; on a stored table the filter reaches the scan."""
    return profiles.where(F.col("account_id") == account)


def hash_order(col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(col)))


def hash_fraction(col: str, seed: int) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_order(col, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample_transactions(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest hashes: a uniform deterministic sample.

    Rows far above the expected n-th hash are filtered out first, so that the
    final sort merges about n rows and not n rows per partition.
    """
    total = df.count()
    share = (n + 8 * math.sqrt(n) + 64) / max(total, 1)
    if share < 1:
        likely = df.where(hash_fraction("transaction_id", seed) < share)
        # practically certain; otherwise the whole table is sorted
        df = likely if likely.count() >= n else df
    return df.orderBy(hash_order("transaction_id", seed), "transaction_id").limit(n)


def sample_per_account(df: DataFrame, cap: int, n: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per sender, then at most ``n`` in total."""
    w = Window.partitionBy("sender_account").orderBy(hash_order("transaction_id", seed), "transaction_id")
    capped = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
    return sample_transactions(capped, n, seed + 1)


def ordered_eval_sample(features: DataFrame, truth: DataFrame, cap: int = 10, n: int = 3000, seed: int = 42) -> DataFrame:
    """Rows to evaluate: every labelled one plus a capped sample of the others.

    The features must come from the full ordered stream; only the recorded rows
    are restricted.
    """
    ids = truth.select("transaction_id").distinct()
    fraud = features.join(ids, "transaction_id", "left_semi")
    rest = sample_per_account(features.join(ids, "transaction_id", "left_anti"), cap, n, seed)
    return fraud.withColumn("y_true", F.lit(1)).unionByName(rest.withColumn("y_true", F.lit(0)))


def training_matrix(features: DataFrame, graph_features: DataFrame) -> DataFrame:
    """45 rolling features plus the sender's 7 graph features (0 when unknown)."""
    g = graph_features.select(F.col("account_id").alias("sender_account"), *schemas.GRAPH_FEATURES)
    return (features.select("transaction_id", "sender_account", *schemas.FEATURES)
            .join(g, "sender_account", "left").na.fill(0.0, schemas.GRAPH_FEATURES)
            .select("transaction_id", "sender_account", *MODEL_COLUMNS))


def finite_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))
    return df.where(reduce(lambda a, b: a & b, [ok(c) for c in cols]))


@dataclass(frozen=True)
class Scaler:
    mean: dict[str, float]
    std: dict[str, float]


def fit_scaler(df: DataFrame, cols: list[str]) -> Scaler:
    """Mean and population deviation per column; a zero deviation becomes 1."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return Scaler({c: row[f"m{i}"] or 0.0 for i, c in enumerate(cols)},
                  {c: row[f"s{i}"] or 1.0 for i, c in enumerate(cols)})


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    scaled = {c: (F.col(c) - m) / scaler.std[c] for c, m in scaler.mean.items()}
    return df.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def train_val_split(df: DataFrame, val_share: float = 0.2, seed: int = 42, max_train: int | None = None) -> tuple[DataFrame, DataFrame]:
    u = hash_fraction("transaction_id", seed)
    train, val = df.where(u >= val_share), df.where(u < val_share)
    return (train if max_train is None else sample_transactions(train, max_train, seed)), val


def top_drivers(cols: list[str], k: int = 3) -> Column:
    """Names of the ``k`` columns with the largest absolute scaled value."""
    items = F.array(*[F.struct(F.abs(F.col(c)).alias("a"), F.lit(i).alias("i"), F.lit(c).alias("n")) for i, c in enumerate(cols)])
    return F.transform(F.slice(F.sort_array(items, asc=False), 1, k), lambda x: x["n"])


def feature_drift_report(scaled: DataFrame, bucket: str, cols: list[str]) -> DataFrame:
    """Mean absolute scaled value per feature and bucket; flagged above 5."""
    per = scaled.groupBy(bucket).agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in cols])
    long = per.unpivot([bucket], cols, "feature", "v")
    pick = lambda b: F.max(F.when(F.col(bucket) == b, F.col("v")))
    return long.groupBy("feature").agg(
        pick("train").alias("train"), pick("normal").alias("normal"), pick("fraud").alias("fraud")
    ).withColumn("blows_up", F.greatest(F.coalesce("normal", F.lit(0.0)), F.coalesce("fraud", F.lit(0.0))) > 5)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Linearly interpolated quantiles from value counts and a running count."""
    keys = keys or []
    # stored, as it is read twice and the values may be costly; a condition before that would work them out once more
    counts = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    hist = cut_lineage(counts).where("_v IS NOT NULL")
    cum = running(hist, keys, ["_v"], None, {"_before": ("sum", F.col("_c"))})
    totals = hist.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if keys:
        cum = cum.join(totals, keys)
    else:
        cum = cum.withColumn("_n", totals.scalar())
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * p
        at = lambda i: F.min(F.when(F.col("_before") + F.col("_c") > i, F.col("_v")))
        lo, hi, frac = at(F.floor(pos)), at(F.ceil(pos)), F.max(pos - F.floor(pos))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return cum.groupBy(*keys).agg(*aggs)
