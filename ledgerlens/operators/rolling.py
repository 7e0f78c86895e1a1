"""Rolling account features: 45 values per transaction from strictly earlier rows.

Rows of a sender are ordered by (timestamp, transaction_id). A window of W
seconds holds the earlier rows whose timestamp is at least ``now - W``.

Two plans give the same values:

* ordinary senders: one shuffle by sender, range frames over a composite long
  key that orders ties and excludes the current row;
* busy senders (more than ``busy_rows`` rows in some 30-day block): the sliding
  frames would be quadratic and the sender would sit in one task, so the frames
  are rewritten as running scans over (sender, time slot), see ``rolling_busy``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ledgerlens.functions import scalars as S
from ledgerlens.operators.scans import HOUR, running, time_slot
from ledgerlens.schemas import FEATURES

H1, H6, H24, D7, D30 = 3_600, 21_600, 86_400, 604_800, 2_592_000
# timestamp micros are spread by this factor so that ties get their own values
_SPREAD = 2048


@dataclass(frozen=True)
class FeatureConfig:
    threshold: float = 1_000_000.0
    high_risk_countries: tuple[str, ...] = S.HIGH_RISK_COUNTRIES
    busy_rows: int = 1_000
    slot_seconds: int = HOUR
    # busy senders are broadcast only below this many; beyond it Spark joins by shuffle
    broadcast_limit: int = 100_000

    def __post_init__(self) -> None:
        # ordinary senders' ties must fit into the spread of the composite key
        if not 0 <= self.busy_rows <= _SPREAD // 2 - 1:
            raise ValueError(f"busy_rows must be 0 to {_SPREAD // 2 - 1}")


def with_defaults(txn: DataFrame) -> DataFrame:
    """Fill the optional event columns the features read."""
    cols = set(txn.columns)

    def col(name: str, default: Column, dtype: str) -> Column:
        return (F.coalesce(F.col(name).cast(dtype), default) if name in cols else default).alias(name)

    empty = F.lit("")
    amount = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    filled = {
        "sender_account": empty, "receiver_account": empty, "device_id": empty, "ip_address": empty,
        "sender_country": empty, "receiver_country": empty, "sender_bank": empty, "receiver_bank": empty,
        "transaction_type": F.lit("NEFT"), "payment_channel": F.lit("Mobile"),
        "transaction_status": F.lit("Success"),
    }
    return txn.select(
        "transaction_id", F.col("timestamp").cast("timestamp").alias("timestamp"), amount.alias("amount"),
        *[col(n, d, "string") for n, d in filled.items()],
        col("geo_latitude", F.lit(0.0), "double"), col("geo_longitude", F.lit(0.0), "double"),
        col("kyc_level", F.lit(0), "int"),
        col("sender_balance_before", amount + 1.0, "double"),
        col("is_international",
            F.coalesce(F.col("sender_country"), empty) != F.coalesce(F.col("receiver_country"), empty), "boolean"),
    )


def device_usage(base: DataFrame, slot_seconds: int = HOUR) -> DataFrame:
    """transaction_id -> new_device_flag, shared_device_count.

    The first use of each (sender, device) is found by a map-side combined
    aggregate and matched back on the unique transaction id, so a hot device or
    sender meets no skewed join; distinct senders are a running sum of first uses.
    """
    firsts = (base.groupBy("sender_account", "device_id")
              .agg(F.min(F.struct("timestamp", "transaction_id")).alias("f"))
              .select(F.col("f.transaction_id").alias("transaction_id"), F.lit(1).alias("first_use")))
    uses = (base.select("transaction_id", "timestamp", "device_id")
            .join(firsts, "transaction_id", "left")
            .withColumn("first_use", F.coalesce("first_use", F.lit(0))))
    counted = running(uses, ["device_id"], ["timestamp", "transaction_id"],
                      time_slot(F.col("timestamp"), slot_seconds),
                      {"earlier_senders": ("sum", F.col("first_use"))})
    return counted.select(
        "transaction_id", F.col("first_use").cast("double").alias("new_device_flag"),
        F.when(F.col("device_id") == "", 0.0).otherwise(F.col("earlier_senders").cast("double"))
        .alias("shared_device_count"))


def busy_senders(base: DataFrame, busy_rows: int) -> DataFrame:
    block = F.floor(F.unix_seconds("timestamp") / D30)
    return (base.groupBy("sender_account", block.alias("_block")).count()
            .where(F.col("count") > busy_rows).select("sender_account").distinct())


def last_digits(digit: Column, rows: WindowSpec, depth: int = 200) -> dict[str, Column]:
    """Counts of the nine digits among the ``depth`` rows before: two frames that only grow, as a sliding one reads all its rows again for every row."""
    def before(d: int, last: int) -> Column:
        return F.coalesce(F.sum(F.when(digit == d, 1).otherwise(0)).over(rows.rowsBetween(Window.unboundedPreceding, last)), F.lit(0))

    return {f"_d{d}": before(d, -1) - before(d, -depth - 1) for d in range(1, 10)}


def window_parts(base: DataFrame) -> DataFrame:
    """Window aggregates of ordinary senders: one shuffle, frames share the sort."""
    by = Window.partitionBy("sender_account")
    p = by.orderBy("timestamp", "transaction_id")

    def frame(seconds: int):
        return by.orderBy("_k").rangeBetween(-(seconds * 1_000_000 * _SPREAD + 1023), -1)

    w1, w6, w24, w7, w30 = (frame(s) for s in (H1, H6, H24, D7, D30))
    one = F.lit(1)
    share = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    hour, dow = F.hour("timestamp"), F.weekday("timestamp")

    # a sliding frame evaluates its expressions anew for every row it holds, so they are columns before
    keyed = base.withColumns({
        "_digit": S.leading_digit(F.col("amount")),
        "_at_night": share((hour >= 22) | (hour <= 5)), "_at_weekend": share(dow >= 5),
        "_succeeded": share(F.col("transaction_status") == "Success"),
    }).withColumns({
        "_tie": F.row_number().over(p) - F.rank().over(by.orderBy("timestamp")),
        "_prev_ts": F.lag("timestamp").over(p),
        "_prev_lat": F.lag("geo_latitude").over(p),
        "_prev_lon": F.lag("geo_longitude").over(p),
        "_prev_country": F.lag("receiver_country").over(p),
        **last_digits(F.col("_digit"), p),
    }).withColumns({
        "_k": F.unix_micros("timestamp") * _SPREAD + F.col("_tie"),
        "_switch": F.when(F.col("_prev_country").isNotNull() & (F.col("_prev_country") != F.col("receiver_country")), 1)
        .otherwise(0),
    })
    return keyed.withColumns({
        "_n1": F.count(one).over(w1), "_n6": F.count(one).over(w6),
        "_n24": F.count(one).over(w24), "_n7": F.count(one).over(w7), "_n30": F.count(one).over(w30),
        "_avg7": F.avg("amount").over(w7), "_std7": F.stddev_pop("amount").over(w7),
        "_max7": F.max("amount").over(w7), "_min7": F.min("amount").over(w7),
        "_sum30": F.sum("amount").over(w30),
        "_night": F.avg("_at_night").over(w7), "_weekend": F.avg("_at_weekend").over(w7), "_ok": F.avg("_succeeded").over(w7),
        "_ben7": F.size(F.collect_set("receiver_account").over(w7)),
        "_ben30": F.size(F.collect_set("receiver_account").over(w30)),
        "_dev7": F.size(F.collect_set("device_id").over(w7)),
        "_ip24": F.size(F.collect_set("ip_address").over(w24)),
        "_recv7": F.collect_list("receiver_account").over(w7),
        "_ctry30": F.collect_list("receiver_country").over(w30),
        "_switches": F.sum("_switch").over(w7) - F.first("_switch").over(w7),
    }).withColumns({
        "_entropy": S.entropy_bits(F.col("_recv7")),
        "_abroad": F.size(F.filter("_ctry30", lambda c: c != F.col("sender_country"))),
    }).drop("_recv7", "_ctry30", "_tie", "_k", "_switch", "_prev_country", "_digit", "_at_night", "_at_weekend", "_succeeded")


def finish(parts: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Turn window aggregates into the named features."""
    c, lit = F.col, F.lit
    amount = c("amount")
    zero = lambda x: F.coalesce(x, lit(0.0))
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    avg7 = zero(c("_avg7"))
    std7 = F.when(c("_n7") > 1, zero(c("_std7"))).otherwise(0.0)
    gap = (F.unix_micros("timestamp") - F.unix_micros("_prev_ts")) / 1e6
    dist = F.when(c("_prev_lat").isNotNull(),
                  S.haversine_km(c("_prev_lat"), c("_prev_lon"), c("geo_latitude"), c("geo_longitude"))).otherwise(0.0)
    hours = gap / 3600.0
    hour, dow = F.hour("timestamp"), F.weekday("timestamp")
    max7, min7 = F.coalesce(c("_max7"), amount), F.coalesce(c("_min7"), amount)
    cyc = lambda f, x, n: f(lit(2 * math.pi) * x / lit(float(n)))
    values = {
        "tx_velocity_1h": c("_n1"), "tx_velocity_6h": c("_n6"),
        "tx_velocity_24h": c("_n24"), "tx_velocity_7d": c("_n7"),
        "avg_amount_7d": avg7, "std_amount_7d": std7,
        "tx_gap_seconds": F.when(c("_prev_ts").isNull(), 86_400.0).otherwise(F.greatest(gap, lit(0.0))),
        "night_tx_ratio": zero(c("_night")), "weekend_tx_ratio": zero(c("_weekend")),
        "hour_of_day": hour, "day_of_week": dow,
        "beneficiary_count_7d": c("_ben7"), "beneficiary_count_30d": c("_ben30"),
        "receiver_entropy": c("_entropy"),
        "amount_zscore": F.when(std7 > 0, (amount - avg7) / (std7 + 1e-6)).otherwise(0.0),
        "avg_daily_volume_30d": zero(c("_sum30")) / 30.0,
        "round_amount_flag": flag((amount % 100_000 == 0) & (amount >= 100_000)),
        "sub_threshold_flag": flag((amount >= 0.85 * cfg.threshold) & (amount < cfg.threshold)),
        "amount_leading_digit": S.leading_digit(amount),
        "benford_chi2_score": S.benford_chi2([c(f"_d{d}") for d in range(1, 10)]),
        "geo_distance_km": dist,
        "country_switch_count_7d": zero(c("_switches")),
        "impossible_travel_flag": flag(c("_prev_ts").isNotNull() & (hours > 0) & (dist / hours > 900.0)),
        "high_risk_country_flag": flag(c("receiver_country").isin(*cfg.high_risk_countries)
                                       | c("sender_country").isin(*cfg.high_risk_countries)),
        "cross_border_ratio_30d": F.when(c("_n30") > 0, c("_abroad") / c("_n30")).otherwise(0.0),
        "device_change_count_7d": c("_dev7"),
        "new_device_flag": c("new_device_flag"), "shared_device_count": c("shared_device_count"),
        "ip_change_count_24h": c("_ip24"),
        "kyc_level": c("kyc_level"),
        "amount_ratio_7d": F.when(avg7 > 0, amount / avg7).otherwise(1.0),
        "balance_utilization": F.when(c("sender_balance_before") > 0, amount / c("sender_balance_before")).otherwise(1.0),
        "same_bank_flag": flag(c("sender_bank") == c("receiver_bank")),
        "is_international": flag(c("is_international")),
        "tx_type_encoded": S.lookup(c("transaction_type"), S.TYPE_CODES, 0),
        "channel_encoded": S.lookup(c("payment_channel"), S.CHANNEL_CODES, 0),
        "hour_sin": cyc(F.sin, hour, 24), "hour_cos": cyc(F.cos, hour, 24),
        "dow_sin": cyc(F.sin, dow, 7), "dow_cos": cyc(F.cos, dow, 7),
        "day_of_month": F.dayofmonth("timestamp"),
        "success_rate_7d": F.coalesce(c("_ok"), lit(1.0)),
        "max_amount_7d": max7, "min_amount_7d": min7,
        "amount_to_max_ratio": F.when(max7 > 0, amount / max7).otherwise(1.0),
    }
    return parts.select(
        "transaction_id", "timestamp", "sender_account", "receiver_account", "amount",
        *[values[name].cast("double").alias(name) for name in FEATURES])


def rolling_features(txn: DataFrame, cfg: FeatureConfig = FeatureConfig(), only: DataFrame | None = None) -> DataFrame:
    """transaction_id, timestamp, sender, receiver, amount + the 45 features.

    ``only`` (transaction_id) restricts the result; windows are then computed for
    the senders of those rows alone, over their full history.
    """
    from ledgerlens.operators.rolling_busy import busy_window_parts

    everyone = with_defaults(txn)
    base = everyone
    if only is not None:
        wanted = only.select("transaction_id").distinct()
        senders = everyone.join(wanted, "transaction_id", "left_semi").select("sender_account").distinct()
        base = everyone.join(senders, "sender_account", "left_semi")
    busy = busy_senders(base, cfg.busy_rows)
    n_busy = busy.limit(cfg.broadcast_limit + 1).count()
    if n_busy == 0:
        parts = window_parts(base)
    else:
        marked = F.broadcast(busy) if n_busy <= cfg.broadcast_limit else busy
        calm = window_parts(base.join(marked, "sender_account", "left_anti"))
        hot = busy_window_parts(base.join(marked, "sender_account", "left_semi"), cfg.slot_seconds)
        parts = calm.unionByName(hot.select(*calm.columns))
    if only is not None:
        parts = parts.join(wanted, "transaction_id", "left_semi")
    return finish(parts.join(device_usage(everyone, cfg.slot_seconds), "transaction_id"), cfg)


def rolling_features_after(history: DataFrame, stream: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Features of the stream rows, warm-started with the history rows."""
    return rolling_features(history.unionByName(stream, allowMissingColumns=True), cfg, only=stream)


def feature_vector(features: DataFrame) -> DataFrame:
    return features.select("transaction_id", F.array(*FEATURES).alias("features"))
