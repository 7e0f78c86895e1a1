"""Column helpers over built-in functions; no Python runs per row."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normalisation tables of the event contract.
TYPE_NAMES = {
    "TRANSFER": "NEFT", "WIRE": "Wire", "SWIFT": "Wire", "SWIFT_TRANSFER": "Wire",
    "UPI": "UPI", "IMPS": "IMPS", "NEFT": "NEFT", "RTGS": "RTGS", "CARD": "Card",
}
CHANNEL_NAMES = {
    "NEFT": "Web", "RTGS": "Web", "IMPS": "Mobile", "UPI": "Mobile", "WIRE": "Web",
    "SWIFT": "Web", "ATM": "ATM", "BRANCH": "Branch", "MOBILE": "Mobile", "WEB": "Web",
}
STATUS_NAMES = {"SUCCESS": "Success", "FAILED": "Failed", "PENDING": "Pending", "FAILURE": "Failed"}
TYPE_CODES = {
    "NEFT": 0, "RTGS": 1, "IMPS": 2, "Wire": 3, "WIRE": 3, "UPI": 4,
    "Card": 5, "TRANSFER": 6, "PAYMENT": 7,
}
CHANNEL_CODES = {
    "Mobile": 0, "Web": 1, "ATM": 2, "Branch": 3, "SWIFT": 4,
    "NEFT": 5, "RTGS": 6, "IMPS": 7, "UPI": 8,
}
HIGH_RISK_COUNTRIES = ("AE", "MU", "CN", "NG", "PK", "CH")
EARTH_RADIUS_KM = 6371.0
BENFORD = [math.log10(1 + 1 / d) for d in range(1, 10)]


def lookup(col: Column, table: dict, default) -> Column:
    """Literal map lookup; unknown and null keys take the default."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.coalesce(col, F.lit(""))), F.lit(default))


def transaction_type_name(col: Column) -> Column:
    return lookup(F.regexp_replace(F.upper(col), "-", "_"), TYPE_NAMES, "NEFT")


def payment_channel_name(col: Column) -> Column:
    return lookup(F.upper(col), CHANNEL_NAMES, "Web")


def status_name(col: Column) -> Column:
    return lookup(F.upper(col), STATUS_NAMES, "Success")


def leading_digit(amount: Column) -> Column:
    """First digit of the whole part; amounts below 1 are read in millionths."""
    scaled = F.when(amount >= 1.0, amount).otherwise(amount * 1_000_000)
    digit = F.substring(F.floor(scaled).cast("string"), 1, 1).cast("int")
    return F.when(amount <= 0, 1).otherwise(F.greatest(digit, F.lit(1)))


def leading_digit_2dp(amount: Column) -> Column:
    """First significant digit of the two-decimal text; 0.0x counts as a nine."""
    text = F.regexp_replace(F.format_string("%.2f", amount), r"^0+", "")
    digit = F.substring(F.regexp_replace(text, r"\.", ""), 1, 1).cast("int")
    return F.when(amount <= 0, 1).when(digit == 0, 9).otherwise(F.coalesce(digit, F.lit(1)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def benford_chi2(counts: list[Column], min_n: int = 5) -> Column:
    """Chi-square of nine digit counts against Benford's law; 0 below ``min_n``."""
    n = reduce(lambda a, b: a + b, counts)
    terms = [F.pow(c - n * p, 2) / (n * p + 1e-9) for c, p in zip(counts, BENFORD)]
    return F.when(n >= min_n, reduce(lambda a, b: a + b, terms)).otherwise(F.lit(0.0))


def benford_chi2_agg(digit: Column, min_n: int = 5) -> Column:
    """Aggregate form: nine conditional sums, combined map-side by Spark."""
    return benford_chi2([F.sum(F.when(digit == d, 1).otherwise(0)) for d in range(1, 10)], min_n)


def entropy_bits(values: Column) -> Column:
    """Shannon entropy of an array's values, -sum p*log2(p + 1e-12); 0 when empty.

    One pass over the sorted array adds a term whenever a run of equal values ends.
    """
    n = F.size(values).cast("double")
    term = lambda run: (run / n) * F.log2(run / n + 1e-12)
    start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0.0).alias("run"), F.lit(0.0).alias("acc"))

    def step(acc: Column, v: Column) -> Column:
        same = acc["v"].eqNullSafe(v)
        return F.struct(
            v.alias("v"),
            F.when(same, acc["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
            F.when(same | (acc["run"] == 0), acc["acc"]).otherwise(acc["acc"] + term(acc["run"])).alias("acc"),
        )

    total = F.aggregate(F.sort_array(values), start, step, lambda a: a["acc"] + term(a["run"]))
    return F.when(F.size(values) > 0, -total).otherwise(F.lit(0.0))


def severity_band(total: Column) -> Column:
    return (F.when(total >= 5_000_000, "Critical").when(total >= 1_000_000, "High")
            .when(total >= 200_000, "Medium").otherwise("Low"))


def degree_band(degree: Column) -> Column:
    """Display colour of a node by total degree."""
    return (F.when(degree > 100, "red").when(degree > 40, "orange")
            .when(degree > 15, "yellow").otherwise("blue"))


def clip(col: Column, low: float = 0.0, high: float = 100.0) -> Column:
    # least and greatest skip nulls, so a missing value must be kept apart
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))
