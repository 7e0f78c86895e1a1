"""Window aggregates of busy senders as running scans (linear, no hot task).

* counts, distinct counts, entropy: every row adds a delta when it happens and
  takes it back when it leaves the window; the window value is a running sum.
* sums, variance, extremes: time is cut into blocks of the window length W. The
  window [t-W, t) is a suffix of one block plus a prefix of the next, so two
  running scans give it without subtracting.
* last-200 digits: rows are cut into blocks of 200 positions; each block is
  scanned together with the block before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators.scans import running
from ledgerlens.session import cut_lineage

_US = 1_000_000
H1, H6, H24, D7, D30 = 3_600, 21_600, 86_400, 604_800, 2_592_000
_ORDER = ["at", "phase", "transaction_id"]
_ROW, _LEAVE = 0, 1


def _slot(col: str, seconds: int) -> Column:
    return F.floor(F.col(col) / F.lit(seconds * _US)).cast("bigint")


def _neighbours(rows: DataFrame, slot_seconds: int) -> DataFrame:
    """Previous row of the sender, next row's time and country, and the next use
    of the same receiver / device / address. Each round stores its rows, so they hold only what is still read."""
    slot = _slot("at", slot_seconds)
    order = ["at", "transaction_id"]
    country = F.col("receiver_country").alias("country")
    before = F.struct("at", F.col("geo_latitude").alias("lat"), F.col("geo_longitude").alias("lon"), country)
    read = rows.select("transaction_id", "timestamp", "sender_account", "receiver_account", "receiver_country", "transaction_status",
                       "device_id", "ip_address", "geo_latitude", "geo_longitude", "at")
    out = running(read, ["sender_account"], order, slot,
                  {"prev": ("last", before), "next": ("next", F.struct("at", country))}).drop("geo_latitude", "geo_longitude")
    for name, value in (("recv", "receiver_account"), ("dev", "device_id"), ("ip", "ip_address")):
        out = running(out, ["sender_account", value], order, slot,
                      {f"prev_{name}": ("last", F.col("at")), f"next_{name}": ("next", F.col("at"))}, store=True)
        out = out if value == "receiver_account" else out.drop(value)
    return cut_lineage(out)


def _appears(prev: str, seconds: int) -> Column:
    """1 when the value was not in the window just before this row."""
    gone = F.col(prev).isNull() | (F.col(prev) + seconds * _US < F.col("at"))
    return F.when(gone, 1).otherwise(0)


def _vanishes(nxt: str, seconds: int) -> Column:
    """-1 when no later row keeps the value in the window until this row leaves."""
    last = F.col(nxt).isNull() | (F.col(nxt) > F.col("at") + seconds * _US)
    return F.when(last, -1).otherwise(0)


def _counts(rows: DataFrame, slot_seconds: int) -> DataFrame:
    hour, dow = F.hour("timestamp"), F.weekday("timestamp")
    bit = lambda cond: F.when(cond, 1).otherwise(0)
    night, weekend = bit((hour >= 22) | (hour <= 5)), bit(dow >= 5)
    ok = bit(F.col("transaction_status") == "Success")
    switch = bit(F.col("prev").isNotNull() & (F.col("prev.country") != F.col("receiver_country")))
    pair_leaves = bit(F.col("next").isNotNull() & (F.col("next.at") <= F.col("at") + D7 * _US)
                      & (F.col("next.country") != F.col("receiver_country")))
    # a switch counts only while both of its rows are inside the window
    pair_enters = F.when(F.col("prev.at") + D7 * _US >= F.col("at"), switch).otherwise(0)
    names = ["n1", "n6", "n24", "n7", "n30", "night", "weekend", "ok",
             "ben7", "ben30", "dev7", "ip24", "switches"]
    enter = {"n1": F.lit(1), "n6": F.lit(1), "n24": F.lit(1), "n7": F.lit(1), "n30": F.lit(1),
             "night": night, "weekend": weekend, "ok": ok,
             "ben7": _appears("prev_recv", D7), "ben30": _appears("prev_recv", D30),
             "dev7": _appears("prev_dev", D7), "ip24": _appears("prev_ip", H24), "switches": pair_enters}
    leave = {
        H1: {"n1": F.lit(-1)}, H6: {"n6": F.lit(-1)},
        H24: {"n24": F.lit(-1), "ip24": _vanishes("next_ip", H24)},
        D7: {"n7": F.lit(-1), "night": -night, "weekend": -weekend, "ok": -ok,
             "ben7": _vanishes("next_recv", D7), "dev7": _vanishes("next_dev", D7), "switches": -pair_leaves},
        D30: {"n30": F.lit(-1), "ben30": _vanishes("next_recv", D30)},
    }

    # six events a row are stored: their deltas, each -1, 0 or 1, are two bits each of one number
    def event(at: Column, phase: int, deltas: dict[str, Column]) -> Column:
        bits = [F.shiftleft((d + 1).cast("bigint"), 2 * names.index(n)) for n, d in deltas.items()]
        none = sum(1 << 2 * i for i, n in enumerate(names) if n not in deltas)
        return F.struct(at.alias("at"), F.lit(phase).alias("phase"), reduce(Column.__add__, bits, F.lit(none).cast("bigint")).alias("deltas"))

    def delta(name: str) -> Column:
        return F.shiftright("deltas", 2 * names.index(name)).bitwiseAND(F.lit(3).cast("bigint")) - 1

    events = rows.select(
        "transaction_id", "sender_account", "receiver_account",
        F.explode(F.array(
            event(F.col("at"), _ROW, enter),
            *[event(F.col("at") + w * _US, _LEAVE, d) for w, d in leave.items()])).alias("e"),
    ).select("transaction_id", "sender_account", "receiver_account", "e.*")

    # entropy = log2 n - (sum over receivers of c*log2 c) / n; that sum moves with every delta
    slot = _slot("at", slot_seconds)
    # entries and exits of one row share its id, hence the phase in the order
    events = running(events, ["sender_account", "receiver_account"], _ORDER, slot, {"c": ("sum", delta("n7"))})
    weight = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(0.0)
    events = events.withColumn("g", weight(F.col("c") + delta("n7")) - weight(F.col("c"))).drop("receiver_account", "c")
    sums = running(events, ["sender_account"], _ORDER, slot,
                   {**{f"_{n}": ("sum", delta(n)) for n in names}, "_g": ("sum", F.col("g"))}, store=True)
    n7 = F.col("_n7")
    return sums.where(F.col("phase") == _ROW).select(
        "transaction_id", *[f"_{n}" for n in ("n1", "n6", "n24", "n7", "n30", "ben7", "ben30", "dev7", "ip24")],
        F.col("_switches"),
        *[F.when(n7 > 0, F.col(f"_{n}") / n7).alias(f"_{n}") for n in ("night", "weekend", "ok")],
        # first-order share of the 1e-12 inside the logarithm
        F.when(n7 > 0, F.greatest(F.lit(0.0), F.log2(n7.cast("double")) - F.col("_g") / n7)
               - F.col("_ben7") * 1e-12 / 0.6931471805599453).otherwise(0.0).alias("_entropy"))


def _abroad(rows: DataFrame, slot_seconds: int) -> DataFrame:
    """30-day rows whose receiver country equals the current sender country."""
    def event(country: str, at: Column, phase: int, d: int, ask: bool) -> Column:
        return F.struct(F.col(country).alias("country"), at.alias("at"), F.lit(phase).alias("phase"),
                        F.lit(d).cast("bigint").alias("d"), F.lit(ask).alias("ask"))

    at = F.col("at")
    events = rows.select("transaction_id", "sender_account", F.explode(F.array(
        event("sender_country", at, -1, 0, True), event("receiver_country", at, _ROW, 1, False),
        event("receiver_country", at + D30 * _US, _LEAVE, -1, False))).alias("e"),
    ).select("transaction_id", "sender_account", "e.*")
    # questions carry the row's own id and sort before its entry, after earlier ids
    events = events.withColumn("rank", F.when(F.col("phase") == _LEAVE, 1).otherwise(0))
    counted = running(events, ["sender_account", "country"], ["at", "rank", "transaction_id", "phase"],
                      _slot("at", slot_seconds), {"home": ("sum", F.col("d"))})
    return counted.where("ask").select("transaction_id", F.col("home").alias("_home"))


def _blocks(rows: DataFrame, seconds: int, aggs: dict[str, tuple[str, Column]], slot_seconds: int) -> DataFrame:
    """Suffix of the block holding t-W merged with the prefix of the block holding t."""
    width = seconds * _US
    keep = [e for e in {"amount", "centred"} if e in rows.columns]
    values = rows.select("transaction_id", "sender_account", "at", F.lit(0).alias("phase"), *keep)
    probes = values.select("transaction_id", "sender_account", (F.col("at") - width).alias("at"),
                           F.lit(-1).alias("phase"), *[F.lit(None).cast("double").alias(c) for c in keep])
    block = lambda df: df.withColumn("block", F.floor(F.col("at") / width))
    slot = _slot("at", slot_seconds)
    prefix = running(block(values), ["sender_account", "block"], _ORDER, slot, aggs)
    # scanning backwards, a probe (phase -1) comes after all rows at its own time
    suffix = running(block(values.unionByName(probes)), ["sender_account", "block"], _ORDER, slot, aggs,
                     descending=True).where("phase = -1")
    both = (prefix.select("transaction_id", *aggs).alias("a")
            .join(suffix.select("transaction_id", *aggs).alias("b"), "transaction_id"))
    merged = []
    for name, (kind, _) in aggs.items():
        a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
        merged.append((a + b if kind == "sum" else (F.greatest if kind == "max" else F.least)(a, b)).alias(name))
    return both.select("transaction_id", *merged)


def _last_digits(rows: DataFrame, slot_seconds: int, depth: int = 200) -> DataFrame:
    from ledgerlens.operators.rolling import last_digits

    # the digit is a column before the scans, which would work it out again for every row of a frame
    placed = running(rows.select("transaction_id", "sender_account", "at", S.leading_digit(F.col("amount")).alias("digit")), ["sender_account"],
                     ["at", "transaction_id"], _slot("at", slot_seconds), {"pos": ("sum", F.lit(1))})
    placed = placed.withColumn("block", F.floor(F.col("pos") / depth))
    halo = placed.withColumn("block", F.explode(F.array("block", F.col("block") + 1)))
    counts = halo.withColumns(last_digits(F.col("digit"), Window.partitionBy("sender_account", "block").orderBy("pos"), depth))
    return (counts.where(F.col("block") == F.floor(F.col("pos") / depth))
            .select("transaction_id", *[f"_d{d}" for d in range(1, 10)]))


def busy_window_parts(base: DataFrame, slot_seconds: int) -> DataFrame:
    rows = cut_lineage(base.withColumn("at", F.unix_micros("timestamp")))
    near = _neighbours(rows, slot_seconds)
    counts = _counts(near, slot_seconds)
    # centring on the sender's mean keeps the sum of squares well conditioned
    means = rows.groupBy("sender_account").agg(F.avg("amount").alias("centre"))
    centred = rows.join(means, "sender_account").withColumn("centred", F.col("amount") - F.col("centre"))
    week = _blocks(centred, D7, {
        "s": ("sum", F.col("amount")), "c1": ("sum", F.col("centred")),
        "c2": ("sum", F.col("centred") * F.col("centred")),
        "_max7": ("max", F.col("amount")), "_min7": ("min", F.col("amount"))}, slot_seconds)
    month = _blocks(rows, D30, {"_sum30": ("sum", F.col("amount"))}, slot_seconds)
    joined = (rows.join(near.select("transaction_id", "prev"), "transaction_id")
              .join(counts, "transaction_id").join(_abroad(rows, slot_seconds), "transaction_id")
              .join(week, "transaction_id").join(month, "transaction_id")
              .join(_last_digits(rows, slot_seconds), "transaction_id"))
    n7 = F.col("_n7")
    var = F.greatest(F.lit(0.0), F.col("c2") / n7 - F.pow(F.col("c1") / n7, 2))
    return joined.withColumns({
        "_prev_ts": F.timestamp_micros(F.col("prev.at")),
        "_prev_lat": F.col("prev.lat"), "_prev_lon": F.col("prev.lon"),
        "_avg7": F.when(n7 > 0, F.col("s") / n7),
        # equal amounts have no spread, whatever the rounding of the squares
        "_std7": F.when(n7 > 0, F.when(F.col("_max7") == F.col("_min7"), 0.0).otherwise(F.sqrt(var))),
        "_abroad": F.col("_n30") - F.col("_home"),
    })
