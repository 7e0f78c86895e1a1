"""Running aggregates and row numbering that hold up under hot keys.

A plain ``Window.partitionBy(key)`` puts every row of one key into one task.
Here a key's rows are cut into slots (time buckets, score buckets, ...). Each
(key, slot) is scanned on its own; the slot totals, one row per (key, slot),
are scanned separately and added back. No task ever sees a whole hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage

HOUR = 3600


def time_slot(ts: Column, seconds: int = HOUR) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def range_slots(df: DataFrame, order: list[str], name: str = "_slot") -> DataFrame:
    """Rows with the number of their range of ``order``; the bounds are sampled, ranges hold about equally many rows.

    Rows equal in ``order`` share a range. The result is checkpointed, as another run would draw other bounds.
    """
    return cut_lineage(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id().cast("bigint")))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slot: Column | None,
    specs: dict[str, tuple[str, Column]],
    *,
    inclusive: bool = False,
    descending: bool = False,
    store: bool = False,
) -> DataFrame:
    """Add running columns per key.

    ``specs`` maps an output name to (kind, row expression); kinds are ``sum``,
    ``max``, ``min``, ``last`` (latest earlier non-null value) and ``next``
    (nearest later non-null value). ``slot`` must not decrease as ``order``
    increases; None draws the slots from the rows themselves (``range_slots``), so that they
    hold about as many rows each wherever the rows crowd. Exclusive scans leave the row itself out. Empty prefixes give 0
    for sums and null otherwise. ``descending`` scans from the end.

    The input is read twice (rows and slot totals); ``store`` checkpoints it
    first, for chains of scans and other costly inputs.
    """
    if slot is None:
        slotted = range_slots(df, [*keys, *order])
    else:
        slotted = df.withColumn("_slot", slot)
        if store:
            slotted = cut_lineage(slotted)
    by = [*keys, "_slot"]

    def frames(backwards: bool):
        d = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
        inner = (Window.partitionBy(*by).orderBy(*[d(c) for c in order])
                 .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
        # without keys the slot table is small by construction (one row per slot)
        outer = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(d("_slot"))
                 .rowsBetween(Window.unboundedPreceding, -1))
        return inner, outer

    totals, carried, scanned, combined = [], [], {}, {}
    for name, (kind, expr) in specs.items():
        part, prior, here = f"_part_{name}", f"_prior_{name}", f"_here_{name}"
        backwards = descending != (kind == "next")
        inner, outer = frames(backwards)
        if kind in ("last", "next"):
            at = F.when(expr.isNotNull(), F.struct(*order))
            totals.append((F.min_by if backwards else F.max_by)(expr, at).alias(part))
            carried.append(F.last(part, ignorenulls=True).over(outer).alias(prior))
            scanned[here] = F.last(expr, ignorenulls=True).over(inner)
            combined[name] = F.coalesce(F.col(here), F.col(prior))
            continue
        agg = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
        totals.append(agg(expr).alias(part))
        carried.append(agg(F.col(part)).over(outer).alias(prior))
        scanned[here] = agg(expr).over(inner)
        if kind == "sum":
            combined[name] = F.coalesce(F.col(here), F.lit(0)) + F.coalesce(F.col(prior), F.lit(0))
        else:
            combined[name] = (F.greatest if kind == "max" else F.least)(F.col(here), F.col(prior))

    prior = slotted.groupBy(*by).agg(*totals).select(*by, *carried)
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    joined = slotted.withColumns(scanned).alias("l").join(prior.alias("r"), on, "left")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *[e.alias(n) for n, e in combined.items()])


def global_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """0-based position in the total order, without a single-task window.

    Range-partitioned sort, then per-partition counts (one row per partition)
    turned into offsets. The sorted rows are checkpointed so that both uses see
    the same partitions.
    """
    ordered = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright("_mid", 33)
    inside = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    upto = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ordered.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
               .select("_pid", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_offset")))
    # one row per partition of the sort, so the broadcast is bounded by the partition count
    return (ordered.withColumn("_pid", pid)
            .join(F.broadcast(offsets), "_pid")
            .withColumn(name, inside + F.col("_offset"))
            .drop("_mid", "_pid", "_offset"))
