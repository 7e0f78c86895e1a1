import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.profiles import exact_quantiles
from ledgerlens.operators.scans import global_index, range_slots, running


@pytest.fixture(scope="module")
def rows(spark):
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string")))
    return spark.range(600).select("id", hot.alias("key"), ((F.col("id") * 7919) % 100).alias("t"), F.when(F.col("id") % 4 > 0, F.col("id") % 11).alias("v")).cache()


@pytest.mark.parametrize("inclusive,descending", [(False, False), (True, False), (False, True), (True, True)])
def test_running_equals_plain_windows(rows, inclusive, descending):
    kinds = {"s": "sum", "hi": "max", "lo": "min", "last": "last"}
    got = running(rows, ["key"], ["t", "id"], F.floor(F.col("t") / 9), {n: (k, F.col("v")) for n, k in kinds.items()}, inclusive=inclusive, descending=descending)
    order = [F.col(c).desc() if descending else F.col(c) for c in ("t", "id")]
    w = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max("v").over(w).alias("hi"), F.min("v").over(w).alias("lo"),
                       F.last("v", ignorenulls=True).over(w).alias("last"))
    cols = ["id", "s", "hi", "lo", "last"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_next_looks_forward(rows):
    got = running(rows, ["key"], ["t", "id"], F.floor(F.col("t") / 9), {"n": ("next", F.col("v"))}, store=True)
    w = Window.partitionBy("key").orderBy("t", "id").rowsBetween(1, Window.unboundedFollowing)
    want = rows.select("id", F.first("v", ignorenulls=True).over(w).alias("n"))
    assert sorted(map(tuple, got.select("id", "n").collect())) == sorted(map(tuple, want.collect()))


def test_global_index_is_the_total_order(rows):
    got = [r["id"] for r in global_index(rows, ["t", "id"]).orderBy("row_index").collect()]
    assert got == [r["id"] for r in rows.orderBy("t", "id").collect()]
    assert [r["row_index"] for r in global_index(rows, ["t", "id"]).orderBy("row_index").collect()] == list(range(600))


def test_quantiles_and_slots(spark, rows):
    import numpy as np
    x = spark.range(-50, 151).select((F.col("id") * 1.37).alias("v"), (F.col("id") % 2).alias("g"))
    got = exact_quantiles(x, "v", {"a": 0.05, "b": 0.5, "c": 0.99}).first()
    assert tuple(got) == pytest.approx(tuple(np.percentile([i * 1.37 for i in range(-50, 151)], [5, 50, 99])))


def test_slots_drawn_from_the_rows(spark, rows):
    """Crowded values, and an hour with most of a key's rows, are cut into ranges of about equal size."""
    crowded = spark.range(8000).select((-0.5 + F.pow(F.col("id") / 8000.0, 9) / 50).alias("v"), "id")
    for df, order in ((crowded, ["v", "id"]), (crowded.select(F.lit("c").alias("key"), F.lit(7).alias("t"), "id"), ["key", "t", "id"])):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            slots = [tuple(r) for r in range_slots(df, order).groupBy("_slot").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("a")).orderBy("_slot").collect()]
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(slots) == 4 and max(n for _, n, _ in slots) <= 2 * 8000 / 4
        assert [a for _, _, a in slots] == sorted(a for _, _, a in slots)
    for inclusive in (False, True):
        by_range = running(rows, ["key"], ["t", "id"], None, {"s": ("sum", F.col("v")), "n": ("next", F.col("v"))}, inclusive=inclusive)
        by_slot = running(rows, ["key"], ["t", "id"], F.floor(F.col("t") / 9), {"s": ("sum", F.col("v")), "n": ("next", F.col("v"))}, inclusive=inclusive)
        assert sorted(map(tuple, by_range.collect()), key=str) == sorted(map(tuple, by_slot.collect()), key=str)
