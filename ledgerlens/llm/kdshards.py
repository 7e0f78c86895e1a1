"""Sharding by a k-d tree over metadata, with DataFrame operations only.

Rows of one group (equal keys) go together. Groups carry a weight and some metadata dimensions;
a node of the tree is split at the weighted median along its widest dimension (relative
to the dimension's whole range) until there are as many leaves as shards. The order along a
dimension is (value, group key), so ties are split at an exact group as well: the two sides
differ by no more than the weight of the group at the cut.

A median is found in rounds: every node's interval is cut into ``BINS`` bins, the weights
per bin are summed where the rows are (a small combined aggregate), and the bin that holds
the half becomes the next interval, until it holds one group key. All nodes of a level
take their rounds together. What comes to the driver is per node, never per row.

A group larger than an even share has a shard of its own, which is larger than the others, as groups
stay whole; the tree deals the rest to the other shards. A group that is large for its node goes to the side that
it leaves nearer to the target, and both sides get shards by their measured weights. Fewer groups than shards leave shards empty. Repeated rows and null ids are rows like others; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.stored import stored

#: Bins of an interval in each round of the search for a median.
BINS = 4_096
#: Rows of one shard that are numbered in one task, about.
RUN = 4_000
#: From this part of a shard on, a group at a cut goes to the side that it leaves nearer to the target.
LARGE = 0.1


@dataclass
class Cut:
    """Rows at or before (value, key) along a dimension go left; the group there only if ``closed``."""

    dimension: str
    value: float
    key: int
    before: int
    group: int
    closed: bool = True

    @property
    def left(self) -> int:
        """The weight of the left side."""
        return self.before + self.group * self.closed


def _ranges(rows: DataFrame, dimensions: list[str], key: str, weight: str) -> dict[int, dict]:
    """Per node its weight, number of groups at least (1 or 2), and the range of each dimension."""
    found = rows.groupBy("node").agg(
        F.sum(weight).alias("weight"), F.min(key).alias("k0"), F.max(key).alias("k1"),
        *[F.min(d).alias(f"lo_{d}") for d in dimensions], *[F.max(d).alias(f"hi_{d}") for d in dimensions])
    return {r["node"]: r.asDict() for r in found.collect()}  # a row per node


def _bin(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor((x - lo) / (hi - lo) * BINS)).cast("int")


def _per_node(values: dict[int, float | int], kind: str) -> Column:
    """The value of the row's node; a bounded lookup, one entry per node."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), F.col("node")).cast(kind)


def _half_bin(rows: DataFrame, x: Column, lo: dict[int, float], hi: dict[int, float], before: dict[int, int], half: dict[int, int], kind: str, weight: str) -> dict[int, tuple]:
    """Per node the bin in which the running weight reaches half: its smallest and largest x, and the weight before it."""
    cell = _bin(x.cast("double"), _per_node(lo, "double"), _per_node(hi, "double"))
    sums = rows.groupBy("node", cell.alias("bin")).agg(F.sum(weight).alias("w"), F.min(x).alias("a"), F.max(x).alias("b"))
    out: dict[int, tuple] = {}
    passed = dict(before)
    for r in sums.orderBy("node", "bin").collect():  # at most BINS rows per node
        if r["node"] in out:
            continue
        if passed[r["node"]] + r["w"] >= half[r["node"]]:
            out[r["node"]] = (r["a"], r["b"], passed[r["node"]])
        passed[r["node"]] += r["w"]
    return out


def _medians(rows: DataFrame, ranges: dict[int, dict], share: dict[int, float], widest: dict[int, str], key: str, weight: str) -> dict[int, Cut]:
    """The cut of every node that has more than one group."""
    half = {n: max(1, round(share[n] * ranges[n]["weight"])) for n in widest}
    x = F.coalesce(*[F.when(F.col("node") == n, F.col(d)) for n, d in widest.items()])
    inside = rows.filter(F.col("node").isin([*widest])).withColumn("x", x)
    found: dict[int, list] = {}
    lo = {n: ranges[n][f"lo_{d}"] for n, d in widest.items()}
    hi = {n: ranges[n][f"hi_{d}"] for n, d in widest.items()}
    before = dict.fromkeys(widest, 0)
    while todo := [n for n in widest if n not in found]:
        open_ = [n for n in todo if lo[n] < hi[n]]
        for n in todo:
            if n not in open_:
                found[n] = [lo[n], before[n]]
        if not open_:
            break
        part = inside.filter(F.col("node").isin(open_) & F.col("x").between(_per_node({n: lo[n] for n in open_}, "double"), _per_node({n: hi[n] for n in open_}, "double")))
        for n, (a, b, w) in _half_bin(part, F.col("x"), lo, hi, before, half, "double", weight).items():
            lo[n], hi[n], before[n] = a, b, w
    # among the groups at the value: the group key at which the half is reached
    ties = inside.filter(F.col("x") == _per_node({n: v for n, (v, _) in found.items()}, "double"))
    ends = {r["node"]: (r["a"], r["b"]) for r in ties.groupBy("node").agg(F.min(key).alias("a"), F.max(key).alias("b")).collect()}
    before = {n: w for n, (_, w) in found.items()}
    klo, khi = {n: a for n, (a, _) in ends.items()}, {n: b for n, (_, b) in ends.items()}
    while open_ := [n for n in ends if klo[n] < khi[n]]:
        part = ties.filter(F.col("node").isin(open_) & F.col(key).between(_per_node({n: klo[n] for n in open_}, "bigint"), _per_node({n: khi[n] for n in open_}, "bigint")))
        steps = _half_bin(part, F.col(key), {n: float(klo[n]) for n in open_}, {n: float(khi[n]) for n in open_}, before, half, "bigint", weight)
        for n, (a, b, w) in steps.items():
            if (a, b) == (klo[n], khi[n]):  # doubles can't tell these apart any more
                klo[n] = khi[n] = a
            else:
                klo[n], khi[n], before[n] = a, b, w
    at = ties.filter(F.col(key) == _per_node(klo, "bigint")).groupBy("node").agg(F.sum(weight).alias("w"))
    return {r["node"]: Cut(widest[r["node"]], found[r["node"]][0], klo[r["node"]], before[r["node"]], r["w"]) for r in at.collect()}


def _route(cuts: dict[int, Cut], key: str, node: int, leaf: Callable[[int], int]) -> Column:
    """The tree below a node as one nested conditional, as large as the tree."""
    if node not in cuts:
        return F.lit(leaf(node))
    c = cuts[node]
    left = (F.col(c.dimension) < c.value) | ((F.col(c.dimension) == c.value) & (F.col(key) <= c.key if c.closed else F.col(key) < c.key))
    return F.when(left, _route(cuts, key, 2 * node + 1, leaf)).otherwise(_route(cuts, key, 2 * node + 2, leaf))


def _alone(rows: DataFrame, shards: int, key: str, weight: str) -> list[int]:
    """Keys of the groups that outweigh an even share of what is left without larger ones; fewer than shards."""
    left = rows.agg(F.sum(weight)).first()[0] or 0
    out = []
    for k, w in rows.groupBy(key).agg(F.sum(weight).alias("w")).orderBy(F.desc("w"), key).limit(shards).collect():
        if w * (shards - len(out)) <= left:
            break
        out.append(k)
        left -= w
    return out[: shards - 1]


def assign(rows: DataFrame, shards: int, dimensions: list[str], key: str, weight: str) -> Column:
    """The shard, 0 to shards - 1, of each row, as a column expression over the rows' own columns.

    ``dimensions`` are double columns without nulls, ``key`` is a long that rows of one group share, as they
    share the dimensions; ``weight`` is a long. The rows are read a few times per level of the tree,
    so give a stored table.
    """
    alone = _alone(rows, shards, key, weight)
    rows = rows.filter(~F.col(key).isin(alone)) if alone else rows
    spans = {0: (0, shards - len(alone))}  # leaves so far and the shards below them
    cuts: dict[int, Cut] = {}
    whole: dict[str, float] = {}
    while open_ := [n for n, (a, b) in spans.items() if b - a > 1]:
        placed = rows.select(*dimensions, key, weight, _route(cuts, key, 0, lambda n: n).alias("node"))
        placed = placed.filter(F.col("node").isin(open_))
        ranges = _ranges(placed, dimensions, key, weight)
        whole = whole or {d: ranges[0][f"hi_{d}"] - ranges[0][f"lo_{d}"] or 1.0 for d in dimensions if ranges}
        widest, share = {}, {}
        for n in open_:
            a, b = spans[n]
            if n in ranges and ranges[n]["k0"] < ranges[n]["k1"]:
                r = ranges[n]
                widest[n] = max(dimensions, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / whole[d])  # noqa: B023
                share[n] = (b - a) // 2 / (b - a)
            else:
                spans[n] = (a, a + 1)  # nothing, or one group: not to be split
        if widest:
            for n, cut in _medians(placed, ranges, share, widest, key, weight).items():
                a, b = spans.pop(n)
                total = ranges[n]["weight"]
                target = share[n] * total
                if cut.before and cut.group * (b - a) > LARGE * total and (target - cut.before < cut.left - target or cut.left == total):
                    cut.closed = False
                cuts[n] = cut
                middle = a + min(max(round((b - a) * cut.left / total), 1), b - a - 1)
                spans |= {2 * n + 1: (a, middle), 2 * n + 2: (middle, b)}
    out = _route(cuts, key, 0, lambda n: spans[n][0])
    for i, k in enumerate(alone):
        out = F.when(F.col(key) == k, F.lit(shards - 1 - i)).otherwise(out)
    return out


def numbered(rows: DataFrame, shard: str, row: str, order: list[str], out: str, run: int = RUN) -> DataFrame:
    """Rows with a gapless number from 0 within their shard, by hash of ``row`` into runs of about ``run`` rows, then ``order``."""
    runs = rows.groupBy(shard).agg(F.ceil(F.count("*") / run).alias("runs"))
    placed = rows.join(F.broadcast(runs), shard).withColumn("run", F.pmod(F.xxhash64(row), "runs")).drop("runs")  # a row per shard
    sizes = placed.groupBy(shard, "run").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(shard).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy(shard, "run").orderBy(*order, row))
    return placed.withColumn("at", at).join(starts, [shard, "run"]).withColumn(out, F.col("start") + F.col("at") - 1).drop("run", "at", "start")


def shard_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per document; equal texts in one shard, sizes near equal.

    Size is the UTF-8 length plus one; a null text counts as empty. Dimensions are the length, the bytes per
    code point (a trace of the language) and the checksum, which spreads texts of like length.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(body) + 1).cast("long")
    rows = stored(docs.select(
        F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("key"),
        ((size - 1) / F.greatest(F.length(body), F.lit(1))).cast("double").alias("density"), F.monotonically_increasing_id().alias("row")))
    rows = rows.withColumns({"bytes": F.col("size").cast("double"), "sum": F.col("text_crc32").cast("double")})
    placed = rows.withColumn("shard", assign(rows, shards, ["bytes", "density", "sum"], "key", "size"))
    return numbered(placed, "shard", "row", ["doc_id"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
