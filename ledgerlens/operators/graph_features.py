"""Per-account graph features, computed by joins and grouped aggregates.

Iterative algorithms keep one row per account (or per pivot and account),
checkpoint every round and bring back only scalar convergence measures. The
links lie in buckets of the joined account, so that rounds do not move them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators.graph import degrees, ranked_pairs, undirected_pairs
from ledgerlens.operators.scans import global_index
from ledgerlens.session import bucketed, cut_lineage


def accounts(edges: DataFrame) -> DataFrame:
    return (edges.select(F.col("src").alias("account_id"))
            .union(edges.select(F.col("dst").alias("account_id"))).distinct())


def pagerank(edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-4) -> DataFrame:
    """Power iteration; parallel edges add weight, dangling mass is spread evenly.

    Stops when the L1 change falls below n * tol.
    """
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy("src").agg(F.sum("n").alias("total"))
    links = pairs.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("p"))
    nodes = accounts(edges).join(out.select(F.col("src").alias("account_id"), F.lit(False).alias("d")), "account_id", "left")
    ranks = nodes.select("account_id", F.coalesce("d", F.lit(True)).alias("dangling"))
    n = ranks.count()
    ranks = cut_lineage(ranks.withColumn("pagerank", F.lit(1.0 / max(n, 1))))
    lost = ranks.agg(F.sum(F.when(F.col("dangling"), F.col("pagerank")))).first()[0] or 0.0
    with bucketed(links, "src") as links:
        for _ in range(max_iter):
            flow = (links.join(ranks, F.col("src") == F.col("account_id"))
                    .groupBy("dst").agg(F.sum(F.col("p") * F.col("pagerank")).alias("flow")))
            base = alpha * lost / n + (1 - alpha) / n
            new = cut_lineage(ranks.join(flow, F.col("account_id") == F.col("dst"), "left").select(
                "account_id", "dangling", F.col("pagerank").alias("old"),
                (F.lit(alpha) * F.coalesce("flow", F.lit(0.0)) + base).alias("pagerank")))
            step = new.agg(F.sum(F.abs(F.col("pagerank") - F.col("old"))).alias("err"),
                           F.sum(F.when(F.col("dangling"), F.col("pagerank"))).alias("lost")).first()
            ranks, lost = new.drop("old"), step["lost"] or 0.0
            if step["err"] < n * tol:
                break
    return ranks.select("account_id", "pagerank")


def betweenness(edges: DataFrame, pivots: int = 100, seed: int = 42) -> DataFrame:
    """Shortest-path betweenness from up to ``pivots`` sources, normalised.

    All sources advance together: one join per level over (pivot, node), then one
    join per level backwards for the dependencies. With at most ``pivots``
    accounts every account is a source and the result is exact; otherwise the
    sources are chosen by hash.
    """
    ids = cut_lineage(accounts(edges))
    n = ids.count()
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("account_id")))
    chosen = ids.orderBy(order, "account_id").limit(pivots)
    k = min(pivots, n)
    frontier = cut_lineage(chosen.select(F.col("account_id").alias("pivot"), F.col("account_id").alias("node"),
                                         F.lit(1.0).alias("sigma")))
    levels = [frontier]
    zero = F.lit(0.0)
    with bucketed(edges.where("src <> dst").select("src", "dst").distinct(), "src") as links:
        while True:
            # the levels are stored already: what has been met is their union
            seen = reduce(DataFrame.union, [level.select("pivot", "node") for level in levels])
            step = (frontier.join(links, F.col("node") == F.col("src"))
                    .groupBy("pivot", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
                    .join(seen, ["pivot", "node"], "left_anti"))
            frontier = cut_lineage(step)
            if frontier.isEmpty():
                break
            levels.append(frontier)

        below = levels[-1].select("pivot", "node", "sigma", zero.alias("delta"))
        totals = []
        for depth in range(len(levels) - 2, -1, -1):
            totals.append(below.groupBy("node").agg(F.sum("delta").alias("delta")))
            share = below.select("pivot", F.col("node").alias("dst"), ((F.col("delta") + 1) / F.col("sigma")).alias("share"))
            up = levels[depth]
            gained = (up.join(links, F.col("node") == F.col("src")).join(share, ["pivot", "dst"])
                      .groupBy("pivot", "node").agg(F.sum(F.col("sigma") * F.col("share")).alias("delta")))
            below = cut_lineage(up.join(gained, ["pivot", "node"], "left").select(
                "pivot", "node", "sigma", F.coalesce("delta", zero).alias("delta")))
    # level 0 holds the sources themselves, which do not count
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 else 1.0
    summed = (reduce(DataFrame.union, totals).groupBy("node").agg(F.sum("delta").alias("delta"))
              if totals else ids.select(F.col("account_id").alias("node"), zero.alias("delta")))
    return ids.join(summed, F.col("account_id") == F.col("node"), "left").select(
        "account_id", (F.coalesce("delta", zero) * scale).alias("betweenness"))


def clustering(edges: DataFrame) -> DataFrame:
    """Local clustering of the undirected simple graph.

    Each triangle is found once, from its lowest-degree corner, so a hub never
    lists the pairs of its neighbours.
    """
    und = undirected_pairs(edges)
    deg = und.groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    rank = lambda name: deg.select(F.col("node").alias(name), F.struct("deg", "node").alias(f"r_{name}"))
    up = cut_lineage(und.join(rank("node"), "node").join(rank("nb"), "nb").where("r_node < r_nb")
                     .select("node", "nb", "r_nb"))
    a = up.select("node", F.col("nb").alias("x"), F.col("r_nb").alias("rx"))
    b = up.select("node", F.col("nb").alias("y"), F.col("r_nb").alias("ry"))
    tri = (a.join(b, "node").where("rx < ry")
           .join(up.select(F.col("node").alias("x"), F.col("nb").alias("y")), ["x", "y"]))
    per = tri.select(F.explode(F.array("node", "x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    value = F.when(F.col("deg") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("deg") * (F.col("deg") - 1)))
    return (accounts(edges).join(deg.join(per, "node", "left"), F.col("account_id") == F.col("node"), "left")
            .select("account_id", F.coalesce(value, F.lit(0.0)).alias("clustering_coefficient")))


def cycle_counts(edges: DataFrame) -> DataFrame:
    """Closed walks of length 2 and 3 through each account on the 0/1 adjacency.

    diag(A^2) = loop + mutual pairs; diag(A^3) = loop + 2*loop*mutual + loops of
    mutual partners + directed triangles.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("account_id"), F.lit(1).alias("loop")).distinct()
    p = cut_lineage(ranked_pairs(edges))
    mutual = p.select("src", "dst").join(p.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    partner = (mutual.join(loops.withColumnRenamed("account_id", "dst"), "dst", "left")
               .groupBy(F.col("src").alias("account_id"))
               .agg(F.count(F.lit(1)).alias("m"), F.sum(F.coalesce("loop", F.lit(0))).alias("ml")))
    e = lambda a: p.select(*[F.col(c).alias(f"{a}_{c}") for c in ("src", "dst", "r_src", "r_dst")])
    tri = (e("a").where("a_r_dst < a_r_src").join(e("b").where("b_r_src < b_r_dst"), F.col("a_dst") == F.col("b_src"))
           .where("a_src <> b_dst")
           .join(p.select(F.col("src").alias("b_dst"), F.col("dst").alias("a_src")), ["b_dst", "a_src"]))
    per = (tri.select(F.explode(F.array("a_src", "a_dst", "b_dst")).alias("account_id"))
           .groupBy("account_id").agg(F.count(F.lit(1)).alias("t")))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return (accounts(edges).join(loops, "account_id", "left").join(partner, "account_id", "left")
            .join(per, "account_id", "left").select(
                "account_id", (z("loop") + z("m")).alias("2hop_cycle_count"),
                (z("loop") + 2 * z("loop") * z("m") + z("ml") + z("t")).alias("3hop_cycle_count")))


def _components(edges: DataFrame) -> DataFrame:
    """account_id -> smallest account of its weakly connected component.

    Alternating star contractions: every account links to the smallest one it
    knows; the number of rounds grows with the logarithm of the component size.
    """
    orient = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs = cut_lineage(orient(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))))

    def star(sym: DataFrame, keep: str) -> DataFrame:
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return sym.where(keep).join(low, "u")

    mark = None
    while True:
        sym = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = cut_lineage(orient(star(sym, "v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))))
        down = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        small = star(down, "true")
        pairs = cut_lineage(orient(small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            small.select(F.col("u").alias("a"), F.col("m").alias("b")))))
        row = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    return (accounts(edges).join(pairs, F.col("account_id") == F.col("hi"), "left")
            .select("account_id", F.coalesce("lo", "account_id").alias("label")))


def _label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """Each account takes the most frequent label around it (own label included;
    smallest on ties), all accounts at once, for at most ``rounds`` rounds."""
    labels = cut_lineage(accounts(edges).withColumn("label", F.col("account_id")))
    with bucketed(undirected_pairs(edges), "nb") as und:
        for _ in range(rounds):
            votes = (und.join(labels.withColumnRenamed("account_id", "nb"), "nb").select(F.col("node").alias("account_id"), "label")
                     .union(labels.select("account_id", "label"))
                     .groupBy("account_id", "label").agg(F.count(F.lit(1)).alias("n")))
            new = cut_lineage(votes.groupBy("account_id").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label")))
            settled = new.join(labels.withColumnRenamed("label", "was"), "account_id").where("label <> was").isEmpty()
            labels = new
            if settled:
                break
    return labels


def communities(edges: DataFrame, method: str = "components", rounds: int = 10) -> DataFrame:
    """account_id, community_id (dense, in order of the smallest label), community_size."""
    labels = _components(edges) if method == "components" else _label_propagation(edges, rounds)
    labels = cut_lineage(labels)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("community_size"))
    numbered = global_index(sizes, ["label"], "community_id")
    return labels.join(numbered, "label").select("account_id", "community_id", "community_size")


def community_density(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct internal edges over n(n-1) per community."""
    m = members.select("account_id", "community_id")
    inside = (edges.select("src", "dst").distinct()
              .join(m.select(F.col("account_id").alias("src"), F.col("community_id").alias("cs")), "src")
              .join(m.select(F.col("account_id").alias("dst"), F.col("community_id").alias("cd")), "dst")
              .where("cs = cd").groupBy(F.col("cs").alias("community_id")).agg(F.count(F.lit(1)).alias("inside")))
    size = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return size.join(inside, "community_id", "left").select(
        "community_id", F.when(n < 2, 0.0).otherwise(F.coalesce("inside", F.lit(0)) / (n * (n - 1))).alias("community_density"))


def community_benford(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Benford chi-square of the amounts sent from each community.

    Digits are counted per account first, so the join carries one row per account.
    """
    # worked out once a row, not once for each of the nine sums
    digits = edges.select(F.col("src").alias("account_id"), S.leading_digit_2dp(F.col("amount")).alias("digit"))
    cols = [f"d{d}" for d in range(1, 10)]
    per = digits.groupBy("account_id").agg(*[F.sum(F.when(F.col("digit") == d, 1).otherwise(0)).alias(f"d{d}") for d in range(1, 10)])
    return (members.join(per, "account_id", "left").groupBy("community_id")
            .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols])
            .select("community_id", S.benford_chi2([F.col(c) for c in cols]).alias("benford_chi2_community")))


def flow_scores(edges: DataFrame) -> DataFrame:
    """Degrees, fan scores, scatter-gather and volumes of every account."""
    i, o = F.col("in_degree"), F.col("out_degree")
    total = i + o + 1e-9
    fi, fo = i / total, o / total
    vol = lambda key, name: edges.groupBy(F.col(key).alias("account_id")).agg(F.sum("amount").alias(name))
    vi, vo = (F.coalesce(c, F.lit(0.0)) for c in ("ego_in_volume_7d", "ego_out_volume_7d"))
    return (degrees(edges).join(vol("dst", "ego_in_volume_7d"), "account_id", "left")
            .join(vol("src", "ego_out_volume_7d"), "account_id", "left")
            .select("account_id", "in_degree", "out_degree", "total_degree", "in_degree_unique", "out_degree_unique",
                    fi.alias("fan_in_score"), fo.alias("fan_out_score"),
                    F.least(F.lit(1.0), (1 - F.abs(fi - fo)) * F.log(total + 1) / 5.0).alias("scatter_gather_score"),
                    vi.alias("ego_in_volume_7d"), vo.alias("ego_out_volume_7d"),
                    ((vo - vi) / (vo + vi + 1.0)).alias("volume_asymmetry")))


def graph_features(edges: DataFrame, community_method: str = "components") -> DataFrame:
    """One row per account with all 21 columns of the offline graph table."""
    members = communities(edges, community_method)
    per_account = [pagerank(edges), betweenness(edges), clustering(edges), cycle_counts(edges), members]
    out = reduce(lambda a, b: a.join(b, "account_id"), per_account, flow_scores(edges))
    for t in (community_density(edges, members), community_benford(edges, members)):
        out = out.join(t, "community_id")
    return out.select(
        "account_id", "in_degree", "out_degree", "total_degree", "in_degree_unique", "out_degree_unique",
        "pagerank", "betweenness", "clustering_coefficient", "2hop_cycle_count", "3hop_cycle_count",
        "fan_in_score", "fan_out_score", "scatter_gather_score", "community_id", "community_size",
        "community_density", "ego_in_volume_7d", "ego_out_volume_7d", "volume_asymmetry", "benford_chi2_community")
