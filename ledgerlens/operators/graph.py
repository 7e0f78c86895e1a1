"""Account graph: one edge per transaction, nodes with both roles folded in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.scans import HOUR, running, time_slot
from ledgerlens.session import cut_lineage


def _or(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def build_edges(txn: DataFrame) -> DataFrame:
    none = F.lit("")
    return txn.select(
        F.col("sender_account").alias("src"), F.col("receiver_account").alias("dst"),
        "transaction_id", "timestamp", F.coalesce(F.col("amount"), F.lit(0.0)).alias("amount"),
        _or(txn, "currency", F.lit("INR")).alias("currency"),
        _or(txn, "transaction_type", none).alias("transaction_type"),
        _or(txn, "payment_channel", none).alias("payment_channel"),
        _or(txn, "is_fraud", F.lit(False)).alias("is_fraud"),
        _or(txn, "fraud_ring_id", none).alias("ring_id"))


def build_nodes(txn: DataFrame) -> DataFrame:
    """One row per account: attributes of its first appearance (as sender before
    receiver inside one transaction), volumes, counts and last time seen."""
    def role(is_sender: bool) -> DataFrame:
        side = "sender" if is_sender else "receiver"
        sent, zero = F.lit(1 if is_sender else 0), F.lit(0.0)
        return txn.select(
            F.col(f"{side}_account").alias("account_id"), "timestamp", "transaction_id",
            F.lit(0 if is_sender else 1).alias("role"),
            F.struct(
                _or(txn, f"{side}_name", F.lit("")).alias("account_name"),
                _or(txn, f"{side}_country", F.lit("")).alias("country"),
                _or(txn, f"{side}_bank", F.lit("")).alias("bank"),
                _or(txn, "kyc_level", F.lit(0)).alias("kyc_level"),
                (_or(txn, "geo_latitude", zero) if is_sender else zero).alias("geo_latitude"),
                (_or(txn, "geo_longitude", zero) if is_sender else zero).alias("geo_longitude")).alias("attrs"),
            (F.col("amount") * sent).alias("sent"), (F.col("amount") * (1 - sent)).alias("received"),
            sent.alias("n_sent"), (1 - sent).alias("n_recv"))

    rows = role(True).unionByName(role(False))
    first = F.min_by("attrs", F.struct("timestamp", "transaction_id", "role"))
    return rows.groupBy("account_id").agg(
        first.alias("a"), F.sum("sent").alias("total_sent"), F.sum("received").alias("total_received"),
        F.sum("n_sent").alias("tx_count_sent"), F.sum("n_recv").alias("tx_count_recv"),
        F.max("timestamp").alias("last_seen_ts"),
    ).select("account_id", "a.*", "total_sent", "total_received", "tx_count_sent", "tx_count_recv", "last_seen_ts")


def simple_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges collapsed; the amount is that of the last one."""
    return edges.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.max_by("amount", F.struct("timestamp", "transaction_id")).alias("amount"))


def degrees(edges: DataFrame) -> DataFrame:
    """Multi-degrees and distinct-neighbour degrees of every account.

    Counts come from the collapsed edges, so no distinct aggregate is needed.
    """
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    side = lambda key, i, o: pairs.select(
        F.col(key).alias("account_id"), (F.col("n") * i).alias("i"), (F.col("n") * o).alias("o"),
        F.lit(i).alias("iu"), F.lit(o).alias("ou"))
    both = side("src", 0, 1).unionByName(side("dst", 1, 0))
    return both.groupBy("account_id").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"),
        (F.sum("i") + F.sum("o")).alias("total_degree"),
        F.sum("iu").cast("bigint").alias("in_degree_unique"), F.sum("ou").cast("bigint").alias("out_degree_unique"))


def node_info(txn: DataFrame, account: str | Column) -> DataFrame:
    """Attributes and degrees of one account; the filter reaches both scans."""
    touching = txn.where((F.col("sender_account") == account) | (F.col("receiver_account") == account))
    return (build_nodes(touching).where(F.col("account_id") == account)
            .join(degrees(build_edges(touching)), "account_id"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Number of accounts and of edges, from one grouped pass."""
    per_node = degrees(edges)
    return per_node.agg(F.count(F.lit(1)).alias("nodes"), F.sum("out_degree").alias("edges"))


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (node, nb) in both directions, self-loops left out."""
    flip = edges.select(F.col("dst").alias("node"), F.col("src").alias("nb"))
    return (edges.select(F.col("src").alias("node"), F.col("dst").alias("nb")).union(flip)
            .where("node <> nb").distinct())


def neighbors(edges: DataFrame, account: str, cap: int | None = None) -> DataFrame:
    """Successors and predecessors; with ``cap`` so many of each, in id order."""
    def side(here: str, there: str, label: str) -> DataFrame:
        found = edges.where(F.col(here) == account).select(F.lit(label).alias("direction"), F.col(there).alias("account_id")).distinct()
        return found if cap is None else found.orderBy("account_id").limit(cap)
    return side("src", "dst", "successor").unionByName(side("dst", "src", "predecessor"))


def two_hop_neighborhood(edges: DataFrame, account: str) -> DataFrame:
    """All accounts within two undirected hops of one account, itself excluded."""
    pairs = undirected_pairs(edges)
    one = pairs.where(F.col("node") == account).select(F.col("nb").alias("account_id"))
    two = pairs.join(one, F.col("node") == F.col("account_id"), "left_semi").select(F.col("nb").alias("account_id"))
    return one.union(two).where(F.col("account_id") != account).distinct()


def two_hop_capped(edges: DataFrame, cap: int) -> DataFrame:
    """For every account the ``cap`` smallest ids within two hops.

    The smallest ids of a union are among the smallest ids of its parts, so each
    neighbour passes on only its first ``cap + 1``: work grows with the edges,
    not with the squares of the degrees, and the answer is exact.
    """
    pairs = cut_lineage(undirected_pairs(edges))
    by_nb = Window.partitionBy("node").orderBy("nb")
    head = pairs.withColumn("r", F.row_number().over(by_nb)).where(F.col("r") <= cap + 1).drop("r")
    via = (pairs.withColumnRenamed("nb", "mid").join(head.select(F.col("node").alias("mid"), "nb"), "mid")
           .where("node <> nb").select("node", "nb"))
    found = head.union(via).distinct()
    ranked = found.withColumn("r", F.row_number().over(by_nb)).where(F.col("r") <= cap)
    return ranked.groupBy(F.col("node").alias("account_id")).agg(
        F.sort_array(F.collect_list("nb")).alias("two_hop_neighborhood"))


def one_hop_edge_list(edges: DataFrame, cap: int | None = None) -> DataFrame:
    """Per account its touching edges, outgoing first, in time order; with ``cap`` the first so many.

    Without a cap a hub's list is as long as its history; ask for single accounts then.
    """
    e = F.struct(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("timestamp").alias("ts"), "amount")
    side = lambda key, d: edges.select(F.col(key).alias("account_id"), F.lit(d).alias("dir"),
                                       "timestamp", "transaction_id", e.alias("e"))
    w = Window.partitionBy("account_id").orderBy("dir", "timestamp", "transaction_id")
    ranked = (side("src", 0).unionByName(side("dst", 1))
              .withColumn("r", F.row_number().over(w)))
    if cap is not None:
        ranked = ranked.where(F.col("r") <= cap)
    items = F.sort_array(F.collect_list(F.struct("r", "e")))
    return ranked.groupBy("account_id").agg(F.transform(items, lambda x: x["e"]).alias("two_hop_edge_list"))


def one_hop_edge_rows(edges: DataFrame) -> DataFrame:
    """All touching edges of every account, a row each, with their ``position`` from 1: outgoing first, in time order.

    Positions are counted over time slots, so a hub's history is never one task or one row.
    """
    side = lambda key, d: edges.select(F.col(key).alias("account_id"), F.lit(d).alias("dir"), "src", "dst", "timestamp", "transaction_id", "amount")
    slot = F.col("dir") * F.lit(1 << 40) + time_slot(F.col("timestamp"))
    return running(side("src", 0).unionByName(side("dst", 1)), ["account_id"], ["dir", "timestamp", "transaction_id"], slot,
                   {"position": ("sum", F.lit(1))}, inclusive=True)


def two_hop_edges(edges: DataFrame, account: str) -> DataFrame:
    """Every edge touching the two-hop set of one account."""
    near = two_hop_neighborhood(edges, account)
    hit = lambda key: edges.join(near, F.col(key) == F.col("account_id"), "left_semi")
    return (hit("src").union(hit("dst"))
            .select("src", "dst", "transaction_id", "timestamp", "amount").dropDuplicates(["transaction_id"]))


def _key() -> Column:
    return F.struct("timestamp", "transaction_id")


def ranked_pairs(edges: DataFrame) -> DataFrame:
    """Collapsed edges without self-loops, earliest appearance ``k`` and the
    degree rank of both ends (degree, id); used to orient joins from low to high."""
    pairs = edges.where("src <> dst").groupBy("src", "dst").agg(F.min(_key()).alias("k"))
    und = pairs.select(F.col("src").alias("node")).union(pairs.select(F.col("dst").alias("node")))
    deg = und.groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    rank = lambda name: deg.select(F.col("node").alias(name), F.struct("deg", "node").alias(f"r_{name}"))
    return pairs.join(rank("src"), "src").join(rank("dst"), "dst")


def earliest_returns(edges: DataFrame) -> DataFrame:
    """For each pair (src, dst): when a return path dst -> ... -> src of 1, 2 or 3
    earlier edges first exists (its latest edge), as t1, t2, t3.

    Cycles are enumerated from their lowest (3-cycles) or highest (4-cycles)
    ranked account, so hubs meet at most the square root of the edges per edge.
    """
    p = cut_lineage(ranked_pairs(edges))
    e = lambda a: p.select(*[F.col(c).alias(f"{a}_{c}") for c in ("src", "dst", "k", "r_src", "r_dst")])

    back = p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("k").alias("t"))
    hop1 = p.select("src", "dst").join(back, ["src", "dst"]).select("src", "dst", F.lit(1).alias("hops"), "t")

    # 3-cycles p -> l -> q -> p with l the lowest rank
    into = e("a").where("a_r_dst < a_r_src")
    outof = e("b").where("b_r_src < b_r_dst")
    wedge = into.join(outof, F.col("a_dst") == F.col("b_src")).where("a_src <> b_dst")
    tri = wedge.join(e("c"), (F.col("c_src") == F.col("b_dst")) & (F.col("c_dst") == F.col("a_src")))

    def closes(side: str, x: str, y: str) -> Column:
        return F.struct(F.col(f"{side}_src").alias("src"), F.col(f"{side}_dst").alias("dst"),
                        F.greatest(F.col(f"{x}_k"), F.col(f"{y}_k")).alias("t"))

    hop2 = (tri.select(F.explode(F.array(closes("a", "b", "c"), closes("b", "a", "c"), closes("c", "a", "b"))).alias("x"))
            .select("x.src", "x.dst", F.lit(2).alias("hops"), "x.t"))

    # 4-cycles v -> u -> w -> y -> v with v the highest rank: two half paths meet at (v, w)
    out_v = e("a").where("a_r_dst < a_r_src")
    down = (out_v.join(e("b"), F.col("a_dst") == F.col("b_src")).where("b_r_dst < a_r_src")
            .select(F.col("a_src").alias("v"), F.col("a_dst").alias("u"), F.col("b_dst").alias("w"),
                    F.col("a_k").alias("k1"), F.col("b_k").alias("k2")))
    in_v = e("a").where("a_r_src < a_r_dst")
    up = (e("b").join(in_v, F.col("b_dst") == F.col("a_src")).where("b_r_src < a_r_dst")
          .select(F.col("a_dst").alias("v"), F.col("a_src").alias("u"), F.col("b_src").alias("w"),
                  F.col("b_k").alias("k1"), F.col("a_k").alias("k2")))
    best = lambda half, name: half.groupBy("v", "w").agg(F.min(F.greatest("k1", "k2")).alias(name))
    pair = lambda s, d, k: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), F.greatest(F.col(k), F.col("o")).alias("t"))
    from_down = down.join(best(up, "o"), ["v", "w"]).select(
        F.explode(F.array(pair("v", "u", "k2"), pair("u", "w", "k1"))).alias("x"))
    from_up = up.join(best(down, "o"), ["v", "w"]).select(
        F.explode(F.array(pair("w", "u", "k2"), pair("u", "v", "k1"))).alias("x"))
    hop3 = from_down.union(from_up).select("x.src", "x.dst", F.lit(3).alias("hops"), "x.t")

    at = lambda h: F.min(F.when(F.col("hops") == h, F.col("t"))).alias(f"t{h}")
    return hop1.union(hop2).union(hop3).groupBy("src", "dst").agg(at(1), at(2), at(3))


def deep_returns(known: DataFrame, wanted: DataFrame, max_depth: int) -> DataFrame:
    """(src, dst, hops, t) for return paths of 4 to ``max_depth`` edges: when a path dst -> ... -> src of that many edges first exists.

    ``wanted`` (src, dst, timestamp, transaction_id) are the transactions that no shorter path closes. From the receivers of those alone a
    frontier moves on along collapsed edges, one hop a round; a label is the earliest time at which its path is complete. Only labels that
    have become earlier move on, and none that is later than the last wanted transaction of its start.
    """
    pairs = cut_lineage(known.where("src <> dst").groupBy("src", "dst").agg(F.min(_key()).alias("f")))
    ends = wanted.select("src", "dst").distinct()
    starts = wanted.groupBy(F.col("dst").alias("start")).agg(F.max(_key()).alias("latest"))
    frontier = cut_lineage(pairs.join(starts, F.col("src") == F.col("start")).where("f < latest")
                           .select("start", "latest", F.col("dst").alias("node"), F.col("f").alias("t")))
    best, found = frontier, None
    for hops in range(2, max_depth + 1):
        step = (frontier.join(pairs, F.col("node") == F.col("src")).where("dst <> start")
                .select("start", "latest", F.col("dst").alias("node"), F.greatest("t", "f").alias("t")).where("t < latest")
                .groupBy("start", "latest", "node").agg(F.min("t").alias("t")))
        old = best.select("start", "node", F.col("t").alias("before"))
        frontier = cut_lineage(step.join(old, ["start", "node"], "left").where("before IS NULL OR t < before").drop("before"))
        best = cut_lineage(best.unionByName(frontier).groupBy("start", "latest", "node").agg(F.min("t").alias("t")))
        if hops > 3:
            hit = frontier.select(F.col("start").alias("dst"), F.col("node").alias("src"), F.lit(hops).alias("hops"), "t").join(ends, ["src", "dst"], "left_semi")
            found = hit if found is None else found.unionByName(hit)
    return found


def cycle_closure(edges: DataFrame, max_depth: int = 3, earlier: DataFrame | None = None) -> DataFrame:
    """Per transaction: does its edge close a path of at most ``max_depth`` earlier
    edges, and the cycle length (hops + 1; 1 for a self-transfer; 0 for none).

    ``earlier`` adds edges of the past that may lie on the path. Paths of up to three edges are joined from half paths; longer ones are
    looked for only where no shorter one closes the transaction.
    """
    if max_depth < 1:
        raise ValueError("max_depth must be at least 1")
    cols = ["transaction_id", "timestamp", "src", "dst"]
    known = edges.select(*cols) if earlier is None else edges.select(*cols).unionByName(earlier.select(*cols))
    j = edges.select(*cols).join(earliest_returns(known), ["src", "dst"], "left")
    length = F.when(F.col("src") == F.col("dst"), 1)
    for h in range(1, min(max_depth, 3) + 1):
        length = length.when(F.col(f"t{h}") < _key(), h + 1)
    short = j.withColumn("cycle_length", length.otherwise(0))
    if max_depth > 3:
        short = cut_lineage(short.select(*cols, "cycle_length"))
        left = short.where("cycle_length = 0")
        deep = deep_returns(known, left, max_depth)
        closed = left.join(deep, ["src", "dst"]).where(F.col("t") < _key()).groupBy("transaction_id").agg((F.min("hops") + 1).alias("longer"))
        short = short.join(closed, "transaction_id", "left").withColumn("cycle_length", F.coalesce("longer", "cycle_length"))
    return short.select("transaction_id", (F.col("cycle_length") > 0).alias("edge_creates_cycle"), "cycle_length")


def as_of_degrees(edges: DataFrame, slot_seconds: int = HOUR, earlier: DataFrame | None = None) -> DataFrame:
    """Degrees of both ends right after each transaction is added.

    ``earlier`` holds edges known from before (same four columns); each counts only for
    transactions after it, so a row that comes late sees what preceded it and no more.
    """
    cols = ["transaction_id", "timestamp", "src", "dst"]
    known = edges.select(*cols)
    if earlier is not None:
        known = known.unionByName(earlier.select(*cols).join(known.select("transaction_id"), "transaction_id", "left_anti"))
    first = known.groupBy("src", "dst").agg(F.min(_key()).alias("f"))
    first = first.select(F.col("f.transaction_id").alias("transaction_id"), F.lit(1).alias("fresh"))
    seen = known.join(first, "transaction_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    role = lambda key, r: F.struct(F.col(key).alias("account_id"), F.lit(r).alias("role"))
    rows = seen.select("transaction_id", "timestamp", "fresh", (F.col("src") == F.col("dst")).cast("int").alias("loop"),
                       F.explode(F.array(role("src", 0), role("dst", 1))).alias("x")).select("*", "x.*").drop("x")
    is_in, is_out = F.col("role"), 1 - F.col("role")
    run = running(rows, ["account_id"], ["timestamp", "transaction_id", "role"],
                  time_slot(F.col("timestamp"), slot_seconds),
                  {"i": ("sum", is_in), "o": ("sum", is_out),
                   "iu": ("sum", is_in * F.col("fresh")), "ou": ("sum", is_out * F.col("fresh"))}, store=True)
    if earlier is not None:
        run = run.join(edges.select("transaction_id"), "transaction_id", "left_semi")
    s = lambda v: F.max(F.when(F.col("role") == 0, v))
    r = lambda v: F.max(F.when(F.col("role") == 1, v))
    loop, fresh = F.col("loop"), F.col("fresh")
    return run.groupBy("transaction_id").agg(
        s(F.col("i") + loop).alias("sender_in_degree"), s(F.col("o") + 1).alias("sender_out_degree"),
        s(F.col("iu") + loop * fresh).alias("sender_in_degree_unique"), s(F.col("ou") + fresh).alias("sender_out_degree_unique"),
        r(F.col("i") + 1).alias("receiver_in_degree"), r(F.col("iu") + fresh).alias("receiver_in_degree_unique"),
        r(F.col("o")).alias("receiver_out_degree"))


def as_of_neighbourhoods(edges: DataFrame, max_nodes: int = 20, max_edges: int = 30) -> DataFrame:
    """Per transaction, right after its edge is added: the first ``max_nodes`` accounts that came within two undirected hops of
    its sender (``two_hop_neighborhood``), and the first ``max_edges`` edges at the sender, outgoing before incoming
    (``two_hop_edge_list``: u, v, ts, amount).

    An account comes within two hops when the later edge of its earliest path appears; ties go by that path's second edge, then by
    id. In this order what was there at any time is a prefix of what is there in the end, so one short list per account answers
    every transaction: no range join, and an account passes on only its first ``max_nodes + 1`` neighbours. A hub's lists are cut before
    its rows meet.
    """
    sent = edges.select(F.col("src").alias("account_id")).distinct()
    of = lambda df: df.join(sent, "account_id", "left_semi")

    e = F.struct(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("timestamp").alias("ts"), "amount")
    side = lambda key, d: edges.select(F.col(key).alias("account_id"), F.lit(d).alias("dir"), _key().alias("k"), e.alias("e"))
    w = Window.partitionBy("account_id", "dir").orderBy("k")
    few = of(side("src", 0).unionByName(side("dst", 1))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_edges)
    near_edges = few.groupBy("account_id").agg(F.sort_array(F.collect_list(F.struct("dir", "k", "e"))).alias("near_edges"))

    both = edges.where("src <> dst").select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("nb")), F.struct(F.col("dst").alias("node"), F.col("src").alias("nb")))).alias("x"), _key().alias("k"))
    pairs = cut_lineage(both.groupBy("x.node", "x.nb").agg(F.min("k").alias("f")))
    by_time = Window.partitionBy("mid").orderBy("f2", "nb")
    heads = (pairs.select(F.col("node").alias("mid"), "nb", F.col("f").alias("f2")).withColumn("r", F.row_number().over(by_time))
             .where(F.col("r") <= max_nodes + 1).drop("r"))
    mine = of(pairs.withColumnRenamed("node", "account_id"))
    reach = lambda at, then: F.struct(at.alias("reach"), then.alias("then"), F.col("nb"))
    one = mine.select("account_id", "nb", reach(F.col("f"), F.col("f")).alias("k"))
    two = (mine.select("account_id", F.col("nb").alias("mid"), "f").join(heads, "mid").where("nb <> account_id")
           .select("account_id", "nb", reach(F.greatest("f", "f2"), F.col("f2")).alias("k")))
    ranked = (one.unionByName(two).groupBy("account_id", "nb").agg(F.min("k").alias("k"))
              .withColumn("r", F.row_number().over(Window.partitionBy("account_id").orderBy("k"))).where(F.col("r") <= max_nodes))
    near_nodes = ranked.groupBy("account_id").agg(F.sort_array(F.collect_list("k")).alias("near_nodes"))

    now = edges.select("transaction_id", F.col("src").alias("account_id"), _key().alias("now"))
    known = now.join(near_edges, "account_id").join(near_nodes, "account_id", "left")
    upto = lambda items, at: F.filter(items, lambda x: x[at] <= F.col("now"))
    nodes = F.transform(upto("near_nodes", "reach"), lambda x: x["nb"])
    return known.select(
        "transaction_id", F.coalesce(nodes, F.array().cast("array<string>")).alias("two_hop_neighborhood"),
        F.transform(F.slice(upto("near_edges", "k"), 1, max_edges), lambda x: x["e"]).alias("two_hop_edge_list"))


def live_graph_vector(txn: DataFrame, graph_features: DataFrame | None = None,
                      community_risk: DataFrame | None = None, neighbourhoods: bool = False) -> DataFrame:
    """Graph vector of every transaction as of its own time.

    Degrees and cycles come from earlier edges; centralities, communities and
    community risk are looked up in the offline tables, with the defaults of an
    unknown account when absent. ``neighbourhoods`` adds the lists of ``as_of_neighbourhoods``.
    """
    edges = build_edges(txn)
    vector = look_up_graph(edges, as_of_degrees(edges), cycle_closure(edges), graph_features, community_risk)
    return vector.join(as_of_neighbourhoods(edges), "transaction_id") if neighbourhoods else vector


def look_up_graph(edges: DataFrame, degrees_now: DataFrame, cycles: DataFrame, graph_features: DataFrame | None,
                  community_risk: DataFrame | None) -> DataFrame:
    base = (edges.select("transaction_id", F.col("src").alias("sender_account"), F.col("dst").alias("receiver_account"))
            .join(degrees_now, "transaction_id").join(cycles, "transaction_id"))
    total = F.col("sender_in_degree") + F.col("sender_out_degree")
    base = base.withColumns({
        "sender_fan_in_score": F.when(total > 0, F.col("sender_in_degree") / total).otherwise(0.0),
        "sender_fan_out_score": F.when(total > 0, F.col("sender_out_degree") / total).otherwise(0.0)})
    # Output name -> (offline column, default of an unknown account)
    sender = {
        "sender_2hop_cycle_count": ("2hop_cycle_count", F.lit(0).cast("bigint")),
        "sender_3hop_cycle_count": ("3hop_cycle_count", F.lit(0).cast("bigint")),
        "sender_pagerank": ("pagerank", F.lit(0.0)), "sender_betweenness": ("betweenness", F.lit(0.0)),
        "sender_community_id": ("community_id", F.lit(-1).cast("bigint")),
        "sender_community_size": ("community_size", F.lit(0).cast("bigint")),
        "sender_community_density": ("community_density", F.lit(0.0)),
        "sender_benford_chi2_community": ("benford_chi2_community", F.lit(0.0)),
        "volume_asymmetry": ("volume_asymmetry", F.lit(0.0)),
    }
    receiver = {"receiver_community_id": ("community_id", F.lit(-1).cast("bigint"))}
    if graph_features is None:
        out = base.withColumns({n: d for n, (_, d) in {**sender, **receiver}.items()})
    else:
        side = lambda key, cols: graph_features.select(
            F.col("account_id").alias(key), *[F.col(c).alias(n) for n, (c, _) in cols.items()])
        out = (base.join(side("sender_account", sender), "sender_account", "left")
               .join(side("receiver_account", receiver), "receiver_account", "left")
               .withColumns({n: F.coalesce(F.col(n), d) for n, (_, d) in {**sender, **receiver}.items()}))
    for who in ("sender", "receiver"):
        name = f"{who}_community_risk_score"
        if community_risk is None:
            out = out.withColumn(name, F.lit(0.0))
        else:
            risk = community_risk.select(F.col("community_id").alias(f"{who}_community_id"),
                                         F.col("normalised_risk").alias(name))
            out = out.join(risk, f"{who}_community_id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))
    same = (F.col("sender_community_id") != -1) & (F.col("sender_community_id") == F.col("receiver_community_id"))
    return out.withColumn("shared_community", same)


def shortest_path_nodes(edges: DataFrame, start: str, goal: str, max_hops: int | None = None) -> int:
    """Node count of a shortest directed path, 0 when there is none.

    Frontier joins, one per hop; each round keeps only accounts not met before.
    """
    if start == goal:
        return 1
    pairs = cut_lineage(edges.select("src", "dst").distinct())
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(start,)], "node string")
    seen = frontier
    hops = 0
    while max_hops is None or hops < max_hops:
        nxt = (pairs.join(frontier, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node"))
               .distinct().join(seen, "node", "left_anti"))
        frontier = cut_lineage(nxt)
        hops += 1
        state = frontier.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("node") == goal).alias("hit")).first()
        if state["n"] == 0:
            return 0
        if state["hit"]:
            return hops + 1
        seen = seen.union(frontier)  # stored frontiers; nothing is written twice
    return 0


def ego_nodes(edges: DataFrame, account: str, hops: int = 2, cap: int | None = None) -> DataFrame:
    """Accounts within ``hops`` (1 or 2) of the centre with their full degrees."""
    if hops not in (1, 2):
        raise ValueError("hops must be 1 or 2")
    near = (two_hop_neighborhood(edges, account) if hops == 2 else
            undirected_pairs(edges).where(F.col("node") == account).select(F.col("nb").alias("account_id")))
    me = edges.where((F.col("src") == account) | (F.col("dst") == account)).select(F.lit(account).alias("account_id"))
    ids = near.union(me).distinct()
    out = (degrees(edges).join(ids, "account_id", "left_semi")
           .select("account_id", "in_degree", "out_degree", (F.col("account_id") == account).alias("is_center")))
    return out if cap is None else out.orderBy(F.col("is_center").desc(), "account_id").limit(cap)


def ego_edges(edges: DataFrame, account: str, hops: int = 2, cap: int | None = None,
              multiplicity: bool = False) -> DataFrame:
    """Collapsed edges inside the ego set; weight 1, or the number of parallel edges."""
    ids = ego_nodes(edges, account, hops, cap=None).select("account_id")
    inside = (simple_edges(edges)
              .join(ids.withColumnRenamed("account_id", "src"), "src", "left_semi")
              .join(ids.withColumnRenamed("account_id", "dst"), "dst", "left_semi"))
    weight = F.col("n_edges") if multiplicity else F.lit(1).cast("bigint")
    out = inside.select(F.col("src").alias("source"), F.col("dst").alias("target"), weight.alias("weight"))
    return out if cap is None else out.orderBy("source", "target").limit(cap)
