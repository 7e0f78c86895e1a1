"""Community profiles, risk and suspicious paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import clip
from ledgerlens.operators.graph import simple_edges
from ledgerlens.operators.scans import range_slots, running
from ledgerlens.session import cut_lineage

CHAIN_IF_CYCLIC = 8


def community_aggregates(features: DataFrame) -> DataFrame:
    avg = lambda c, n: F.avg(c).alias(n)
    volume = (F.sum("ego_in_volume_7d") + F.sum("ego_out_volume_7d")) / 2.0
    return features.groupBy("community_id").agg(
        F.count(F.lit(1)).alias("size"), avg("pagerank", "avg_pagerank"), avg("betweenness", "avg_betweenness"),
        avg("fan_in_score", "avg_fan_in"), avg("fan_out_score", "avg_fan_out"), avg("community_density", "density"),
        avg("benford_chi2_community", "avg_benford_chi2"), volume.alias("total_volume"),
        F.sum("2hop_cycle_count").alias("two_hop_cycles"))


def _label(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    return df.join(members.select(F.col("account_id").alias(key), F.col("community_id").alias(name)), key)


def community_avg_amount(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Mean amount of the edges with either end inside; pairs are summed first."""
    pairs = edges.groupBy("src", "dst").agg(F.sum("amount").alias("s"), F.count(F.lit(1)).alias("n"))
    both = _label(_label(pairs, members, "src", "cs"), members, "dst", "cd")
    return (both.select("s", "n", F.explode(F.array_distinct(F.array("cs", "cd"))).alias("community_id"))
            .groupBy("community_id").agg((F.sum("s") / F.sum("n")).alias("avg_amount")))


def fraud_nodes(edges: DataFrame) -> DataFrame:
    bad = edges.where("is_fraud")
    return bad.select(F.col("src").alias("account_id")).union(bad.select(F.col("dst").alias("account_id"))).distinct()


def fraud_node_counts(edges: DataFrame, members: DataFrame) -> DataFrame:
    hit = fraud_nodes(edges).withColumn("bad", F.lit(1))
    return (members.join(hit, "account_id", "left").groupBy("community_id")
            .agg(F.count("bad").alias("num_fraud_nodes")))


# So many rounds of a job each come before runs of accounts are contracted.
PLAIN_ROUNDS = 16


def _peeled(links: DataFrame, how: str = "left_semi") -> DataFrame:
    """Links that leave accounts with incoming links; with ``left_anti`` the others."""
    return links.join(links.select(F.col("dst").alias("src")).distinct(), "src", how)


def _longest(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy("account_id", "community_id").agg(F.max("best").alias("best"))


def _contracted(links: DataFrame, best: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of accounts with one link in and one out become one link as long as the run.

    Every such account knows the next one and how far it is; each round it takes over what that one knows, so
    a run of n accounts needs log2(n) rounds. Returns the links, the longest paths known to end at accounts,
    and the communities with a run that closes on itself, whose links are gone.
    """
    outs = links.groupBy(F.col("src").alias("v")).agg(
        F.count(F.lit(1)).alias("outs"), F.min("dst").alias("next"), F.min("w").alias("dist"), F.min("community_id").alias("community_id"))
    ins = links.groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("ins"))
    start = best.select(F.col("account_id").alias("v"), "best")
    run = cut_lineage(outs.join(ins, "v").where("outs = 1 AND ins = 1").join(start, "v", "left").select(
        "v", "community_id", "next", "dist", (F.coalesce("best", F.lit(0)) + F.col("dist")).alias("gain")))
    going = -1
    while True:
        ahead = run.select(F.col("v").alias("next"), F.col("next").alias("far"), F.col("dist").alias("more"), F.col("gain").alias("ahead"))
        more = F.coalesce("more", F.lit(0))
        run = cut_lineage(run.join(ahead, "next", "left").select(
            "v", "community_id", F.coalesce("far", "next").alias("next"), (F.col("dist") + more).alias("dist"),
            F.greatest(F.col("gain") + more, "ahead").alias("gain"), F.col("far").isNotNull().alias("going")))
        still = run.where("going").count()
        if still in (0, going):
            break
        run, going = run.drop("going"), still
    done = run.where("NOT going")
    reached = done.select(F.col("next").alias("account_id"), "community_id", F.col("gain").alias("best"))
    kept = (links.join(run.select(F.col("v").alias("src")), "src", "left_anti")
            .join(done.select(F.col("v").alias("dst"), "next", "dist"), "dst", "left")
            .groupBy("src", F.coalesce("next", "dst").alias("dst"), "community_id")
            .agg(F.max(F.col("w") + F.coalesce("dist", F.lit(0))).alias("w")))
    return cut_lineage(kept), cut_lineage(_longest(best, reached)), run.where("going").select("community_id")


def max_chain_length(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Accounts on the longest path inside each community, 8 when it has a cycle.

    Round by round the links leaving accounts without incoming links are removed.
    A community whose last link goes in round i has a longest path of i + 1
    accounts; one that keeps links when nothing can be removed any more is cyclic.
    Where links outlast ``PLAIN_ROUNDS`` rounds, each further round contracts runs
    of accounts first and carries path lengths along, so that the number of jobs
    grows with the logarithm of a run.
    """
    inside = _label(_label(edges.select("src", "dst").distinct(), members, "src", "cs"), members, "dst", "cd")
    links = cut_lineage(inside.where("cs = cd").select("src", "dst", F.col("cs").alias("community_id")))
    found, depth, size, moved = [], 0, links.count(), True
    while size and moved and depth < PLAIN_ROUNDS:
        depth += 1
        found.append(links.select("community_id", F.lit(depth).cast("bigint").alias("d")).distinct())
        links = cut_lineage(_peeled(links))
        size, last = links.count(), size
        moved = size < last
    stuck = []
    if size and moved:
        # every account without incoming links now ends a path of ``depth`` links
        links = links.withColumn("w", F.lit(1).cast("bigint"))
        best = links.select(F.col("src").alias("account_id"), "community_id", F.lit(depth).cast("bigint").alias("best")).distinct()
        while size and moved:
            links, best, closed = _contracted(links, best)
            stuck.append(closed)
            ends = _peeled(links, "left_anti").join(best.select(F.col("account_id").alias("src"), "best"), "src", "left").select(
                F.col("dst").alias("account_id"), "community_id", (F.coalesce("best", F.lit(0)) + F.col("w")).alias("best"))
            best = cut_lineage(_longest(best, ends))
            links = cut_lineage(_peeled(links))
            size, last = links.count(), size
            moved = size < last
        found.append(best.select("community_id", F.col("best").alias("d")))
    stuck.append(links.select("community_id"))
    cyclic = reduce(DataFrame.union, stuck).distinct().withColumn("cyclic", F.lit(True))
    every = members.select("community_id").distinct()
    rounds = reduce(DataFrame.union, found) if found else every.select("community_id", F.lit(0).alias("d"))
    longest = rounds.groupBy("community_id").agg(F.max("d").alias("d"))
    value = F.when(F.col("cyclic"), CHAIN_IF_CYCLIC).otherwise(F.coalesce("d", F.lit(0)) + 1).cast("int")
    return (every.join(longest, "community_id", "left").join(cyclic, "community_id", "left")
            .select("community_id", value.alias("max_chain_length")))


def dominant_pattern(has_cycle: Column, size: Column, fan_in: Column, fan_out: Column, chain: Column) -> Column:
    return (F.when(has_cycle & (size >= 3), "circular_laundering").when(fan_in >= 0.70, "fan_in")
            .when(fan_out >= 0.70, "fan_out").when(chain >= 4, "layering_chain").otherwise("mixed"))


def community_risk_score(density: Column, has_cycle: Column, fan_in: Column, fan_out: Column,
                         chi2: Column, fraud: Column, size: Column) -> Column:
    over = lambda c: F.greatest(c - 0.5, F.lit(0.0)) * 20.0
    return F.least(F.lit(100.0), (
        density * 30.0 + F.when(has_cycle, 25.0).otherwise(0.0) + over(fan_in) + over(fan_out)
        + F.least(chi2 / 20.0, F.lit(1.0)) * 15.0 + F.when(size > 0, fraud / size * 20.0).otherwise(0.0)))


# A community row names so many accounts.
TOP_ACCOUNTS = 5


def top_accounts(features: DataFrame, k: int = TOP_ACCOUNTS) -> DataFrame:
    w = Window.partitionBy("community_id").orderBy(F.col("pagerank").desc(), "account_id")
    best = features.select("community_id", "account_id", "pagerank").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return best.groupBy("community_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("r", "account_id"))), lambda x: x["account_id"]).alias("top_accounts"))


def _with_risk(edges: DataFrame, features: DataFrame) -> DataFrame:
    members = features.select("account_id", "community_id")
    j = community_aggregates(features)
    for t in (community_avg_amount(edges, members), fraud_node_counts(edges, members),
              max_chain_length(edges, members), top_accounts(features)):
        j = j.join(t, "community_id")
    c = F.col
    cyc = c("two_hop_cycles") > 0
    return j.withColumns({
        "has_cycle": cyc, "has_fan_in": c("avg_fan_in") >= 0.60, "has_fan_out": c("avg_fan_out") >= 0.60,
        "dominant_pattern": dominant_pattern(cyc, c("size"), c("avg_fan_in"), c("avg_fan_out"), c("max_chain_length")),
        "raw_risk": community_risk_score(c("density"), cyc, c("avg_fan_in"), c("avg_fan_out"),
                                         c("avg_benford_chi2"), c("num_fraud_nodes"), c("size"))})


def community_profiles(edges: DataFrame, features: DataFrame) -> DataFrame:
    """The 15-column community table."""
    r = lambda c, n, d: F.round(c, d).alias(n)
    return _with_risk(edges, features).select(
        "community_id", "size", r("density", "density", 6), "dominant_pattern",
        r("avg_pagerank", "avg_pagerank", 8), r("avg_betweenness", "avg_betweenness", 8),
        r("total_volume", "total_volume", 2), r("avg_amount", "avg_amount", 2), "num_fraud_nodes",
        r("raw_risk", "risk_score", 2), "has_cycle", "has_fan_in", "has_fan_out",
        r("avg_benford_chi2", "avg_benford_chi2", 4), "top_accounts")


# Second halves of paths that lie in one row.
PATH_CHUNK = 4096


def _second_halves(levels: list[DataFrame]) -> DataFrame:
    """The paths from each account (``middle``) without it, in their order, in rows of at most ``PATH_CHUNK``; ``slot`` and ``chunk`` rise in that order."""
    rest = F.slice("path", 2, F.size("path") - 1)
    back = reduce(DataFrame.union, levels).select(F.element_at("path", 1).alias("middle"), rest.alias("rest"), F.col("total_amount").alias("more"))
    slotted = range_slots(back, ["middle", "rest"], "slot")
    place = F.row_number().over(Window.partitionBy("middle", "slot").orderBy("rest")) - 1
    return (slotted.withColumn("chunk", F.floor(place / PATH_CHUNK)).groupBy("middle", "slot", "chunk")
            .agg(F.sort_array(F.collect_list(F.struct("rest", "more"))).alias("halves")))


def _whole_paths(step: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """Every simple path of 2..``max_hops`` hops from the seeds, with its number ``i`` in its community.

    Paths of up to half the hops are built hop by hop from all accounts; longer ones are two of them that meet at their
    common account. Each first half knows how many paths it begins, and a running sum of these gives the number of the
    first one; only halves and these sums are stored and moved, the paths themselves are made last, where their halves met.
    """
    half = (max_hops + 1) // 2
    last, size = F.element_at("path", -1), F.size("path")
    level = cut_lineage(step.select(F.array("src", "dst").alias("path"), F.col("amount").alias("total_amount")))
    levels = [level]
    for _ in range(2, half + 1):
        level = cut_lineage(level.join(step.select("src", "dst", "amount"), last == F.col("src")).where(~F.array_contains("path", F.col("dst")))
                            .select(F.concat("path", F.array("dst")).alias("path"), (F.col("total_amount") + F.col("amount")).alias("total_amount")))
        levels.append(level)
    seeded = lambda df: df.withColumn("src", F.element_at("path", 1)).join(seeds, "src").drop("src")
    none = lambda kind: F.lit(None).cast(kind)
    own = reduce(DataFrame.union, levels).where(size > 2)
    begun = seeded(own).withColumns({"middle": none("string"), "slot": F.lit(-1).cast("bigint"), "chunk": F.lit(-1).cast("bigint"), "n": F.lit(1)})
    halves = cut_lineage(_second_halves(levels[: max_hops - half] if max_hops > half else [level.where("false")]))
    fitting = F.filter("halves", lambda x: ~F.arrays_overlap("path", x["rest"]))
    met = (seeded(level).withColumn("middle", last).join(halves, "middle").withColumn("n", F.size(fitting)).where("n > 0")
           .select(*begun.columns))
    # a first half stands before the paths that it begins; stored, as sampling the bounds would fit the halves once more
    numbered = running(cut_lineage(begun.unionByName(met)), ["community_id"], ["entry", "path", "slot", "chunk"], None, {"i": ("sum", F.col("n"))})
    numbered = cut_lineage(numbered.drop("entry", "n"))
    cols = ["community_id", "dominant_pattern", "i", "path", "total_amount"]
    longer = (numbered.join(halves, ["middle", "slot", "chunk"]).select(*cols, F.posexplode(fitting).alias("at", "half"))
              .select("community_id", "dominant_pattern", (F.col("i") + F.col("at")).alias("i"), F.concat("path", "half.rest").alias("path"),
                      (F.col("total_amount") + F.col("half.more")).alias("total_amount")))
    return numbered.where("slot < 0").select(*cols).union(longer)


def suspicious_paths(edges: DataFrame, members: DataFrame, profiles: DataFrame, *, max_paths: int | None = None,
                     entry_nodes: int | None = None, max_hops: int = 8, min_risk: float = 40.0) -> DataFrame:
    """Simple paths of 2..8 hops per risky community; with ``max_paths`` the first so many of each.

    Paths are listed entry by entry (highest out-degree first), depth first, in
    id order. Every prefix of two or more hops is itself listed before its
    extensions, so keeping the first ``max_paths`` partial paths of each length
    loses none of the listed ones. Without ``max_paths`` all paths are met in the
    middle and numbered by what their first halves begin, so no task holds a community.
    """
    risky = profiles.where(
        (F.col("risk_score") >= min_risk) & (F.col("size") >= 3)
        & F.col("dominant_pattern").isin("layering_chain", "circular_laundering", "mixed")
    ).select("community_id", "dominant_pattern")
    m = members.join(risky, "community_id", "left_semi").select("account_id", "community_id")
    inside = _label(_label(simple_edges(edges), m, "src", "cs"), m, "dst", "cd").where("cs = cd")
    links = cut_lineage(inside.select("src", "dst", "amount", F.col("cs").alias("community_id")))

    out_deg = links.groupBy("community_id", "src").agg(F.count(F.lit(1)).alias("deg"))
    if entry_nodes is None:
        ranked = running(out_deg.withColumn("fewer", -F.col("deg")), ["community_id"], ["fewer", "src"], None, {"before": ("sum", F.lit(1))})
        seeds = ranked.select("community_id", "src", (F.col("before") + 1).alias("entry"))
    else:
        by_deg = Window.partitionBy("community_id").orderBy(F.col("deg").desc(), "src")
        seeds = out_deg.withColumn("entry", F.row_number().over(by_deg)).where(F.col("entry") <= entry_nodes).drop("deg")
    step = links.where("src <> dst")
    if max_paths is None:
        every = _whole_paths(step, seeds.join(risky, "community_id"), max_hops)
    else:
        every = _first_paths(step, seeds, max_hops, max_paths).join(risky, "community_id")
    return every.select(
        F.format_string("PATH_%d_%04d", "community_id", "i").alias("path_id"), "community_id", "path", (F.size("path") - 1).alias("num_hops"),
        "total_amount", "dominant_pattern")


def _first_paths(step: DataFrame, seeds: DataFrame, max_hops: int, max_paths: int) -> DataFrame:
    """The first ``max_paths`` paths of each community with their numbers; every map task cuts before the shuffle."""
    listed = Window.partitionBy("community_id").orderBy("entry", "path")
    first = lambda df: df.withColumn("_r", F.row_number().over(listed)).where(F.col("_r") <= max_paths).drop("_r")
    paths = seeds.select("community_id", "entry", F.array("src").alias("path"), F.lit(0.0).alias("total_amount"))
    found = []
    for hops in range(1, max_hops + 1):
        last = F.element_at("path", -1)
        nxt = (paths.withColumn("src", last).join(step.select("src", "dst", "amount"), "src")
               .where(~F.array_contains("path", F.col("dst")))
               .select("community_id", "entry", F.concat("path", F.array("dst")).alias("path"),
                       (F.col("total_amount") + F.col("amount")).alias("total_amount")))
        if hops == 1:
            # a single hop is not listed itself: keep those that can be extended
            more = step.select(F.col("src").alias("a"), F.col("dst").alias("b"))
            nxt = nxt.join(more, (F.element_at("path", -1) == F.col("a")) & (F.element_at("path", 1) != F.col("b")), "left_semi")
        paths = cut_lineage(first(nxt))
        if hops >= 2:
            found.append(paths)
    return first(reduce(DataFrame.union, found)).withColumn("i", F.row_number().over(listed) - 1)


def normalised_community_risk(profiles: DataFrame) -> DataFrame:
    """33 points per standard deviation above the mean risk, within 0..100."""
    stats = profiles.agg(F.struct(F.avg("risk_score").alias("mean"),
                                  F.greatest(F.coalesce(F.stddev_samp("risk_score"), F.lit(0.0)), F.lit(1.0)).alias("std"))).scalar()
    z = (F.col("risk_score") - stats["mean"]) / stats["std"]
    return profiles.select("community_id", "risk_score", clip(z * 33.0).alias("normalised_risk"))


def list_communities(profiles: DataFrame, min_risk: float = 0.0, limit: int | None = None) -> DataFrame:
    found = profiles.where(F.col("risk_score") >= min_risk).orderBy(F.col("risk_score").desc(), "community_id")
    return found if limit is None else found.limit(limit)


def community(profiles: DataFrame, community_id: int) -> DataFrame:
    return profiles.where(F.col("community_id") == community_id)


def paths_of(paths: DataFrame, community_id: int | None = None, limit: int | None = None) -> DataFrame:
    chosen = (paths if community_id is None else paths.where(F.col("community_id") == community_id)).orderBy("path_id")
    return chosen if limit is None else chosen.limit(limit)
