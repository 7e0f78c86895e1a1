import random
from collections import defaultdict, deque
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import communities as C
from ledgerlens.operators import graph as G
from ledgerlens.operators import graph_features as GF
from ledgerlens.plans.catalog import REGISTRY
from ledgerlens.session import bucketed
from make import T0, edge_frame

TRIANGLE = [("a", "b"), ("b", "c"), ("c", "a")]
SHAPES = TRIANGLE + [("h", "x"), ("h", "y"), ("p", "q"), ("q", "p"), ("s", "s"), ("1", "2"), ("2", "3"), ("3", "4"), ("4", "5"), ("m", "n"), ("m", "n")]


def random_pairs(n=120, nodes=14, seed=1):
    rnd = random.Random(seed)
    return [(f"n{rnd.randrange(nodes)}", f"n{int(nodes * rnd.random() ** 2)}") for _ in range(n)]


def asdict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def closure(pairs, depth=3):
    succ, out = defaultdict(set), []
    for s, r in pairs:
        succ[s].add(r)
        length = 1 if s == r else 0
        front = {r}
        for d in range(1, depth + 1):
            if length:
                break
            front = {y for x in front for y in succ[x]}
            if s in front:
                length = d + 1
        out.append(length)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cycle_closure_equals_bfs(spark, seed):
    pairs = random_pairs(seed=seed)
    got = asdict(G.cycle_closure(edge_frame(spark, pairs)), "transaction_id", "cycle_length")
    assert [got[f"E{i:04d}"] for i in range(len(pairs))] == closure(pairs)


def test_cycle_depth_bound(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a"), ("d", "a")]
    got = asdict(G.cycle_closure(edge_frame(spark, pairs)), "transaction_id", "cycle_length")
    assert got["E0004"] == 0 and got["E0005"] == 4


def test_as_of_degrees_equal_replay(spark):
    pairs = random_pairs(80)
    ins, outs, ui, uo = (defaultdict(int), defaultdict(int), defaultdict(set), defaultdict(set))
    want = {}
    for i, (s, r) in enumerate(pairs):
        outs[s] += 1
        ins[r] += 1
        uo[s].add(r)
        ui[r].add(s)
        want[f"E{i:04d}"] = (ins[s], outs[s], len(ui[s]), len(uo[s]), ins[r], len(ui[r]), outs[r])
    for r in G.as_of_degrees(edge_frame(spark, pairs)).collect():
        assert tuple(r)[1:] == want[r["transaction_id"]]


def test_degrees_and_simple_edges(spark):
    e = edge_frame(spark, SHAPES)
    d = {r["account_id"]: r for r in G.degrees(e).collect()}
    assert (d["m"]["out_degree"], d["m"]["out_degree_unique"]) == (2, 1)
    assert (d["s"]["in_degree"], d["s"]["out_degree"], d["s"]["total_degree"]) == (1, 1, 2)
    last = G.simple_edges(e).where("src = 'm'").first()
    assert last["n_edges"] == 2 and last["amount"] == 10.0 * len(SHAPES)


def test_cycle_counts_equal_matrix_powers(spark):
    import numpy as np
    pairs = random_pairs(90, 12, seed=4) + [("n0", "n0"), ("n1", "n1")]
    names = sorted({x for p in pairs for x in p})
    a = np.zeros((len(names),) * 2, dtype=int)
    for s, r in pairs:
        a[names.index(s), names.index(r)] = 1
    got = {r["account_id"]: (r["2hop_cycle_count"], r["3hop_cycle_count"]) for r in GF.cycle_counts(edge_frame(spark, pairs)).collect()}
    d2, d3 = np.diag(a @ a), np.diag(a @ a @ a)
    assert got == {n: (d2[i], d3[i]) for i, n in enumerate(names)}


def test_pagerank_equals_power_iteration(spark):
    import numpy as np
    pairs = random_pairs(70, 10, seed=6) + [("n0", "sink")]
    names = sorted({x for p in pairs for x in p})
    n = len(names)
    m = np.zeros((n, n))
    for s, r in pairs:
        m[names.index(s), names.index(r)] += 1
    out = m.sum(axis=1)
    p = np.divide(m, out[:, None], where=out[:, None] > 0, out=np.zeros_like(m))
    x = np.full(n, 1 / n)
    for _ in range(100):
        new = 0.85 * (x @ p + x[out == 0].sum() / n) + 0.15 / n
        done = abs(new - x).sum() < n * 1e-4
        x = new
        if done:
            break
    got = asdict(GF.pagerank(edge_frame(spark, pairs)), "account_id", "pagerank")
    assert sum(got.values()) == pytest.approx(1.0)
    for i, name in enumerate(names):
        assert got[name] == pytest.approx(x[i], abs=1e-9)


def brandes(pairs):
    succ = defaultdict(set)
    names = sorted({x for p in pairs for x in p})
    for s, r in pairs:
        if s != r:
            succ[s].add(r)
    score = dict.fromkeys(names, 0.0)
    for s in names:
        dist, sigma, order, q = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in succ[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = defaultdict(float)
        for v in reversed(order):
            for w in succ[v]:
                if dist.get(w) == dist[v] + 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if v != s:
                score[v] += delta[v]
    n = len(names)
    return {v: b / ((n - 1) * (n - 2)) for v, b in score.items()}


def test_betweenness_is_exact_on_small_graphs(spark):
    pairs = random_pairs(60, 16, seed=8)
    got = asdict(GF.betweenness(edge_frame(spark, pairs)), "account_id", "betweenness")
    want = brandes(pairs)
    assert got == pytest.approx(want, abs=1e-9)


def test_clustering_and_components(spark):
    e = edge_frame(spark, SHAPES)
    c = asdict(GF.clustering(e), "account_id", "clustering_coefficient")
    assert c["a"] == 1.0 and c["h"] == 0.0 and c["s"] == 0.0
    m = {r["account_id"]: r for r in GF.communities(e).collect()}
    assert m["a"]["community_id"] == m["c"]["community_id"] and m["1"]["community_size"] == 5 and m["s"]["community_size"] == 1
    # in order of the smallest member: 1, a, h, m, p, s
    assert [m[x]["community_id"] for x in "1ahmps"] == list(range(6))


def test_components_of_a_long_chain(spark):
    rnd = random.Random(3)
    ids = [f"c{i:03d}" for i in range(60)]
    rnd.shuffle(ids)
    got = GF.communities(edge_frame(spark, list(zip(ids, ids[1:]))))
    assert got.select("community_id").distinct().count() == 1 and got.count() == 60


def test_chain_length_and_patterns(spark):
    e = edge_frame(spark, SHAPES)
    m = GF.communities(e)
    ids = asdict(m, "account_id", "community_id")
    got = asdict(C.max_chain_length(e, m), "community_id", "max_chain_length")
    assert [got[ids[x]] for x in ("1", "h", "a", "p", "s", "m")] == [5, 2, 8, 8, 8, 2]


def test_chain_length_of_long_runs(spark, monkeypatch):
    """Contraction from the second round on, and a chain longer than all plain rounds."""
    link = lambda name, order: [(f"{name}{a:02d}", f"{name}{b:02d}") for a, b in order]
    line = lambda n: [(i, i + 1) for i in range(n - 1)]
    pairs = (link("a", line(40)) + link("b", line(30) + [(50, 20), (20, 51), (4, 25)]) + link("c", line(25) + [(24, 10)])
             + link("d", line(12) + [(11, 3), (40, 41), (41, 11)]) + link("e", [(0, 1), (1, 2), (0, 3), (3, 4), (4, 2), (2, 5), (5, 6)]) + [("f", "f")])
    e = edge_frame(spark, pairs)
    m = GF.communities(e)
    ids = asdict(m, "account_id", "community_id")
    want = {"a00": 40, "b00": 30, "c00": 8, "d00": 8, "e00": 6, "f": 8}
    for plain in (C.PLAIN_ROUNDS, 1):
        monkeypatch.setattr(C, "PLAIN_ROUNDS", plain)
        got = asdict(C.max_chain_length(e, m), "community_id", "max_chain_length")
        assert {x: got[ids[x]] for x in want} == want


def test_chain_length_of_random_graphs(spark, monkeypatch):
    rnd = random.Random(21)
    pairs = []
    for g in range(30):
        nodes = rnd.randrange(4, 16)
        for _ in range(rnd.randrange(3, 18)):
            a, b = sorted(rnd.sample(range(nodes), 2))
            pairs.append((f"{g:02d}-{a:02d}", f"{g:02d}-{b:02d}"))
    e = edge_frame(spark, pairs)
    m = GF.communities(e)
    depth = defaultdict(int)
    for a, b in sorted(set(pairs)):
        depth[b] = max(depth[b], depth[a] + 1)
    want = defaultdict(int)
    for a, c in asdict(m, "account_id", "community_id").items():
        want[c] = max(want[c], depth[a] + 1)
    for plain in (1, 2):
        monkeypatch.setattr(C, "PLAIN_ROUNDS", plain)
        assert asdict(C.max_chain_length(e, m), "community_id", "max_chain_length") == want


def test_rounds_leave_links_in_place(spark):
    """Only the other side of a join with bucketed links moves, and nothing is left behind."""
    e = edge_frame(spark, random_pairs())
    links = e.select("src", "dst").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with bucketed(links, "src") as stored:
            ranks = GF.accounts(e).select(F.col("account_id").alias("src"))
            plan = stored.join(ranks, "src")._jdf.queryExecution().executedPlan().toString()
            scan = plan[: plan.index("Bucketed: true")].splitlines()
            sides = [x for x in scan if "FileScan" in x or "Exchange" in x]
            assert len(sides) == 1 and stored.count() == links.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def dfs_paths(edges, nodes, limit=20, entries=5, hops=8):
    """Depth first over id-ordered successors, entries by out-degree."""
    succ = defaultdict(dict)
    for s, r, amount in edges:
        if s in nodes and r in nodes:
            succ[s][r] = amount
    found = []

    def go(path, total):
        if len(found) >= limit:
            return
        if len(path) >= 3:
            found.append((tuple(path), round(total, 2)))
        if len(path) == hops + 1:
            return
        for nxt in sorted(succ[path[-1]]):
            if nxt not in path:
                go([*path, nxt], total + succ[path[-1]][nxt])

    for start in sorted(nodes, key=lambda x: (-len(succ[x]), x))[:entries]:
        if succ[start]:
            go([start], 0.0)
    return found


def test_suspicious_paths_equal_dfs(spark):
    rnd = random.Random(12)
    dense = [(f"d{rnd.randrange(9)}", f"d{rnd.randrange(9)}") for _ in range(60)]
    thin = [("t1", "t2"), ("t2", "t3"), ("t3", "t1"), ("t1", "t1")]
    short = [("u1", "u2"), ("u3", "u2")]
    e = edge_frame(spark, dense + thin + short)
    m = GF.communities(e)
    p = m.groupBy("community_id").agg(F.count(F.lit(1)).alias("size")).withColumns({"risk_score": F.lit(50.0), "dominant_pattern": F.lit("mixed")})
    rows = C.suspicious_paths(e, m, p, max_paths=20, entry_nodes=5).collect()
    members = defaultdict(set)
    for a, c in asdict(m, "account_id", "community_id").items():
        members[c].add(a)
    simple = [tuple(r) for r in G.simple_edges(e).select("src", "dst", "amount").collect()]
    for c, nodes in members.items():
        got = sorted((r["path_id"], tuple(r["path"]), round(r["total_amount"], 2)) for r in rows if r["community_id"] == c)
        assert [x[1:] for x in got] == dfs_paths(simple, nodes)
        assert all(len(r["path"]) == r["num_hops"] + 1 for r in rows)


@pytest.mark.parametrize("hops,entries", [(8, None), (5, None), (2, None), (6, 3)])
def test_all_suspicious_paths_equal_dfs(spark, hops, entries):
    rnd = random.Random(13)
    pairs = [(f"d{rnd.randrange(9)}", f"d{rnd.randrange(9)}") for _ in range(26)] + [(f"k{i:02d}", f"k{i + 1:02d}") for i in range(12)] + [("t1", "t2"), ("t2", "t3"), ("t3", "t1")]
    e = edge_frame(spark, pairs)
    m = GF.communities(e)
    p = m.groupBy("community_id").agg(F.count(F.lit(1)).alias("size")).withColumns({"risk_score": F.lit(50.0), "dominant_pattern": F.lit("mixed")})
    rows = C.suspicious_paths(e, m, p, max_hops=hops, entry_nodes=entries).collect()
    simple = [tuple(r) for r in G.simple_edges(e).select("src", "dst", "amount").collect()]
    members = defaultdict(set)
    for a, c in asdict(m, "account_id", "community_id").items():
        members[c].add(a)
    for c, nodes in members.items():
        got = sorted((int(r["path_id"].split("_")[2]), tuple(r["path"]), round(r["total_amount"], 2)) for r in rows if r["community_id"] == c)
        assert [x[0] for x in got] == list(range(len(got)))
        assert [x[1:] for x in got] == dfs_paths(simple, nodes, 10 ** 6, entries, hops)


def test_halves_of_paths_lie_in_rows_of_bounded_size(spark, monkeypatch):
    """Numbers stay those of the depth-first list when an account's second halves are cut into many rows."""
    monkeypatch.setattr(C, "PATH_CHUNK", 3)
    rnd = random.Random(14)
    e = edge_frame(spark, [(f"d{rnd.randrange(8)}", f"d{rnd.randrange(8)}") for _ in range(24)])
    simple = [tuple(r) for r in G.simple_edges(e).select("src", "dst", "amount").collect()]
    halves = C._second_halves([spark.createDataFrame([([a, b], m) for a, b, m in simple], "path array<string>, total_amount double")])
    assert max(len(r["halves"]) for r in halves.collect()) <= 3 < max(sum(a == n for a, _, _ in simple) for n, _, _ in simple)
    m = GF.communities(e)
    p = m.groupBy("community_id").agg(F.count(F.lit(1)).alias("size")).withColumns({"risk_score": F.lit(50.0), "dominant_pattern": F.lit("mixed")})
    rows = C.suspicious_paths(e, m, p).where("community_id = 0").collect()
    got = sorted((int(r["path_id"].split("_")[2]), tuple(r["path"]), round(r["total_amount"], 2)) for r in rows)
    nodes = {a for a, c in asdict(m, "account_id", "community_id").items() if c == 0}
    assert [x[0] for x in got] == list(range(len(got))) and [x[1:] for x in got] == dfs_paths(simple, nodes, 10 ** 6, None, 8)


def test_all_suspicious_paths_lists_all_eight_hops(spark, tmp_path):
    """The registered query leaves no hop out: a ring of twelve accounts with a payment back, the last one risky for its cycles and digits."""
    pairs = [(i, (i + 1) % 12) for i in range(12)] + [(1, 0), (5, 0)]
    # the fixture pays (5 * key + 3) % 12 of the sender's group of twelve
    orders = [(120 * i + 5 * (to - 3) % 12, 12 + a, 9000.0 + i, T0 + timedelta(days=i)) for i, (a, to) in enumerate(pairs)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    rows = REGISTRY["all_suspicious_paths"].plan(spark, str(tmp_path)).collect()
    name = lambda i: f"C{12 + i:08d}"
    simple = [(name(a), name(b), 9000.0 + i) for i, (a, b) in enumerate(pairs)]
    wanted = dfs_paths(simple, {name(i) for i in range(12)}, 10 ** 6, None, 8)
    assert [(tuple(r["path"]), round(r["total_amount"], 2)) for r in sorted(rows, key=lambda r: r["path_id"])] == wanted
    assert max(r["num_hops"] for r in rows) == 8


def test_two_hop_cap_is_exact_around_a_hub(spark):
    pairs = [("hub", f"x{i:02d}") for i in range(40)] + [("x00", "y"), ("y", "z")]
    e = edge_frame(spark, pairs)
    got = asdict(G.two_hop_capped(e, 5), "account_id", "two_hop_neighborhood")
    assert got["hub"] == ["x00", "x01", "x02", "x03", "x04"]
    assert got["x39"] == ["hub", "x00", "x01", "x02", "x03"]
    assert got["z"] == ["x00", "y"]


def test_point_lookups(spark):
    e = edge_frame(spark, SHAPES)
    assert G.shortest_path_nodes(e, "1", "5") == 5 and G.shortest_path_nodes(e, "5", "1") == 0 and G.shortest_path_nodes(e, "a", "a") == 1
    assert {tuple(r) for r in G.neighbors(e, "a").collect()} == {("successor", "b"), ("predecessor", "c")}
    assert {r["account_id"] for r in G.ego_nodes(e, "3", 1).collect()} == {"2", "3", "4"}
    assert asdict(G.ego_edges(e, "m", multiplicity=True), "source", "weight") == {"m": 2}
    assert G.graph_stats(e).first()["edges"] == len(SHAPES)


def test_edge_rows_are_numbered_like_the_lists(spark):
    """One row per account and edge, positions as in the lists, and no list of a whole history in the query."""
    from ledgerlens.plans import catalog

    edges = edge_frame(spark, random_pairs())
    rows = defaultdict(list)
    for r in G.one_hop_edge_rows(edges).collect():
        rows[r.account_id].append((r.position, r.src, r.dst, r.timestamp, r.amount))
    want = {a: [(i + 1, *e) for i, e in enumerate(x)] for a, x in asdict(G.one_hop_edge_list(edges), "account_id", "two_hop_edge_list").items()}
    assert {a: sorted(x) for a, x in rows.items()} == want
    plan = catalog.REGISTRY["one_hop_edge_list"].query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_as_of_lists_equal_a_replay(spark):
    """Both lists after every edge, with a hub, self-transfers, equal times and short caps."""
    rnd = random.Random(8)
    e = [(rnd.choice("habcdefg" if i % 3 else "hh"), rnd.choice("habcdefgz"), f"E{i:03d}", T0 + timedelta(seconds=i // 2 * 60), float(i), False) for i in range(90)]
    df = spark.createDataFrame(e, "src string, dst string, transaction_id string, timestamp timestamp, amount double, is_fraud boolean")
    got = {r["transaction_id"]: r for r in G.as_of_neighbourhoods(df, max_nodes=4, max_edges=5).collect()}
    order = sorted(e, key=lambda x: (x[3], x[2]))
    assert len(got) == len(e)
    for i, now in enumerate(order):
        first = {}
        for k, (a, b, *_) in enumerate(order[: i + 1]):
            if a != b:
                first.setdefault((a, b), k)
                first.setdefault((b, a), k)
        reach = {}
        for (v, u), f in first.items():
            if v == now[0]:
                reach[u] = min(reach.get(u, (f, f)), (f, f))
                for (m, w), g in first.items():
                    if m == u and w != v:
                        reach[w] = min(reach.get(w, (i + 1, 0)), (max(f, g), g))
        near = sorted(reach, key=lambda w: (*reach[w], w))[:4]
        beside = [x for x in order[: i + 1] if x[0] == now[0]] + [x for x in order[: i + 1] if x[1] == now[0]]
        assert got[now[2]]["two_hop_neighborhood"] == near, i
        assert [tuple(x) for x in got[now[2]]["two_hop_edge_list"]] == [(x[0], x[1], x[3], x[4]) for x in beside[:5]], i


def test_cycles_of_any_length_equal_a_breadth_first_search(spark):
    rnd = random.Random(4)
    pairs = [(f"n{a}", f"n{(a + 1 + rnd.randrange(2)) % 14}") for a in (rnd.randrange(14) for _ in range(70))] + [("n1", "n1")]
    for depth in (2, 4, 6):
        got = {r["transaction_id"]: r["cycle_length"] for r in G.cycle_closure(edge_frame(spark, pairs), max_depth=depth).collect()}
        for i, (a, b) in enumerate(pairs):
            out = {}
            for x, y in pairs[:i]:
                out.setdefault(x, set()).add(y)
            level, length = {b}, 1 if a == b else 0
            for h in range(1, depth + 1):
                level = {y for x in level for y in out.get(x, ())}
                if not length and a in level:
                    length = h + 1
            assert got[f"E{i:04d}"] == length, (depth, i)


def test_the_digit_of_an_amount_is_worked_out_once_a_row(spark):
    e = edge_frame(spark, [("a", "b"), ("b", "c"), ("x", "y")])
    members = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("x", 1), ("y", 1)], "account_id string, community_id long")
    found = GF.community_benford(e, members)
    assert {r[0] for r in found.collect()} == {0, 1}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("%.2f") <= 2
