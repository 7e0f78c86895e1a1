"""Near duplicates against all pairs; components against a union-find; MinHash estimates."""

import itertools
import random

import numpy as np
from conftest_llm import documents

from ledgerlens.llm import dedup, minhash, queries
from ledgerlens.llm.components import components


def plain_set(text, words):
    w = (text or "").encode().lower().split()
    if len(w) < words:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))


def plain_groups(rows, words, percent):
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    sets = [(d, plain_set(t, words)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in parent}


def corpus(seed, n=160):
    """Chains of small edits, exact copies, short texts, and texts around the threshold."""
    r = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.6:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, 4)):
                if w:
                    w[r.randrange(len(w))] = r.choice(["x", "y", f"e{r.randrange(50)}"])
            text = " ".join(w)
        else:
            text = " ".join(f"w{r.randrange(400)}" for _ in range(r.choice([0, 1, 2, 3, 5, 12, 40, 90, 200])))
        texts.append(text)
        rows.append((i * 3, text.upper() if r.random() < 0.1 else text))
    r.shuffle(rows)
    return rows


def test_groups_equal_all_pairs(spark, sf_of):
    for seed in (1, 2):
        rows = corpus(seed)
        sf = sf_of(documents=documents(rows))
        want = plain_groups(rows, 3, 85)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op2_near_duplicates(spark, sf).collect()}
        assert got == {d: (len(plain_set(t, 3)), want[d], want[d] == d) for d, t in rows}


def test_what_stars_miss_is_found(spark, sf_of, monkeypatch):
    """A ring of texts, each near its neighbours only, in blocks of three."""
    monkeypatch.setattr(dedup, "BLOCK", 3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for k in range(3):
            w[(i + k) * 2 % 120] = f"e{i + k}"
        rows.append((i, " ".join(w)))
    sf = sf_of(documents=documents(rows))
    want = plain_groups(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in queries.op2_near_duplicates(spark, sf).collect()} == want


def test_last_pair_of_a_large_family_is_found(spark, sf_of):
    """A shared template just below the threshold, and one pair above it that is no centre of its buckets."""
    for seed in (2, 9):  # the hashes are fixed: here the pair's buckets all have other centres
        r = random.Random(seed)
        template = [f"t{r.randrange(10**6)}" for _ in range(180)]
        rows = [(i, " ".join(template + [f"u{i}.{k}" for k in range(20)])) for i in range(100)]
        rows += [(i, " ".join(template + [f"p{k}" for k in range(6)] + [f"u{i}.{k}" for k in range(14)])) for i in (100, 101)]
        met = {}
        for i, t in rows:
            s = minhash.shingle_set(t, 3)
            for k in minhash.bands(minhash.signature(s), dedup.ROWS):
                met.setdefault(int(k), []).append((minhash.digest(s), i))
        shared = [m for m in met.values() if {100, 101} <= {i for _, i in m}]
        assert shared and all(len(m) > 2 and min(m)[1] < 100 for m in shared)
        want = plain_groups(rows, 3, 85)
        assert want == {i: i for i in range(101)} | {101: 100}
        assert {x.doc_id: x.component_id for x in queries.op2_near_duplicates(spark, sf_of(documents=documents(rows))).collect()} == want


def test_awkward_rows(spark, sf_of, awkward):
    sf = sf_of(documents=documents(awkward))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in queries.op2_near_duplicates(spark, sf).collect()), key=str)
    want = {d: d for d, _ in awkward} | {6: 5, 13: 12}
    assert got == sorted(((d, len(plain_set(t, 3)), want[d], want[d] == d) for d, t in awkward), key=str)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = dedup.near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    want5 = {d: d for d, _ in awkward} | {6: 5, 13: 12}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in awkward if want5[d] == d), key=str)


def test_empty_table(spark, sf_of):
    assert queries.op2_near_duplicates(spark, sf_of()).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 50)] + [(300 + i, 300 + (i + 1) % 20) for i in range(20)]
    edges += [(400 + r.randrange(60), 400 + r.randrange(60)) for _ in range(40)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    r.shuffle(edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_signature_estimates_similarity():
    r = random.Random(6)
    for size in (3, 20, 100, 1000):
        off = []
        for _ in range(40):
            words = [f"w{r.random()}" for _ in range(size + 4)]
            other = list(words)
            other[r.randrange(len(other))] = "other"
            a, b = (minhash.shingle_set(" ".join(x), 3) for x in (words, other))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            off.append((minhash.signature(a) == minhash.signature(b)).mean() - true)
        assert abs(np.mean(off)) < 0.06


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 77}" for i in range(3000)) + " " + "q" * 500
    whole = minhash.shingle_set(text, 3)
    monkeypatch.setattr(minhash, "PIECE", 64)
    assert (minhash.shingle_set(text, 3) == whole).all()
    assert len(whole) == len(plain_set(text, 3))
