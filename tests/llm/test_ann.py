"""Nearest neighbours: recall and order against brute force, copies, ties and odd vectors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import ann, queries


def table_of(rows, kind=pa.float32()):
    n = len(rows)
    return pa.table({
        "vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(kind)),
        "label": pa.array([0] * n, pa.int32()), **{c: pa.array(["x"] * n) for c in ("v", "id", "q", "rep", "list", "part", "r", "score", "rank")}})


def brute(rows, k=20):
    """query_id -> [(vec_id, score)], of usable rows of one length."""
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array([i for i, _ in usable])
    x = np.array([v for _, v in usable], np.float64)
    out = {}
    for i, v in usable:
        if i % 20 == 0:
            score = np.zeros(len(x))
            for j in range(x.shape[1]):
                score += x[:, j] * v[j]
            best = [b for b in np.lexsort((ids, -score)) if ids[b] != i][:k]
            out[i] = [(int(ids[b]), float(score[b])) for b in best]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], r["score"]))
    return out


def clusters(n, dim, seed, kind=np.float32):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(12, dim))
    x = middle[r.integers(0, 12, n)] + 0.8 * r.normal(size=(n, dim))
    return [(i, [float(y) for y in v]) for i, v in enumerate((x * r.uniform(0.3, 2, (n, 1))).astype(kind))]


@pytest.fixture
def small_lists(monkeypatch):
    monkeypatch.setattr(ann, "LIST", 40)
    monkeypatch.setattr(ann, "PART_VALUES", 3200)
    monkeypatch.setattr(ann, "QUERY_PART", 8)


def test_recall_and_exact_scores(spark, sf_of, small_lists):
    """Norms differ, lists are split in parts, and the search graph has more lists than a beam."""
    rows = clusters(6000, 16, 1)
    got, expected = answers(queries.op11_nearest(spark, sf_of(embeddings=table_of(rows)))), brute(rows)
    assert got.keys() == expected.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(dict(got[q]).keys() & dict(expected[q]).keys()) for q in expected]) / 20 >= 0.9
    x = dict(rows)
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))
        for i, score in near:
            assert score == pytest.approx(float(np.dot(np.array(x[q], np.float64), np.array(x[i], np.float64))), rel=1e-12, abs=1e-12)


def test_copies_ties_and_odd_vectors(spark, sf_of):
    """Few rows are read whole, so the result is exact: thousands of copies, equal scores, unusable vectors, repeated rows."""
    nan, inf = float("nan"), float("inf")
    unit = [[float(i == j) for j in range(6)] for i in range(6)]
    rows = [(i, unit[i % 3]) for i in range(3000)] + [(i, [0.5, 0.25, 0.0, 0.0, 1.0, -0.0]) for i in range(5000, 5040)] + [(-20, unit[5]), (-19, unit[4])]
    rows += [(10_000, None), (10_020, []), (10_040, [0.0] * 6), (10_060, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (10_080, [nan] * 6), (10_100, [inf, 1.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(None, unit[0]), (0, unit[0]), (20, unit[2])]
    assert answers(queries.op11_nearest(spark, sf_of(embeddings=table_of(rows)))) == brute(rows)


def test_few_rows_and_other_lengths(spark, sf_of):
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0])]
    got = answers(queries.op11_nearest(spark, sf_of(embeddings=table_of(rows + [(40, [1.0])], pa.float64()))))
    assert got == {0: [(20, 4.0), (3, 3.0)], 20: [(0, 4.0), (3, 3.0)]}
    assert answers(queries.op11_nearest(spark, sf_of(embeddings=table_of([])))) == {}
    assert answers(queries.op11_nearest(spark, sf_of(embeddings=table_of([(1, [1.0]), (3, [2.0])])))) == {}


def test_lists_are_balanced_and_the_graph_finds_the_nearest():
    x = np.array([v for _, v in clusters(8000, 12, 5)])
    top = float((x * x).sum(1).max())
    lifted = ann.lifted(x, top)
    assert ((lifted**2).sum(1) == pytest.approx(top, rel=1e-5))
    coarse = ann.balanced(lifted, 12)
    cell = ann._distances(lifted, coarse).argmin(axis=1)
    means = [ann.balanced(lifted[cell == c], 20) for c in range(12)]
    lists = ann.Lists.of(np.concatenate(means), np.repeat(np.arange(12), [len(m) for m in means]), top)
    found, _ = lists.search(lifted[:500], 32)
    exact = ann._distances(lifted[:500], lists.centroids).argsort(axis=1)[:, :10]
    assert np.mean([len({*a[:10]} & {*b}) for a, b in zip(found, exact)]) >= 9.5
    homes, take = lists.homes(lifted[:512])
    assert take[:, 0].all() and 0 < take[:, 1:].sum() and (np.diff(np.sort(homes, axis=1), axis=1) > 0).all()
    size = np.bincount(np.concatenate([lists.search(lifted[i : i + 500], 1)[0][:, 0] for i in range(0, 8000, 500)]), minlength=240)
    assert size.max() <= 6 * size.mean()
