"""Filter audit against a plain loop over documents and orders."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
from conftest_llm import documents

from ledgerlens.llm import audit, queries

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    """rows of (doc_id, text, lang); labels of (doc_id, quality, toxic)."""
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        docs = []
        for d, text, lang in rows:
            if (lang or "") != part:
                continue
            text = text or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", text)
            fails = {f for f, bad in zip("ABCDE", (
                len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                bool(re.search(r"[#$%&*|]", text)), d is not None and d > least[text])) if bad}
            docs.append((fails, d in good, d in toxic))
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, before = docs, set()
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x[0] and bool(x[0] & before) for x in docs), sum(x[0] == {f} for x in docs),
                    sum(x[1] for x in gone), sum(x[2] for x in gone)]
                before.add(f)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in df.collect()}


def table_of(rows):
    t = documents([r[:2] for r in rows])
    return t.set_column(t.column_names.index("lang"), "lang", pa.array([r[2] for r in rows], pa.string()))


def labels_of(rows):
    kinds = pa.int64(), pa.int32(), pa.int32()
    return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(("doc_id", "quality", "toxic"), kinds))} | {
        "mask": pa.array(["x"] * len(rows)), "good": pa.array([5] * len(rows)), "part": pa.array(["p"] * len(rows))})


def test_equals_plain_loop(spark, sf_of, awkward):
    r = random.Random(3)
    texts = [" ".join(r.choice(["aa", "Bb", "c#", "ü", *[f"w{i}" for i in range(400)]]) for _ in range(r.choice([0, 150, 250, 400]))) for _ in range(25)]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(120)]
    rows += [(d, t, "odd") for d, t in awkward] + [(7, "same", "en"), (7, "same", "en"), (7, "same", "de"), (3, "same", "fr"), (None, "same", "en"), (None, "same", "en")]
    labels = [(i % 90, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(150)] + [(None, 1, 1), (10_000, 1, 1)]
    sf = sf_of(documents=table_of(rows), labels=labels_of(labels))
    expected = plain(rows, labels)
    assert len(expected) == 600 * 5
    assert got(queries.op13_filter_audit(spark, sf)) == expected


def test_empty_tables(spark, sf_of):
    assert queries.op13_filter_audit(spark, sf_of()).collect() == []
    assert got(queries.op13_filter_audit(spark, sf_of(documents=table_of([(1, None, None)]))))["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


def test_min_plus_product_is_the_first_failing_step():
    names, position = audit.orders("ABC")
    steps = audit.removal_steps(np.arange(8), position)
    for mask, order in itertools.product(range(8), names):
        failing = [i + 1 for i, f in enumerate(order) if mask >> "ABC".index(f) & 1]
        assert steps[mask, names.index(order)] == min(failing, default=np.inf)
