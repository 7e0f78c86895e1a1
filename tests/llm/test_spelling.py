"""Spelling variants against deletions of every word, and a plain count."""

import random
import re
import zlib
from collections import Counter, defaultdict

from conftest_llm import documents

from ledgerlens.llm import queries, spelling


def edits(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(small)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = defaultdict(list)
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if edits(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def varied(seed):
    """Words with typos of every kind at every place, chains of frequencies, ties and close families."""
    r = random.Random(seed)
    letters = "abcdexyzßéÀ×ÿ"
    base = ["".join(r.choice(letters) for _ in range(r.randint(6, 14))) for _ in range(14)] + ["aaaaaaaa", "aaaaaaaaa", "abababab"]
    bag = []
    for i, w in enumerate(base):
        bag += [w] * r.choice([2, 30, 400])
        for _ in range(12):
            p, c = r.randrange(len(w) + 1), r.choice(letters)
            v = r.choice([w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :]])
            bag += [v] * r.choice([1, 2, 3, 25])
    bag += ["chainword"] * 900 + ["chainwort"] * 60 + ["chainwart"] * 3
    r.shuffle(bag)
    rows = [(i, " ".join(bag[i * 40 : i * 40 + 40])) for i in range(len(bag) // 40 + 1)]
    return rows + [(None, "abababab Abababab, ABABABAB"), (5, None), (5, ""), (6, rows[0][1]), (6, rows[0][1]), (7, "straßen" * 3 + " 12 " + "Übergang übergang ÜBERGANG " * 4)]


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_equals_all_pairs(spark, sf_of):
    for seed in (1, 2):
        rows = varied(seed)
        expected = plain(rows)
        found = queries.op12_spelling(spark, sf_of(documents=documents(rows)))
        assert got(found) == expected
        assert any(v[1] != v[0] and v[0] for v in expected.values())  # a chain of forms


def test_awkward_and_empty(spark, sf_of, awkward):
    rows = awkward + [(50, "word " * 3 + "letters letters"), (51, "x" * 200_000 + " " + "x" * 200_000)]
    assert got(queries.op12_spelling(spark, sf_of(documents=documents(rows)))) == plain(rows)
    assert queries.op12_spelling(spark, sf_of()).collect() == []


def test_every_single_edit_shares_a_key(spark):
    words = {w[:p] + e + w[q:] for w in ("abcdefg", "abcdefgh", "abcdefghijklmno") for p in range(len(w) + 1) for q in (p, p + 1) for e in ("", "z")}
    words = sorted(words)
    pairs = {(a, b) for a, _, b, _ in spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()}
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in words for b in words if edits(a, b)}
    assert len(pairs) == len({frozenset(p) for p in pairs})
