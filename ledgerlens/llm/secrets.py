"""Secret scans: fixed base patterns, and formats inferred from the credentials that those label.

The base patterns find assignments, access keys and long hexadecimal runs. Their values are
labelled credentials: from a sample of at most ``SAMPLE`` distinct values a kind (of ``LONGEST`` characters at most) a prefix
tree over character classes is built, and states whose futures do not differ
significantly are merged (red-blue merging with Hoeffding bounds). The outcome per kind is
a probabilistic automaton; a candidate's score is the log-likelihood ratio of its best automaton
against a background of ordinary text.

Candidates are all maximal runs of ``LEAST`` or more credential characters, whatever their shape, that base spans leave: of a run
that a base span lies in, what stands before and after it is scored on its own. The background is the chain of character classes in
all candidates of all documents, counted by Spark. A candidate is added as kind ``format`` if its score reaches that of
``REACHED`` of all labelled credentials and its evidence is one in ``1 / CHANCE`` for ordinary text. Only the automata look at a sample.

Null and empty texts have no spans; repeated rows have the same spans each and count as often in the fit; an empty table gives
an empty one; other columns are ignored. Offsets are code points, end exclusive. Kinds of equal score make no difference. Without any
labelled credential no format is known and nothing is added.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.batches import arrow_udf
from ledgerlens.llm.stored import stored

#: The base kinds in their order, their patterns and least lengths.
KINDS = ["assign", "access", "hex", "format"]
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6

#: Shortest candidate: that of an assigned value.
LEAST = LEAST_ASSIGNED
#: Distinct labelled credentials of a kind that automata are inferred from, and the longest of them; nothing else has these bounds.
SAMPLE = 1_000
LONGEST = 256
#: Confidence of the merge test, and the share of labelled credentials that must reach the threshold.
ALPHA = 0.05
REACHED = 0.99
#: Weight, in characters, of the frequencies of single classes in those of pairs.
PRIOR = 100
#: Chance of ordinary text to look as much like a format.
CHANCE = 1e-6

CLASSES = {"digit": "0123456789", "hex": "abcdef", "low": "ghijklmnopqrstuvwxyz", "HEX": "ABCDEF", "UP": "GHIJKLMNOPQRSTUVWXYZ", "mark": "+/_.=-"}
CLASS_OF = {c: name for name, chars in CLASSES.items() for c in chars}
#: A character of one class each, for whole texts at a time; all else is a space.
CODES = dict(zip(CLASSES, "dhlHUm"))
NAMES = list(CLASSES)
RUN = re.compile(f"[{''.join(CODES.values())}]{{{LEAST},}}")
_PLACE = np.zeros(256, np.int64)
_PLACE[[ord(c) for c in CODES.values()]] = np.arange(1, len(CODES) + 1)
#: Class strings whose scores a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_LONG = 300_000, 48


class _Coded(dict):
    """A translation table that learns that a character is no credential's."""

    def __missing__(self, key: int) -> str:
        if len(self) < 100_000:
            self[key] = " "
        return " "


_CODED = _Coded({ord(c): CODES[name] for c, name in CLASS_OF.items()})


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the base patterns, per kind leftmost and non-overlapping."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]


def outside(text: str, base: list[tuple[str, int, int, int]]) -> str:
    """The text as classes, a character for each, with base spans blanked."""
    coded = text.translate(_CODED)
    if base:
        parts, at = [], 0
        for a, b in sorted((a, b) for _, a, b, _ in base):
            if b > at:
                parts += [coded[at:a], " " * (b - max(a, at))] if a >= at else [" " * (b - at)]
                at = b
        coded = "".join([*parts, coded[at:]])
    return coded


def chain_counts(coded: str) -> np.ndarray:
    """How often each class follows each other class (0: the start) in the candidates of a coded text."""
    total = np.zeros((len(NAMES) + 1) ** 2, np.int64)
    data, at = np.frombuffer(coded.encode("ascii"), np.uint8), 0
    while at < len(data):
        stop = min(len(data), at + (1 << 20))
        if stop < len(data):  # a piece ends where no candidate is
            gap = np.flatnonzero(data[stop:] == 32)
            stop = stop + int(gap[0]) if len(gap) else len(data)
        now = _PLACE[data[at:stop]]
        edge = np.diff(now > 0, prepend=False, append=False).nonzero()[0]
        starts, ends = edge[::2], edge[1::2]
        keep = ends - starts >= LEAST
        before = np.concatenate([[0], now[:-1]])
        before[starts] = 0
        inside = np.zeros(len(now) + 1, np.int8)
        inside[starts[keep]], inside[ends[keep]] = 1, -1
        chosen = np.cumsum(inside)[:-1] > 0
        total += np.bincount((before * (len(NAMES) + 1) + now)[chosen], minlength=len(total))
        at = stop
    return total


class Automaton:
    """A probabilistic automaton over character classes, inferred by merging prefix-tree states."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]  # by class; "" is the end of a word
        for w in words:
            s = 0
            for c in map(CLASS_OF.__getitem__, w):
                self.count[s][c] += 1
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                s = self.next[s][c]
            self.count[s][""] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, blue = [0], sorted((0, c) for c in self.next[0])
        while blue:
            s, c = blue.pop(0)
            t = self.next[s][c]
            for r in red:
                if self.compatible(r, t):
                    self.next[s][c] = r
                    self.fold(r, t)
                    break
            else:
                red.append(t)
            keep = set(red)
            blue = sorted({(r, x) for r in red for x, u in self.next[r].items() if u not in keep})
        self.states = red

    def differ(self, a: Counter, b: Counter) -> bool:
        n, m = a.total(), b.total()
        if not n or not m:
            return False
        limit = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(a[x] / n - b[x] / m) > limit for x in {*a, *b})

    def compatible(self, a: int, b: int) -> bool:
        """Whether two states and all that follows them show no significant difference."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if self.differ(self.count[a], self.count[b]):
                return False
            stack += [(self.next[a][x], t) for x, t in self.next[b].items() if x in self.next[a]]
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree under b to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.count[a].update(self.count[b])
            for x, t in self.next[b].items():
                if x in self.next[a]:
                    stack.append((self.next[a][x], t))
                else:
                    self.next[a][x] = t

    def table(self) -> dict[int, dict[str, tuple[float, int]]]:
        """Per state and class the log-probability of each of its characters and the state after it; "" ends."""
        out = {}
        for s in self.states:
            n = self.count[s].total() + len(CLASSES) + 1
            row = {x: (math.log((self.count[s][x] + 1) / n) - math.log(len(chars)), self.next[s].get(x, -1)) for x, chars in CLASSES.items()}
            out[s] = row | {"": (math.log((self.count[s][""] + 1) / n), -1)}
        return out


class Formats:
    """The automata of all kinds with the background and the threshold; small and picklable."""

    def __init__(self, labelled: dict[str, list[str]], chain: np.ndarray, threshold: float = math.inf):
        tables = [Automaton(words).table() for _, words in sorted(labelled.items()) if words]
        self.tables = [{s: {CODES[x]: row[x] for x in NAMES} for s, row in t.items()} for t in tables]
        counts = np.asarray(chain).reshape(len(NAMES) + 1, -1)[:, 1:]
        # a class that hardly occurs is followed as any other
        single = counts.sum(axis=0) + 1.0
        counts = counts + PRIOR * single / single.sum()
        size = np.log([len(CLASSES[x]) for x in NAMES])
        logs = np.log(counts / counts.sum(axis=1, keepdims=True)) - size
        self.ground = {p: dict(zip(CODES.values(), row)) for p, row in zip(["", *CODES.values()], logs.tolist())}
        self.threshold = threshold
        self.known: dict[str, float] = {}

    def evidence(self) -> float:
        """The least score that ordinary text reaches with a chance of ``CHANCE`` at most, whichever automaton is the best."""
        return math.log(max(1, len(self.tables)) / CHANCE)

    def score(self, classes: str) -> float:
        """Log-likelihood ratio of the best automaton for a string of classes."""
        score = self.known.get(classes)
        if score is None:
            before, ground = "", 0.0
            for x in classes:
                ground += self.ground[before][x]
                before = x
            best = -math.inf
            for table in self.tables:
                s, total = 0, 0.0
                for x in classes:
                    p, to = table[s][x]
                    total += p
                    if to < 0:  # never seen here: pay for it and go on in the same state
                        total -= 3.0
                        continue
                    s = to
                best = max(best, total)
            score = best - ground
            if len(classes) <= REMEMBERED_LONG:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[classes] = score
        return score

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans by start, then kind."""
        base = base_spans(text)
        out = [(k, a, b) for k, a, b, _ in base]
        if self.tables:
            out += [("format", *m.span()) for m in RUN.finditer(outside(text, base)) if self.score(m[0]) >= self.threshold]
        return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Formats:
    """Infer the formats: automata from at most ``sample`` distinct values of each kind, those with the smallest hashes; background and
    threshold from all documents. Texts are read once; labelled values and counts are written in between."""
    words = pa.list_(pa.struct([("kind", pa.string()), ("word", pa.string())]))

    @arrow_udf("struct<words: array<struct<kind: string, word: string>>, chain: array<bigint>>")
    def gathered(texts: pa.Array) -> pa.Array:
        found, chains = [], []
        for t in (x.as_py() or "" for x in texts):
            base = base_spans(t)
            found.append([{"kind": k, "word": t[v:b]} for k, _, b, v in base])
            chains.append(chain_counts(outside(t, base)))
        return pa.StructArray.from_arrays([pa.array(found, words), pa.array(chains, pa.list_(pa.int64()))], ["words", "chain"])

    found = stored(docs.select(gathered(F.col(text)).alias("x")).select("x.words", "x.chain"))
    places = (len(NAMES) + 1) ** 2
    chain = np.array([x or 0 for x in found.agg(*[F.sum(F.get("chain", i)).alias(f"c{i}") for i in range(places)]).first()], np.int64)
    every = found.select(F.inline("words"))
    distinct = every.filter(F.length("word") <= LONGEST).select("kind", "word", F.xxhash64("kind", "word").alias("h")).distinct()
    labelled: dict[str, list[str]] = {}
    for kind in KINDS[:3]:
        rows = distinct.filter(F.col("kind") == kind).orderBy("h", "word").limit(sample).collect()  # short strings, sample at most
        labelled[kind] = [r.word for r in rows]
    formats = Formats(labelled, chain)
    if formats.tables:
        @arrow_udf("int")
        def tenths(values: pa.Array) -> pa.Array:
            scores = [formats.score(v.translate(_CODED)) for v in values.to_pylist()]
            return pa.array([max(-10_000, min(10_000, math.floor(10 * x))) for x in scores], pa.int32())

        counts = sorted((r.t, r.n) for r in every.select(tenths("word").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect())
        below, total = 0, sum(n for _, n in counts)
        for t, n in counts:
            if (below := below + n) > total * (1 - REACHED):
                formats.threshold = max(t / 10, formats.evidence())
                break
    return formats


def scan(text: Column, formats: Formats) -> Column:
    """array<struct<kind, a, b>> of all secrets of each whole text, by start, then kind."""

    @arrow_udf("array<struct<kind: string, a: bigint, b: bigint>>")
    def spans(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "a": a, "b": b} for k, a, b in formats.spans(t.as_py() or "")] for t in texts]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())])))

    return spans(text)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def redact(docs: DataFrame, formats: Formats, text: str = "text", put: str = "[SECRET]") -> DataFrame:
    """Documents with every secret replaced by ``put``, same columns; a column n_chars follows the text."""

    @arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for t in (x.as_py() for x in texts):
            at, left = 0, []
            for _, a, b in formats.spans(t or ""):
                if b > at:
                    left += [t[at:a], put] if a >= at else []
                    at = b
            out.append("".join([*left, t[at:]]) if left else t)
        return pa.array(out, pa.string())

    before = "__before"
    while before in docs.columns:
        before += "_"
    out = docs.withColumnRenamed(text, before).withColumn(text, clean(F.col(before)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(text) != F.col(before), F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
