"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are what is left between ASCII marks and spaces, A-Z lower-cased. The automaton
accepts every run of consecutive words of any item; reading a document it tracks the
longest run that ends at each word. A run of ``window`` words, or a shorter item as a
whole, makes its words hit.

Words are looked up in the items' own vocabulary first, and only stretches whose
neighbouring pairs all occur in some item are given to the automaton; no match
can cross another pair, so this loses nothing.

Items are sent to the workers in blocks of at most ``BLOCK_WORDS`` words (counted
first); every document meets up to ``BLOCKS_A_PASS`` blocks in one narrow pass, without a shuffle. With more blocks each
further pass reads what the one before has written, so that a worker builds each automaton once and holds few.

Null, empty and wordless texts have no words and no hits; items without words have no
windows; equal items are all reported; a null item id is reported as the empty string. Any extra
columns are left as they are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.batches import arrow_udf
from ledgerlens.llm.stored import stored

WINDOW = 10
#: Most words of items in one automaton; about 60 MB a worker.
BLOCK_WORDS = 100_000
#: A document with a larger share of hit words goes as a whole.
MAX_COVERAGE = 0.5

#: One step to words: every ASCII byte but letters and digits becomes a space, A-Z become small.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PAIR_BITS = 22


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split()


class Automaton:
    """Suffix automaton over the word numbers of many items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        rows = []
        for name, text in items:
            if words := words_of(text):
                rows.append((name, [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Per state the items that have its runs; per state the short items that end in it.
        self.owners: list[set[str]] = [set()]
        self.short: list[list[tuple[int, str]]] = [[]]
        self.least = min([window, *(len(w) for _, w in rows)])
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        ends = []
        for name, row in rows:
            last, path = 0, []
            for w in row:
                last = self.extend(last, w)
                path.append(last)
            ends.append((name, row, path))
            if len(row) > 1:
                a = np.array(row, np.uint64)
                self.pairs[self.pair(a[:-1], a[1:])] = True
        for name, row, _ in ends:
            s = 0
            for w in row:  # the states of the prefixes, now that the automaton is whole
                s, at = self.next[s][w], None
                at = s
                while at > 0 and name not in self.owners[at]:
                    self.owners[at].add(name)
                    at = self.link[at]
            if len(row) < window:
                self.short[s].append((len(row), name))
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        #: The nearest state up the links, itself included, where a short item ends.
        self.shorts = [-1] * len(order)
        for s in order[1:]:
            self.shorts[s] = s if self.short[s] else self.shorts[self.link[s]]

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.owners.append(set())
        self.short.append([])
        return len(self.next) - 1

    def split(self, p: int, q: int, w: int) -> int:
        """A copy of q for the runs no longer than those of p and one word more."""
        copy = self.state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:  # another item had this run
            return q if self.length[q] == self.length[last] + 1 else self.split(last, q, w)
        new, p = self.state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, q, w)
        return new

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit spans (word numbers, end exclusive, joined), items found."""
        words = words_of(text)
        n, get = len(words), self.numbers.get
        if n < self.least or not self.numbers:
            return n, [], set()
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, n)
        known = ids > 0
        if not known.any():
            return n, [], set()
        linked = known[:-1] & known[1:]
        linked &= self.pairs[self.pair(ids[:-1], ids[1:])]
        if self.least == 1:
            starts = np.flatnonzero(known & ~np.concatenate(([False], linked)))
            stops = np.flatnonzero(known & ~np.concatenate((linked, [False]))) + 1
        else:
            edge = np.diff(np.concatenate(([0], linked.astype(np.int8), [0])))
            starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        long = stops - starts >= self.least
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            self.read(ids[a:b].tolist(), a, spans, found)
        return n, joined(spans), found

    def read(self, ids: list[int], at: int, spans: list, found: set[str]) -> None:
        s, length = 0, 0
        for i, w in enumerate(ids, at + 1):
            while s and w not in self.next[s]:
                s = self.link[s]
                length = self.length[s]
            if w in self.next[s]:
                s, length = self.next[s][w], length + 1
            if length >= self.window:
                u = s
                while self.length[self.link[u]] >= self.window:
                    u = self.link[u]
                spans.append((i - self.window, i))
                found |= self.owners[u]
            u = self.shorts[s]
            while u > 0:
                for m, name in self.short[u]:
                    if m <= length:
                        spans.append((i - m, i))
                        found.add(name)
                u = self.shorts[self.link[u]]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans; spans that touch stay joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: Blocks scanned in one pass over the documents, and automata that a worker keeps; all of a pass are kept while it lasts.
BLOCKS_A_PASS = 4
_built: dict[tuple[str, int], Automaton] = {}


def automaton(digest: str, block: Broadcast, window: int) -> Automaton:
    """The automaton of one block of items, built once per worker and pass; ``digest`` names the block's content."""
    own = _built.pop((digest, window), None) or Automaton(block.value, window)
    _built[digest, window] = own  # the last used stands last
    while len(_built) > BLOCKS_A_PASS:
        _built.pop(next(iter(_built)))
    return own


#: Spans in words (a, b) and in characters (c, d), ends exclusive.
FOUND = "struct<n_words: bigint, spans: array<struct<a: bigint, b: bigint, c: bigint, d: bigint>>, items: array<string>>"


def scan_block(text: Column, digest: str, block: Broadcast, window: int) -> Column:
    @arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        found = automaton(digest, block, window)
        rows = []
        for t in texts:
            text = t.as_py() or ""
            n, spans, items = found.scan(text)
            at = [m.span() for m in WORD.finditer(text)] if spans else []
            rows.append({"n_words": n, "spans": [{"a": a, "b": b, "c": at[a][0], "d": at[b - 1][1]} for a, b in spans], "items": sorted(items)})
        span = pa.struct([(x, pa.int64()) for x in "abcd"])
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))]))

    # deterministic in truth; said otherwise so that a filter on its result does not make Spark run it twice
    return scan.asNondeterministic()(text)


def find(docs: DataFrame, items: DataFrame, out: str, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents with a column ``out``: n_words, hit spans in word numbers (joined per block), items found."""
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("words"))
    # bytes bound the words from above; one block holds at most about block_words of them
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("words") + 2), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n_bytes // (2 * block_words)))
    block = F.pmod(F.xxhash64("name", "words"), F.lit(n_blocks))

    def scanned(k: int) -> Column:
        rows = sorted((r[0], r[1]) for r in items.filter(block == k).collect())  # bounded by block_words
        return scan_block(F.col(text), hashlib.sha256(repr(rows).encode()).hexdigest(), spark.sparkContext.broadcast(rows), window)

    if n_blocks == 1:
        return docs.withColumn(out, scanned(0))
    columns, found = docs.columns, []
    for at in range(0, n_blocks, BLOCKS_A_PASS):
        if at:  # a pass ends: what it found is written beside the documents, and its automata can go
            docs = stored(docs)
        for k in range(at, min(at + BLOCKS_A_PASS, n_blocks)):
            found.append(f"{out}{k}")
            while found[-1] in columns:
                found[-1] += "_"
        docs = docs.withColumns({name: scanned(k) for k, name in enumerate(found[at:], at)})
    whole = F.struct(
        F.greatest(*[F.col(f"`{p}`")["n_words"] for p in found]).alias("n_words"),
        F.concat(*[F.col(f"`{p}`")["spans"] for p in found]).alias("spans"),
        F.array_distinct(F.concat(*[F.col(f"`{p}`")["items"] for p in found])).alias("items"))
    return docs.withColumn(out, whole).drop(*found)


def hit_words(spans: Column) -> Column:
    """Number of words inside any of the spans."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(ordered, start, lambda s, x: F.struct(
        (s["hit"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("hit"), F.greatest(s["to"], x["b"]).alias("to")))["hit"]


def without(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and what stands between them."""
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))

    def skip(s: Column, x: Column) -> Column:
        before = F.substring(text, s["at"].cast("int") + 1, F.greatest(F.lit(0).cast("long"), x["c"] - s["at"]).cast("int"))
        return F.struct(F.concat(s["kept"], before).alias("kept"), F.greatest(s["at"], x["d"]).alias("at"))

    return F.aggregate(F.array_sort(spans), start, skip, lambda s: F.concat(s["kept"], F.substring(text, s["at"].cast("int") + 1, F.length(text))))


def decontaminate(docs: DataFrame, items: DataFrame, max_coverage: float = MAX_COVERAGE, **names: str) -> DataFrame:
    """Documents without the passages they share with the items, same columns.

    Hit spans are cut out of the text. A document with more than ``max_coverage`` of its words hit goes
    as a whole, as little of its own would remain. Others are unchanged; where a text is cut,
    a column n_chars follows it.
    """
    text = names.get("text", "text")
    out = "__found"
    while out in docs.columns:
        out += "_"
    found = find(docs, items, out, **names)
    spans, hit = F.col(f"{out}.spans"), hit_words(F.col(f"{out}.spans"))
    found = found.filter(hit <= max_coverage * F.col(f"{out}.n_words"))
    found = found.withColumn(text, F.when(F.size(spans) > 0, without(F.col(text), spans)).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
