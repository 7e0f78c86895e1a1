"""Byte-pair encoding and decoding with a public vocabulary file.

A word is a doubly linked list of symbols. A heap holds the merges of adjacent
symbols by (rank, position); an entry whose symbols have changed meanwhile is
stale and skipped. Decoding looks every id up in the vocabulary and joins the
strings as the vocabulary file asks for: without a decoder section, by one space.

Null and empty texts have no ids; no ids decode to the empty text. Repeated rows have equal ids each; an empty table gives an
empty one; other columns are left alone, whatever their names, as only the text column is read. Texts are never
cut. Work is one narrow Arrow step per partition, so a lost executor costs only
its partitions. A worker remembers at most ``CACHE_RUNS`` runs between white space.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.llm.batches import arrow_udf

#: Runs without white space that a worker remembers; others are encoded anew each time they occur.
CACHE_RUNS = 400_000
SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: A stop or comma next to another symbol (or to a quote, which may start a match).
SIDE_BY_SIDE = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s].)|(?<=_.))")

#: White space as the vocabulary's split pattern understands it (fixed values).
SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The vocabulary's split pattern (fixed value); white space between matches is dropped.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """One printable letter per byte: itself if it prints, else the next code point from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file of the word-end kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.letter_ids = [vocab[c] for c in byte_letters()]
        self.end_ids = [vocab[c + self.end] for c in byte_letters()]
        pairs = [*map(tuple, model["merges"])]
        #: Rank of a pair of ids, packed into one number; the id that the merge of a rank makes.
        self.ranks = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(WORDS)
        self.strings = [""] * (1 + max([*vocab.values(), *special.values()]))
        for text, i in [*vocab.items(), *special.items()]:
            self.strings[i] = text
        #: Ids of a run, one code point each: compact, and quick to join.
        self.known: dict[str, str] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Apply all merges to one word's symbols, lowest rank first, leftmost on ties."""
        n, rank, made = len(ids), self.ranks.get, self.made
        heap = [r << 32 | i for i, pair in enumerate(itertools.pairwise(ids)) if (r := rank(pair[0] << 20 | pair[1])) is not None]
        if not heap:
            return ids
        heapq.heapify(heap)
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        while heap:
            entry = heapq.heappop(heap)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j == n or rank(ids[i] << 20 | ids[j]) != r:
                continue  # stale
            new = ids[i] = made[r]
            ids[j] = -1
            k = after[i] = after[j]
            h = before[i]
            if k < n:
                before[k] = i
                if (q := rank(new << 20 | ids[k])) is not None:
                    heapq.heappush(heap, q << 32 | i)
            if h >= 0 and (q := rank(ids[h] << 20 | new)) is not None:
                heapq.heappush(heap, q << 32 | h)
        return [x for x in ids if x >= 0]

    def run(self, run: str) -> str:
        """Ids of a run of characters without white space, as code points."""
        words, parts = [run] if run.isalpha() else self.words.findall(run), []
        for w in words:
            ids = self.known.get(w) if len(words) > 1 else None
            if ids is None:
                data = w.encode()
                ids = "".join(map(chr, self.merge([*map(self.letter_ids.__getitem__, data[:-1]), self.end_ids[data[-1]]])))
            parts.append(ids)
        out = "".join(parts)
        if len(self.known) < CACHE_RUNS and len(run) <= 64:
            self.known[run] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; special strings inside it become their own id."""
        parts = [text] if self.cut is None else self.cut.split(text)
        ids = "".join([chr(self.special[part]) if k % 2 else self.plain(part) for k, part in enumerate(parts)])
        return np.frombuffer(ids.encode("utf-32-le", "surrogatepass"), np.int32)

    def plain(self, text: str) -> str:
        # lower-casing goes character by character: a capital sigma has one small form
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        # no match holds white space; Python also splits at the four separators below, the vocabulary doesn't
        if SEPARATORS.search(text):
            runs = [text]
        else:
            if not SIDE_BY_SIDE.search(text):  # then each stop and comma is a match of its own
                text = text.replace(",", " , ").replace(".", " . ")
            runs = text.split()
        ids = [*map(self.known.get, runs)]
        if None in ids:
            ids = [known if known is not None else self.run(r) for known, r in zip(ids, runs, strict=True)]
        return "".join(ids)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker and file."""
    return Codec(path)


def encode(text: Column, path: str) -> Column:
    """Token ids, array<int>, of a text column."""

    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        c, flat, ends = codec(path), [], [0]
        for t in texts:
            flat.append(pa.array(c.encode(t.as_py() or "")))
            ends.append(ends[-1] + len(flat[-1]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(flat) if flat else pa.array([], pa.int32()))

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Text of an array<int> column of token ids; null ids decode to the empty text."""

    @arrow_udf("string")
    def texts(rows: pa.Array) -> pa.Array:
        c, flat = codec(path), rows.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))))
        return pa.array((c.decode(flat[a:b]) for a, b in itertools.pairwise(ends.tolist())), pa.string())

    return texts(ids)
