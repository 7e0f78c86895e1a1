"""Token counts by a deterministic transducer compiled from a piece vocabulary.

The vocabulary's merge rule (join the adjacent pair that makes the best scored piece,
leftmost on ties) has a useful property: a piece sequence is the encoding of its text
exactly if each adjacent pair is the encoding of its own concatenation. So the last
piece of every prefix is unique, and a machine reading characters needs to remember
only the open piece beginnings, the piece before each, and how many tokens have been
counted since. Those are its states; every transition is annotated with the tokens
that it emits (negative if a longer piece takes back shorter ones). States are compiled when
first met and kept.

No piece crosses from a non-space to a space, nor from a letter to some marks (found from
the vocabulary), so at such a border the machine is in one known state whatever came before. A chunk of text is therefore a state map of constant
size: what precedes its first such border (still to be run from the incoming state), the tokens
counted after it, and its last state. Maps compose associatively; a text's maps are
composed pairwise in rounds, as a prefix scan does.

Null and empty texts have 0 tokens. Repeated rows have equal counts each; an empty table gives an empty one; other columns are left
alone, whatever their names, as only the text column is read. Texts are read whole. Special strings inside a
text are ordinary characters; characters outside the vocabulary count one token per UTF-8
byte. A worker keeps at most ``MAX_STATES`` states and ``MAX_WORDS`` counts; beyond
those states are compiled anew and words counted each time, with equal results.
"""

from __future__ import annotations

import functools
import heapq
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.llm.batches import arrow_udf

CHUNK = 8_192
MAX_STATES = 150_000
MAX_WORDS = 400_000

LETTER = r"[^\W\d_]"
#: Marks that end a word if no piece holds a letter with the mark after it.
MARKS = ",.\n"


class Machine:
    """The compiled transducer of one vocabulary; a space stands for the vocabulary's space mark."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i).replace("▁", " ")] = -model.get_score(i)
        if any(" " in p.lstrip(" ") for p in self.rank):
            raise ValueError("a piece crosses from a word to a space; chunks would not be independent")
        self.marks = "".join(m for m in MARKS if not any(re.search(LETTER + re.escape(m), p) for p in self.rank))
        after_letter = rf"(?<={LETTER})(?=[ {re.escape(self.marks)}])"
        self.border = re.compile(rf"{after_letter}|(?<=[^ ])(?= )")
        self.segments = re.compile(rf" *[^ ]+?(?:(?= |\Z)|{after_letter})| +")
        self.letter = re.compile(LETTER)
        self.begins = {p[:k] for p in self.rank for k in range(1, len(p))}
        self.counts: dict[str, int] = {}
        self.restart()

    def restart(self) -> None:
        self.joins: dict[tuple[str, str], bool] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, tuple[int, int]]] = []
        #: Start of a text, or of a word after a border: one open beginning, nothing before it.
        self.start = self.number((("", None, 0),))

    def number(self, state: tuple) -> int:
        if (n := self.numbers.get(state)) is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return n

    def pieces(self, text: str) -> list[str]:
        """Encoding of a short text by merging; used to compile transitions."""
        parts: list[str | None] = list(text)
        after = [*range(1, len(parts)), -1] if parts else []
        before = [i - 1 for i in range(len(parts))]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (r := self.rank.get(whole := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, whole))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, whole = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) < 0 or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j], after[i] = whole, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i, after[i])
            offer(before[i], i)
        return [p for p in parts if p is not None]

    def parted(self, last: str, piece: str) -> bool:
        """Whether a border lies between the two."""
        a, b = last[-1], piece[0]
        return (b == " " and a != " ") or (b in self.marks and self.letter.match(a) is not None)

    def fits(self, last: str | None, piece: str) -> bool:
        """Whether the two pieces next to each other are the encoding of their concatenation."""
        if last is None or self.parted(last, piece):
            return True
        key = (last, piece)
        if (ok := self.joins.get(key)) is None:
            ok = self.joins[key] = self.pieces(last + piece) == [last, piece]
        return ok

    def compile(self, state: int, c: str) -> tuple[int, int]:
        """The transition of a state on a character: next state and tokens emitted."""
        opened = [(begun + c, last, since) for begun, last, since in self.states[state]]
        for piece, last, since in opened:
            if (piece in self.rank or len(piece) == 1) and self.fits(last, piece):
                emits = (1 if piece in self.rank else len(piece.encode())) - since
                break
        else:
            raise AssertionError("every prefix has an encoding")
        kept = [(s, None if last and self.parted(last, s) else last, since + emits)
                for s, last, since in opened if s in self.begins]
        step = self.steps[state][c] = self.number((*kept, ("", piece, 0))), emits
        return step

    def run(self, state: int, text: str) -> tuple[int, int]:
        """State and tokens emitted after reading a text."""
        steps, count = self.steps, 0
        for c in text:
            state, emits = steps[state].get(c) or self.compile(state, c)
            count += emits
        return state, count

    def segment(self, s: str) -> int:
        count = self.run(self.start, s)[1]
        if len(self.counts) < MAX_WORDS and len(s) <= 48:
            self.counts[s] = count
        return count

    def chunk_map(self, chunk: str) -> tuple[str, int, int | None]:
        """(head before the first border, tokens after it, last state); None: no border inside."""
        border = self.border.search(chunk)
        if border is None:
            return chunk, 0, None
        at = border.start()
        *whole, tail = self.segments.findall(chunk, at)
        get, count = self.counts.get, 0
        for s in whole:
            count += get(s) or self.segment(s)
        state, more = self.run(self.start, tail)
        return chunk[:at], count + more, state

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of a chunk followed by another."""
        if a[2] is None:
            if a[0] and b[0] and self.parted(a[0], b[0]):  # the joint itself is a border
                state, n = self.run(self.start, b[0])
                return a[0], n + b[1], state if b[2] is None else b[2]
            return a[0] + b[0], b[1], b[2]
        state, n = self.run(a[2], b[0])
        return a[0], a[1] + n + b[1], state if b[2] is None else b[2]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if len(self.states) > MAX_STATES:
            self.restart()
        text = " " + text.replace("▁", " ")
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, count, _ = maps[0]
        return self.run(self.start, head)[1] + count


@functools.lru_cache(maxsize=2)
def machine(path: str) -> Machine:
    """One machine per worker and vocabulary."""
    return Machine(path)


def count_tokens(text: Column, path: str) -> Column:
    """Number of tokens, long, of each whole text."""

    @arrow_udf("long")
    def counts(texts: pa.Array) -> pa.Array:
        m = machine(path)
        return pa.array([m.count(t.as_py() or "") for t in texts], pa.int64())

    return counts(text)
