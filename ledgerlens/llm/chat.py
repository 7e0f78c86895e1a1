"""Chat formatting: typed content parts become one marked text with a loss mask, and read back.

A visitor goes through a turn's parts. Text is copied with control strings escaped; an image,
audio or document becomes a numbered placeholder, and its reference and the tokens
it expands to are recorded. A turn is one piece of output::

    <|im_start|>role LF content <|im_end|> LF

Inside texts, roles and references ``<|`` gets a backslash after ``<``, and so does ``<`` before backslashes and a bar,
so that reading back is exact for any text. The loss mask covers the content of assistant turns.

Turns are formatted one by one wherever they are. Only reading back needs a conversation in
order: it streams over sorted partitions and keeps running digests, so a conversation of any
length takes constant memory. Null texts are empty, a null role is the empty role, null
turns come first; equal turn numbers are ordered by their formatted text, so by role first; repeated rows are repeated turns;
rows without a conversation id form one conversation of their own. No rows give no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.batches import arrow_udf

#: Fixed values of the template.
START, END, ASSISTANT = "<|im_start|>", "<|im_end|>", "assistant"
HIDE, SHOW = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")

#: Tokens an attachment expands to: image patches of so many pixels a side, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE = 28, 25, 768

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
TURN = "struct<formatted: string, loss_from: int, loss_to: int, attachments: array<struct<ref: string, kind: string, tokens: bigint>>>"


def escaped(text: str) -> str:
    return HIDE.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return SHOW.sub(r"<\1|", text)


@dataclass
class Flatten:
    """Visitor of content parts."""

    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['kind']}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escaped(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        self.attach(part, -(-(part["width"] or 1) // PATCH) * -(-(part["height"] or 1) // PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, max(1, round((part["seconds"] or 0) * FRAMES)))

    def visit_document(self, part: dict) -> None:
        self.attach(part, PAGE * max(1, part["pages"] or 1))

    def attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"ref": part["ref"], "kind": part["kind"], "tokens": tokens})
        self.out.append(f"<|{part['kind']}:{len(self.attachments)}|>")


def format_turn(role: str | None, parts: list[dict] | None) -> dict:
    """One piece of output, the span under the loss mask in it, and its attachments."""
    visitor = Flatten()
    for part in parts or []:
        visitor.visit(part)
    # a line end in a role would end it, so roles keep theirs as a control string
    head = START + escaped(role or "").replace("\n", "<|nl|>") + "\n"
    content = "".join(visitor.out)
    loss = (len(head), len(head) + len(content)) if role == ASSISTANT else (None, None)
    return {"formatted": head + content + END + "\n", "loss_from": loss[0], "loss_to": loss[1], "attachments": visitor.attachments}


ROLE = re.compile(r"<\|im_start\|>((?:<\|nl\|>|(?!<\|)[^\n])*)\n")


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of a piece; placeholders stay."""
    head = ROLE.match(piece)
    end = piece.rindex(END)
    return unescaped(head[1].replace("<|nl|>", "\n")), unescaped(piece[head.end() : end])


def format_turns(role: Column, parts: Column) -> Column:
    """The formatted piece of each turn; see ``TURN``."""
    kind = pa.struct([("formatted", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32()),
                      ("attachments", pa.list_(pa.struct([("ref", pa.string()), ("kind", pa.string()), ("tokens", pa.int64())])))])

    @arrow_udf(TURN)
    def pieces(roles: pa.Array, rows: pa.Array) -> pa.Array:
        return pa.array([format_turn(r, p) for r, p in zip(roles.to_pylist(), rows.to_pylist(), strict=True)], kind)

    return pieces(role, parts)


def text_part(text: Column) -> Column:
    """A plain text as the only part of a turn."""
    empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    value = {"kind": F.lit("text"), "text": F.coalesce(text, F.lit(""))} | {k: F.lit(None).cast(t) for k, t in empty.items()}
    return F.array(F.struct(*[value[k].alias(k) for k in ("kind", "text", "ref", "width", "height", "seconds", "pages")]).cast(PART))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", parts: str | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, piece (see ``TURN``). Needs no order and no shuffle."""
    content = F.col(parts) if parts else text_part(F.col(text))
    return turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), format_turns(F.col(role), content).alias("piece"))


class Running:
    """Digests of one conversation while its pieces come by."""

    def __init__(self, key):
        self.key, self.turns, self.loss_chars, self.chars = key, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, a: int | None, b: int | None) -> None:
        role, text = read_turn(piece)
        self.turns += 1
        self.chars += len(piece)
        self.all.update(f"{role}\n{text}\n".encode())
        if a is not None:
            under = unescaped(piece[a:b])
            self.loss_chars += len(under)
            self.loss.update(under.encode())

    def row(self) -> tuple:
        return self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation what its formatted pieces say: turns, text under the loss mask, sizes, digests."""
    id_type = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    rows = pieces.select("conv_id", "turn", "piece.formatted", "piece.loss_from", "piece.loss_to")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: Running | None = None
        kinds = None
        for batch in batches:
            kinds = pa.schema([(names[0], batch.schema.field("conv_id").type), (names[1], pa.int64()), (names[2], pa.string()),
                               (names[3], pa.int64()), (names[4], pa.string()), (names[5], pa.int64())])
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")]
            for key, piece, a, b in zip(*columns, strict=True):
                if open_ is None or open_.key != key:
                    done += [open_.row()] if open_ else []
                    open_ = Running(key)
                open_.add(piece, a, b)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), kinds, strict=True)], schema=kinds)
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(open_.row(), kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(read, schema)
