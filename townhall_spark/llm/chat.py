"""Chat formatting that reads back to exactly its source.

A turn is rendered as ``opener text closer``. A deterministic parser reads the
rendered turn; where the turn that comes back differs from the source, the content
that conflicts is escaped and the turn rendered again, until both are identical.
Control strings inside texts are escaped by a backslash after their first
character, and one backslash more each time they have some already, so the escape
can be undone whatever a text holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the template: what opens and closes a turn of each role. Any other
# role is named in its opener, percent-encoded.
TURNS = {
    "system": ("<<SYS>>", "<</SYS>>"),
    "user": ("[INST]", "[/INST]"),
    "assistant": ("<s>", "</s>"),
}
OTHER = ("[ROLE", "[/ROLE]")
LOSS_ROLE = "assistant"

# A control string in a text, in two parts between which backslashes go.
_REST = r"(?:</?SYS>>|/?INST\]|/?s>|/?ROLE)"
_CONTROL = re.compile(rf"[<\[]{_REST}")
_ESCAPABLE = re.compile(rf"([<\[])(\\*)(?={_REST})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_REST})")
_OPENER = re.compile(r"(?P<system><<SYS>>)|(?P<user>\[INST\])|(?P<assistant><s>)"
                     r"|\[ROLE (?P<other>[^\]\s]*)\]")


class Turn(NamedTuple):
    """A turn read back; ``start`` and ``end`` are its text's place in the rendering."""

    role: str
    text: str
    start: int
    end: int


def escape(text: str) -> str:
    return _ESCAPABLE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def parse(rendered: str) -> list[Turn] | None:
    """The turns of a rendering, or None where it is not one."""
    turns, at = [], 0
    while at < len(rendered):
        opener = _OPENER.match(rendered, at)
        if not opener:
            return None
        other = opener.group("other")
        role = opener.lastgroup if other is None else unquote(other)
        close = OTHER[1] if other is not None else TURNS[role][1]
        control = _CONTROL.search(rendered, opener.end())
        start = opener.end() + 1
        if not control or control.start() - 1 < start \
                or not rendered.startswith(close, control.start()) \
                or rendered[opener.end()] != " " or rendered[control.start() - 1] != " ":
            return None
        end = control.start() - 1
        turns.append(Turn(role, unescape(rendered[start:end]), start, end))
        at = control.start() + len(close)
    return turns


def render(role: str, text: str) -> tuple[str, Turn]:
    """A turn's rendering and the turn as the parser reads it, equal to the source."""
    open_, close = TURNS.get(role) or (f"{OTHER[0]} {quote(role, safe='')}]", OTHER[1])
    body = text
    while True:
        rendered = f"{open_} {body} {close}"
        back = parse(rendered)
        if back and len(back) == 1 and back[0][:2] == (role, text):
            return rendered, back[0]
        body = escape(body)


_RENDERED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()),
                       ("rendered", pa.string()), ("loss", pa.bool_())])


def _render_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, turn, roles, texts = (c.to_pylist() for c in batch.columns)
        rows = [render(r, t)[0] for r, t in zip(roles, texts, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(rows, pa.string()),
             pa.array([r == LOSS_ROLE for r in roles], pa.bool_())], schema=_RENDERED)


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, rendered, loss): each turn's part of the formatted text.

    A conversation's formatted text is its ``rendered`` parts in the order of turn,
    then of the part itself for equal turns (a null turn comes first). ``loss``
    marks parts whose text is trained on; its place is what the parser says. Null
    texts and roles count as empty; repeated rows are turns of their own; a null
    conv_id is a conversation. Nothing is shuffled.
    """
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).mapInArrow(_render_rows, "conv_id long, turn long, rendered string, loss boolean")


class _Digest:
    """Running digests of one conversation; holds one turn at a time."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, 0
        self.all, self.trained = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str, loss: bool) -> None:
        for turn in parse(rendered):
            self.turns += 1
            self.all.update(f"{turn.role}\n{turn.text}\n".encode())
            if loss:
                text = unescape(rendered[turn.start:turn.end])
                self.loss += len(text)
                self.trained.update(text.encode())
        self.chars += len(rendered)

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss,
                self.trained.hexdigest(), self.chars)


_DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current = None
    for batch in batches:
        done = []
        for conv_id, rendered, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    done.append(current.row())
                current = _Digest(conv_id)
            current.add(rendered, loss)
        yield pa.RecordBatch.from_pylist(
            [dict(zip(_DIGESTS.names, r, strict=True)) for r in done], schema=_DIGESTS)
    if current is not None:
        yield pa.RecordBatch.from_pylist(
            [dict(zip(_DIGESTS.names, current.row(), strict=True))], schema=_DIGESTS)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text says: turns, loss text, length.

    A conversation is read as a stream in its order, so its size is not bounded by
    memory. Digests are SHA-256 of role, newline, text, newline per turn, and of
    all text under the loss mask.
    """
    return (formatted.repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "rendered")
            .select("conv_id", "rendered", "loss")
            .mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, "
                                    "loss_chars long, loss_sha256 string, formatted_chars long"))
