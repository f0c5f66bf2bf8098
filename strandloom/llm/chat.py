"""Chat formatting: a finite-state machine over roles and a declarative template give segments with loss flags.

The rows of a conversation, in the order of their turns, become segments: the opening of a turn with its role, the
turn's text, and its close. Only the texts of roles that the template trains on carry the loss flag. Control strings
inside roles and texts are escaped with a backslash, so the output can be read back exactly; :class:`Reader` does
that from the segments as they come, and never needs a whole conversation at once.

Rows are dealt by conversation and sorted, and stream through one task in order; memory holds a single turn. A
conversation is one digest over all its text, so its turns have to pass through one task.

Defined results: a null text or role is empty; a null conversation id is a conversation of its own; rows of equal
turn follow by role and text; an invalid order of roles is reported in ``valid`` and still formatted; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R


@dataclass(frozen=True)
class Template:
    """What surrounds roles and texts, which roles carry loss, and the machine of turn order."""

    opening: str = "### "
    header_end: str = ": "
    close: str = "</turn>\n"
    control: tuple[str, ...] = ("### ", ": ", "</turn>")
    loss_roles: tuple[str, ...] = ("assistant",)
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accepting: tuple[str, ...] = ("user", "assistant")


@dataclass(frozen=True)
class Segment:
    text: str
    loss: bool


class Formatter:
    """Turns to segments, and the state of the turn order."""

    def __init__(self, template: Template):
        self.template = template
        self.state: str | None = template.start
        self._controls = re.compile("|".join(re.escape(c) for c in sorted(("\\", *template.control), key=len, reverse=True)))

    def escape(self, text: str) -> str:
        return self._controls.sub(lambda m: "\\" + m[0], text)

    def turn(self, role: str, text: str) -> list[Segment]:
        t = self.template
        if self.state is not None:
            self.state = t.moves.get((self.state, role))
        shown = t.names.get(role)
        # a name of the template is shown as such; any other role is quoted, so that no two roles look alike
        shown = self.escape(shown) if shown is not None else "=" + self.escape(role)
        return [Segment(t.opening + shown + t.header_end, False), Segment(self.escape(text), role in t.loss_roles), Segment(t.close, False)]

    @property
    def valid(self) -> bool:
        return self.state in self.template.accepting


class Reader:
    """Formatted segments back to turns; feed() gives each (role, text, text under the loss mask) as it ends."""

    def __init__(self, template: Template):
        self.template = template
        escaped = "|".join(re.escape("\\" + c) for c in sorted(("\\", *template.control), key=len, reverse=True))
        self._head = re.compile(f"({escaped})|({re.escape(template.header_end)})")
        self._body = re.compile(f"({escaped})|({re.escape(template.close)})")
        self._roles = {v: k for k, v in template.names.items()}
        self._held: list[Segment] = []

    def _upto(self, pattern: re.Pattern, text: str, at: int) -> tuple[str, int, int] | None:
        """Unescaped text from ``at`` to the first bare mark; the mark's start and end. None if there is no mark yet."""
        parts = []
        for m in pattern.finditer(text, at):
            parts.append(text[at : m.start()])
            if m[2] is not None:
                return "".join(parts), m.start(), m.end()
            parts.append(m[1][1:])
            at = m.end()
        return None

    def feed(self, segment: Segment) -> tuple[str, str, str] | None:
        self._held.append(segment)
        if not segment.text.endswith(self.template.close):
            return None
        text = "".join(s.text for s in self._held)
        if not text.startswith(self.template.opening):
            raise ValueError("a turn does not begin with the opening")
        head = self._upto(self._head, text, len(self.template.opening))
        body = head and self._upto(self._body, text, head[2])
        if not body or body[2] != len(text):
            return None
        shown, _, begin = head
        content, end, _ = body
        role = shown[1:] if shown.startswith("=") else self._roles[shown]
        loss, at = [], 0
        for s in self._held:
            if s.loss:
                a, b = max(at, begin), min(at + len(s.text), end)
                loss.append(self._unescape(text[a:b]))
            at += len(s.text)
        self._held = []
        return role, content, "".join(loss)

    def _unescape(self, text: str) -> str:
        return self._body.sub(lambda m: m[1][1:] if m[1] is not None else m[0], text)


_OUT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


class _Digest:
    def __init__(self, template: Template):
        self.formatter, self.reader = Formatter(template), Reader(template)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, role: str, text: str) -> None:
        for segment in self.formatter.turn(role, text):
            self.chars += len(segment.text)
            read = self.reader.feed(segment)
            if read:
                r, t, loss = read
                self.n += 1
                self.turns.update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
                self.loss.update(loss.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(loss)

    def row(self, conv: int | None) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.formatter.valid


def _digests(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own, rows = None, None, []
        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if own is None or c != conv:
                    if own is not None:
                        rows.append(own.row(conv))
                    conv, own = c, _Digest(template)
                own.add(role or "", text or "")
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
        if own is not None:
            rows.append(own.row(conv))
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _OUT.split(", ")])


def _segments(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own, first = None, None, True
        for batch in batches:
            out = []
            for c, turn, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True):
                if first or c != conv:
                    conv, own, first = c, Formatter(template), False
                segments = own.turn(role or "", text or "")
                out += [(c, turn, k, s.text, s.loss) for k, s in enumerate(segments)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "turn", "segment", "text", "loss"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    R.ship(rows.sparkSession)
    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return named.repartition(R.partitions(rows), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_segments(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turn, segment, text, loss) for every segment of every turn."""
    return _dealt(rows).mapInArrow(_segments(template or Template()), "conv_id long, turn long, segment int, text string, loss boolean")


def format_digests(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation, read back from its formatted segments."""
    return _dealt(rows).mapInArrow(_digests(template or Template()), _OUT)
