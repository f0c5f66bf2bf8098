"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is compiled from a model file in three parts. The normaliser is a machine over blanks and other
characters that puts boundary marks. The lexicon has an arc for each piece (a matcher of all of them at once), and for
each character that is no piece an arc that writes its bytes, or the unknown id. The grammar weighs an arc by the one
before it. Composed with an input they give a lattice whose states are (place, last arc); the tropical-semiring
shortest path through it, with weights added along a path and the least kept at each state, is the encoding.

For unigram models an arc weighs its negative log probability and the grammar nothing. For models of merged pairs arcs
weigh nothing, and the grammar nothing where a piece may follow the last one and infinity where it may not: two pieces
may stand side by side if merging their characters gives just these two, and a sequence is the model's encoding exactly
if that holds for each neighbouring pair. States at infinite weight are not kept.

No arc crosses from text into a boundary mark, so the lattice falls into one part for each word, whose shortest
paths are kept in a bounded table.

Defined results: a null text stays null in texts and has no ids; an empty text has no ids; decoding inverts encoding
but for boundary marks in the text itself, which come back as blanks; rows are independent; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R

MARK = "▁"
#: Words whose paths a worker keeps before it starts anew.
MOST_KEPT = 1_200_000
MOST_FOLLOWS = 600_000

# types of pieces and of models in the public file format (fixed values)
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_UNIGRAM, _MERGES = 1, 2

#: In place of the last piece: the beginning of a path, or a character that is no piece (its bytes merge with nothing).
_ALONE = 1 << 30
#: Weight of an arc that writes bytes.
_BYTES_COST = 1e6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class ModelFile:
    pieces: list[tuple[str, float, int]]
    merges: bool
    byte_fallback: bool
    dummy_prefix: bool
    squeeze_blanks: bool


def read_model(path: str) -> ModelFile:
    with open(path, "rb") as f:
        top = list(_fields(f.read()))
    pieces = []
    for n, v in top:
        if n == 1:
            own = dict(_fields(v))
            pieces.append((own[1].decode("utf-8"), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, _NORMAL)))
    trainer = dict(_fields(next(v for n, v in top if n == 2)))
    normal = dict(_fields(next(v for n, v in top if n == 3)))
    if normal.get(1, b"identity") != b"identity" or normal.get(2):
        raise ValueError("only identity normalisation is compiled")
    if trainer.get(3, _UNIGRAM) not in (_UNIGRAM, _MERGES):
        raise ValueError("only models of pieces are compiled")
    return ModelFile(pieces, trainer.get(3, _UNIGRAM) == _MERGES, bool(trainer.get(35, 0)), bool(normal.get(3, 1)), bool(normal.get(4, 1)))


class Normaliser:
    """States and arcs over classes of characters: (state, blank or not) to (what is written before the character, next state).

    A blank itself is never written.
    """

    def __init__(self, dummy_prefix: bool, squeeze_blanks: bool):
        prefix = MARK if dummy_prefix else ""
        self.arcs = {("start", False): (prefix, "text"), ("text", False): ("", "text")}
        if squeeze_blanks:  # blanks wait for text: leading and trailing ones are never written
            self.arcs |= {("start", True): ("", "start"), ("text", True): ("", "gap"), ("gap", True): ("", "gap"), ("gap", False): (MARK, "text")}
        else:
            self.arcs |= {("start", True): (prefix + MARK, "text"), ("text", True): (MARK, "text")}

        self.prefix, self.squeeze = prefix, squeeze_blanks

    def steps(self, text: str) -> str:
        """The machine, character by character."""
        out, state = [], "start"
        for c in text:
            written, state = self.arcs[state, c == " "]
            out.append(written if c == " " else written + c)
        return "".join(out)

    def __call__(self, text: str) -> str:
        """The same for whole runs: all but the first arc of a run of characters are loops that write these alone."""
        if self.squeeze:
            words = list(filter(None, text.split(" ")))
            return self.arcs["start", False][0] + self.arcs["gap", False][0].join(words) if words else ""
        return self.prefix + text.replace(" ", self.arcs["text", True][0]) if text else ""


class Transducer:
    def __init__(self, model: ModelFile):
        self.model = model
        self.normalise = Normaliser(model.dummy_prefix, model.squeeze_blanks)
        self.scores = {p: s for p, s, kind in model.pieces if kind in (_NORMAL, _USER)}
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (_NORMAL, _USER)}
        self.unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == _UNKNOWN)
        self.bytes = [self.unknown] * 256
        for i, (p, _, kind) in enumerate(model.pieces):
            if kind == _BYTE:
                self.bytes[int(p[1:-1], 16)] = i
        self.longest = max(map(len, self.scores), default=1)
        self._follows: dict[int, bool] = {}
        self._paths: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self.output = [self._shown(p, kind) for p, _, kind in model.pieces]
        self._single = frozenset(p for p in self.ids if len(p) == 1)
        self._units = self._parts()
        self._arcs = self._automaton()

    def _parts(self) -> re.Pattern:
        """Where the lattice falls apart: places that no piece spans, so that the sides never merge.

        Those are before a boundary mark that follows text, around ASCII characters that no piece holds, and before an
        ASCII mark, unless some piece has a mark after the character at hand.
        """
        if any(MARK in p[k:] and p[k - 1] != MARK for p in self.scores for k in range(1, len(p)) if p[k] == MARK):
            return re.compile(".+", re.DOTALL)  # some piece spans words
        held = set("".join(self.scores))
        chars = lambda cs: "".join("\\" + c if c in "\\]^-[&~|" else c for c in sorted(cs))
        alone = chars(chr(c) for c in range(128) if chr(c) not in held and c != 0x20)
        own = {chr(c) for c in range(128) if chr(c) in held and not chr(c).isalnum()}
        before = chars({a for p in self.scores for a, b in zip(p, p[1:]) if b in own and a not in own and a != MARK})
        marks = chars(own)
        text = f"[^{MARK}{alone}{marks}{before}]" + (f"|[{before}][{marks}]*" if before and marks else f"|[{before}]" if before else "")
        ways = [f"[{alone}]"] if alone else []
        ways += [f"{MARK}*[{marks}]*(?:{text})+", f"{MARK}*[{marks}]+"] if marks else [f"{MARK}*(?:{text})+"]
        return re.compile("|".join([*ways, f"{MARK}+"]))

    def _automaton(self):
        """Of all arcs: a matcher that gives, at each place, the pieces that end there, the longest first."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            found.add_word(piece, (i, len(piece), 0.0 if self.model.merges else -self.scores[piece]))
        if self.ids:
            found.make_automaton()
        return found

    @staticmethod
    def _shown(piece: str, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(piece[1:-1], 16)])
        if kind == _CONTROL:
            return b""
        if kind == _UNKNOWN:
            return " ⁇ ".encode()
        return piece.replace(MARK, " ").encode("utf-8")

    # -- the machine --

    def _merged(self, text: str) -> list[str]:
        """What merging the best neighbouring pair, again and again, makes of a short text."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and score > best:
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, last: int, piece: int) -> bool:
        """The grammar of merges: whether ``piece`` has a finite weight after ``last`` (``_ALONE``: after nothing that merges)."""
        key = last << 32 | piece
        got = self._follows.get(key)
        if got is None:
            if len(self._follows) > MOST_FOLLOWS:
                self._follows.clear()
            names = [self.model.pieces[i][0] for i in (last, piece) if i != _ALONE]
            got = self._follows[key] = self._merged("".join(names)) == names
        return got

    def bytes_of(self, character: str) -> tuple[int, ...]:
        """What the arc of a character that is no piece writes."""
        return tuple(self.bytes[b] for b in character.encode("utf-8", "surrogatepass")) if self.model.byte_fallback else (self.unknown,)

    def compose(self, unit: str) -> Iterable[tuple[int, tuple[int, int, float]]]:
        """Arcs (last place, (label, length, weight)) of one part of the lattice by last place.

        A label is a piece, or ``~c`` for a character c that is none.
        """
        found = self._arcs.iter(unit) if self.ids else ()
        if self._single.issuperset(unit):
            return found
        alone = ((k, (~ord(c), 1, _BYTES_COST)) for k, c in enumerate(unit) if c not in self._single)
        return heapq.merge(found, alone, key=lambda arc: arc[0])

    def shortest_path(self, unit: str) -> list[int]:
        """Labels of the path of least weight over one part of the lattice."""
        merges, follows = self.model.merges, self._follows.get
        # of each place: (weight, what the grammar sees, label, state before); an arc leads from one place to one state
        states: list[list[tuple]] = [[] for _ in range(len(unit) + 1)]
        states[0].append((0.0, _ALONE, 0, None))
        for last, (label, size, weight) in self.compose(unit):
            best = None
            for state in states[last + 1 - size]:
                if merges and label >= 0:
                    ok = follows(state[1] << 32 | label)
                    if ok is None:
                        ok = self.may_follow(state[1], label)
                    if not ok:
                        continue
                if best is None or state[0] < best[0]:
                    best = state
            if best is None:
                continue
            total, own = best[0] + weight, states[last + 1]
            if merges and label >= 0:
                own.append((total, label, label, best))
            elif not own or merges:
                own.append((total, _ALONE, label, best))
            elif total < own[0][0]:  # the grammar sees no difference: one state
                own[0] = (total, _ALONE, label, best)
        state, out = min(states[-1], key=lambda x: x[0]), []
        while state[3] is not None:
            out.append(state[2])
            state = state[3]
        return out[::-1]

    def _emit(self, labels: list[int]) -> list[int]:
        return [i for label in labels for i in ((label,) if label >= 0 else self.bytes_of(chr(~label)))]

    def _unit(self, unit: str) -> bytes:
        got = self._older.get(unit)
        if got is None:
            ids = self._emit(self.shortest_path(unit))
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) <= 64:
            if len(self._paths) >= MOST_KEPT // 2:  # two generations: what is still met moves to the new one
                self._older, self._paths = self._paths, {}
            self._paths[unit] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, as little-endian unsigned 32-bit numbers."""
        units = self._units.findall(self.normalise(text))
        parts = list(map(self._paths.get, units))
        if None in parts:
            parts = [got if got is not None else self._unit(unit) for got, unit in zip(parts, units, strict=True)]
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes of pieces in order, without the blank that the normaliser put first."""
        data = b"".join(map(self.output.__getitem__, ids.tolist()))
        if self.model.dummy_prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(read_model(path))


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for part in R.pieces_of(batches):
            ids = [None if t is None else pa.scalar(machine.encode(t).astype(np.int32), pa.list_(pa.int32())).as_py() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts = [None if i is None else machine.decode(np.array(i, np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _digester(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for part in R.pieces_of(batches):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = machine.encode(text or "")
                rows.append((doc, len(ids), zlib.crc32(ids.tobytes()), machine.decode(ids) == (text or "").replace(MARK, " ")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return run


def _narrow(docs: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    R.ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast(kind).alias(text_col))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row."""
    return _narrow(docs, id_col, text_col, "string").withColumnRenamed(text_col, "text").mapInArrow(_encoder(model), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) for every row of (doc_id, ids)."""
    return _narrow(encoded, "doc_id", "ids", "array<int>").mapInArrow(_decoder(model), "doc_id long, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip): each text encoded, and decoded again."""
    return _narrow(docs, id_col, text_col, "string").withColumnRenamed(text_col, "text").mapInArrow(_digester(model), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
