"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The packing is planned on the histogram of piece lengths, which has at most ``capacity`` entries whatever the size
of the table: pieces above a third of the capacity are matched greedily (at most two share a sequence: the longest
left takes the longest partner that fits), then shorter lengths, longest first, go to the tightest gap that takes
them. The plan is a list of sequence patterns with multiplicities. A piece finds its place from its rank among
pieces of its length; ranks are taken per (length, salt) with running offsets over the salts, so that a very
common length is no single task's work. A length has as many salts as its pieces need, and a piece's salt follows from
a number of its own, so that repeated rows are dealt out as well.

Ids are those of the tokenizers library's own call; a text that holds an added token of the vocabulary has its id there.

Defined results: a null text has no ids of its own, so its document is the end id alone; documents longer than the
capacity are cut from the end into whole pieces and their first piece has the rest; repeated rows are packed each;
a null id stays null. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime as R

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that a task ranks, about.
PIECES_PER_SALT = 500

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies show printable bytes as themselves and the others as characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return table | {chr(0x100 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of the byte-level BPE vocabulary in a tokenizers file; the file's own library takes texts that the fast path refuses."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        R.worker_env()
        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte = _byte_of_char()
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def ids(self, text: str) -> np.ndarray:
        if not any(token in text for token in self.special):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # the fast path's regex engine gives up on runs of a million blanks
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _piecer(path: str, pattern: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for part in R.pieces_of(batches):
            rows: list[tuple] = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.append(own.ids(text), np.uint32(end_id)) if text else np.array([end_id], np.uint32)
                ids = ids.astype("<u4", copy=False)
                n = len(ids)
                begin, piece = 0, 0
                while begin < n:
                    end = begin + ((n - begin) % capacity or capacity)
                    rows.append((doc, piece, begin, end - begin, zlib.crc32(ids[begin:end].tobytes())))
                    begin, piece = end, piece + 1
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (sequences, [(length, pieces of it in each), ...]) that hold all pieces of a length histogram."""
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} in sequences of {capacity}")
        left[length] = n
    gaps: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]
    least = capacity // 3 + 1

    for a in range(capacity, least - 1, -1):
        while left[a]:
            b = min(a, capacity - a)
            while b >= least and left[b] < 1 + (b == a):
                b -= 1
            if b < least:
                n, items = left[a], [(a, 1)]
            elif b == a:
                n, items = left[a] // 2, [(a, 2)]
            else:
                n, items = min(left[a], left[b]), [(a, 1), (b, 1)]
            for length, k in items:
                left[length] -= n * k
            gaps[capacity - sum(x * k for x, k in items)].append((n, items))

    for length in range(least - 1, 0, -1):
        rest = left[length]
        gap = length
        while rest and gap <= capacity:
            if not gaps[gap]:
                gap += 1
                continue
            n, items = gaps[gap].pop()
            each = gap // length
            full = min(n, rest // each)
            if full:
                gaps[gap - each * length].append((full, [*items, (length, each)]))
                rest, n = rest - full * each, n - full
            if n and rest:  # fewer than fill one more
                gaps[gap - rest * length].append((1, [*items, (length, rest)]))
                rest, n = 0, n - 1
            if n:
                gaps[gap].append((n, items))
        each = capacity // length
        if rest // each:
            gaps[capacity - each * length].append((rest // each, [(length, each)]))
        if rest % each:
            gaps[capacity - (rest % each) * length].append((1, [(length, rest % each)]))
    return [x for held in gaps for x in held]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, pieces in each sequence, first sequence, offset) for each run of ranks."""
    out, taken, first = [], {}, 0
    for n, items in patterns:
        offset = 0
        for length, k in items:
            rank = taken.get(length, 0)
            out.append((length, rank, n * k, k, first, offset))
            taken[length] = rank + n * k
            offset += k * length
        first += n
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY, per_salt: int = PIECES_PER_SALT) -> DataFrame:
    """``pieces`` (with length, and ``_at``, a number of each) plus sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    salts = spark.createDataFrame([(k, -(-n // per_salt)) for k, n in histogram.items()], "length int, _salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("_at"), F.col("_salts"))).drop("_salts")
    table = spark.createDataFrame(slots(plan(histogram, capacity)) or [], "_length long, _first long, _ranks long, _each long, _sequence long, _offset long")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    offsets = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    in_salt = Window.partitionBy("length", "_salt").orderBy("_at")
    ranked = salted.withColumn("_place", F.row_number().over(in_salt) - 1).join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_place"))
    # at most a few slots for each of `capacity` lengths: a fixed bound
    placed = ranked.join(F.broadcast(table), F.expr("length = _length and _rank >= _first and _rank < _first + _ranks"))
    j = F.col("_rank") - F.col("_first")
    return placed.select(
        *[c for c in pieces.columns if c != "_at"],
        (F.col("_sequence") + F.floor(j / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (j % F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    R.ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = texts.mapInArrow(_piecer(vocabulary, pattern, capacity, end_id), _PIECES)
    pieces = R.stage(cut.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    return place(pieces, capacity)
