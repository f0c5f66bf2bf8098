"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Each occurrence of an anchor (a very common word) starts a chain: the next ``CHAIN`` content words after it, at steps
of ``STEP`` content words. Anchor and chain make one spot signature; a text's fingerprint is its set of signatures,
written as their sorted 32-bit hashes. A text without a full chain takes a chain from each of its words instead, and
one without words a hash of itself. The likeness of two fingerprints is the Jaccard coefficient of their sets.

:func:`similar_pairs` finds all pairs of fingerprints at or above a likeness. Sets are partitioned by their length:
a pair at likeness t has lengths within a factor t, so a set meets only its own and the next partition. Inside, sets
meet at shared signatures of their prefixes in an order from rare to common, and pairs that the positions of the
match rule out are pruned before the exact Jaccard coefficient. Equal fingerprints are one class from the start.

:func:`edited_likeness` fingerprints each text, an edited form of it and compares it with its successor; successors
are found by ranges of ids, with the first row of each range also dealt to the range before it, so that no task sees
more than its range and no text is sent twice but those.

Defined results: a null text is empty; equal texts have equal fingerprints; two empty texts are alike; a null id
sorts after all others; rows that share an id follow by their text; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime as R, textcodes as X

#: Common words of the languages at hand (fixed values).
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "with", "you",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "aux", "avec", "dans", "de", "du", "elle", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "al", "con", "del", "el", "es", "las", "lo", "los", "no", "para", "por", "se", "su", "y",
)
CHAIN = 3
STEP = 1
#: Ranges of ids that a partition gets, about: more of them are dealt more evenly.
RANGES_PER_PARTITION = 6


def _anchors() -> np.ndarray:
    words = pa.array(sorted(set(ANCHORS)), pa.string())
    return np.sort(X.words(*R.text_bytes(words), "alnum", fold=True).hash)


_ANCHORS = _anchors()


def signature_sets(array: pa.Array, chain: int = CHAIN, step: int = STEP) -> list[np.ndarray]:
    """Sorted distinct 32-bit signature hashes of each text of a string array."""
    data, offsets = R.text_bytes(array)
    w = X.words(data, offsets, "alnum", fold=True)
    h, first = w.hash, w.first
    anchor = X.lookup(_ANCHORS, h) >= 0
    content = np.flatnonzero(~anchor)
    doc = w.doc
    # of each word: the number of content words before or at it, which is the place of the next one in `content`
    after = np.cumsum(~anchor)
    reach = step * (chain - 1)
    at = np.flatnonzero(anchor)
    begin = after[at]
    fits = begin + reach < len(content)
    at, begin = at[fits], begin[fits]
    inside = doc[content[begin + reach]] == doc[at] if len(at) else np.zeros(0, bool)
    at, begin = at[inside], begin[inside]
    total = h[at] * X.U64(X._window_key(0))
    for k in range(chain):
        total = total + h[content[begin + k * step]] * X.U64(X._window_key(k + 1))
    spots = (X.mix64(total) >> X.U64(32)).astype(np.uint32)
    cuts = np.searchsorted(at, first)
    out = []
    for d in range(len(first) - 1):
        own = spots[cuts[d] : cuts[d + 1]]
        if not len(own):
            words = h[first[d] : first[d + 1]]
            if len(words):
                size = min(chain, len(words))
                mixed = np.zeros(len(words) - size + 1, X.U64)
                for k in range(size):
                    mixed += words[k : len(words) - size + 1 + k] * X.U64(X._window_key(k + 1))
                own = (X.mix64(mixed + X.U64(size)) >> X.U64(32)).astype(np.uint32)
            elif offsets[d + 1] > offsets[d]:
                whole = hashlib.blake2b(data[offsets[d] : offsets[d + 1]].tobytes(), digest_size=4).digest()
                own = np.frombuffer(whole, np.uint32)
        out.append(np.unique(own))
    return out


def written(signatures: np.ndarray) -> str:
    """A set of signatures as text: base64 of its sorted little-endian 32-bit hashes."""
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode("ascii")


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard coefficient of two sorted sets; pruned to no work where one is empty. Two empty sets are alike."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if len(x) > len(y):
        x, y = y, x
    same = int((X.lookup(y, x) >= 0).sum())
    return same / (len(x) + len(y) - same)


def _fingerprinter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in R.pieces_of(batches):
        sets = signature_sets(part.column(1))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "spots"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, spots) for every row: the size and the sorted signatures of its fingerprint."""
    R.ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_fingerprinter, "doc_id long, n int, spots array<long>")


def similar_pairs(prints: DataFrame, least: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): (doc_id, class_id) for every row of ``prints``, and (a, b, likeness) between classes.

    A class is the rows of equal fingerprints, named by its smallest id. Pairs have a < b and likeness >= least.
    """
    prints = R.stage(prints, "prints")
    classes = R.stage(prints.where("n > 0").groupBy("spots").agg(F.min("doc_id").alias("id"), F.first("n").alias("n")), "classes")
    member = prints.join(classes.select("spots", F.col("id").alias("class_id")), "spots", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))

    spots = classes.select("id", "n", F.explode("spots").alias("spot"))
    common = spots.groupBy("spot").agg(F.count("*").alias("df")).where("df > 1")
    shared = spots.join(common, "spot")
    of_set = Window.partitionBy("id", "n")
    at = F.col("n") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("df", "spot")) - 1
    prefix = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    # partitions of lengths: a factor of 1/least each, so that a set meets its own and the next one only
    part = F.floor(F.log(F.col("n").cast("double")) / (-math.log(least)) + 1e-9).cast("int")
    entries = shared.withColumn("at", at).where(F.col("at") < prefix).select("spot", "id", "n", "at", part.alias("part"))
    probes = entries.select("spot", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("own"))
    stored = entries.select("spot", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), "part")
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    met = probes.join(stored, ["spot", "part"]).where(
        ((F.col("part") > F.col("own")) | (F.col("a") < F.col("b")))
        & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9)
        & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= need)
    )
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = classes.select(F.col("id").alias("a"), F.col("spots").alias("x"))
    right = classes.select(F.col("id").alias("b"), F.col("spots").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    alike = same / (F.size("x") + F.size("y") - same)
    return member, pairs.join(left, "a").join(right, "b").select("a", "b", alike.alias("likeness")).where(F.col("likeness") >= least - 1e-12)


def partners(prints: DataFrame, least: float = 0.75) -> DataFrame:
    """(doc_id, class_id, n_similar) for every row: the class of its fingerprint and the number of classes alike to it."""
    member, pairs = similar_pairs(prints, least)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id"))
    return member.join(ends.groupBy("class_id").agg(F.count("*").alias("n")), "class_id", "left").select("doc_id", "class_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_similar"))


# ---- edited texts and successors ----

_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with its last half of code points replaced by the first as many (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _editor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range and descending id; a guest row ends a range and is only looked at as a successor."""
    held: tuple | None = None  # range, guest, id, text, set: waits for its successor

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (id, text, set, next text, next set)."""
        changed = [edited(t, follow) for _, t, _, follow, _ in rows]
        sets = signature_sets(pa.array(changed, pa.string()))
        cols = (
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]),
            pa.array([written(r[2]) for r in rows]),
            pa.array([written(s) for s in sets]),
            pa.array([likeness(r[2], s) for r, s in zip(rows, sets, strict=True)], pa.float64()),
            pa.array([likeness(r[2], r[4]) for r in rows], pa.float64()),
        )
        return pa.RecordBatch.from_arrays(list(cols), names=[c.split()[0] for c in _EDITED.split(", ")])

    for part in R.pieces_of(batches):
        ranges, guests, ids = (part.column(k).to_pylist() for k in ("_range", "_guest", "doc_id"))
        at = part.schema.get_field_index("text")
        texts = [t or "" for t in part.column(at).to_pylist()]
        sets = signature_sets(part.column(at))
        rows = []
        for now in zip(ranges, guests, ids, texts, sets, strict=True):
            if held is not None and held[0] == now[0] and not held[1]:
                rows.append((*held[2:], now[3], now[4]))
            held = now
        if rows:
            yield answer(rows)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``_EDITED`` for every row."""
    spark = docs.sparkSession
    R.ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # place: the larger the id, the earlier; null ids last
    place = F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1))
    partitions = R.partitions(docs)
    ranges = RANGES_PER_PARTITION * partitions
    bounds = texts.select(place.cast("double").alias("p")).approxQuantile("p", [k / ranges for k in range(1, ranges)], 0.2 / ranges)
    bounds = sorted({min(math.floor(b), 2**63 - 1) for b in bounds})
    # the range of a place: how many bounds lie below it; a sorted array of at most `ranges` numbers
    table = spark.sparkContext.broadcast(np.array(bounds, np.int64))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("_place").to_numpy(zero_copy_only=False)
            got = pa.array(np.searchsorted(table.value, places, "left").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, "_range"])

    placed = texts.withColumn("_place", place)
    ids = placed.select("doc_id", "_place").mapInArrow(ranged, "doc_id long, _place long, _range int")
    heads = ids.groupBy("_range").agg(F.min("_place").alias("_first")).orderBy("_range").collect()  # one small row for each range
    if not heads:
        return R.empty_like(spark, _EDITED)
    # the head of each range is also the successor of the last row before it; the first of all follows the last
    guests = [(heads[k]["_first"], heads[k - 1]["_range"] if k else heads[-1]["_range"]) for k in range(len(heads))]
    wanted = spark.createDataFrame(guests, "_place long, _to int")
    lead = placed.join(F.broadcast(wanted), "_place")  # as many rows as there are ranges
    first = lead.groupBy("_place", "_to").agg(F.min_by("doc_id", F.struct("text")).alias("doc_id"), F.min("text").alias("text"), F.max(F.col("text").isNull()).alias("_void"))
    guest = first.select("doc_id", F.when(~F.col("_void"), F.col("text")).alias("text"), F.col("_to").alias("_range"), F.lit(True).alias("_guest"), F.lit(2**63 - 1).alias("_place"))
    own = placed.mapInArrow(ranged, "doc_id long, text string, _place long, _range int").select("doc_id", "text", "_range", F.lit(False).alias("_guest"), "_place")
    dealt = own.unionByName(guest).repartition(partitions, "_range").sortWithinPartitions("_range", "_guest", "_place", F.col("text").asc_nulls_first())
    return dealt.select("_range", "_guest", "doc_id", "text").mapInArrow(_editor, _EDITED)
