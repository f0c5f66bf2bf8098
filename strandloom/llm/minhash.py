"""Near-duplicate classes of documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature: the first scatters shingles over 2**32 places, the second maps places
to ranks, and coordinate k is the smallest rank of a set after its places were shifted circularly by k. Bands of
coordinates give the buckets. Links are confirmed on the full shingle sets.

Groups of any size stay linear:

* texts with equal shingle sets are one class from the start;
* in each bucket, members are first compared with one hub (the member that shares most buckets), and what is
  verified is contracted into components;
* of buckets that still hold several components, small ones give their pairs across components; in larger ones
  the pairs come from a prefix filter on the rarest shingles, which is exact: a pair at the threshold shares a
  shingle of both prefixes. Nothing is capped.

A pair at a similarity of exactly 0.75 meets in no band with probability (1 - 0.75**4)**32 = 5e-6, less above, and its
signatures agree in less than ``LEAST_ESTIMATE`` with one of 1e-7; ``exact`` leaves both out and takes all candidates
from the prefix filter.

Defined results: null or wordless texts have an empty set and are linked with nothing; a text of fewer words than
a shingle has its whole sequence as its only shingle; a null id takes no part (component null, kept true); rows
that share an id count as one document with several texts; equal rows are linked. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import components, runtime as R, textcodes as X

SHINGLE = 5
PERCENT = 75
BANDS = 32
ROWS = 4
#: Buckets of up to so many members give their pairs across components directly; others go through prefixes.
SMALL_BUCKET = 8
#: Pairs whose signatures agree in a smaller part cannot reach the threshold (5 standard errors below it).
LEAST_ESTIMATE = 0.55

_SKETCH = "doc_id long, n int, fp binary, bands array<long>, sig binary"


def _ranks(places: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit words."""
    x = places ^ (places >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A row of ``size`` coordinates for each non-empty set of 64-bit shingle hashes."""
    lens = np.array([len(s) for s in sets])
    out = np.empty((len(sets), size), np.uint32)
    begin = 0
    while begin < len(sets):  # blocks that stay in a core's cache
        end, total = begin, 0
        while end < len(sets) and (end == begin or total + lens[end] <= 60_000):
            total += lens[end]
            end += 1
        block = np.concatenate(sets[begin:end])
        first = np.concatenate([[0], np.cumsum(lens[begin:end])[:-1]])
        places = (X.mix64(block ^ X.U64(0x5DEECE66D)) >> X.U64(32)).astype(np.uint32)
        for k in range(size):
            out[begin:end, k] = np.minimum.reduceat(_ranks(places + np.uint32(k)), first)
        begin = end
    return out


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sig), bands), X.U64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, X.U64)
        for r in range(rows):
            key = X.mix64(key * X.U64(0x9E3779B97F4A7C15) + sig[:, b * rows + r].astype(X.U64))
        keys[:, b] = key
    return keys.view(np.int64)


def _sets(part: pa.RecordBatch, size: int) -> list[np.ndarray]:
    data, offsets = R.text_bytes(part.column(1))
    w = X.words(data, offsets, "blank", fold=True)
    return X.shingles(w.hash, w.first, size)


def _sketcher(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in R.pieces_of(batches):
            sets = _sets(part, size)
            n = np.array([len(s) for s in sets], np.int32)
            some = np.flatnonzero(n)
            fps: list[bytes | None] = [None] * len(sets)
            sigs: list[bytes | None] = [None] * len(sets)
            keys: list = [None] * len(sets)
            if len(some):
                full = signatures([sets[i] for i in some], bands * rows)
                band = _band_keys(full, bands, rows)
                short = (full & np.uint32(255)).astype(np.uint8)
                for j, i in enumerate(some):
                    fps[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    sigs[i] = short[j].tobytes()
                    keys[i] = band[j]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "n", "fp", "bands", "sig"],
            )

    return run


def _setter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in R.pieces_of(batches):
            sets = _sets(part, size)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["id", "n", "items"],
            )

    return run


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= least))

    return run


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), X.U64), np.frombuffer(y.as_buffer(), X.U64)
                if len(x) > len(y):
                    x, y = y, x
                same = int((X.lookup(y, x) >= 0).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _pairs_to_links(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, least: float = LEAST_ESTIMATE) -> DataFrame:
    """Of distinct candidate pairs (a, b): the links, confirmed on full sets; staged."""
    a = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    sized = pairs.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    likely = R.stage(sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_likely(least), "a long, b long"), "likely")
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    full = likely.join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b")
    links = R.stage(full.mapInArrow(_verifier(percent), "a long, b long").distinct(), "links")
    R.unstage(likely)
    return links


def _prefix_pairs(hot: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that may reach the threshold, from the rarest items of each set.

    hot: (id, n, label, items array<long>). The shorter set's items up to its index prefix meet the longer
    set's up to its probe prefix, within lengths that can reach the threshold; items of one set only cannot meet and
    just move the others' positions. For each item, the component with most entries is not joined with itself, and
    what lies beyond a shorter set's index prefix is on one side of the join only.
    """
    tokens = hot.select("id", "n", "label", F.explode("items").alias("item"))
    common = tokens.groupBy("item").agg(F.count("*").alias("df"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("df > 1")
    shared = tokens.join(common, "item")
    by_id = Window.partitionBy("id", "n", "label").orderBy("df", "item")
    alone = F.col("n") - F.count("*").over(Window.partitionBy("id", "n", "label"))
    ranked = shared.withColumn("at", alone + F.row_number().over(by_id) - 1)
    probe = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100.0 - 1e-9) + 1
    index = F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100.0 + percent) - 1e-9) + 1
    # sets that can reach the threshold have lengths of the same or the next class
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(100.0 / percent) + 1e-9).cast("int")
    entries = R.stage(ranked.where((F.col("at") < probe) & (F.col("l0") != F.col("l1"))).select("item", "id", "n", "label", "at", (F.col("at") < index).alias("indexed"), size.alias("size")), "entries")
    counted = entries.groupBy("item", "label").agg(F.count("*").alias("c"))
    major = counted.groupBy("item").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.count("*").alias("labels")).where("labels > 1")
    major = R.stage(major.select("item", "major"), "major")  # so that the joins below are all of their stage, and uneven sides can be split
    known = entries.join(major, "item")
    short = known.where("indexed").select("item", "id", "n", "label", "at", "major", F.explode(F.array("size", F.col("size") + 1)).alias("size")).alias("x")
    y = known.drop("indexed").alias("y")
    need = f"ceil({percent} * (x.n + y.n) / (100.0 + {percent}) - 1e-9)"
    meet = (
        f"x.item = y.item and x.size = y.size and x.label <> y.label and (x.n < y.n or (x.n = y.n and x.id < y.id))"
        f" and 100 * x.n >= {percent} * y.n and least(x.n - x.at, y.n - y.at) >= {need}"
    )
    minor = short.where("x.label <> x.major").join(y, F.expr(meet))
    most = short.where("x.label = x.major").join(y.where("y.label <> y.major"), F.expr(meet))
    both = [got.select(F.expr("least(x.id, y.id) a"), F.expr("greatest(x.id, y.id) b")) for got in (minor, most)]
    return both[0].unionByName(both[1]).distinct()


def _banded(texts: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, label) of the classes that have links, by bands; staged."""
    # buckets of several classes, and the hub of each: the member that meets most others
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = R.stage(members.join(full, "bucket"), "members")
    score = met.groupBy("rep").agg(F.sum("size").alias("score"))
    hubs = met.join(score, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("score", -F.col("rep"))).alias("hub"))
    pairs = met.join(hubs, "bucket").where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()

    # the full sets of all that met another
    active = R.stage(met.select(F.col("rep").alias("doc_id")).distinct(), "active")
    sets = R.stage(texts.join(active, "doc_id", "left_semi").mapInArrow(_setter(shingle), "id long, n int, items binary"), "sets")
    R.unstage(active)

    links = _pairs_to_links(pairs, reps, sets, percent)
    labels = R.stage(components.connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")

    # what buckets hold beyond one component
    labelled = met.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("bucket")
    rest = R.stage(labelled.join(mixed, "bucket"), "rest")
    small = rest.where(F.col("size") <= SMALL_BUCKET)
    x, y = small.alias("x"), small.alias("y")
    few = x.join(y, F.expr("x.bucket = y.bucket and x.rep < y.rep and x.label <> y.label")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    hot_ids = rest.where(F.col("size") > SMALL_BUCKET).select(F.col("rep").alias("id"), "label").distinct()
    hot = sets.join(hot_ids, "id").mapInArrow(_unpack, "id long, n int, label long, items array<long>")
    more = _pairs_to_links(few.unionByName(_prefix_pairs(hot, percent)).distinct(), reps, sets, percent)
    if more.isEmpty():
        final = labels
    else:
        all_links = links.unionByName(more)
        final = R.stage(components.connected_components(all_links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")
    R.unstage(sets, met, rest)
    return final


def _unbanded(texts: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The same with all candidates from the prefix filter."""
    ids = reps.select(F.col("rep").alias("doc_id"))
    sets = R.stage(texts.join(ids, "doc_id", "left_semi").mapInArrow(_setter(shingle), "id long, n int, items binary"), "sets")
    hot = sets.withColumn("label", F.col("id")).mapInArrow(_unpack, "id long, n int, label long, items array<long>")
    links = _pairs_to_links(_prefix_pairs(hot, percent), reps, sets, percent, 0.0)
    return R.stage(components.connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; see the module's text."""
    spark = docs.sparkSession
    R.ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = R.stage(texts.mapInArrow(_sketcher(shingle, bands, rows), _SKETCH), "sketch")
    alive = sketch.where("n > 0 and doc_id is not null")
    reps = R.stage(alive.groupBy("fp").agg(F.min(F.struct("doc_id", "n", "bands", "sig")).alias("m"), F.count("*").alias("copies")).select("fp", F.col("m.doc_id").alias("rep"), "m.n", "m.bands", "m.sig", "copies"), "reps")

    final = (_unbanded if exact else _banded)(texts, reps, shingle, percent)

    # back to documents: only classes with several rows or a link need a label
    named = reps.select("fp", "rep", "copies").join(final.select(F.col("node").alias("rep"), "label"), "rep", "left").where("copies > 1 or label is not null").select("fp", F.coalesce("label", "rep").alias("label"))
    out = sketch.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")).join(named, "fp", "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, others) that stay when each class keeps its document of smallest id.

    Rows that repeat a kept id are one document: the one whose row sorts first, as JSON, stays. Rows without an id stay.
    """
    marked = R.stage(near_duplicates(docs), "marked")
    gone = R.stage(marked.where("not kept").select("doc_id").distinct(), "gone")
    stay = docs.join(gone, "doc_id", "left_anti")
    again = R.stage(marked.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return stay.select(docs.columns)
    row, others = R.fresh(docs, "row"), [c for c in docs.columns if c != "doc_id"]
    one = stay.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*others), F.to_json(F.struct(*others))).alias(row)).select("doc_id", f"{row}.*")
    return stay.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one.select(docs.columns))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("items")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), batch.column("label"), pa.array(items, pa.list_(pa.int64()))], names=["id", "n", "label", "items"])
