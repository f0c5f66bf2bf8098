"""Toxicity: gradient-boosted trees over a few dense features of a text, with isotonic calibration.

The lexicon is learned: words and word beginnings that are far more frequent in toxic than in other training texts,
with their log odds. A text's features are the densities of lexicon hits (plain, by beginning, and after undoing
obfuscation), how close hits stand to second-person words, and the rates of capitals, punctuation and obfuscated
words. Trees of small depth are boosted on them, and their sums are mapped to probabilities by isotonic regression
on texts that the trees have not seen.

Learning uses a bounded sample of distinct labelled texts (``MOST_TRAINING``, by a hash) in three folds. The sample has
more of the rarer label than the table; trees and calibration weigh each text by the labelled rows that it stands for,
so that a score is a probability under the table's own mix of labels, however large the table is.
The features that the trees learn from are crosswise: a text's hits come from a lexicon of the other two folds; the
lexicon for scoring comes from all three. A part of the sample is kept from the trees for the calibration. Lexicon
counts are taken on the executors; the driver holds lexicons and one row of features for each sampled text. Scoring is
one pass over whole texts.

Defined results: a null or empty text has all features at zero and gets the score of such a text; without training
rows of both labels every score is 0; null labels are not learned from; an id labelled again with the same label counts
once, with both labels once for each; repeated documents get the same score; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime as R, textcodes as X

#: Labelled texts that are learned from, about (a documented bound for fitting a classifier).
MOST_TRAINING = 24_000
#: Word beginnings in the lexicon have so many characters.
BEGINNINGS = (4, 5, 6, 7)
#: Least log odds of a lexicon entry, and least likelihood ratio (its chi-square tail is a thousandth).
LEAST_ODDS = 2.5
LEAST_RATIO = 10.83
#: Texts that score at least this are rejected.
CUTOFF = 0.7
NEAR = 6

#: Second-person words of the languages at hand (fixed values).
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "youre", "u", "ur", "du", "dich", "dir", "dein", "deine", "deinen", "ihr", "euch", "euer",
    "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros",
)
#: Characters that stand for letters in obfuscated words (fixed values).
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = ("hits", "hit_weight", "strongest", "begin_hits", "begin_weight", "unmasked_hits", "near_second_person", "second_person", "capitals", "exclaims", "marks", "masked", "log_words")
ROUNDS, DEPTH, RATE, CUTS = 60, 3, 0.2, 32
FOLDS = 3


@dataclass
class Lexicon:
    """Sorted hashes and log odds: of whole words, and of beginnings for each length."""

    words: tuple[np.ndarray, np.ndarray]
    beginnings: dict[int, tuple[np.ndarray, np.ndarray]]


def _second_person() -> np.ndarray:
    return np.sort(np.array([X.hash_text(w) for w in SECOND_PERSON], X.U64))


def _lookalikes() -> np.ndarray:
    table = np.arange(128, dtype=np.uint32)
    for a, b in LOOKALIKE.items():
        table[ord(a)] = ord(b)
    return table


class _Tokens:
    """Words of a slice of texts: runs of letters, and longer runs that also hold what stands for letters."""

    def __init__(self, part: pa.RecordBatch, column: int):
        data, offsets = R.text_bytes(part.column(column))
        raw, self.offsets = X.code_points(data, offsets)
        self.raw, self.docs = raw, part.num_rows
        self.codes = X.lower_codes(raw)
        self.flags = X.is_letter(self.codes)
        self.keys = X.code_keys(self.codes)
        self.start, self.end = X.spans(self.flags, self.offsets)
        self.hash = X.run_hashes(self.keys, self.flags, self.start, self.end)
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1

    def beginnings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first n characters of longer words, and which words those are."""
        which = np.flatnonzero(self.end - self.start > n)
        at = self.start[which]
        total = np.zeros(len(which), X.U64)
        for k in range(n):
            total += self.keys[at + k] * X.U64(X._window_key(k))
        return X.mix64(total + X.U64(n)), which

    def masked(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words as they read once look-alikes are letters and inner marks are gone; the text of each.

        Candidates are runs without blanks that begin and end in a letter or look-alike and hold something else.
        """
        c = self.codes
        blank = (c == 0x20) | ((c >= 9) & (c <= 13))
        start, end = X.spans(~blank, self.offsets)
        look = _lookalikes()
        swap = c.copy()
        low = c < 128
        swap[low] = look[c[low]]
        letter = X.is_letter(swap)
        # a candidate begins at its first letter or look-alike and ends at its last letter or digit: marks at the end
        # of a word (an exclamation) are no mask
        opens, closes = np.flatnonzero(letter), np.flatnonzero(self.flags | ((c >= 48) & (c <= 57)))
        if not len(start) or not len(closes):
            return np.zeros(0, X.U64), np.zeros(0, np.int64)
        i0, i1 = np.searchsorted(opens, start), np.searchsorted(closes, end) - 1
        a, b = opens[np.minimum(i0, len(opens) - 1)], closes[np.maximum(i1, 0)] + 1
        some = (a >= start) & (b <= end) & (b > a) & (a < end) & (b > start)
        a, b = a[some], b[some]
        plain = np.concatenate([[0], np.cumsum(self.flags)])
        letters = plain[b] - plain[a]
        mixed = (letters >= 2) & (letters < b - a) & (5 * letters >= 2 * (b - a))
        a, b = a[mixed], b[mixed]
        if not len(a):
            return np.zeros(0, X.U64), np.zeros(0, np.int64)
        size = b - a
        at = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        own = np.repeat(np.arange(len(a)), size)
        keep = letter[at]
        codes, own = swap[at][keep], own[keep]
        n = np.bincount(own, minlength=len(a))
        first = np.cumsum(n) - n
        h = X.run_hashes(X.code_keys(codes), np.ones(len(codes), bool), first, first + n)
        return h, np.searchsorted(self.offsets, a, "right") - 1


def features(lexicon: Lexicon, part: pa.RecordBatch, column: int) -> np.ndarray:
    """A row of FEATURES for each text."""
    t = _Tokens(part, column)
    docs = t.docs
    n = np.bincount(t.doc, minlength=docs).astype(float)
    per_doc = lambda which, weights=None: np.bincount(which, weights=weights, minlength=docs).astype(float)
    hashes, odds = lexicon.words
    at = X.lookup(hashes, t.hash)
    hit = at >= 0
    hits, weight = per_doc(t.doc[hit]), per_doc(t.doc[hit], odds[at[hit]])
    strongest = np.zeros(docs)
    np.maximum.at(strongest, t.doc[hit], odds[at[hit]])
    begin_hits, begin_weight = np.zeros(docs), np.zeros(docs)
    any_hit = hit.copy()
    for size, (begin_hashes, begin_odds) in lexicon.beginnings.items():
        h, which = t.beginnings(size)
        at = X.lookup(begin_hashes, h)
        got = at >= 0
        begin_hits += per_doc(t.doc[which[got]])
        begin_weight += per_doc(t.doc[which[got]], begin_odds[at[got]])
        any_hit[which[got]] = True
    masked_hash, masked_doc = t.masked()
    unmasked = X.lookup(hashes, masked_hash) >= 0
    second = X.lookup(_second_person(), t.hash) >= 0
    places = np.flatnonzero(second)
    near = np.zeros(docs)
    if len(places) and any_hit.any():
        hit_at = np.flatnonzero(any_hit)
        k = np.searchsorted(places, hit_at)
        for other in (places[np.minimum(k, len(places) - 1)], places[np.maximum(k - 1, 0)]):
            close = (np.abs(other - hit_at) <= NEAR) & (t.doc[other] == t.doc[hit_at])
            near += per_doc(t.doc[hit_at[close]])
    chars = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[t.offsets]).astype(float)
    letters = chars(t.flags)
    rate = lambda count, base=None: 100.0 * count / ((n if base is None else base) + 1.0)
    return np.stack(
        [
            rate(hits), rate(weight), strongest, rate(begin_hits), rate(begin_weight), rate(per_doc(masked_doc[unmasked])), rate(near), rate(per_doc(t.doc[second])),
            rate(chars(X.is_upper(t.raw)), letters), rate(chars(t.raw == 0x21)), rate(chars(np.isin(t.raw, [ord(c) for c in "?.,;:*#$%&|<>"]))),
            rate(per_doc(masked_doc)), np.log1p(n),
        ],
        axis=1,
    )


# ---- learning ----


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, n, entry, toxic texts, other texts) within each slice; n = 0: whole words, else beginnings of n characters."""
    for part in R.pieces_of(batches):
        t = _Tokens(part, part.schema.get_field_index("text"))
        toxic = np.array(part.column("toxic").to_pylist(), np.int64)
        folds = np.array(part.column("fold").to_pylist(), np.int64)
        found = [(0, t.hash, t.doc)]
        for size in BEGINNINGS:
            h, which = t.beginnings(size)
            found.append((size, h, t.doc[which]))
        for size, h, doc in found:
            if not len(h):
                continue
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
            h, doc = h[new], doc[new]
            for fold in range(FOLDS):
                own = folds[doc] == fold
                entries, where = np.unique(h[own], return_inverse=True)
                bad = np.bincount(where, weights=toxic[doc[own]], minlength=len(entries)).astype(np.int64)
                both = np.bincount(where, minlength=len(entries))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fold] * len(entries), pa.int32()), pa.array([size] * len(entries), pa.int32()), pa.array(entries.view(np.int64)), pa.array(bad), pa.array(both - bad)],
                    names=["fold", "n", "entry", "bad", "good"],
                )


def _featurer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in R.pieces_of(batches):
            folds = part.column("fold").to_numpy(zero_copy_only=False)
            for fold in np.unique(folds):
                own = part.filter(pa.array(folds == fold))
                x = features(sent.value[int(fold)], own, own.schema.get_field_index("text"))
                yield pa.RecordBatch.from_arrays([own.column("held"), own.column("toxic"), own.column("weight"), pa.array(list(x), pa.list_(pa.float64()))], names=["held", "toxic", "weight", "x"])

    return run


def _lexicon(counts: DataFrame, toxic: int, others: int) -> Lexicon:
    """All entries that are far more frequent in toxic texts, beyond chance; the bounded sample bounds their number."""
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1.0)) - F.log((F.col("good") + 0.5) / (others + 1.0))
    n, share = F.col("bad") + F.col("good"), toxic / max(1, toxic + others)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * F.lit(p)))).otherwise(0.0)
    ratio = 2 * (part("bad", share) + part("good", 1 - share))
    rows = counts.withColumns({"odds": odds, "ratio": ratio}).where((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= LEAST_RATIO)).select("n", "entry", "odds").collect()

    def table(size: int) -> tuple[np.ndarray, np.ndarray]:
        own = sorted((r["entry"] & 0xFFFFFFFFFFFFFFFF, r["odds"]) for r in rows if r["n"] == size)
        return np.array([e for e, _ in own], X.U64), np.array([o for _, o in own], float)

    return Lexicon(table(0), {size: table(size) for size in BEGINNINGS})


@dataclass
class Trees:
    """Boosted trees of fixed depth: split features and thresholds by level order, leaf values, and the base."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def sums(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, weight: np.ndarray | None = None) -> Trees:
    """Newton boosting of the weighted logistic loss on histograms of feature quantiles."""
    w = np.ones(len(y)) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    for f in range(x.shape[1]):  # a rare feature has all its quantiles at zero
        if (x[:, f] > 0).any():
            edges[f] = np.unique(np.concatenate([edges[f], [0.0], np.quantile(x[x[:, f] > 0, f], np.linspace(0, 1, CUTS // 2 + 1)[:-1])]))
    bins = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
    p = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    sums = np.full(len(y), base)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feats, cuts, values = [], [], []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-sums))
        g, h = w * (y - q), w * np.maximum(q * (1 - q), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = node == k
                best = 1e-6
                for f in range(x.shape[1]):
                    size = len(edges[f]) + 1
                    gs, hs = np.bincount(bins[own, f], g[own], size), np.bincount(bins[own, f], h[own], size)
                    gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
                    gt, ht = gs.sum(), hs.sum()
                    if not len(gl):
                        continue
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain = np.where((hl > 0.5) & (ht - hl > 0.5), gain, 0)
                    j = int(gain.argmax())
                    if gain[j] > best:
                        best, feature[k], threshold[k] = gain[j], f, edges[f][j]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + 1)
        sums += leaf[at]
        feats.append(feature)
        cuts.append(threshold)
        values.append(leaf)
    return Trees(np.array(feats), np.array(cuts), np.array(values), base)


def isotonic(sums: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: increasing knots (sum, probability), with a virtual text of the other label at each end."""
    order = np.argsort(sums, kind="stable")
    w = np.ones(len(y)) if weight is None else weight
    rows = [(sums[order[0]], 1.0, 1.0), *((sums[i], float(y[i]), float(w[i])) for i in order), (sums[order[-1]], 0.0, 1.0)]
    blocks: list[list[float]] = []  # weight, labels, first sum, last sum; of texts with the same sum, before any are pooled
    for s, label, n in rows:
        if blocks and blocks[-1][2] == s:
            blocks[-1][0] += n
            blocks[-1][1] += n * label
        else:
            blocks.append([n, n * label, s, s])
    equal, blocks = blocks, []
    for block in equal:
        blocks.append(block)
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    knots = [(s, b[1] / b[0]) for b in blocks for s in dict.fromkeys((b[2], b[3]))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def scores(self, part: pa.RecordBatch, column: int) -> np.ndarray:
        if self.trees is None:
            return np.zeros(part.num_rows)
        return np.interp(self.trees.sums(features(self.lexicon, part, column)), *self.knots)


def fit(training: DataFrame, most: int = MOST_TRAINING) -> Model | None:
    """A model from rows (text, toxic); None without texts of both labels.

    A column ``weight`` says how many rows of the table each row stands for; without it, one.
    """
    spark = training.sparkSession
    R.ship(spark)
    weight = F.col("weight") if "weight" in training.columns else F.lit(1.0)
    rows = training.where("text is not null and toxic in (0, 1)").select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic"), weight.alias("weight"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = _shares(sizes, most)
    place = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30))
    own = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    # a text stands for its rows: the drawn ones, each for as many as its draw left out
    distinct = rows.where(place < own * (1 << 30)).groupBy("text", "toxic").agg(F.sum(F.col("weight") / own).alias("weight"))
    fold = lambda salt, n: F.pmod(F.xxhash64("text", F.lit(salt)), F.lit(n)).cast("int")
    sample = R.stage(distinct.withColumns({"fold": fold(8, FOLDS), "held": fold(9, 10) >= 7}), "labelled")
    n = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    counts = sample.select("fold", "toxic", "text").mapInArrow(_document_frequencies, "fold int, n int, entry long, bad long, good long")
    counts = R.stage(counts.groupBy("fold", "n", "entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "counts")

    def lexicon_without(fold: int | None) -> Lexicon:
        of = lambda toxic: sum(v for (f, t), v in n.items() if t == toxic and f != fold)
        kept = counts if fold is None else counts.where(F.col("fold") != fold)
        return _lexicon(kept.groupBy("n", "entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), of(1), of(0))

    sent = spark.sparkContext.broadcast([lexicon_without(k) for k in range(FOLDS)])
    got = sample.select("fold", "held", "toxic", "weight", "text").mapInArrow(_featurer(sent), "held boolean, toxic int, weight double, x array<double>").collect()
    lexicon = lexicon_without(None)
    R.unstage(sample, counts)
    x = np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES))
    y = np.array([r["toxic"] for r in got], float)
    held = np.array([r["held"] for r in got], bool)
    w = np.array([r["weight"] for r in got], float)
    order = np.lexsort((*x.T, y, held, w))  # rows come in any order; a model is the same each time
    x, y, held, w = x[order], y[order], held[order], w[order]
    first, second = ~held, held
    if min(y[first].sum(), (1 - y[first]).sum(), y[second].sum(), (1 - y[second]).sum()) < 1:
        first = second = np.ones(len(y), bool)
    if not len(y) or not 0 < y.sum() < len(y):
        return Model(lexicon, None, None)
    w = w / w.mean()
    trees = boost(x[first], y[first], weight=w[first])
    return Model(lexicon, trees, isotonic(trees.sums(x[second]), y[second], w[second]))


def _scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = sent.value
        for part in R.pieces_of(batches):
            at = part.schema.get_field_index("text")
            score = model.scores(part, at) if model else np.zeros(part.num_rows)
            rest = [k for k in range(part.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), pa.array(score, pa.float64())], names=[*(part.schema.names[k] for k in rest), "score"])

    return run


def score(model: Model | None, docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` plus the score, from the text alone."""
    spark = docs.sparkSession
    R.ship(spark)
    sent = spark.sparkContext.broadcast(model)
    narrow = docs.select(*keep, F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in narrow.dtypes if c != "text") + ", score double"
    return narrow.mapInArrow(_scorer(sent), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that training never sees: crc32 of the id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _shares(sizes: dict[int, int], most: int) -> dict[int, float]:
    """The part of each label's rows in a sample of about ``most``: half each where there are enough of both."""
    few = min(sizes, key=lambda k: (sizes[k], k))
    of_few = min(most // 2, sizes[few])
    return {k: min(1.0, (of_few if k == few else most - of_few) / n) for k, n in sizes.items()}


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> DataFrame:
    """(text, toxic, weight) of a bounded sample of the labelled rows that training may see.

    The sample is drawn from the labels, before any text is read: about ``most`` rows, which are sent to the texts.
    A row's weight is the number of labelled rows that it stands for: one over its label's share.
    """
    seen = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return docs.select(F.col("text").cast("string").alias("text"), F.lit(None).cast("int").alias("toxic"), F.lit(1.0).alias("weight")).limit(0)
    share = _shares(sizes, most)
    own = F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    chosen = seen.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30)) < own * (1 << 30)).withColumn("weight", 1.0 / own)
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "_id").select("text", "toxic", "weight")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from the labels that are not held out, applied to all rows."""
    model = fit(labelled(docs, labels))
    out = score(model, docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def _filter(sent, cutoff: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = sent.value
        for part in R.pieces_of(batches):
            if model is not None:
                part = part.filter(pa.array(model.scores(part, part.schema.get_field_index("text")) < cutoff))
            yield part

    return run


def keep_clean(model: Model | None, docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that score below the cutoff, with all their columns."""
    R.ship(docs.sparkSession)
    return docs.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(model), cutoff), docs.schema)
