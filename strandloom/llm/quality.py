"""Quality rules and robust multivariate outliers among the statistics of texts.

Base rules count words, symbols, repeated lines and repeated five-word windows. Beyond them, transformed statistic
vectors are compared with their language and source by the minimum covariance determinant: of all parts of a group
that hold three quarters of its rows, the one whose covariance has the smallest determinant gives mean and covariance,
and a text is rejected when its Mahalanobis distance exceeds a cutoff. To the covariance a fixed diagonal is added
(``FLOOR``), so that a constant feature does not reject everything else; it is part of the determinant.

The search is FAST-MCD. On a bounded sample of a group (all of a small group) many random starts take concentration
steps, and the best of them step on to convergence. The best two different results then take concentration steps over
all rows of the group until the determinant falls no more, and the smaller determinant wins. A step keeps exactly the
closest rows: distances are counted in classes, the class that holds the quantile is divided again until its rows fit
a task, and these are sorted. Rows at the quantile itself count in equal part, so the order of rows does not matter.
Only sums by class and the bounded class at the quantile leave the tasks that read the rows.

A group needs five rows for each feature; a smaller one is held against its whole language, and a language too small
against all rows.

Defined results: a null text has no words and fails the base rules; null lang or source are groups of their own;
an empty table gives an empty result; repeated rows count each; ties in distance are treated alike.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R, textcodes as X

#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5

FEATURES = ("log_words", "log_word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "marks", "digits", "variety", "vowels")
#: What is added to the standard deviation of each feature: what varies less says nothing about quality.
FLOOR = (0.7, 0.15, 0.35, 0.35, 0.45, 0.35, 0.35, 0.35, 0.35, 0.25)
#: The part of a group's rows that its estimate is of.
SHARE = 0.75
#: Rows that a covariance of so many features needs.
LEAST_GROUP = 5 * len(FEATURES)
#: Rows of a group on which starts are tried, about; random starts; those that go on to convergence; and on to all rows.
SAMPLE, STARTS, BEST, CARRIED = 2000, 100, 10, 2
#: Steps end when the log determinant falls by less.
TOLERANCE = 1e-7
CLASSES = 64
#: Rows of the class at the quantile that one task sorts.
SORTED = 5000
#: A text is rejected beyond this upper-tail probability of the chi-square law: the share of ordinary texts, about.
TAIL = 1e-4

_STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in R.pieces_of(batches):
        data, offsets = R.text_bytes(part.column("text"))
        w = X.words(data, offsets, "blank", fold=False)
        docs = len(offsets) - 1
        n_words = np.diff(w.first)
        per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
        inside = X.byte_class("blank")[data]
        lead = (data & 0xC0) != 0x80
        word_chars = per(inside & lead)
        n_symbols = per(np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8)))
        capitals = per((data >= 65) & (data <= 90))
        letters = per(((data | 32) >= 97) & ((data | 32) <= 122))
        vowels = per(np.isin(data | 32, np.frombuffer(b"aeiouy", np.uint8)) & (data >= 65) & (data < 128))
        digits = per((data >= 48) & (data <= 57))
        marks = per(np.isin(data, np.frombuffer(b".,;:!?\"'()-", np.uint8)))

        # lines: runs between line feeds, cut where texts begin
        is_feed = data == 10
        line_start, line_end = X.spans(~is_feed, offsets)
        with_word = np.concatenate([[0], np.cumsum(inside)])
        some = with_word[line_end] > with_word[line_start]
        line_hash = X.run_hashes(X._byte_keys(False)[data], ~is_feed, line_start, line_end)[some]
        line_doc = np.searchsorted(offsets, line_start[some], "right") - 1
        n_lines = np.bincount(line_doc, minlength=docs)
        distinct_lines = _distinct(line_hash, line_doc, docs)

        window_hash, at = X.windows(w.hash, w.first, WINDOW)
        repeated = np.zeros(len(w.start), bool)
        if len(window_hash):
            key = X.mix64(window_hash + w.doc[at].astype(X.U64) * X.U64(0x9E3779B97F4A7C15))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            for k in range(WINDOW):
                repeated[at[twice] + k] = True
        n_repeat = np.diff(np.concatenate([[0], np.cumsum(repeated)])[w.first])
        variety = _distinct(w.hash, w.doc, docs)

        share = lambda part_, whole: np.log((part_ + 0.5) / (whole - np.minimum(part_, whole) + 1.0))
        words = n_words.astype(float)
        x = np.stack(
            [
                np.log1p(words),
                np.log((word_chars + 1.0) / (words + 1.0)),
                np.log1p(100.0 * n_symbols / (words + 10.0)),
                np.log1p(20.0 * (n_lines - distinct_lines) / (n_lines + 5.0)),
                np.log1p(20.0 * n_repeat / (words + 20.0)),
                np.log1p(20.0 * capitals / (letters + 20.0)),
                np.log1p(5.0 * marks / (words + 10.0)),
                np.log1p(20.0 * digits / (words + 20.0)),
                share(variety, words) * (words > 0) / np.sqrt(1.0 + np.log1p(words)),
                np.log((vowels + 1.0) / (letters - vowels + 10.0)),
            ],
            axis=1,
        )
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), part.column("lang"), part.column("source"),
                *(pa.array(v.astype(np.int64)) for v in (n_words, word_chars, n_symbols, n_lines - distinct_lines, n_repeat)),
                pa.array(list(x), pa.list_(pa.float64())),
            ],
            names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"],
        )


def _distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Distinct hashes within each text."""
    if not len(h):
        return np.zeros(docs, np.int64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    return np.bincount(doc[new], minlength=docs)


def chi_square_tail(x: float, d: float) -> float:
    """The upper tail of the chi-square law, by the series and the continued fraction of the incomplete gamma."""
    a, x = d / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale
    b = x + 1 - a
    c, dd = 1e300, 1.0 / b
    h = dd
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        dd = 1.0 / (an * dd + b)
        c = b + an / c
        h *= dd * c
        if abs(dd * c - 1) < 1e-15:
            break
    return scale * h


def chi_square_cutoff(tail: float, d: float) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, d) > tail else (low, mid)
    return high


class Determinant:
    """The covariance that is minimised, from sums over a group's kept rows."""

    def __init__(self, floor: tuple[float, ...], share: float):
        d = len(floor)
        self.d, self.share, self.floor = d, share, np.square(np.array(floor))
        # the covariance of the closest share of a normal law is too small by a known factor
        self.grow = share / (1 - chi_square_tail(chi_square_cutoff(1 - share, d), d + 2)) if share < 1 else 1.0
        self.upper = np.triu_indices(d)

    def kept(self, n: float) -> float:
        return max(1.0, math.ceil(self.share * n - 1e-9))

    def estimate(self, n: float, s: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(log determinant, mean, precision) from the count, sums and upper products of the kept rows."""
        mean = s / n
        cov = np.zeros((self.d, self.d))
        cov[self.upper] = p / n
        cov = self.grow * (cov + np.triu(cov, 1).T - np.outer(mean, mean))
        cov[np.diag_indices(self.d)] = np.maximum(np.diag(cov), 0.0) + self.floor
        return float(np.linalg.slogdet(cov)[1]), mean, np.linalg.inv(cov)

    def of(self, x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        return self.estimate(w.sum(), w @ x, self.products(x, w))

    def products(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return ((x * w[:, None]).T @ x)[self.upper]

    @staticmethod
    def far(x: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> np.ndarray:
        """Log of 1 + squared distance."""
        y = x - mean
        return np.log1p(np.maximum(((y @ precision) * y).sum(axis=1), 0.0))

    @staticmethod
    def closest(u: np.ndarray, w: np.ndarray, keep: float) -> np.ndarray:
        """Weights of the closest rows that make up ``keep``; rows at the quantile count in equal part."""
        order = np.argsort(u, kind="stable")
        at = min(len(u) - 1, int(np.searchsorted(np.cumsum(w[order]), keep * (1 - 1e-12))))
        q = u[order[at]]
        less, equal = u < q, u == q
        return np.where(less, w, np.where(equal, w * min(1.0, max(0.0, (keep - w[less].sum()) / w[equal].sum())), 0.0))

    def step(self, x: np.ndarray, w: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        return self.of(x, self.closest(self.far(x, mean, precision), w, self.kept(w.sum())))

    def search(self, x: np.ndarray, w: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """The best different results of many starts: two steps each, then the best of them to convergence."""
        rng = np.random.default_rng(len(x))
        begun = [self.of(x, w)]
        for _ in range(STARTS):
            some = rng.choice(len(x), min(len(x), self.d + 1), replace=False)
            now = self.of(x[some], np.ones(len(some)))
            for _ in range(2):
                now = self.step(x, w, *now[1:])
            begun.append(now)
        out: list[tuple[float, np.ndarray, np.ndarray]] = []
        for now in sorted(begun, key=lambda e: e[0])[:BEST] + begun[:1]:
            while (after := self.step(x, w, *now[1:]))[0] < now[0] - TOLERANCE * 1e-3:
                now = after
            out.append(now)
        best: list[tuple[float, np.ndarray, np.ndarray]] = []
        for now in sorted(out, key=lambda e: e[0]):
            if all(now[0] - e[0] > 1e-6 for e in best):
                best.append(now)
        return best[:CARRIED]


_ESTIMATE = "grp string, start int, mean array<double>, precision array<double>, logdet double, low double, high double, done boolean"
#: The log of 1 + distance lies below this.
_END = 800.0

# ---- rows of a group in blocks, so that an estimate meets many rows at once ----

_BLOCK = "grp string, n long, least long, x binary, place binary"
#: Places of rows in the draw of the sample.
_PLACES = 1 << 30


def _packer(d: int):
    """(id, grp, x) to blocks: the vectors of a group in a batch, and a place for each row by its id and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy().reshape(-1, d)
            place = X.mix64(batch.column(0).fill_null(0).to_numpy().view(X.U64))
            for k in range(d):
                place = X.mix64(place * X.U64(0x9E3779B97F4A7C15) + np.ascontiguousarray(x[:, k]).view(X.U64))
            place = (place >> X.U64(34)).astype(np.int64)
            grp = batch.column(1).dictionary_encode()
            code = grp.indices.to_numpy()
            rows = []
            for g, name in enumerate(grp.dictionary.to_pylist()):
                own = code == g
                rows.append((name, int(own.sum()), int(place[own].min()), x[own].tobytes(), place[own].tobytes()))
            yield _arrow(rows, _BLOCK)

    return run


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(cols, fields, strict=True)], names=[name for name, _ in fields])


def _drawer(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                drawn = np.frombuffer(r["place"], np.int64) <= r["upto"]
                rows += [(r["grp"], x.tolist()) for x in np.frombuffer(r["x"]).reshape(-1, d)[drawn]]
            yield _arrow(rows, "grp string, x array<double>")

    return run


def _edges(low: float, high: float) -> np.ndarray:
    return np.append(low + np.arange(CLASSES) * ((high - low) / CLASSES), high)


def _met(batches: Iterator[pa.RecordBatch], search: Determinant) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Each block with an estimate: the row, its vectors and their distances (log of 1 + square)."""
    for batch in batches:
        for r in batch.to_pylist():
            x = np.frombuffer(r["x"]).reshape(-1, search.d)
            yield r, x, search.far(x, np.array(r["mean"]), np.array(r["precision"]).reshape(search.d, -1))


#: Groups whose sums a task holds at once.
_HELD = 1000
_COUNTS = "grp string, start int, class int, c long"


def _histogram(search: Determinant, whole: bool):
    """Rows of each class of the interval, and (-1, CLASSES) on either side if they are looked at as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        told = lambda: _arrow([(g, k, c - 1, int(n)) for (g, k), counts in held.items() for c, n in enumerate(counts) if n], _COUNTS)
        for r, _, u in _met(batches, search):
            if not whole:
                u = u[(u >= r["low"]) & (u < r["high"])]
            got = np.bincount(np.searchsorted(_edges(r["low"], r["high"]), u, "right"), minlength=CLASSES + 2)
            key = (r["grp"], r["start"])
            held[key] = held[key] + got if key in held else got
            if len(held) > _HELD:
                yield told()
                held.clear()
        yield told()

    return run


#: kind 0: count, sums and products below the class at the quantile; 1: a row of that class; 2: its sums.
_PARTS = "grp string, start int, kind int, u double, v array<double>"


def _totals(search: Determinant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], np.ndarray] = {}
        told = lambda: _arrow([(*key, 0.0, v.tolist()) for key, v in held.items()], _PARTS)
        for r, x, u in _met(batches, search):
            inside = (u >= r["low"]) & (u < r["high"])
            for kind, own in ((0, u < r["low"]), (2, inside)):
                if kind == 0 or (r["equal"] and own.any()):
                    key, w = (r["grp"], r["start"], kind), np.ones(int(own.sum()))
                    held[key] = held.get(key, 0.0) + np.concatenate([[len(w)], x[own].sum(0), search.products(x[own], w)])
            if not r["equal"] and inside.any():
                yield _arrow([(r["grp"], r["start"], 1, float(a), v.tolist()) for a, v in zip(u[inside], x[inside], strict=True)], _PARTS)
            if len(held) > _HELD:
                yield told()
                held.clear()
        yield told()

    return run


def _starts(search: Determinant):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["x"].to_numpy())
        order = np.lexsort(x.T)  # rows come in any order
        found = search.search(x[order], rows["w"].to_numpy(float)[order])
        # all rows are looked at anew, from an interval where the quantile should be; a sample's determinant is not theirs
        out = []
        for k, (_, mean, precision) in enumerate(found):
            u = np.sort(search.far(x, mean, precision))
            q = float(u[min(len(u) - 1, int(search.share * len(u)))])
            out.append((rows["grp"].iloc[0], k, mean.tolist(), precision.ravel().tolist(), math.inf, max(0.0, q - 0.2), q + 0.2, False))
        return pd.DataFrame(out, columns=["grp", "start", "mean", "precision", "logdet", "low", "high", "done"])

    return run


#: Of a step under way: the rows kept for sure, those to keep, and the interval of the class at the quantile with its rows.
_OPEN = "grp string, start int, n long, keep double, low double, high double, inside long"


def _locate(search: Determinant, first: bool):
    """Counts of a group's classes to the class that holds the quantile."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class")
        count, head = rows["c"].to_numpy(np.int64), rows.iloc[0]
        n, keep = (0, search.kept(count.sum())) if first else (int(head["n"]), float(head["keep"]))
        at = min(len(count) - 1, int(np.searchsorted(n + np.cumsum(count), keep - 1e-9)))
        k, edges = int(rows["class"].iloc[at]), _edges(float(head["low"]), float(head["high"]))
        inside = (0.0, edges[0]) if k < 0 else (edges[-1], _END) if k >= CLASSES else (edges[k], edges[k + 1])
        return pd.DataFrame([(head["grp"], head["start"], n + int(count[:at].sum()), keep, *inside, int(count[at]))], columns=[c.split()[0] for c in _OPEN.split(", ")])

    return run


def _finish(search: Determinant):
    """What is below the class at the quantile, and its rows or their sums, to the next estimate."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kind, d = rows["kind"].to_numpy(), search.d
        head = rows[kind == 0].iloc[0]
        sums, q = np.asarray(head["v"], float), float(head["high"])
        need = float(head["keep"]) - sums[0]
        if (kind == 2).any():
            equal = np.asarray(rows[kind == 2].iloc[0]["v"], float)
            sums = sums + equal * min(1.0, need / equal[0])
        elif (kind == 1).any():
            x, u = np.stack(rows["v"][kind == 1].to_numpy()), rows["u"][kind == 1].to_numpy(float)
            order = np.lexsort((*x.T, u))
            x, u = x[order], u[order]
            w = search.closest(u, np.ones(len(u)), need)
            sums = sums + np.concatenate([[w.sum()], w @ x, search.products(x, w)])
            q = float(u[min(len(u) - 1, int(need))])
        logdet, mean, precision = search.estimate(sums[0], sums[1 : d + 1], sums[d + 1 :])
        done = not logdet < float(head["logdet"]) - TOLERANCE
        if done and logdet >= float(head["logdet"]):
            logdet, mean, precision = float(head["logdet"]), np.asarray(head["mean"], float), np.asarray(head["precision"], float).reshape(d, -1)
        out = (head["grp"], head["start"], mean.tolist(), precision.ravel().tolist(), logdet, max(0.0, q - 0.1), q + 0.1, done)
        return pd.DataFrame([out], columns=["grp", "start", "mean", "precision", "logdet", "low", "high", "done"])

    return run


def _step(blocks: DataFrame, now: DataFrame, search: Determinant) -> DataFrame:
    """One concentration step over all rows of the groups of ``now``."""
    key, state = ["grp", "start"], now.select("grp", "start", "mean", "precision")

    def located(interval: DataFrame, known: DataFrame, whole: bool) -> DataFrame:
        met = blocks.select("grp", "x").join(state.join(interval, key), "grp")
        counts = met.mapInArrow(_histogram(search, whole), _COUNTS).groupBy("grp", "start", "class").agg(F.sum("c").alias("c"))
        return counts.join(known, key).groupBy("grp", "start").applyInPandas(_locate(search, whole), _OPEN)

    interval = now.select("grp", "start", "low", "high")
    open_ = R.stage(located(interval, interval, True), "open")
    wide = (F.col("inside") > SORTED) & (F.col("high") - F.col("low") > 1e-12)
    while not open_.where(wide).isEmpty():  # a class of many rows is divided again, each time by CLASSES
        some = open_.where(wide)
        after = R.stage(open_.where(~wide).unionByName(located(some.select("grp", "start", "low", "high"), some.select("grp", "start", "n", "keep", "low", "high"), False)), "open")
        R.unstage(open_)
        open_ = after
    equal = ((F.col("inside") > SORTED) | (F.col("n") + F.col("inside") <= F.col("keep"))).alias("equal")
    met = blocks.select("grp", "x").join(state.join(open_.select("grp", "start", "low", "high", equal), key), "grp")
    parts = R.stage(met.mapInArrow(_totals(search), _PARTS), "parts")
    each = parts.where("kind <> 1").select("grp", "start", "kind", F.posexplode("v").alias("at", "y")).groupBy("grp", "start", "kind", "at").agg(F.sum("y").alias("y"))
    sums = each.groupBy("grp", "start", "kind").agg(F.array_sort(F.collect_list(F.struct("at", "y"))).alias("v")).select("grp", "start", "kind", F.lit(0.0).alias("u"), F.col("v.y").alias("v"))
    # the state goes with the one row of kind 0
    told = now.select("grp", "start", "mean", "precision", "logdet").join(open_.select("grp", "start", "keep", "high"), key).withColumn("kind", F.lit(0))
    ends = sums.unionByName(parts.where("kind = 1")).join(told, ["grp", "start", "kind"], "left")
    after = R.stage(ends.groupBy("grp", "start").applyInPandas(_finish(search), _ESTIMATE), "estimates")
    R.unstage(open_, parts)
    return after


def _measurer(search: Determinant):
    """Rows with the mean and precision of their group to rows with their distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = search.d
            x, mean, precision = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy() for c in ("x", "mean", "precision"))
            y = x.reshape(-1, d) - mean.reshape(-1, d)
            far = np.maximum((np.einsum("ni,nij->nj", y, precision.reshape(-1, d, d)) * y).sum(axis=1), 0.0)
            rest = [n for n in batch.schema.names if n not in ("mean", "precision")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in rest), pa.array(far)], names=[*rest, "distance"])

    return run


def outlier_distances(stats: DataFrame, floor: tuple[float, ...] = FLOOR, share: float = SHARE, least_group: int = LEAST_GROUP, sample: int = SAMPLE) -> DataFrame:
    """``stats`` (doc_id, lang, source, x, others) plus ``grp`` and ``distance``, the squared robust Mahalanobis distance."""
    R.ship(stats.sparkSession)
    search = Determinant(floor, share)
    lang, source = F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0"))
    sizes = stats.groupBy(lang.alias("_l"), source.alias("_s")).agg(F.count("*").alias("_n"))
    by_lang = sizes.groupBy("_l").agg(F.sum("_n").alias("_all"), F.min("_n").alias("_least"))
    small, pooled = F.col("_n") < least_group, F.col("_all") >= least_group
    own, whole = F.to_json(F.struct("_l", "_s")), F.to_json(F.struct("_l"))
    grp = F.when(~small, own).when(pooled, whole).otherwise(F.lit(""))
    # what a row is an example of: its own group, and its language if that stands in for a small group
    of = F.array_compact(F.array(F.when(~small, own), F.when(pooled & (F.col("_least") < least_group), whole)))
    named = R.stage(sizes.join(by_lang, "_l").select("_l", "_s", grp.alias("grp"), of.alias("_of")), "groups")
    if not named.where("grp = ''").isEmpty():  # and all rows, if they stand in for a language
        named = named.withColumn("_of", F.array_append("_of", F.lit("")))
    rows = R.stage(stats.withColumns({"_l": lang, "_s": source}).join(named, ["_l", "_s"]).drop("_l", "_s"), "vectors")
    blocks = R.stage(rows.select("doc_id", F.explode("_of").alias("grp"), "x").mapInArrow(_packer(search.d), _BLOCK), "blocks")

    # a group has one row at least in the sample, were all of them alike
    upto = R.stage(blocks.groupBy("grp").agg(F.greatest(F.min("least"), (F.lit(float(sample) * _PLACES) / F.sum("n") - 1).cast("long")).alias("upto")), "upto")
    drawn = blocks.select("grp", "x", "place").join(upto, "grp").mapInArrow(_drawer(search.d), "grp string, x array<double>")
    now = R.stage(drawn.groupBy("grp", "x").agg(F.count("*").alias("w")).groupBy("grp").applyInPandas(_starts(search), _ESTIMATE), "estimates")
    finished = []
    while not now.isEmpty():
        after = _step(blocks, now, search)
        finished.append(after.where("done"))
        now = after.where("not done")
    best = functools.reduce(DataFrame.unionByName, finished, now).groupBy("grp").agg(F.min_by(F.struct("mean", "precision"), F.struct("logdet", "start")).alias("e")).select("grp", "e.mean", "e.precision")
    met = rows.drop("_of").join(R.stage(best, "estimates"), "grp")
    schema = ", ".join(f"`{c}` {t}" for c, t in met.dtypes if c not in ("mean", "precision")) + ", distance double"
    return met.mapInArrow(_measurer(search), schema)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed and the statistic vector x for every row."""
    R.ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return texts.mapInArrow(_statistics, _STATS).withColumn("base_failed", failed)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, distance for every row."""
    far = outlier_distances(R.stage(statistics(docs, id_col, text_col, lang_col, source_col), "stats"))
    kept = ~F.col("base_failed") & (F.col("distance") <= chi_square_cutoff(tail, len(FEATURES)))
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
