"""Language identification by words first, backing off to ever shorter character n-grams.

A word that the model knows scores its log frequency in each language. An unknown word, padded with a boundary on
either side, is walked character by character: each place scores the longest known n-gram that ends there, from five
characters down to one, and the word has the mean of its places. A text's language has the highest sum; its score is
that language's share after a softmax over sums divided by the square root of the number of words.

Frequencies are shares of all that a language's sample shows plus the number of distinct entries that the languages
show together, so that few training words make none of them likely; what a language has not shown scores the same in
every language, less than anything shown. Scores are kept as gains over that common floor, only for the languages
that show an entry, so a model is as large as its sample however many languages there are.

The model is counted, without further limits, from a bounded sample of the distinct training texts: ``SAMPLE`` of them,
shared out so that small languages are whole and large ones alike. A text is drawn by its hash, so the draw depends on
neither order nor copies; each language has one text at least. Prediction is one pass over whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is any text if there is no
training row; ties go to the language that sorts first; repeated rows get the same result and train once; null ids are
not held out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime as R, textcodes as X

#: Distinct training texts, about (one more for each language at most): the bound of the sample the classifier is fitted on.
SAMPLE = 12_000
LONGEST = 5
#: Log frequency of what a language has not shown, below the rarest of the largest language.
UNSEEN = -2.0
UNDETERMINED = "und"

_EDGE = 0x20


@dataclass
class Table:
    """Entries of one kind: sorted hashes, and the languages that show each with their gains over the floor."""

    keys: np.ndarray
    first: np.ndarray  # of each entry: its place in the next two, and one more for the end
    lang: np.ndarray
    gain: np.ndarray

    def add(self, out: np.ndarray, at: np.ndarray, doc: np.ndarray, weight: np.ndarray | None = None) -> None:
        """To ``out`` (texts, languages): the gains of the entries ``at``, each for its text."""
        many = self.first[at + 1] - self.first[at]
        which = np.repeat(self.first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        gain = self.gain[which] if weight is None else self.gain[which] * np.repeat(weight, many)
        out += np.bincount(np.repeat(doc, many) * out.shape[1] + self.lang[which], weights=gain, minlength=out.size).reshape(out.shape)


@dataclass
class Model:
    languages: list[str]
    tables: list[Table]  # words, then n-grams by length


def _letters(part: pa.RecordBatch, column: int):
    data, offsets = R.text_bytes(part.column(column))
    codes, offsets = X.code_points(data, offsets)
    codes = X.lower_codes(codes)
    flags = X.is_letter(codes)
    start, end = X.spans(flags, offsets)
    if X.is_mark(codes).any():  # marks alone are no word
        base = np.concatenate([[0], np.cumsum(flags & ~X.is_mark(codes))])
        some = base[end] > base[start]
        start, end = start[some], end[some]
        flags = np.zeros(len(codes), bool)
        flags[np.repeat(start, end - start) + _within(end - start)] = True
    doc = np.searchsorted(offsets, start, "right") - 1
    return codes, flags, start, end, doc


def _within(size: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n in turn."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _padded(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a boundary before and after: their codes, the word of each place, the place within the word."""
    size = end - start + 2
    first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - first[word]
    at = start[word] + place - 1
    inner = (place > 0) & (place < size[word] - 1)
    out = np.full(len(word), _EDGE, np.uint32)
    out[inner] = codes[at[inner]]
    return out, word, place


def _gram_hashes(padded: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each place where one fits into its word, and those places."""
    keys = X.code_keys(padded)
    ends = np.flatnonzero(place >= n - 1)
    total = np.zeros(len(ends), X.U64)
    for k in range(n):
        total += keys[ends - k] * X.U64(X._window_key(k))
    return X.mix64(total + X.U64(n)), ends


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, count) of sampled texts, summed within each slice; n = 0: whole words."""
    for part in R.pieces_of(batches):
        codes, flags, start, end, doc = _letters(part, 1)
        langs = part.column(0).to_pylist()
        names = sorted(set(langs))
        lang = np.array([names.index(v) for v in langs])[doc] if len(doc) else np.zeros(0, np.int64)
        padded, word, place = _padded(codes, start, end)
        for n in range(LONGEST + 1):  # the arrays of one length at a time
            if n == 0:
                h, of = X.run_hashes(X.code_keys(codes), flags, start, end), lang
            else:
                h, ends = _gram_hashes(padded, place, n)
                if n == 1:  # a boundary alone says nothing
                    inner = padded[ends] != _EDGE
                    h, ends = h[inner], ends[inner]
                of = lang[word[ends]]
            for k, name in enumerate(names):
                grams, counts = np.unique(h[of == k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array([n] * len(grams), pa.int32()), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["lang", "n", "gram", "c"],
                )


def shares(sizes: dict[str, int], sample: int) -> dict[str, float]:
    """The part of each language's texts that is drawn: small languages whole, the others down to one common number."""
    left, out = sample, {}
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        own = min(n, left / (len(sizes) - k))
        left -= own
        out[lang] = own / n
    return out


def fit(training: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from rows (lang, text); None if no row has both."""
    spark = training.sparkSession
    R.ship(spark)
    rows = training.where("lang is not null and text is not null").select("lang", "text")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    distinct = rows.select("lang", F.xxhash64("text").alias("key"), place.alias("place")).distinct()
    sizes = {r["lang"]: (r["n"], r["least"]) for r in distinct.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")).collect()}  # one row for each language
    if not sizes:
        return None
    share = shares({k: n for k, (n, _) in sizes.items()}, sample)
    upto = spark.createDataFrame([(k, max(least, int(share[k] * (1 << 40)) - 1)) for k, (_, least) in sizes.items()], "lang string, upto long")
    chosen = rows.join(F.broadcast(upto), "lang").where(place <= F.col("upto"))
    counts = chosen.select("lang", "text").distinct().mapInArrow(_counter, "lang string, n int, gram long, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    got = counts.toArrow()  # what the sample shows
    languages = sorted(sizes)
    lang = np.array(pc.index_in(got["lang"], pa.array(languages)).to_pylist(), np.int64)
    size, gram, count = (got[c].to_numpy() for c in ("n", "gram", "c"))
    tables = []
    for n in range(LONGEST + 1):
        own = size == n
        keys, where = np.unique(gram[own].view(X.U64), return_inverse=True)
        of, c = lang[own], count[own].astype(float)
        total = np.bincount(of, weights=c, minlength=len(languages)) + len(keys)
        order = np.lexsort((of, where))
        gain = np.log(c / total[of]) - (UNSEEN - np.log(total.max())) if len(c) else c
        tables.append(Table(keys, np.searchsorted(where[order], np.arange(len(keys) + 1)), of[order].astype(np.int32), gain[order]))
    return Model(languages, tables)


def score_texts(model: Model, codes: np.ndarray, flags: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Log scores (texts, languages) of words, over what a word unknown to a language would score."""
    out = np.zeros((docs, len(model.languages)))
    if not len(start):
        return out
    at = X.lookup(model.tables[0].keys, X.run_hashes(X.code_keys(codes), flags, start, end))
    known = at >= 0
    model.tables[0].add(out, at[known], doc[known])
    rest = np.flatnonzero(~known)
    if not len(rest):
        return out
    padded, word, place = _padded(codes, start[rest], end[rest])
    # as many places score as a word has characters and a boundary; a known word scores once, so an unknown one has the mean
    weight = 1.0 / ((end - start)[rest] + 1)
    todo = place > 0  # the first boundary has no n-gram of its own
    for n in range(LONGEST, 0, -1):
        h, ends = _gram_hashes(padded, place, n)
        keep = todo[ends]
        h, ends = h[keep], ends[keep]
        at = X.lookup(model.tables[n].keys, h)
        hit = at >= 0
        own = word[ends[hit]]
        model.tables[n].add(out, at[hit], doc[rest[own]], weight[own])
        todo[ends[hit]] = False
    return out


def _judge(model: Model | None, part: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of column ``text``."""
    docs = part.num_rows
    if model is None:
        return [UNDETERMINED] * docs, np.zeros(docs)
    codes, flags, start, end, doc = _letters(part, part.schema.get_field_index("text"))
    n = np.bincount(doc, minlength=docs)
    sums = score_texts(model, codes, flags, start, end, doc, docs)
    best = sums.argmax(axis=1)
    sharp = (sums - sums.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(1, n))[:, None]
    score = np.where(n > 0, 1.0 / np.exp(sharp).sum(axis=1), 0.0)
    return [model.languages[b] if m else UNDETERMINED for b, m in zip(best, n, strict=True)], score


def _predictor(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in R.pieces_of(batches):
            lang, score = _judge(sent.value, part)
            names = [x for x in part.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def _filter(sent, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in R.pieces_of(batches):
            lang, score = _judge(sent.value, part)
            yield part.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return run


#: Below this score no language is clearly ahead.
LEAST_SCORE = 0.4


def keep_identified(model: Model | None, docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns; all rows if there is no model."""
    R.ship(docs.sparkSession)
    if model is None:
        return docs
    return docs.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(model), least), docs.schema)


def predict(model: Model | None, docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` plus lang_pred and score, from the text alone."""
    spark = docs.sparkSession
    R.ship(spark)
    sent = spark.sparkContext.broadcast(model)
    narrow = docs.select(*keep, F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in narrow.dtypes if c != "text") + ", lang_pred string, score double"
    return narrow.mapInArrow(_predictor(sent), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that training never sees: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> Model | None:
    """A model from the rows of documents that are not held out."""
    return fit(docs.where(~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trained on the rows that are not held out, applied to all."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(fit_documents(docs), marked, ["doc_id", "held_out"])
