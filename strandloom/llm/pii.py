"""Personal data: pattern kinds, and terms that reveal them by corpus co-occurrence.

Patterns find the protected entities (e-mail, IP address, card and phone number). A term near an entity discloses it
when, over the whole corpus, the pointwise mutual information of term and entity reaches a part of the entity's own
information content: who reads the term then knows most of what the entity would tell. Such terms are spans too.

Counts are over distinct texts, so that copies of one text are one witness. The term's count is smoothed by one unseen
text that has it without the entity (``SMOOTHING``), so a single meeting tells less than several; the rule is the same
for rare and for frequent entities. One pass finds entities and the terms around them, and keeps the texts that have
entities; a second pass over all texts counts in how many of them those terms occur. A task gives one row for each
term: its texts, copies within the task left out, and 64 bits that their hashes set (for terms that may have many
texts, the hashes of a share of texts). The sum over tasks is the most texts that a term can have, and too many bits
say that it has more than could disclose; what these leave open is counted text by text. A text that shows the entity has a span at each occurrence of the term, near or far. Rows are known by 128
bits of their id and text.

Work is linear in a text: runs of digits are tried once, and terms meet entities by binary search.

Defined results: a null text is empty and has no spans; rows are independent, repeated rows get the same spans; a null
id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R, textcodes as X

#: Kinds and their patterns, in the order of reports (fixed values).
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What takes the place of a span in sanitised text; terms are generalised to their kind, or removed ("").
REPLACEMENTS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "name": "[NAME]", "number": "[NUMBER]", "term": ""}
#: Terms up to so many words from an entity are looked at.
NEAR = 8
#: A term discloses an entity from this part of the entity's information content on.
DISCLOSURE = 0.8
#: Unseen texts that have a term without the entity.
SMOOTHING = 1.0

_SPAN = "struct<kind:string,start:int,end:int>"
_NEAR = "struct<entity:long,term:long>"
_FOUND = f"row long, row2 long, doc_id long, text_key long, spans array<{_SPAN}>, entities array<long>, near array<{_NEAR}>, text string"
_ROW = ["row", "row2"]


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _holds(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(v) <= 3 and int(v or 0) <= 255 for v in (p.lstrip("0") for p in match.split(".")))
    if kind == "card":
        d = _digits(match)
        return 13 <= len(d) <= 19 and _luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(match)) <= 15
    return True


_COMPILED = {kind: re.compile(p) for kind, p in PATTERNS.items()}
# the same matches without trying a run of digits again from each of its places, or keeping the way through it
_COMPILED["ip"] = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_COMPILED["card"] = re.compile(r"[0-9](?:[\x20-]?[0-9])++")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: by kind as listed, then by start."""
    out = []
    has_digit = any(c in text for c in "0123456789")
    for kind, pattern in _COMPILED.items():
        if kind == "email":
            # a match has an @: look only around those, from where the run before it begins
            if "@" not in text:
                continue
        elif not has_digit or (kind == "phone" and "+" not in text) or (kind == "ip" and "." not in text):
            continue
        for m in pattern.finditer(text) if kind != "email" else _emails(text):
            if _holds(kind, m[0]):
                out.append((kind, m.start(), m.end()))
    return out


_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")


def _emails(text: str):
    """Leftmost matches without trying the pattern at every letter: a match begins where the run before an @ does."""
    done = 0
    for run in _LOCAL.finditer(text):
        begin = max(done, run.start())
        m = _COMPILED["email"].match(text, begin) if begin < run.end() - 1 else None
        if m:
            yield m
            done = m.end()


def _term_kind(term: str) -> str:
    if any(c.isdigit() for c in term):
        return "number"
    return "name" if term[0].isupper() and not term.isupper() else "term"


def _words(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts by code points: starts, ends, and hashes of their lowered form.

    Candidates and counts both come from here. A word is a run of letters, marks and digits, also across an apostrophe
    between two of them.
    """
    codes = X.lower_codes(codes)
    flags = X.is_letter(codes) | ((codes >= 48) & (codes <= 57))
    joint = (codes == 0x27) | (codes == 0x2019)
    joint[1:] &= flags[:-1]
    joint[:-1] &= flags[1:]
    some = offsets[1:] > offsets[:-1]  # an apostrophe at the end of a text joins nothing
    joint[offsets[:-1][some]] = False
    joint[offsets[1:][some] - 1] = False
    codes = np.where(joint, np.uint32(0x27), codes)
    flags |= joint
    start, end = X.spans(flags, offsets)
    return start, end, X.run_hashes(X.code_keys(codes), flags, start, end).view(np.int64)


def _words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _words(codes, np.array([0, len(codes)]))


def _text_key(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _entity(text: str, kind: str, s: int, e: int) -> int:
    value = text[s:e].lower() if kind == "email" else _digits(text[s:e]) if kind != "ip" else text[s:e]
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def _outside(start: np.ndarray, end: np.ndarray, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Which words overlap no entity."""
    free = np.ones(len(start), bool)
    for _, s, e in spans:
        free[np.searchsorted(end, s, "right") : np.searchsorted(start, e)] = False
    return free


def _around(text: str, spans: list[tuple[str, int, int]], entities: np.ndarray, near: int) -> np.ndarray:
    """Distinct (entity, term) within ``near`` words on either side of each entity, for terms outside all entities."""
    first, last, hashes = _words_of(text)
    free = _outside(first, last, spans)
    at = np.array([(s, e) for _, s, e in spans])
    before, after = np.searchsorted(last, at[:, 0], "right"), np.searchsorted(first, at[:, 1])
    step = np.arange(near)
    k = np.concatenate([before[:, None] - 1 - step, after[:, None] + step], axis=1)
    good = (k >= 0) & (k < len(first))
    good[good] = free[k[good]]
    found = np.stack([np.repeat(entities, good.sum(axis=1)), hashes[k[good]]], axis=1)
    return np.unique(found, axis=0) if len(found) else found


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _span_lists(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    flat = [s for own in found for s in own]
    cols = [pa.array([s[k] for s in flat], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
    return _lists([len(own) for own in found], pa.StructArray.from_arrays(cols, ["kind", "start", "end"]))


def _finder(near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in R.pieces_of(batches, most=1 << 21):
            keys, spans, entities, nears, held = [], [], [], [], []
            for text in part.column(3).to_pylist():
                own = base_spans(text) if text else []
                named = np.array([_entity(text, *s) for s in own], np.int64)
                keys.append(None if text is None else _text_key(text.encode("utf-8", "surrogatepass")))
                spans.append(own)
                held.append(text if own else None)
                entities.append(np.unique(named))
                nears.append(_around(text, own, named, near) if own else np.zeros((0, 2), np.int64))
            both = np.concatenate(nears)
            close = _lists([len(x) for x in nears], pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["entity", "term"]))
            told = _lists([len(x) for x in entities], pa.array(np.concatenate(entities)))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(keys, pa.int64()), _span_lists(spans), told, close, pa.array(held, pa.string())], names=["row", "row2", "doc_id", "text_key", "spans", "entities", "near", "text"])

    return run


def _terms_of_texts(batches: Iterator[pa.RecordBatch], terms: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, term, text key) of each slice: each wanted term of each text, once; ``term`` are places in ``names``.

    A text that the task has met before is left out. Every word is wanted if ``terms`` (sorted) is None.
    """
    seen: set[int] = set()
    for part in R.pieces_of(batches):
        data, offsets = R.text_bytes(part.column(0))
        keys, new = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, bool)
        for k in range(part.num_rows):
            key = _text_key(data[offsets[k] : offsets[k + 1]].tobytes())
            keys[k], new[k] = key, key not in seen
            seen.add(key)
        codes, offsets = X.code_points(data, offsets)
        start, _, words = _words(codes, offsets)
        doc = np.searchsorted(offsets, start, "right") - 1
        own = new[doc]
        if terms is None:
            names, at = np.unique(words[own], return_inverse=True)
        else:
            names, at = terms, X.lookup(terms, words)
            own &= at >= 0
            at = at[own]
        at, doc = np.divmod(np.unique(at * part.num_rows + doc[own]), part.num_rows)
        yield names, at, keys[doc]


def _bounder(sent):
    """(term, n, bits): texts that a task (without ``sent``: a slice) meets the term in, and the bits of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda names, n, bits: pa.RecordBatch.from_arrays([pa.array(names[n > 0]), pa.array(n[n > 0]), pa.array(bits[n > 0].view(np.int64))], names=["term", "n", "bits"])
        terms, level = sent.value if sent is not None else (None, None)
        n, bits = (np.zeros(len(terms), np.int64), np.zeros(len(terms), X.U64)) if sent is not None else (None, None)
        for names, at, keys in _terms_of_texts(batches, terms):
            if sent is None:
                n, bits = np.zeros(len(names), np.int64), np.zeros(len(names), X.U64)
            if len(at):  # in the order of terms
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                n[at[first]] += np.diff(np.append(first, len(at)))
                keys = keys.view(X.U64)
                bit = X.U64(1) << (keys & X.U64(63))
                if level is not None:
                    bit[(keys >> X.U64(6)) & ((X.U64(1) << level[at]) - X.U64(1)) != 0] = 0
                bits[at[first]] |= np.bitwise_or.reduceat(bit, first)
            if sent is None:
                yield told(names, n, bits)
        if sent is not None:
            yield told(terms, n, bits)

    return run


def _pairer(sent):
    """(term, text_key) for each text and each wanted term in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, at, keys in _terms_of_texts(batches, sent.value[0] if sent is not None else None):
            yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(keys)], names=["term", "text_key"])

    return run


def _marker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, row2, added): the spans of all words of a text that are among its disclosing terms, outside its entities."""
    for batch in R.pieces_of(batches, most=1 << 21):
        added = []
        for text, terms in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            first, last, hashes = _words_of(text)
            hit = np.flatnonzero(_outside(first, last, base_spans(text)) & np.isin(hashes, terms.values.to_numpy()))
            added.append(sorted((_term_kind(text[a:b]), a, b) for a, b in zip(first[hit].tolist(), last[hit].tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], _span_lists(added)], names=["row", "row2", "added"])


def _row_columns(id_col, text_col) -> dict:
    """128 bits of a row that are the same whenever its id and text are."""
    return {"row": F.xxhash64(id_col, text_col), "row2": F.xxhash64(F.lit(1), id_col, text_col)}


#: Terms are sent to executors up to this number (8 MB); more are found by a join, with the same result.
MOST_SENT_TERMS = 1_000_000


def _met(texts: DataFrame, terms: DataFrame, mapper, schema: str) -> tuple[DataFrame, bool]:
    """What a mapper over all texts gives for the staged ``terms`` (term, level), and whether it knew these."""
    some = texts.where("text is not null").select("text")
    if terms.count() > MOST_SENT_TERMS:
        return some.mapInArrow(mapper(None), schema).join(terms.select("term"), "term", "left_semi"), False
    got = terms.select("term", "level").toArrow()
    order = np.argsort(got["term"].to_numpy())
    sent = texts.sparkSession.sparkContext.broadcast((got["term"].to_numpy()[order], got["level"].to_numpy()[order].astype(X.U64)))
    return some.mapInArrow(mapper(sent), schema), True


#: Of terms with a share of 2**-level, a term at its limit has so many hashes, about; and more bits than this never,
#: for all that matters (a Poisson law of 8 has 40 with probability 1e-15).
_AT_LIMIT, _BEYOND = 8, 40


def _texts_of_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_term): of the staged ``terms`` (term, least, most, level) those in no more texts than ``most``.

    Terms that are surely in no more than ``least`` may have a larger number than theirs, but none beyond ``least``.
    """
    met, levels = _met(texts, terms, _bounder, "term long, n long, bits long")
    bounds = met.groupBy("term").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"))
    shared = F.col("level") > 0 if levels else F.lit(False)
    beyond = F.when(shared, F.bit_count("bits") >= _BEYOND).otherwise(F.bit_count("bits") > F.col("most"))
    kept = R.stage(bounds.join(terms, "term").where(~beyond).select("term", "level", "n", (F.col("n") <= F.col("least")).alias("sure")), "bounds")
    open_ = R.stage(kept.where("not sure").select("term", "level"), "open")
    sure = kept.where("sure").select("term", F.col("n").alias("n_term"))
    if open_.isEmpty():
        return sure
    pairs, _ = _met(texts, open_, _pairer, "term long, text_key long")
    return sure.unionByName(pairs.distinct().groupBy("term").agg(F.count("*").alias("n_term")))


def disclosing(found: DataFrame, texts: DataFrame, disclosure: float, smoothing: float) -> DataFrame:
    """(entity, term) pairs whose mutual information reaches the threshold; counts are exact and over all texts."""
    n = found.where("text_key is not null").select("text_key").distinct().count()
    some = found.where(F.size("entities") > 0)
    entities = some.select("text_key", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    close = some.select("text_key", F.explode("near").alias("x")).select("text_key", "x.entity", "x.term").distinct()
    pairs = close.groupBy("entity", "term").agg(F.count("*").alias("both")).join(entities, "entity").where(F.col("n_entity") < n)
    # log2(both * n / (n_entity * (n_term + smoothing))) >= disclosure * log2(n / n_entity), solved for n_term
    limit = (F.col("both") * F.pow(F.lit(float(n)) / F.col("n_entity"), F.lit(1.0 - disclosure)) - smoothing) * (1 + 1e-12)
    bounded = R.stage(pairs.select("entity", "term", "both", limit.alias("limit")).where("both <= limit"), "bounded")
    level = F.when(F.col("most") < _BEYOND, 0).otherwise(F.ceil(F.log2(F.col("most") / _AT_LIMIT)))
    terms = R.stage(bounded.groupBy("term").agg(F.min("limit").alias("least"), F.max("limit").alias("most")).withColumn("level", level.cast("long")), "terms")
    if terms.isEmpty():
        return R.empty_like(found.sparkSession, "entity long, term long")
    return bounded.join(_texts_of_terms(texts, terms), "term").where("n_term <= limit").select("entity", "term")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    R.ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.withColumns(_row_columns("doc_id", "text")).select("row", "row2", "doc_id", "text")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR, disclosure: float = DISCLOSURE, smoothing: float = SMOOTHING) -> DataFrame:
    """(row, row2, doc_id, spans, added) for every row: base spans, and spans of disclosing terms."""
    texts = _texts(docs, id_col, text_col)
    found = R.stage(texts.mapInArrow(_finder(near), _FOUND), "found")
    reveal = disclosing(found, texts, disclosure, smoothing)
    shown = found.where(F.size("entities") > 0).select(*_ROW, F.explode("entities").alias("entity")).distinct()
    told = R.stage(shown.join(reveal, "entity").groupBy(*_ROW).agg(F.collect_set("term").alias("terms")), "told")
    marked = found.where("text is not null").select(*_ROW, "text").join(told, _ROW).select(*_ROW, "text", "terms").mapInArrow(_marker, f"row long, row2 long, added array<{_SPAN}>")
    added = R.stage(marked.dropDuplicates(_ROW), "added")
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    return found.join(added, _ROW, "left").select(*_ROW, "doc_id", "spans", F.coalesce("added", none).alias("added"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""
    found = find(docs, id_col, text_col, **how)
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    added = F.array_sort(F.transform("added", lambda s: F.struct(s["kind"], s["start"], s["end"])))
    return found.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(shown(F.col("spans")), 256).alias("base_sha256"), F.array_join(F.filter(F.array(shown(F.col("spans")), shown(added)), lambda s: s != ""), ",").alias("spans"))


def _cleaner(replacements: dict[str, str], added_name: str):
    def clean(text: str, spans: list[dict]) -> str:
        out, at = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
            if s["end"] <= at:
                continue
            out.append(text[at : max(at, s["start"])])
            if s["start"] >= at:  # what overlaps the last one is covered by its replacement
                out.append(replacements.get(s["kind"], ""))
            at = s["end"]
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in R.pieces_of(batches, most=1 << 21):
            at, extra = batch.schema.get_field_index("text"), batch.schema.get_field_index(added_name)
            texts = []
            for text, added in zip(batch.column(at).to_pylist(), batch.column(extra).to_pylist(), strict=True):
                spans = [{"kind": k, "start": s, "end": e} for k, s, e in base_spans(text)] + (added or []) if text else []
                texts.append(clean(text, spans) if spans else text)
            cols = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns) if k != extra]
            yield pa.RecordBatch.from_arrays(cols, names=[n for n in batch.schema.names if n != added_name])

    return run


def sanitise(docs: DataFrame, id_col: str = "doc_id", replacements: dict[str, str] | None = None, **how) -> DataFrame:
    """``docs`` with all spans of column ``text`` replaced; other columns stay."""
    row, row2, added = R.fresh(docs, "row"), R.fresh(docs, "row2"), R.fresh(docs, "added")
    spans = find(docs, id_col, "text", **how).where(F.size("added") > 0).select(F.col("row").alias(row), F.col("row2").alias(row2), F.col("added").alias(added))
    spans = R.stage(spans.dropDuplicates([row, row2]), "added")
    keys = _row_columns(F.col(id_col).cast("long"), F.col("text").cast("string"))
    joined = docs.withColumns({row: keys["row"], row2: keys["row2"]}).join(spans, [row, row2], "left").drop(row, row2)
    return joined.mapInArrow(_cleaner(replacements or REPLACEMENTS, added), docs.schema)
