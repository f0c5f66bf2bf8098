import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import packing

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def check(frame, texts, library, capacity):
    """texts: [(id, text)]. Every id is placed once, sequences are gapless and full enough."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    rows = frame.collect()
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want, total = defaultdict(list), 0
    for doc, text in texts:
        ids = [*library(text or ""), 0]
        total += len(ids)
        begin, piece = 0, 0
        while begin < len(ids):
            end = begin + ((len(ids) - begin) % capacity or capacity)
            want[doc].append((piece, begin, end - begin, zlib.crc32(np.array(ids[begin:end], "<u4").tobytes())))
            begin, piece = end, piece + 1
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


def test_documents(documents, rows, library):
    used, least = check(packing.pack(documents, PATH, P.PATTERN), list(rows.items()), library, 2048)
    assert used <= least + 1


def test_odd_rows(odd, library):
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(packing.pack(odd, PATH, P.PATTERN, capacity=300), texts, library, 300)


def test_special_tokens_and_repeated_rows(spark, library):
    """Added tokens in texts have their ids; equal rows of one id are placed each, in several salts."""
    texts = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), *[(3, "the same row again")] * 500]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert library("a <|endoftext|> b") == [64, 220, 50256, 275]
    check(packing.pack(frame, PATH, P.PATTERN, capacity=30), texts, library, 30)
    pieces = spark.createDataFrame([(k, 5 + k % 3) for k in range(1000)], "_at long, length long")
    rows = packing.place(pieces, 16, per_salt=10).collect()
    taken = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert len(taken) == 1000 and all(x[1] == (0 if y is None or y[0] != x[0] else y[1] + y[2]) for y, x in zip([None, *taken], taken))


def test_no_rows(none):
    assert packing.pack(none, PATH, P.PATTERN).collect() == []


def test_ids_are_the_library_s(library):
    rng = random.Random(1)
    own = packing.encoder(PATH, P.PATTERN)
    for _ in range(400):
        text = "".join(rng.choice(["a", " ", "  ", "\n", "é", "日", "😀", "'s", "123", "the", "<|endoftext|>", " ", "\x00", "ß"]) for _ in range(rng.randint(0, 30)))
        assert own.ids(text).tolist() == library(text)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=25))
def test_plan_holds_every_piece(histogram):
    patterns = packing.plan(histogram, 60)
    got = defaultdict(int)
    for n, items in patterns:
        assert n > 0 and sum(x * k for x, k in items) <= 60
        assert sum(k for x, k in items if x > 20) <= 2
        for x, k in items:
            got[x] += n * k
    assert dict(got) == {x: n for x, n in histogram.items() if n}
    total, large = sum(x * n for x, n in histogram.items()), sum(n for x, n in histogram.items() if x > 30)
    assert sum(n for n, _ in patterns) <= max(1.5 * max(-(-total // 60), large), 1) + 1


def test_plan_is_small_and_tight():
    rng = random.Random(3)
    histogram = {x: rng.randint(1, 10**9) for x in range(1, 2049)}
    patterns = packing.plan(histogram, 2048)
    total = sum(x * n for x, n in histogram.items())
    assert sum(n for n, _ in patterns) <= 1.02 * total / 2048
    assert len(packing.slots(patterns)) < 60_000
