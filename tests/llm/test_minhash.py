import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandloom.llm import components, minhash


def brute(texts):
    """{id: (set size, smallest reachable id)}; texts: [(id, text)]"""
    sets = defaultdict(list)
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i].append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posting = defaultdict(list)
    flat = [(i, s) for i, own in sets.items() for s in own]
    for n, (_, s) in enumerate(flat):
        for x in s:
            posting[x].append(n)
    for n, (i, s) in enumerate(flat):
        for m, same in Counter(m for x in s for m in posting[x] if m > n).items():
            j, other = flat[m]
            if 100 * same >= 75 * (len(s) + len(other) - same):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: ({len(s) for s in own}, find(i)) for i, own in sets.items()}


def check(frame, texts):
    want = brute([(i, t) for i, t in texts if i is not None])
    rows = frame.collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        sizes, root = want[r["doc_id"]]
        assert r["n_shingles"] in sizes and (r["component_id"], r["kept"]) == (root, root == r["doc_id"]), r


def test_documents(documents, rows):
    check(minhash.near_duplicates(documents), list(rows.items()))


def test_odd_rows(odd):
    check(minhash.near_duplicates(odd), [(r["doc_id"], r["text"]) for r in odd.collect()])


def test_exact_candidates(documents, rows, odd):
    check(minhash.near_duplicates(documents, exact=True), list(rows.items()))
    check(minhash.near_duplicates(odd, exact=True), [(r["doc_id"], r["text"]) for r in odd.collect()])


def test_pairs_at_the_threshold_meet():
    """Of 20,000 pairs at exactly 0.75, of sets of 3 to 350, those that share no band or look too different: 0.1 expected."""
    rng = np.random.default_rng(7)
    sets, n = [], 20_000
    for k in range(n):
        m = int(rng.integers(1, 20) if k % 20 else rng.integers(20, 88))
        union = rng.integers(0, 2**63, 4 * m).astype(np.uint64)
        cut = int(rng.integers(0, m + 1))
        sets += [np.sort(union[: 3 * m + cut]), np.sort(np.concatenate([union[: 3 * m], union[3 * m + cut :]]))]
    some = [s for s in sets if len(s)]
    sig = minhash.signatures(some, minhash.BANDS * minhash.ROWS)
    keys = minhash._band_keys(sig, minhash.BANDS, minhash.ROWS)
    short = sig & np.uint32(255)
    met = (keys[::2] == keys[1::2]).any(axis=1) & ((short[::2] == short[1::2]).mean(axis=1) >= minhash.LEAST_ESTIMATE)
    assert len(met) == n and (~met).sum() <= 2


def test_one_row_of_an_id_stays_whatever_its_columns(spark):
    rows = [(1, "a b c d e f g", {"k": 1}), (1, "a b c d e f g", {"k": 0}), (2, "other words of a text that is long", {"z": 2})]
    got = minhash.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>")).collect()
    assert sorted((r["doc_id"], r["extra"]) for r in got) == [(1, {"k": 0}), (2, {"z": 2})]


def test_no_rows(none):
    assert minhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_near_the_threshold(spark, seed):
    """Edited copies whose mutual likeness lies on both sides of the threshold, in buckets beyond the small size."""
    rng = random.Random(seed)
    out = []
    for group in range(4):
        base = [f"w{group}x{rng.randint(0, 400)}" for _ in range(160)]
        for _ in range(45):
            own = base[:]
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 10**6)}"
            out.append(" ".join(own))
    rng.shuffle(out)
    texts = list(enumerate(out + out[:20]))
    check(minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")), texts)


def test_prefix_pairs_lose_nothing(spark):
    rng = random.Random(9)
    sets = {}
    for k in range(60):
        base = set(rng.sample(range(80), rng.randint(20, 40))) if k % 6 == 0 else set(sets[k - k % 6])
        for _ in range(rng.randint(0, 6)):
            base.discard(rng.choice(sorted(base)))
            base.add(rng.randint(80, 2000))
        sets[k] = frozenset(base)
    rows = [(k, len(s), k % 7, sorted(s)) for k, s in sets.items()]
    got = {(r["a"], r["b"]) for r in minhash._prefix_pairs(spark.createDataFrame(rows, "id long, n int, label long, items array<long>"), 75).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and a % 7 != b % 7 and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert want and want <= got


def test_one_document_of_each_group_stays(spark):
    t = "a b c d e f g h"
    docs = spark.createDataFrame([(3, t, "x"), (1, t, "y"), (1, t, "y"), (2, "other words", "z"), (None, t, "n")], "doc_id long, text string, kept string")
    got = minhash.keep_one_each(docs)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()[2:3] + docs.collect()[3:]))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (11, 10), (10, 12), (1, 2)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(5, 10), 5), 10: 10, 11: 10, 12: 10, **dict.fromkeys(range(100, 141), 100)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_signature_agreement_estimates_likeness():
    import numpy as np

    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**63, 600, dtype=np.uint64)
    a, b = np.sort(np.concatenate([common, rng.integers(0, 2**63, 100, dtype=np.uint64)])), np.sort(np.concatenate([common, rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    sig = minhash.signatures([a, b], 512)
    assert abs((sig[0] == sig[1]).mean() - 0.75) < 0.07
