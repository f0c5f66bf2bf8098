"""Licenses, quality, fingerprints, personal data, pieces and chat against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from common import same_rows

from strandloom.llm import chat, licenses, oracles, pieces, pii, quality, queries, spotsigs

MODEL = P.path("piece_bpe_32k.model")
FOLD = {c: c + 32 for c in range(65, 91)}


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


# ---- licenses ----

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def license_row(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))
    at = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_license_base(request, table):
    frame = request.getfixturevalue(table)
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(frame).collect())
    assert got == Counter((i, *license_row(t)) for i, t in pairs(frame))


def test_license_places(spark):
    texts = ["CC BY NC cc-by-nc", "under the MIT licence under, the. mit LICENSE apache license version 2 cc by nc", "cc by cc by nc nc", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_base"], r["first_word"], r["last_word"]) for r in got] == [(2, 0, 3), (3, 4, 12), (1, 2, 2), (0, None, None)]
    assert [r["labels"] for r in got] == ["cc-by-nc", "apache-2,cc-by-nc,mit", "cc-by-nc", "mit"] and got[3]["score"] >= 0.75


def test_automaton_statistics():
    rng = random.Random(2)
    for _ in range(60):
        sequences = [[rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(4)]
        machine = licenses.SuffixAutomaton(sequences)
        stream = [rng.randrange(5) for _ in range(30)]
        runs = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        for at, (state, length) in enumerate(machine.statistics(stream), 1):
            assert length == max((n for n in range(1, at + 1) if tuple(stream[at - n : at]) in runs), default=0)
            if length:
                want = sorted({(k, e) for k, s in enumerate(sequences) for e in range(length, len(s) + 1) if s[e - length : e] == stream[at - length : at]})
                assert machine.ends[state] == want


def test_license_spans_are_chained(spark):
    text = "x Permission is hereby granted free of charge to any person (sic) obtaining a copy of this software and associated documentation files y"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["labels"] == "mit" and [(s["start"], s["end"]) for s in r["spans"] if s["label"] == "mit"] == [(1, 22)]


# ---- quality ----


def quality_row(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    often = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_every_notice_of_a_text_is_a_span(spark):
    notice = "licensed under the gnu affero general public license"
    filler = " ".join(f"x{k}" for k in range(80))
    mit = next(t for t, label in licenses.TEMPLATES.items() if label == "mit" and len(t) > 500)
    texts = [f"{notice} {filler} {notice}", f"{notice} {notice} {filler}", f"{filler} {mit.replace('EXPRESS OR IMPLIED', 'of some other sort')} {filler}", f"{notice} " * 3000]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    at = lambda k: [(s["label"], s["start"], s["end"]) for s in sorted(got[k]["spans"], key=lambda s: s["start"])]
    assert at(0) == [("agpl", 0, 8), ("agpl", 88, 96)] and at(1) == [("agpl", 0, 8), ("agpl", 8, 16)] and len(at(3)) == 3000
    assert "mit" in got[2]["labels"].split(",") and any(a <= 100 and b >= 200 for _, a, b in at(2))


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_quality_base(request, table):
    frame = request.getfixturevalue(table)
    rows = quality.quality(frame).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in rows) == Counter((i, *quality_row(t)) for i, t in pairs(frame))
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_outliers_of_a_group(spark):
    rng = np.random.default_rng(4)
    d = len(quality.FEATURES)
    clean, far = rng.normal(0, 1, (400, d)), rng.normal(30, 1, (60, d))
    rows = [(k, "en", "s", x.tolist()) for k, x in enumerate(np.concatenate([clean, far]))]
    got = {r["doc_id"]: r["distance"] for r in quality.outlier_distances(spark.createDataFrame(rows, "doc_id long, lang string, source string, x array<double>")).collect()}
    cutoff = quality.chi_square_cutoff(1e-6, d)
    assert max(got[k] for k in range(400)) < 4 * cutoff < min(got[k] for k in range(400, 460))


@pytest.mark.parametrize("seed", range(4))
def test_the_smallest_determinant_is_found(seed):
    """All ways to keep nine of twelve rows, against the search."""
    from itertools import combinations

    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (9, 2)), rng.normal(5, 3, (3, 2))])
    search = quality.Determinant((0.1, 0.2), 0.75)
    grow = search.grow
    best = min(np.linalg.slogdet(grow * np.cov(x[list(k)].T, bias=True) + np.diag([0.01, 0.04]))[1] for k in combinations(range(12), 9))
    got = search.search(x, np.ones(12))
    assert abs(got[0][0] - best) < 1e-9


def test_distances_equal_a_plain_search(spark):
    """Groups of several sizes through the DataFrame, against all ways to keep rows (small) or a plain search on all rows."""
    from itertools import combinations

    rng = np.random.default_rng(9)
    floor = (0.1, 0.2, 0.3)
    search = quality.Determinant(floor, 0.75)
    groups = {"a": np.concatenate([rng.normal(0, 1, (9, 3)), rng.normal(4, 1, (3, 3))]), "b": rng.normal(2, 1, (12, 3)).round(0), "c": np.concatenate([rng.normal(0, 1, (2500, 3)), rng.normal(6, 1, (500, 3))])}
    rows = [(i, "en", g, v.tolist()) for g, x in groups.items() for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, source string, x array<double>")
    got = {(r["source"], r["doc_id"]): r["distance"] for r in quality.outlier_distances(frame, floor=floor, least_group=10, sample=400).collect()}
    assert len(got) == len(rows)
    for g, x in groups.items():
        if len(x) == 12:
            keep = min(combinations(range(12), 9), key=lambda k: round(np.linalg.slogdet(search.grow * np.cov(x[list(k)].T, bias=True) + np.diag(search.floor))[1], 12))
            mean, cov = x[list(keep)].mean(0), search.grow * np.cov(x[list(keep)].T, bias=True) + np.diag(search.floor)
            precision, near = np.linalg.inv(cov), 1e-6
        else:
            _, mean, precision = search.search(x, np.ones(len(x)))[0]
            near = 0.03  # from another sample the search may end in another minimum close by
        if g != "b":  # equal rows count in part there
            want = ((x - mean) @ precision * (x - mean)).sum(1)
            assert np.allclose([got[g, i] for i in range(len(x))], want, rtol=near, atol=near)


@pytest.mark.parametrize("bound", [5000, 7])
def test_steps_keep_exactly_the_closest_rows(spark, monkeypatch, bound):
    """However often the class at the quantile is divided, and with many rows at the quantile itself."""
    monkeypatch.setattr(quality, "SORTED", bound)
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(0, 1, (700, 2)), np.repeat(rng.normal(0, 1, (3, 2)), 100, axis=0)])
    search = quality.Determinant((0.1, 0.1), 0.75)
    at = search.of(x[:5], np.ones(5))
    now = spark.createDataFrame([("g", 0, at[1].tolist(), at[2].ravel().tolist(), 99.0, 0.3, 0.9, False)], quality._ESTIMATE)
    rows = spark.createDataFrame([(k, "g", v.tolist()) for k, v in enumerate(x)], "doc_id long, grp string, x array<double>")
    got = quality._step(rows.mapInArrow(quality._packer(2), quality._BLOCK), now, search).first()
    want = search.step(x, np.ones(len(x)), at[1], at[2])
    assert abs(got["logdet"] - want[0]) < 1e-9 and np.allclose(got["mean"], want[1]) and np.allclose(got["precision"], want[2].ravel())


def test_many_equal_rows_of_a_group(spark):
    rows = [(None, "en", "s", [1.0] * 10)] * 3000 + [(1, "en", "s", [9.0] * 10)]
    got = quality.outlier_distances(spark.createDataFrame(rows, "doc_id long, lang string, source string, x array<double>")).collect()
    assert len(got) == 3001 and max(r["distance"] for r in got if r["doc_id"] is None) < 1e-9 and max(r["distance"] for r in got) > 100


def test_small_groups_are_held_against_the_whole(spark):
    """Few rows of a source against their language, few rows of a language against all; the rest as without them."""
    rng = np.random.default_rng(6)
    d = len(quality.FEATURES)
    rows = [(k, "en", "s", x.tolist()) for k, x in enumerate(rng.normal(0, 1, (300, d)))]
    rows += [(300 + k, "en", "few", x.tolist()) for k, x in enumerate([*rng.normal(30, 1, (20, d)), *rng.normal(0, 1, (5, d))])]
    rows += [(400, "xx", "one", [30.0] * d), (401, "yy", None, [0.0] * d), (402, None, "s", [-30.0] * d)]
    far = lambda some: {r["doc_id"]: r["distance"] for r in quality.outlier_distances(spark.createDataFrame(some, "doc_id long, lang string, source string, x array<double>")).collect()}
    got, alone = far(rows), far(rows[:300])
    cutoff = quality.chi_square_cutoff(1e-6, d)
    assert len(got) == len(rows) and all(abs(got[k] - alone[k]) < 1e-6 * (1 + alone[k]) for k in range(300))
    assert min(got[k] for k in [*range(300, 320), 400, 402]) > 4 * cutoff > max(got[k] for k in [*range(320, 325), 401])


def test_altered_texts_are_outliers(spark):
    """All capitals, symbols and gibberish among ordinary texts."""
    rng = random.Random(16)
    words = ["".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    plain = [" ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", "."]) for _ in range(rng.randint(80, 300))) for _ in range(200)]
    changes = [
        str.upper,
        lambda t: " ".join(w + " |" * (k % 4 == 0) for k, w in enumerate(t.split())),
        lambda t: "".join(rng.choice("bcdfghjklmnpqrst") if c.isalpha() else c for c in t),
    ]
    texts = plain + [change(plain[k]) for change in changes for k in range(5)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(docs).collect()}
    assert sum(kept[k] for k in range(200)) >= 198 and not any(kept[k] for k in range(200, 215))


def test_chi_square():
    assert abs(quality.chi_square_cutoff(0.05, 1) - 3.841) < 1e-2 and abs(quality.chi_square_cutoff(0.01, 9) - 21.666) < 1e-2
    assert abs(quality.chi_square_tail(16.919, 9) - 0.05) < 1e-4


def test_no_quality_rows(none):
    assert quality.quality(none).collect() == []


# ---- fingerprints ----


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_edited_texts(request, table):
    frame = request.getfixturevalue(table)
    order = sorted(pairs(frame), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in order]
    sets = [spotsigs.signature_sets(pa.array([t]))[0] for t in texts]
    want = Counter()
    for k, (i, _) in enumerate(order):
        text, follow = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        changed = text[: len(text) - half] + follow[:half]
        own = spotsigs.signature_sets(pa.array([changed]))[0]
        alike = lambda a, b: len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist())) if len(a) or len(b) else 1.0
        want[(i, len(text), hashlib.sha256(changed.encode()).hexdigest(), spotsigs.written(sets[k]), spotsigs.written(own), round(alike(sets[k], own), 9), round(alike(sets[k], sets[(k + 1) % len(texts)]), 9))] += 1
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in spotsigs.edited_likeness(frame).collect())
    assert got == want


def test_one_row_follows_itself(spark):
    r = spotsigs.edited_likeness(spark.createDataFrame([(4, "the cat sat down")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"the cat the cat ").hexdigest() and r["near_next"] == 1.0


def test_signatures():
    a, b, c, d, e = spotsigs.signature_sets(pa.array(["the big cat sat", "THE big, cat; sat.", "big cat sat", "", None]))
    assert len(a) == 1 and a.tolist() == b.tolist() and len(c) == 1 and c.tolist() != a.tolist() and len(d) == len(e) == 0
    assert spotsigs.read(spotsigs.written(a)).tolist() == a.tolist()


def test_similar_fingerprints(documents):
    prints = spotsigs.fingerprints(documents)
    sets = {r["doc_id"]: frozenset(r["spots"]) for r in prints.collect()}
    members, found = spotsigs.similar_pairs(prints, 0.5)
    classes = {r["doc_id"]: r["class_id"] for r in members.collect()}
    assert all(sets[i] == sets[c] for i, c in classes.items()) and len(classes) == len(sets)
    heads = sorted(i for i in set(classes.values()) if sets[i])
    want = {(a, b) for x, a in enumerate(heads) for b in heads[x + 1 :] if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in found.collect()} == want


def test_partners_of_fingerprints(spark, small, documents):
    sets = {r["doc_id"]: frozenset(r["spots"]) for r in spotsigs.fingerprints(documents).collect()}
    got = {r["doc_id"]: (r["class_id"], r["n_similar"]) for r in queries.similar_fingerprints(spark, small).collect()}
    heads = {c for c, _ in got.values() if sets[c]}
    for i, (c, n) in got.items():
        assert sets[i] == sets[c] and n == sum(4 * len(sets[c] & sets[h]) >= 3 * len(sets[c] | sets[h]) for h in heads if h != c and sets[c])


# ---- personal data ----


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in pii.PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(p) > 400 or int(p) > 255 for p in m[0].split(".")):
                continue
            if (kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))) or (kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    bits = ["a", "@", ".", "-", "x.y", "1", "0", "4111111111111111", " ", "+", "(", ")", "255", "256", "é", "@mail.com", "%", "\n", "99", "+1 (499) 555-6503"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_personal_data(request, table):
    frame = request.getfixturevalue(table)
    want = Counter()
    for i, t in pairs(frame):
        s = plain_spans(t or "")
        want[(i, *(sum(k == kind for k, _, _ in s) for kind in pii.PATTERNS), hashlib.sha256(",".join("%s:%d:%d" % x for x in s).encode()).hexdigest())] += 1
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.digests(frame).collect())
    assert got == want


def test_disclosing_terms(spark):
    """A term that only ever stands by one entity reveals it; common words and other texts are left alone."""
    filler = ["alpha beta the of", "gamma the delta of", "epsilon of the zeta"]
    texts = [f"{filler[k % 3]} Zorblatt writes the mail zz.top@mail.example.com of {k}" for k in range(4)]
    texts += [f"the mail of some writes {k} {filler[k % 3]}" for k in range(60)]
    texts += [f"other{k}@mail.example.com writes the mail number {k}" for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.digests(docs).collect()}
    for k in range(4):
        at = texts[k].index("Zorblatt")
        assert f"name:{at}:{at + 8}" in found[k] and "term:" not in found[k]
    assert all(found[k] == "" for k in range(4, 64)) and all("name" not in found[k] and "term" not in found[k] for k in range(64, 72))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "[NAME] writes the mail [EMAIL] of 0" in clean[0] and clean[30] == texts[30]


@pytest.mark.parametrize("name", ["O'Brien", "D’Angelo", "Ame\u0301lie", "ΣΤΕΦΑΝΟΣ", "İpek", "कविता"])
def test_names_disclose_however_they_are_written(spark, name):
    """Candidates and counts have the same words: apostrophes, marks and letters that lower in an unusual way."""
    texts = [f"the {name} writes {k} to zz.top@mail.example.com" for k in range(4)] + [f"the other writes {k} to some" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["added"]] for r in pii.find(docs).collect()}
    assert all(found[k] == ([name] if k < 4 else []) for k in range(64))


def test_rare_terms_disclose_an_entity_of_one_text(spark):
    """Ordinary letters, each with an address and a name of its own: no value repeats."""
    rng = random.Random(13)
    words = ["the", "of", "and", "to", "in", "mail", "writes", "some", "letter", "house"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    names = ["".join(rng.choice("bdgklmn") + rng.choice("aeiou") for _ in range(4)).title() for _ in range(20)]
    texts = [f"{some(5)} {n} {some(2)} box{k}@mail.example.com {some(9)}" for k, n in enumerate(names)] + [f"{some(12)} {k}" for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["added"]] for r in pii.find(docs).collect()}
    assert len(set(names)) == 20 and all(found[k] == ([names[k]] if k < 20 else []) for k in range(420))


def test_disclosing_terms_are_marked_everywhere_in_a_text(spark):
    """Also beyond NEAR words, and in a text that shows the entity with other terms around it."""
    gap = "the of and to in " * 5
    texts = [f"Zorblatt writes to zz.top@mail.example.com {gap} of {k} Zorblatt" for k in range(4)]
    texts += [f"mail to zz.top@mail.example.com {gap} {gap} Zorblatt"] + [f"the writes {k} to mail of {gap}" for k in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["added"]] for r in pii.find(docs).collect()}
    assert all(found[k] == ["Zorblatt"] * (2 if k < 4 else k == 4) for k in range(85))
    assert not any("Zorblatt" in r["text"] for r in pii.sanitise(docs).collect())


def test_many_terms_are_joined(spark, documents, monkeypatch):
    """The way for more terms than are sent gives the same spans."""
    want = sorted(pii.digests(documents).collect())
    monkeypatch.setattr(pii, "MOST_SENT_TERMS", 0)
    assert sorted(pii.digests(documents).collect()) == want and any("term:" in r["spans"] or "name:" in r["spans"] for r in want)


def test_copies_in_other_tasks_are_one_text(spark):
    """A name of one text that many tasks have copies of still discloses; a name of many different texts does not."""
    texts = ["the Zorblatt writes to zz.top@mail.example.com"] * 120 + [f"the Miller writes of {k} and {k + 7}" for k in range(200)] + ["to Miller writes a.b@mail.example.com"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40, "doc_id")
    found = {r["doc_id"]: {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["added"]} for r in pii.find(docs).collect()}
    assert all("Zorblatt" in found[k] for k in range(120)) and not any("Miller" in v for v in found.values())


def test_long_texts_take_linear_time(spark):
    """A million digits, and 100,000 addresses in one text, each with terms around it."""
    import time

    began = time.perf_counter()
    for text, n in (("7" * 1_000_000, 0), ("1." * 500_000, 125_000), ("1 " * 500_000, 0), ("+1" + "(" * 500_000, 0), ("a" * 500_000 + "@" + "b" * 500_000, 0)):
        assert len(pii.base_spans(text)) == n
    text = " ".join(f"w{k % 997} p{k}@mail.com" for k in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "some other text"), (3, "one more")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_email"] for r in pii.digests(docs).collect()} == {1: 100_000, 2: 0, 3: 0}
    assert time.perf_counter() - began < 60


def test_sanitised_rows_keep_their_columns(odd, none):
    got = pii.sanitise(odd)
    assert got.schema == odd.schema and got.count() == odd.count()
    text = next(t for i, t in pairs(got) if i == 11)
    assert text == "mail me: [EMAIL] or [PHONE], [CARD], [IP]"
    assert pii.sanitise(none).collect() == [] and pii.digests(none).collect() == []


# ---- pieces ----


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_are_the_library_s(library):
    rng = random.Random(6)
    own = pieces.transducer(MODEL)
    for _ in range(3000):
        text = "".join(rng.choice([" ", "  ", "     ", "a", "th", "ing", "e", "1", ".", "www", "\n", "\t", "é", "ß", "日", "😀", "́", "▁", "</s>"]) for _ in range(rng.randint(0, 14)))
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text) and own.decode(ids) == text.replace("▁", " ")


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_piece_digests(request, table, library):
    frame = request.getfixturevalue(table)
    got = Counter((r["doc_id"], r["n_pieces"], r["ids_crc32"], r["round_trip"]) for r in pieces.digests(frame, MODEL).collect())
    want = Counter()
    for i, t in pairs(frame):
        ids = library.encode(t or "")
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)] += 1
    assert got == want


def test_normaliser_by_runs_and_by_steps():
    rng = random.Random(3)
    for prefix in (False, True):
        for squeeze in (False, True):
            machine = pieces.Normaliser(prefix, squeeze)
            for _ in range(300):
                text = "".join(rng.choice(["a", " ", "  ", "é", "\n", "▁"]) for _ in range(rng.randint(0, 9)))
                assert machine(text) == machine.steps(text)


def test_paths_are_the_shortest(tmp_path):
    """All ways through small lattices, with pieces of random weights and with merges."""
    from functools import cache

    rng = random.Random(4)
    for merges in (False, True):
        names = list(dict.fromkeys(["a", "b", "c", *("".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(14))]))
        model = pieces.ModelFile([("<unk>", 0.0, 2), *[(f"<0x{k:02X}>", 0.0, 6) for k in range(256)], *[(p, -float(k) if merges else -rng.random() * len(p), 1) for k, p in enumerate(names)]], merges, True, False, False)
        machine = pieces.Transducer(model)
        score = dict(zip(names, (s for p, s, kind in model.pieces if kind == 1)))

        @cache
        def ways(text):
            return [()] if not text else [(p, *rest) for p in [*names, *({text[0]} - set(names))] if text.startswith(p) for rest in ways(text[len(p) :])]

        for _ in range(150):
            text = "".join(rng.choice("aabbccd") for _ in range(rng.randint(1, 9)))
            got = tuple(chr(~i) if i < 0 else model.pieces[i][0] for i in machine.shortest_path(text))
            if merges:  # the best neighbouring pair is merged again and again
                assert got == tuple(machine._merged(text))
            else:
                cost = lambda way: sum(-score[p] if p in score else 1e6 for p in way)
                assert abs(cost(got) - min(map(cost, ways(text)))) < 1e-6


def test_piece_round_trip(odd):
    back = pieces.decode(pieces.encode(odd, MODEL), MODEL)
    assert sorted(map(str, pairs(back))) == sorted(map(str, pairs(odd)))


def test_unigram_weights():
    """The cheapest path of a unigram model, against every segmentation."""
    scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -2.2, "aba": -5.1, "bb": -9.0}
    model = pieces.ModelFile([("<unk>", 0.0, 2), *((p, s, 1) for p, s in scores.items())], merges=False, byte_fallback=False, dummy_prefix=False, squeeze_blanks=False)
    machine = pieces.Transducer(model)

    def best(text):
        if not text:
            return 0.0
        return max((scores[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in scores), default=-1e9)

    for text in ("a", "abab", "bbaab", "ababba"):
        path = machine.shortest_path(text)
        assert "".join(model.pieces[i][0] for i in path) == text and abs(sum(model.pieces[i][1] for i in path) - best(text)) < 1e-9
    assert machine.shortest_path("axb") == [machine.ids["a"], ~ord("x"), machine.ids["b"]]


# ---- chat ----


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, duck, small, name):
    assert same_rows(queries.queries()[name](spark, small), duck.execute(queries.oracle_sql()[name]))


def test_chat_reads_back_what_it_wrote():
    rng = random.Random(7)
    template = chat.Template()
    bits = ["\\", "### ", "</turn>", "</turn>\n", ": ", "\n", "a", "User", "=", "é", "#", "</turn"]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "", "User", "x: y", "tool\\", "=user"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(1, 4))]
        writer, reader, got = chat.Formatter(template), chat.Reader(template), []
        for role, text in turns:
            for segment in writer.turn(role, text):
                read = reader.feed(segment)
                if read:
                    got.append(read)
        assert got == [(r, t, t if r == "assistant" else "") for r, t in turns]


@pytest.mark.parametrize(("roles", "valid"), [("ua", True), ("sua", True), ("u", True), ("a", False), ("uu", False), ("us", False), ("s", False), ("uau", True), ("ux", False)])
def test_turn_order(roles, valid):
    writer = chat.Formatter(chat.Template())
    for r in roles:
        writer.turn({"u": "user", "a": "assistant", "s": "system", "x": "tool"}[r], "t")
    assert writer.valid is valid


def test_odd_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "user", None, 5), (1, 0, None, "x", 5), (1, 1, "assistant", "y", 5), (None, 0, "user", "z", 5), (2, None, "assistant", "", 5), (1, 1, "assistant", "y", 5)], "conv_id long, turn long, role string, text string, valid int")
    got = {r["conv_id"]: r for r in chat.format_digests(rows).collect()}
    turns = [("", "x"), ("user", ""), ("assistant", "y"), ("assistant", "y")]
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["valid"], got[None]["n_turns"], got[2]["loss_chars"]) == (4, 2, False, 1, 0)
    segments = chat.format_segments(rows).where("conv_id = 1 and loss").collect()
    assert [s["text"] for s in segments] == ["y", "y"]
    assert chat.format_digests(rows.limit(0)).collect() == [] and chat.format_segments(rows.limit(0)).collect() == []


# ---- shared text code ----


@pytest.mark.parametrize("block", [1, 7, 64])
def test_words_do_not_depend_on_blocks(monkeypatch, block):
    from strandloom.llm import runtime, textcodes

    rng = random.Random(block)
    array = pa.array(["".join(rng.choice("ab é \n\t.X") for _ in range(rng.randint(0, 60))) for _ in range(30)] + [None])
    data, offsets = runtime.text_bytes(array)
    for kind in ("blank", "alnum"):
        want = textcodes.words(data, offsets, kind, fold=True)
        monkeypatch.setattr(textcodes, "BLOCK", block)
        got = textcodes.words(data, offsets, kind, fold=True)
        monkeypatch.undo()
        assert (want.hash == got.hash).all() and len(want.hash)
        pattern = r"[^\x20\x09-\x0D]+" if kind == "blank" else "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
        flat = [w for t in array.to_pylist() for w in re.findall(pattern, (t or "").translate(FOLD))]
        assert len(flat) == len(got.hash) and len(set(flat)) == len(set(got.hash.tolist()))


def test_slices_of_nulls_and_views():
    from strandloom.llm import runtime

    array = pa.array(["ab", None, "", "éx", None, "tail"]).slice(1, 4)
    data, offsets = runtime.text_bytes(array)
    assert bytes(data).decode() == "éx" and offsets.tolist() == [0, 0, 0, 3, 3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), array], names=["doc_id", "text"])
    assert [p.num_rows for p in runtime.cut(batch, "text", 1)] == [2, 1, 1] or sum(p.num_rows for p in runtime.cut(batch, "text", 1)) == 4


def test_empty_tables(none):
    assert spotsigs.edited_likeness(none).collect() == [] and licenses.scan(none).collect() == []
    assert pieces.digests(none, MODEL).collect() == [] and pieces.encode(none, MODEL).collect() == []
    members, found = spotsigs.similar_pairs(spotsigs.fingerprints(none))
    assert members.collect() == [] and found.collect() == []


def test_odd_fingerprints(odd):
    members, found = spotsigs.similar_pairs(spotsigs.fingerprints(odd))
    assert members.count() == odd.count()
    assert all(r["a"] is None or r["a"] < r["b"] for r in found.collect())


def test_disclosure_equals_the_definition(spark):
    """Every pair of entity and near term, by counts over distinct texts."""
    import math

    rng = random.Random(11)
    common, rare = ["the", "of", "and", "to", "in"], [f"t{k}" for k in range(40)]
    texts = []
    for k in range(260):
        words = [rng.choice(common if rng.random() < 0.6 else rare[: 6 + k % 30]) for _ in range(14)]
        if k % 3 == 0:
            at = rng.randint(0, 14)
            words[at:at] = [f"p{k % 9}@mail.com", f"z{k % 9 if rng.random() < 0.7 else rng.randint(0, 8)}"]
        elif k % 5 == 0:
            words.append(f"z{rng.randint(0, 8)}")
        texts.append(" ".join(words))
    texts += texts[:40]
    near, by_entity, by_term = {}, {}, {}
    for text in set(texts):
        for w in set(text.split()):
            by_term.setdefault(w, set()).add(text)
        for _, s, e in plain_spans(text):
            before, after = text[:s].split()[-pii.NEAR :], text[e:].split()[: pii.NEAR]
            by_entity.setdefault(text[s:e], set()).add(text)
            for w in {*before, *after}:
                near.setdefault((text[s:e], w), set()).add(text)
    n = len(set(texts))
    want = set()
    for (entity, w), both in near.items():
        info = math.log2(n / len(by_entity[entity]))
        if info > 0 and math.log2(len(both) * n / (len(by_entity[entity]) * (len(by_term[w]) + 0.5))) >= 0.45 * info:
            want.add((entity, w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = set()
    for r in pii.find(docs, disclosure=0.45, smoothing=0.5).collect():
        text = texts[r["doc_id"]]
        for s in r["added"]:
            entity = next(text[b["start"] : b["end"]] for b in r["spans"])
            got.add((entity, text[s["start"] : s["end"]]))
    assert got == want and len(want) > 3
