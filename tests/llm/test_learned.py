"""Language identification, toxicity and the pipeline: held-out accuracy, folds, and odd rows."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from common import DATA

from strandloom.llm import langid, minhash, pii, queries, toxicity

VOWELS = {"aa": "aeo", "bb": "iuy"}


@pytest.fixture(scope="module")
def larger(spark):
    return str(DATA / "sf0.01")


def invented(rng, lang, n):
    return " ".join("".join(rng.choice("klmnprst") + rng.choice(VOWELS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_languages_on_held_out_rows(spark, larger):
    got = langid.identify(spark.read.parquet(f"{larger}/documents.parquet")).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert len(held) > 100 and np.mean(held) >= 0.98


def test_unseen_words_back_off(spark):
    rng = random.Random(1)
    rows = [(k, invented(rng, lang, 20), lang) for k, lang in enumerate(["aa", "bb"] * 60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("lang", "text"))
    fresh = [(k, "zz" + "".join(rng.choice("klmnprst") + rng.choice(VOWELS[lang]) for _ in range(5)), lang) for k, lang in enumerate(["aa", "bb"] * 20)]
    got = langid.predict(model, spark.createDataFrame(fresh, "doc_id long, text string, want string"), ["doc_id", "want"]).collect()
    assert all(r["lang_pred"] == r["want"] for r in got)


def plain_languages(training, texts, longest=langid.LONGEST):
    """[(language, score)] of the texts by the definition, learned from all distinct (lang, text); for small tables."""
    import math
    import unicodedata
    from collections import Counter

    kind = lambda c: unicodedata.category(c)[0]
    low = lambda c: c.lower() if len(c.lower()) == 1 else c

    def words(text):
        out, now = [], ""
        for c in [*map(low, text or ""), " "]:
            if kind(c) in "LM":
                now += c
            else:
                if any(kind(x) == "L" for x in now):
                    out.append(now)
                now = ""
        return out

    def grams(word, n):
        padded = f" {word} "
        found = {e: padded[e - n : e] for e in range(n, len(padded) + 1)}
        return {e: g for e, g in found.items() if g != " "}

    seen = [{} for _ in range(longest + 1)]  # of each length: entry -> language -> count
    totals = [Counter() for _ in range(longest + 1)]
    for lang, text in set(training):
        for w in words(text):
            for n in range(longest + 1):
                for g in [w] if n == 0 else grams(w, n).values():
                    seen[n].setdefault(g, Counter())[lang] += 1
                    totals[n][lang] += 1
    languages = sorted({lang for lang, _ in training})

    def score(n, g, lang):
        total = {k: totals[n][k] + len(seen[n]) for k in languages}
        unseen = langid.UNSEEN - math.log(max(total.values()))
        return (math.log(seen[n][g][lang] / total[lang]) if seen[n][g][lang] else unseen) - unseen

    out = []
    for text in texts:
        own = words(text)
        if not own:
            out.append(("und", 0.0))
            continue
        sums = dict.fromkeys(languages, 0.0)
        for w in own:
            for lang in languages:
                if w in seen[0]:
                    sums[lang] += score(0, w, lang)
                    continue
                for e in range(2, len(w) + 3):
                    n = next((n for n in range(longest, 0, -1) if grams(w, n).get(e) in seen[n]), 0)
                    sums[lang] += score(n, grams(w, n)[e], lang) / (len(w) + 1) if n else 0.0
        best = max(languages, key=lambda k: (round(sums[k], 9), [-ord(c) for c in k]))
        out.append((best, 1 / sum(math.exp((v - sums[best]) / math.sqrt(len(own))) for v in sums.values())))
    return out


def test_predictions_equal_a_plain_version(spark, documents, odd):
    """Each row of the query, with all of the small tables in the sample."""
    for table in (documents, odd.where("length(text) < 10000 or text is null")):
        rows = table.select("doc_id", "lang", "text").collect()
        fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        want = plain_languages([(r["lang"], r["text"]) for r in rows if r["lang"] is not None and r["text"] is not None and not fold(r["doc_id"])], [r["text"] for r in rows])
        got = langid.identify(table)
        key = lambda x: (x[0] is None, x[0] or 0, x[2], x[3])
        ours = sorted(((r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in got.collect()), key=key)
        theirs = sorted(((r["doc_id"], fold(r["doc_id"]), *w) for r, w in zip(rows, want, strict=True)), key=key)
        assert [r[:3] for r in ours] == [r[:3] for r in theirs]
        assert np.allclose([r[3] for r in ours], [r[3] for r in theirs])


@pytest.mark.parametrize("own", ["umuntu ngumuntu ngabantu bonke lapha", None])
def test_a_language_of_one_row_takes_no_others(spark, larger, own):
    """One row of a new language, short or long, all words distinct: the others are predicted as before, it keeps its own."""
    rng = random.Random(14)
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang", "text")
    own = own or " ".join(dict.fromkeys("".join(rng.choice("qwxzjkþ") + rng.choice("ůőıø") for _ in range(3)) for _ in range(80)))
    training = docs.where(~langid.held_out()).select("lang", "text")
    before, after = langid.fit(training), langid.fit(training.unionByName(spark.createDataFrame([("zu", own)], "lang string, text string")))
    of = lambda model: {r["doc_id"]: r["lang_pred"] for r in langid.predict(model, docs, ["doc_id"]).collect()}
    assert after.languages[-1] == "zu" and of(before) == of(after)
    assert langid.predict(after, spark.createDataFrame([(0, own)], "k int, text string"), ["k"]).first()["lang_pred"] == "zu"


def test_copies_change_no_prediction(spark, larger):
    """20,000 copies of one text of a language beside the other rows."""
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang", "text")
    one = docs.where("lang = 'de'").orderBy("doc_id").limit(1)
    copies = one.crossJoin(spark.range(20_000)).select("lang", "text")
    training = docs.where(~langid.held_out()).select("lang", "text").unionByName(one.select("lang", "text"))
    of = lambda rows: {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.predict(langid.fit(rows), docs, ["doc_id"]).collect()}
    assert of(training) == of(training.unionByName(copies))


def test_copies_do_not_empty_the_sample(spark):
    """A frequent language of three texts, each copied often, is learned like any other; so is one of a single text."""
    rng = random.Random(15)
    few = [invented(rng, "aa", 30) for _ in range(3)]
    rows = [("aa", few[k % 3]) for k in range(3000)] + [("bb", invented(rng, "bb", 30)) for _ in range(60)] + [("cc", "qqq www xxx")]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), sample=20)
    got = langid.predict(model, spark.createDataFrame([(k, t) for k, t in enumerate([*few, invented(rng, "bb", 30), "xxx"])], "k int, text string"), ["k"]).collect()
    assert {r["k"]: r["lang_pred"] for r in got} == {0: "aa", 1: "aa", 2: "aa", 3: "bb", 4: "cc"}


def test_shares_of_the_sample():
    got = langid.shares({"a": 10, "b": 10_000, "c": 1000, "d": 50_000}, 1210)
    assert got["a"] == 1 and [round(got[k] * n) for k, n in (("b", 10_000), ("c", 1000), ("d", 50_000))] == [400] * 3


def test_odd_languages(odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] in (0, 1, 2, 7, 8):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in ("en", "de")
    assert langid.identify(none).collect() == []
    assert {r["lang_pred"] for r in langid.identify(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_toxicity_on_held_out_rows(spark):
    sf_dir = str(DATA / "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    caught = np.mean([r["predicted"] for r in got if r["toxic"] == 1])
    wrong = np.mean([r["predicted"] for r in got if r["toxic"] == 0])
    assert caught >= 0.92 and wrong <= 0.005


def test_toxicity_folds_and_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(13)], "doc_id long, toxic int, quality int")
    got = toxicity.classify(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify(none, labels).collect() == []
    assert {r["score"] for r in toxicity.classify(odd, labels.where("toxic = 1")).collect()} == {0.0}


def test_scores_do_not_depend_on_the_sample(spark):
    """A word of all toxic and of some clean texts means the same probability when few clean texts are sampled."""
    rng = random.Random(12)
    words = [invented(rng, "aa", 1) for _ in range(300)]
    rows = []
    for k in range(9000):
        toxic = int(k % 20 == 0)
        text = [rng.choice(words) for _ in range(12)]
        if toxic or rng.random() < 0.06:
            text[5] = "zuzzib"
        rows.append((k, " ".join(text), toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    fixed = spark.createDataFrame([(0, " ".join([*words[:5], "zuzzib", *words[5:11]]))], "doc_id long, text string")

    def of(most):
        model = toxicity.fit(toxicity.labelled(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), most), most)
        return toxicity.score(model, fixed, ["doc_id"]).first()["score"]

    whole = of(24_000)
    assert 0.3 < whole < 0.65 and abs(of(1200) - whole) < 0.17


def test_masked_words_are_read():
    import pyarrow as pa

    part = pa.RecordBatch.from_arrays([pa.array(["you are an !d10t!!", "an id.i.ot", "idiot!", "", None, "price 100$"])], names=["text"])
    h, doc = toxicity._Tokens(part, 0).masked()
    want = toxicity.X.hash_text("idiot")
    assert [int(d) for x, d in zip(h, doc, strict=True) if int(x) == want] == [0, 1]


def test_long_masked_words_are_read():
    import pyarrow as pa

    word = "idiot" * 20
    part = pa.RecordBatch.from_arrays([pa.array(["so " + ".".join(word)])], names=["text"])
    assert int(toxicity._Tokens(part, 0).masked()[0][0]) == toxicity.X.hash_text(word)


def test_labels_repeated(spark):
    """An id with many label rows counts once for each label."""
    rng = random.Random(21)
    docs = spark.createDataFrame([(k, invented(rng, "aa", 10)) for k in range(30)], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(30)]
    few, many = (sorted(toxicity.labelled(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, labels + [(2, 0)] * 500))
    assert few == many


def test_trees_and_calibration():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5) | (x[:, 1] > 1.5)).astype(float)
    trees = toxicity.boost(x[:2000], y[:2000])
    sums = trees.sums(x[2000:])
    assert np.mean((sums > 0) == (y[2000:] == 1)) > 0.97
    knots, values = toxicity.isotonic(sums, y[2000:])
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all() and values.min() >= 0 and values.max() <= 1
    assert abs(np.interp(sums, knots, values).mean() - y[2000:].mean()) < 0.02


def test_isotonic_equals_the_definition():
    """The fit at k is the largest, over starts, of the smallest mean over ends."""
    rng = np.random.default_rng(5)
    s = np.sort(rng.normal(size=40))
    y = (rng.random(40) < 1 / (1 + np.exp(-s))).astype(float)
    knots, values = toxicity.isotonic(s, y)
    padded_y = np.concatenate([[1.0], y, [0.0]])
    want = [max(min(padded_y[a : b + 1].mean() for b in range(k, 42)) for a in range(k + 1)) for k in range(42)]
    got = np.interp(s, knots, values)
    assert np.allclose(got[1:-1], want[2:-2])


# ---- the pipeline ----


def test_pipeline_stages(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, larger).cache()
        assert after.columns == docs.columns and after.schema == docs.schema, name
        ids, kept = ({r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in (docs, after))
        assert set(kept) <= set(ids)
        if name == "toxicity":
            toxic = {r["doc_id"] for r in toxicity.classify(docs, spark.read.parquet(f"{larger}/labels.parquet")).where("predicted = 1").collect()}
            assert set(ids) - set(kept) == toxic and toxic
        elif name == "language":
            gone = {r["doc_id"] for r in langid.identify(docs).where(f"lang_pred = 'und' or score < {langid.LEAST_SCORE}").collect()}
            assert set(ids) - set(kept) == gone
        elif name == "near_duplicates":
            from test_minhash import brute

            assert set(kept) == {i for i, (_, root) in brute(list(ids.items())).items() if i == root}
        else:
            assert set(kept) == set(ids)
            assert all(kept[i] == t or pii.base_spans(t) for i, t in ids.items())
            assert not any(k in ("email", "card", "phone") for t in kept.values() for k, _, _ in pii.base_spans(t))
        docs = after
        n.append(docs.count())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, larger)
    assert packed.select("doc_id").distinct().count() == n[-1] and n[0] > n[1] and n[2] > n[3]


def test_pipeline_of_no_rows(spark, tmp_path, none):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_of_odd_rows(spark, tmp_path, odd):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, k % 2) for k in range(13)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_every_operator_is_registered():
    names = set(queries.queries())
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(queries.oracle_sql()) <= names and minhash.PERCENT == 75
