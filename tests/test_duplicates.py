from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandloom import queries
from strandloom.operators import duplicates, lines, repeats


def table(spark, files):
    """files: {name: text} or {name: (extension, text)}"""
    rows = [(k, *(v if isinstance(v, tuple) else ("ts", v))) for k, v in files.items()]
    return lines.classify(lines.explode(spark.createDataFrame(rows, "path_key string, extension string, content string")))


def blocks(spark, files):
    places, weights = defaultdict(list), {}
    for r in duplicates.blocks(table(spark, files)).collect():
        text = tuple(r["block_text"].split("\n"))
        places[text].append((r["path_key"], r["start_line"], r["end_line"]))
        weights[text] = r["weight"]
    return {text: sorted(own) for text, own in places.items()}, weights


def brute(files):
    """Each pair of equal comparison lines, grown up and down while lines are equal."""
    kept = {}
    for name, (status, text) in files.items():
        rows = [(n, t.strip()) for n, t in enumerate(text.split("\n"), 1) if t.strip()]
        kept[name] = [(n, t, t not in status) for n, t in rows]
    spots = [(f, i) for f in kept for i in range(len(kept[f]))]
    out = defaultdict(set)
    for x, (fa, ia) in enumerate(spots):
        for fb, ib in spots[x + 1 :]:
            a, b = kept[fa], kept[fb]
            if a[ia][1] != b[ib][1] or not (a[ia][2] and b[ib][2]):
                continue
            up = 0
            while ia - up > 0 and ib - up > 0 and a[ia - up - 1][1] == b[ib - up - 1][1]:
                up += 1
            down = 0
            while ia + down + 1 < len(a) and ib + down + 1 < len(b) and a[ia + down + 1][1] == b[ib + down + 1][1]:
                down += 1
            if fa == fb and ib - up <= ia + down:
                continue
            text = tuple(t for _, t, _ in a[ia - up : ia + down + 1])
            for f, i in ((fa, ia), (fb, ib)):
                out[text].add((f, kept[f][i - up][0], kept[f][i + down][0]))
    return {k: sorted(v) for k, v in out.items() if len(v) > 1}


P, Q, R, S, X, Z = "const pp = one(1);", "const qq = two(2);", "const rr = three(3);", "const ss = four(4);", "const x = 1;", "const z = 26;"


def test_three_places(spark):
    found, _ = blocks(spark, {k: f"{P}\n{Q}" for k in "abc"})
    assert found == {(P, Q): [("a", 1, 2), ("b", 1, 2), ("c", 1, 2)]}


def test_structure_alone_is_no_block(spark):
    assert blocks(spark, {"a": "}", "b": "}"})[0] == {}


def test_structure_lengthens_a_block(spark):
    assert blocks(spark, {"a": f"{P}\n}}\n{Q}", "b": f"{P}\n}}\n{Q}"})[0] == {(P, "}", Q): [("a", 1, 3), ("b", 1, 3)]}


def test_runs_that_overlap_themselves_are_dropped(spark):
    found, _ = blocks(spark, {"a": f"{X}\n{X}\n{X}"})
    assert (X, X) not in found


def test_repeats_within_one_file(spark):
    found, weight = blocks(spark, {"a": "\n".join([X, X, X, Z, X, X])})
    assert found == {(X, X): [("a", 1, 2), ("a", 2, 3), ("a", 5, 6)], (X,): [("a", 1, 1), ("a", 3, 3), ("a", 5, 5), ("a", 6, 6)]}
    assert weight == {(X, X): 96, (X,): 36}


def test_status_goes_by_extension(spark):
    assert blocks(spark, {"a.json": ("json", "}"), "b.json": ("json", "}")})[0] == {("}",): [("a.json", 1, 1), ("b.json", 1, 1)]}
    assert blocks(spark, {"a.json": ("json", "}"), "b.ts": "}"})[0] == {}


def test_parts_are_reported_beside_the_whole(spark):
    found, _ = blocks(spark, {"a": f"{P}\n{Q}\n{R}", "b": f"{P}\n{Q}\n{R}", "c": f"{S}\n{Q}\n{R}"})
    assert found == {(P, Q, R): [("a", 1, 3), ("b", 1, 3)], (Q, R): [("a", 2, 3), ("b", 2, 3), ("c", 2, 3)]}


def test_blocks_span_blank_lines(spark):
    assert blocks(spark, {"a": f"{P}\n\n{Q}", "b": f"{P}\n{Q}"})[0] == {(P, Q): [("a", 1, 3), ("b", 1, 2)]}


def test_empty_and_null_files(spark):
    assert blocks(spark, {"a": "", "b": ("ts", None)})[0] == {}


def test_hot_line_is_salted(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "PLACES_PER_SALT", 4)
    files = {f"f{k:03d}": f"{P}\n{k}\n{Q}" for k in range(30)}
    assert duplicates.seed_pairs(table(spark, files)).count() == 2 * 30 * 29 // 2


def test_order_of_the_report(spark):
    texts = {"a": f"{X}\nonly a\n{P}\n{Q}", "b": f"{X}\nonly b\n{P}\n{Q}"}
    rows = duplicates.numbered(duplicates.summary(duplicates.find(table(spark, texts)))).orderBy("rank").collect()
    assert [(r["rank"], tuple(r["lines"])) for r in rows] == [(1, (P, Q)), (2, (X,))]
    assert [tuple(r["lines"]) for r in duplicates.ranked(duplicates.summary(duplicates.find(table(spark, texts)))).collect()] == [(P, Q), (X,)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([P, Q, X, "}", ""]), max_size=8), min_size=1, max_size=4))
def test_equals_pairwise_expansion(spark, contents):
    files = {f"f{k}": "\n".join(c) for k, c in enumerate(contents)}
    assert blocks(spark, files)[0] == brute({k: (("}",), t) for k, t in files.items()})


@pytest.mark.parametrize("extra", ["text", "idx"])
def test_extra_columns_do_not_matter(spark, extra):
    rows = spark.createDataFrame([("a", "ts", P, 1), ("b", "ts", P, 2)], f"path_key string, extension string, content string, {extra} int")
    assert duplicates.blocks(lines.classify(lines.explode(rows))).count() == 2


def test_copies_stand_for_each_other(spark, monkeypatch):
    """Copies of a file, with blank lines at other places, and a file that shares a part of them."""
    files = {f"c{k}": "\n".join([X, X, "", X, "}", P][: 6 - (k == 9)]) + "\n" * k for k in range(9)}
    files |= {"blank": f"\n{X}\n\n\n{X}\n{X}\n}}\n{P}", "part": f"{Z}\n{X}\n}}\n{P}"}
    assert blocks(spark, files)[0] == brute({k: (("}",), t) for k, t in files.items()})
    seen = []
    monkeypatch.setattr(repeats, "places", lambda own, places=repeats.places: seen.append(own.select("f").distinct().count()) or places(own))
    blocks(spark, files)
    assert seen == [3]


def test_long_runs_of_one_line(spark):
    files = {"a": "\n".join([X] * 37), "b": "\n".join([P] + [X] * 20 + [Q] + [X] * 9), "c": "\n".join([X] * 5 + [P])}
    assert blocks(spark, files)[0] == brute({k: ((), t) for k, t in files.items()})


def test_status_of_mixed_extensions_in_longer_blocks(spark):
    files = {"a.json": ("json", f"}}\n{{\n{P}\n}}"), "b.json": ("json", f"}}\n{{\n{Q}\n}}"), "c.ts": f"}}\n{{\n{P}", "d.ts": f"}}\n{{\n{S}"}
    found, _ = blocks(spark, files)
    assert found == {
        ("}", "{"): [("a.json", 1, 2), ("b.json", 1, 2)], ("}",): [("a.json", 1, 1), ("a.json", 4, 4), ("b.json", 1, 1), ("b.json", 4, 4)],
        ("}", "{", P): [("a.json", 1, 3), ("c.ts", 1, 3)],
    }


def test_work_follows_the_places_of_a_hot_line(spark, monkeypatch):
    """No step holds more rows than a few for each line, though the line's pairs are 180 thousand."""
    files = {f"f{k:04d}": f"let a{k} = 1;\n{P}\nlet b{k} = 2;" for k in range(600)}
    sizes, stage = [], repeats.stage

    def counted(df, name):
        out = stage(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(repeats, "stage", counted)
    found, _ = blocks(spark, files)
    assert [len(v) for v in found.values()] == [600] and max(sizes) <= 600


def lengths_of_pairs(found):
    return {r["n"]: r["count"] for r in duplicates.runs(found).selectExpr("last - first + 1 AS n").groupBy("n").count().collect()}


@pytest.mark.parametrize("files", [
    {"a": "\n".join([X] * 37), "b": "\n".join([P] + [X] * 20 + [Q] + [X] * 9), "c": "\n".join([X] * 5 + [P])},
    {f"c{k}": "\n".join([X, P, X, P, X, "}", P][: 7 - (k > 6)]) for k in range(9)} | {"part": f"{Z}\n{X}\n}}\n{P}", "own": f"{Q}\n{R}\n{Q}\n{R}"},
    {f"{k}.json": ("json", f"}}\n{{\n{P}\n}}") for k in range(3)} | {f"{k}.ts": f"}}\n{{\n{(P, S)[k % 2]}\n}}" for k in range(4)},
    {"a": P, "b": Q, "c": "}", "d": "}"},
], ids=["one line", "copies", "status", "none"])
def test_run_lengths_are_those_of_the_pairs(spark, files):
    found = table(spark, files)
    assert {r["size"]: r["n"] for r in duplicates.run_lengths(found).collect()} == lengths_of_pairs(found)


def test_run_lengths_leave_the_callers_lines(spark):
    found = duplicates.numbered_files(table(spark, {"a": f"{P}\n{Q}", "b": f"{P}\n{Q}"}))
    assert duplicates.run_lengths(found).collect() == [(2, 1)] and found.count() == 4


def test_duplicate_runs_of_a_hot_line_without_its_pairs(spark, monkeypatch, tmp_path):
    texts = [(k, "web", f"let a{k} = 1;\n{P}\nlet b{k} = 2;") for k in range(600)]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("seed_pairs", "runs"):
        monkeypatch.setattr(duplicates, name, lambda *_: pytest.fail("a row for each pair"))
    assert [tuple(r) for r in queries.duplicate_runs(spark, str(tmp_path)).collect()] == [(1, 600 * 599 // 2)]
