import pytest
from pyspark.sql import functions as F

from strandloom.functions import java_cognitive, languages, spaces
from strandloom.functions import text as T
from strandloom.operators import complexity, lines


def status(spark, rows):
    got = spark.createDataFrame(rows, "e string, t string").select(T.is_comparison(F.col("e"), F.col("t"))).collect()
    return [r[0] for r in got]


def test_classification(spark):
    structural = [
        ("rs", ".into_iter()"), ("rs", "assert!("), ("rs", "assert_eq!("), ("rs", ".update()"), ("ts", "} \t);"), ("ts", "// @ts-nocheck"), ("ts", "/* eslint-disable */"),
        ("ts", "errors: DeleteViewsError[]"), ("ts", "__typename: 'DeleteViewsResponse'"), ("yaml", "jobs:"), ("rs", "let mut value ="), ("rs", "use crate::module;"), ("sh", "done"), ("html", "</div>"),
        ("rs", "{\u2003}"),
    ]
    compared = [("rs", ".update()?.await"), ("ts", "const value = computeValue(input);"), ("json", "}"), ("unknown", "});"), ("py", "return x"), ("c", "a}")]
    assert status(spark, structural) == [False] * len(structural)
    assert status(spark, compared) == [True] * len(compared)


def test_registry():
    assert len(languages.LANGUAGES) == 28
    every = [e for x in languages.LANGUAGES for e in x.extensions]
    assert len(every) == len(set(every)) == 49 == len(languages.supported_extensions())


def test_lines_are_trimmed_and_numbered(spark):
    rows = spark.createDataFrame([("a", "ts", "  P  \n\n   }\r\n\tvalue\u2003\n \u00a0\u3000 \n\u200bx\u001c")], "path_key string, extension string, content string")
    got = [(r["idx"], r["line_number"], r["text"]) for r in lines.explode(rows).orderBy("idx").collect()]
    assert got == [(0, 1, "P"), (1, 3, "}"), (2, 4, "value"), (3, 6, "\u200bx\u001c")]


@pytest.mark.parametrize(("path", "shown", "ext"), [("./src/../a.ts", "src/../a.ts", "ts"), (".", ".", ""), ("/x//y.RS", "/x/y.RS", "rs"), ("a.d.ts", "a.d.ts", "ts"), (".ts", ".ts", ""), ("a\\b.js", "a/b.js", "js")])
def test_paths(spark, path, shown, ext):
    row = spark.createDataFrame([(path,)], "p string").select(T.display_path(T.path_key(F.col("p"))), T.extension(F.col("p"))).first()
    assert tuple(row) == (shown, ext)


def test_metrics_and_ranges(spark):
    row = spark.range(1).select(T.metric(F.lit(3.0)), T.metric(F.lit(2.5)), T.range_list(F.expr("array(struct(3 as start, 17 as end), struct(21 as start, 21 as end))"))).first()
    assert tuple(row) == ("3", "2.50", "3-17,21")


@pytest.mark.parametrize(("body", "score"), [
    ("if(a){ {h();} if(b){h();} }", 3), ("if(a) h(); { if(b){h();} }", 2), ("do { if(a){h();} } while(b);", 3), ("return a && b && c;", 1), ("if((a && b)){h();}", 2),
    ("for(int i=0;i<n;i++){ if(a){h();} }", 2), ("for(int i : xs){ if(a){h();} }", 3), ("if(g(a && b)){h();}", 3), ("if(x && (a || b)){h();}", 4), ("if(a){} else if(b){} else {}", 3),
    ("List<?> xs;", 1), ("for(int i=0; a && b; i++){h();}", 3), ('String s = "if (a && b) {"; // if', 0), ("char c = '\\''; /* && */", 0),
])
def test_java_scores(body, score):
    assert java_cognitive.cognitive(f"void f() {{ {body} }}") == score


def test_java_scores_in_a_plan(spark):
    rows = spark.createDataFrame([(1, "if (a) { }"), (2, None), (3, "")], "id int, src string")
    assert [r[0] for r in rows.orderBy("id").select(complexity.java_cognitive("src")).collect()] == [1.0, None, 0.0]


NESTED = b"fn nested(value: i32) -> i32 {\nif value > 10 {\nif value > 20 {\nreturn 20;\n}\nreturn 10;\n}\n0\n}\n"
RISKY = b"fn risky(value: i32) -> i32 {\nif value > 10 {\nreturn 10;\n}\nif value > 5 {\nreturn 5;\n}\n0\n}\n"
JAVA = b"class Sample {\nint risky(int value) {\nif (value > 10 && value < 20) {\nwhile (value > 0) {\nvalue--;\n}\n}\nreturn value;\n}\n}\n"


def test_either_limit_counts(spark):
    files = spark.createDataFrame([("a.rs", "rs", NESTED), ("b.rs", "rs", RISKY), ("c.rb", "rb", b"def x; end")], "path_key string, extension string, content binary")
    found = complexity.detect(files)
    assert [r["function_name"] for r in complexity.ranked(found, 2, 3).collect()] == ["nested"]
    assert [r["function_name"] for r in complexity.ranked(found, 2, 2).where("path_key = 'b.rs'").collect()] == ["risky"]
    spans = {r["function_name"]: (r["start_line"], r["end_line"]) for r in found.collect()}
    assert spans == {"nested": (1, 9), "risky": (1, 9)}


def test_function_forms():
    assert [f.name for f in spaces.functions(JAVA, "java")] == ["risky"]
    assert spaces.functions(JAVA, "java")[0].cognitive == 4
    script = b"export const go = async (a) => {\n if (a) {}\n}\nclass A { run(x) { return x ? 1 : 2 } }\nfunction z() { }\n"
    assert [f.name for f in spaces.functions(script, "ts")] == ["go", "run", "z"]
    assert [f.name for f in spaces.functions(b"int A::go(int a) {\n for (;;) { }\n}\n", "cpp")] == ["A::go"]
    assert [(f.name, f.cyclomatic) for f in spaces.functions(b"def a(x):\n  if x and y:\n    pass\n", "py")] == [("a", 3.0)]
    assert spaces.functions(b"def broken(:", "py") == [] and spaces.functions(b"\xff\xfe{", "rs") == [] and spaces.functions(b"", "java") == []


def test_functions_are_ordered_by_excess(spark):
    rows = [("src/c.rs", "c", 1, 2, 17.0, 8.0), ("src/b.rs", "b", 1, 2, 14.0, 12.0), ("src/a.rs", "a", 1, 2, 16.0, 14.0), ("src/d.rs", "d", 1, 2, 13.0, 13.0), ("src/e.rs", "e", 1, 2, 12.0, 11.0), ("src/f.rs", "f", 1, 2, 10.0, 10.0)]
    got = [r["function_name"] for r in complexity.ranked(spark.createDataFrame(rows, complexity.SCHEMA), 10, 10).collect()]
    assert got == ["a", "c", "b", "d", "e"]
    numbered = complexity.numbered(spark.createDataFrame(rows, complexity.SCHEMA), 10, 10).orderBy("rank").collect()
    assert [(r["rank"], r["function_name"]) for r in numbered] == list(enumerate(got, 1))


#: By the published rules: cognitive (a point for each break of the flow, one more for each level around it, one for each
#: sequence of like operators, an else without levels), cyclomatic (decisions and operators, and one).
_VECTORS = [
    ("ts", "if (a) { x(); }", 1, 2), ("ts", "if (a) { x(); } else { y(); }", 2, 2), ("ts", "if (a) { x(); } else if (b) { y(); } else { z(); }", 3, 3),
    ("ts", "for (let i = 0; i < a; i++) { if (b) { x(); } }", 3, 3), ("ts", "while (a) { while (b) { while (c) { x(); } } }", 6, 4), ("ts", "do { x(); } while (a);", 1, 2), ("ts", "do x(); while (a);", 1, 2), ("ts", "do { if (b) { x(); } } while (a && b); while (c) { y(); }", 5, 5),
    ("ts", "return a && b && c;", 1, 3), ("ts", "return a && b || c;", 2, 3), ("ts", "if (a && b) { x(); }", 2, 3), ("ts", "return a ? 1 : 2;", 1, 2),
    ("ts", "if (a) { return b ? 1 : 2; }", 3, 3), ("ts", "switch (a) { case 1: x(); break; case 2: y(); break; default: z(); }", 1, 3),
    ("ts", "try { x(); } catch (e) { y(); }", 1, 2), ("ts", "for (" + "a(" * 500 + ")" * 500 + "; b; c) { if (d) { x(); } }", 3, 3), ("ts", "x(); y();", 0, 1),
    ("rs", "if a { x(); }", 1, 2), ("rs", "if a { x(); } else { y(); }", 2, 2), ("rs", "if a { x(); } else if b { y(); } else { z(); }", 3, 3), ("rs", "loop { if a { break; } }", 3, 3),
    ("rs", "for i in 0..a { while b { x(); } }", 3, 3), ("rs", "if a && b || c { x(); }", 3, 4), ("rs", "x();", 0, 1),
    ("py", "if a: x()", 1, 2), ("py", "for i in a:\n  if b:\n   x()\n  elif c:\n   y()\n  else:\n   z()", 5, 4), ("py", "while a:\n  x()\n else:\n  y()", 2, 2),
    ("py", "try:\n  x()\n except E:\n  if a: y()", 3, 3), ("py", "return a and b and c", 1, 3), ("py", "return a and b or c", 2, 3), ("py", "return x if a else y", 1, 2),
    ("py", "return lambda y: 1 if y else 2", 2, 2), ("py", "x()", 0, 1),
]


@pytest.mark.parametrize("extension, body, cognitive, cyclomatic", _VECTORS)
def test_measures_follow_the_published_rules(extension, body, cognitive, cyclomatic):
    wrap = {"ts": "function f(a, b, c) {\n%s\n}", "rs": "fn f(a: bool, b: bool, c: bool) {\n%s\n}", "py": "def f(a, b, c):\n %s\n"}[extension]
    assert [(f.cognitive, f.cyclomatic) for f in spaces.functions((wrap % body).encode(), extension)] == [(cognitive, cyclomatic)]
