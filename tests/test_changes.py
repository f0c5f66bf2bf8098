from pyspark.sql import functions as F

from strandloom.operators import changes


def ranges(spark, rows):
    return spark.createDataFrame(rows, "path_key string, start int, end int")


def test_ranges_that_adjoin_become_one(spark):
    got = changes.coalesce_ranges(ranges(spark, [("a", 3, 3), ("a", 1, 2), ("a", 7, 7), ("b", 1, 9), ("b", 2, 3), ("b", 10, 11)]))
    assert sorted(map(tuple, got.collect())) == [("a", 1, 3), ("a", 7, 7), ("b", 1, 11)]


def test_equal_ranges_open_one_island_in_any_order(spark):
    rows = [(f"f{k}", s, s + n) for k in range(3) for s, n in ((5, 0), (5, 0), (5, 4), (9, 1), (9, 1), (20, 0), (20, 0), (21, k), (40, 2))] * 50
    expected = [(f"f{k}", s, e) for k in range(3) for s, e in ((5, 10), (20, 21 + k), (40, 42))]
    for seed in range(3):
        got = changes.coalesce_ranges(ranges(spark, rows).orderBy(F.rand(seed)).repartition(7))
        assert sorted(map(tuple, got.collect())) == expected


def test_touching(spark):
    spans = spark.createDataFrame([("a", 1, 9), ("b", 1, 9)], "path_key string, start_line int, end_line int")
    assert changes.touching_lines(spans, ranges(spark, [("a", 10, 10)])).count() == 0
    assert changes.touching_lines(spans, ranges(spark, [("a", 9, 10), ("a", 1, 1)])).count() == 1
    assert changes.touching_files(spans, ranges(spark, [("b", 100, 100)])).collect()[0]["path_key"] == "b"


def test_ranges_beside_files(spark):
    files = spark.createDataFrame([("a",), ("b",)], "path_key string")
    got = {r["path_key"]: r["ranges"] for r in changes.with_ranges(files, ranges(spark, [("a", 5, 6), ("a", 1, 2)])).collect()}
    assert [tuple(r) for r in got["a"]] == [(1, 2), (5, 6)] and got["b"] is None
