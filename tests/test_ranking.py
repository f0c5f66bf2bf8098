import pytest
from pyspark.sql import functions as F

from strandloom.operators.ranking import with_rank


def test_ranks_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.col("id").alias("_at"), F.lit(1).alias("_range"))
    got = with_rank(rows, F.desc("x")).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 1001)) and all(r["rank"] == 1000 - r["x"] for r in got)
    assert set(got[0].asDict()) == {"x", "_at", "_range", "rank"}
    assert with_rank(rows.limit(0), F.desc("x")).collect() == []


def test_a_rank_overwrites_nothing(spark):
    with pytest.raises(ValueError):
        with_rank(spark.range(3).withColumnRenamed("id", "Rank"), F.asc("Rank"))
