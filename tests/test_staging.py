import pytest

from strandloom import staging


def test_staged_tables(spark):
    first, second = (staging.stage(spark.range(n), "numbers") for n in (3, 4))
    assert first.count() == 3 and staging.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    staging.unstage(first, spark.range(1))
    with pytest.raises(Exception):
        spark.read.parquet(first._staged_at).count()
    assert second.count() == 4
    staging.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(second._staged_at).count()
    assert staging.stage(spark.range(0), "none").count() == 0
