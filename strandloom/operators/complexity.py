"""Functions beyond complexity limits: detection over files, the excess, the threshold and the order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import java_cognitive as J, spaces
from ..shipping import ship
from .ranking import with_rank

SCHEMA = "path_key string, function_name string, start_line int, end_line int, cognitive double, cyclomatic double"


def supported(extensions: tuple[str, ...]) -> tuple[str, ...]:
    """The extensions among these whose functions can be measured."""
    return tuple(e for e in extensions if e in spaces.SUPPORTED)


def detect(files: DataFrame) -> DataFrame:
    """All functions of (path_key, extension, content binary); a file is one row, files are dealt to all tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (path, f.name, f.start_line, f.end_line, f.cognitive, f.cyclomatic)
                for path, extension, content in zip(batch["path_key"], batch["extension"], batch["content"], strict=True)
                if content is not None
                for f in spaces.functions(bytes(content), extension)
            ]
            yield pd.DataFrame(rows, columns=["path_key", "function_name", "start_line", "end_line", "cognitive", "cyclomatic"])

    ship(files.sparkSession)
    wanted = files.where(F.col("extension").isin(*spaces.SUPPORTED)).select("path_key", "extension", F.col("content").cast("binary").alias("content"))
    return wanted.mapInPandas(run, SCHEMA)


def excess(max_cognitive: int, max_cyclomatic: int) -> Column:
    over = lambda name, limit: F.greatest(F.col(name) - F.lit(float(limit)), F.lit(0.0))
    return over("cognitive", max_cognitive) + over("cyclomatic", max_cyclomatic)


def over_limits(functions: DataFrame, max_cognitive: int, max_cyclomatic: int) -> DataFrame:
    """Functions with either measure beyond its limit."""
    return functions.where((F.col("cognitive") > max_cognitive) | (F.col("cyclomatic") > max_cyclomatic))


def ranked(functions: DataFrame, max_cognitive: int, max_cyclomatic: int) -> DataFrame:
    """Functions beyond the limits in report order: the largest excess first."""
    over = over_limits(functions, max_cognitive, max_cyclomatic).withColumn("excess", excess(max_cognitive, max_cyclomatic))
    return over.orderBy(*_order())


def numbered(functions: DataFrame, max_cognitive: int, max_cyclomatic: int) -> DataFrame:
    """Functions beyond the limits with their ``excess`` and their ``rank`` in the report."""
    over = over_limits(functions, max_cognitive, max_cyclomatic).withColumn("excess", excess(max_cognitive, max_cyclomatic))
    return with_rank(over, *_order())


def _order() -> list:
    return [F.desc("excess"), *(F.asc(c) for c in ("path_key", "start_line", "end_line", "function_name"))]


@F.pandas_udf(DoubleType())
def java_cognitive(source: pd.Series) -> pd.Series:
    """The cognitive complexity of Java source; null stays null."""
    return source.map(lambda s: None if s is None else J.cognitive(s)).astype("float64")
