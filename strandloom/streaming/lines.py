"""Normalized, classified lines of files as they arrive, and how often each line has been seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lines
from ..sources import files


def arriving(spark: SparkSession, path: str, extensions: tuple[str, ...], files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (path_key, extension, idx, line_number, text, is_comparison) of new files below a path in any store. A file that is not UTF-8 is an error."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    named = read.select(F.col("path").alias("path_key"), T.extension(F.col("path")).alias("extension"), "content")
    return lines.classify(lines.explode(files.as_text(named.where(F.col("extension").isin(*extensions)))))


def running_frequency(stream: DataFrame) -> DataFrame:
    """(text, n) over all that has arrived; for output mode update or complete."""
    return lines.frequency(stream)
