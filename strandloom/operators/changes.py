"""Changed line ranges: coalescing, and keeping what touches them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesce_ranges(ranges: DataFrame) -> DataFrame:
    """(path_key, start, end): the union of each file's ranges; ranges that overlap or adjoin become one."""
    by_file = Window.partitionBy("path_key").orderBy("start", "end")
    before = F.max("end").over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("opens", (before.isNull() | (F.col("start") > before + 1)).cast("int"))
    grouped = marked.withColumn("island", F.sum("opens").over(by_file))
    return grouped.groupBy("path_key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("path_key", "start", "end")


def range_arrays(ranges: DataFrame) -> DataFrame:
    """(path_key, ranges): each file's ranges in order."""
    return ranges.groupBy("path_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def touching_files(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows whose path_key is that of a changed file."""
    return rows.join(changed.select("path_key").distinct(), "path_key", "left_semi")


def touching_lines(rows: DataFrame, changed: DataFrame, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Rows whose span overlaps a changed range of their own file."""
    return rows.join(changed, (rows["path_key"] == changed["path_key"]) & (rows[start] <= changed["end"]) & (rows[end] >= changed["start"]), "left_semi")


def blocks_touching_files(places: DataFrame, changed: DataFrame, key: str = "block_text") -> DataFrame:
    """All places of the blocks that have a place in a changed file."""
    return places.join(touching_files(places, changed).select(key).distinct(), key, "left_semi")


def blocks_touching_lines(places: DataFrame, changed: DataFrame, key: str = "block_text") -> DataFrame:
    """All places of the blocks that have a place which overlaps a changed range of its file."""
    return places.join(touching_lines(places, changed).select(key).distinct(), key, "left_semi")


def with_ranges(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files with their changed ranges, null where a file has none."""
    return files.join(range_arrays(changed), "path_key", "left")
