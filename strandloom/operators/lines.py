"""Files or documents to normalized lines with a dense index, and what is counted on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def of_documents(documents: DataFrame, extension: Column | str = "rs") -> DataFrame:
    """(path_key, extension, content) of a document table: one row is one file."""
    ext = F.lit(extension) if isinstance(extension, str) else extension
    return documents.select(F.printf(F.lit("%s/%08d"), "source", "doc_id").alias("path_key"), ext.alias("extension"), F.col("text").alias("content"))


def explode(files: DataFrame) -> DataFrame:
    """(path_key, extension, idx, line_number, text) for each line that is not blank.

    Lines end at line feeds only; ``line_number`` counts all lines from 1, ``idx`` the kept ones from 0. Both are
    taken within the file's array, so there is no shuffle. A null content has no lines.
    """
    numbered = F.transform(F.split("content", "\n", -1), lambda x, i: F.struct((i + 1).alias("line_number"), T.normalized(x).alias("text")))
    kept = files.select("path_key", "extension", F.posexplode(F.filter(numbered, lambda r: r["text"] != "")).alias("idx", "line"))
    return kept.select("path_key", "extension", "idx", "line.line_number", "line.text")


def classify(lines: DataFrame) -> DataFrame:
    """Lines with ``is_comparison``."""
    return lines.withColumn("is_comparison", T.is_comparison(F.col("extension"), F.col("text")))


def frequency(lines: DataFrame) -> DataFrame:
    """(text, n): how often each line occurs."""
    return lines.groupBy("text").agg(F.count("*").alias("n"))


def repeated(lines: DataFrame) -> DataFrame:
    """Lines that occur more than once."""
    return frequency(lines).where("n > 1")
