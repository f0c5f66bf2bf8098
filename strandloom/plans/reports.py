"""The two reports: plans over files, and their text, written row by row as the sorted result comes in."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TextIO

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import AnalysisError, ChangedFile, Config, LineRange, ReportKind, RunStatus, SourceFile
from ..operators import changes, complexity, duplicates, lines
from ..sources import files, git
from ..staging import stage


def show_ranges(ranges: list[LineRange]) -> str:
    return ",".join(str(r.start) if r.start == r.end else f"{r.start}-{r.end}" for r in ranges)


def show_file(path: str, ranges: list[LineRange] | None) -> str:
    path = files.path_key(path)
    return f"{path} ({show_ranges(ranges)})" if ranges else path


def show_metric(value: float) -> str:
    return f"{value:.0f}" if abs(value - int(value)) < 2.220446049250313e-16 else f"{value:.2f}"


def show_duration(seconds: float) -> str:
    micros = int(seconds * 1_000_000)
    return f"{micros // 1000}.{micros % 1000:03d} ms"


@dataclass
class Header:
    analyzed: list[SourceFile]
    extensions: tuple[str, ...]
    changed: list[ChangedFile] | None = None
    timings: list[tuple[str, float]] = field(default_factory=list)

    def file_lines(self) -> list[str]:
        ranges = {c.path: c.lines for c in self.changed or ()}
        return ["Files analyzed:", *(f"- {show_file(f.display_path, ranges.get(f.display_path))}" for f in self.analyzed)]

    def timing_lines(self) -> list[str]:
        return ["Timings:", *(f"- {name}: {show_duration(s)}" for name, s in self.timings)]


def _timed(header: Header, name: str, work: Callable):
    began = time.perf_counter()
    out = work()
    header.timings.append((name, time.perf_counter() - began))
    return out


def duplicate_blocks(contents: DataFrame, changed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, places) of (path_key, extension, content), each by ``rank`` in the report.

    With ``changed``, the blocks that have a place which touches its ranges. Places are rows of their own, so a block
    may have any number of them.
    """
    found = duplicates.find(lines.classify(lines.explode(contents)))
    kept = duplicates.summary(found)
    if changed is not None:
        kept = kept.join(changes.touching_lines(found.places, changed).select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    blocks = stage(duplicates.numbered(kept).drop("block_text"), "blocks")
    places = found.places.join(blocks.select("k1", "k2", "rank"), ["k1", "k2"]).select("rank", "path_key", "start_line", "end_line")
    return blocks, places


def complex_functions(contents: DataFrame, max_cognitive: int, max_cyclomatic: int, changed: DataFrame | None = None) -> DataFrame:
    """Functions beyond the limits in report order; with ``changed``, those that touch its ranges."""
    found = complexity.detect(contents)
    return complexity.numbered(found if changed is None else changes.touching_lines(found, changed), max_cognitive, max_cyclomatic)


def _write(out: TextIO, text: list[str]) -> None:
    out.write("".join(line + "\n" for line in text))


def duplicate_header(header: Header, blocks: int, verbose: bool) -> list[str]:
    text = ["Duplicate Code Report", "=====================", "", f"Number of files analyzed: {len(header.analyzed)}"]
    if verbose:
        text += [*header.file_lines(), f"Analyzed extensions: {', '.join(sorted(header.extensions))}"]
    text.append(f"Duplicate blocks found: {blocks}")
    return text + header.timing_lines() if verbose else text


def duplicate_text(blocks: DataFrame, places: DataFrame, verbose: bool) -> DataFrame:
    """(rank, at, path_key, start_line, end_line, line): the lines of each block of the report, a place in its own row."""
    shown = F.array(F.lit(""), F.format_string("#%d", "rank"))
    if verbose:
        facts = F.array(F.format_string("Weight: %d", "weight"), F.format_string("Lines: %d", F.size("lines")), F.format_string("Occurrences: %d", "n_places"), F.lit(""), F.lit("Code:"))
        shown = F.concat(shown, facts, F.transform("lines", lambda x: F.concat(F.lit("  "), x)), F.array(F.lit(""), F.lit("Locations:")))
    head = blocks.select("rank", F.posexplode(shown).alias("at", "line")).select("rank", "at", F.lit("").alias("path_key"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), "line")
    own = places.select("rank", F.lit(2**31 - 1).alias("at"), "path_key", "start_line", "end_line", F.format_string("- %s:%d-%d", "path_key", "start_line", "end_line").alias("line"))
    return head.unionByName(own)


def complexity_header(header: Header, functions: int, config: Config) -> list[str]:
    text = ["Complexity Report", "=================", "", f"Number of files analyzed: {len(header.analyzed)}"]
    if config.verbose:
        text += [
            *header.file_lines(), f"Analyzed extensions: {', '.join(sorted(header.extensions))}",
            f"Max cognitive complexity: {config.max_cognitive_complexity}", f"Max cyclomatic complexity: {config.max_cyclomatic_complexity}",
        ]
    text.append(f"Functions exceeding limits: {functions}")
    return text + header.timing_lines() if config.verbose else text


def complexity_text(functions: DataFrame) -> DataFrame:
    """(rank, at, line): the lines of each function of the report; rows are formatted where they are."""
    shown = F.array(
        F.lit(""), F.format_string("#%d", "rank"), F.concat(F.lit("Function: "), "function_name"), F.format_string("Location: %s:%d-%d", "path_key", "start_line", "end_line"),
        F.concat(F.lit("Cognitive complexity: "), T.metric(F.col("cognitive"))), F.concat(F.lit("Cyclomatic complexity: "), T.metric(F.col("cyclomatic"))),
    )
    return functions.select("rank", F.posexplode(shown).alias("at", "line"))


def _spark_errors(work: Callable):
    """The engine's own message of an error raised in a plan."""
    try:
        return work()
    except PySparkException as error:
        text = str(error)
        at = text.find("could not read ")
        raise AnalysisError(text[at:].split("\n")[0].split(" SQLSTATE")[0] if at >= 0 else text.split("\n")[0]) from error


def run(spark: SparkSession, config: Config, directory: str, out: TextIO) -> RunStatus:
    """Make the report of a configuration over a directory and write it; the status says whether it found anything."""
    changed = git.changed_lines(directory) if config.git_branch else None
    scope = git.table(spark, changed) if changed is not None else None
    is_duplicate = config.report is ReportKind.DUPLICATE
    extensions = config.file_extensions if is_duplicate else complexity.supported(config.file_extensions)
    header = Header([], extensions, changed)
    # duplicates of changed lines may be anywhere; functions of changed lines are in the changed files
    named = config.files if is_duplicate or changed is None else tuple(c.path for c in changed)
    found = _timed(header, "Discovery", lambda: files.discover(directory, extensions, named))
    contents = files.table(spark, found)
    if is_duplicate:
        touched = None if changed is None else {c.path for c in changed}
        header.analyzed = [f for f in found if touched is None or f.display_path in touched]
        texts = files.as_text(contents).persist()
        try:
            _timed(header, "File processing", lambda: _spark_errors(texts.count))
            blocks, places = _timed(header, "Duplicate detection", lambda: _spark_errors(lambda: duplicate_blocks(texts, scope)))
            n = blocks.count()
            _write(out, duplicate_header(header, n, config.verbose))
            for row in duplicate_text(blocks, places, config.verbose).orderBy("rank", "at", "path_key", "start_line", "end_line").toLocalIterator():
                _write(out, [row["line"]])
        finally:
            texts.unpersist()
    else:
        header.analyzed = found
        result = _timed(header, "Complexity analysis", lambda: _spark_errors(lambda: stage(complex_functions(contents, config.max_cognitive_complexity, config.max_cyclomatic_complexity, scope), "functions")))
        n = result.count()
        _write(out, complexity_header(header, n, config))
        for row in complexity_text(result).orderBy("rank", "at").toLocalIterator():
            _write(out, [row["line"]])
    return RunStatus.from_issue_count(n)
