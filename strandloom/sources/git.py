"""Changed lines: of the current branch, from git on the driver (small data whatever the repository's size), or of diffs in a table.

Messages and the names of base branches are fixed values: users and scripts read them.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AnalysisError, ChangedFile, LineRange
from ..shipping import ship
from .files import display_path, path_key

_BASES = ("origin/HEAD", "origin/main", "origin/master")
_ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}


def _run(directory: str, action: str, *args: str) -> subprocess.CompletedProcess:
    try:
        return subprocess.run(["git", "-C", directory, *args], capture_output=True, check=False)
    except OSError as error:
        raise AnalysisError(f"could not {action}: {error.strerror}") from error


def _output(directory: str, action: str, *args: str) -> bytes:
    done = _run(directory, action, *args)
    if done.returncode:
        raise AnalysisError(f"could not {action}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout


def _text(data: bytes, action: str) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as error:
        raise AnalysisError(f"could not {action}: {error}") from error


def repository_root(directory: str) -> str:
    done = _run(directory, "find git repository", "rev-parse", "--show-toplevel")
    if done.returncode:
        raise AnalysisError("git branch mode requires the current directory to be inside a git repository")
    return _text(done.stdout, "parse git repository root").strip()


def _require_branch(root: str) -> None:
    name = _text(_output(root, "determine current git branch", "rev-parse", "--abbrev-ref", "HEAD"), "determine current git branch")
    if name.strip() == "HEAD":
        raise AnalysisError("git branch mode requires a named local branch, but HEAD is detached")


def _base(root: str) -> str:
    for name in _BASES:
        if not _run(root, "resolve origin base branch", "rev-parse", "--verify", name + "^{commit}").returncode:
            return name
    raise AnalysisError("git branch mode could not resolve origin base branch")


def unquoted(path: str) -> str:
    """A path as git shows it: in quotes with C escapes, or plain with a tab after it if it has blanks."""
    if not path.startswith('"'):
        return path.removesuffix("\t")
    path = path.removesuffix("\t")
    if len(path) < 2 or not path.endswith('"'):
        raise AnalysisError(f"could not parse changed git header: +++ {path}")
    out, body, at = bytearray(), path[1:-1], 0
    while at < len(body):
        if body[at] != "\\":
            out += body[at].encode("utf-8")
            at += 1
            continue
        octal = re.match(r"[0-7]{1,3}", body[at + 1 :])
        if octal and int(octal[0], 8) < 256:
            out.append(int(octal[0], 8))
            at += 1 + len(octal[0])
        elif at + 1 < len(body) and body[at + 1] in _ESCAPES:
            out.append(_ESCAPES[body[at + 1]])
            at += 2
        else:
            raise AnalysisError(f"could not parse changed git header: +++ {path}")
    try:
        return out.decode("utf-8")
    except UnicodeDecodeError as error:
        raise AnalysisError(f"could not parse changed git header: +++ {path}") from error


def hunk_range(header: str) -> LineRange | None:
    """The new side of a hunk header; None for a pure deletion."""
    new = next((t for t in header.split() if t.startswith("+")), None)
    m = re.fullmatch(r"\+(\d+)(?:,(\d+))?", new or "")
    if not m:
        raise AnalysisError(f"could not parse changed git hunk: {header}")
    start, count = int(m[1]), int(m[2] or 1)
    return LineRange(start, start + count - 1) if count else None


def parse_diff(text: str) -> list[tuple[str, LineRange]]:
    """(path, range) of each hunk of a diff without context.

    The lines of a hunk are counted off, so that an added line which looks like a header is not taken for one.
    """
    out: list[tuple[str, LineRange]] = []
    path: str | None = None
    body = 0
    for line in text.split("\n"):
        if body and line[:1] in ("+", "-"):
            body -= 1
        elif line.startswith("+++ "):
            shown = unquoted(line[4:])
            if shown == "/dev/null":
                path = None
            elif shown.startswith("b/"):
                path = shown[2:]
            else:
                raise AnalysisError(f"could not parse changed git header: {line}")
        elif line.startswith("@@ "):
            sizes = re.match(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", line)
            body = sum(int(s) if s is not None else 1 for s in sizes.groups()) if sizes else 0
            found = hunk_range(line)
            if found:
                if path is None:
                    raise AnalysisError("could not parse changed git lines: missing file")
                out.append((path, found))
    return out


def _shown(root: str, directory: str, path: str) -> str | None:
    """How a changed path is shown: relative to the directory if inside, None if it is no regular file now."""
    full = os.path.join(root, path)
    if os.path.islink(full) or not os.path.isfile(full):
        return None
    real, base = os.path.realpath(full), os.path.realpath(directory)
    return display_path(os.path.relpath(real, base) if real.startswith(base + os.sep) else real)


def merged(ranges: list[LineRange]) -> list[LineRange]:
    out: list[LineRange] = []
    for r in sorted(ranges, key=lambda r: (r.start, r.end)):
        if out and r.start <= out[-1].end + 1:
            out[-1] = LineRange(out[-1].start, max(out[-1].end, r.end))
        else:
            out.append(r)
    return out


def line_count(data: bytes) -> int:
    return data.count(b"\n") + bool(data and not data.endswith(b"\n"))


def changed_lines(directory: str) -> list[ChangedFile]:
    """Changed files of the branch against its base with their merged ranges, committed or not, and untracked files."""
    root = repository_root(directory)
    _require_branch(root)
    base = _text(_output(root, "find git merge base", "merge-base", _base(root), "HEAD"), "find git merge base").strip()
    action = "list changed git lines"
    diff = _output(root, action, "diff", "--unified=0", "--no-color", "--no-ext-diff", "--src-prefix=a/", "--dst-prefix=b/", "--diff-filter=ACMRTUXB", base)
    ranges: dict[str, list[LineRange]] = {}
    for path, found in parse_diff(_text(diff, "parse changed git lines")):
        shown = _shown(root, directory, path)
        if shown is not None:
            ranges.setdefault(shown, []).append(found)
    untracked = _output(root, "list untracked git files", "ls-files", "--others", "--exclude-standard", "-z")
    for raw in filter(None, untracked.split(b"\0")):
        path = os.fsdecode(raw)
        shown = _shown(root, directory, path)
        if shown is not None:
            try:
                n = line_count(Path(root, path).read_bytes())
            except OSError as error:
                raise AnalysisError.of_io(shown, "read file", error) from error
            ranges.setdefault(shown, []).extend([LineRange(1, n)] if n else [])
    return [ChangedFile(p, merged(r)) for p, r in sorted(ranges.items())]


def table(spark: SparkSession, changed: list[ChangedFile]) -> DataFrame:
    """(path_key, start, end) for each changed range."""
    return spark.createDataFrame([(path_key(c.path), r.start, r.end) for c in changed for r in c.lines], "path_key string, start int, end int")


def diff_ranges(diffs: DataFrame, column: str = "diff") -> DataFrame:
    """(path_key, start, end) for each hunk of diffs without context, one diff a row; not merged. A null diff has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(path_key(path), r.start, r.end) for text in batch[column] if text is not None for path, r in parse_diff(text)]
            yield pd.DataFrame(found, columns=["path_key", "start", "end"])

    ship(diffs.sparkSession)
    return diffs.select(F.col(column).cast("string").alias(column)).mapInPandas(run, "path_key string, start int, end int")


def untracked_ranges(files: DataFrame) -> DataFrame:
    """(path_key, start, end): all lines of new files (path_key, content binary); a file without lines has none."""
    text = F.col("content").cast("binary")
    feeds = F.length(text) - F.length(F.expr("cast(replace(decode(content, 'ISO-8859-1'), chr(10), '') as string)"))
    last = F.substring(F.expr("decode(content, 'ISO-8859-1')"), -1, 1)
    n = F.when(F.length(text) > 0, feeds + F.when(last == "\n", 0).otherwise(1)).otherwise(0)
    return files.select("path_key", F.lit(1).alias("start"), n.cast("int").alias("end")).where(F.col("end") > 0)
