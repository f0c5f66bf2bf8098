"""The command line: parsing in a fixed order of errors, help, version, and the exit status."""

from __future__ import annotations

import sys
from typing import TextIO

from .functions.languages import supported_extensions
from .model import AnalysisError, Config, ReportKind, RunStatus

VERSION = "0.1.0"
NAME = "strandloom"
_REPORTS = {"--report-duplicate": ReportKind.DUPLICATE, "--report-complexity": ReportKind.COMPLEXITY}

HELP = f"""{NAME} - deterministic source code analysis reports.

USAGE:
  {NAME} help
  {NAME} -h
  {NAME} --version
  {NAME} --report-complexity [OPTIONS]
  {NAME} --report-duplicate [OPTIONS]

REPORTS (one is required):
  --report-complexity
      Functions whose cognitive or cyclomatic complexity exceeds a limit.
  --report-duplicate
      Blocks of lines that occur in two or more places.

OPTIONS:
  -file-extension=<extensions>
      Comma-separated extensions to analyze; by default all known ones.
  -files=<paths>
      Comma-separated files to analyze instead of all below the current directory.
  -git-branch
      Only what touches lines changed on the current branch. Not with -files.
  -max-cognitive-complexity=<value>
      Limit of --report-complexity; 15 by default.
  -max-cyclomatic-complexity=<value>
      Limit of --report-complexity; 10 by default.
  -verbose
      Also list analyzed files, timings, and details of blocks.
"""


def parse_extensions(value: str) -> tuple[str, ...]:
    out = []
    for raw in value.split(","):
        ext = raw.strip()
        if not ext:
            raise AnalysisError("file extension values must not be empty")
        if ext.startswith("."):
            raise AnalysisError(f"file extensions must not start with a dot: {ext}")
        if "/" in ext or "\\" in ext:
            raise AnalysisError(f"file extensions must not contain path separators: {ext}")
        out.append("".join(c.lower() if c.isascii() else c for c in ext))
    return tuple(dict.fromkeys(out))


def parse_files(value: str) -> tuple[str, ...]:
    out = tuple(raw.strip() for raw in value.split(","))
    if not all(out):
        raise AnalysisError("file path values must not be empty")
    return out


def parse_limit(value: str) -> int:
    digits = value[1:] if value.startswith("+") else value
    if not (digits.isascii() and digits.isdigit()) or int(digits) >= 2**32:
        raise AnalysisError(f"complexity limits must be positive integers: {value}")
    if not int(digits):
        raise AnalysisError("complexity limits must be greater than zero")
    return int(digits)


_VALUES = {
    "-file-extension=": parse_extensions,
    "-files=": parse_files,
    "-max-cognitive-complexity=": parse_limit,
    "-max-cyclomatic-complexity=": parse_limit,
}
_SWITCHES = ("-verbose", "-git-branch")


def _rejoined(args: list[str]) -> list[str]:
    """Some shells split ``-files=a.ts`` before the dot: glue what begins with one to the file list before it."""
    out: list[str] = []
    for arg in args:
        if arg.startswith(".") and out and out[-1].startswith("-files="):
            out[-1] += arg
        else:
            out.append(arg)
    return out


def parse_args(args: list[str]) -> Config:
    args = _rejoined(list(args))
    for arg in args:
        if arg.startswith("--") and arg not in _REPORTS:
            raise AnalysisError(f"unknown argument: {arg}")
    reports: list[ReportKind] = []
    switches = dict.fromkeys(_SWITCHES, 0)
    values: dict[str, list] = {name: [] for name in _VALUES}
    for arg in args:
        name = next((n for n in _VALUES if arg.startswith(n)), None)
        if arg in _REPORTS:
            reports.append(_REPORTS[arg])
        elif arg in switches:
            switches[arg] += 1
        elif name:
            values[name].append(_VALUES[name](arg[len(name) :]))
        else:
            raise AnalysisError(f"unexpected argument '{arg}' found")
    for name in ("-max-cognitive-complexity=", "-max-cyclomatic-complexity="):
        if len(values[name]) > 1:
            raise AnalysisError(f"the argument '{name}<value>' cannot be used multiple times")
    if not reports:
        raise AnalysisError("no report switch provided; pass --report-duplicate or --report-complexity", show_help=True)
    if len(set(reports)) < len(reports):
        raise AnalysisError("report switch was provided more than once")
    if len(reports) > 1:
        raise AnalysisError("--report-duplicate and --report-complexity are mutually exclusive")
    for count, what in ((switches["-git-branch"], "git branch mode was"), (len(values["-file-extension="]), "file extensions were"), (len(values["-files="]), "explicit files were")):
        if count > 1:
            raise AnalysisError(f"{what} provided more than once")
    if switches["-git-branch"] and values["-files="]:
        raise AnalysisError("git branch mode cannot be combined with explicit files")
    limits = [values["-max-cognitive-complexity="], values["-max-cyclomatic-complexity="]]
    if reports[0] is ReportKind.DUPLICATE and any(limits):
        raise AnalysisError("complexity limits can only be used with --report-complexity")
    first = lambda name, other: values[name][0] if values[name] else other
    return Config(
        report=reports[0],
        verbose=bool(switches["-verbose"]),
        file_extensions=first("-file-extension=", supported_extensions()),
        files=first("-files=", None),
        git_branch=bool(switches["-git-branch"]),
        max_cognitive_complexity=first("-max-cognitive-complexity=", 15),
        max_cyclomatic_complexity=first("-max-cyclomatic-complexity=", 10),
    )


def run(args: list[str], directory: str, out: TextIO, spark=None) -> RunStatus:
    """Help, version or a report; raises :class:`AnalysisError`. Without a session one is made when it is needed."""
    if list(args) in (["help"], ["-h"]):
        out.write(HELP)
        return RunStatus.SUCCESS
    if list(args) == ["--version"]:
        out.write(VERSION + "\n")
        return RunStatus.SUCCESS
    config = parse_args(args)
    from .plans import reports

    if spark is not None:
        return reports.run(spark, config, directory, out)
    from pyspark.sql import SparkSession

    from .staging import clear

    spark = SparkSession.builder.appName(NAME).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        return reports.run(spark, config, directory, out)
    finally:
        clear(spark)


def main() -> int:
    import os

    try:
        return run(sys.argv[1:], os.getcwd(), sys.stdout).value
    except AnalysisError as error:
        sys.stderr.write(f"error: {error.message}\n" + (f"\n{HELP}" if error.show_help else ""))
        return 1
