"""Small driver-side values: errors, configuration, report headers. Everything that grows is a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path


class AnalysisError(Exception):
    """An error with a message for the user; ``show_help`` asks for the help text after it."""

    def __init__(self, message: str, show_help: bool = False):
        super().__init__(message)
        self.message = message
        self.show_help = show_help

    @classmethod
    def of_io(cls, path: str | Path, action: str, error: Exception) -> AnalysisError:
        reason = getattr(error, "strerror", None) or str(error)
        return cls(f"could not {action} {str(path).replace(chr(92), '/')}: {reason}")


class ReportKind(Enum):
    DUPLICATE = "duplicate"
    COMPLEXITY = "complexity"


class RunStatus(Enum):
    SUCCESS = 0
    ISSUES_FOUND = 1

    @classmethod
    def from_issue_count(cls, count: int) -> RunStatus:
        return cls.ISSUES_FOUND if count else cls.SUCCESS


@dataclass(frozen=True)
class Config:
    report: ReportKind
    verbose: bool = False
    file_extensions: tuple[str, ...] = ()
    files: tuple[str, ...] | None = None
    git_branch: bool = False
    max_cognitive_complexity: int = 15
    max_cyclomatic_complexity: int = 10


@dataclass(frozen=True)
class SourceFile:
    path: str
    display_path: str
    extension: str


@dataclass(frozen=True)
class LineRange:
    start: int
    end: int


@dataclass
class ChangedFile:
    path: str
    lines: list[LineRange] = field(default_factory=list)
