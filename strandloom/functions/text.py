"""Column functions on lines, paths, ranges and numbers; all of them run inside the engine's generated code."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import LANGUAGES, Language

#: Unicode white space at either end (the engine's trim takes U+0020 only).
_TRIM = r"(?U)^\s+|\s+\z"


def normalized(line: Column) -> Column:
    """The line without white space around it."""
    return F.regexp_replace(line, _TRIM, "")


def path_key(path: Column) -> Column:
    """A path with forward slashes: the identity of a file."""
    return F.translate(path, "\\", "/")


def display_path(path: Column) -> Column:
    """Without empty and ``.`` parts; ``..`` stays; an absolute path stays absolute; nothing left is ``.``."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    joined = F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def extension(path: Column) -> Column:
    """What follows the last dot of the last part, in ASCII lower case; "" without one, or if only the first dot leads."""
    name = F.element_at(F.split(path, "/"), -1)
    found = F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def metric(value: Column) -> Column:
    """Integral values without, others with two decimals."""
    return F.when(F.abs(value - F.floor(value)) < 2.220446049250313e-16, F.format_string("%.0f", value)).otherwise(F.format_string("%.2f", value))


def range_list(ranges: Column) -> Column:
    """``3-17,21`` of an array of (start, end)."""
    one = lambda r: F.when(r["start"] == r["end"], r["start"].cast("string")).otherwise(F.concat_ws("-", r["start"], r["end"]))
    return F.array_join(F.transform(ranges, one), ",")


def analyzed_file(path: Column, ranges: Column) -> Column:
    """A path, with its changed ranges in parentheses if there are any."""
    return F.when(F.size(F.coalesce(ranges, F.array())) > 0, F.concat(path, F.lit(" ("), range_list(ranges), F.lit(")"))).otherwise(path)


def _quoted(characters: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in characters)


def _seeds_nothing(language: Language, text: Column) -> Column:
    rule = text.rlike(rf"(?U)^[\s{_quoted(language.characters)}]*\z")
    if language.lines:
        rule = rule | text.isin(*language.lines)
    for pattern in language.patterns:
        rule = rule | text.rlike("(?sU)" + re.sub(r"\$$", r"\\z", pattern))
    return rule


def is_comparison(ext: Column, text: Column) -> Column:
    """Whether a normalized line can seed a match: it is no mere structure in its language. Unknown languages: always."""
    alike: dict[tuple, list[str]] = {}
    for language in LANGUAGES:
        alike.setdefault((language.characters, language.lines, language.patterns), []).extend(language.extensions)
    by_rule = [(Language("", (), *rule), extensions) for rule, extensions in alike.items()]
    return ~functools.reduce(lambda got, r: F.when(ext.isin(*r[1]), _seeds_nothing(r[0], text)).otherwise(got), by_rule, F.lit(False))
