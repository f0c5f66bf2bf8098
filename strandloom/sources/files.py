"""Source files: discovery on the driver (ignore rules need the tree's files), contents on the executors."""

from __future__ import annotations

import os
import stat
import subprocess
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AnalysisError, SourceFile
from ..shipping import ship

#: Directories that are never entered, whatever their case (fixed values).
IGNORED_DIRECTORIES = frozenset((".git", "node_modules", "target", "dist", "build", "coverage", ".next", ".nuxt", ".svelte-kit", ".idea", ".vscode"))
_IGNORE_FILES = (".gitignore", ".ignore")


def path_key(path: str) -> str:
    return path.replace("\\", "/")


def display_path(path: str) -> str:
    parts = [p for p in path.split("/") if p not in ("", ".")]
    return (("/" if path.startswith("/") else "") + "/".join(parts)) or "."


def extension_of(path: str) -> str:
    """The ASCII-lowercased extension; "" for none, and for names whose only dot leads."""
    stem, dot, ext = os.path.basename(path).rpartition(".")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in ext) if dot and stem else ""


class IgnoreRules:
    """The patterns of one ignore file, relative to its directory; the last that matches decides."""

    def __init__(self, base: str, text: str):
        self.base = base
        self.rules: list[tuple[regex.Pattern, bool, bool]] = []
        for line in text.split("\n"):
            line = line.removesuffix("\r")
            while line.endswith(" ") and not line.endswith("\\ "):
                line = line[:-1]
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep or line.startswith(("\\#", "\\!")) else line
            only_dirs = line.endswith("/")
            line = line.rstrip("/") if only_dirs else line
            if line:
                self.rules.append((regex.compile(self._pattern(line)), keep, only_dirs))

    @staticmethod
    def _pattern(glob: str) -> str:
        anchored = "/" in glob
        glob = glob.lstrip("/")
        out, at = "" if anchored else "(?:.*/)?", 0
        while at < len(glob):
            if glob.startswith("**/", at) and (at == 0 or glob[at - 1] == "/"):
                out, at = out + "(?:.*/)?", at + 3
            elif glob.startswith("/**", at) and at + 3 == len(glob):
                out, at = out + "/.*", at + 3
            elif glob[at] == "*":
                out += "[^/]*"
                at += 1
                while at < len(glob) and glob[at] == "*":
                    at += 1
            elif glob[at] == "?":
                out, at = out + "[^/]", at + 1
            elif glob[at] == "[" and "]" in glob[at + 2 :]:
                end = glob.index("]", at + 2)
                inner = glob[at + 1 : end]
                inner = "^" + inner[1:] if inner[0] in "!^" else inner
                out, at = out + "[" + inner.replace("\\", "\\\\") + "]", end + 1
            elif glob[at] == "\\" and at + 1 < len(glob):
                out, at = out + regex.escape(glob[at + 1]), at + 2
            else:
                out, at = out + regex.escape(glob[at]), at + 1
        return out

    def decide(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored; False: kept by an exception; None: no rule."""
        inside = os.path.relpath(path, self.base).replace(os.sep, "/")
        for pattern, keep, only_dirs in reversed(self.rules):
            if (is_dir or not only_dirs) and pattern.fullmatch(inside):
                return not keep
        return None


class LocalTree:
    """Directories and files of the driver's file system."""

    def read(self, directory: str, name: str) -> str | None:
        try:
            return Path(directory, name).read_text(encoding="utf-8", errors="replace")
        except OSError:
            return None

    def is_repository(self, directory: str) -> bool:
        return os.path.isdir(os.path.join(directory, ".git"))

    def entries(self, directory: str) -> list[tuple[str, bool, bool]]:
        """(name, is a directory, is a regular file), links are neither."""
        try:
            return sorted((e.name, e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)) for e in os.scandir(directory))
        except OSError as error:
            raise AnalysisError(f"could not walk {path_key(directory)}: {error.strerror}") from error


class ListedTree:
    """A tree from a list of its files: {path: (is a regular file, content of an ignore file or None)}."""

    def __init__(self, listed: dict[str, tuple[bool, str | None]]):
        self.texts = {path: text for path, (_, text) in listed.items() if text is not None}
        self.held: dict[str, dict[str, tuple[bool, bool]]] = {"": {}}
        for path, (regular, _) in listed.items():
            *above, name = path.split("/")
            at = ""
            for part in above:
                self.held[at][part] = (True, False)
                at = f"{at}/{part}" if at else part
                self.held.setdefault(at, {})
            self.held[at][name] = (False, regular)

    def read(self, directory: str, name: str) -> str | None:
        return self.texts.get(f"{directory}/{name}" if directory else name)

    def is_repository(self, directory: str) -> bool:
        return ".git" in self.held.get(directory, {})

    def entries(self, directory: str) -> list[tuple[str, bool, bool]]:
        return sorted((name, *kind) for name, kind in self.held[directory].items())


def _rules_of(tree: LocalTree | ListedTree, directory: str) -> list[IgnoreRules]:
    """An ``.ignore`` file wins over a ``.gitignore``, that over the repository's own list, so it comes last."""
    names = [*([".git/info/exclude"] if tree.is_repository(directory) else []), *_IGNORE_FILES]
    texts = [tree.read(directory, name) for name in names]
    return [IgnoreRules(directory or ".", text) for text in texts if text is not None]


def _global_rules(root: str) -> list[IgnoreRules]:
    """The user's own list: the file that git's core.excludesFile names, else the one in the configuration folder."""
    try:
        named = subprocess.run(["git", "-C", root, "config", "--type=path", "--get", "core.excludesFile"], capture_output=True, check=False).stdout.decode("utf-8", "replace").strip()
    except OSError:  # no git
        named = ""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    path = named or os.path.join(home, "git", "ignore")
    text = LocalTree().read(os.path.dirname(path) or root, os.path.basename(path)) if path else None
    return [IgnoreRules(root, text)] if text is not None else []


def _ascii_lower(name: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in name)


def visible(tree: LocalTree | ListedTree, root: str, extensions: tuple[str, ...], rules: list[IgnoreRules]) -> list[tuple[str, str]]:
    """(path, extension) of the regular files below ``root``: hidden ones too, ignored ones not; links are not followed."""
    wanted, found = frozenset(extensions), []

    def visit(directory: str, rules: list[IgnoreRules]) -> None:
        rules = rules + _rules_of(tree, directory)
        for name, is_dir, is_file in tree.entries(directory):
            if is_dir and _ascii_lower(name) in IGNORED_DIRECTORIES:
                continue
            path = f"{directory.rstrip('/')}/{name}" if directory else name
            if next((v for r in reversed(rules) if (v := r.decide(path, is_dir)) is not None), None):
                continue
            if is_dir:
                visit(path, rules)
            elif is_file and (ext := extension_of(name)) in wanted:
                found.append((path, ext))

    visit(root, rules)
    return found


def walk(root: str, extensions: tuple[str, ...]) -> list[SourceFile]:
    """Files below a directory of the driver that no rule ignores, also of the directories above it."""
    tree, top = LocalTree(), os.path.abspath(root)
    above, parent = [], top
    while os.path.dirname(parent) != parent:
        parent = os.path.dirname(parent)
        above[:0] = _rules_of(tree, parent)
    return [SourceFile(path, display_path(os.path.relpath(path, root)), ext) for path, ext in visible(tree, top, extensions, _global_rules(top) + above)]


def discovered(listing: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """(project, path_key, extension) of the files that a walk of each project's root finds.

    ``listing`` has a row for each file: project, path from the root, is_file (false: a link or other), and the content
    of ignore files. Whether a file is ignored depends on the tree above it, so a project's listing is one task's; its
    contents are not. A path listed twice counts once; a null project is one of its own; null paths are no files.
    """
    schema = "project string, path_key string, extension string"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        listed = {r.path: (bool(r.is_file), r.content) for r in rows.itertuples()}
        found = visible(ListedTree(listed), "", extensions, [])
        return pd.DataFrame([(rows["project"].iloc[0], path, ext) for path, ext in found], columns=["project", "path_key", "extension"])

    ship(listing.sparkSession)
    name = F.element_at(F.split("path", "/"), -1)
    rules = F.when(name.isin(*_IGNORE_FILES, "exclude"), F.col("content").cast("string")).alias("content")
    return listing.where("path is not null").select(F.col("project").cast("string").alias("project"), "path", "is_file", rules).groupBy("project").applyInPandas(run, schema)


def explicit(root: str, files: tuple[str, ...], extensions: tuple[str, ...]) -> list[SourceFile]:
    """The named files, checked before they are filtered; a file named twice counts once, the first way it was named."""
    base = os.path.realpath(root)
    seen: set[str] = set()
    found = []
    for name in files:
        path = name if os.path.isabs(name) else os.path.join(root, name)
        try:
            mode = os.lstat(path).st_mode
        except FileNotFoundError:
            raise AnalysisError(f"explicit file does not exist: {path_key(name)}") from None
        except OSError as error:
            raise AnalysisError.of_io(path, "read explicit file metadata", error) from error
        if stat.S_ISLNK(mode):
            raise AnalysisError(f"explicit file is a symbolic link and will not be followed: {path_key(name)}")
        if stat.S_ISDIR(mode):
            raise AnalysisError(f"explicit file is a directory: {path_key(name)}")
        if not stat.S_ISREG(mode):
            raise AnalysisError(f"explicit path is not a file: {path_key(name)}")
        ext = extension_of(path)
        real = os.path.realpath(path)
        if ext not in extensions or real in seen:
            continue
        seen.add(real)
        inside = os.path.isabs(name) and (real == base or real.startswith(base + os.sep))
        found.append(SourceFile(path, display_path(os.path.relpath(real, base) if inside else name), ext))
    return found


def discover(root: str, extensions: tuple[str, ...], files: tuple[str, ...] | None = None) -> list[SourceFile]:
    """Named files or all below ``root``, in the order of their shown paths."""
    found = walk(root, extensions) if files is None else explicit(root, files, extensions)
    return sorted(found, key=lambda f: path_key(f.display_path).encode("utf-8", "surrogateescape"))


def table(spark: SparkSession, files: list[SourceFile]) -> DataFrame:
    """(path_key, extension, content binary) of discovered files; contents are read by the executors."""
    names = spark.createDataFrame([("file:" + os.path.abspath(f.path), path_key(f.display_path), f.extension) for f in files], "_path string, path_key string, extension string")
    if not files:
        return names.select("path_key", "extension", F.lit(None).cast("binary").alias("content"))
    # names with characters that the reader takes as patterns are escaped one by one
    escaped = [regex.sub(r"([\\{}\[\]*?,^$])", r"\\\1", os.path.abspath(f.path)) for f in files]
    read = spark.read.format("binaryFile").load(escaped).select(F.regexp_replace("path", "^file:/+", "file:/").alias("_path"), "content")
    return read.join(names, "_path").select("path_key", "extension", "content")


def tree(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path_key, extension, content binary) of a plain tree in any store; listing and filters are the reader's."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    from ..functions import text as T

    ignored = "(?i)/(" + "|".join(regex.escape(d) for d in sorted(IGNORED_DIRECTORIES)) + ")/"
    named = read.where(~F.col("path").rlike(ignored)).select(F.col("path").alias("path_key"), T.extension(F.col("path")).alias("extension"), "content")
    return named.where(F.col("extension").isin(*extensions))


def as_text(files: DataFrame) -> DataFrame:
    """Files with their content as text. A file that is not UTF-8 is an error that names it."""
    return files.select("path_key", "extension", F.when(F.expr("is_valid_utf8(cast(content as string))"), F.expr("cast(content as string)")).otherwise(F.raise_error(F.concat(F.lit("could not read "), F.col("path_key"), F.lit(": stream did not contain valid UTF-8")))).alias("content"))
