"""The languages whose lines are classified: extensions, characters, lines and patterns of lines that seed nothing."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    characters: str
    lines: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


# Character sets, exact lines and whole-line patterns that must equal the documented behaviour.
_BRACKETS = "(),:;[]{}"
_C_LIKE = "(),:;<>?[]{}"
_SHELL = "&();[]{|}"
_SCRIPT = "&(),:;<>?[]{|}"
_MARKUP = "/<>"
_SHELL_WORDS = ("do", "done", "else", "fi", "then")
_CLOSING_TAGS = ("</article>", "</body>", "</div>", "</html>", "</section>", "</span>")
_SCRIPT_PATTERNS = (
    r"^/\*.*\*/$",
    r"^[A-Za-z_$][A-Za-z0-9_$]*\??:\s*(?:Scalars\['[A-Za-z]+'\]|[A-Z][A-Za-z0-9_$]*(?:\[\])?|[a-z]+(?:\[\])?|\([^)]*\))(?:\[\])?(?:\s*\|\s*(?:null|number|boolean|string))*[,]?$",
    r"^__typename:\s*'[A-Za-z_$][A-Za-z0-9_$]*'[,]?$",
)
_RUST_PATTERNS = (
    r"^[A-Za-z0-9_]*::?\s*[A-Za-z0-9_]*[,]?$",
    r"^[A-Za-z0-9_]+\s*[.,]?$",
    r"^\.?\s*[A-Za-z0-9_]+(?:\(\s*\)?)?$",
    r"^let\s+(?:mut\s+)?[A-Za-z0-9_]+\s*=$",
    r"^pub\s+[A-Za-z0-9_]*\s*:\s*[A-Za-z0-9_]*[,]?$",
    r"^use\s+[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)*;$",
)

LANGUAGES = (
    Language("Bash", ("bash",), _SHELL, _SHELL_WORDS),
    Language("C", ("c", "h"), _C_LIKE, ("#else", "#endif")),
    Language("C#", ("cs",), _C_LIKE, ("#else", "#endif", "#endregion")),
    Language("C++", ("cpp", "hpp", "cc", "hh", "cxx", "hxx"), _C_LIKE, ("#else", "#endif")),
    Language("CSS", ("css",), _BRACKETS),
    Language("Fish", ("fish",), _SHELL, ("else", "end")),
    Language("Go", ("go",), _BRACKETS),
    Language("HTML", ("html", "htm"), _MARKUP, _CLOSING_TAGS),
    Language("Java", ("java",), _C_LIKE),
    Language("JavaScript", ("js", "jsx", "mjs", "cjs"), _SCRIPT, ("// @ts-nocheck",), _SCRIPT_PATTERNS),
    Language("Kotlin", ("kt", "kts"), _C_LIKE),
    Language("Less", ("less",), _BRACKETS),
    Language("Objective-C", ("m", "mm"), _C_LIKE, ("#else", "#endif")),
    Language("PHP", ("php", "phtml"), "(),/:;<>?[]{}"),
    Language("PowerShell", ("ps1", "psm1", "psd1"), "(),:;?[]{|}"),
    Language("Python", ("py", "pyw"), _BRACKETS),
    Language("Ruby", ("rb",), "(),:;?[]{}", ("end",)),
    Language("Rust", ("rs",), "&(),:;<>?[]{}", ("///", "#[test]", "assert!(", "assert_eq!("), _RUST_PATTERNS),
    Language("Sass", ("sass",), _BRACKETS),
    Language("Scala", ("scala", "sc"), _C_LIKE),
    Language("SCSS", ("scss",), _BRACKETS),
    Language("Shell", ("sh",), _SHELL, _SHELL_WORDS),
    Language("SQL", ("sql",), "(),:;", ("BEGIN", "END")),
    Language("Swift", ("swift",), _C_LIKE),
    Language("TypeScript", ("ts", "tsx"), _SCRIPT, ("// @ts-nocheck",), _SCRIPT_PATTERNS),
    Language("XML", ("xml", "xhtml", "svg"), _MARKUP, _CLOSING_TAGS),
    Language("YAML", ("yaml", "yml"), _C_LIKE, ("jobs:", "on:")),
    Language("Zsh", ("zsh",), _SHELL, _SHELL_WORDS),
)


def supported_extensions() -> tuple[str, ...]:
    return tuple(dict.fromkeys(e for language in LANGUAGES for e in language.extensions))
