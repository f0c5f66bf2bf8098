"""Functions of a source file with their spans and complexity.

An own approximation: files of bracketed languages are read as tokens, a block is a function's if the tokens before
it have a function's form in that language, and decisions are counted on the tokens of its body. Python goes through
its own parser. Cyclomatic complexity is one plus the decisions; cognitive complexity adds the nesting to structural
decisions, one for else branches and one for each change of boolean operator. Java's cognitive complexity is the
token score of :mod:`java_cognitive` over the function's whole lines.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

import regex

from . import java_cognitive

_FAMILY = {
    **dict.fromkeys(("c", "h", "cc", "cpp", "cxx", "hh", "hpp", "hxx"), "c"),
    **dict.fromkeys(("js", "jsx", "mjs", "cjs", "ts", "tsx"), "script"),
    "java": "java",
    "rs": "rust",
    **dict.fromkeys(("py", "pyw"), "python"),
}
SUPPORTED = tuple(_FAMILY)
ANONYMOUS = "<anonymous>"

_DECISIONS = {
    "c": ("if", "for", "while", "case", "catch", "?", "&&", "||"),
    "script": ("if", "for", "while", "case", "catch", "?", "&&", "||", "??"),
    "java": ("if", "for", "while", "case", "catch", "?", "&&", "||"),
    "rust": ("if", "for", "while", "loop", "=>", "?", "&&", "||"),
}
_STRUCTURE = {
    "c": ("if", "for", "while", "switch", "catch", "do", "?"),
    "script": ("if", "for", "while", "switch", "catch", "do", "?"),
    "java": ("if", "for", "while", "switch", "catch", "do", "?"),
    "rust": ("if", "for", "while", "loop", "match"),
}
_NO_NAME = frozenset(("if", "for", "while", "switch", "catch", "do", "else", "try", "return", "match", "loop", "synchronized", "with", "new", "throw", "sizeof"))

_TOKEN = regex.compile(
    r"""(?P<skip>//[^\n]* | /\*.*?(?:\*/|\Z) | r\#*"(?:.*?)"\#* | "(?:\\.|[^"\\])*(?:"|\Z) | `(?:\\.|[^`\\])*(?:`|\Z)
        | '(?:\\.|[^'\\\n]){1,12}' | '[\p{Alphabetic}_]\w* | \s+)
      | (?P<token>&&= | \|\|= | && | \|\| | \?\?=? | \?\. | => | -> | :: | [\p{Alphabetic}_$][\p{Alphabetic}\p{N}_$]* | [0-9][\w.]* | .)""",
    regex.VERBOSE | regex.DOTALL,
)


@dataclass(frozen=True)
class Function:
    name: str
    start_line: int
    end_line: int
    cognitive: float
    cyclomatic: float


def _tokens(source: str) -> list[tuple[str, int]]:
    out, line = [], 1
    for m in _TOKEN.finditer(source):
        if m["token"]:
            out.append((m["token"], line))
        line += m[0].count("\n")
    return out


def _is_word(token: str) -> bool:
    return token[0].isalpha() or token[0] in "_$"


def _name(head: list[str], family: str, around: str) -> str | None:
    """The name of the function whose block follows these tokens, or None if it is no function's."""
    if family == "rust":
        return head[head.index("fn") + 1] if "fn" in head[:-1] else None
    if family == "script":
        if "function" in head:
            k = head.index("function") + 1
            k += k < len(head) and head[k] == "*"
            if k < len(head) and _is_word(head[k]):
                return head[k]
            return _assigned(head)
        if head and head[-1] == "=>":
            return _assigned(head)
        if around != "class":
            return None
    # name ( parameters ) ...: the first parenthesis that is not inside another bracket
    depth = 0
    for k, token in enumerate(head):
        if token == "(" and depth == 0 and k:
            name = head[k - 1]
            if not _is_word(name) or name in _NO_NAME or "=" in head[:k] or any(t in _NO_NAME for t in head[:k]):
                return None
            if family == "c" and k >= 3 and head[k - 2] == "::":
                name = f"{head[k - 3]}::{name}"
            return name
        depth += token in ("(", "[")
        depth -= token in (")", "]")
    return None


def _assigned(head: list[str]) -> str:
    for mark in ("=", ":"):
        if mark in head:
            k = head.index(mark)
            words = [t for t in head[:k] if _is_word(t) and t not in ("const", "let", "var", "export", "default", "async")]
            if words:
                return words[0] if mark == "=" else words[-1]
    return ANONYMOUS


def _cognitive(body: list[str], family: str) -> int:
    score = nesting = parens = 0  # parentheses that the statement at hand has opened: a for header holds semicolons
    pending, blocks, held, operator = [], [], [], None
    done = False  # the body of a do has just ended: its while is no other loop
    for at, token in enumerate(body):
        before = body[at - 1] if at else ""
        tail, done = done and token == "while", False
        if token in ("&&", "||"):
            score += token != operator
            operator = token
            continue
        if tail:
            operator = None
        elif token in _STRUCTURE[family]:
            if token == "if" and before == "else":
                pending.append(True)
            elif token == "?":
                score += nesting + 1
            else:
                score += nesting + 1
                pending.append("do" if token == "do" else True)
            operator = None
        elif token == "else":
            score += 1
            pending.append(True)
            if at + 1 < len(body) and body[at + 1] == "if":
                pending.pop()
        elif token == "=>" and family != "rust":
            pending.append(True)
        elif token == "{":
            blocks.append(pending.pop() if pending else False)
            nesting += bool(blocks[-1])
            held.append(parens)
            parens, operator = 0, None
        elif token == "}":
            parens = held.pop() if held else 0
            ended = blocks.pop() if blocks else False
            if ended:
                nesting -= 1
                pending.clear()
            done = ended == "do"
            operator = None
        elif token == ";":
            operator = None
            if not parens:
                done = pending[-1:] == ["do"]
                pending = []
        elif token in ("(", ")"):
            parens = max(0, parens + (1 if token == "(" else -1))
    return score


def _bracketed(source: str, family: str) -> list[Function]:
    stream = _tokens(source)
    lines = source.split("\n")
    found: list[Function] = []
    open_: list[tuple[str, str | None, int, int]] = []  # kind, name, first line, place of the brace
    begin = 0  # the statement at hand
    parens = 0
    held: list[int] = []
    for at, (token, line) in enumerate(stream):
        if token in "([":
            parens += 1
        elif token in ")]":
            parens = max(0, parens - 1)
        elif token == "{":
            first = begin
            while family == "rust" and first < at and stream[first][0] == "#":  # attributes are no part of a function
                while first < at and stream[first][0] != "]":
                    first += 1
                first += 1
            head = [t for t, _ in stream[first:at]]
            around = open_[-1][0] if open_ else "file"
            inside = any(k == "function" for k, *_ in open_) and family in ("c", "java") and around != "class"
            name = None if inside else _name(head, family, around)
            kind = "function" if name is not None else "class" if any(t in ("class", "interface", "enum", "struct", "impl", "trait", "namespace") for t in head) or (family == "java" and "new" in head) else "block"
            open_.append((kind, name, stream[first][1], at))
            held.append(parens)
            parens, begin = 0, at + 1
        elif token == "}" and open_:
            kind, name, start, brace = open_.pop()
            parens = held.pop()
            if kind == "function":
                body = [t for t, _ in stream[brace : at + 1]]
                inner = body[1:-1]
                if family == "java":
                    cognitive = java_cognitive.cognitive("\n".join(lines[start - 1 : line]))
                else:
                    cognitive = float(_cognitive(inner, family))
                decisions = sum(t in _DECISIONS[family] for t in inner)
                found.append(Function(name, start, line, cognitive, 1.0 + decisions))
            if not parens:
                begin = at + 1
        elif token == ";" and not parens:
            begin = at + 1
    return found


class _PythonCognitive(ast.NodeVisitor):
    def __init__(self):
        self.score = self.nesting = 0

    def _nested(self, nodes) -> None:
        self.nesting += 1
        for n in nodes:
            self.visit(n)
        self.nesting -= 1

    def visit_If(self, node, chained: bool = False):
        self.score += 1 if chained else 1 + self.nesting
        self.visit(node.test)
        self._nested(node.body)
        if len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If):
            self.visit_If(node.orelse[0], chained=True)
        elif node.orelse:
            self.score += 1
            self._nested(node.orelse)

    def _loop(self, node):
        self.score += 1 + self.nesting
        for part in ("test", "iter"):
            if hasattr(node, part):
                self.visit(getattr(node, part))
        self._nested(node.body)
        if node.orelse:
            self.score += 1
            self._nested(node.orelse)

    visit_For = visit_AsyncFor = visit_While = _loop

    def visit_ExceptHandler(self, node):
        self.score += 1 + self.nesting
        self._nested(node.body)

    def visit_IfExp(self, node):
        self.score += 1 + self.nesting
        self._nested([node.test, node.body, node.orelse])

    def visit_BoolOp(self, node):
        self.score += 1
        self.generic_visit(node)

    def visit_FunctionDef(self, node):
        self._nested(node.body)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node):
        self._nested([node.body])


def _python(source: str) -> list[Function]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            visitor = _PythonCognitive()
            for n in node.body:
                visitor.visit(n)
            decisions = 0
            for n in ast.walk(node):
                decisions += isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case))
                decisions += len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0
            found.append(Function(node.name, node.lineno, node.end_lineno or node.lineno, float(visitor.score), 1.0 + decisions))
    return found


def functions(source: bytes, extension: str) -> list[Function]:
    """Functions of a file, by place; none for other languages or what cannot be read."""
    family = _FAMILY.get(extension)
    if family is None:
        return []
    text = source.decode("utf-8", "replace")
    found = _python(text) if family == "python" else _bracketed(text, family)
    return sorted(found, key=lambda f: (f.start_line, f.end_line, f.name))
