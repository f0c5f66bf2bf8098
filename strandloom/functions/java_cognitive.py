"""Cognitive complexity of Java source, scored on a stream of words, brackets and boolean operators.

Structure costs one plus the nesting of control blocks around it; boolean operators cost one whenever the operator
changes. Operators in the header of a control statement are scored with the statement; the walk over the body leaves
out what stands directly in such a header. Which tokens do is known from the open parentheses: each remembers whether
it opens a control header, and whether a brace or semicolon has already appeared in it.
"""

from __future__ import annotations

import regex

CONTROL = frozenset(("if", "for", "while", "switch", "catch"))
_TOKEN = regex.compile(
    r"""//[^\n]* | /\*.*?(?:\*/|\Z) | "(?:\\.|[^"\\])*(?:"|\\?\Z) | '(?:\\.|[^'\\])*(?:'|\\?\Z)
      | (?P<token>&& | \|\| | [\p{Alphabetic}_][\p{Alphabetic}\p{N}_]* | [?{}();])""",
    regex.VERBOSE | regex.DOTALL,
)


def tokens(source: str) -> list[str]:
    return [m["token"] for m in _TOKEN.finditer(source) if m["token"]]


def _changes(operators) -> int:
    """How many runs of one operator a sequence has."""
    count, last = 0, None
    for op in operators:
        count += op != last
        last = op
    return count


def _header_runs(stream: list[str], at: int) -> int:
    """Operator runs within the parentheses that follow the token at ``at``."""
    if at + 1 >= len(stream) or stream[at + 1] != "(":
        return 0
    inside, depth = [], 0
    for token in stream[at + 1 :]:
        depth += (token == "(") - (token == ")")
        if depth == 0:
            break
        if token in ("&&", "||"):
            inside.append(token)
    return _changes(inside)


def _direct_header(stream: list[str]) -> list[bool]:
    """For each token: whether it stands directly in a control header."""
    out, open_ = [], []  # open parentheses: [opens a control header, a brace or semicolon was met]
    for at, token in enumerate(stream):
        out.append(bool(open_) and open_[-1][0] and not open_[-1][1])
        if token == "(":
            before = stream[at - 1] if at else ""
            open_.append([before in CONTROL or (before == "(" and bool(open_) and open_[-1][0]), False])
        elif token == ")" and open_:
            open_.pop()
        elif token in ("{", ";") and open_:
            open_[-1][1] = True
    return out


def cognitive(source: str) -> float:
    stream = tokens(source)
    in_header = _direct_header(stream)
    score = nesting = 0
    waiting: list[str] = []  # statements that have not met their block
    blocks: list[str] = []
    operator = None
    done = False  # a do block has just closed

    for at, token in enumerate(stream):
        if token in CONTROL:
            score += _header_runs(stream, at)
            if token == "if" and at and stream[at - 1] == "else":
                waiting.append("control")
            elif token == "while" and done:
                done, operator = False, None
            else:
                score += nesting + 1
                waiting.append("control")
        elif token == "else":
            score += 1
        elif token == "do":
            score += nesting + 1
            waiting.append("do")
        elif token == "?":
            score += nesting + 1
        elif token in ("&&", "||"):
            if not in_header[at]:
                score += token != operator
                operator = token
        elif token == "{":
            blocks.append(waiting.pop() if waiting else "plain")
            nesting += blocks[-1] != "plain"
            operator = None
        elif token == "}":
            if blocks:
                kind = blocks.pop()
                done = kind == "do"
                if kind != "plain":
                    nesting -= 1
                    waiting.clear()
            operator = None
        elif token == ";" and not in_header[at]:
            waiting.clear()
            done, operator = False, None
        else:
            done = False
    return float(score)
