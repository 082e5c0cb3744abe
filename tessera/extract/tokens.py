"""A small tokenizer for brace languages: names, strings, numbers, signs."""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)
    |(?P<name>[^\W\d][\w$]*|\$[\w$]*)
    |(?P<number>\d[\w.]*)
    |(?P<sign>=>|\.\.\.|:=|\?\.|<-|&&|\|\||[-+*/%&|^!<>=]=|.)""",
    re.VERBOSE | re.DOTALL,
)


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    start: int
    end: int


def tokens(source: str) -> list[Token]:
    out, line = [], 1
    for m in _TOKEN.finditer(source):
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup or "sign", m[0], line, m.start(), m.end()))
        line += m[0].count("\n")
    return out


OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def partners(ts: list[Token]) -> list[int]:
    """For each opening sign the place of its closing one; -1 elsewhere and where it is never closed."""
    out, stack = [-1] * len(ts), []
    for i, t in enumerate(ts):
        if t.kind == "sign" and t.text in OPEN:
            stack.append(i)
        elif t.kind == "sign" and t.text in CLOSE and stack:
            out[stack.pop()] = i
    return out


def chain_before(ts: list[Token], i: int) -> tuple[str, int] | None:
    """The dotted name that ends just before place i, and where it starts."""
    j, parts = i - 1, []
    while j >= 0 and ts[j].kind == "name":
        parts.append(ts[j].text)
        if j >= 2 and ts[j - 1].text in (".", "?.") and ts[j - 2].kind == "name":
            j -= 2
        else:
            break
    return (".".join(reversed(parts)), j) if parts else None


def arguments(source: str, ts: list[Token], start: int, end: int) -> list[str]:
    """Texts of the comma-separated parts between two places."""
    out, depth, first = [], 0, start + 1
    for i in range(start + 1, end + 1):
        t = ts[i]
        if i == end or (depth == 0 and t.text == "," and t.kind == "sign"):
            if i > first:
                out.append(source[ts[first].start : ts[i - 1].end])
            first = i + 1
        elif t.kind == "sign" and t.text in OPEN:
            depth += 1
        elif t.kind == "sign" and t.text in CLOSE:
            depth -= 1
    return out
