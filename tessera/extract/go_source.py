"""Facts of Go files."""

from __future__ import annotations

from .facts import Facts
from .tokens import Token, arguments, chain_before, partners, tokens

NOT_CALLED = {"if", "for", "switch", "select", "func", "return", "go", "defer", "range", "import", "const", "var", "type", "interface", "struct"}


def _defined(facts: Facts, name: str, kind: str, start: int, end: int) -> None:
    facts.definition(name, kind, start, end)
    if name[:1].isupper():
        facts.exported(name, False, start)


def _imports(facts: Facts, ts: list[Token], pair: list[int], i: int) -> int:
    end = pair[i + 1] if i + 1 < len(ts) and ts[i + 1].text == "(" and pair[i + 1] >= 0 else i
    j = i + 1
    while j < len(ts):
        if ts[j].kind == "string":
            path = ts[j].text[1:-1]
            alias = ts[j - 1].text if ts[j - 1].text not in ("(", "import") and ts[j - 1].kind in ("name", "sign") and ts[j - 1].line == ts[j].line and ts[j - 1].text != ";" else None
            facts.imported(path, [(path.rsplit("/", 1)[-1], alias)], False, True, ts[j].line)
            if end == i:
                return j
        if j >= end > i:
            return end
        j += 1
    return j


def _group(facts: Facts, ts: list[Token], pair: list[int], i: int, kind: str) -> int:
    """const, var and type declarations, single or in parentheses."""
    grouped = i + 1 < len(ts) and ts[i + 1].text == "("
    j, end = (i + 2, pair[i + 1]) if grouped else (i + 1, len(ts))
    while 0 <= j < end:
        line = ts[j].line
        if ts[j].kind == "name":
            stop = j
            while stop + 1 < end and (ts[stop + 1].line == line or pair[stop] >= 0):
                stop = pair[stop] if pair[stop] >= 0 else stop + 1
                line = ts[stop].line if pair[stop] < 0 and ts[stop].text in (")", "}", "]") else line
            what = kind
            if kind == "type":
                follows = next((t.text for t in ts[j + 1 : stop + 1] if t.text in ("struct", "interface")), "")
                what = {"struct": "Struct", "interface": "Interface"}.get(follows, "TypeAlias")
            _defined(facts, ts[j].text, {"const": "Constant", "var": "Constant"}.get(what, what), ts[j].line, ts[stop].line)
            j = stop
        if not grouped:
            return j
        j += 1
    return end


def extract(source: str) -> Facts:
    facts, ts = Facts(), tokens(source)
    pair = partners(ts)
    spans: list[tuple[int, int, str]] = []  # places of a function's name and end, and the name
    i = 0
    while i < len(ts):
        word = ts[i].text
        if word == "import":
            i = _imports(facts, ts, pair, i)
        elif word == "func":
            j = i + 1
            if j < len(ts) and ts[j].text == "(" and pair[j] >= 0:
                j = pair[j] + 1  # the receiver
            name, at = (ts[j].text, j) if j < len(ts) and ts[j].kind == "name" else (None, j)
            while j < len(ts) and ts[j].text != "{":
                j = pair[j] + 1 if pair[j] >= 0 else j + 1
            end = pair[j] if j < len(ts) and pair[j] >= 0 else min(j, len(ts) - 1)
            if name:
                _defined(facts, name, "Function", ts[i].line, ts[end].line)
                spans.append((at, end, name))
            i = end
        elif word in ("const", "var", "type"):
            i = _group(facts, ts, pair, i, word)
        elif pair[i] >= 0:
            i = pair[i]
        i += 1
    for start, end, name in spans:
        for k in range(start + 2, end):
            if ts[k].text != "(" or pair[k] < 0:
                continue
            found = chain_before(ts, k)
            if not found or found[0] in NOT_CALLED or found[1] == start:
                continue
            callee, first = found
            facts.call(callee, ts[first].line, name, arguments(source, ts, k, pair[k]))
            if ts[first - 1].text in (":=", "=") and ts[first - 2].kind == "name":
                facts.assignment(ts[first - 2].text, callee, ts[first].line, name)
    return facts
