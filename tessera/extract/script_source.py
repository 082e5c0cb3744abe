"""Facts of TypeScript and JavaScript files."""

from __future__ import annotations

from .facts import Facts
from .tokens import Token, arguments, chain_before, partners, tokens

NOT_CALLED = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "import", "with", "of", "in", "new", "async"}
MODIFIERS = {"export", "default", "async", "abstract", "declare", "public", "private", "protected", "static", "readonly", "override"}


def unquoted(t: Token) -> str:
    return t.text[1:-1]


def _named(ts: list[Token], i: int, close: int) -> list[tuple[str, str | None]]:
    """`a, b as c, type d` between braces."""
    out, j = [], i + 1
    while j < close:
        if ts[j].text == "type" and j + 1 < close and ts[j + 1].kind == "name" and ts[j + 1].text != "as":
            j += 1
        if ts[j].kind in ("name", "string"):
            name, alias = ts[j].text, None
            if j + 2 < close + 1 and ts[j + 1].text == "as":
                alias, j = ts[j + 2].text, j + 2
            out.append((name, alias))
        j += 1
    return out


def _import(facts: Facts, ts: list[Token], pair: list[int], i: int) -> int:
    line, j, names, default, namespace = ts[i].line, i + 1, [], False, False
    if j < len(ts) and ts[j].text in ("(", "."):
        return i  # a dynamic import is a call
    if ts[j].text == "type" and ts[j + 1].text != "from":
        j += 1
    while j < len(ts) and ts[j].kind != "string" and ts[j].text != ";":
        if ts[j].text == "{":
            names += _named(ts, j, pair[j])
            j = pair[j]
        elif ts[j].text == "*":
            namespace = True
            names.append((ts[j + 2].text, None))
            j += 2
        elif ts[j].kind == "name" and ts[j].text != "from":
            default = True
            names.append((ts[j].text, None))
        j += 1
    if j < len(ts) and ts[j].kind == "string":
        facts.imported(unquoted(ts[j]), names, default, namespace, line)
    return j


def _end_of_statement(ts: list[Token], pair: list[int], i: int) -> int:
    j = i
    while j < len(ts):
        if pair[j] >= 0:
            j = pair[j]
        elif ts[j].text == ";" or (j > i and ts[j].line > ts[j - 1].line and ts[j - 1].text not in ("=", "=>", ",", ".", "(", ":", "|", "&", "?") and ts[j].text not in (".", "?.", "=", ":", "?", "|", "&", "=>", "{", "(")):
            return j - (ts[j].text != ";")
        j += 1
    return len(ts) - 1


def _is_function_value(ts: list[Token], pair: list[int], i: int) -> bool:
    """Whether the value that starts at i is an arrow function or a function."""
    if i < len(ts) and ts[i].text == "async":
        i += 1
    if i >= len(ts):
        return False
    if ts[i].text == "function":
        return True
    if ts[i].text == "(" and pair[i] >= 0:
        j = pair[i] + 1
        while j < len(ts) and ts[j].text not in ("=>", ";", "{", ")", ","):
            j += 1
        return j < len(ts) and ts[j].text == "=>"
    return ts[i].kind == "name" and i + 1 < len(ts) and ts[i + 1].text == "=>"


def _declaration(facts: Facts, ts: list[Token], pair: list[int], i: int, exported: bool, default: bool, spans: list[tuple[int, int, str]]) -> int:
    """The declaration at i; returns its last place, or i - 1 if there is none."""
    start = i
    while i < len(ts) and ts[i].text in MODIFIERS:
        i += 1
    if i >= len(ts):
        return start - 1
    word, line = ts[i].text, ts[i].line
    kinds = {"function": "Function", "class": "Class", "interface": "Interface", "type": "TypeAlias", "enum": "Class"}
    if word in kinds and i + 1 < len(ts):
        j = i + 1 + (ts[i + 1].text == "*")
        name = ts[j].text if ts[j].kind == "name" else "default"
        body = j
        while body < len(ts) and ts[body].text != "{":
            if word == "type" and ts[body].text in (";",):
                break
            body = pair[body] if pair[body] >= 0 and ts[body].text != "{" else body
            body += 1
            if word == "type" and body < len(ts) and ts[body].text == "=":
                break
        end = _end_of_statement(ts, pair, j) if word == "type" else pair[body] if body < len(ts) and pair[body] >= 0 else j
        if name != "default":
            facts.definition(name, kinds[word], line, ts[end].line)
        if exported:
            facts.exported(name, default, line)
        if word in ("interface", "type", "enum"):
            spans.append((i, end, ""))
        if word == "class" and body < len(ts):
            heads = [ts[k + 1].text for k in range(j, body) if ts[k].text == "extends" and k + 1 < body]
            facts.bases(name, heads)
            _methods(facts, ts, pair, body, spans)
        elif word == "function":
            spans.append((i, end, name))
        return end
    if word in ("const", "let", "var"):
        end = _end_of_statement(ts, pair, i)
        j = i + 1
        while j <= end and ts[j].kind == "name":
            name, at = ts[j].text, ts[j].line
            k = j + 1
            while k <= end and ts[k].text not in ("=", ","):
                k = pair[k] if pair[k] >= 0 else k
                k += 1
            value = k + 1
            stop = value
            while stop <= end and ts[stop].text != ",":
                stop = pair[stop] if pair[stop] >= 0 else stop
                stop += 1
            stop = min(stop - 1, end)
            function = k <= end and ts[k].text == "=" and _is_function_value(ts, pair, value)
            facts.definition(name, "Function" if function else "Constant", at, ts[max(stop, j)].line)
            if exported:
                facts.exported(name, default, at)
            if function:
                spans.append((value, stop, name))
            j = stop + 2
        return end
    return start - 1


def _methods(facts: Facts, ts: list[Token], pair: list[int], body: int, spans: list[tuple[int, int, str]]) -> None:
    j, end = body + 1, pair[body]
    while 0 <= j < end:
        if ts[j].kind == "name" and ts[j].text not in MODIFIERS and j + 1 < end and ts[j + 1].text == "(" and pair[j + 1] >= 0:
            k = pair[j + 1] + 1
            while k < end and ts[k].text not in ("{", ";", "="):
                k = pair[k] + 1 if pair[k] >= 0 else k + 1
            if k < end and ts[k].text == "{" and pair[k] >= 0:
                facts.definition(ts[j].text, "Function", ts[j].line, ts[pair[k]].line)
                spans.append((j + 1, pair[k], ts[j].text))
                j = pair[k] + 1
                continue
            j = k
        j = pair[j] + 1 if pair[j] >= 0 else j + 1


def _export(facts: Facts, ts: list[Token], pair: list[int], i: int, spans: list[tuple[int, int, str]]) -> int:
    line, j = ts[i].line, i + 1
    default = j < len(ts) and ts[j].text == "default"
    j += default
    if j < len(ts) and ts[j].text == "type" and j + 1 < len(ts) and ts[j + 1].text == "{":
        j += 1
    if j < len(ts) and ts[j].text in ("{", "*"):
        names = _named(ts, j, pair[j]) if ts[j].text == "{" else [("*", None)]
        k = pair[j] + 1 if ts[j].text == "{" else j + 1
        while k < len(ts) and ts[k].text in ("as",) or (k < len(ts) and ts[k - 1].text == "as"):
            k += 1
        source = unquoted(ts[k + 1]) if k + 1 < len(ts) and ts[k].text == "from" and ts[k + 1].kind == "string" else None
        for name, alias in names:
            facts.exported(alias or name, (alias or name) == "default", line, source)
        return k + 1 if source else k - 1
    end = _declaration(facts, ts, pair, j, True, default, spans)
    if end >= j:
        return end
    if default and j < len(ts):
        facts.exported(ts[j].text if ts[j].kind == "name" else "default", True, line)
    return j


def extract(source: str) -> Facts:
    facts, ts = Facts(), tokens(source)
    pair = partners(ts)
    spans: list[tuple[int, int, str]] = []  # places of a function's text, and its name
    i = 0
    while i < len(ts):
        if ts[i].text == "import":
            i = _import(facts, ts, pair, i)
        elif ts[i].text == "export":
            i = _export(facts, ts, pair, i, spans)
        else:
            end = _declaration(facts, ts, pair, i, False, False, spans)
            i = end if end >= i else pair[i] if pair[i] >= 0 else i
        i += 1
    _nested_functions(ts, pair, spans)
    spans.sort(key=lambda s: (s[0], -s[1]))
    _calls(facts, source, ts, pair, spans)
    return facts


def _nested_functions(ts: list[Token], pair: list[int], spans: list[tuple[int, int, str]]) -> None:
    """Functions and arrow functions bound to a name below the top level."""
    known = {s[0] for s in spans}
    for i, t in enumerate(ts):
        if t.text == "function" and i not in known and i + 1 < len(ts) and ts[i + 1].kind == "name":
            j = i
            while j < len(ts) and ts[j].text != "{":
                j = pair[j] + 1 if pair[j] >= 0 else j + 1
            if j < len(ts) and pair[j] >= 0:
                spans.append((i, pair[j], ts[i + 1].text))
        elif t.text in ("const", "let", "var") and i + 3 < len(ts) and ts[i + 1].kind == "name" and ts[i + 2].text == "=" and i + 3 not in known and _is_function_value(ts, pair, i + 3):
            spans.append((i + 3, _end_of_statement(ts, pair, i + 3), ts[i + 1].text))


def _calls(facts: Facts, source: str, ts: list[Token], pair: list[int], spans: list[tuple[int, int, str]]) -> None:
    named = {s[0] for s in spans}
    open_spans: list[tuple[int, int, str]] = []
    at = 0
    for i, t in enumerate(ts):
        while at < len(spans) and spans[at][0] <= i:
            open_spans.append(spans[at])
            at += 1
        while open_spans and open_spans[-1][1] < i:
            open_spans.pop()
        if t.text != "(" or t.kind != "sign" or pair[i] < 0:
            continue
        found = chain_before(ts, i)
        if not found or i in named or found[0].split(".")[0] in NOT_CALLED and "." not in found[0]:
            continue
        callee, first = found
        before = ts[first - 1].text if first else ""
        if before in ("function", "new") or (pair[i] + 1 < len(ts) and ts[pair[i] + 1].text == "{" and before in ("{", "}", ";", "async", "static", "get", "set", "public", "private", "protected")):
            continue
        scope = open_spans[-1][2] if open_spans else None
        if scope == "":
            continue  # the body of a type has no calls
        facts.call(callee, ts[first].line, scope, arguments(source, ts, i, pair[i]))
        start = first - (before == "await")
        if start >= 3 and ts[start - 1].text == "=" and ts[start - 2].kind == "name" and ts[start - 3].text in ("const", "let", "var"):
            facts.assignment(ts[start - 2].text, callee, ts[first].line, scope)
