"""Facts of Rust, Java, C#, PHP, Kotlin, Swift, Scala, Ruby, C and C++ files.

Each language is a row of patterns: what an import looks like, which words
open a definition, and how a function is declared. Bodies are found by their
braces (or `end` in Ruby); calls are names before parentheses.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .facts import Facts
from .tokens import Token, arguments, chain_before, partners, tokens

Names = list[tuple[str, str | None]]
CONTROL = {"if", "for", "foreach", "while", "switch", "catch", "return", "match", "when", "guard", "sizeof", "typeof", "throw", "new", "using", "lock", "fixed", "synchronized", "elseif", "unless", "until", "echo", "else", "do", "try", "in", "is", "as", "and", "or", "not", "defined"}


def last_part(*separators: str) -> Callable[[re.Match[str]], tuple[str, Names, bool]]:
    """An import named by the last part of its source; `*` takes the whole."""

    def build(m: re.Match[str]) -> tuple[str, Names, bool]:
        source, alias = m["source"], m.groupdict().get("alias")
        name = source
        for s in separators:
            name = name.rsplit(s, 1)[-1]
        return source, [(name, alias)], name in ("*", "_")

    return build


def whole(m: re.Match[str]) -> tuple[str, Names, bool]:
    return m["source"], [], True


def listed(m: re.Match[str]) -> tuple[str, Names, bool]:
    """`base{a, b as c}` or `base.{a, b => c}`."""
    names: Names = []
    for part in m["names"].split(","):
        words = re.split(r"\s+as\s+|\s*=>\s*", part.strip())
        if words[0]:
            names.append((words[0].rsplit("::", 1)[-1].rsplit("\\", 1)[-1], words[1] if len(words) > 1 else None))
    return m["source"], names, False


_TREE = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<tree>[^;]*\{[^;]*)", re.MULTILINE)


def use_trees(source: str) -> list[tuple[int, str, Names, bool]]:
    """(line, source, names, whole) of Rust use statements with braces: one import
    for each path that leaves stand under, in the order in which these are met."""
    found = []
    for m in _TREE.finditer(source):
        line = source.count("\n", 0, m.start("tree")) + 1
        text = re.sub(r"//[^\n]*|/\*.*?\*/", " ", m["tree"], flags=re.DOTALL)
        groups: dict[str, Names] = {}
        _leaves(re.findall(r"[\w*]+|::|[{},]", text), 0, [], groups)
        found += [(line, path, names, [n for n, _ in names] == ["*"]) for path, names in groups.items()]
    return found


def _leaves(parts: list[str], i: int, prefix: list[str], groups: dict[str, Names]) -> int:
    """Read the items of one list of a use tree from place i; returns the place after it."""
    path: list[str] = []
    alias = None
    while True:
        part = parts[i] if i < len(parts) else "}"
        if part in (",", "}"):
            if path:
                groups.setdefault("::".join([*prefix, *path[:-1]]), []).append((path[-1], alias))
            path, alias = [], None
            if part == "}":
                return i + 1
        elif part == "{":
            i = _leaves(parts, i + 1, [*prefix, *path], groups)
            path = []
            continue
        elif part == "as" and path and i + 1 < len(parts):
            alias, i = parts[i + 1], i + 1
        elif part != "::":
            path.append(part)
        i += 1


@dataclass(frozen=True)
class Language:
    imports: tuple[tuple[str, Callable], ...]
    types: dict[str, str] = field(default_factory=dict)
    functions: tuple[str, ...] = ()  # words before a function's name
    bare_functions: bool = False  # `type name(...) {` as in Java and C
    constants: tuple[str, ...] = ()


CLASSES = {"class": "Class", "interface": "Interface", "enum": "Class", "struct": "Struct"}
LANGUAGES = {
    "Rust": Language(
        ((r"^\s*(?:pub\s+)?use\s+(?P<source>[\w:]+(?:::\*)?)(?:\s+as\s+(?P<alias>\w+))?\s*;", last_part("::")), (r"^\s*(?:pub\s+)?mod\s+(?P<source>\w+)\s*;", whole)),
        {"struct": "Struct", "enum": "Class", "trait": "Interface", "union": "Struct", "type": "TypeAlias"}, ("fn",), False, ("const", "static"),
    ),
    "Java": Language(((r"^\s*import\s+(?:static\s+)?(?P<source>[\w.]+(?:\.\*)?)\s*;", last_part(".")),), {"class": "Class", "interface": "Interface", "enum": "Class", "record": "Class"}, (), True),
    "CSharp": Language(((r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<source>[\w.]+)\s*;", last_part(".")),), {**CLASSES, "record": "Class"}, (), True),
    "Php": Language(
        ((r"^\s*use\s+(?:function\s+|const\s+)?(?P<source>[\w\\]+)\\\{(?P<names>[^}]*)\}", listed), (r"^\s*use\s+(?:function\s+|const\s+)?(?P<source>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;", last_part("\\")), (r"""^\s*(?:require|include)(?:_once)?\s*\(?\s*['"](?P<source>[^'"]+)['"]""", whole)),
        {"class": "Class", "interface": "Interface", "trait": "Interface", "enum": "Class"}, ("function",), False, ("const",),
    ),
    "Ruby": Language(((r"""^\s*(?:require|require_relative|load)\s*\(?\s*['"](?P<source>[^'"]+)['"]""", whole), (r"^\s*(?:include|extend)\s+(?P<source>[A-Z][\w:]*)", last_part("::"))), {"class": "Class", "module": "Class"}, ("def",)),
    "Kotlin": Language(((r"^\s*import\s+(?P<source>\w+(?:\.\w+)*(?:\.\*)?)(?:\s+as\s+(?P<alias>\w+))?", last_part(".")),), {"class": "Class", "interface": "Interface", "object": "Class", "typealias": "TypeAlias"}, ("fun",), False, ("val", "var")),
    "Swift": Language(((r"^\s*(?:@testable\s+)?import\s+(?:class\s+|struct\s+|func\s+|enum\s+)?(?P<source>[\w.]+)", last_part(".")),), {"class": "Class", "struct": "Struct", "protocol": "Interface", "enum": "Class", "actor": "Class", "typealias": "TypeAlias"}, ("func",), False, ("let", "var")),
    "Scala": Language(((r"^\s*import\s+(?P<source>[\w.]+)\.\{(?P<names>[^}]*)\}", listed), (r"^\s*import\s+(?P<source>[\w.]+(?:\.[_*])?)", last_part("."))), {"class": "Class", "trait": "Interface", "object": "Class", "type": "TypeAlias"}, ("def",), False, ("val",)),
    "C": Language(((r"""^\s*#\s*include\s*[<"](?P<source>[^>"]+)[>"]""", whole),), {"struct": "Struct", "enum": "Class", "union": "Struct"}, (), True),
    "Cpp": Language(((r"""^\s*#\s*include\s*[<"](?P<source>[^>"]+)[>"]""", whole), (r"^\s*using\s+(?:namespace\s+)?(?P<source>[\w:]+)\s*;", last_part("::"))), {"class": "Class", "struct": "Struct", "enum": "Class", "union": "Struct"}, (), True),
}


def extract(language: str, source: str) -> Facts:
    rules, facts = LANGUAGES[language], Facts()
    found = []
    taken: set[int] = set()
    if language == "Rust":
        found = use_trees(source)
        taken = {line for line, *_ in found}
    for pattern, build in rules.imports:
        for m in re.finditer(pattern, source, re.MULTILINE):
            line = source.count("\n", 0, m.start("source")) + 1
            if line not in taken:
                taken.add(line)
                found.append((line, *build(m)))
    for line, origin, names, space in sorted(found, key=lambda f: f[0]):
        facts.imported(origin, names, False, space, line)
    text = re.sub(r"(?m)#[^\n]*$", "", source) if language in ("Ruby", "C", "Cpp") else source
    ts = tokens(text)
    pair = partners(ts)
    spans = _ruby(facts, ts, rules) if language == "Ruby" else _definitions(facts, ts, pair, rules)
    _calls(facts, text, ts, pair, spans, taken)
    return facts


def _body(ts: list[Token], pair: list[int], i: int) -> tuple[int, int]:
    """Opening and closing place of the braces that follow; the statement's end twice without."""
    j = i
    while j < len(ts) and ts[j].text not in ("{", ";"):
        if pair[j] >= 0:
            j = pair[j]
        elif ts[j].text == "=" and ts[j].kind == "sign":
            end = j
            while end + 1 < len(ts) and ts[end + 1].line == ts[j].line:
                end = pair[end + 1] if pair[end + 1] >= 0 else end + 1
            return end, end
        j += 1
    if j < len(ts) and ts[j].text == "{" and pair[j] >= 0:
        return j, pair[j]
    return min(j, len(ts) - 1), min(j, len(ts) - 1)


def _definitions(facts: Facts, ts: list[Token], pair: list[int], rules: Language) -> list[tuple[int, int, str]]:
    spans: list[tuple[int, int, str]] = []
    i = 0
    inside: list[int] = []
    while i < len(ts):
        while inside and inside[-1] < i:
            inside.pop()
        t = ts[i]
        following = ts[i + 1] if i + 1 < len(ts) else None
        if t.text in rules.types and following and following.kind == "name" and (i == 0 or ts[i - 1].text not in (".", "->")):
            if following.text == "class" and i + 2 < len(ts):  # `enum class`
                i += 1
                following = ts[i + 1]
            start, end = _body(ts, pair, i + 2)
            if start < len(ts) and (ts[start].text != ";" or rules.types[t.text] == "TypeAlias" or "fn" in rules.functions):
                facts.definition(following.text, rules.types[t.text], t.line, ts[end].line)
        elif t.text in rules.functions and following and following.kind == "name":
            name = following.text
            _, end = _body(ts, pair, i + 2)
            facts.definition(name, "Function", t.line, ts[end].line)
            spans.append((i + 1, end, name))
            inside.append(end)
        elif rules.bare_functions and t.kind == "name" and following and following.text == "(" and pair[i + 1] >= 0 and t.text not in CONTROL and not inside:
            j = pair[i + 1] + 1
            while j < len(ts) and (ts[j].kind == "name" or ts[j].text in (",", ".", ":", "<", ">", "[", "]", "::")) and ts[j].text not in ("return",):
                j += 1
            typed = i > 0 and (ts[i - 1].kind == "name" and ts[i - 1].text not in {"new", "return", "else", "throw"} or ts[i - 1].text in (">", "*", "&", "]", ":"))
            constructor = i > 0 and ts[i - 1].text in ("{", "}", ";", "public", "private", "protected")
            if j < len(ts) and ts[j].text == "{" and pair[j] >= 0 and (typed or constructor):
                facts.definition(t.text, "Function", t.line, ts[pair[j]].line)
                spans.append((i, pair[j], t.text))
                inside.append(pair[j])
        elif t.text in rules.constants and following and following.kind == "name" and not inside:
            name = ts[i + 2] if following.text == "mut" and i + 2 < len(ts) else following
            facts.definition(name.text, "Constant", t.line, t.line)
        i += 1
    return spans


def _ruby(facts: Facts, ts: list[Token], rules: Language) -> list[tuple[int, int, str]]:
    """Ruby's bodies end with `end`; words that open one count when they begin a line or follow `=`."""
    spans, stack = [], []
    for i, t in enumerate(ts):
        begins = i == 0 or ts[i - 1].line < t.line or ts[i - 1].text in ("=", "private", "public", "protected")
        if t.text in ("class", "module", "def", "if", "unless", "while", "until", "case", "begin", "for") and begins or t.text == "do":
            j = i + 1
            if t.text == "def" and j + 2 < len(ts) and ts[j].text == "self" and ts[j + 1].text == ".":
                j += 2
            stack.append((t.text, i, j))
        elif t.text == "end" and stack and (i == 0 or ts[i - 1].text != "."):
            word, start, at = stack.pop()
            if word in rules.types or word in rules.functions:
                kind = rules.types.get(word, "Function")
                facts.definition(ts[at].text, kind, ts[start].line, t.line)
                if kind == "Function":
                    spans.append((at, i, ts[at].text))
    facts.rows["definitions"].sort(key=lambda d: d["start_line"])
    for n, row in enumerate(facts.rows["definitions"]):
        row["pos"] = n
    return spans


def _calls(facts: Facts, source: str, ts: list[Token], pair: list[int], spans: list[tuple[int, int, str]], import_lines: set[int]) -> None:
    spans.sort(key=lambda s: (s[0], -s[1]))
    declared = {s[0] for s in spans}
    open_spans: list[tuple[int, int, str]] = []
    at = 0
    for i, t in enumerate(ts):
        while at < len(spans) and spans[at][0] <= i:
            open_spans.append(spans[at])
            at += 1
        while open_spans and open_spans[-1][1] < i:
            open_spans.pop()
        if t.text != "(" or t.kind != "sign" or pair[i] < 0 or t.line in import_lines:
            continue
        before = i - 1
        if before >= 0 and ts[before].text == "!":  # a macro
            before -= 1
        found = chain_before(ts, before + 1)
        if not found or found[1] in declared or found[0] in CONTROL:
            continue
        callee, first = found
        # Paths such as a::b and $a->b are one callee.
        while first >= 2 and ts[first - 1].text in (":", ">", "?.", "\\"):
            sign, step = ("::", 3) if ts[first - 1].text == ":" and ts[first - 2].text == ":" else ("->", 3) if ts[first - 1].text == ">" and ts[first - 2].text == "-" else ("\\", 2) if ts[first - 1].text == "\\" else ("", 0)
            if not step or first < step or ts[first - step].kind != "name":
                break
            head = chain_before(ts, first - step + 1)
            if not head:
                break
            callee, first = f"{head[0]}{sign}{callee}", head[1]
        scope = open_spans[-1][2] if open_spans else None
        if scope is None and first and ts[first - 1].kind == "name" and ts[first - 1].text not in CONTROL and pair[i] + 1 < len(ts) and ts[pair[i] + 1].text == ";":
            continue  # a declaration without a body
        facts.call(callee, ts[first].line, scope, arguments(source, ts, i, pair[i]))
        first -= first > 0 and ts[first - 1].text == "await"
        if first >= 2 and ts[first - 1].text in ("=", ":=") and ts[first - 2].kind == "name":
            facts.assignment(ts[first - 2].text, callee, ts[first].line, scope)
