"""Facts of Python files by the standard library's parser, around lines that it rejects."""

from __future__ import annotations

import ast

from .facts import Facts


def dotted(node: ast.expr) -> str | None:
    """Text of a name or attribute chain; None for other callees."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = dotted(node.value)
        return f"{base}.{node.attr}" if base else None
    if isinstance(node, ast.Call):
        base = dotted(node.func)
        return f"{base}()" if base else None
    return None


class _Walk(ast.NodeVisitor):
    def __init__(self, facts: Facts, source: str) -> None:
        self.facts, self.source, self.scope = facts, source, None

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        for d in node.decorator_list:
            self.visit(d)
        outer, self.scope = self.scope, node.name
        for child in [node.args, *node.body]:
            self.visit(child)
        self.scope = outer

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Call(self, node: ast.Call) -> None:
        callee = dotted(node.func)
        if callee:
            given = [ast.get_source_segment(self.source, a) or "" for a in [*node.args, *(k.value for k in node.keywords)]]
            self.facts.call(callee, node.lineno, self.scope, given)
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        value = node.value.value if isinstance(node.value, ast.Await) else node.value
        callee = dotted(value.func) if isinstance(value, ast.Call) else None
        for target in node.targets:
            if callee and isinstance(target, ast.Name):
                self.facts.assignment(target.id, callee, node.lineno, self.scope)
        self.generic_visit(node)


def _define(facts: Facts, body: list[ast.stmt], inside_class: bool = False) -> None:
    for node in body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            facts.definition(node.name, "Function", node.lineno, node.end_lineno or node.lineno)
        elif isinstance(node, ast.ClassDef) and not inside_class:
            facts.definition(node.name, "Class", node.lineno, node.end_lineno or node.lineno)
            facts.bases(node.name, [b for b in map(dotted, node.bases) if b])
            _define(facts, node.body, True)


def _parsed(source: str) -> tuple[ast.Module, str]:
    """The tree of a source, and the source it is of: lines that the grammar
    rejects give way to `pass`. Raises the first error where nothing else is left."""
    lines, first, changed = source.split("\n"), None, set()
    while True:
        text = "\n".join(lines)
        try:
            tree = ast.parse(text)
        except SyntaxError as e:
            first = first or e
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            while at >= 0 and (at in changed or not lines[at].strip()):
                at -= 1
            if at < 0:
                raise first from None
            changed.add(at)
            lines[at] = lines[at][: len(lines[at]) - len(lines[at].lstrip())] + "pass"
            continue
        if first and all(isinstance(n, ast.Pass) for n in tree.body):
            raise first
        return tree, text


def extract(source: str) -> Facts:
    facts = Facts()
    tree, source = _parsed(source)
    _define(facts, tree.body)
    for node in tree.body:
        if isinstance(node, ast.Import):
            facts.imported(node.names[0].name, [(a.name, a.asname) for a in node.names], False, True, node.lineno)
        elif isinstance(node, ast.ImportFrom):
            facts.imported("." * node.level + (node.module or ""), [(a.name, a.asname) for a in node.names], False, False, node.lineno)
    _Walk(facts, source).visit(tree)
    return facts
