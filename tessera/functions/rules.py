"""Path predicates as data.

A rule set is a list of (test, values): the path matches if any value passes
its test. The same rules compile to Catalyst expressions and to SQL text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, tuple[str, ...]]]


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; the whole name without one."""
    return F.substring_index(filename(path), ".", -1)


def either(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def matches(path: Column, rules: Rules) -> Column:
    """Whether the lower-case path passes any rule."""
    lower = F.lower(path)
    name, ext = filename(lower), extension(lower)

    def passes(test: str, values: tuple[str, ...]) -> Column:
        if test == "name":
            return name.isin(*values)
        if test == "ext":
            return ext.isin(*values)
        of, how = test.split("_")
        # One expression for each rule keeps the generated code small.
        words = "|".join(map(re.escape, values))
        pattern = {"has": words, "starts": f"^(?:{words})", "ends": rf"(?:{words})\z"}[how]
        return {"path": lower, "name": name}[of].rlike(pattern)

    return either(*[passes(t, vs) for t, vs in rules])


def sql(path: str, rules: Rules) -> str:
    """The same predicate as DuckDB SQL over an SQL expression."""
    lower = f"lower({path})"
    name = f"split_part({lower}, '/', -1)"
    ext = f"split_part({name}, '.', -1)"

    def quoted(v: str) -> str:
        return "'" + v.replace("'", "''") + "'"

    def passes(test: str, values: tuple[str, ...]) -> str:
        if test in ("name", "ext"):
            return f"{name if test == 'name' else ext} IN ({', '.join(map(quoted, values))})"
        of, how = test.split("_")
        function = {"has": "contains", "starts": "starts_with", "ends": "ends_with"}[how]
        return " OR ".join(f"{function}({lower if of == 'path' else name}, {quoted(v)})" for v in values)

    return "(" + " OR ".join(passes(t, vs) for t, vs in rules) + ")"


def under(*directories: str) -> Rules:
    """Files below directories of these names, at the root or deeper."""
    return [("path_has", tuple(f"/{d}/" for d in directories)), ("path_starts", tuple(f"{d}/" for d in directories))]
