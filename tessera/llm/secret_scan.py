"""Secret scans by multipart credential linking.

Strong parts (assignments, access identifiers, long hexadecimal runs) are
reported wherever they stand. Weak candidates - unnamed random-looking tokens,
service endpoints and account names - are reported only where the complementary
parts of one credential co-occur: an interval join inside a scope links an
identifier, a secret and an endpoint whose distance is within reach.

A scope is a run of lines without a blank line between them.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "secret", "endpoint", "account")
BASE = KINDS[:3]
#: Code points between two parts of one credential at most, and the least entropy of a weak secret in bits a character.
REACH = 240
ENTROPY = 3.5

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
# A run is matched from its first digit, so 16 digits and more are whole runs.
HEX = re.compile(r"[0-9a-f]{16,}")
WEAK = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
ENDPOINT = re.compile(r"(?:https?|wss?|ftp|jdbc:[a-z]+|amqp|redis|mongodb)://[^\s\"'<>|]+")
ACCOUNT = re.compile(r"""(?<![A-Za-z0-9])(?:[Uu]ser(?:_?[Nn]ame)?|[Ll]ogin|[Cc]lient_?[Ii][Dd]|[Aa]ccount(?:_?[Ii][Dd])?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}""")
BLANK = re.compile(r"\n[\x20\t\r]*\n")


class Span(NamedTuple):
    start: int
    order: int
    end: int

    def text(self) -> str:
        return f"{KINDS[self.order]}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    """Strong parts by start, then kind."""
    found = [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def _near(spans: list[Span], to: list[Span]) -> list[Span]:
    """Those of `spans`, ascending and disjoint, whose gap to some span of `to` is within reach."""
    ends, starts = [s.end for s in spans], [s.start for s in spans]
    found: set[Span] = set()
    for t in to:
        found.update(spans[bisect_left(ends, t.start - REACH) : bisect_right(starts, t.end + REACH)])
    return sorted(found)


def _scopes(text: str, marks: list[Span]) -> Iterator[tuple[int, int, list[Span]]]:
    """Bounds of each scope that holds marks, with the marks that start in it."""
    bounds = [0] + [m.end() for m in BLANK.finditer(text)] + [len(text) + 1]
    held: dict[int, list[Span]] = {}
    for s in marks:
        held.setdefault(bisect_right(bounds, s.start) - 1, []).append(s)
    for at, some in held.items():
        yield bounds[at], min(bounds[at + 1], len(text)), some


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts that complete a credential with a complementary part of their scope.

    - An endpoint beside an access identifier, or beside a named or hexadecimal secret.
    - A weak secret beside an access identifier, beside an endpoint that itself
      stands beside one, or beside an account name.
    - An account name beside a named, hexadecimal or weak secret.
    - An endpoint beside a weak secret that stands beside an account name.

    Beside means within `REACH` code points in one scope. A part alone, and a
    weak secret with an endpoint alone, never make a credential.
    """
    accounts = [Span(m.start(), 5, m.end()) for m in ACCOUNT.finditer(text)]
    if not base and not accounts:
        return []
    found: set[Span] = set()
    for lo, hi, marks in _scopes(text, sorted([*base, *accounts])):
        strong = [s for s in marks if s.order < 3]
        names = _free([s for s in marks if s.order == 5], strong)
        ends = _free([Span(m.start(), 4, m.end()) for m in ENDPOINT.finditer(text, lo, hi)], strong)
        tokens = (Span(m.start(), 3, m.end()) for m in WEAK.finditer(text, lo, hi) if any(c.isdigit() for c in m[0]) and entropy(m[0]) >= ENTROPY)
        weak = _free(list(tokens), [*strong, *names])
        access, secrets = [s for s in strong if s.order == 1], [s for s in strong if s.order != 1]
        owned = _near(weak, names)
        found.update(_near(ends, [*access, *secrets, *owned]), owned, _near(weak, [*access, *_near(ends, access)]), _near(names, [*secrets, *weak]))
    return sorted(found)


def _free(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of `spans` that overlap none of `taken`."""
    merged: list[list[int]] = []
    for s in sorted(taken):
        if merged and s.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.end)
        else:
            merged.append([s.start, s.end])

    def clear(s: Span) -> bool:
        i = bisect_left(merged, [s.end])
        return i == 0 or merged[i - 1][1] <= s.start

    return [s for s in spans if clear(s)]


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start, then kind; null is empty."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted({*base, *linked_spans(text, base)})


def _join(spans: list[Span]) -> str:
    return ",".join(s.text() for s in spans)


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` with n_assign, n_access, n_hex, base_sha256 and spans.

    Offsets count code points, ends exclusive. Null and empty texts have no
    spans. One row out for each row in, so repeated rows and ids stay apart;
    kept columns come first and must not be named like the outputs.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    cols = [F.col(f"`{c}`") for c in keep]
    zero = F.lit(0).cast("bigint")
    schema = df.select(*cols, zero.alias("n_assign"), zero.alias("n_access"), zero.alias("n_hex"), F.lit("").alias("base_sha256"), F.lit("").alias("spans")).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for x in batch.column(len(keep)):
                base, every = scan_text(x.as_py())
                for i in range(3):
                    counts[i].append(sum(s.order == i for s in base))
                digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
                spans.append(_join(every))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names)

    return df.select(*cols, F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def redact_text(text: str, mark: str = "[secret]") -> str:
    out, at = [], 0
    for s in scan_text(text)[1]:
        if s.end <= at:
            continue
        out += [text[at : s.start], mark] if s.start >= at else []
        at = s.end
    return "".join(out) + text[at:] if out else text


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """`df` with every span replaced by `mark`, overlapping spans by one.

    Rows without spans pass unchanged; a column `n_chars` follows the new text.
    """
    names, where = df.columns, df.columns.index(text)
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(where).to_pylist()
            new = [redact_text(x, mark) if x else x for x in old]
            columns = list(batch.columns)
            columns[where] = pa.array(new, batch.schema.field(where).type)
            if size is not None:
                was = batch.column(size).to_pylist()
                columns[size] = pa.array([w if a == b else len(b) for w, a, b in zip(was, old, new)], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema)
