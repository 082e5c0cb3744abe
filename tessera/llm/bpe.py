"""BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring symbols that occurs inside no vocabulary token can never
be merged across, directly or by later merges. Such pairs mark certain cuts:
the fragments between them are encoded independently, remembered, and
concatenated, with exactly the ids that merging the whole word would give.

White space is a certain cut as well, so texts are taken apart at it first and
what was seen before is looked up whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

#: Entries that a worker remembers before it starts afresh.
REMEMBERED = 400_000

#: White space by the Unicode property; str.split() also takes the separators 1C to 1F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{SPACE}]+")
_ODD = re.compile(r"[\x1c-\x1f]")


# Capital letters newer than Python's tables, from their first to
# their last code point, with the lower-case form of the first.
NEWER_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A),
    (0xA7CB, 0xA7CB, 0x0264),
    (0xA7CC, 0xA7CC, 0xA7CD),
    (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB),
    (0xA7DC, 0xA7DC, 0x019B),
    (0x10D50, 0x10D65, 0x10D70),
    (0x16EA0, 0x16EB8, 0x16EBB),
]
#: A final sigma is none here: lower-casing looks at single code points.
_LOWER_FIRST = {0x03A3: 0x03C3} | {c: low + c - a for a, b, low in NEWER_CAPITALS for c in range(a, b + 1)}
_NEEDS_CARE = re.compile("[%s]" % "".join(map(chr, _LOWER_FIRST)))


def lower(text: str) -> str:
    """Each code point's own lower-case form."""
    if _NEEDS_CARE.search(text):
        text = text.translate(_LOWER_FIRST)
    return text.lower()


# Letters and numbers newer than Python's tables.
NEWER = {
    "L": [
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
        (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
        (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
        (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}


def category_class(major: str) -> str:
    """The inside of a character class with all code points of a major category."""
    runs: list[list[int]] = [list(r) for r in NEWER[major]]
    runs.append([-1, -1])
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == major:
            if runs and c == runs[-1][1] + 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs if a >= 0)


def word_pattern(source: str) -> re.Pattern[str]:
    """A split pattern whose \\p{L}, \\p{N} and \\s are spelled out for Python's matcher."""
    source = source.replace(r"\s", SPACE)
    for major in "LN":
        inside = category_class(major)
        source = source.replace(rf"[\p{{{major}}}]", f"[{inside}]").replace(rf"\p{{{major}}}", inside)
    return re.compile(source)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others follow from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, extra = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in names:
            names[b] = chr(extra)
            extra += 1
    return [names[b] for b in range(256)]


_NEVER = 1 << 60


class WordEndBPE:
    """Encoder and decoder of a tokenizer file: byte symbols, lower case, a
    suffix at word ends, added tokens cut out of the raw text first."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {p: i for i, p in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        self.bytes = dict(enumerate(byte_symbols()))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = word_pattern(split["pattern"]["Regex"])
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or "(?!)")
        self.joined = self._pairs_inside_tokens()
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[str, tuple[int, ...]] = {}

    def _symbols(self, token: str) -> list[str]:
        """Single symbols of a token; the last carries the word-end suffix."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _pairs_inside_tokens(self) -> set[tuple[str, str]]:
        inside: set[tuple[str, str]] = set()
        for token in self.vocab:
            symbols = self._symbols(token)
            inside.update(zip(symbols, symbols[1:]))
        return inside

    def split_certain(self, symbols: list[str]) -> Iterator[list[str]]:
        """Fragments between the pairs that no token contains."""
        joined, at = self.joined, 0
        for i, pair in enumerate(zip(symbols, symbols[1:]), 1):
            if pair not in joined:
                yield symbols[at:i]
                at = i
        if symbols:
            yield symbols[at:]

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge by rank, leftmost first."""
        return self._merge_short(list(symbols)) if len(symbols) <= 64 else self._merge_long(symbols)

    def _merge_short(self, parts: list[str]) -> list[str]:
        get = self.ranks.get
        ranks = [get(p, _NEVER) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != _NEVER:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), _NEVER)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), _NEVER)
        return parts

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap over a linked list, for long fragments."""
        n = len(symbols)
        parts: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]

    def _fragment(self, symbols: list[str]) -> tuple[int, ...]:
        """Ids of one fragment; fragments of common length are remembered."""
        key = "".join(symbols)
        ids = self.fragments.get(key)
        if ids is None:
            ids = tuple([self.vocab[p] for p in self.merge(symbols) if p in self.vocab])
            if len(self.fragments) >= REMEMBERED:
                self.fragments.clear()
            if len(symbols) <= 64:
                self.fragments[key] = ids
        return ids

    def _plain(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk without white space or added tokens."""
        found: list[tuple[int, ...]] = []
        for word in self.words.findall(lower(unicodedata.normalize("NFC", chunk))):
            symbols = list(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.bytes))
            symbols[-1] += self.suffix
            found += [self._fragment(fragment) for fragment in self.split_certain(symbols)]
        return found[0] if len(found) == 1 else tuple(chain.from_iterable(found))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        if self.special.search(chunk):
            ids: list[int] = []
            at = 0
            for m in self.special.finditer(chunk):
                ids += [*self._plain(chunk[at : m.start()]), self.added[m[0]]]
                at = m.end()
            return tuple(ids) + self._plain(chunk[at:])
        out = self._plain(chunk)
        if len(self.chunks) >= REMEMBERED:
            self.chunks.clear()
        if len(chunk) <= 64:
            self.chunks[chunk] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null and empty texts have none."""
        if not text:
            return []
        chunks = text.split() if not _ODD.search(text) else [c for c in _SPACE.split(text) if c]
        known, ids = self.chunks.get, []
        for chunk in chunks:
            found = known(chunk)
            ids.extend(found if found is not None else self._chunk(chunk))
        return ids

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space, as for tokenizer files without a decoder.

        Ids outside the vocabulary are passed over.
        """
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


def _loaded(source: str) -> WordEndBPE:
    """One encoder for each tokenizer and Python worker."""
    return kept(f"bpe-{hashlib.sha256(source.encode()).hexdigest()}", lambda: WordEndBPE(source))


def _mapped(df: DataFrame, path: str, column: str, keep: list[str] | None, extra: dict[str, str], one) -> DataFrame:
    """Kept columns and what `one(encoder, value)` returns for each row."""
    keep = [c for c in df.columns if c != column] if keep is None else keep
    cols = [F.col(f"`{c}`") for c in keep]
    schema = df.select(*cols, *[F.lit(None).cast(t).alias(c) for c, t in extra.items()]).schema
    with open(path, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary of a few MB at most
    kinds = [pa.list_(pa.int32()) if t == "array<int>" else pa.int64() if t == "bigint" else pa.string() for t in extra.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(source.value)
        for batch in batches:
            # A few rows at a time, so that long texts never pile up as Python objects.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [one(encoder, x.as_py()) for x in part.column(len(keep))]
                made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], [*keep, *extra])

    return df.select(*cols, F.col(f"`{column}`").alias("__value")).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` and `ids`, the token ids of the whole text.

    Null and empty texts have no ids. One row out for each row in. `path`
    names the tokenizer file on the driver; workers get it by broadcast.
    """
    return _mapped(df, path, text, keep, {"ids": "array<int>"}, lambda e, x: (e.encode(x),))


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` and `decoded`, the text of the ids; null ids decode to an empty text."""
    return _mapped(df, path, ids, keep, {"decoded": "string"}, lambda e, x: (e.decode(x or []),))


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep`, n_tokens, and digests of the ids and of what they decode to."""

    def one(encoder: WordEndBPE, value: str | None) -> tuple:
        ids = encoder.encode(value)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(encoder.decode(ids).encode()).hexdigest()

    return _mapped(df, path, text, keep, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, one)
