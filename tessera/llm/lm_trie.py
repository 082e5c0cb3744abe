"""Language-model scores from an Elias-Fano n-gram trie.

A model of order n with absolute discounting, interpolated down to add-one
unigrams, is counted over every training text and asked for every text:

1. Each task turns its texts into chunks: the chunk's words sorted by hash, and
   the texts as numbers of those words. Texts are read once.
2. Chunks send their word counts to shards by ranges of the word hash. Each
   shard answers every chunk with the totals and the numbers of the words it
   asked about. From then on a word is its number, which takes far fewer bytes
   than its hash.
3. Chunks send their distinct training n-grams, with counts, to shards by the
   first word; so all n-grams that begin alike meet. A prefix with
   more than a shard's share of all tokens is split over several shards by the
   word that follows it.
4. Each shard's counts become its part of the trie, a table in the shared
   folder: a level for each order holds monotone pointers and, for each
   context, the following words, made monotone by the end of the context
   before; both are Elias-Fano coded. Discounted probabilities and back-off
   weights are quantised.
5. Chunks send their distinct n-grams to the same shards, which map their part
   of the trie into memory and find each n-gram by successor search relative
   to its context, in the coded form. This takes rounds of some shards each, so
   that requests and trie are never under way as a whole. The chunks
   interpolate what they get.

Shards are sized by tokens. Nothing grows on the driver: it sees sums, and
prefixes that hold more than a shard's share of all tokens, of which there
cannot be more than shards for each length.
"""

from __future__ import annotations

import math
import mmap
import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Tokens after which a chunk ends; a longer text is a chunk of its own. Tokens for each shard.
CHUNK_TOKENS, SHARD_TOKENS = 1_500_000, 2_000_000
#: Rounds in which the shards answer.
ROUNDS = 2
#: Words that no text has: the end of a text, and what follows it in an n-gram.
END, PAD = b"\n", b"\r"
#: Steps of a quantised log10 probability in one unit; 16 bits reach down to 10**-32. The last code is no probability.
STEPS, NONE = 2048, 65535
#: Values coded at once.
SPAN = 1 << 18


def _start(k: int) -> bytes:
    """The word k places before the first one of a text."""
    return b"\t" * k


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _joined(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one buffer: kinds and lengths, then the arrays at multiples of 8 bytes."""
    head = np.array([len(arrays), *(v for a in arrays for v in (int.from_bytes(a.dtype.str[1:].encode(), "little"), len(a)))], "<i8")
    return head.tobytes() + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


def _parted(buffer: np.ndarray) -> list[np.ndarray]:
    """Views of the arrays in a buffer of bytes."""
    n = int(buffer[:8].view("<i8")[0])
    head, at, out = buffer[8 : 8 + 16 * n].view("<i8").tolist(), 8 + 16 * n, []
    for kind, size in zip(head[::2], head[1::2]):
        dtype = np.dtype("<" + kind.to_bytes(2, "little").decode())
        out.append(buffer[at : at + size * dtype.itemsize].view(dtype))
        at += size * dtype.itemsize + -size * dtype.itemsize % 8
    return out


def _planes(a: np.ndarray) -> np.ndarray:
    """Numbers byte by byte, as many bytes as the greatest needs; bytes of one place compress better together."""
    a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
    return a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.ravel()


def _from_planes(p: np.ndarray, n: int) -> np.ndarray:
    size = len(p) // max(n, 1)
    return np.ascontiguousarray(p.reshape(size, n).T).view(f"<u{size}").ravel().astype(np.int64) if n else np.empty(0, np.int64)


def _ascending(a: np.ndarray) -> np.ndarray:
    """Ascending numbers as the steps between them."""
    return _planes(np.diff(a, prepend=0))


def _from_ascending(p: np.ndarray, n: int) -> np.ndarray:
    return np.cumsum(_from_planes(p, n))


# --- the trie --------------------------------------------------------------------

_BYTES = np.arange(256, dtype=np.uint8)
#: Place of the k-th bit that is set in a byte.
_NTH = np.argsort(1 - np.unpackbits(_BYTES[:, None], axis=1, bitorder="little"), axis=1, kind="stable").astype(np.uint8)
#: A 1 in every byte of a word.
_ONES = np.uint64(0x0101010101010101)


def _nth_bit(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of the n-th set bit, from 0, of each 64-bit word."""
    n = n.astype(np.uint64)
    # Set bits of each byte, then of all bytes up to it.
    upto = words - (words >> np.uint64(1) & np.uint64(0x55) * _ONES)
    upto = (upto & np.uint64(0x33) * _ONES) + (upto >> np.uint64(2) & np.uint64(0x33) * _ONES)
    upto = (upto + (upto >> np.uint64(4)) & np.uint64(0x0F) * _ONES) * _ONES
    # The top bit of each byte whose sum is at most n.
    passed = (n * _ONES | np.uint64(0x80) * _ONES) - upto & np.uint64(0x80) * _ONES
    bit = np.minimum(np.bitwise_count(passed), 7).astype(np.uint64) << np.uint64(3)
    rest = n - (upto << np.uint64(8) >> bit & np.uint64(0xFF))
    return bit.astype(np.int64) + _NTH[words >> bit & np.uint64(0xFF), np.minimum(rest, np.uint64(7))]


class EliasFano:
    """A sorted sequence of n integers below a bound in about log2(bound / n) + 2 bits each.

    The low bits lie side by side; the high parts are in unary, one set bit for
    each value. Values are read and searched in this form.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        self.zeros = 64 * np.arange(len(high) + 1) - self.ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        bound = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (bound // max(n, 1)).bit_length() - 1)
        low, high = np.zeros(n * low_bits // 64 + 2, np.uint64), np.zeros((n + (bound >> low_bits)) // 64 + 2, np.uint64)
        for first in range(0, n, SPAN):
            v = values[first : first + SPAN].astype(np.uint64)
            at = np.arange(first, first + len(v))
            if low_bits:
                bit = at * low_bits
                word, off = bit >> 6, (bit & 63).astype(np.uint64)
                rest = v & np.uint64((1 << low_bits) - 1)
                _add(low, word, rest << off)
                _add(low, word + 1, rest >> np.uint64(1) >> (np.uint64(63) - off))
            up = (v >> np.uint64(low_bits)).astype(np.int64) + at
            _add(high, up >> 6, np.uint64(1) << (up & 63).astype(np.uint64))
        return cls(n, low_bits, low, high)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], "<i8"), self.low, self.high]

    @classmethod
    def viewed(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), arrays[1], arrays[2])

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.int64)
        bit = at * self.low_bits
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        both = (self.low[word] >> off) | (self.low[word + 1] << np.uint64(1) << (np.uint64(63) - off))
        return (both & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def read(self, at: np.ndarray) -> np.ndarray:
        """Values at some places."""
        word = np.searchsorted(self.ones, at, side="right") - 1
        up = 64 * word + _nth_bit(self.high[word], at - self.ones[word]) - at
        return (up << self.low_bits) | self._low(at)

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at some places and at the places after them."""
        word = np.searchsorted(self.ones, at, side="right") - 1
        bits = self.high[word]
        bit = _nth_bit(bits, at - self.ones[word])
        first = ((64 * word + bit - at) << self.low_bits) | self._low(at)
        # The next set bit is mostly one of the same word.
        rest = bits >> np.uint64(1) >> bit.astype(np.uint64)
        place = 64 * word + bit + 1 + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1))
        second = ((place - at - 1) << self.low_bits) | self._low(at + 1)
        other = np.flatnonzero(rest == 0)
        second[other] = self.read(at[other] + 1)
        return first, second

    def decode(self) -> np.ndarray:
        """All values."""
        return self.read(np.arange(self.n))

    def _below(self, up: np.ndarray) -> np.ndarray:
        """How many values have a high part below `up`."""
        n = np.maximum(up - 1, 0)  # the zero that ends the part before
        word = np.minimum(np.searchsorted(self.zeros, n, side="right") - 1, len(self.high) - 1)
        place = 64 * word + _nth_bit(~self.high[word], n - self.zeros[word])
        return np.where(up > 0, place - n, 0)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where it is none of the sequence."""
        up = values >> self.low_bits
        inside = (up <= ((self.high.size * 64 - self.n) - 1)) & (values >= 0)
        up = np.where(inside, up, 0)
        lo, rest = self._below(up), values & ((1 << self.low_bits) - 1)
        # The first value of this high part, if any, has its bit next.
        place = lo + up
        inside &= (lo < self.n) & (self.high[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1) > 0)
        out = np.full(len(values), -1)
        at = np.flatnonzero(inside)
        low = self._low(lo[at])
        same = at[low == rest[at]]
        out[same] = lo[same]
        # Elsewhere the successor among the values of the high part, by halving.
        at = at[low < rest[at]]
        lo, rest, end = lo[at] + 1, rest[at], self._below(up[at] + 1)
        hi, going = end.copy(), np.flatnonzero(lo < end)
        while len(going):
            mid = (lo[going] + hi[going]) >> 1
            less = self._low(mid) < rest[going]
            lo[going] = np.where(less, mid + 1, lo[going])
            hi[going] = np.where(less, hi[going], mid)
            going = going[lo[going] < hi[going]]
        there = np.flatnonzero(lo < end)
        there = there[self._low(lo[there]) == rest[there]]
        out[at[there]] = lo[there]
        return out


def _add(out: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """Add bits that do not overlap to words at ascending places."""
    if len(at):
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[new]] |= np.add.reduceat(bits, new)


class Level:
    """The followers of every context, as context-relative monotone values, with their codes.

    A follower is stored as word + 1 + base, where the base is the last value
    of the context before, so the whole level is one monotone sequence.
    """

    def __init__(self, pointers: EliasFano, followers: EliasFano, codes: np.ndarray, back_off: np.ndarray) -> None:
        self.pointers, self.followers, self.codes, self.back_off = pointers, followers, codes, back_off

    @classmethod
    def of(cls, parents: int, contexts: np.ndarray, words: np.ndarray, codes: np.ndarray, back_off: np.ndarray) -> Level:
        pointers = np.concatenate(([0], np.cumsum(np.bincount(contexts, minlength=parents))))
        return cls(EliasFano.of(pointers), EliasFano.of(words.astype(np.int64) + 1 + _bases(contexts, words)), codes.astype("<u2"), back_off.astype("<u2"))

    def arrays(self) -> list[np.ndarray]:
        return [*self.pointers.arrays(), *self.followers.arrays(), self.codes, self.back_off]

    @classmethod
    def viewed(cls, a: list[np.ndarray]) -> Level:
        return cls(EliasFano.viewed(a[:3]), EliasFano.viewed(a[3:6]), a[6], a[7])

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Place of each (context, word), contexts ascending; -1 for those not there and for contexts or words of -1."""
        out = np.full(len(contexts), -1)
        asked = np.flatnonzero((contexts >= 0) & (words >= 0))
        if not len(asked) or not self.followers.n:
            return out
        one = contexts[asked]
        new = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
        lo, hi = self.pointers.pairs(one[new])
        base = np.where(lo > 0, self.followers.read(np.maximum(lo, 1) - 1), 0)
        lo, hi, base = (np.repeat(x, np.diff(np.append(new, len(one)))) for x in (lo, hi, base))
        at = self.followers.find(words[asked] + 1 + base)
        met = (at >= lo) & (at < hi)
        out[asked[met]] = at[met]
        return out


class Trie:
    """Levels in one buffer that is mapped into memory.

    `words` is the number of words, `unigram` their codes. The first level holds
    the followers of words, each further one those of the level before; each
    comes as contexts and words, both ascending, codes, and the back-off codes
    of its contexts.
    """

    def __init__(self, folder: str | None, words: int, contexts: np.ndarray, followers: np.ndarray, codes: np.ndarray, unigram: np.ndarray, back_off: np.ndarray, deeper: tuple = ()) -> None:
        levels, parents = [], words
        for c, f, k, b in [(contexts, followers, codes, back_off), *deeper]:
            levels.append(Level.of(parents, c, f, k, b))
            parents = len(c)
        self._map(folder, _joined([unigram.astype("<u8"), *(a for x in levels for a in x.arrays())]))

    @classmethod
    def opened(cls, blob: bytes | np.ndarray, folder: str | None = None) -> Trie:
        trie = cls.__new__(cls)
        trie._map(folder, blob)
        return trie

    def _map(self, folder: str | None, blob: bytes | np.ndarray) -> None:
        """Map the buffer from a file of `folder`, or from memory that has no file."""
        self.path = None
        if folder is None:
            memory = mmap.mmap(-1, len(blob))
            memory.write(blob)
            whole = np.frombuffer(memory, np.uint8)
        else:
            handle, self.path = tempfile.mkstemp(prefix="trie-", dir=folder)
            with os.fdopen(handle, "wb") as f:
                f.write(blob)
            whole = np.memmap(self.path, np.uint8, "r")
        arrays = _parted(whole)
        self.unigram, self.levels, self.blob = arrays[0], [Level.viewed(arrays[i : i + 8]) for i in range(1, len(arrays), 8)], whole

    def close(self) -> None:
        self.unigram = self.levels = self.blob = None
        if self.path:
            os.unlink(self.path)

    def look_up(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Codes of bigrams sorted by (context, word): their own where the trie
        has them, else back-off and unigram together."""
        level = self.levels[0]
        at = level.find(contexts, words)
        return np.where(at >= 0, level.codes[np.maximum(at, 0)] if len(level.codes) else 0, level.back_off[contexts].astype(np.int64) + self.unigram[words].astype(np.int64))


def _bases(contexts: np.ndarray, followers: np.ndarray) -> np.ndarray:
    """For each follower the last value of the context before, both sorted."""
    if not len(contexts):
        return np.empty(0, np.int64)
    last = np.flatnonzero(np.append(np.diff(contexts) != 0, True))
    ends = np.cumsum(followers[last].astype(np.int64) + 1)
    return np.repeat(np.concatenate(([0], ends[:-1])), np.diff(np.concatenate(([-1], last))))


# --- chunks ------------------------------------------------------------------------


class _Words(defaultdict):
    """Numbers of words in the order in which they are met."""

    def __init__(self) -> None:
        super().__init__(counter().__next__)


def _chunks(df: DataFrame, text: str, keep: list[str], train: Column, order: int) -> DataFrame:
    """One row for each chunk: its words' hashes ascending, their training
    counts, and its texts as word numbers with lengths, training marks and kept columns."""
    cols = [F.col(f"`{c}`") for c in keep]
    wanted = df.select(F.col(f"`{text}`").alias("__text"), F.coalesce(train, F.lit(False)).alias("__train"), *cols)
    schema = "chunk bigint, n_all bigint, n_train bigint, n_texts bigint, hashes binary, counts binary, ids binary, lengths binary, train binary, kept binary"
    names = ["chunk", "n_all", "n_train", "n_texts", "hashes", "counts", "ids", "lengths", "train", "kept"]
    marks_of_texts = [PAD, END, *map(_start, range(1, order))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 24
        made = 0

        def begin() -> tuple:
            words = _Words()
            for w in marks_of_texts:
                words[w]
            return words, [], [], [], [], 0

        def close(words: _Words, ids: list[np.ndarray], lengths: list[int], marks: list[bool], kept: list[pa.RecordBatch]) -> pa.RecordBatch:
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            every = rank[np.concatenate(ids)]
            seen = np.repeat(np.array(marks), lengths)
            counts = np.bincount(every[seen], minlength=len(order)).astype(np.uint32)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept[0].schema) as writer:
                for k in kept:
                    writer.write_batch(k)
            row = [part + made, len(every), int(counts.sum()), sum(marks), hashes[order].tobytes(), _pack(counts), _pack(every), _pack(np.array(lengths, np.uint32)), _pack(np.array(marks, np.uint8)), zstandard.compress(sink.getvalue().to_pybytes(), 1)]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 4 else pa.binary()) for i, v in enumerate(row)], names)

        words, ids, lengths, marks, kept, held = begin()
        end = np.array([words[END]], np.uint32)
        for batch in batches:
            first = 0
            for i, (x, mark) in enumerate(zip(batch.column(0), batch.column(1).to_pylist())):
                got = (x.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                ids += [np.fromiter(map(words.__getitem__, got), np.uint32, len(got)), end]
                lengths.append(len(got) + 1)
                marks.append(mark)
                held += len(got) + 1
                if held >= CHUNK_TOKENS:
                    kept.append(pa.RecordBatch.from_arrays(batch.columns[2:], schema=pa.schema(list(batch.schema)[2:])).slice(first, i + 1 - first))
                    yield close(words, ids, lengths, marks, kept)
                    made, first = made + 1, i + 1
                    words, ids, lengths, marks, kept, held = begin()
            if first < batch.num_rows:
                kept.append(pa.RecordBatch.from_arrays(batch.columns[2:], schema=pa.schema(list(batch.schema)[2:])).slice(first))
        if lengths:
            yield close(words, ids, lengths, marks, kept)

    return wanted.mapInArrow(run, schema)


class _Texts:
    """A chunk's texts as sequences of word numbers, with the marks before and after each."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray, order: int, marks: np.ndarray) -> None:
        self.order, self.lengths = order, lengths.astype(np.int64)
        pad, *before = np.searchsorted(numbers, marks[[0, *range(order - 1, 0, -1)]]).tolist()
        spans = self.lengths + 2 * order - 3
        begins = np.cumsum(spans) - spans
        self.words = np.full(int(spans.sum()), pad, np.uint32)
        for k, w in enumerate(before):
            self.words[begins + k] = w
        #: Place of every token, and of every n-gram's first word; n-grams begin at all places up to the last word before the end.
        self.tokens = _runs(begins + order - 1, self.lengths)
        self.grams = self.lengths + order - 2
        self.begins = _runs(begins, self.grams)
        self.words[self.tokens] = ids

    def gram_at(self) -> np.ndarray:
        """For each token the number of the n-gram of full length that ends with it."""
        return _runs(np.cumsum(self.grams) - self.grams, self.lengths)

    def nodes(self, only: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """`_levels` of the n-grams that begin at all places, or at some."""
        begins = self.begins if only is None else self.begins[only]
        return _levels([self.words[begins + k].astype(np.int64) for k in range(self.order)])


def _levels(columns: list[np.ndarray], ascending: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 2: prefix and last word of the distinct n-grams, ascending,
    and the number of each n-gram among them. A prefix is a number of the length before.

    The n-grams come column by column; `ascending` tells that they are sorted.
    """
    bits = max(max(int(c.max(initial=0)) for c in columns).bit_length(), 1)
    above, out = columns[0], []
    if bits * len(columns) > 63:  # too wide for one sort of whole n-grams
        for c in columns[1:]:
            found, above = np.unique(above << 32 | c, return_inverse=True)
            out.append((found >> 32, found & 0xFFFFFFFF, above))
        return out
    key = above
    for c in columns[1:]:
        key = key << bits | c
    by = None if ascending else np.argsort(key)
    key = key if ascending else key[by]
    above = key >> bits * (len(columns) - 1)
    for k in range(len(columns) - 2, -1, -1):
        here = key >> bits * k
        new = np.ones(len(here), bool)
        new[1:] = here[1:] != here[:-1]
        prefix, last, above = above[new], here[new] & ((1 << bits) - 1), np.cumsum(new) - 1
        number = above
        if by is not None:
            number = np.empty(len(by), np.int64)
            number[by] = above
        out.append((prefix, last, number))
    return out


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for sizes[i] values each."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _leaves(nodes: list) -> list[np.ndarray]:
    """The words of the distinct n-grams, column by column."""
    columns, at = [], np.arange(len(nodes[-1][0]))
    for prefix, last, _ in reversed(nodes):
        columns.append(last[at])
        at = prefix[at]
    return [at, *reversed(columns)]


def _hashes(numbers: np.ndarray) -> np.ndarray:
    """A hash of each word number, by which n-grams are dealt; different numbers have different hashes."""
    x = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a prefix with one word more."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _top(hashes: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """The upper bits of hashes; none of them for 0 bits."""
    return (hashes >> np.uint64(1) >> (np.uint64(63) - np.asarray(bits).astype(np.uint64))).astype(np.int64)


def _by_shard(shards: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams by shard, in their order within each, and where each shard begins among them and ends."""
    by = np.argsort(shards.astype(np.min_scalar_type((1 << bits) - 1)), kind="stable")
    return by, np.concatenate(([0], np.cumsum(np.bincount(shards, minlength=1 << bits))))


class _Hot:
    """Prefixes of one length that hold more than a shard's share: hash, bits to split by, tokens."""

    def __init__(self, rows: list[tuple[int, int, int]]) -> None:
        rows = sorted(rows)
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.bits = np.array([r[1] for r in rows], np.int64)
        self.total = np.array([r[2] for r in rows], np.int64)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the hot ones, -1 for the others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def _shards(columns: list[np.ndarray], bits: int, hot: list[_Hot]) -> np.ndarray:
    """The shard of n-grams given as columns of word hashes."""
    prefix = columns[0]
    out = _top(prefix, bits)
    for known, word in zip(hot, columns[1:]):
        at = known.place(prefix)
        split = np.flatnonzero(at >= 0)
        out[split] += _top(word[split], known.bits[at[split]])
        prefix = _mix(prefix, word)
    return out & ((1 << bits) - 1)


def _texts_of(row: dict, order: int, marks: np.ndarray) -> tuple[np.ndarray, _Texts]:
    numbers = _from_ascending(_unpack(row["numbers"], "u1"), row["words"])
    return numbers, _Texts(numbers, _unpack(row["ids"], "<u4"), _unpack(row["lengths"], "<u4"), order, marks)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


# --- shards of words ---------------------------------------------------------------


def _word_requests(chunks: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hashes, counts = np.frombuffer(row["hashes"], np.uint64), _unpack(row["counts"], "<u4")
            edges = np.searchsorted(_top(hashes, bits), np.arange((1 << bits) + 1))
            parts = [(s, a, b) for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if a < b]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _, _ in parts], pa.int32()), pa.array([row["chunk"]] * len(parts), pa.int64()), pa.array([hashes[a:b].tobytes() for _, a, b in parts]), pa.array([_pack(counts[a:b]) for _, a, b in parts])],
                ["shard", "chunk", "hashes", "counts"],
            )

    return chunks.select("chunk", "hashes", "counts").mapInArrow(run, "shard int, chunk bigint, hashes binary, counts binary")


def _word_totals(requests: DataFrame, most: float, marks: list[bytes]) -> DataFrame:
    """Answers by chunk and shard: the words' training totals, and their places among
    the shard's words. Rows of chunk -1 tell how many words a shard has, how many of
    them are trained, and the places of the words with over `most` training tokens and of `marks`."""

    def run(table: pa.Table) -> pa.Table:
        chunk, shard = table.column("chunk").to_pylist(), table.column("shard")[0].as_py()
        hashes = [np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()]
        counts = np.concatenate([_unpack(b, "<u4") for b in table.column("counts").to_pylist()]).astype(np.int64)
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
        sizes = [len(h) for h in hashes]
        places = np.split(inverse, np.cumsum(sizes)[:-1])
        hot = np.flatnonzero(totals > most)
        wanted = np.array([xxhash.xxh64_intdigest(w) for w in marks], np.uint64)
        at = np.minimum(np.searchsorted(distinct, wanted), len(distinct) - 1)
        told = _joined([hot.astype("<i8"), totals[hot].astype("<i8"), np.where(distinct[at] == wanted, at, -1).astype("<i8")])
        return pa.table({
            "chunk": pa.array([*chunk, -1], pa.int64()),
            "shard": pa.array([shard] * (len(chunk) + 1), pa.int32()),
            "words": pa.array([*sizes, len(distinct)], pa.int64()),
            "trained": pa.array([*[0] * len(chunk), int((totals > 0).sum())], pa.int64()),
            "totals": pa.array([*(_pack(_planes(totals[p])) for p in places), told], pa.binary()),
            "places": pa.array([*(_pack(_ascending(p)) for p in places), None], pa.binary()),
        })

    return requests.groupBy("shard").applyInArrow(run, "chunk bigint, shard int, words bigint, trained bigint, totals binary, places binary")


def _numbered(chunks: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """The chunks with word numbers, ascending, instead of hashes, and with training totals.

    A word's number is its place in its shard after `width` numbers for each shard before.
    """
    none = F.lit(None).cast("binary")
    told = words.where("chunk >= 0").select("chunk", "shard", "words", "totals", "places", *[none.alias(c) for c in ("ids", "lengths", "train", "kept")])
    own = chunks.select("chunk", F.lit(-1).alias("shard"), F.lit(0).cast("bigint").alias("words"), none.alias("totals"), none.alias("places"), "ids", "lengths", "train", "kept")

    def run(table: pa.Table) -> pa.Table:
        first, *rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
        numbers = np.concatenate([r["shard"] * width + _from_ascending(_unpack(r["places"], "u1"), r["words"]) for r in rows])
        totals = np.concatenate([_from_planes(_unpack(r["totals"], "u1"), r["words"]) for r in rows])
        values = {"chunk": first["chunk"], "words": len(numbers), "numbers": _pack(_ascending(numbers)), "totals": _pack(_planes(totals)), **{c: first[c] for c in ("ids", "lengths", "train", "kept")}}
        return pa.table({c: pa.array([v], pa.int64() if c in ("chunk", "words") else pa.binary()) for c, v in values.items()})

    return own.unionByName(told).groupBy("chunk").applyInArrow(run, "chunk bigint, words bigint, numbers binary, totals binary, ids binary, lengths binary, train binary, kept binary")


def _hot_prefixes(chunks: DataFrame, hot: list[_Hot], most: float, bits: int, n: int, order: int, marks: np.ndarray) -> _Hot:
    """Prefixes one word longer than the last of `hot` with over `most` training tokens; their own prefixes are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            numbers, texts = _texts_of(row, order, marks)
            hashes = _hashes(numbers)
            begins = texts.begins[np.repeat(_unpack(row["train"], "u1").astype(bool), texts.grams)]
            prefix = hashes[texts.words[begins]]
            for k, known in enumerate(hot, 1):
                on = known.place(prefix) >= 0
                begins, prefix = begins[on], prefix[on]
                prefix = _mix(prefix, hashes[texts.words[begins + k]])
            found, counts = np.unique(prefix, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], ["h", "c"])

    met = chunks.select("words", "numbers", "ids", "lengths", "train").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > most).collect()
    return _Hot([(int(np.int64(h).view(np.uint64)), _split_bits(c, n, bits), c) for h, c in met])


def _split_bits(c: int, n: int, bits: int) -> int:
    return min(bits, math.ceil(math.log2(max(2.0, 2 * c * (1 << bits) / max(n, 1)))))


# --- shards of n-grams -------------------------------------------------------------


def _requests(chunks: DataFrame, bits: int, hot: list[_Hot], order: int, marks: np.ndarray, training: bool, turn: int = 0, rounds: int = 1) -> DataFrame:
    """(shard, chunk, blob): distinct n-grams of each chunk; for training with
    their counts, and only those of training texts. One round in `rounds` asks
    the shards whose number leaves `turn`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            numbers, texts = _texts_of(row, order, marks)
            hashes = _hashes(numbers)
            only = np.repeat(_unpack(row["train"], "u1").astype(bool), texts.grams) if training else None
            if rounds > 1:  # n-grams of other rounds need no sorting
                only = _shards([hashes[texts.words[texts.begins + k]] for k in range(order)], bits, hot) % rounds == turn
            nodes = texts.nodes(only)
            columns = _leaves(nodes)
            counts = np.bincount(nodes[-1][2], minlength=len(columns[0])) if training else None
            shards = _shards([hashes[c] for c in columns], bits, hot)
            by, edges = _by_shard(shards, bits)
            place, met = np.empty(len(numbers), np.int64), np.zeros(len(numbers), bool)
            for s in np.flatnonzero(np.diff(edges)).tolist():
                some = by[edges[s] : edges[s + 1]]
                own = [c[some] for c in columns]
                for c in own:
                    met[c] = True
                words = np.flatnonzero(met)
                met[words], place[words] = False, np.arange(len(words))
                first, *others = [place[c] for c in own]
                blob = zstandard.compress(_joined([np.array([len(words), len(some)], "<i8"), _ascending(numbers[words]), _ascending(first), *map(_planes, others), *([_planes(counts[some])] if training else [])]), 1)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((s, pa.int32()), (row["chunk"], pa.int64()), (blob, pa.binary()))], ["shard", "chunk", "blob"])

    return chunks.select("chunk", "words", "numbers", "ids", "lengths", "train").mapInArrow(run, "shard int, chunk bigint, blob binary")


def _opened(blob: bytes, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray | None]:
    """Numbers of a request's words, columns of their places, and counts."""
    sizes, words, first, *planes = _parted(np.frombuffer(zstandard.decompress(blob), np.uint8))
    words_n, n = sizes.tolist()
    found = [_from_ascending(first, n), *(_from_planes(p, n) for p in planes)]
    return _from_ascending(words, words_n), found[:order], found[order] if len(found) > order else None


def _packed_levels(words: np.ndarray, levels: list, totals: np.ndarray) -> bytes:
    """Words, the prefixes and last words of each length, and the totals of the longest n-grams."""
    sizes = np.array([len(words), *(len(last) for _, last, *_ in levels)], "<i8")
    arrays = [x for above, last, *_ in levels for x in (_ascending(above), _planes(last))]
    return zstandard.compress(_joined([sizes, _ascending(words), *arrays, _planes(totals)]), 1)


def _opened_levels(blob: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    sizes, words, *arrays, totals = _parted(np.frombuffer(zstandard.decompress(blob), np.uint8))
    n, *lengths = sizes.tolist()
    levels = [(_from_ascending(arrays[2 * k], m), _from_planes(arrays[2 * k + 1], m)) for k, m in enumerate(lengths)]
    return _from_ascending(words, n), levels, _from_planes(totals, lengths[-1])


def _counted(requests: DataFrame, order: int, hot: list[_Hot], marks: np.ndarray) -> DataFrame:
    """One row for each shard: its words and n-grams with totals; how many n-grams
    of each length occurred once and twice; and the followers its part of each hot prefix has."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_opened(b, order) for b in table.column("blob").to_pylist()]
        words, number = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        firsts = np.cumsum([0, *(len(p[0]) for p in parts)])[:-1]
        columns = [np.concatenate([number[a + p[1][k]] for a, p in zip(firsts.tolist(), parts)]) for k in range(order)]
        counts = np.concatenate([p[2] for p in parts])
        del parts
        levels = _levels(columns)
        outside, pad = (np.flatnonzero(np.isin(words, m)) for m in (marks, marks[:1]))
        totals = [np.bincount(inverse, counts, len(last)).astype(np.int64) for _, last, inverse in levels]
        once, twice, told = [], [], []
        prefix = hashes = _hashes(words)
        for k, (above, last, _) in enumerate(levels):
            here = _mix(prefix[above], hashes[last])
            usual = ~np.isin(last, outside)
            split = hot[k + 1].place(here) >= 0 if k + 1 < len(hot) else np.zeros(len(here), bool)
            once.append(int((usual & ~split & (totals[k] == 1)).sum()))
            twice.append(int((usual & ~split & (totals[k] == 2)).sum()))
            # Followers of hot prefixes; those that are split themselves are in several shards and counted on the driver.
            at = hot[k].place(prefix)
            kinds = np.bincount(at[above][(at[above] >= 0) & ~np.isin(last, pad) & ~split], minlength=len(hot[k].hashes))
            told.append(kinds.astype("<i8"))
            # Each split follower is told by all shards that have it, as its hash and its prefix.
            both = np.flatnonzero(split)
            told += [here[both], at[above[both]].astype("<i8")]
            prefix = here
        return pa.table({"shard": table.column("shard")[:1], "blob": pa.array([_packed_levels(words, levels, totals[-1])]), "once": pa.array([once], pa.list_(pa.int64())), "twice": pa.array([twice], pa.list_(pa.int64())), "told": pa.array([zstandard.compress(_joined(told), 1)])})

    return requests.groupBy("shard").applyInArrow(run, "shard int, blob binary, once array<bigint>, twice array<bigint>, told binary")


def _kinds(counted: DataFrame, hot: list[_Hot]) -> list[np.ndarray]:
    """Number of followers of each hot prefix over all shards; one short row for each shard that has any."""
    kinds = [np.zeros(len(h.hashes), np.int64) for h in hot]
    if not any(len(h.hashes) for h in hot):
        return kinds
    split: list[set] = [set() for _ in hot]
    for (blob,) in counted.select("told").toLocalIterator():
        told = _parted(np.frombuffer(zstandard.decompress(blob), np.uint8))
        for k, known in enumerate(kinds):
            known += told[3 * k]
            split[k].update(zip(told[3 * k + 1].tolist(), told[3 * k + 2].tolist()))
    for k, met in enumerate(split):
        for _, at in met:
            kinds[k][at] += 1
    return kinds


def _codes(chance: np.ndarray) -> np.ndarray:
    """Quantised -log10."""
    return np.minimum(np.rint(-np.log10(np.maximum(chance, 1e-31)) * STEPS), NONE - 1).astype(np.uint16)


def _tries(counted: DataFrame, order: int, hot: list[_Hot], kinds: list[np.ndarray], discounts: list[float], marks: np.ndarray) -> DataFrame:
    """(shard, blob): each shard's part of the trie.

    An n-gram seen c times, in a context seen C times with t followers, has the
    code of (c - discount) / C, and the context that of its back-off weight
    discount * t / C.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, levels, longest = _opened_levels(row["blob"])
            totals, pad = [longest], np.flatnonzero(np.isin(words, marks[:1]))
            for above, _ in levels[:0:-1]:
                totals.insert(0, np.bincount(above, totals[0]).astype(np.int64))
            hashes = _hashes(words)
            prefix, made, place = hashes, [], np.arange(len(words))
            for k, (above, last) in enumerate(levels):
                here, c = _mix(prefix[above], hashes[last]), totals[k]
                inner = ~np.isin(last, pad)
                sums = np.bincount(above[inner], c[inner], len(prefix)).astype(np.int64)
                t = np.bincount(above[inner], minlength=len(prefix)).astype(np.int64)
                at = hot[k].place(prefix)
                sums, t = np.where(at >= 0, np.append(hot[k].total, 0)[at], sums), np.where(at >= 0, np.append(kinds[k], 0)[at], t)
                if k + 1 < len(hot):  # an n-gram that is split has its total from the driver
                    at = hot[k + 1].place(here)
                    c = np.where(at >= 0, np.append(hot[k + 1].total, 0)[at], c)
                # An n-gram that ends with what follows a text is none; its place closes up.
                new = np.cumsum(inner) - 1
                back = np.where(sums > 0, _codes(discounts[k] * t / np.maximum(sums, 1)), 0)
                made.append((place[above[inner]], last[inner], _codes((c - discounts[k])[inner] / np.maximum(sums[above[inner]], 1)), back[place >= 0]))
                prefix, place = here, np.where(inner, new, -1)
            first = made[0]
            trie = Trie(None, len(words), *first[:3], np.empty(0, np.int64), first[3], tuple(made[1:]))
            blob = zstandard.compress(_joined([np.array([len(words)], "<i8"), _ascending(words), trie.blob]), 1)
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])

    return counted.select("shard", "blob").mapInArrow(run, "shard int, blob binary")


def _answers(requests: DataFrame, tries: DataFrame, order: int) -> DataFrame:
    """(chunk, shard, blob): the back-off codes of a request's first words; then for
    each length the codes of its n-grams, and their own back-off codes as contexts."""
    asked = requests.unionByName(tries.select("shard", F.lit(-1).cast("bigint").alias("chunk"), "blob"))

    def run(table: pa.Table) -> pa.Table:
        chunk, blobs = table.column("chunk").to_pylist(), table.column("blob")
        model = [i for i, c in enumerate(chunk) if c < 0]
        trie = None
        if model:
            n, packed, levels = _parted(np.frombuffer(zstandard.decompress(blobs[model[0]].as_py()), np.uint8))
            words, trie = _from_ascending(packed, int(n[0])), Trie.opened(levels)
        out = []
        for i, c in enumerate(chunk):
            if c < 0:
                continue
            asked, columns, _ = _opened(blobs[i].as_py(), order)
            levels = _levels(columns, ascending=True)
            if trie is None:
                out.append(zstandard.compress(_joined([_planes(np.zeros(len(asked), "<u2")), *(_planes(x) for _, last, _ in levels for x in (np.full(len(last), NONE, "<u2"), np.zeros(len(last), "<u2")))]), 1))
                continue
            at = np.minimum(np.searchsorted(words, asked), max(len(words) - 1, 0))
            number = np.where(words[at] == asked, at, -1)
            codes, above = [_coded(trie.levels[0].back_off, number, 0)], number
            for k, (prefix, last, _) in enumerate(levels):
                level = trie.levels[k]
                # Contexts ascend here as they do in the trie, since numbers and places do.
                found = level.find(above[prefix], number[last])
                codes += [_coded(level.codes, found, NONE), _coded(trie.levels[k + 1].back_off, found, 0) if k + 1 < len(trie.levels) else np.zeros(0, "<u2")]
                above = found
            out.append(zstandard.compress(_joined(list(map(_planes, codes))), 1))
        if trie is not None:
            trie.close()
        asks = [c for c in chunk if c >= 0]
        return pa.table({"chunk": pa.array(asks, pa.int64()), "shard": pa.array([table.column("shard")[0].as_py()] * len(asks), pa.int32()), "blob": pa.array(out, pa.binary())})

    return asked.groupBy("shard").applyInArrow(run, "chunk bigint, shard int, blob binary")


def _coded(codes: np.ndarray, at: np.ndarray, other: int) -> np.ndarray:
    return np.where(at >= 0, codes[np.maximum(at, 0)] if len(codes) else other, other).astype("<u2")


# --- the model and its scores ------------------------------------------------------


def _chance(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == NONE, 0.0, 10.0 ** (codes / -STEPS))


def score(df: DataFrame, train: Column, text: str = "text", keep: list[str] | None = None, order: int = 2) -> DataFrame:
    """The columns of `keep` with n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows where `train` is true; a null counts as
    false. Words lie between ASCII white space, A-Z lower-cased; an end token
    closes each text, so null and empty texts are scored on that token alone.
    base_score uses add-one unigrams, score n-grams of length `order`, 2 or
    more. One row out for each row in; repeated rows count as often as they
    stand there. Without training rows every token is unknown. Kept columns
    must not be named like the outputs. Word numbers of a chunk are 31 bits
    wide; a task holds one chunk, so a single text must fit into a worker's
    memory about ten times.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    zero, real = F.lit(0).cast("bigint"), F.lit(0.0)
    schema = df.select(*[F.col(f"`{c}`") for c in keep], zero.alias("n_tokens"), zero.alias("n_known"), zero.alias("train_tokens"), real.alias("base_score"), real.alias("score")).schema
    chunks = materialize(_chunks(df, text, keep, train, order), "lm-chunks")
    sums = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_all", "n_train", "n_texts")]).first()
    n_all, n, n_texts = map(int, sums)
    bits = max(0, math.ceil(math.log2(max(1, n_all) / SHARD_TOKENS)))
    most = max(1.0, n / (1 << bits))
    names_of_marks = [PAD, *map(_start, range(1, order))]
    words = materialize(_word_totals(_word_requests(chunks, bits), most, names_of_marks), "lm-words")
    told = words.where("chunk = -1").select("shard", "words", "trained", "totals").collect()  # a row for each shard, fewer hot words than shards
    v, width = sum(r["trained"] for r in told), max((r["words"] for r in told), default=0)
    marks, heavy = np.full(order, -1), []
    for r in told:
        hot_places, totals, places = _parted(np.frombuffer(r["totals"], np.uint8))
        heavy += zip((r["shard"] * width + hot_places).tolist(), totals.tolist())
        marks = np.where(places >= 0, r["shard"] * width + places, marks)
    heavy += [(k, n_texts) for k in marks[1:].tolist() if n_texts > most]
    numbered = materialize(_numbered(chunks, words, width), "lm-numbered")
    release(chunks)
    release(words)
    hot = [_Hot([(h, _split_bits(c, n, bits), c) for h, (_, c) in zip(_hashes(np.array([k for k, _ in heavy], np.int64)).tolist(), heavy)] if bits else [])]
    for _ in range(2, order):
        hot.append(_hot_prefixes(numbered, hot, most, bits, n, order, marks) if len(hot[-1].hashes) else _Hot([]))
    counted = materialize(_counted(_requests(numbered, bits, hot, order, marks, True), order, hot, marks), "lm-counts")
    ends = counted.select(*[F.sum(F.col(c)[k]) for c in ("once", "twice") for k in range(order - 1)]).first()
    discounts = [a / (a + 2 * b) if a and b else 0.5 for a, b in zip(ends[: order - 1], ends[order - 1 :])]
    tries = materialize(_tries(counted, order, hot, _kinds(counted, hot), discounts, marks), "lm-trie")
    release(counted)
    none = F.lit(None).cast("binary")
    parts = numbered.select("chunk", F.lit(-1).alias("shard"), "words", "numbers", "totals", "ids", "lengths", "kept")
    rounds = min(ROUNDS, 1 << bits)
    for turn in range(rounds):
        asked = _requests(numbered, bits, hot, order, marks, False, turn, rounds)
        answers = materialize(_answers(asked, tries.where(F.col("shard") % rounds == turn), order), "lm-answers")
        parts = parts.unionByName(answers.select("chunk", "shard", F.lit(0).cast("bigint").alias("words"), F.col("blob").alias("numbers"), *[none.alias(c) for c in ("totals", "ids", "lengths", "kept")]))
    release(tries)
    names = schema.names

    def run(table: pa.Table) -> pa.Table:
        own, *rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
        numbers, texts = _texts_of(own, order, marks)
        ids, lengths = _unpack(own["ids"], "<u4"), _unpack(own["lengths"], "<u4")
        c_word, hashes = _from_planes(_unpack(own["totals"], "u1"), own["words"]), _hashes(numbers)
        nodes = texts.nodes()
        columns = _leaves(nodes)
        shards = _shards([hashes[c] for c in columns], bits, hot)
        codes = [np.full(len(last), NONE, np.uint16) for _, last, _ in nodes]
        backs = [np.zeros(len(numbers), np.uint16), *(np.zeros(len(last), np.uint16) for _, last, _ in nodes[:-1])]
        by, edges = _by_shard(shards, bits)
        met, leads = np.zeros(len(numbers), bool), np.zeros(len(numbers), bool)
        for r in rows:
            some = by[edges[r["shard"]] : edges[r["shard"] + 1]]
            got = _parted(np.frombuffer(zstandard.decompress(r["numbers"]), np.uint8))
            for c in columns:
                met[c[some]] = True
            leads[columns[0][some]] = True
            asked = np.flatnonzero(met)
            first = leads[asked]
            backs[0][asked[first]] = _from_planes(got[0], len(asked))[first]
            met[asked] = leads[asked] = False
            at, held = some, [some]
            for prefix, _, _ in nodes[:0:-1]:
                at = prefix[at]  # ascending as the n-grams are
                at = at[np.append(True, at[1:] != at[:-1])]
                held.insert(0, at)
            for k, at in enumerate(held):
                codes[k][at] = _from_planes(got[1 + 2 * k], len(at))
                if k + 1 < len(backs):
                    backs[k + 1][at] = _from_planes(got[2 + 2 * k], len(at))
        uni = (c_word + 1) / (n + v + 1)
        grams, chance = texts.gram_at(), uni[ids]
        for k in range(order - 1):
            # The n-gram of k + 2 words that ends with a token begins later than that of full length.
            node = nodes[k][2][grams + order - 2 - k]
            chance = _chance(codes[k][node]) + 10.0 ** (backs[k][nodes[k][0][node]] / -STEPS) * chance
        begins = np.cumsum(lengths.astype(np.int64)) - lengths
        base = np.add.reduceat(np.log10(uni)[ids], begins)
        seen = np.add.reduceat((c_word > 0).astype(np.int64)[ids], begins)
        kept = pa.ipc.open_stream(zstandard.decompress(own["kept"])).read_all()
        made = [pa.array(lengths.astype(np.int64)), pa.array(seen), pa.array(np.full(len(lengths), n)), pa.array(base), pa.array(np.add.reduceat(np.log10(chance), begins))]
        return pa.Table.from_arrays([*kept.columns, *made], names=names)

    return parts.groupBy("chunk").applyInArrow(run, schema)
