"""Near copies: SimHash links, verified by the exact Jaccard similarity of word shingles, and an exact join that proves them whole.

1. Texts of equal shingle sets collapse, so copies never meet each other. Each
   set has a SimHash fingerprint of `WORDS` words of 64 bits, a word from a mix
   of its own of the shingle hashes.
2. Sets that have some word within `RADIUS` bits are found by the generalised
   pigeonhole search of `simhash`, word by word; these are all pairs within
   WORDS * (RADIUS + 1) - 1 bits and most of those further apart. Inside each
   component of a word's links the similarity is computed in full, and the
   pairs that reach it make the groups. Of the 48 pairs of similarity 0.8 in
   sf0.1 one word holds 39 within 11 bits, two 47, three all. A wider
   radius instead of more words lets in chance pairs without bound as tables grow.
3. A fingerprint proves nothing of the pairs it passes over. So an exact join
   looks for links that are left between different groups.
   Two sets of similarity t share one of the first s - ceil(t s) + 1 shingles
   of either, s its size, in any one order of all shingles. So these prefixes
   are the keys of buckets, of which those inside one group are passed over.
   Shingles that are frequent in a sample come last in the order, which steers
   cost only.
   Large sets are dealt by hash into parts first: two similar sets are as
   similar as a whole in one part at least, so the same search runs on parts.
4. In a bucket, pairs whose sizes or parity bitmaps rule the similarity out are
   passed over: bitmaps of two sets differ in at most as many bits as the sets
   have elements of their own. The other pairs are candidates, of which each
   task gives out a spanning forest.
5. The components of the candidates that reach into several groups are verified
   like those of the fingerprints. Large components are dealt into blocks, and
   each pair of blocks is a task's work.

No step leaves a similar pair out or lets one in that is not similar.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .simhash import Forest, components, merged, search, shingle_hashes, text_words

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: Words of a fingerprint, and bits in which one of them differs at most in a SimHash link.
WORDS, RADIUS = 3, 11
#: What each word adds to the hashes before they are mixed.
MIX = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Bits of a parity bitmap, and elements of a part beyond which a set is dealt into twice as many.
PARITY, PART = 1024, 1024
#: One text in so many is sampled for frequent shingles; from so many texts on a shingle is frequent, and at most so many are.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 4, 1 << 17
#: Shingles in a block of a component.
BLOCK = 1 << 19
#: Texts to verify up to which their hashes are broadcast; beyond, the same join shuffles.
BROADCAST = 500_000
#: Buckets up to this size are compared by offsets, all at once.
SMALL_BUCKET = 64


def shingles(text: str | None, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The set of a text's shingle hashes, sorted."""
    return np.unique(shingle_hashes(text_words(text), k, seed))


def least_overlap(size: int, similarity: float) -> int:
    """Elements that a set of this size shares at least with a similar one."""
    return math.ceil(similarity * size - 1e-9)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets reach the Jaccard similarity; two empty ones do."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def set_key(own: np.ndarray) -> int:
    """A signed 64-bit hash of a set; the empty set has 0."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)) if len(own) else 0


def fingerprint(own: np.ndarray) -> np.ndarray:
    """The `WORDS` words of a set's SimHash: a bit is 1 if it is set in over half the mixed hashes."""
    votes = np.zeros(WORDS * 64, np.int64)
    for part in np.array_split(own, len(own) // 16384 + 1) if len(own) else ():
        x = part[:, None] + MIX
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ x >> np.uint64(31)).view(np.uint8).reshape(len(part), -1), axis=1)
        # Up to 255 rows have sums of a byte.
        votes += np.add.reduceat(bits, np.arange(0, len(part), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(own)).view(np.uint64)


def prefix(own: np.ndarray, late: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The elements of which a similar set's prefix has one too; those of `late`, sorted, come last."""
    n = len(own) - least_overlap(len(own), similarity) + 1 if len(own) else 0
    if not n or not len(late):
        return own[:n]
    is_late = late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own
    return np.concatenate((own[~is_late], own[is_late]))[:n]


def parity(own: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of elements fall on it; 64 bits a word."""
    odd = (np.bincount((own >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def frequent(texts: DataFrame, k: int, seed: int) -> np.ndarray:
    """Sorted shingles that many texts of a sample hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py(), k, seed).view(np.int64))], ["token"])

    # Copies would make all their shingles frequent.
    some = texts.where(F.pmod("h", F.lit(SAMPLE)) == 0).dropDuplicates(["h"]).select("text")
    n = some.mapInArrow(run, "token bigint").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    # At most MOST_FREQUENT rows.
    got = [r[0] for r in n.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").collect()]
    return np.sort(np.array(got, np.int64).view(np.uint64))


def part_counts(size: int, similarity: float = SIMILARITY) -> list[int]:
    """Into how many parts a set of this size is dealt: as many as the smallest
    and the largest of the similar sets up to its size are, powers of two between."""
    low, high = (1 << max(0, (max(n, 1) - 1) // PART).bit_length() for n in (least_overlap(size, similarity), size))
    return [1 << i for i in range(low.bit_length() - 1, high.bit_length())]


def parts(own: np.ndarray, similarity: float = SIMILARITY) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, elements, salt) of each part that is not empty; the salt keeps the parts of one count apart from those of others."""
    for count in part_counts(len(own), similarity):
        at = own >> np.uint64(8) & np.uint64(count - 1)
        salt = np.uint64(xxhash.xxh64_intdigest(str(count), SEED) if count > 1 else 0)
        for i in range(count):
            some = own[at == i]
            if len(some):
                yield count + i, some, salt


def _profiles(texts: DataFrame, late: np.ndarray, k: int, similarity: float, seed: int) -> DataFrame:
    """(id, h, key, fps, total, unit, size, bits, tokens): the set's hash, fingerprint and size, and for each part its size, bitmap and prefix.

    Every row of `texts` has one row of unit 0. Parts have their numbers as
    units, and a set that repeats in a task gives them once.
    """
    schema = texts.select("id", "h", F.lit(0).cast("bigint").alias("key"), F.array().cast("array<bigint>").alias("fps"), F.lit(0).alias("total"), F.lit(0).alias("unit"), F.lit(0).alias("size"), F.lit(b"").alias("bits"), F.array().cast("array<bigint>").alias("tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        none = np.empty(0, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for at, x in enumerate(batch.column(2)):
                own = shingles(x.as_py(), k, seed)
                key = set_key(own)
                rows.append((at, key, fingerprint(own).view(np.int64), len(own), 0, 0, b"", none))
                if key not in seen:
                    seen.add(key)
                    rows += [(at, key, none, len(own), unit, len(some), parity(some).tobytes(), (prefix(some, late, similarity) ^ salt).view(np.int64)) for unit, some, salt in parts(own, similarity)]
            if not rows:
                continue
            at, keys, fps, totals, units, sizes, bits, tokens = zip(*rows)
            fps, lists = (pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), pa.array(np.concatenate(x))) for x in (fps, tokens))
            ids = [batch.column(i).take(pa.array(at)) for i in (0, 1)]
            columns = [*ids, pa.array(keys, pa.int64()), fps, *[pa.array(c, pa.int32()) for c in (totals, units, sizes)], pa.array(bits, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return texts.select("id", "h", "text").mapInArrow(run, schema)


def shared(entries: DataFrame) -> DataFrame:
    """The distinct rows (token, key, unit) of `entries` (token, key, unit, known) whose token has several values of `known`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)]

        def several(tokens: np.ndarray, keys: np.ndarray, units: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
            """Rows of whole tokens."""
            new = np.concatenate(([True], (np.diff(tokens) != 0) | (np.diff(keys) != 0)))
            tokens, keys, units, known = tokens[new], keys[new], units[new], known[new]
            starts = np.flatnonzero(np.concatenate(([True], np.diff(tokens) != 0)))
            apart = np.minimum.reduceat(known, starts) != np.maximum.reduceat(known, starts)
            many = np.repeat(apart, np.diff(np.append(starts, len(tokens))))
            return pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (tokens, keys, units)], ["token", "key", "unit"])

        for batch in batches:
            held = [np.concatenate((x, batch.column(i).to_numpy(zero_copy_only=False))) for i, x in enumerate(held)]
            other = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else []
            whole = int(other[-1]) + 1 if len(other) else 0
            if whole:
                yield several(*[x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield several(*held)

    return entries.repartition("token").sortWithinPartitions("token", "key").mapInArrow(run, "token bigint, key bigint, unit int")


def _possible(sizes: np.ndarray, bits: np.ndarray, size: np.ndarray, bit: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sizes and bitmaps leave room for the similarity."""
    apart = np.bitwise_count(bits ^ bit).sum(axis=-1, dtype=np.int64)
    most = (sizes + size) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return (apart <= most) & (np.minimum(sizes, size) >= similarity * np.maximum(sizes, size) - 1e-9)


def candidates(entries: DataFrame, similarity: float) -> DataFrame:
    """(a, b): for each task a spanning forest of the pairs that buckets leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty((0, PARITY // 64), np.uint64)]

        def settle(tokens: np.ndarray, keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> None:
            """Rows of whole buckets."""
            starts = np.concatenate(([0], np.flatnonzero(np.diff(tokens)) + 1, [len(tokens)]))
            counts = np.diff(starts)
            small = np.repeat(counts, counts) <= SMALL_BUCKET
            for d in range(1, min(int(counts.max()), SMALL_BUCKET)):
                at = np.flatnonzero((tokens[d:] == tokens[:-d]) & small[d:])
                at = at[_possible(sizes[at], bits[at], sizes[at + d], bits[at + d], similarity)]
                for a, b in zip(keys[at].tolist(), keys[at + d].tolist()):
                    forest.link(a, b)
            for i in np.flatnonzero(counts > SMALL_BUCKET).tolist():
                pool = np.arange(starts[i], starts[i + 1])
                while len(pool) > 1:
                    front, pool = [pool[0]], pool[1:]
                    while front and len(pool):
                        x = front.pop()
                        near = _possible(sizes[pool], bits[pool], sizes[x], bits[x], similarity)
                        for y in pool[near].tolist():
                            forest.link(int(keys[x]), int(keys[y]))
                        front.extend(pool[near])
                        pool = pool[~near]

        for batch in batches:
            tokens, keys, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            bits = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, PARITY // 64)
            held = [np.concatenate(x) for x in zip(held, (tokens, keys.view(np.uint64), sizes.astype(np.int64), bits))]
            # The last bucket may go on in the next batch.
            other = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else []
            whole = int(other[-1]) + 1 if len(other) else 0
            if whole:
                settle(*[x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if len(held[0]):
            settle(*held)
        a, b = forest.edges()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return entries.select("token", "key", "size", "bits").mapInArrow(run, "a bigint, b bigint")


def similar_links(keys: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all pairs of sets that reach the similarity, as signed keys.

    Breadth first, and over the sets not yet reached only, so a dense group costs a few sweeps.
    """
    forest, names = Forest(), keys.view(np.uint64).tolist()
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    free = np.ones(len(sets), bool)
    for first in range(len(sets)):
        if not free[first]:
            continue
        front = [first]
        free[first] = False
        while front and free.any():
            x = front.pop()
            lo, hi = np.searchsorted(tokens, sets[x], "left"), np.searchsorted(tokens, sets[x], "right")
            n = hi - lo
            met = owners[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            both = np.bincount(met, minlength=len(sets))
            near = np.flatnonzero(free & (both >= similarity * (sizes + sizes[x] - both) - 1e-9) & (both > 0))
            free[near] = False
            for y in near.tolist():
                forest.link(names[x], names[y])
            front.extend(near.tolist())
    return forest.edges()


def members(forest: DataFrame) -> DataFrame:
    """(n_key, root) of every node of `components`, roots included."""
    return forest.select(F.col("node").alias("n_key"), "root").unionByName(forest.select(F.col("root").alias("n_key"), "root").distinct())


def thinned(edges: DataFrame) -> DataFrame:
    """(a, b): the forests of many tasks as edges of the same components, hardly more of them than nodes.

    A large group's node is in the forest of each task that it met others in, under
    a root of that task. Where all edges of a node meet, one of them stays, and one
    for each root that these connect.
    """
    return merged(edges.repartition("a"))


def by_fingerprint(own: DataFrame, radius: int) -> DataFrame:
    """(n_key, root): the sets of which a word is linked with those of others, by the word's component.

    Components of different words stay apart, so that chance links of one do not
    join those of another; components of the same sets count once.
    """
    sets = materialize(own.where("total > 0").select("key", "fps").dropDuplicates(["key"]), "near-fingerprints")
    found = [materialize(search(sets.select(F.col("fps")[i].alias("fp")).distinct(), radius), "near-found") for i in range(WORDS)]
    # Files of several tasks are read together, so their forests are merged before they are dealt.
    forest = components(thinned(merged(functools.reduce(DataFrame.unionByName, found))))
    placed = materialize(sets.select("key", F.explode("fps").alias("fp")).join(forest, F.col("fp") == F.col("node"), "left").select(F.col("key").alias("n_key"), F.coalesce("root", "fp").alias("root")), "near-words")
    marks = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("n_key").cast("decimal(38,0)")).alias("mark")).where("n > 1")
    once = marks.groupBy("n", "mark").agg(F.min("root").alias("s_root"))
    return placed.join(once, F.col("root") == F.col("s_root"), "left_semi")


def verified(texts: DataFrame, own: DataFrame, nodes: DataFrame, k: int, similarity: float, seed: int) -> DataFrame:
    """(a, b): links of sets that reach the similarity inside the components `nodes` (n_key, root) of candidates."""
    sized = own.join(nodes, own["key"] == nodes["n_key"]).groupBy("key", "root").agg(F.min("h").alias("v_h"), F.max("total").alias("size"))
    sized = materialize(sized, "near-sizes")
    large = sized.groupBy("root").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("root", "l_root")
    # One text of each set.
    placed = materialize(sized.join(large, sized["root"] == large["l_root"]).select("key", "root", "v_h", "blocks"), "near-places")
    few = F.broadcast(placed) if placed.count() <= BROADCAST else placed
    met = texts.select("h", "text").join(few, F.col("h") == F.col("v_h"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, b""
        for batch in batches:
            found = []
            for x in batch.column(3):
                # The components of a text follow each other.
                if (now := x.as_py()) != last:
                    last, own = now, shingles(now, k, seed).tobytes()
                found.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["key", "root", "blocks", "own"])

    # A text that repeats gives its set once a component.
    whole = met.select("key", "root", "blocks", "text").mapInArrow(sets, "key bigint, root bigint, blocks int, own binary").dropDuplicates(["key", "root"])
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    dealt = whole.select("key", "root", "own", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", "own", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def links(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        a, b = similar_links(keys, [np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()], similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("root", "i", "j").applyInArrow(links, "a bigint, b bigint")


def groups(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """(id, h, root) for each row: h is a hash of the text, and rows of one root
    are reachable from each other over pairs of texts that reach the similarity.

    Null and empty texts are copies of each other, and a text of fewer than k
    words is similar to one of the same words only. The radius steers cost only.
    """
    texts = df.select(F.col(f"`{id}`").alias("id"), F.xxhash64(f"`{text}`").alias("h"), F.col(f"`{text}`").alias("text"))
    profiles = materialize(_profiles(texts, frequent(texts, k, seed), k, similarity, seed), "profiles")
    own = materialize(profiles.where("unit = 0").select("id", "h", "key", "fps", "total"), "sets")
    links = materialize(verified(texts, own, by_fingerprint(own, radius), k, similarity, seed), "near-links")
    known = materialize(members(components(links)).select(F.col("n_key").alias("k_key"), F.col("root").alias("known")), "near-known")
    few = F.broadcast(known) if known.count() <= BROADCAST else known
    # Links that SimHash missed, if any, run between different groups.
    grouped = profiles.where("unit > 0").join(few, F.col("key") == F.col("k_key"), "left").select("tokens", "key", "unit", F.coalesce("known", "key").alias("known"))
    met = materialize(shared(grouped.select(F.explode("tokens").alias("token"), "key", "unit", "known")), "shared")
    # Of each part that meets another, one bitmap.
    wanted = met.select("key", "unit").distinct()
    bitmaps = profiles.where("unit > 0").select("key", "unit", "size", "bits").join(wanted, ["key", "unit"], "left_semi").dropDuplicates(["key", "unit"])
    entries = met.join(bitmaps, ["key", "unit"]).repartition("token").sortWithinPartitions("token", "key")
    near = materialize(members(components(thinned(candidates(entries, similarity)))), "near")
    release(met)
    release(profiles)
    held = near.join(few, F.col("n_key") == F.col("k_key"), "left").groupBy(F.col("root").alias("o_root")).agg(F.min(F.coalesce("known", "n_key")).alias("low"), F.max(F.coalesce("known", "n_key")).alias("high"))
    open_nodes = near.join(held.where("low != high"), F.col("root") == F.col("o_root"), "left_semi")
    every = links.unionByName(verified(texts, own, open_nodes, k, similarity, seed))
    named = components(every).select(F.col("node").alias("n_key"), F.col("root").alias("n_root"))
    return own.join(named, own["key"] == named["n_key"], "left").select("id", "h", F.coalesce("n_root", "key").alias("root"))
