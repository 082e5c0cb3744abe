"""SimHash near-duplicate groups by a generalised pigeonhole search.

1. Every text gets a 64-bit fingerprint: the majority vote over the bits of
   the XXH64 hashes of its word shingles.
2. Equal fingerprints collapse, so copies never meet each other.
3. The 64 bits are dealt into partitions, correlated bits together. A dynamic
   program gives the partitions unequal thresholds t_i with
   sum(t_i) = radius - partitions + 1, at the least estimated cost. Two
   fingerprints within the radius then agree to t_i bits in some partition i.
4. Each fingerprint is entered under every signature within half of t_i,
   rounded up, of its own value in partition i: two values t_i bits apart meet
   half-way. Inside a signature's bucket, distances are verified, and each
   task gives out a spanning forest of the links it found, not pairs. Buckets
   too large for a task are dealt into blocks of bits, as a close pair agrees
   in one of radius + 1 blocks.
5. Components come from alternating star contraction of that forest.

The estimates only steer cost. No bucket is cut short.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
#: Relative cost of entering one signature and of verifying one candidate.
PROBE_COST, CANDIDATE_COST = 1.0, 0.05
#: Buckets beyond this many fingerprints are split again by plain pigeonhole, beyond `HOT_BUCKET` over tasks.
WIDE_BUCKET, HOT_BUCKET = 4096, 1 << 20
#: Fingerprints whose pairs estimate how often values of a partition are close; steers cost only.
SAMPLE = 2048
#: Nodes beyond which a task that merges forests gives out what it has and begins another.
FOREST = 1 << 19
#: Parts into which the rows of one component are dealt when it is named.
SALTS = 16


def text_words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of k words joined by a space; all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([digest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], np.uint64)


def fingerprint(words: list[bytes], k: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the shingle hashes; no words give 0."""
    return majority(shingle_hashes(words, k, seed))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; none give 0."""
    if not len(hashes):
        return 0
    votes = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        votes += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns of `keep` and `fp`, the fingerprint as a signed bigint.

    Null and empty texts have fingerprint 0. One row out for each row in.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    schema = df.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("bigint").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(text_words(x.as_py()), k, seed) for x in batch.column(len(keep))]
            fps = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], fps], [*keep, "fp"])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


# --- partitions and thresholds -------------------------------------------------


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, in how many both are 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float32)
            for part in np.array_split(bits, len(bits) // 65536 + 1):
                both += part.T @ part
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["cell", "n"])

    # 4097 sums, whatever the input.
    cells = distinct.select("fp").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for cell, n in cells:
        flat[cell] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def _bits(fps: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, bit 0 the least."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into `parts` groups of near equal size, correlated bits together."""
    ones = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(ones, ones)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for i in range(parts):
        size = BITS // parts + (i < BITS % parts)
        first = max(sorted(free), key=lambda b: corr[b, sorted(free)].max())
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _within(differ: np.ndarray, most: int) -> list[float]:
    """Chance that at most 0, 1, ... `most` of independent bits differ."""
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for p in differ:
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    return np.cumsum(chance).tolist()


def _close(group: list[int], most: int, sample: np.ndarray) -> list[float]:
    """Share of the sample's pairs that differ in at most 0, 1, ... `most` bits of the group."""
    own = sample & np.uint64(sum(1 << b for b in group))
    found = np.zeros(most + 1)
    for i in range(1, len(own)):
        found += np.bincount(np.minimum(np.bitwise_count(own[i:] ^ own[:-i]), most + 1), minlength=most + 2)[: most + 1]
    return (np.cumsum(found) / max(1, len(own) * (len(own) - 1) // 2)).tolist()


def meeting(t: int) -> int:
    """Bits flipped on either side so that values t bits apart have a signature in common."""
    return -(-t // 2)


def allocate(n: int, both: np.ndarray, radius: int = RADIUS, sample: np.ndarray | None = None) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, at the least estimated cost.

    A threshold of -1 leaves a partition out. The cost of threshold t in a
    partition of b bits is its signatures, C(b, 0) + ... + C(b, r) with r half
    of t, rounded up, for each fingerprint, and the candidates: pairs whose
    values differ in at most 2 r bits. Their share is estimated from the bits'
    frequencies and, since bits of a partition are correlated, from the pairs of a sample.
    """
    ones = np.diag(both) / max(n, 1)
    differ = 2 * ones * (1 - ones)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(1, radius + 2):
        total = radius - parts + 1
        groups = correlated_groups(n, both, parts)
        cost: dict[tuple[int, int], float] = {}
        for i, group in enumerate(groups):
            near = _within(differ[group], radius + 1)
            if sample is not None and len(sample) > 1:
                near = np.maximum(near, _close(group, radius + 1, sample)).tolist()
            for t in range(0, radius + 1):
                r = meeting(t)
                probes = sum(math.comb(len(group), j) for j in range(r + 1))
                cost[i, t] = probes * PROBE_COST + n * near[min(2 * r, radius + 1)] / 2 * CANDIDATE_COST
            cost[i, -1] = 0.0
        # table[s] is the least cost of the partitions so far with thresholds summing to s.
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for i in range(parts):
            after: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in table.items():
                for t in range(-1, radius + 1):
                    new = (c + cost[i, t], [*chosen, t])
                    if s + t not in after or new < after[s + t]:
                        after[s + t] = new
            table = after
        if total in table and (best is None or table[total][0] < best[0]):
            best = (table[total][0], list(zip(groups, table[total][1])))
    assert best is not None
    return best[1]


# --- signatures, buckets and links ---------------------------------------------


def signatures(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, sig, fp) for each signature within half of a partition's threshold; none where it is -1."""
    flips = []
    for part, (group, t) in enumerate(plan):
        masks = [sum(1 << group[j] for j in chosen) for r in range(meeting(t) + 1 if t >= 0 else 0) for chosen in itertools.combinations(range(len(group)), r)]
        flips.append((part, sum(1 << b for b in group), np.array(masks, np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part, mask, masks in flips:
                # At most 2**20 signatures at once.
                step = max(1, (1 << 20) // max(1, len(masks)))
                for at in range(0, len(fps) if len(masks) else 0, step):
                    some = fps[at : at + step]
                    sigs = ((some & np.uint64(mask))[:, None] ^ masks[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sigs), part, np.int32)), pa.array(sigs.view(np.int64)), pa.array(np.repeat(some, len(masks)).view(np.int64))], ["part", "sig", "fp"])

    return distinct.select("fp").mapInArrow(run, "part int, sig bigint, fp bigint")


class Forest:
    """Union by smallest member over the fingerprints that have a link."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up[x]
        return root

    def link(self, a: int, b: int) -> None:
        ra, rb = self.find(a), self.find(b)
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        if ra != rb:
            lo, hi = (ra, rb) if ra < rb else (rb, ra)
            self.up[lo] = lo
            self.up[hi] = lo

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(x, r) for x in self.up if (r := self.find(x)) != x]
        flat = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1])


def link_bucket(fps: np.ndarray, forest: Forest, radius: int = RADIUS) -> None:
    """Link what lies within the radius among distinct fingerprints.

    Searching breadth first, every fingerprint leaves the pool as soon as it
    is reached, so a dense group costs a few sweeps. A wide bucket is first
    split by radius + 1 blocks of bits: a close pair agrees in one.
    """
    if len(fps) > WIDE_BUCKET and not np.all(fps == fps[0]):
        cuts = np.linspace(0, BITS, radius + 2).astype(int)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            block = (fps >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)
            order = np.argsort(block, kind="stable")
            ends = np.flatnonzero(np.diff(block[order])) + 1
            for some in np.split(fps[order], ends):
                if len(some) > 1:
                    _sweep(some, forest, radius)
        return
    _sweep(fps, forest, radius)


def _sweep(pool: np.ndarray, forest: Forest, radius: int) -> None:
    while len(pool) > 1:
        front, pool = [pool[0]], pool[1:]
        while front and len(pool):
            x = front.pop()
            near = np.bitwise_count(pool ^ x) <= radius
            if near.any():
                reached = pool[near]
                pool = pool[~near]
                for y in reached.tolist():
                    forest.link(int(x), y)
                front.extend(reached)


def links(sigs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest, for each task, of the verified links in its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def settle(parts: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> None:
            """Rows of whole buckets."""
            change = np.flatnonzero((np.diff(keys) != 0) | (np.diff(parts) != 0)) + 1
            starts = np.concatenate(([0], change, [len(keys)]))
            sizes = np.diff(starts)
            bucket = np.repeat(np.arange(len(sizes)), sizes)
            small = int(sizes.max()) if len(sizes) else 0
            for d in range(1, min(small, 64)):
                hit = (bucket[d:] == bucket[:-d]) & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= radius) & (sizes[bucket[d:]] <= 64)
                for i in np.flatnonzero(hit).tolist():
                    if fps[i] != fps[i + d]:
                        forest.link(int(fps[i]), int(fps[i + d]))
            for i in np.flatnonzero(sizes > 64).tolist():
                link_bucket(np.unique(fps[starts[i] : starts[i + 1]]), forest, radius)

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the bucket that may go on, in pieces

        def flush() -> None:
            if held:
                settle(*(np.concatenate(x) for x in zip(*held)))
                held.clear()

        for batch in batches:
            now = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)) + (batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64),)
            if not len(now[0]):
                continue
            if held and (held[-1][0][-1] != now[0][0] or held[-1][1][-1] != now[1][0]):
                flush()
            # Rows of the last bucket wait for the next batch.
            other = np.flatnonzero((now[1] != now[1][-1]) | (now[0] != now[0][-1]))
            whole = int(other[-1]) + 1 if len(other) else 0
            if whole:
                held.append(tuple(x[:whole] for x in now))
                flush()
            held.append(tuple(x[whole:] for x in now))
        flush()
        a, b = forest.edges()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = sigs.repartition(F.col("part"), F.col("sig")).sortWithinPartitions("part", "sig", "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def spread_hot(sigs: DataFrame, radius: int = RADIUS, hot: int = HOT_BUCKET) -> DataFrame:
    """Buckets of over `hot` entries dealt into smaller ones, each under a part and signature of its own.

    Every fingerprint of such a bucket is entered once for each of radius + 1
    blocks of its bits; a pair within the radius agrees in one block.
    """
    large = sigs.groupBy("part", "sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(F.col("part").alias("h_part"), F.col("sig").alias("h_sig"))
    met = sigs.join(large, (F.col("part") == F.col("h_part")) & (F.col("sig") == F.col("h_sig")), "left")
    cuts = np.linspace(0, BITS, radius + 2).astype(int).tolist()
    blocks = [F.struct(F.xxhash64("part", F.lit(i)).alias("part"), F.xxhash64("sig", F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(((1 << hi) - 1) ^ ((1 << lo) - 1))))).alias("sig")) for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:]))]
    own = F.struct(F.col("part").cast("bigint").alias("part"), F.col("sig").alias("sig"))
    return met.select("fp", F.explode(F.when(F.col("h_part").isNull(), F.array(own)).otherwise(F.array(*blocks))).alias("k")).select("k.part", "k.sig", "fp")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def merged(edges: DataFrame) -> DataFrame:
    """(a, b): for each task a spanning forest of its rows' components, which keeps all that they connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def flush() -> pa.RecordBatch:
            a, b = forest.edges()
            forest.up.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for a, b in zip(*(batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64).tolist() for i in (0, 1))):
                forest.link(a, b)
            if len(forest.up) > FOREST:
                yield flush()
        if forest.up:
            yield flush()

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by alternating star contraction.

    Each round every node's larger neighbours move to its smallest neighbour
    (large star), then its smaller neighbours do (small star); rounds end when
    each node has a single edge, to a root. Rounds grow with the logarithm
    of the longest path, and a hot centre is only ever a min() aggregate and
    the streamed side of a join.
    """
    star = materialize(_oriented(edges.where("a != b")), "edges")
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _oriented(large)
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low2, large["a"] == low2["k"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = materialize(_oriented(small), "edges")
        done = _marks(after) == _marks(star)
        release(star)
        star = after
        if done:
            break
    return star.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _marks(edges: DataFrame) -> tuple:
    one = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(one)


def search(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): for each task a spanning forest of the links within the radius among the rows' distinct `fp`."""
    n, both = bit_counts(distinct)
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    plan = allocate(n, both, radius, np.array([r["fp"] for r in sample], np.int64).view(np.uint64))
    sigs = signatures(distinct, plan)
    # With fewer fingerprints no bucket can be too large.
    return links(spread_hot(sigs, radius) if n > HOT_BUCKET else sigs, radius)


def _grouped(df: DataFrame, id: str, text: str, k: int, radius: int, seed: int) -> DataFrame:
    """(id, h, fp, root, component_id) for each row; h is a hash of the text."""
    narrow = df.select(F.col(f"`{id}`").alias("id"), F.xxhash64(f"`{text}`").alias("h"), F.col(f"`{text}`").alias("text"))
    own = materialize(fingerprints(narrow, "text", ["id", "h"], k, seed), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("id").alias("rep"))
    forest = components(search(distinct, radius))
    linked = distinct.join(forest, distinct["fp"] == forest["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    low = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    # A large component is named part by part.
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(low, ["root", "salt"]).select(F.col("fp").alias("k_fp"), "root", "component_id")
    return own.join(named, own["fp"] == named["k_fp"]).drop("k_fp")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(id, fp, component_id) for each row of `df`.

    component_id is the smallest id reachable over links of at most `radius`
    differing bits, its own included. Null and empty texts share fingerprint 0
    and are linked by it; repeated rows and ids stay separate rows; a null id
    belongs to its group but names it only if all ids there are null; an
    empty table gives no rows. Other columns are not read.
    """
    return _grouped(df, id, text, k, radius, seed).select(F.col("id").alias(id), "fp", "component_id")


def deduplicate(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """`df` with one row of each near-duplicate group, that of the smallest id.

    Null ids come last. Among rows of one id in a group the one with the least
    text hash stays, and one of rows that repeat it exactly.
    """
    return one_of_each(df, _grouped(df, id, text, k, radius, seed), id, text)


def one_of_each(df: DataFrame, grouped: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with one row of each root of `grouped` (id, h, root), chosen as `deduplicate` says."""
    groups = materialize(grouped.select("id", "h", "root"), "groups")
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("h").alias("h"))
    kept = groups.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.id").alias("__id"), F.col("o.h").alias("__h"))
    out = df.withColumn("__text_hash", F.xxhash64(f"`{text}`"))
    met = F.col(f"`{id}`").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__h"))
    repeated = materialize(groups.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "h"), "repeated")
    again = (F.col("__id").eqNullSafe(F.col("id"))) & (F.col("__h") == F.col("h"))
    if repeated.isEmpty():
        return out.join(kept, met, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
    once = out.join(kept.join(repeated, again, "left_anti"), met, "left_semi").drop("__text_hash")
    twice = out.join(kept.join(repeated, again, "left_semi"), met, "left_semi").dropDuplicates([id, "__text_hash"]).drop("__text_hash")
    return once.unionByName(twice)
