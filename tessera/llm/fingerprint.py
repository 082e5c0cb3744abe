"""Document fingerprints from improbable features.

Every window of 8 bytes gets a rank by the rarity of its entropy: how few
windows of the corpus have that entropy. Windows of little entropy say little
and come last. The window that ranks rarest in some run of 8 windows is a
feature; texts of every length follow this one rule. Distinct features, in
order, fill a chain of Bloom filters of 2048 bits, 160 features each; two
chains are compared by the overlap of their bits, normalised between what
chance gives and what is possible.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a window, and windows of a run, the rarest of which is a feature.
WINDOW, RUN = 8, 8
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Entropy, in thousandths of its greatest value, below which a window has no rank: none has none.
COMMON = 0
#: Entropy, in the same unit, below which windows rank behind all others.
WEAK = 400
#: Share of the range between chance and a full match that scattered overlaps are given before they count.
MARGIN = 0.3
#: Bytes handled at once; a longer text is taken in overlapping pieces.
PIECE = 1 << 18
#: Rows whose texts are held at once, and ranges of ids for each shuffle partition.
ROWS, RANGES = 128, 4

_UNRANKED = 1 << 12


def _entropy_ranks(data: np.ndarray, window: int = 64) -> np.ndarray:
    """Rank by falling entropy of the window starting at each place: 0 the greatest, _UNRANKED none.

    The sum of c * log2(c) over the window's byte counts moves with each step
    by what the byte that comes in and the byte that goes out change, and those
    depend on how often each byte occurs in the other places before or after it.
    """
    n = len(data)
    order = np.argsort(data, kind="stable")
    # Equal bytes are neighbours in `order`; a window more between values keeps them apart.
    key = order + data[order].astype(np.int64) * (n + window)
    before, after = np.zeros(n, np.int16), np.zeros(n, np.int16)
    close = np.arange(n)
    for d in range(1, window):
        close = close[close >= d]
        close = close[key[close] - key[close - d] < window]
        if not len(close):
            break
        before[order[close]] += 1
        after[order[close - d]] += 1
    c = np.arange(window + 1, dtype=np.float64)
    f = c * np.log2(np.maximum(c, 1))
    step = np.rint((f[1:] - f[:-1]) * (1 << 20)).astype(np.int64)
    first = np.bincount(data[:window], minlength=256)
    start = int(np.rint(f[first] * (1 << 20)).astype(np.int64).sum())
    moved = np.cumsum(step[before[window:]] - step[after[: n - window]])
    total = np.concatenate(([start], start + moved)) / (1 << 20)
    entropy = np.rint(1000 * (1 - total / (window * np.log2(window)))).astype(np.int64)
    return np.where(entropy < COMMON, _UNRANKED, 1000 - entropy)


def rarity(counts: np.ndarray | None = None) -> np.ndarray:
    """Rank of each entropy in thousandths, the rarest first, given how many windows have it.

    Without counts greater entropy counts as rarer. Entropies below `WEAK` come last.
    """
    entropy = np.arange(1001)
    counts = np.zeros(1001, np.int64) if counts is None else counts
    ranks = np.empty(1001, np.int64)
    ranks[np.lexsort((-entropy, counts, entropy < WEAK))] = entropy
    return ranks


def measured_rarity(df: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks from the entropies of all windows of all texts; 1,001 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1001, np.int64)
        for batch in batches:
            for x in batch.column(0):
                data = np.frombuffer((x.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                for at in range(0, len(data) - WINDOW + 1, PIECE):
                    counts += np.bincount(1000 - _entropy_ranks(data[at : at + PIECE + WINDOW - 1], WINDOW), minlength=1001)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts)), pa.array(counts[counts > 0])], ["entropy", "n"])

    sums = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "entropy bigint, n bigint").groupBy("entropy").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1001, np.int64)
    for entropy, n in sums:
        counts[entropy] = n
    return rarity(counts)


def _rarest(ranks: np.ndarray, run: int) -> np.ndarray:
    """For each run of `run` windows, the place of its lowest rank, leftmost first."""
    n = len(ranks)
    low = ranks * (1 << 32) + np.arange(n)
    span = 1
    while span * 2 <= run:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < run:
        low = np.minimum(low[: n - run + 1], low[run - span : n - span + 1])
    return low & 0xFFFFFFFF


def _hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows at some places: their bytes, mixed."""
    x = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places].copy().view("<u8").ravel()
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(ranks: np.ndarray) -> np.ndarray:
    """Places of the windows that are the rarest of a run; fewer windows than a run are one run."""
    return np.unique(_rarest(ranks, min(RUN, len(ranks))))


def _long_features(data: np.ndarray, ranked: np.ndarray) -> list[np.ndarray]:
    """Features of a long text, in pieces that overlap by what a place needs to see."""
    margin, out = 2 * RUN + WINDOW, []
    for at in range(0, len(data), PIECE):
        lo, hi = max(0, at - margin), min(len(data), at + PIECE + margin)
        if hi - lo >= WINDOW:
            places = _places(ranked[1000 - _entropy_ranks(data[lo:hi], WINDOW)]) + lo
            # The outermost places of a piece saw only part of their runs.
            out.append(_hashes(data, places[(places >= at) & (places < at + PIECE)]))
    return out


def _joint_features(texts: list[bytes], ranked: np.ndarray) -> list[np.ndarray]:
    """Features of texts laid end to end; runs that straddle two of them are left out."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    if len(data) < WINDOW:
        return out
    ranks = ranked[1000 - _entropy_ranks(data, WINDOW)]
    runs = np.zeros(len(ranks) + 1, np.int64)  # whole runs in one text
    short = []
    for i, (lo, hi) in enumerate(zip(begins.tolist(), ends.tolist())):
        n = hi - lo - WINDOW + 1
        if n >= RUN:
            runs[lo] += 1
            runs[lo + n - RUN + 1] -= 1
        elif n > 0:
            short.append(lo + int(_places(ranks[lo : lo + n])[0]))
    places = np.empty(0, np.int64)
    if len(ranks) >= RUN:
        places = _rarest(ranks, RUN)
        places = places[np.cumsum(runs)[: len(places)] > 0]
    places = np.unique(np.concatenate((places, np.array(short, np.int64))))
    hashes = _hashes(data, places)
    cuts = np.searchsorted(places, ends)
    for i, (a, b) in enumerate(zip([0, *cuts[:-1].tolist()], cuts.tolist())):
        out[i] = hashes[a:b]
    return out


def features(texts: list[bytes], ranked: np.ndarray | None = None) -> list[np.ndarray]:
    """Hashes of each text's distinct features in order; a text shorter than a window is one feature, an empty one has none."""
    ranked = rarity() if ranked is None else ranked
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0
    for t in texts:
        if held + len(t) > PIECE and group:
            out += _joint_features(group, ranked)
            group, held = [], 0
        if len(t) > PIECE:
            out.append(np.concatenate(_long_features(np.frombuffer(t, np.uint8), ranked)))
            continue
        group.append(t)
        held += len(t)
    out += _joint_features(group, ranked) if group else []
    for i, t in enumerate(texts):
        if 0 < len(t) < WINDOW:
            out[i] = np.array([xxhash.xxh64_intdigest(t)], np.uint64)
        else:
            _, first = np.unique(out[i], return_index=True)
            out[i] = out[i][np.sort(first)]
    return out


def chain(hashes: np.ndarray | list[int]) -> np.ndarray:
    """Bloom filters as rows of 256 bytes, 160 features each."""
    if not len(hashes):
        return np.empty((0, FILTER_BITS // 8), np.uint8)
    h = np.asarray(hashes, np.uint64)
    rows = np.arange(len(h)) // FILTER_FEATURES
    bits = np.zeros((int(rows[-1]) + 1, FILTER_BITS), bool)
    for i in range(HASHES):
        bits[rows, ((h >> np.uint64(11 * i)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


class Digest:
    """A fingerprint: its chain, and the number of features."""

    __slots__ = ("chain", "n", "ones")

    def __init__(self, hashes: np.ndarray | list[int]) -> None:
        self.n = len(hashes)
        self.chain = chain(hashes)
        self.ones = np.bitwise_count(self.chain).sum(axis=1, dtype=np.int64)

    def text(self) -> str:
        return f"{self.n}:{self.chain.tobytes().hex()}"


def digests(texts: list[str | None], ranked: np.ndarray | None = None) -> list[Digest]:
    """Fingerprints of whole texts; null counts as empty."""
    return [Digest(h) for h in features([(t or "").encode("utf-8", "surrogatepass") for t in texts], ranked)]


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: for each filter of the shorter chain its best match in the other, averaged by bits.

    An overlap counts from what two filters of their sizes share by chance,
    and `MARGIN` of the way on, up to all bits of the smaller. Only empty texts
    have no features: two of them are alike, one and another text are not.
    """
    if not a.n or not b.n:
        return float(a.n == b.n)
    if a.n == b.n and a.chain.shape == b.chain.shape and np.array_equal(a.chain, b.chain):
        return 1.0
    short, long = (a, b) if (len(a.chain), a.n) <= (len(b.chain), b.n) else (b, a)
    total = weight = 0.0
    words = long.chain.view("<u8")
    for row, ones in zip(short.chain.view("<u8"), short.ones):
        shared = np.bitwise_count(words & row).sum(axis=1, dtype=np.int64)
        most = np.minimum(long.ones, ones)
        chance = long.ones * ones / FILTER_BITS
        floor = chance + MARGIN * (most - chance)
        score = np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1)
        total += float(score.max()) * float(ones)
        weight += float(ones)
    return min(1.0, total / weight) if weight else 0.0


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, ranked: np.ndarray | None = None) -> DataFrame:
    """The columns of `keep` and `fingerprint`; null counts as empty. One row out for each row in.

    Kept columns must not be named like the output.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    cols = [F.col(f"`{c}`") for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = [d.text() for d in digests(part.column(len(keep)).to_pylist(), ranked)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(made, pa.string())], [*keep, "fingerprint"])

    schema = df.select(*cols, F.lit("").alias("fingerprint")).schema
    return df.select(*cols, F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


# --- each document against its edited self and the next document ----------------


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many code points from the start of the following text, or all it has."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _in_ranges(df: DataFrame, id: str, text: str) -> DataFrame:
    """(range, id, text, guest): rows in ranges of ascending ids; each range ends
    with a guest, the first row of the next range (of the first range for the last).

    Texts are shuffled once. What the driver learns is one bound for each partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    # A null id sorts first. Only the ids are read here.
    key = F.coalesce(F.col("id"), F.lit(-(1 << 63)).cast("bigint"))
    ids = df.select(F.coalesce(F.col(f"`{id}`").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("k"))
    # A few ranges for each partition even out how they hash into partitions.
    n = RANGES * parts
    cuts = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    bounds = sorted({int(c) for c in cuts})
    # The range of an id is the number of bounds at or below it, by halving the sorted bounds.
    rows = rows.withColumn("range", _range_of(key, bounds))
    firsts = ids.select(_range_of(F.col("k"), bounds).alias("range"), "k").groupBy("range").agg(F.min("k").alias("k")).orderBy("range").collect()
    starts = [(r["range"], r["k"]) for r in firsts]
    if not starts:
        return rows.select("range", "id", "text", F.lit(False).alias("guest"), "tie")
    # The first row of a range is also sent to the range before it; one row for each range here.
    back = spark.createDataFrame([(k, starts[i - 1][0]) for i, (_, k) in enumerate(starts)], "first_key bigint, before int")
    met = rows.withColumn("key", key).join(F.broadcast(back), F.col("key") == F.col("first_key"), "left")
    at = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("range"), F.lit(True).alias("guest"))
    sent = met.withColumn("at", F.explode(F.when(F.col("before").isNull(), F.array(at)).otherwise(F.array(at, guest)))).select("at.range", "id", "text", "at.guest", "tie")
    return sent.repartition(parts, "range").sortWithinPartitions("range", "guest", F.col("id").asc_nulls_first(), "tie")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of the sorted bounds at or below the key, by halving."""
    if not bounds:
        return F.lit(0)
    lists = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(lists, mid) <= key
        return F.when(s["lo"] < s["hi"], F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda s: s["lo"])


def compare_neighbours(df: DataFrame, id: str = "doc_id", text: str = "text", ranked: np.ndarray | None = None) -> DataFrame:
    """For each row, in ascending order of id: id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next.

    The next row of the last is the first; a single row follows itself. Null
    texts are empty, empty texts have no features, a null id comes first, and
    rows that repeat an id follow each other by the hash of their texts.
    `ranked` holds the ranks of `measured_rarity`, else those of `rarity`.
    """
    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # range, id, text, digest of the row whose next one is awaited
        met_guest = None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ranges, keys, values, guests = (part.column(i).to_pylist() for i in range(4))
                pairs = []
                for at, key, value, is_guest, own in zip(ranges, keys, values, guests, digests(values, ranked)):
                    if is_guest and met_guest == at:
                        continue  # of rows that repeat the first id, the first one follows
                    now = (at, key, value, own)
                    if last is not None and last[0] == at:
                        pairs.append((last, now))
                    last = None if is_guest else now
                    met_guest = at if is_guest else met_guest
                changed = [edited(one[2], after[2]) for one, after in pairs]
                others = digests(changed, ranked)
                rows = [
                    (one[1], len(one[2]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), one[3].text(), other.text(), likeness(one[3], other), likeness(one[3], after[3]))
                    for (one, after), text, other in zip(pairs, changed, others)
                ]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    made = _in_ranges(df, id, text).select("range", "id", "text", "guest").mapInArrow(run, schema)
    return made.withColumnRenamed("id", id)
