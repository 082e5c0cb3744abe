"""Toxicity from the nearest labelled examples.

Texts are TF-IDF vectors over their words; the IDF of a term is multiplied by
its relevance, so that terms of label 1 weigh more, and no term is left out. The nearest labelled examples
of either label by exact cosine come from a block-max inverted index: rare
terms are scored from their postings; for common terms each block of examples
keeps the greatest weight, and only examples whose bound can reach the k-th
best are scored in full. Votes weighted by distance are calibrated on the
examples themselves, each voted on by the others; the neighbours are the
evidence.

The classifier is fitted on a sample of labelled rows, at most `EXAMPLES`, the
smallest by hash of the id. Scoring covers every row.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import near_copies
from .common import FEW_PARTITIONS, forget, give_back, materialize

#: Labelled rows fitted on at most, neighbours asked, examples in a block.
EXAMPLES, NEIGHBOURS, BLOCK = 10_000, 15, 64
#: A term that more than one in so many examples hold is common.
COMMON = 8
THRESHOLD = 0.7
#: Power of the relevance in a term's weight.
RELEVANCE = 1.5
#: Added to a distance before its inverse is taken as weight.
SOFT = 0.05
#: Texts scored together, and rows taken from a batch at once.
TOGETHER, ROWS = 64, 512

_WORD = re.compile(r"[^\W\d_]+")


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words of the whole text, ascending, and how often each occurs; null has none."""
    times = Counter(_WORD.findall((text or "").lower()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, times), np.uint64, len(times))
    order = np.argsort(hashes)
    return hashes[order], np.fromiter(times.values(), np.int64, len(times))[order]


@dataclass
class BlockMaxIndex:
    """Exact top-k by inner product over sparse unit vectors."""

    vectors: list[tuple[np.ndarray, np.ndarray]]
    n_terms: int

    def __post_init__(self) -> None:
        sizes = np.array([len(t) for t, _ in self.vectors], np.int64)
        terms = np.concatenate([t for t, _ in self.vectors] or [np.empty(0, np.int64)])
        weights = np.concatenate([w for _, w in self.vectors] or [np.empty(0)])
        self.vectors = []
        self._build(sizes, terms, weights)

    @classmethod
    def of(cls, n_terms: int, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> BlockMaxIndex:
        """The index of vectors laid end to end."""
        index = cls.__new__(cls)
        index.vectors, index.n_terms = [], n_terms
        index._build(sizes, terms, weights)
        return index

    def _build(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        n, self.n = self.n_terms, len(sizes)
        rows = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        held = np.bincount(terms, minlength=n)
        # Examples whose heaviest common term is the same share blocks, which keeps bounds tight.
        usual = (held * COMMON > self.n)[terms]
        first = np.full(self.n, -1, np.int64)
        order = np.argsort(weights[usual], kind="stable")
        first[rows[usual][order]] = terms[usual][order]
        self.order = np.argsort(first, kind="stable")
        place_of = np.argsort(self.order)
        self.place_of, self.blocks = place_of, max(1, -(-self.n // BLOCK))
        # Postings of rare terms by term.
        by = np.argsort(terms[~usual], kind="stable")
        self.places, self.weights = place_of[rows[~usual][by]].astype(np.int32), weights[~usual][by]
        self.starts = np.searchsorted(terms[~usual][by], np.arange(n + 1))
        # Weights of common terms by block, term and example, and the greatest of each block and term.
        self.common = np.full(n, -1, np.int32)
        names = np.flatnonzero(held * COMMON > self.n)
        self.common[names] = np.arange(len(names))
        self.full = np.zeros((self.blocks, len(names), BLOCK))
        at = place_of[rows[usual]]
        self.full[at // BLOCK, self.common[terms[usual]], at % BLOCK] = weights[usual]
        self.most = self.full.max(axis=2)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """(similarity, example) of the k greatest similarities over 0, ties by example."""
        return self.nearest_of_each([(terms, weights)], k, [without])[0]

    def nearest_of_each(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """`nearest` for several vectors; blocks are read once for all that need them."""
        if not self.n:
            return [[] for _ in queries]
        heavy = np.zeros((len(queries), self.most.shape[1]))
        scores = np.zeros((len(queries), self.blocks, BLOCK))
        for q, (terms, weights) in enumerate(queries):
            usual = self.common[terms] >= 0
            heavy[q, self.common[terms[usual]]] = weights[usual]
            low = self.starts[terms[~usual]]
            sizes = self.starts[terms[~usual] + 1] - low
            ends = np.cumsum(sizes)
            postings = np.repeat(low - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
            scores[q] = np.bincount(self.places[postings], np.repeat(weights[~usual], sizes) * self.weights[postings], self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        # No example of a block scores more than its best by rare terms and the block's bound for common ones.
        bounds = scores.max(axis=2) + heavy @ self.most.T
        done = np.zeros((len(queries), self.blocks), bool)
        kth = np.zeros(len(queries))
        steps = np.argsort(-bounds, axis=1, kind="stable")
        # The most promising blocks first, then all that the k-th score reached by then leaves open; slack covers rounding.
        for open_blocks in (np.arange(self.blocks)[None, :] < 2, None):
            want = np.zeros_like(done)
            if open_blocks is not None:
                np.put_along_axis(want, steps, np.broadcast_to(open_blocks, steps.shape), axis=1)
            else:
                want = bounds >= kth[:, None] * (1 - 1e-9)
            want &= ~done & (bounds > 0)
            for block in np.flatnonzero(want.any(axis=0)).tolist():
                some = np.flatnonzero(want[:, block])
                scores[some, block] += heavy[some] @ self.full[block]
            done |= want
            for q in range(len(queries)):
                if without and without[q] >= 0:
                    scores[q].ravel()[self.place_of[without[q]]] = 0.0
                reached = scores[q, done[q]].ravel()
                kth[q] = np.partition(reached, -k)[-k] if len(reached) >= k else 0.0
        out = []
        for q in range(len(queries)):
            mine = np.where(done[q][:, None], scores[q], 0.0).ravel()[: self.n]
            at = np.flatnonzero((mine > 0) & (mine >= kth[q] * (1 - 1e-9)))
            best = sorted(((round(s, 12), i) for s, i in zip(mine[at].tolist(), self.order[at].tolist())), key=lambda x: (-x[0], x[1]))
            out.append(best[:k])
        return out


class Examples:
    """The labelled examples: hashes of their terms with weights, and the terms of each.

    Counts are what is sent to the workers, compressed; weights and the index
    are made of them where they are first asked for.
    """

    def __init__(self, terms: np.ndarray, n0: np.ndarray, n1: np.ndarray, ids: list, labels: np.ndarray, numbers: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> None:
        self.terms, self.n0, self.n1, self.ids, self.labels = terms, n0, n1, ids, labels
        self.numbers, self.counts, self.sizes = numbers, counts, sizes

    def __reduce__(self) -> tuple:
        small = [a.astype(np.min_scalar_type(int(a.max(initial=0)))) for a in (self.n0, self.n1, self.labels, self.numbers, self.counts, self.sizes)]
        return _examples, (zstandard.compress(pickle.dumps((self.terms, *small[:2], self.ids, *small[2:])), 3),)

    @cached_property
    def weights(self) -> np.ndarray:
        ones = int(self.labels.sum())
        return term_weights(self.n0, self.n1, len(self.labels) - ones, ones)

    @cached_property
    def index(self) -> BlockMaxIndex:
        """Made once, after which the counts of each example are let go."""
        weights = np.log(self.counts, dtype=np.float64)
        weights += 1
        weights *= self.weights[self.numbers]
        # The length of each vector; an example without terms has none.
        ends = np.cumsum(self.sizes)
        full = self.sizes > 0
        norms = np.ones(len(self.sizes))
        norms[full] = np.sqrt(np.add.reduceat(weights * weights, (ends - self.sizes)[full])) if full.any() else 1.0
        weights /= np.repeat(norms, self.sizes)
        index = BlockMaxIndex.of(len(self.terms), self.sizes, self.numbers, weights)
        del weights, self.numbers, self.counts
        give_back()
        return index

    def neighbours(self, texts: list[str | None], without: list[int] | None = None) -> Iterator[list[tuple[float, int]]]:
        """The nearest examples of each text, of which example `without` is not one."""
        if "index" not in vars(self):
            forget()
        for at in range(0, len(texts), TOGETHER):
            vectors = [vector(t, self.terms, self.weights) for t in texts[at : at + TOGETHER]]
            yield from self.index.nearest_of_each(vectors, NEIGHBOURS, without and without[at : at + TOGETHER])


def _examples(packed: bytes) -> Examples:
    terms, n0, n1, ids, labels, numbers, counts, sizes = pickle.loads(zstandard.decompress(packed))
    # The long arrays stay as narrow as they came.
    return Examples(terms, n0.astype(np.int64), n1.astype(np.int64), ids, labels.astype(np.int64), numbers.astype(np.int32), counts, sizes.astype(np.int64))


@dataclass
class Model:
    """Labelled examples, sent to the workers once, and the calibration."""

    sent: Broadcast
    labels: np.ndarray
    #: Votes and the chances they stand for, both ascending; without a neighbour, `prior`.
    votes: np.ndarray
    chances: np.ndarray
    prior: float

    def score(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.prior
        return float(np.interp(vote(near, self.labels), self.votes, self.chances))


def vector(text: str | None, known: np.ndarray, term_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the text's known terms, and their weights in a vector of length 1."""
    hashes, counts = term_counts(text)
    at = np.searchsorted(known, hashes)
    met = at < len(known)
    met[met] = known[at[met]] == hashes[met]
    return unit(at[met], counts[met], term_weights)


def unit(terms: np.ndarray | dict[int, int], counts: np.ndarray | None, term_weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Terms ascending, and weights (1 + ln tf) * weight scaled to length 1.

    Terms with counts may also come as one dict, followed by the weights.
    """
    if isinstance(terms, dict):
        term_weights, counts = counts, np.array([terms[t] for t in sorted(terms)], np.int64)
        terms = np.array(sorted(terms), np.int64)
    if not len(terms):
        return np.empty(0, np.int64), np.empty(0)
    weights = (1 + np.log(counts)) * term_weights[terms]
    return terms, weights / np.sqrt(weights @ weights)


def term_weights(n0: np.ndarray, n1: np.ndarray, zeros: int, ones: int) -> np.ndarray:
    """IDF times relevance, for terms that n0 of `zeros` and n1 of `ones` examples hold.

    The relevance is log2(2 + share of label 1 / share of label 0) to the power `RELEVANCE`.
    """
    idf = np.log((1 + zeros + ones) / (1 + n0 + n1)) + 1
    return idf * np.log2(2 + (n1 / max(ones, 1)) / ((n0 + 1) / max(zeros, 1))) ** RELEVANCE


def vote(near: list[tuple[float, int]], labels: np.ndarray) -> float:
    weights = np.array([1 / (max(0.0, 1 - s) + SOFT) for s, _ in near])
    return float(weights @ labels[[i for _, i in near]] / weights.sum())


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators with half a row of either label added to each pool."""
    pools: list[list[float]] = []  # sum of votes, rows, positives
    for v, y in sorted(zip(votes.tolist(), labels.tolist())):
        pools.append([v, 1, y])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    x = np.array([p[0] / p[1] for p in pools])
    y = np.maximum.accumulate(np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools]))
    return x, y


def held_out(id: Column, modulus: int = 3, remainder: int = 1) -> Column:
    """Whether crc32 of the id as text has the remainder kept from training; a null id has not."""
    return F.coalesce(F.crc32(id.cast("string")) % modulus == remainder, F.lit(False))


def without_copies(rows: pa.Table) -> pa.Table:
    """Rows by id and text, without those whose five-word shingles are similar to a kept row's."""
    rows = rows.sort_by([("id", "ascending"), ("text", "ascending")])
    kept: list[int] = []
    sets: list[np.ndarray] = []
    seen: set[int] = set()
    for i, x in enumerate(rows.column("text")):
        own = near_copies.shingles(x.as_py())
        key = near_copies.set_key(own)
        if key in seen or any(min(len(own), len(s)) >= near_copies.SIMILARITY * max(len(own), len(s)) - 1e-9 and near_copies.similar(own, s) for s in sets):
            continue
        seen.add(key)
        kept.append(i)
        sets.append(own)
    return rows.take(pa.array(kept, pa.int64()))


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, a few at a time, so that texts never pile up as Python objects."""
    for batch in batches:
        yield from (batch.slice(at, ROWS) for at in range(0, max(batch.num_rows, 1), ROWS))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES) -> Model:
    """Fit on labelled rows that are not held out, at most `examples` of them.

    Rows without a label or with a null one are left out; where labels
    disagree on an id, the greater counts. Without rows of both labels every
    score is near the share of label 1, or 0.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id)))
    few = usable.groupBy(F.col(id).alias("__id")).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(examples)
    # `few` is bounded by the parameter, so it is broadcast.
    chosen = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(few), F.col("id") == F.col("__id"))
    # Near copies would pass their own rare words off as signs of a label, so one
    # of them stays. Rows that share the least hash of five words are compared in full.
    split = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    least = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("ws", i, 5))))
    keyed = chosen.select("id", "text", "y", split.alias("ws")).select(least.alias("key"), "id", "text", "y")
    cut = keyed.groupBy("key", "y").applyInArrow(without_copies, keyed.schema).select("id", "text", "y")
    # A repeated id could repeat its rows without bound, so the parameter bounds them again.
    numbered = cut.withColumn("h", F.xxhash64("id", "text", "y")).orderBy(F.xxhash64("id"), "id", "h").limit(examples)
    chosen = materialize(numbered.withColumn("n", F.row_number().over(Window.orderBy(F.xxhash64("id"), "id", "h")) - 1).select("n", "id", "text", "y"), "labelled")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [term_counts(x.as_py()) for x in batch.column(1)]
            packed = [pa.array([h[i].tobytes() for h in held], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *packed], ["n", "y", "terms", "counts"])

    # All that is collected below is bounded by the parameter.
    spread = chosen.repartition(min(chosen.sparkSession.sparkContext.defaultParallelism, FEW_PARTITIONS))
    got = sorted(spread.select("n", "text", "y").mapInArrow(counts, "n int, y int, terms binary, counts binary").collect(), key=lambda r: r["n"])
    ids = [r["id"] for r in sorted(chosen.select("n", "id").collect(), key=lambda r: r["n"])]
    marks = np.array([r["y"] for r in got], np.int64)
    rows, ones = len(marks), int(marks.sum())
    held = [(np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in got]
    del got
    every = np.concatenate([h for h, _ in held] or [np.empty(0, np.uint64)])
    counted = np.concatenate([c for _, c in held] or [np.empty(0, np.int64)])
    sizes = np.array([len(h) for h, _ in held], np.int64)
    del held
    known, at = np.unique(every, return_inverse=True)
    n1 = np.bincount(at, np.repeat(marks, sizes), len(known)).astype(np.int64)
    examples = Examples(known, np.bincount(at, minlength=len(known)) - n1, n1, ids, marks, at, counted, sizes)
    sent = docs.sparkSession.sparkContext.broadcast(examples)  # bounded by the parameter
    del every, counted, at, examples
    give_back()
    model = Model(sent, marks, np.array([0.0, 1.0]), np.array([0.0, 1.0]), float(ones > 0))
    if not ones or ones == rows:
        return model

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each example's vote by the others, null without a neighbour."""
        m = sent.value
        for batch in few_rows(batches):
            near = m.neighbours(batch.column(1).to_pylist(), batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([vote(n, m.labels) if n else None for n in near], pa.float64())], ["y", "vote"])

    votes = spread.select("n", "text", "y").mapInArrow(left_out, "y int, vote double").collect()
    seen = [(r["vote"], r["y"]) for r in votes if r["vote"] is not None]
    alone = [r["y"] for r in votes if r["vote"] is None]
    x, y = isotonic(np.array([v for v, _ in seen]), np.array([m for _, m in seen])) if seen else (model.votes, model.chances)
    # Texts without a neighbour are as toxic as the examples without one; without such, half as the least vote.
    prior = (sum(alone) + 0.5) / (len(alone) + 1) if alone else 0.5 * float(y[0])
    if not seen:  # nothing tells what a vote is worth
        y = np.full(2, prior)
    return replace(model, votes=x, chances=y, prior=prior)


def classify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of `keep` with score, predicted and evidence.

    Score is the calibrated chance of label 1; `evidence` lists the nearest
    examples as (id, label, similarity), nearest first. Null and empty texts
    and texts without a known term get the prior and no evidence. One row out
    for each row in.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    cols = [F.col(f"`{c}`") for c in keep]
    schema = df.select(*cols, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(None).cast("array<struct<id:string,label:int,similarity:double>>").alias("evidence")).schema
    kind = pa.list_(pa.struct([("id", pa.string()), ("label", pa.int32()), ("similarity", pa.float64())]))
    names = [*keep, "score", "predicted", "evidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.sent.value
        for batch in few_rows(batches):
            near = list(m.neighbours(batch.column(len(keep)).to_pylist()))
            scores = [model.score(n) for n in near]
            shown = [[{"id": str(m.ids[i]), "label": int(m.labels[i]), "similarity": s} for s, i in n] for n in near]
            made = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(shown, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names)

    return df.select(*cols, F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def reject(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`df` without the rows predicted toxic; the others pass unchanged."""
    where = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.sent.value
        for batch in few_rows(batches):
            scores = [model.score(n) for n in m.neighbours(batch.column(where).to_pylist())]
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return df.mapInArrow(run, df.schema)
