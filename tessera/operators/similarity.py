"""Similarity of file embeddings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components

#: Vectors of one block that meet one other block at a time.
BLOCK_ROWS = 2000


def blocks(df: DataFrame, n: int) -> int:
    """Blocks that make pairs of blocks equal tasks."""
    return max(1, math.ceil(n / BLOCK_ROWS))


def pairs(vectors: DataFrame, least: float, id: str = "id", vector: str = "vector") -> DataFrame:
    """(a, b, similarity), a < b, of all pairs whose cosine is `least` or more.

    All pairs have to be compared, so the rows are dealt into blocks by hash,
    and each pair of blocks is one group of bounded size whose cosines are one
    matrix product. Only pairs over the threshold leave it. Null, empty and
    zero vectors have no pairs; vectors of different lengths do not meet.
    """
    import numpy as np
    import pyarrow as pa

    n = blocks(vectors, vectors.count())
    block = F.pmod(F.xxhash64(id), F.lit(n)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: F.struct(F.least(F.col("block"), o).alias("p"), F.greatest(F.col("block"), o).alias("q")))
    base = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"), block.alias("block")).where(F.size("v") > 0)
    dealt = base.select("id", "v", "block", F.size("v").alias("d"), F.explode(cells).alias("cell")).select("id", "v", "block", "cell.p", "cell.q", "d")
    kind = vectors.schema[id].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        block, ids = table.column("block").to_numpy(), table.column("id").to_pylist()
        m = np.array(table.column("v").to_pylist(), np.float64)
        norm = np.sqrt((m * m).sum(axis=1))
        m /= np.where(norm > 0, norm, 1.0)[:, None]
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        left, right = np.flatnonzero((block == p) & (norm > 0)), np.flatnonzero((block == q) & (norm > 0))
        dots = m[left] @ m[right].T
        i, j = np.nonzero(dots >= least)
        found = [(ids[left[x]], ids[right[y]], float(dots[x, y])) for x, y in zip(i.tolist(), j.tolist())]
        # Inside one block each pair is met from both sides.
        found = [(a, b, s) for a, b, s in found if a < b] if p == q else [(a, b, s) if a < b else (b, a, s) for a, b, s in found if a != b]
        return pa.table({"a": pa.array([f[0] for f in found], table.schema.field("id").type), "b": pa.array([f[1] for f in found], table.schema.field("id").type), "similarity": pa.array([f[2] for f in found], pa.float64())})

    return dealt.groupBy("p", "q", "d").applyInArrow(run, f"a {kind}, b {kind}, similarity double")


def top_pairs(vectors: DataFrame, k: int, least: float = -1.0, id: str = "id", vector: str = "vector") -> DataFrame:
    """The k most similar pairs, ties by ids."""
    return pairs(vectors, least, id, vector).orderBy(F.desc("similarity"), "a", "b").limit(k)


def matrix(vectors: DataFrame, least: float = -1.0, id: str = "id", vector: str = "vector") -> DataFrame:
    """(a, b, similarity) in both directions."""
    one = pairs(vectors, least, id, vector)
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))


def clusters(vectors: DataFrame, least: float, id: str = "id", vector: str = "vector") -> DataFrame:
    """(id, cluster, size): single linkage at a threshold; a cluster is named by its least id."""
    linked = components(pairs(vectors, least, id, vector).select("a", "b"))
    every = vectors.select(F.col(id).alias("id")).distinct().join(linked, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster"))
    return every.join(every.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster").select("id", "cluster", "size")


def centroids(vectors: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """(group, vector): element-wise means."""
    each = vectors.select(F.col(group).alias("group"), F.posexplode(vector).alias("pos", "x"))
    means = each.groupBy("group", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))


def refine(group_files: DataFrame, vectors: DataFrame, least: float = 0.75, small: int = 5) -> DataFrame:
    """(path, group_no): small groups merged greedily, the closest pair of centroids first.

    `group_files` is (path, group_no), `vectors` (path, vector). The merging is
    sequential over groups, of which a change set has few; the driver holds
    sums and sizes of small groups only, never files.
    """
    import numpy as np

    sizes = group_files.groupBy("group_no").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= small)
    sums = group_files.join(sizes, "group_no").join(vectors, "path", "left")
    each = sums.groupBy("group_no", "n").agg(F.collect_list("vector").alias("vs")).collect()
    state = {r["group_no"]: (r["n"], np.sum(np.array(r["vs"], float), axis=0) if r["vs"] else None, len(r["vs"])) for r in each}
    into: dict[int, int] = {}
    while True:
        best = None
        alive = sorted(g for g, (n, s, c) in state.items() if n <= small and c)
        units = {g: state[g][1] / max(float(np.linalg.norm(state[g][1])), 1e-300) for g in alive}
        for i, a in enumerate(alive):
            for b in alive[i + 1 :]:
                s = float(units[a] @ units[b])
                if s >= least and (best is None or s > best[0]):
                    best = (s, a, b)
        if best is None:
            break
        _, a, b = best
        (na, sa, ca), (nb, sb, cb) = state[a], state.pop(b)
        state[a] = (na + nb, sa + sb, ca + cb)
        into = {k: (a if v == b else v) for k, v in into.items()} | {b: a}
    if not into:
        return group_files.select("path", "group_no")
    moved = group_files.sparkSession.createDataFrame(sorted(into.items()), "old int, new int")
    return group_files.join(F.broadcast(moved), F.col("group_no") == F.col("old"), "left").select("path", F.coalesce("new", "group_no").alias("group_no"))

