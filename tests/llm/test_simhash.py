import itertools

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import simhash

from .corpus import documents, frame


def brute_fingerprint(t):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    runs = [b" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] if len(ws) >= 4 else [b" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(fps))]


def test_against_brute_force(spark):
    texts = documents(150) + ["a b c d " * 3000]
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(frame(spark, texts)).collect())
    fps = [brute_fingerprint(t) for t in texts]
    assert [g[1] for g in got] == fps
    assert [g[2] for g in got] == brute_components(fps)


def test_chains_across_buckets(spark):
    rng = np.random.default_rng(3)
    fps, x = [], int(rng.integers(1 << 62))
    for _ in range(400):
        for b in rng.choice(64, 3, replace=False).tolist():
            x ^= 1 << b
        fps.append(x)
    fps += [int(v) for v in rng.integers(0, 1 << 62, 400)]
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp bigint, rep bigint")
    for plan in (simhash.allocate(*simhash.bit_counts(df)), [(list(range(32)), 2), (list(range(32, 64)), 1)], [(list(range(22)), 1), (list(range(22, 43)), -1), (list(range(43, 64)), 2)]):
        forest = {r.node: r.root for r in simhash.components(simhash.links(simhash.signatures(df, plan))).collect()}
        signed = [int(np.uint64(f).view(np.int64)) for f in fps]
        want = brute_components(fps)
        got = [forest.get(s, s) for s in signed]
        first = {}
        assert all(first.setdefault(w, g) == g for w, g in zip(want, got)) and len(set(got)) == len(set(want))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 300), st.integers(0, 10**9))
def test_thresholds_sum_to_the_pigeonhole_bound(seed, ones, n):
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (ones, 64))
    plan = simhash.allocate(max(n, ones), (bits.T @ bits) * max(n, ones) // ones)
    assert sum(t for _, t in plan) == 4 - len(plan) + 1
    assert sorted(b for g, _ in plan for b in g) == list(range(64))


def test_wide_buckets_are_searched_whole():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 62, simhash.WIDE_BUCKET + 500).astype(np.uint64))
    near = fps[:50] ^ np.uint64(0b1011)
    pool = np.unique(np.concatenate((fps, near)))
    forest = simhash.Forest()
    simhash.link_bucket(pool, forest)
    assert all(forest.find(int(a)) == forest.find(int(b)) for a, b in zip(fps[:50], near))


def test_deduplicate_keeps_one_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(4, long), (2, long), (2, long), (9, "other words here now"), (None, "other words here now"), (None, None), (7, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fp string")
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicate(df).collect()), key=str)
    assert got == [(2, long), (7, ""), (9, "other words here now")]
    assert simhash.deduplicate(df).columns == df.columns
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_signatures_meet_half_way(spark):
    df = spark.createDataFrame([(5,), (-9,)], "fp bigint")
    for t, each in ((-1, 0), (0, 1), (1, 33), (2, 33), (3, 33 + 496), (4, 33 + 496)):
        plan = [(list(range(32)), t), (list(range(32, 64)), -1)]
        assert simhash.signatures(df, plan).count() == 2 * each


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(1, 4), st.randoms())
def test_values_within_a_threshold_share_a_signature(x, t, rng):
    y = x
    for b in rng.sample(range(32), t):
        y ^= 1 << b
    ball = lambda v: {v ^ sum(1 << b for b in c) for r in range(simhash.meeting(t) + 1) for c in itertools.combinations(range(32), r)}
    assert ball(x) & ball(y)


def test_hot_buckets_are_dealt_out(spark):
    rng = np.random.default_rng(9)
    fps = rng.integers(-(1 << 62), 1 << 62, 200)
    near = fps[:60] ^ (1 << rng.integers(0, 60, 60))
    every = np.unique(np.concatenate((fps, near))).tolist()
    sigs = spark.createDataFrame([(0, 1, f) for f in every] + [(1, 2, f) for f in every[:3]], "part int, sig bigint, fp bigint")
    dealt = simhash.spread_hot(sigs, hot=50)
    assert dealt.where("part = 1").count() == 3 and dealt.count() == 3 + 5 * len(every)
    assert dealt.groupBy("part", "sig").count().agg({"count": "max"}).first()[0] < 30
    forest = {r.node: r.root for r in simhash.components(simhash.links(dealt)).collect()}
    assert all(forest.get(int(a), int(a)) == forest.get(int(b), int(b)) for a, b in zip(fps[:60], near))


def test_correlated_bits_cost_more():
    rng = np.random.default_rng(4)
    sample = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    low = sample & np.uint64(0xFF)
    same = sum(int(a) == int(b) for a, b in itertools.combinations(low.tolist(), 2)) / (500 * 499 / 2)
    assert abs(simhash._close(list(range(8)), 2, sample)[0] - same) < 1e-12
