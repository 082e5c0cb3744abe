import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import near_copies, simhash

from .corpus import documents, frame, text, word


def variants(n=60, seed=5):
    """Families of texts in which each has some words of an earlier one replaced."""
    rng = random.Random(seed)
    out = documents(120)
    for _ in range(n):
        family = [text(rng, rng.choice([12, 60, 200, 700])).split()]
        for _ in range(5):
            words = list(rng.choice(family))
            for _ in range(rng.randint(1, 1 + len(words) // 60)):
                words[rng.randrange(len(words))] = word(rng)
            family.append(words)
        out += [" ".join(w) for w in family]
    line = text(rng, 30)
    out += [f"{text(rng, 20)} {line} {text(rng, rng.randint(1, 20))}" for _ in range(150)]
    return out


def brute_force(texts):
    sets = [near_copies.shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if near_copies.similar(sets[a], sets[b])]
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i for i in up if find(i) == i}, pairs


@pytest.mark.parametrize("block", [near_copies.BLOCK, 400])
def test_stage_keeps_one_of_each_group(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = variants()
    kept, pairs = brute_force(texts)
    assert len(pairs) > 100 and len(kept) < len(texts) - 100
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, texts), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept)


def test_large_buckets_and_frequent_shingles(spark, monkeypatch):
    for name, value in (("SMALL_BUCKET", 2), ("SAMPLE", 1), ("FREQUENT", 2), ("PART", 50)):
        monkeypatch.setattr(near_copies, name, value)
    texts = variants(20, 8)
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, texts), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(brute_force(texts)[0])


def test_similar_sets_meet_in_a_part(monkeypatch):
    monkeypatch.setattr(near_copies, "PART", 50)
    texts = variants(20, 9)
    _, pairs = brute_force(texts)
    late = near_copies.shingles(texts[-1])
    for a, b in pairs:
        sets = [near_copies.shingles(texts[i]) for i in (a, b)]
        if not len(sets[0]) or near_copies.set_key(sets[0]) == near_copies.set_key(sets[1]):
            continue
        one, two = ({n: (p, set((near_copies.prefix(p, late) ^ salt).tolist())) for n, p, salt in near_copies.parts(s)} for s in sets)
        assert any(one[n][1] & two[n][1] and near_copies.similar(one[n][0], two[n][0]) for n in one.keys() & two.keys())


def test_simhash_finds_most_groups_and_the_join_the_rest(spark, monkeypatch):
    texts = variants(60, 10)
    kept, pairs = brute_force(texts)
    joined = []

    def none(entries):
        joined.append(entries.where("key != known").count())
        return entries.limit(0).select("token", "key", "unit")

    monkeypatch.setattr(near_copies, "shared", none)
    out = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, texts), "").collect()}
    # Without the join nothing dissimilar goes, and most near copies are gone.
    assert kept <= out
    same = len({near_copies.set_key(near_copies.shingles(t)) for t in texts})
    assert same - len(out) >= 0.7 * (same - len(kept)) > 50
    assert joined[0] > 0


def test_tokens_of_one_group_are_not_joined(spark):
    rows = [(1, 10, 1, 10), (1, 11, 1, 10), (2, 10, 1, 10), (2, 11, 1, 10), (2, 12, 1, 12), (3, 12, 1, 12), (2, 12, 1, 12)]
    df = spark.createDataFrame(rows, "token bigint, key bigint, unit int, known bigint")
    assert sorted(tuple(r) for r in near_copies.shared(df).collect()) == [(2, 10, 1), (2, 11, 1), (2, 12, 1)]


def test_simhash_alone_finds_every_group(spark, monkeypatch):
    texts = variants(60, 10)
    kept, pairs = brute_force(texts)
    assert len(pairs) > 100
    monkeypatch.setattr(near_copies, "shared", lambda entries: entries.limit(0).select("token", "key", "unit"))
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, texts), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept)


def test_fingerprints_within_the_words_radius_are_linked(spark):
    rng, most = random.Random(11), near_copies.WORDS * (near_copies.RADIUS + 1) - 1
    rows = []
    for i in range(100):
        fps = [rng.getrandbits(64) for _ in range(near_copies.WORDS)]
        rows.append((2 * i, 9, fps))
        for bit in rng.sample(range(64 * len(fps)), most):
            fps = [x ^ (1 << bit % 64 if j == bit // 64 else 0) for j, x in enumerate(fps)]
        rows.append((2 * i + 1, 9, fps))
    rows = [(k, n, np.array(fps, np.uint64).view(np.int64).tolist()) for k, n, fps in rows]
    own = spark.createDataFrame(rows, "key bigint, total int, fps array<bigint>")
    roots = {}
    for r in near_copies.by_fingerprint(own, near_copies.RADIUS).collect():
        roots.setdefault(r.n_key, set()).add(r.root)
    assert all(roots.get(2 * i, set()) & roots.get(2 * i + 1, set()) for i in range(100))
    # Components of the same sets come once.
    assert all(len(roots[k]) == 1 for k in roots)


def test_words_of_a_fingerprint(spark):
    rng = np.random.default_rng(2)
    own = np.unique(rng.integers(0, 2**64, 700, dtype=np.uint64))
    fps = near_copies.fingerprint(own)
    assert len(fps) == near_copies.WORDS == len(set(fps.tolist()))
    votes = np.zeros((near_copies.WORDS, 64), int)
    for h in own.tolist():
        for i in range(near_copies.WORDS):
            x = (h + (i + 1) * 0x9E3779B97F4A7C15) % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            x ^= x >> 31
            votes[i] += [x >> b & 1 for b in range(64)]
    # Which bit has which place does not matter.
    assert [int(x).bit_count() for x in fps] == [int((v * 2 > len(own)).sum()) for v in votes]
    assert near_copies.fingerprint(own[:0]).tolist() == [0] * near_copies.WORDS


def test_a_large_group_gives_hardly_more_edges_than_nodes(spark, monkeypatch):
    rng = random.Random(12)
    base = text(rng, 200).split()
    texts = documents(40)
    for _ in range(300):
        words = list(base)
        words[rng.randrange(len(words))] = word(rng)
        texts.append(" ".join(words))
    counts, components = [], near_copies.components

    def counted(edges):
        counts.append((edges.count(), edges.select("a").union(edges.select("b")).distinct().count()))
        return components(edges)

    monkeypatch.setattr(near_copies, "components", counted)
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, texts), "").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert out == brute_force(texts)[0]
    # The group's nodes meet in nearly all of the 16 tasks.
    assert counts[0][1] > 600 and all(edges <= 2 * nodes for edges, nodes in counts)


@pytest.mark.parametrize("forest", [simhash.FOREST, 10])
def test_merged_forests_connect_the_same(spark, monkeypatch, forest):
    monkeypatch.setattr(simhash, "FOREST", forest)
    rng = random.Random(13)
    rows = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(-7, x) for x in range(50)] * 5
    edges = spark.createDataFrame(rows, "a bigint, b bigint").repartition(5)
    want = {(r.node, r.root) for r in simhash.components(edges).collect()}
    for got in (simhash.merged(edges), near_copies.thinned(simhash.merged(edges))):
        assert got.count() < len(rows)
        assert {(r.node, r.root) for r in simhash.components(got).collect()} == want
