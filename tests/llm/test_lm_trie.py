import collections
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import lm_trie

from .corpus import documents, frame


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**7), max_size=300))
def test_elias_fano_round_trip(values):
    values = np.array(sorted(values), np.int64)
    assert lm_trie.EliasFano.of(values).decode().tolist() == values.tolist()


@settings(max_examples=30, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 30), st.integers(0, 40)), max_size=120), st.integers(1, 40))
def test_trie_look_up(tmp_path_factory, pairs, span):
    words = 41
    pairs = sorted(pairs)
    contexts, followers = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    rng = np.random.default_rng(len(pairs))
    unigram, back, codes = rng.integers(0, 999, words), rng.integers(0, 999, words), rng.integers(0, 999, len(pairs))
    old, lm_trie.SPAN = lm_trie.SPAN, span
    try:
        trie = lm_trie.Trie(str(tmp_path_factory.mktemp("t")), words, contexts, followers, codes, unigram, back)
        every = [(u, w) for u in range(31) for w in range(words)]
        got = trie.look_up(np.array([u for u, _ in every]), np.array([w for _, w in every]))
        trie.close()
    finally:
        lm_trie.SPAN = old
    known = dict(zip(pairs, codes.tolist()))
    assert got.tolist() == [known.get((u, w), back[u] + unigram[w]) for u, w in every]


def brute(texts, train):
    c, b = collections.Counter(), collections.Counter()
    rows = [("".join(x.lower() if "A" <= x <= "Z" else x for x in t or "").encode().split() + [b"\n"], m) for t, m in zip(texts, train)]
    for w, m in rows:
        if m:
            c.update(w)
            b.update(zip([b"\t", *w[:-1]], w))
    total, kinds = collections.Counter(), collections.Counter()
    for (u, _), n in b.items():
        total[u] += n
        kinds[u] += 1
    n, v = sum(c.values()), len(c)
    once, twice = sum(x == 1 for x in b.values()), sum(x == 2 for x in b.values())
    d = once / (once + 2 * twice) if once and twice else 0.5
    out = []
    for w, _ in rows:
        before, base, own = b"\t", 0.0, 0.0
        for x in w:
            p = (c[x] + 1) / (n + v + 1)
            base += math.log10(p)
            t = total.get(before, 0)
            own += math.log10(max(b.get((before, x), 0) - d, 0) / t + d * kinds[before] / t * p if t else p)
            before = x
        out.append((len(w), sum(c[x] > 0 for x in w), n, base, own))
    return out


@pytest.mark.parametrize("chunk", [50, 1_500_000])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm_trie, "CHUNK_TOKENS", chunk)
    texts = documents(90) + ["the the the the of the"] * 30 + ["a b c " * 2000]
    train = [i % 7 != 2 for i in range(len(texts))]
    df = frame(spark, texts).repartition(3).withColumn("m", F.col("doc_id") % 7 != 2)
    got = {r.doc_id: r for r in lm_trie.score(df, F.col("m"), keep=["doc_id"]).collect()}
    assert len(got) == len(texts)
    for i, (tokens, known, n, base, own) in enumerate(brute(texts, train)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(own, abs=tokens * 6e-4)


def test_edge_tables(spark):
    df = frame(spark, [None, "", "x", "x"])
    none = lm_trie.score(df, F.lit(False), keep=["doc_id"]).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in none} == {(0, 0, 0.0, 0.0)}
    assert lm_trie.score(df.limit(0), F.lit(True), keep=["doc_id"]).count() == 0
    clash = df.withColumnRenamed("source", "score_").withColumn("chunk", F.lit(1))
    assert lm_trie.score(clash, F.lit(True), keep=["doc_id", "chunk"]).count() == 4


def brute_of_order(texts, train, order):
    """Absolute discounting over n-grams up to `order`, counted anew."""
    rows = ["".join(x.lower() if "A" <= x <= "Z" else x for x in t or "").split(None) for t in texts]
    rows = [[*(("<", k) for k in range(order - 1, 0, -1)), *w, ">"] for w in rows]
    c = collections.Counter(x for w, m in zip(rows, train) if m for x in w[order - 1 :])
    n, v = sum(c.values()), len(c)
    levels = []
    for k in range(2, order + 1):
        grams = collections.Counter(tuple(w[i : i + k]) for w, m in zip(rows, train) if m for i in range(order - k, len(w) - k + 1))
        once, twice = sum(x == 1 for x in grams.values()), sum(x == 2 for x in grams.values())
        total, kinds = collections.Counter(), collections.Counter()
        for g, x in grams.items():
            total[g[:-1]] += x
            kinds[g[:-1]] += 1
        levels.append((grams, total, kinds, once / (once + 2 * twice) if once and twice else 0.5))
    out = []
    for w in rows:
        own = 0.0
        for i in range(order - 1, len(w)):
            p = (c[w[i]] + 1) / (n + v + 1)
            for k, (grams, total, kinds, d) in enumerate(levels, 2):
                context = tuple(w[i - k + 1 : i])
                if total[context]:
                    p = max(grams[*context, w[i]] - d, 0) / total[context] + d * kinds[context] / total[context] * p
            own += math.log10(p)
        out.append((len(w) - order + 1, own))
    return out


@pytest.mark.parametrize("order,shard", [(2, 700), (3, 2_000_000), (3, 900), (4, 1500)])
def test_orders_and_shards_against_brute_force(spark, monkeypatch, order, shard):
    monkeypatch.setattr(lm_trie, "CHUNK_TOKENS", 2000)
    monkeypatch.setattr(lm_trie, "SHARD_TOKENS", shard)
    texts = documents(90) + ["the the the the of the"] * 30 + ["a b c " * 2000, "of the of the of " * 300, "of the man"] + ["of the " + w for w in "x y z u v w".split()]
    train = [i % 7 != 2 for i in range(len(texts))]
    df = frame(spark, texts).repartition(3).withColumn("m", F.col("doc_id") % 7 != 2)
    got = {r.doc_id: r for r in lm_trie.score(df, F.col("m"), keep=["doc_id"], order=order).collect()}
    for i, (tokens, own) in enumerate(brute_of_order(texts, train, order)):
        assert got[i].n_tokens == tokens
        assert got[i].score == pytest.approx(own, abs=tokens * 3e-4 * order)


def test_hot_prefixes_are_split():
    rng = np.random.default_rng(2)
    columns = [np.array([7] * 500, np.uint64) << np.uint64(60), rng.integers(0, 1 << 63, 500).astype(np.uint64) << np.uint64(1), rng.integers(0, 1 << 63, 500).astype(np.uint64) << np.uint64(1)]
    assert len(set(lm_trie._shards(columns, 4, [lm_trie._Hot([]), lm_trie._Hot([])]).tolist())) == 1
    hot = lm_trie._Hot([(7 << 60, 4, 500)])
    assert len(set(lm_trie._shards(columns, 4, [hot, lm_trie._Hot([])]).tolist())) == 16


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=300), st.lists(st.integers(0, 4000), min_size=1, max_size=50))
def test_coded_search(values, wanted):
    values = np.array(sorted(set(values)), np.int64)
    place = {v: i for i, v in enumerate(values.tolist())}
    assert lm_trie.EliasFano.of(values).find(np.array(wanted)).tolist() == [place.get(w, -1) for w in wanted]


def test_scores_come_from_the_trie(spark, monkeypatch):
    texts = ["a b c d"] * 20 + ["e f"]
    df = frame(spark, texts)
    whole = lm_trie.score(df, F.lit(True), keep=["doc_id"], order=3).where("doc_id = 0").first().score
    monkeypatch.setattr(lm_trie, "_tries", lambda counted, *_: counted.select("shard", "blob").limit(0))
    bare = lm_trie.score(df, F.lit(True), keep=["doc_id"], order=3).where("doc_id = 0").first()
    assert whole > bare.score + 1 and bare.score == pytest.approx(bare.base_score)
