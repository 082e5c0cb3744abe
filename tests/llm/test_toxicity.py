import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.toxicity import ROWS, Examples, few_rows
from tessera.llm.toxicity import EXAMPLES, NEIGHBOURS, RELEVANCE, BlockMaxIndex, classify, fit, held_out, isotonic, reject, unit, without_copies

from .corpus import frame, text


def test_index_is_exact():
    rng = np.random.default_rng(0)
    idf = 1 + rng.random(60)
    vectors = [unit({int(t): int(rng.integers(1, 4)) for t in rng.choice(60, rng.integers(0, 9), replace=False)}, idf) for _ in range(500)]
    dense = np.zeros((500, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = BlockMaxIndex(vectors, 60)
    for q in range(0, 500, 7):
        t, w = vectors[q]
        for without in (-1, q):
            scores = np.round(dense[:, t] @ w, 12) if len(t) else np.zeros(500)
            if without >= 0:
                scores[without] = 0
            want = [i for i in sorted(range(500), key=lambda i: (-scores[i], i))[:15] if scores[i] > 0]
            assert [i for _, i in index.nearest(t, w, 15, without)] == want
    assert BlockMaxIndex([], 3).nearest(np.array([1]), np.array([1.0]), 5) == []


def test_calibration_is_monotone():
    rng = np.random.default_rng(1)
    votes = rng.random(300)
    x, y = isotonic(votes, (rng.random(300) < votes).astype(int))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 < y[0] < y[-1] < 1


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    texts, marks = [], []
    for i in range(900):
        words = text(rng, rng.randint(20, 80)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["zwurmig", "zwurmen", "glopf"]))
        texts.append(" ".join(words))
        marks.append(int(toxic))
    texts += [None, ""]
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(900, 1, 0), (7, 1, None), (None, 1, 1), (5000, 0, 1)], "doc_id bigint, quality int, toxic int")
    return frame(spark, texts), labels, marks


def test_held_out_accuracy(spark, labelled):
    docs, labels, marks = labelled
    got = classify(docs.select("doc_id", "text"), fit(docs, labels)).withColumn("held_out", held_out(F.col("doc_id"))).collect()
    assert len(got) == 902
    out = [r for r in got if r.held_out and r.doc_id < 900]
    assert out and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = sum(r.predicted == marks[r.doc_id] for r in out)
    assert right / len(out) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    toxic = next(r for r in out if marks[r.doc_id])
    assert toxic.evidence and toxic.evidence[0].label == 1
    blank = [r for r in got if r.doc_id >= 900]
    assert all(r.score < 0.5 and not r.evidence for r in blank)


def test_reject_keeps_clean_rows_whole(spark, labelled):
    docs, labels, marks = labelled
    kept = reject(docs, fit(docs, labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i, m in enumerate(marks) if not m} | {900, 901} <= ids
    assert sum(i in ids for i, m in enumerate(marks) if m) < 8


def test_without_labels_or_rows(spark, labelled):
    docs, labels, _ = labelled
    model = fit(docs, labels.limit(0))
    assert {r.score for r in classify(docs.select("doc_id", "text"), model).collect()} == {0.0}
    assert classify(docs.limit(0).select("doc_id", "text"), model).count() == 0
    only = fit(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in classify(docs.select("doc_id", "text"), only).collect()} == {0}
    assert EXAMPLES == 10_000


def test_only_confirmed_copies_are_cut():
    words = [f"w{i}" for i in range(100)]
    passage, copy = words[:60], [*words[:99], "other"]
    texts = [" ".join(words), " ".join(copy), " ".join([*passage, *(f"x{i}" for i in range(60))]), " ".join(words)]
    rows = pa.table({"key": [7] * 4, "id": [1, 2, 3, 4], "text": texts, "y": [1] * 4})
    assert without_copies(rows).column("id").to_pylist() == [1, 3]


def test_rows_that_share_a_passage_stay_examples(spark):
    passage = " ".join(f"p{i}" for i in range(300))
    texts = [f"{passage} " + " ".join(f"d{d}w{i}" for i in range(200)) + " zwurmig glopfen" * (d % 2) for d in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id bigint, toxic int")
    n = labels.where(~held_out(F.col("doc_id")) & (F.col("toxic") == 1)).count()
    assert fit(docs, labels).labels.sum() == n


def brute_scores(texts, marks, train):
    """TF-IDF, dense cosine, votes and calibration, counted anew."""
    words = [collections.Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for t in texts]
    ones, zeros = [i for i in train if marks[i]], [i for i in train if not marks[i]]
    names = sorted({w for i in train for w in words[i]})
    share = lambda rows, w: sum(w in words[i] for i in rows)
    weight = []
    for w in names:
        a, c = share(ones, w), share(zeros, w)
        weight.append((math.log((1 + len(train)) / (1 + a + c)) + 1) * math.log2(2 + (a / len(ones)) / ((c + 1) / len(zeros))) ** RELEVANCE)
    rows = np.array([[(1 + math.log(c[w])) * x if c[w] else 0.0 for w, x in zip(names, weight)] for c in words])
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    order = sorted(train, key=lambda i: i)

    def vote(i, others):
        near = sorted(((-round(float(rows[i] @ rows[j]), 12), j) for j in others if rows[i] @ rows[j] > 0))[:NEIGHBOURS]
        w = [1 / (max(0.0, 1 + s) + 0.05) for s, _ in near]
        return sum(x * marks[j] for x, (_, j) in zip(w, near)) / sum(w) if near else None

    x, y = isotonic(np.array([vote(i, [j for j in order if j != i]) for i in order]), np.array([marks[i] for i in order]))
    return [None if (v := vote(i, order)) is None else float(np.interp(v, x, y)) for i in range(len(texts))]


def test_scores_against_brute_force(spark):
    rng = random.Random(6)
    texts, marks = [], []
    for i in range(130):
        words = text(rng, rng.randint(5, 40)).split()
        marks.append(int(i % 4 == 0))
        texts.append(" ".join(words + (["zwurm", "glopf"][: rng.randint(0, 2)] if marks[-1] else [])))
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id bigint, toxic int")
    docs = frame(spark, [*texts, "0 1 2"]).select("doc_id", "text")
    train = [i for i in range(130) if zlib.crc32(str(i).encode()) % 3 != 1]
    got = {r.doc_id: r.score for r in classify(docs, fit(docs, labels)).collect()}
    for i, want in enumerate(brute_scores(texts, marks, train)):
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert got[130] < 0.5


def test_a_worker_lets_go_of_what_it_does_not_need():
    common.kept("other", lambda: [0])
    ids = np.arange(2)
    examples = Examples(np.arange(3, dtype=np.uint64), np.ones(3, np.int64), np.zeros(3, np.int64), [1, 2], ids, np.array([0, 1, 1, 2]), np.ones(4, np.int64), np.full(2, 2))
    list(examples.neighbours(["a", None]))
    assert not common._KEPT and not {"numbers", "counts"} & vars(examples).keys()
    common.kept("one", lambda: [1])
    assert common.kept("two", lambda: [2]) == [2] and list(common._KEPT) == ["two"]
    common.forget()


def test_rows_come_a_few_at_a_time():
    batch = pa.RecordBatch.from_pydict({"x": list(range(2 * ROWS + 3))})
    got = list(few_rows(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in got] == [ROWS, ROWS, 3, 0]
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(2 * ROWS + 3))
