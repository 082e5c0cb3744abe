import hashlib
import math
import random

import numpy as np

from tessera.llm import fingerprint as fp

from .corpus import documents, text


def test_entropy_against_counting():
    rng = random.Random(5)
    for n in (64, 65, 130, 400):
        data = bytes(rng.choice(b"abcdeeee  xyz" + bytes(range(30))) for _ in range(n))
        ranks = fp._entropy_ranks(np.frombuffer(data, np.uint8))
        for i in range(n - 63):
            w = data[i : i + 64]
            h = -sum(w.count(x) / 64 * math.log2(w.count(x) / 64) for x in set(w)) / 6
            e = round(1000 * h)
            assert abs((1000 - ranks[i] if ranks[i] < 4096 else 0) - (e if e >= fp.COMMON else 0)) <= 1


def test_digests_depend_on_the_text_alone(monkeypatch):
    rng = random.Random(2)
    texts = [text(rng, n) for n in (1, 5, 60, 300, 3000, 300)]
    texts[-1] = texts[3]
    together = [d.text() for d in fp.digests(texts)]
    assert together == [fp.digests([t])[0].text() for t in texts] and together[3] == together[5]
    monkeypatch.setattr(fp, "PIECE", 700)
    assert [d.text() for d in fp.digests(texts)] == together


def test_likeness_tells_edits_from_strangers():
    rng = random.Random(4)
    texts = [text(rng, rng.choice([6, 40, 200, 900])) for _ in range(120)]
    own = fp.digests(texts)
    changed = fp.digests([fp.edited(a, b) for a, b in zip(texts, texts[1:])])
    near = [fp.likeness(a, b) for a, b in zip(own, changed)]
    far = [fp.likeness(a, b) for a, b in zip(own, own[1:])]
    assert min(near) > max(far) and all(0 <= x <= 1 for x in near + far)
    assert fp.likeness(own[0], own[0]) == 1.0
    blank = fp.digests([None, ""])
    assert fp.likeness(blank[0], blank[1]) == 1.0 and fp.likeness(blank[0], own[0]) == 0.0


def test_neighbours_against_sorting(spark):
    texts = documents(80)
    rng = random.Random(9)
    ids = rng.sample(range(-500, 500), len(texts))
    df = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts)], "doc_id bigint, text string, n_chars int")
    got = {r.doc_id: r for r in fp.compare_neighbours(df).collect()}
    rows = sorted(zip(ids, [t or "" for t in texts]))
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        r, cut = got[i], len(t) // 4
        changed = t[: len(t) - cut] + n[:cut]
        a, b, c = fp.digests([t, changed, n])
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (a.text(), b.text())
        assert (r.near_edited, r.near_next) == (fp.likeness(a, b), fp.likeness(a, c))


def test_few_rows_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, None), (2, "")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_chars) for r in fp.compare_neighbours(df).collect()) == [(0, 0), (1, 3), (1, 3), (2, 0)]
    one = fp.compare_neighbours(df.limit(1)).first()
    assert one.near_next == 1.0 and fp.compare_neighbours(df.limit(0)).count() == 0
    assert fp.fingerprints(df, keep=["doc_id"]).count() == 4


def brute_features(data, ranked):
    """Every run looked at on its own."""
    windows = [data[i : i + 8] for i in range(len(data) - 7)]
    entropy = lambda w: -sum(w.count(x) / 8 * math.log2(w.count(x) / 8) for x in set(w)) / 3
    ranks = [int(ranked[round(1000 * entropy(w))]) for w in windows]
    places = set()
    for i in range(max(1, len(windows) - 7)) if windows else []:
        places.add(min(range(i, min(i + 8, len(windows))), key=lambda j: (ranks[j], j)))
    return list(dict.fromkeys(windows[i] for i in sorted(places)))


def test_features_bits_and_likeness_against_brute_force():
    rng = random.Random(11)
    ranked = fp.rarity(np.array([rng.randint(0, 9) for _ in range(1001)]))
    texts = [text(rng, n).encode() for n in (1, 2, 3, 4, 9, 30, 200, 700)] + [b"abcdefgh", b"abcdefghi", b"a" * 40, b"ab" * 2000]
    for t, hashes in zip(texts, fp.features(texts, ranked)):
        if len(t) < 8:
            assert len(hashes) == 1
            continue
        windows = brute_features(t, ranked)
        assert hashes.tolist() == [int(fp._hashes(np.frombuffer(w, np.uint8), np.array([0]))[0]) for w in windows]
        d = fp.Digest(hashes)
        for i in range(0, len(hashes), 160):
            want = {int(h) >> 11 * k & 2047 for h in hashes[i : i + 160].tolist() for k in range(5)}
            assert set(np.flatnonzero(np.unpackbits(d.chain[i // 160])).tolist()) == want
    a, b = fp.digests([texts[7].decode(), texts[7][:2000].decode(errors="ignore") + " other end of it"])
    sets = [[set(np.flatnonzero(np.unpackbits(r)).tolist()) for r in d.chain] for d in sorted((a, b), key=lambda d: (len(d.chain), d.n))]
    total = 0.0
    for x in sets[0]:
        best = 0.0
        for y in sets[1]:
            chance, most = len(x) * len(y) / 2048, min(len(x), len(y))
            floor = chance + 0.3 * (most - chance)
            best = max(best, min(1.0, max(0.0, (len(x & y) - floor) / max(most - floor, 1e-9))))
        total += best * len(x)
    assert abs(fp.likeness(a, b) - total / sum(map(len, sets[0]))) < 1e-12


def test_one_rule_for_all_lengths():
    rng = random.Random(12)
    whole = text(rng, 900)
    sizes = [len(f) for f in fp.features([whole.encode()[:n] for n in range(900, 1200)])]
    assert max(abs(a - b) for a, b in zip(sizes, sizes[1:])) <= 2


def test_low_entropy_texts_are_told_apart():
    ab, cd, blank = fp.digests(["ab" * 2000, "cd" * 2000, ""])
    assert ab.n and fp.likeness(ab, cd) == 0.0 and fp.likeness(ab, blank) == 0.0
    longer = fp.digests(["ab" * 3000])[0]
    assert fp.likeness(ab, longer) == 1.0


def test_rarity_is_measured_on_all_windows(spark, monkeypatch):
    texts = documents(40) + ["aaaaaaaaaaaaaaaa"]
    counts = np.zeros(1001, np.int64)
    for t in texts:
        data = (t or "").encode()
        for i in range(len(data) - 7):
            w = data[i : i + 8]
            counts[round(-1000 * sum(w.count(x) / 8 * math.log2(w.count(x) / 8) for x in set(w)) / 3)] += 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert fp.measured_rarity(df).tolist() == fp.rarity(counts).tolist()
    ranks = fp.rarity(counts)
    assert sorted(ranks.tolist()) == list(range(1001)) and ranks[: fp.WEAK].min() > ranks[fp.WEAK :].max()
