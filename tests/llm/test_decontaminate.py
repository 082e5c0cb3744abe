import re

import pytest

from tessera.llm.decontaminate import clean, find

from .corpus import documents, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(texts, items):
    windows = {}
    for key, t in items:
        ws = WORD.findall(low(t))
        for i in range(max(1, len(ws) - 7)) if ws else []:
            windows.setdefault(tuple(ws[i : i + 8]), set()).add(key)
    out = []
    for t in texts:
        ws = WORD.findall(low(t))
        hit, found = set(), set()
        for w, keys in windows.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found |= keys
        out.append((len(ws), len(hit), sorted(map(str, found))))
    return out


@pytest.fixture
def planted():
    texts = documents(60)
    items = [(10, " ".join((texts[20] or "a b c").split()[:12])), (2, "Short item"), (3, None), (4, "  !! "), (11, texts[25]), (12, texts[25])]
    texts[7] = "So: SHORT, item. " + (texts[20] or "")
    texts[8] = texts[7]
    return texts, items


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_against_brute_force(spark, planted, bound):
    texts, items = planted
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = find(frame(spark, texts), bench, keep=["doc_id"], broadcast_windows=bound).collect()
    assert sorted((r.row.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == [(i, w, h, tuple(k)) for i, (w, h, k) in enumerate(brute(texts, items))]


def test_empty_tables(spark, planted):
    texts, items = planted
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, texts)
    assert find(docs.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in find(docs, bench.limit(0)).collect())


def test_clean_cuts_spans_and_keeps_the_rest(spark):
    passage = "one two three four five six seven eight nine"
    bench = spark.createDataFrame([(1, passage), (2, "uno dos tres cuatro cinco seis siete ocho")], "item_id bigint, text string")
    texts = ["Before it. One, two three four five six seven eight NINE! After", "nothing here", None, passage + " uno dos tres cuatro cinco seis siete ocho", ""]
    got = {r.doc_id: r for r in clean(frame(spark, texts), bench).collect()}
    assert sorted(got) == [0, 1, 2, 4]
    assert got[0].text == "Before it! After" and got[0].n_chars == len(got[0].text)
    assert got[1].text == "nothing here" and got[2].text is None and got[4].text == ""
    assert clean(frame(spark, texts), bench).columns == ["doc_id", "text", "lang", "source", "n_chars"]
