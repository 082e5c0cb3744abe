import random

import pytest

import corpus_pipeline
from tessera.llm import simhash
from tessera.llm.catalog import ORACLES, QUERIES

from ..oracle import FOLDER, compare
from .corpus import text

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Planted toxic documents, copies, a benchmark passage and a secret among clean texts."""
    rng = random.Random(12)
    root = tmp_path_factory.mktemp("sf")
    texts = [text(rng, rng.randint(60, 200)) for _ in range(600)]
    for i in range(0, 600, 6):
        words = texts[i].split()
        for _ in range(5):
            words.insert(rng.randrange(len(words)), rng.choice(["zwurmig", "zwurmen", "glopf"]))
        texts[i] = " ".join(words)
    passage = text(rng, 40)
    texts[101] = texts[100]
    texts[201] = f"{texts[201]}\n{passage}\n{text(rng, 80)}"
    texts[301] += " token = abcdef0123456789abcdef"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(600, None, None, None, None), (601, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), texts, passage


def test_stages_take_effect(spark, folder):
    root, texts, passage = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root).persist()
        seen.append({r.doc_id: r for r in out.collect()})
        assert name == "bpe_encoding" or out.columns == columns
        docs = out
    toxic, unique, clean, safe, coded = seen
    assert sum(i in toxic for i in range(0, 600, 6)) < 5
    assert sum(i in toxic for i in range(600) if i % 6) > 495
    assert 101 not in unique
    fps = {i: simhash.fingerprint(simhash.text_words(r.text)) for i, r in toxic.items()}
    assert {i for i in fps if not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 4 for j in fps)} == set(unique)
    assert set(clean) == set(unique) and passage not in clean[201].text and clean[201].n_chars == len(clean[201].text)
    assert all(clean[i].text == unique[i].text for i in clean if i != 201)
    assert "abcdef0123456789" not in safe[301].text and set(safe) == set(clean)
    assert all(safe[i].text == clean[i].text for i in safe if i != 301)
    assert set(coded) == set(safe) and coded[301].ids


def test_run_equals_its_stages(spark, folder):
    root = folder[0]
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
    own = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, root).collect())
    assert own == sorted((r.doc_id, tuple(r.ids)) for r in docs.collect())


def test_shape():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(QUERIES) and len(QUERIES) == 10


@pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])
