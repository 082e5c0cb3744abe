import hashlib
import random

import numpy as np
import pytest

from tessera.llm.bpe import WordEndBPE, decode, encode, round_trip

from .corpus import documents, frame

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return WordEndBPE(f.read())


POOLS = [range(32, 127), range(0, 0x250), range(0x370, 0x530), range(0x1E00, 0x2100), [0x3A3, 0x130, 0x212A, 0x41, 0x308, 0x301, 0x20, 0x27], range(0x4E00, 0x4F00), [0x1F600, 0x1F1E6, 0x200D, 0xFE0F, 0x3000, 0x85, 0x1C, 0x1F], range(0xAC00, 0xAC80)]


def test_against_the_library(library, own):
    rng = random.Random(5)
    for _ in range(3000):
        s = "".join(chr(rng.choice(rng.choice(POOLS))) for _ in range(rng.randrange(30)))
        if rng.random() < 0.2:
            s = s[:4] + rng.choice(["<|endoftext|>", "<|startoftext|>", "<|end"]) + s[4:]
        ids = library.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == ids, ascii(s)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_fragments(library, own):
    for s in ("a" * 5000 + " " + "xyz" * 3000, "é" * 4000, "a1" * 3000):
        assert own.encode(s) == library.encode(s, add_special_tokens=False).ids


def test_cuts_are_certain(own):
    rng = random.Random(2)
    symbols = [own.bytes[b] for b in range(256)]
    for _ in range(500):
        word = [rng.choice(symbols) for _ in range(rng.randint(1, 12))]
        word[-1] += own.suffix
        pieces = list(own.split_certain(word))
        assert [s for p in pieces for s in p] == word
        assert [t for p in pieces for t in own.merge(p)] == own.merge(word) == own._merge_long(word)


def test_rows(spark, library):
    texts = documents(40)
    df = frame(spark, texts).select("doc_id", "text")
    got = {r.doc_id: r for r in round_trip(df, PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = decode(encode(df, PATH), PATH).orderBy("doc_id").collect()
    assert back[3].decoded == back[5].decoded == ""
    assert encode(df.limit(0), PATH).count() == 0
