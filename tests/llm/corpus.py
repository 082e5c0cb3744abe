"""Small invented tables for the tests of the training-data operators."""

import random

SYLLABLES = ["an", "ble", "er", "est", "ion", "ka", "lo", "mi", "nd", "ou", "re", "ti", "wh", "ü", "é"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def text(rng, n):
    return " ".join(word(rng) for _ in range(n))


def documents(n=120, seed=7):
    """Texts with copies, near copies, empty and null ones."""
    rng = random.Random(seed)
    out = [text(rng, rng.choice([0, 1, 3, 8, 40, 150, 400])) for _ in range(n)]
    for _ in range(n // 6):
        source = rng.randrange(n)
        parts = out[source].split(" ")
        if rng.random() < 0.6 and len(parts) > 5:
            parts[rng.randrange(len(parts))] = word(rng)
        out[rng.randrange(n)] = " ".join(parts)
    out[3], out[5] = None, ""
    return out


def frame(spark, texts, first=0):
    rows = [(i + first, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
