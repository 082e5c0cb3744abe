import random

from tessera.llm.license_scan import TEMPLATES, Templates, bigrams, dice, normalise, scan

from .corpus import frame, text


def brute(t, templates, least=0.8):
    """Every block against every template."""
    import re

    found = {}
    for block in {t, *re.split(r"\n[\x20\t\r]*\n", t), *t.split("\n")}:
        words = normalise(block)
        scored = [(dice(bigrams(words), bigrams(normalise(x))), n) for n, xs in templates.items() for x in xs] if words else []
        best = max((s for s, _ in scored), default=0)
        if best >= least:
            name = min(n for s, n in scored if s == best)
            found[name] = max(found.get(name, 0), best)
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))


def test_against_all_pairs():
    rng = random.Random(8)
    notices = [x for xs in TEMPLATES.values() for x in xs]
    known = Templates()
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(notices).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["x", "the", "license", "and more"])
            parts.append(" ".join(words))
            parts.append(text(rng, rng.randint(0, 60)))
        t = rng.choice(["\n", "\n\n", " "]).join(parts)
        assert known.scan(t) == brute(t, TEMPLATES), t


def test_rows(spark):
    texts = [None, "", "intro\nLicensed under the Apache License, Version 2.0.\nmore", "All rights reserved.", "no licence here " * 4000]
    got = {r.doc_id: r for r in scan(frame(spark, texts).select("doc_id", "text")).collect()}
    assert [got[i].license for i in range(5)] == [None, None, "Apache-2.0", "LicenseRef-all-rights-reserved", None]
    assert got[2].score == 1.0 and got[2].n_licenses == 1
    assert scan(frame(spark, texts).limit(0).select("doc_id", "text")).count() == 0


def brute_windows(t, templates):
    """Every window of every template's size."""
    words, found = normalise(t), {}
    for name, texts in templates.items():
        for x in texts:
            grams = bigrams(normalise(x))
            size = sum(grams.values())
            for i in range(max(0, len(words) - 1)):
                if words[i + 1 : i + 2] and (words[i], words[i + 1]) in grams:
                    found[name] = max(found.get(name, 0), dice(bigrams(words[i : i + size + 1]), grams))
    return {n: s for n, s in found.items() if s >= 0.8 - 1e-12}


def test_windows_against_all_windows():
    rng = random.Random(9)
    notices = {n: xs for n, xs in TEMPLATES.items() if n in ("MIT", "ISC", "CC0-1.0", "GPL-2.0")}
    known, blocks = Templates(notices, windows=True), Templates(notices)
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 2)):
            words = rng.choice([x for xs in notices.values() for x in xs]).split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(["x", "the", "license", "and more"])
            parts += [" ".join(words), text(rng, rng.randint(0, 30))]
        t = " ".join(parts)
        want = brute_windows(t, notices)
        for name, score in blocks.scan(t):
            want[name] = max(want.get(name, 0), score)
        assert known.scan(t) == sorted(want.items(), key=lambda x: (-x[1], x[0]))


def test_notices_inside_other_text():
    known = Templates(windows=True)
    line = "Note: this file is Licensed under the Apache License, Version 2.0. And further text goes on here."
    assert known.scan(line)[0] == ("Apache-2.0", 1.0)
    body = TEMPLATES["MIT"][-1].split()
    comment = "/*\n * Copyright (c) 2024 Some Author\n *\n" + "\n".join(" * " + " ".join(body[i : i + 9]) for i in range(0, len(body), 9)) + "\n */\nint main() { return 0; }\n"
    assert known.scan(comment)[0] == ("MIT", 1.0)
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        assert known.scan("Copyright 2020 X\n" + TEMPLATES[name][0])[0] == (name, 1.0)
    assert normalise("Copyright (c) 2020 A B. All rights reserved.") == ["all", "rights", "reserved"]
