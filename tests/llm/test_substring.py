from __future__ import annotations

import hashlib
import random

import pytest

from skyledger.llm import substring_dedup as sd


def plain(rows, window):
    split = [[w for w in _split(t or "")] for _, t in rows]
    first = {}
    for (doc, _), words in zip(rows, split):
        if doc is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), words in zip(rows, split):
        gone = set()
        for i in range(len(words) - window + 1):
            if doc is not None and first[tuple(words[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def _split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def corpus(seed, window, vocabulary=400):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    passages = [say(rng.choice([window - 1, window, window + 1, 2 * window, 5 * window])) for _ in range(6)]
    rows = []
    for i in range(60):
        words = say(rng.randrange(0, 3 * window))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(words) + 1)
            p = rng.choice(passages)
            cut = rng.randrange(0, 10)
            words[at:at] = p[cut:] if rng.random() < 0.5 else p
        rows.append((rng.randrange(1000), " ".join(words)))
    rows += [(2000, rows[5][1]), (2001, rows[5][1]), (2001, rows[6][1]), (1, None), (2, ""), (3, "a b c\n d"), (None, rows[7][1]), (2002, "same " * 7 * window), (2003, "same " * 3 * window), (2004, "ab cd " * window)]
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("window", [50, 12])
def test_same_as_plain_windows(make_docs, seed, window):
    rows = corpus(seed, window, 3 if seed == 3 else 400)
    found = sd.remove_repeats(make_docs(rows), window=window)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, window)


def test_empty_and_clashing(make_docs):
    from pyspark.sql import functions as F

    assert sd.remove_repeats(make_docs([])).count() == 0
    rows = make_docs([(1, "x " * 60), (2, "x " * 60)]).withColumns({c: F.lit(0) for c in ("id", "row", "run", "least", "words", "starts")})
    assert {r.id: r.n_removed for r in sd.remove_repeats(rows).collect()} == {1: 0, 2: 60}
