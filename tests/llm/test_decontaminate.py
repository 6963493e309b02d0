from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from skyledger.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, window=10):
    windows = {}
    for name, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(name))
    out = []
    for doc, text in rows:
        words, hit, names = words_of(text), set(), set()
        for window_words, found in windows.items():
            n = len(window_words)
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == window_words:
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((doc, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "a", "of", "Cat", "ÉTÉ", "x1", "zz"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 7, 9, 10, 11, 14, 25]) + 2)) for i in range(12)] + [(12, None), (13, "--"), (14, items_text := say(30)), (15, items_text)]
    rows = [(i, say(rng.randrange(0, 60))) for i in range(30)]
    rows += [(100 + i, f"before {t or ''}. After, {say(4)}") for i, (_, t) in enumerate(items)] + [(200, None), (201, ""), (202, "unknown words only"), (None, items_text), (100, items_text)]
    return rows, items


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [400_000, 5])
def test_same_as_plain_windows(make_docs, spark, monkeypatch, seed, block):
    monkeypatch.setattr(d, "BLOCK_WORDS", block)
    rows, items = corpus(seed)
    found = d.report(make_docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, items)


@pytest.mark.parametrize("block", [400_000, 1])
def test_spans_are_cut(make_docs, spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_WORDS", block)
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    passage = "One, two THREE four five six seven eight nine ten"
    clean = " ".join(f"clean{i}" for i in range(20))
    rows = make_docs([(1, f"{clean} {passage}! {clean}"), (2, passage), (3, clean), (4, None), (5, f"é {passage} {clean}")])
    out = {r.doc_id: r for r in d.decontaminate(rows, items).collect()}
    assert set(out) == {1, 3, 4, 5} and out[1].text == f"{clean} ! {clean}" and out[3].text == clean and out[4].text is None and out[5].text == f"é  {clean}"
    assert d.decontaminate(rows, items).columns == rows.columns


def test_empty_tables(make_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.report(make_docs([]), none).count() == 0
    assert not any(r.contaminated for r in d.report(make_docs([(1, "a b c")]), none).collect())


@pytest.mark.parametrize("block", [400_000, 1])
def test_clashing_columns(make_docs, spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_WORDS", block)
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "short item")], "item_id long, text string")
    names = ("__n_words", "__spans", "__items", "__row", "__ROW_", "row", "n", "spans", "items")
    rows = make_docs([(1, "a short item in ten words and more of them"), (2, "clean"), (3, None)]).withColumns({n: F.lit("own") for n in names})
    out = d.decontaminate(rows, items)
    assert out.columns == rows.columns and {(r.doc_id, r.text) for r in out.collect()} == {(1, "a  in ten words and more of them"), (2, "clean"), (3, None)} and all(r[n] == "own" for r in out.collect() for n in names)
    assert d.report(rows, items).filter("contaminated").count() == 1
    with pytest.raises(ValueError):
        d.matches(rows, items)
