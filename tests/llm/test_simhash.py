from __future__ import annotations

import random

import numpy as np
import xxhash

from skyledger.llm import simhash
from skyledger.llm.components import connected_components


def plain_fingerprint(text: str | None, k: int = 4) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows, most=4, k=4):
    prints = [plain_fingerprint(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= most:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for (doc, _), g in zip(rows, group):
        least[g] = min(least.get(g, doc), doc)
    return sorted((doc, p, least[g]) for (doc, _), p, g in zip(rows, prints, group))


def texts(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 120, 300]))]
        if i % 3 == 2 and len(rows[-1][1] or "") > 50:
            words = rows[-1][1].split()
            words[rng.randrange(len(words))] = "Changed"
        rows.append((i * 7 % 1000, " ".join(words)))
    return [*rows, (1001, None), (1002, ""), (1003, " \n\t"), (1004, rows[0][1]), (1005, "É ÀB c ΣA")]


def answer(df):
    return sorted((r.id, r.fp % (1 << 64), r.component) for r in df.collect())


def test_same_as_all_pairs(make_docs):
    rows = texts()
    assert answer(simhash.near_duplicates(make_docs(rows))) == plain_components(rows)


def test_crowded_anchor_is_dealt_out(make_docs, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 3)
    rows = texts(40, 5)
    assert answer(simhash.near_duplicates(make_docs(rows))) == plain_components(rows)


def test_large_runs_give_a_forest(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    near = [base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (400, 2))]
    distinct = spark.createDataFrame([(x,) for x in set(near)], "fp long").coalesce(1)
    edges = simhash.links(distinct).collect()
    assert all((e.a ^ e.b).bit_count() <= 4 for e in edges)
    found = connected_components(simhash.links(distinct)).collect()
    assert len({r.component for r in found}) == 1 and len(found) == len(set(near))


def test_anchors_cover():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 31, 300)
    flips = (1 << rng.integers(0, 31, 300)) ^ (1 << rng.integers(0, 31, 300))
    for a, b in zip(x, x ^ flips):
        of = lambda v: set(simhash.anchors(np.array([v], np.uint64))[1].tolist())
        assert of(a) & of(b)
        assert len(of(a)) in (1, 16)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(make_docs):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, text), (3, text), (3, text), (9, text.replace("word7 ", "other ")), (1, "quite another text of its own"), (None, text)]
    kept = [r.doc_id for r in simhash.keep_one(make_docs(rows)).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 3] and kept.count(None) == 1


def test_the_sign_bit_counts_as_one(spark):
    """All pairs at four or fewer bits, the top bit among them, linked as by comparing all pairs."""
    rng = random.Random(8)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        values |= {base, base ^ 1 << 63, *(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(6))}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {r.node: r.component for r in connected_components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    group = {v: v for v in signed}
    near = [(x, y) for i, x in enumerate(signed) for y in signed[:i] if ((x ^ y) % (1 << 64)).bit_count() <= 4]
    changed = True
    while changed:
        changed = False
        for x, y in near:
            low = min(group[x], group[y])
            changed |= group[x] != low or group[y] != low
            group[x] = group[y] = low
    assert {v: found.get(v, v) for v in signed} == group


def test_many_near_fingerprints_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 17)
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    near = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (400, 2))}
    found = connected_components(simhash.links(spark.createDataFrame([(x,) for x in near], "fp long"))).collect()
    assert len({r.component for r in found}) == 1 and len(found) == len(near)
