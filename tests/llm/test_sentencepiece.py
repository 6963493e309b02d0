from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from skyledger.llm import sentencepiece_viterbi as v
from skyledger.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["", " ", "Hello world", "  two  spaces ", "line\nbreak\r\n\ttab", "Grüße, 世界! 🙂🙂", "a" * 700, "x▁y", "\u0000\u0001", "supercalifragilistic" * 40, "\n\n\n", "é" * 100 + " end"]


def full_search(model, text):
    """Least cost over all paths, and whether a path of ids is one of that cost."""
    pieces = {}

    def walk(node, prefix):
        if node[1] >= 0:
            pieces[prefix] = node[1:]
        for c, child in node[0].items():
            walk(child, prefix + c)

    walk(model.root, "")
    s = " " + text.replace("▁", " ")
    cost = [0.0] + [float("inf")] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - model.longest), end):
            if (p := pieces.get(s[start:end])) and cost[start] + p[1] < cost[end]:
                cost[end] = cost[start] + p[1]
        if s[end - 1] not in pieces:
            cost[end] = min(cost[end], cost[end - 1] + model.byte_cost * len(s[end - 1].encode()))
    by_id = {i: c for i, c in pieces.values()}
    return cost[-1], lambda ids: sum(by_id.get(i, model.byte_cost) for i in ids)


@pytest.mark.parametrize("text", TEXTS[1:])
def test_least_cost(text):
    model = v.load(PATH)
    best, cost = full_search(model, text)
    assert cost(v.encode_text(model, text).tolist()) == pytest.approx(best)


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    model = v.load(PATH)
    assert v.decode_ids(model, v.encode_text(model, text)).decode() == text.replace("▁", " ")


def test_portions_and_memory_do_not_matter():
    model, rng = v.load(PATH), random.Random(2)
    text = " " + "".join(rng.choice("abcdefgh ñ\n世ing the") for _ in range(3000))
    whole = v.Stream(model)
    whole.feed(text)
    parts = v.Stream(model)
    at = 0
    while at < len(text):
        n = rng.randrange(1, 40)
        parts.feed(text[at : at + n])
        at += n
        assert len(parts.back) <= 4 * model.longest
    assert whole.close() == parts.close() == v.encode_text(model, text[1:]).tolist()


def test_frames(make_docs):
    rows = make_docs([(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (0, "")])
    model = v.load(PATH)
    found = {r.id: r for r in v.round_trip(rows, PATH).collect()}
    for i, t in enumerate(TEXTS):
        ids = v.encode_text(model, t)
        assert (found[i].n_ids, found[i].ids_crc32, found[i].exact) == (len(ids), zlib.crc32(ids.tobytes()), "▁" not in t)
    coded = v.encode(rows, PATH)
    texts = {r.id: r.text for r in v.decode(coded, PATH).collect()}
    assert texts[5] == TEXTS[5] and texts[99] == "" and v.round_trip(rows.limit(0), PATH).count() == 0
    assert v.decode_ids(model, np.array([model.byte_id[0xFF]])) == b"\xff"


SPACED = ["a   b", "    if x:\n        return  y", "  two", " ", "   ", "x \n  y", "a\n\n   \n b   ", "a|      b |   c", "▁▁▁x ▁ y▁", " " * 40 + "end", "\x01\n  \x01", "tab \t   tab"]


def model_search(text):
    """Least cost over all paths of the pieces in the model file itself, and the cost of ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    pieces = {sp.id_to_piece(i).replace("▁", " "): -sp.get_score(i) for i in plain}
    costs, longest, byte_cost = {i: -sp.get_score(i) for i in plain}, max(map(len, pieces)), v.load(PATH).byte_cost
    s = " " + text.replace("▁", " ")
    cost = [0.0] + [float("inf")] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - longest), end):
            cost[end] = min(cost[end], cost[start] + pieces.get(s[start:end], float("inf")))
        if s[end - 1] not in pieces:
            cost[end] = min(cost[end], cost[end - 1] + byte_cost * len(s[end - 1].encode()))
    return cost[-1], lambda ids: sum(costs.get(i, byte_cost) for i in ids)


@pytest.mark.parametrize("text", [*TEXTS[1:], *SPACED])
def test_least_cost_of_the_model_file(text):
    model = v.load(PATH)
    best, cost = model_search(text)
    ids = v.encode_text(model, text)
    whole = v.Stream(model)
    whole.feed(" " + text.replace("▁", " "))
    assert cost(ids.tolist()) == pytest.approx(best, rel=1e-12) and whole.close() == ids.tolist()
    assert v.decode_ids(model, ids).decode() == text.replace("▁", " ")


def test_long_runs_of_spaces_take_pieces_of_16():
    model = v.load(PATH)
    ids = v.encode_text(model, "x" + " " * 50_000 + "y")
    assert len(ids) < 50_000 / 16 + 5 and v.decode_ids(model, ids) == b"x" + b" " * 50_000 + b"y"


@pytest.mark.parametrize("runs", range(2, 41))
def test_runs_of_spaces_are_least_cost_paths(runs):
    model, text = v.load(PATH), "x" + " " * runs + "the" + " " * (runs - 1) + "\n" + " " * runs
    best, cost = model_search(text)
    ids = v.encode_text(model, text)
    assert cost(ids.tolist()) == pytest.approx(best, rel=1e-12) and v.decode_ids(model, ids).decode() == text


class Crossing(v.Model):
    """Made-up pieces, some across the start of a word or a line."""

    def __init__(self, seed):
        rng = random.Random(seed)
        self.byte_id = {b: 1000 + b for b in range(256)}
        pieces = {"".join(rng.choices("ab \n", k=rng.randrange(1, 6))) for _ in range(40)} | {"a", " ", "b", "b a", "\n\n"}
        self.set_pieces([(p, i, rng.uniform(1, 5)) for i, p in enumerate(sorted(pieces))])


@pytest.mark.parametrize("seed", range(5))
def test_pieces_across_words_and_lines(seed):
    model, rng = Crossing(seed), random.Random(seed)
    for n in (1, 7, 300):
        text = "".join(rng.choices("ab \nc", k=n))
        best, cost = full_search(model, text)
        assert cost(v.encode_text(model, text).tolist()) == pytest.approx(best)


def test_whole_documents_in_one_stream_give_the_same(docs):
    """Window and convergence over whole texts, without splitting or memory, and a window that stays bounded."""
    model = v.load(PATH)
    for r in docs.limit(40).collect():
        if r.text:
            stream, widest = v.Stream(model), 0
            for at in range(0, len(r.text), 50):
                stream.feed((" " if at == 0 else "") + r.text[at : at + 50])
                widest = max(widest, len(stream.back))
            assert widest <= 4 * model.longest and stream.close() == v.encode_text(model, r.text).tolist()


def test_commits_of_whole_texts(docs):
    """Each stretch that is remembered ends where the stream itself converged; without memory every boundary is found again."""
    model = v.Model(PATH)
    texts = [r.text for r in docs.limit(60).collect() if r.text]
    first = [v._packed(model, " " + t.replace("▁", " ")) for t in texts]
    learned = model.commits
    again = [v._packed(model, " " + t.replace("▁", " ")) for t in texts]
    assert again == first and model.commits - learned < learned / 10  # stepped over, but for long stretches
    plain = v.Model(PATH)
    plain.remember = lambda *_: None
    assert [v._packed(plain, " " + t.replace("▁", " ")) for t in texts] == first
    assert plain.commits == sum(len(v._PART.findall(" " + t.replace("▁", " "))) for t in texts)  # under this model one for each run of spaces and line break


def test_a_long_run_of_spaces_keeps_a_bounded_window():
    import tracemalloc

    model = v.load(PATH)
    stream = v.Stream(model)
    tracemalloc.start()
    for _ in range(40):
        stream.feed(" " * 10_000)
        assert len(stream.back) <= 4 * model.longest
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 2_000_000
    ids = stream.close()
    assert len(ids) == 400_000 // 16 and v.decode_ids(model, np.array(ids)) == b" " * 399_999


@pytest.mark.parametrize("seed", range(5))
def test_streams_under_odd_models_in_any_portions(seed):
    model, rng = Crossing(seed), random.Random(seed)
    text = " " + "".join(rng.choices("ab \nc", k=400)) + " " * 90 + "aaaa" * 40
    whole = v.Stream(model)
    whole.feed(text)
    parts, at = v.Stream(model), 0
    while at < len(text):
        n = rng.randrange(1, 9)
        parts.feed(text[at : at + n])
        at += n
    best, cost = full_search(model, text[1:])
    found = [whole.close(), parts.close(), np.frombuffer(v._packed(model, text), "<u4").tolist()]
    assert all(cost(ids) == pytest.approx(best) for ids in found)  # paths of equal cost may differ


def test_each_start_walks_down_the_trie_once(docs):
    """Calls of the search for a character: two or three steps down the trie and little else."""
    import sys

    model, calls = v.load(PATH), 0
    texts = [" " + r.text for r in docs.limit(20).collect() if r.text]

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "c_call"

    stretches = [x + " " for t in texts for x in v._PART.findall(t) if len(x) < 30]
    stream = v.Stream(model)
    sys.setprofile(count)
    try:
        for x in stretches:
            stream.restart()
            stream.feed(x)
    finally:
        sys.setprofile(None)
    assert calls < 5 * sum(map(len, stretches))


def test_a_worker_remembers_as_many_stretches_as_its_bytes_hold(monkeypatch):
    model = v.Model(PATH)
    text = " ".join(map(str, range(340_000)))
    first, learned = v._packed(model, " " + text), model.commits
    assert v._packed(model, " " + text) == first and model.commits - learned < learned / 100
    monkeypatch.setattr(v, "REMEMBERED", 100_000)
    model = v.Model(PATH)
    for n in (3, 60):  # the longer, the fewer
        v._packed(model, "".join(f" {i:0{n}}世" for i in range(3000)))
        kept = [d for side in (model.young, model.old) for d in side.values()]
        assert 0 < sum(x.__sizeof__() + y.__sizeof__() for d in kept for x, y in d.items()) < 200_000
