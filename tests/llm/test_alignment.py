"""Alignment of two tokenizers against the libraries on whole texts and a plain comparison of all token pairs."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from skyledger.llm import token_alignment
from skyledger.llm.queries import op11_alignment, tokenizer_path

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def paths():
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain(rows, paths):
    """What the contract says, one text and one pair of tokens at a time."""
    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    links, groups, sizes = [], [], []
    for text in rows:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ta, tb = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia], [piece(i) for i in ib]
        if not text or b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            links.append([]), groups.append(""), sizes.append((0, 0, 0))
            continue
        spans = []
        for tokens in (ta, tb):
            at, mine = 0, []
            for t in tokens:
                mine.append((at, at + len(t)))
                at += len(t)
            spans.append(mine)
        links.append([(x, y) for x, (s, e) in zip(ia, spans[0]) for y, (p, q) in zip(ib, spans[1]) if s < q and p < e])
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        text_of, begin = [], 0
        for end in ends:
            text_of.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, mine) if begin <= s and e <= end) for ids, mine in zip((ia, ib), spans)))
            begin = end
        groups.append(hashlib.sha256(";".join(text_of).encode()).hexdigest())
        sizes.append((len(ia), len(ib), len(ends)))
    count = Counter(p for found in links for p in set(found))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(*n, len(found), sum(count[p] == best[p[0]] for p in found), sum(count[p] for p in found), g) for n, found, g in zip(sizes, links, groups)]


ODD = [
    "", None, " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\n\na", "tab\there   x", "x  y", "x　 y", "▁ under", "a▁b", "<|endoftext|> <s> </s> <unk> <0x0A>", "don't we'll I'M", "日本語 текст ñandú ß", "👍🏽 é ​﻿", "\r\nx\r\n", "\x00 \x01 \x1d y",
    "ends in space \t ", "12345 67,890.12", "a" * 3000, "﷐ mark", "x ﷐﷑﷒﷓\x1d\x1e\x1f y", "    indented\n        code()  # x", "same same same", "\x85x \x85 y", "  z  q", "word\n\n\n   word",
]


def test_odd_texts_equal_the_libraries_on_whole_texts(spark, make_docs, paths):
    want = plain(ODD, paths)
    rows = token_alignment.align(make_docs(list(enumerate(ODD))), *paths)[0].collect()
    got = {r.id: tuple(r[c] for c in COLUMNS) for r in rows}
    for i, text in enumerate(ODD):
        assert got[i] == want[i], repr(text)


def test_documents_equal_the_plain_comparison(spark, docs, sf, paths):
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id: r for r in op11_alignment(spark, sf).collect()}
    short = [r for r in rows if len(r.text or "") < 3000]
    pairs = {(r.a, r.b): r.docs for r in token_alignment.align(docs, *paths)[1].collect()}
    for r, want in zip(rows, plain([r.text if len(r.text or "") < 3000 else None for r in rows], paths)):
        if len(r.text or "") < 3000:
            mine = got[r.doc_id]
            assert (mine.n_a, mine.n_b, mine.n_groups, mine.n_links, mine.groups_sha256) == (*want[:4], want[6])
    assert len(short) > 50 and pairs


def test_chunks_merge_their_counts(make_docs, paths):
    texts = [f"alpha beta {'gamma ' * (i % 7)} délta{i % 3}\nline two  {i}" for i in range(60)]
    docs = make_docs(list(enumerate(texts))).repartition(5)
    got = {r.id: tuple(r[c] for c in COLUMNS) for r in token_alignment.align(docs, *paths, chunk_bytes=200)[0].collect()}
    assert [got[i] for i in range(60)] == plain(texts, paths)


def test_other_rules_take_whole_texts(paths):
    pair = token_alignment.Pair(*paths)
    pair.cuts = False
    import pyarrow as pa

    con = token_alignment._connection()
    found, packed = token_alignment.align_chunk(pair, con, pa.array([1, 2]), pa.array(["plain words  here\nand there", "one two"]))
    pair.cuts = True
    again, packed_again = token_alignment.align_chunk(pair, con, pa.array([1, 2]), pa.array(["plain words  here\nand there", "one two"]))
    one, two = token_alignment._unpack(packed), token_alignment._unpack(packed_again)
    assert all(one[c].to_pylist() == two[c].to_pylist() for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"))
    assert sorted(zip(found["a"], found["b"], found["docs"])) == sorted(zip(again["a"], again["b"], again["docs"]))


def test_null_rows_and_no_rows(make_docs, paths):
    docs = make_docs([(None, None), (None, "text here"), (3, "text here"), (3, "text here")])
    rows = token_alignment.align(docs, *paths)[0].collect()
    assert sorted((r.id or -1, r.n_a > 0) for r in rows) == [(-1, False), (-1, True), (3, True), (3, True)]
    assert token_alignment.align(docs.limit(0), *paths)[0].count() == 0
