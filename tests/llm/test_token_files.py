from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyledger.llm import token_files
from skyledger.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ROWS = [(4, "Hello, World! It's 2024."), (1, None), (2, ""), (9, "x" * 500 + " <|endoftext|> <|ENDOFTEXT|> É È ΑΣ ΑΣ. é a.b,c., ..."), (3, "Tab\tand\nline\x0b\x0c\r ends"), (4, "again four"), (None, "no id"), (7, "word " * 3000)]


def expected(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def test_same_as_the_library(make_docs, spark):
    folder, dictionary = token_files.write_token_files(make_docs(ROWS), PATH)
    rows = token_files.read_token_files(spark, folder, dictionary).orderBy("start").collect()
    want = sorted(((i, expected(t)) for i, t in ROWS), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.id for r in rows] == [i for i, _ in want]
    assert [r.n_tokens for r in rows] == [len(x) for _, x in want]
    assert [r.start for r in rows] == np.cumsum([0, *(len(x) for _, x in want)])[:-1].tolist()
    assert {(r.id, r.ids_crc32) for r in rows} == {(i, zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want}


def test_whole_corpus(docs, spark):
    folder, dictionary = token_files.write_token_files(docs, PATH)
    found = {r.id: (r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, folder, dictionary).collect()}
    rows = docs.collect()
    want = {r.doc_id: expected(r.text) for r in rows}
    assert found == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_single_documents_and_damage(make_docs, spark):
    folder, dictionary = token_files.write_token_files(make_docs(ROWS), PATH)
    data = [bytes(r.content) for r in spark.read.format("binaryFile").load(folder).collect() if r.length]
    files = [token_files.TokenFile(x, dictionary) for x in data]
    assert files[0].document(7).tolist() == expected("word " * 3000)
    with pytest.raises(KeyError):
        files[0].document(12345)
    with pytest.raises(ValueError):
        token_files.TokenFile(data[0], dictionary + b"x")
    with pytest.raises(ValueError):
        token_files.TokenFile(b"nothing" * 9, dictionary)


def test_several_files(make_docs, spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 300)
    rows = [(i, f"document {i} " * 20) for i in range(50)]
    folder, dictionary = token_files.write_token_files(make_docs(rows), PATH)
    found = token_files.read_token_files(spark, folder, dictionary).orderBy("id").collect()
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist() and len(found) == 50


def test_empty_table(make_docs, spark):
    folder, dictionary = token_files.write_token_files(make_docs([]), PATH)
    assert token_files.read_token_files(spark, folder, dictionary).count() == 0


PATTERNS = ["a{}. b", "{}, b", "{}", "A{}'s T", "{}\u0308.", "a.{} ,b", "<|{}|> <|endoftext|>. q", "{}<|ENDOFTEXT|>{}. ", "1{}2\t{}\n.", "T{}. \n", "{}'ll, \u0307x"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_every_code_point(pattern):
    """All below U+3000 in every pattern, and all below U+30000 in one."""
    library, own = Tokenizer.from_file(PATH), token_files.encoder(PATH)
    points = [c for c in range(0x30000 if pattern == PATTERNS[0] else 0x3000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20000):
        texts = [pattern.replace("{}", chr(c)) for c in points[at : at + 20000]]
        want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert [x.tolist() for x in own.encode(pa.array(texts))] == want


def test_neighbours_do_not_matter():
    own, texts = token_files.TextEncoder(PATH), ["D\u0130. b", "a <|endoftext|>. b", "T\u0308. x", None, ""]
    together = [x.tolist() for x in own.encode(pa.array(texts))]
    assert together == [own.encode(pa.array([t], pa.string()))[0].tolist() for t in texts] == [expected(t)[:-1] for t in texts]


def test_a_tokenizer_with_other_rules(make_docs, spark):
    path = tokenizer_path("byte_bpe_50k.json")
    assert not token_files.TextEncoder(path).by_word and token_files.TextEncoder(PATH).by_word
    rows = [(i, t) for i, t in ROWS if i is not None]
    folder, dictionary = token_files.write_token_files(make_docs(rows), path, end_id=50256)
    found = {(r.id, r.ids_crc32) for r in token_files.read_token_files(spark, folder, dictionary).collect()}
    library = Tokenizer.from_file(path)
    assert found == {(i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 50256], "<u4").tobytes())) for i, t in rows}


def test_wide_ids():
    data = token_files._pack([(7, 2, token_files_frame([70_000, 2]))], hashlib.sha256(b"").digest(), 4)
    assert token_files.TokenFile(data, b"").document(7).tolist() == [70_000, 2]


def token_files_frame(ids):
    return zstandard.ZstdCompressor().compress(np.array(ids, "<u4").tobytes())


def test_part_numbers_beyond_five_digits(spark):
    names = ["file:/x/part-99999-a.txt", "file:/part-7/part-100000-a.txt", "s3a://b/part-00003-c000.txt"]
    rows = spark.createDataFrame([(n,) for n in names], "path string").select(token_files.part_number(F.col("path")).alias("n")).collect()
    assert [r.n for r in rows] == [99_999, 100_000, 3]


def test_starts_over_several_blocks_of_files(make_docs, spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 200)
    monkeypatch.setattr(token_files, "FILES_AT_ONCE", 3)
    folder, dictionary = token_files.write_token_files(make_docs([(i, f"number {i} " * 20) for i in range(60)]), PATH)
    found = token_files.read_token_files(spark, folder, dictionary).orderBy("id").collect()
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist() and len(found) == 60
