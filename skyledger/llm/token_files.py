"""Token-id files: each document compressed by itself with one shared zstandard dictionary.

A file is: magic, sha256 of the dictionary, one zstandard frame for each document, the index (for each
document its id, whether that is null, frame offset, frame length and number of ids, little-endian),
then the index's offset, the number of documents, the bytes of an id (2 where the vocabulary allows, else 4)
and the magic again. Files are written and read by Spark, so they may lie in any store; the writer ends
each with a line break. The part numbers in the names follow the order of document ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.common import Recent, bounded_sample, discard, ids_by_word, map_arrow, new_path, picked, portions, written

#: Documents that the dictionary is trained on, the most ids that one of them may have, and the dictionary's bytes.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 512, 4096, 32_768
#: Bytes of frames in one file, about.
FILE_BYTES = 12_000_000
#: Files whose ids are added up in one task.
FILES_AT_ONCE = 4096
#: New words for which a worker remembers words, and the longest that it remembers, in characters.
REMEMBERED, SHORT = 150_000, 64
MAGIC = b"SKYTOK01"
_INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("ids", "<u4")])


#: The rules under which a word has the same ids alone as in its text.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_SPECIAL = {"<|startoftext|>", "<|endoftext|>"}

#: Words that are cut here as the tokenizer cuts them: printable Latin text without apostrophes, which
#: start its contractions. Below U+0180 lower case is one character (but of U+0130) and normal form changes nothing.
_LATIN = re.compile("[!-&(-~\u00a1-\u012f\u0131-\u017f]+")
_PIECE = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: A full stop or comma between such a letter and ASCII white space. Neither side can compose with it, so it is
#: a piece of its own in the tokenizer too.
_STOP = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f])([.,])([ \n])"


def _byte_letters() -> dict[int, str]:
    """Character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others by U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class TextEncoder:
    """A tokenizer's ids of whole texts.

    Under the rules checked here no piece crosses ASCII white space and normal form changes nothing across
    it, so each distinct word of a batch is encoded once and short ones are remembered. Latin words are cut
    into pieces and each new piece goes to the tokenizer's model; any other word goes through the whole
    tokenizer. Under any other rules whole texts go through the tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = _rules_known(json.loads(self.tokenizer.to_str()))
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known, self.pieces = Recent(REMEMBERED, SHORT), {}

    @property
    def dtype(self) -> str:
        return "<u2" if self.kind == "H" else "<u4"

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids = array(self.kind, [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(self.pieces) >= REMEMBERED:
                self.pieces = {}
            if len(piece) <= SHORT:
                self.pieces[piece] = ids
        return ids

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> list[bytes]:
        found, other, latin, cut, piece = {}, [], _LATIN.fullmatch, _PIECE.findall, self._piece
        for w in words:
            if latin(w) and "<|" not in w:
                found[w] = b"".join(map(piece, cut(w.lower())))
            else:
                other.append(w)
        if other:
            found |= zip(other, self._plain(other))
        return [found[w] for w in words]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return [np.frombuffer(x, self.dtype) for x in self._plain(texts.to_pylist())]
        apart = pc.replace_substring_regex(texts, _STOP, r"\1 \2\3")
        return ids_by_word(pc.ascii_split_whitespace(apart), self.dtype, lambda words: self.known.of(words, self._learn))


def _rules_known(file: dict) -> bool:
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    special = {t["content"] for t in file.get("added_tokens", []) if not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])}
    plain = special == {t["content"] for t in file.get("added_tokens", [])} <= _SPECIAL
    whole = not (file.get("truncation") or file.get("padding") or file.get("post_processor") or file["model"].get("dropout"))
    return file.get("normalizer") == _NORMALIZER and steps == [_SPLIT, _BYTES] and plain and whole


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def train_dictionary(docs: DataFrame, path: str, end_id: int = 2) -> bytes:
    """A zstandard dictionary from the ids of at most ``SAMPLE_DOCS`` documents, least hash first, of at
    most ``SAMPLE_IDS`` ids each. Samples too few to train on are joined as plain content; none: empty."""
    import zstandard

    some = bounded_sample(docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= 4 * SAMPLE_IDS), docs, SAMPLE_DOCS)
    own = encoder(path)
    sample = [ids for ids in own.encode(pa.array([r.text for r in some.collect()], pa.string())) if len(ids) < SAMPLE_IDS]
    sample = [np.append(ids, end_id).astype(own.dtype).tobytes() for ids in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


def _pack(frames: list[tuple[int | None, int, bytes]], dictionary_hash: bytes, width: int) -> bytes:
    index = np.zeros(len(frames), _INDEX)
    offset = len(MAGIC) + 32
    for i, (doc, ids, frame) in enumerate(frames):
        index[i] = (doc or 0, doc is None, offset, len(frame), ids)
        offset += len(frame)
    return b"".join([MAGIC, dictionary_hash, *(f for _, _, f in frames), index.tobytes(), struct.pack("<QIB", offset, len(frames), width), MAGIC])


class TokenFile:
    """Reads one file's bytes: any document by its place or its id, without the others."""

    def __init__(self, data: bytes, dictionary: bytes) -> None:
        import zstandard

        data = data.removesuffix(b"\n")
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a token file")
        if data[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("written with another dictionary")
        at, n, width = struct.unpack("<QIB", data[-21:-8])
        self.dtype = f"<u{width}"
        self.data, self.index = data, np.frombuffer(data, _INDEX, n, at)
        self.zstd = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))

    def ids(self, i: int) -> np.ndarray:
        entry = self.index[i]
        frame = self.data[int(entry["offset"]) : int(entry["offset"]) + int(entry["size"])]
        out = np.frombuffer(self.zstd.decompress(frame), self.dtype).astype("<u4")
        if len(out) != entry["ids"]:
            raise ValueError("a frame has another number of ids than the index")
        return out

    def document(self, doc_id: int) -> np.ndarray:
        """Ids of the first document with this id, by binary search in the index."""
        first = int(self.index["null"].sum())  # null ids come first
        i = first + int(np.searchsorted(self.index["id"][first:], doc_id))
        if i >= len(self.index) or self.index["id"][i] != doc_id:
            raise KeyError(doc_id)
        return self.ids(i)


def write_token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None) -> tuple[str, bytes]:
    """Writes every row of ``docs`` in ascending id order (null first; rows of equal id in the order of
    the scan) and returns (folder, dictionary). Null text counts as empty: the end id alone.

    Texts are encoded once and only frames are shuffled. The number of files follows from the bytes of
    all frames; rows of one id may spread over several files. An empty table gives no files; a text of any
    length is one frame, repeated rows are each written, and other columns may have any names.
    """
    import zstandard

    spark, rows_in = docs.sparkSession, picked(docs, id_col, text_col)
    dictionary = train_dictionary(rows_in, tokenizer, end_id)
    folder = path or new_path(spark, "tokens")

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        zstd = zstandard.ZstdCompressor(level=1, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
        own = encoder(tokenizer)
        end = np.array([end_id], own.dtype).tobytes()
        for b in batches:
            for part in portions(b, 3000, 6_000_000):
                ids = [x.tobytes() + end for x in own.encode(part.column("text"))]
                yield {"id": part.column("id"), "ids": [len(x) // len(end) for x in ids], "frame": [zstd.compress(x) for x in ids]}

    frames = map_arrow(rows_in, {"id": "long", "ids": "int", "frame": "binary"}, framed)
    frames = written(frames.withColumn("row", F.monotonically_increasing_id()), "frames")
    total = frames.agg(F.sum(F.length("frame") + _INDEX.itemsize)).first()[0] or 0
    order = ["id", "row"]
    dealt = frames.repartitionByRange(1 + int(total) // FILE_BYTES, *order).sortWithinPartitions(*order)
    digest, width = hashlib.sha256(dictionary).digest(), np.dtype(encoder(tokenizer).dtype).itemsize

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = [x for b in batches for x in zip(b.column("id").to_pylist(), b.column("ids").to_pylist(), b.column("frame").to_pylist())]
        if own:
            yield {"file": [_pack(own, digest, width)]}

    map_arrow(dealt, {"file": "binary"}, filed).select(F.col("file").cast("string")).write.option("lineSep", "\n").text(folder)
    discard(frames)
    return folder, dictionary


def part_number(path: Column) -> Column:
    """The number in a file's name: Spark pads it to five digits, so beyond 99,999 files names no longer sort by it."""
    return F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).cast("long")


def read_token_files(spark: SparkSession, folder: str, dictionary: bytes) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files of ``folder``: start counts the ids
    of all documents before it, ids_crc32 is over little-endian 32-bit ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content")):
                if not (raw := data.as_py()):
                    continue
                file = TokenFile(raw, dictionary)
                n = file.index["ids"].astype(np.int64)
                yield {
                    "path": [name] * len(n), "id": [None if null else int(i) for i, null in zip(file.index["id"], file.index["null"])], "within": np.concatenate(([0], n[:-1].cumsum())) if len(n) else [],
                    "n_tokens": n, "ids_crc32": [zlib.crc32(file.ids(i).tobytes()) for i in range(len(n))],
                }

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    found = written(map_arrow(files, {"path": "string", "id": "long", "within": "long", "n_tokens": "long", "ids_crc32": "long"}, rows), "read")
    each = found.groupBy("path").agg(F.sum("n_tokens").alias("n")).withColumn("part", part_number(F.col("path")))  # one row for each file
    each = written(each.withColumn("block", F.floor(F.col("part") / FILES_AT_ONCE)), "each")
    blocks = each.groupBy("block").agg(F.sum("n").alias("n"))  # one row for FILES_AT_ONCE files
    blocks = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("base"))
    within = each.select("path", "block", (F.sum("n").over(Window.partitionBy("block").orderBy("part")) - F.col("n")).alias("own"))
    before = within.join(blocks, "block").select("path", (F.col("base") + F.col("own")).alias("before"))
    return found.join(before, "path").select("id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
