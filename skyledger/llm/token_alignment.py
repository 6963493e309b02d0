"""Alignment of the tokens of two tokenizers over the same bytes, and how many documents hold each pair of linked ids.

A byte-level BPE (A) and a SentencePiece model (B) both tile the bytes of a space and the text. A task takes its
partition in chunks of about ``CHUNK`` bytes. In a chunk the texts are cut before spaces and line breaks that follow
something else: under the rules that are checked no token of either side crosses such a place, and a stretch has the same
tokens wherever it stands. The distinct stretches of the chunk are laid end to end; DuckDB holds the two tables of
token intervals over them:

* links: an ASOF join gives each A token the B token that holds its first byte, another each B token
  the A token that holds its first byte, if that lies inside (a range condition). Two tilings have no other overlaps.
* groups: a token's group is the window sum of the ends before it that both sides share.
* documents: the distinct (document, pair) rows, counted by pair.

Each chunk gives its partial pair counts as rows, and one packed row with its documents. Spark sums the counts by pair,
finds each A id's highest, and brings to every chunk the counts of its own pairs: what meets there is bounded by the chunk,
and nothing is broadcast. A tokenizer with other rules gets whole texts as stretches.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import map_arrow, picked, portions, written

#: Bytes of text in a chunk, about; a longer text is a chunk by itself.
CHUNK = 8_000_000
#: Bytes that go to a tokenizer as one text.
JOINED = 65_536
#: White space of either tokenizer: no cut is made behind one of these.
_SPACE = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: One of these marks the cuts of a chunk, the first that no text of it has.
_MARKS = ("﷐", "﷑", "﷒", "﷓", "\x1d", "\x1e", "\x1f")


class Pair:
    """The two tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [x for x in range(256) if x not in shown]
        byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
        a_bytes = [bytes(byte_of.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.tables = [_table(a_bytes), _table(b_bytes)]
        #: Decimal ids with what may follow: an id of the same side and group, the other side, the next group.
        self.texts = [pa.array([f"{i}{end}" for i in range(len(x)) for end in ends]) for x, ends in ((a_bytes, ",|"), (b_bytes, ",;"))]
        rules = json.loads(self.a.to_str())
        before = rules.get("pre_tokenizer") or {}
        plain = [p.replace("▁", " ") for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.cuts = rules.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not any(" " in p.lstrip(" ") or "\n" in p for p in plain)
        self.lead = len(self.b.encode("\n"))

    def ids(self, side: int, texts: list[str]) -> list[np.ndarray]:
        if side and self.cuts:  # behind a line break, which joins no other character, the space that the library puts in front is out of the way
            return [np.array(x[self.lead :], np.int32) for x in self.b.encode(["\n" + t for t in texts], num_threads=1)]
        if side:
            return [np.array(x, np.int32) for x in self.b.encode([t[1:] for t in texts], num_threads=1)]
        return [np.array(x.ids, np.int32) for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def tokens(self, side: int, stretches: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after the other, how many each stretch has, whether their bytes are the stretch's).

        Neighbours go to the tokenizer together, up to one that ends in white space; where the bytes of such a text
        are not its tokens' each of its stretches is tried alone.
        """
        data = np.frombuffer(stretches.buffers()[2] or b"", np.uint8)
        edge = np.frombuffer(stretches.buffers()[1], np.int32)[stretches.offset : stretches.offset + len(stretches) + 1].astype(np.int64)
        ends_blank = pc.match_substring_regex(stretches, f"[{_SPACE}]\\z").to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(stretches), bool)
        part = np.concatenate(([0], np.cumsum(ends_blank)[:-1]))
        part = part * (1 << 32) + (edge[:-1] - edge[0]) // JOINED
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        last = np.append(first[1:], len(stretches))
        n, ok, out = np.zeros(len(stretches), np.int64), np.ones(len(stretches), bool), []
        joined = [bytes(data[edge[i] : edge[j]]).decode() for i, j in zip(first, last)]
        for i, j, ids in zip(first.tolist(), last.tolist(), self.ids(side, joined)):
            upto = np.concatenate(([0], self.tables[side][0][ids].cumsum()))
            at = np.searchsorted(upto, edge[i : j + 1] - edge[i])
            if upto[-1] == edge[j] - edge[i] and (upto[at] == edge[i : j + 1] - edge[i]).all() and _same(self.tables[side], ids, data[edge[i] : edge[j]]):
                n[i:j] = np.diff(at)
                out.append(ids)
                continue
            alone = [ids] if j - i == 1 else self.ids(side, [bytes(data[edge[k] : edge[k + 1]]).decode() for k in range(i, j)])
            for k, ids in zip(range(i, j), alone):
                ok[k] = _same(self.tables[side], ids, data[edge[k] : edge[k + 1]])
                n[k] = len(ids)
            out += alone
        return np.concatenate(out) if out else np.zeros(0, np.int32), n, ok


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in tokens], np.int64)
    return size, size.cumsum() - size, np.frombuffer(b"".join(tokens), np.uint8)


def _same(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, data: np.ndarray) -> bool:
    """Whether the bytes of ``ids`` are ``data``; a token without bytes never is right, since it has no interval."""
    size, first, flat = table
    n = size[ids]
    if n.sum() != len(data) or not n.all():
        return False
    for at in range(0, len(ids), 100_000):
        some, k = ids[at : at + 100_000], n[at : at + 100_000]
        upto = k.cumsum()
        begin = int(n[:at].sum()) if at else 0
        if not np.array_equal(flat[np.repeat(first[some] - upto + k, k) + np.arange(upto[-1])], data[begin : begin + upto[-1]]):
            return False
    return True


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def stretches(pair: Pair, texts: pa.StringArray) -> pa.ListArray:
    """Each text, a space in front, cut into stretches."""
    spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
    free = [m for m in _MARKS if not pc.any(pc.match_substring(texts, m)).as_py()]
    if not pair.cuts or not free:
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32), spaced)
    return pc.split_pattern(pc.replace_substring_regex(spaced, f"([^{_SPACE}])([ \\n])", rf"\1{free[0]}\2"), free[0])


_LINKS = """
CREATE OR REPLACE TEMP TABLE link AS
SELECT w, a << 20 | b AS pair FROM (
  SELECT a.w, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.s >= b.s
  UNION ALL
  SELECT a.w, a.id AS a, b.id AS b FROM b ASOF JOIN a ON b.s > a.s WHERE b.s < a.e)
"""
_GROUPS = """
SELECT sum(shared) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) - shared AS g, shared
FROM (SELECT a.e, CAST(b.e IS NOT NULL AS BIGINT) AS shared FROM a LEFT JOIN b ON a.e = b.e) ORDER BY e
"""
_NUMBERS = "CREATE OR REPLACE TEMP TABLE pairs AS SELECT pair, CAST(row_number() OVER (ORDER BY pair) - 1 AS INTEGER) AS k FROM (SELECT DISTINCT pair FROM link)"
_OF_STRETCH = "SELECT w, k FROM link JOIN pairs USING (pair) ORDER BY w"
_COUNTS = """
SELECT k, pair >> 20 AS a, pair & 1048575 AS b, docs FROM pairs JOIN (
  SELECT k, count(*) AS docs FROM (SELECT DISTINCT doc, k FROM held JOIN link USING (w) JOIN pairs USING (pair)) GROUP BY k) USING (k) ORDER BY k
"""


def _intervals(ids: np.ndarray, n: np.ndarray, size: np.ndarray) -> pa.Table:
    """Token intervals of stretches that lie end to end."""
    e = size[ids].cumsum()
    return pa.table({"w": np.repeat(np.arange(len(n), dtype=np.int32), n), "s": e - size[ids], "e": e, "id": ids.astype(np.int64)})


def _group_texts(pair: Pair, ids: list[np.ndarray], counts: list[np.ndarray], group: list[np.ndarray]) -> pa.StringArray:
    """``a1,a2|b1;`` of each stretch's groups, one after the other."""
    upto = [np.searchsorted(g, np.arange(int(g[-1]) + 2)) if len(g) else np.zeros(1, np.int64) for g in group]  # tokens before each group
    place = [np.arange(len(ids[0])) + upto[1][group[0]], np.arange(len(ids[1])) + upto[0][group[1] + 1]]
    width = len(pair.texts[0])
    order = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    for side in (0, 1):
        ends = np.append(group[side][1:] != group[side][:-1], True) if len(group[side]) else np.zeros(0, bool)
        order[place[side]] = 2 * ids[side].astype(np.int64) + ends + side * width
    flat = pc.take(pa.concat_arrays(pair.texts), pa.array(order))
    edge = np.frombuffer(flat.buffers()[1], np.int32)[: len(flat) + 1]
    tokens = np.concatenate(([0], np.cumsum(counts[0] + counts[1])))
    return pa.StringArray.from_buffers(len(counts[0]), pa.py_buffer(edge[tokens].astype(np.int32).tobytes()), flat.buffers()[2])


def _pack(arrays: dict[str, pa.Array]) -> bytes:
    sink = pa.BufferOutputStream()
    for name, x in arrays.items():
        table = pa.table({name: x})
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> dict[str, pa.ChunkedArray]:
    source, out = pa.BufferReader(data), {}
    while source.tell() < source.size():
        table = pa.ipc.open_stream(source).read_all()
        out[table.column_names[0]] = table.column(0)
    return out


def align_chunk(pair: Pair, con, ids: pa.Array, texts: pa.StringArray) -> tuple[dict[str, np.ndarray], bytes]:
    """Partial pair counts (k, a, b, docs) of the documents, and the documents packed: what is known of each,
    its stretches, and the pairs of each stretch."""
    texts = pc.fill_null(texts, "")
    some = np.flatnonzero(pc.binary_length(texts).to_numpy() > 0)
    cut = stretches(pair, texts.take(pa.array(some)))
    coded = cut.flatten().dictionary_encode()
    index, edge = coded.indices.to_numpy().astype(np.int64), cut.offsets.to_numpy().astype(np.int64)
    sides = [pair.tokens(side, coded.dictionary) for side in (0, 1)]
    right = sides[0][2] & sides[1][2]
    good = np.logical_and.reduceat(right[index], edge[:-1]) if len(some) else np.zeros(0, bool)
    index, size = index[np.repeat(good, np.diff(edge))], np.diff(edge)[good]
    right = np.zeros(len(right), bool)  # from here on the stretches of good documents, numbered anew
    right[index] = True
    index = (np.cumsum(right) - 1)[index]
    doc = np.repeat(np.arange(len(size)), size)
    token_ids, counts = [x[0][np.repeat(right, x[1])] for x in sides], [x[1][right] for x in sides]
    tiled = [_intervals(i, n, table[0]) for i, n, table in zip(token_ids, counts, pair.tables)]
    con.register("a", tiled[0])
    con.register("b", tiled[1])
    con.execute(_LINKS)
    con.execute(_NUMBERS)
    summed = con.execute(_GROUPS).fetchnumpy()
    ends = tiled[0]["e"].to_numpy()
    common = ends[np.asarray(summed["shared"], bool)]
    group = [np.asarray(summed["g"], np.int64), np.searchsorted(common, tiled[1]["e"].to_numpy())]
    of = con.execute(_OF_STRETCH).fetchnumpy()
    held = np.sort(doc << 32 | index)
    held = held[np.append(held[1:] != held[:-1], True)] if len(held) else held
    con.register("held", pa.table({"doc": (held >> 32).astype(np.int32), "w": (held & 0xFFFFFFFF).astype(np.int32)}))
    found = {c: np.asarray(x) for c, x in con.execute(_COUNTS).fetchnumpy().items()}
    for name in ("a", "b", "held"):
        con.unregister(name)
    texts_of = _group_texts(pair, token_ids, counts, group)
    links = np.bincount(np.asarray(of["w"]), minlength=len(counts[0]))
    groups = np.diff(group[0][np.cumsum(counts[0]) - 1] + 1, prepend=0)  # the last token of a stretch ends its group
    at = np.concatenate(([0], size.cumsum()))[:-1]
    out = {c: np.zeros(len(ids), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    digest, where = [""] * len(ids), some[good]
    if len(where):
        for c, n in zip(out, (*counts, groups, links)):
            out[c][where] = np.add.reduceat(n[index], at)
        every = texts_of.take(pa.array(index))
        view, edges = memoryview(every.buffers()[2]), np.frombuffer(every.buffers()[1], np.int32)
        for d, s, e in zip(where.tolist(), edges[at].tolist(), edges[np.append(at[1:], len(index))].tolist()):
            digest[d] = hashlib.sha256(view[s : e - 1]).hexdigest()
    packed = _pack({"id": ids, **{c: pa.array(x) for c, x in out.items()}, "groups_sha256": pa.array(digest, pa.string()), "where": pa.array(where.astype(np.int32)), "size": pa.array(size.astype(np.int32)),
                    "stretch": pa.array(index.astype(np.int32)), "links": pa.array(links.astype(np.int32)), "k": pa.array(np.asarray(of["k"], np.int32))})
    return found, packed


def _connection():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
    con.execute("SET preserve_insertion_order = false")
    con.execute("SET temp_directory = ''")  # a chunk is bounded: nothing goes to a machine's own disk
    return con


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        for part in portions(b, 1 << 30, most):
            n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + n > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.Table.from_batches(held)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): ``pairs`` is (a, b, docs, best), how many documents hold each linked pair of ids and the highest
    of the A id; ``documents`` is (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    Null and empty texts, and those whose tokens do not give the text's bytes again, have zeros and ''. Repeated rows
    are documents each; a null id stays null; an empty table gives no rows; other columns may have any names. A text of
    any length is one chunk at most, in memory of some 60 bytes a byte of text.
    """
    columns = {"chunk": "long", "k": "int", "a": "int", "b": "int", "docs": "long", "packed": "binary"}

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pair, con = load(path_a, path_b), _connection()
        chunk = TaskContext.get().partitionId() << 32
        for table in _chunks(batches, chunk_bytes):
            found, packed = align_chunk(pair, con, table.column("id").combine_chunks(), table.column("text").combine_chunks())
            none = pa.nulls(1, pa.int32())
            yield {"chunk": [chunk], "k": none, "a": none, "b": none, "docs": [None], "packed": [packed]}
            yield {"chunk": np.full(len(found["k"]), chunk), **{c: pa.array(found[c]).cast(pa.int64() if c == "docs" else pa.int32()) for c in found}, "packed": pa.nulls(len(found["k"]), pa.binary())}
            chunk += 1
        con.close()

    partial = written(map_arrow(picked(docs, id_col, text_col), columns, aligned), "aligned")
    ours = partial.filter("packed is null")
    counts = written(ours.groupBy("a", "b").agg(F.sum("docs").alias("docs")), "counts")
    pairs = written(counts.join(counts.groupBy("a").agg(F.max("docs").alias("best")), "a").select("a", "b", "docs", "best"), "pairs")
    known = ours.select("chunk", "k", "a", "b").join(pairs, ["a", "b"]).select("chunk", "k", "docs", (F.col("docs") == F.col("best")).alias("is_best"), F.lit(None).cast("binary").alias("packed"))
    packs = partial.filter("packed is not null").select("chunk", F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("docs"), F.lit(None).cast("boolean").alias("is_best"), "packed")

    def counted(table: pa.Table) -> pa.Table:
        whole = pc.is_valid(table.column("packed"))
        packed = _unpack(table.filter(whole).column("packed")[0].as_py())
        rest = table.filter(pc.invert(whole))
        k, n = rest.column("k").to_numpy(), rest.num_rows
        value = {"count_sum": np.zeros(n, np.int64), "n_best": np.zeros(n, np.int64)}
        value["count_sum"][k] = rest.column("docs").to_numpy()
        value["n_best"][k] = rest.column("is_best").to_numpy()
        links, size, where = (packed[c].to_numpy().astype(np.int64) for c in ("links", "size", "where"))
        stretch, of = packed["stretch"].to_numpy(), packed["k"].to_numpy()
        more = {}
        for c, x in value.items():
            more[c] = np.zeros(len(packed["id"]), np.int64)
            if len(where):
                by_stretch = np.add.reduceat(x[of], links.cumsum() - links)
                more[c][where] = np.add.reduceat(by_stretch[stretch], size.cumsum() - size)
        return pa.table({c: more[c] if c in more else packed[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")})

    schema = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return packs.unionByName(known).groupBy("chunk").applyInArrow(counted, schema), pairs
