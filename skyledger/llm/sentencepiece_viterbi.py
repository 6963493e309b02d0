"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best path maximises the sum of the model's piece scores. The characters of a whole text go through one stream. No piece
is longer than ``longest`` characters, so the stream keeps the boundaries that a piece can still start at and no others; the
path to each is a chain of steps, a repeated piece one step with a count, so that a long run of spaces, in which paths stay
apart, takes no more than its window. Whenever all live paths meet in one boundary, ids up to it are committed.

Before a run of spaces and a line break the stream looks whether it has just converged there, with nothing kept from before.
Then what follows has the ids that it had when the stream last came from such a boundary over the same characters to the next one:
a worker remembers these stretches where they are short, and the stream steps over them. Nothing is assumed about
where paths meet: under a model whose pieces cross words the stream meets in fewer places and remembers longer stretches.

The pieces and scores come from the model file. For a model trained by merges the scores are ranks:
the result is the best path under these scores, which is not the order in which merges apply.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from skyledger.llm.common import map_arrow, picked, portions, text_bytes

#: Bytes of the stretches that a worker remembers (up to twice as many), and the longest that it remembers, in characters.
REMEMBERED, SHORT = 80_000_000, 64
#: A candidate for a boundary to remember is before a run of spaces or a line break.
_PART = re.compile(" +[^ \n]*|\n[^ \n]*|[^ \n]+")


class Model:
    """Pieces, costs and bytes of a SentencePiece model file with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        found = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                piece = piece.replace("▁", " ")
                self.bytes.append(piece.encode())
                found.append((piece, i, -sp.get_score(i)))
        self.set_pieces(found)
        self.size = np.array([len(b) for b in self.bytes])
        self.first = self.size.cumsum() - self.size
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def set_pieces(self, found: list[tuple[str, int, float]]) -> None:
        """(piece, id, cost) of all pieces that stand for text."""
        #: A node is (children by character, id of the piece that ends here or -1, its cost).
        self.root: tuple = ({}, -1, 0.0)
        self.longest = max((len(piece) for piece, _, _ in found), default=1)
        for piece, i, cost in sorted(found, key=lambda x: -len(x[0])):  # a prefix is made before it becomes a piece
            *path, last = piece
            children = self.root[0]
            for c in path:
                children = children.setdefault(c, ({}, -1, 0.0))[0]
            children[last] = (children.get(last, ({},))[0], i, cost)
        #: What one byte costs where no piece has the character.
        self.byte_cost = max([1.0, *(cost for _, _, cost in found if cost < 1e8)]) + 10.0
        #: Packed ids of stretches between two boundaries at which the stream had converged, by the character that follows.
        self.young: dict[str, dict[str, bytes]] = {" ": {}, "\n": {}, "": {}}
        self.old: dict[str, dict[str, bytes]] = {" ": {}, "\n": {}, "": {}}
        self.held = 0  # bytes of the young ones
        self.commits = 0  # boundaries at which the stream converged and that were used

    def remember(self, after: str, stretch: str, ids: bytes) -> None:
        if self.held >= REMEMBERED:
            self.young, self.old, self.held = {c: {} for c in self.young}, self.young, 0
        self.held += getsizeof(stretch) + getsizeof(ids) + 80  # an entry of a dict that has room to grow
        self.young[after][stretch] = ids

    def fallback(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte_id[b] for b in c.encode())


class Stream:
    """Viterbi over characters that arrive in any portions; ``ids`` grows as paths converge.

    ``cost``, ``start`` and ``piece`` stand for the boundaries from ``first`` on: the least cost of a path up to each, and where
    its last piece starts and which it is. A boundary is settled once all pieces from the ones before it have been followed
    through the text, so each start walks down the trie once. ``back`` has the last step of each path (boundary, step before, ids,
    how often the ids are repeated); steps are made when a path has to outlive its window.
    """

    def __init__(self, model: Model) -> None:
        self.model, self.ids = model, []
        self.restart()

    def restart(self) -> None:
        """From a boundary at which nothing is kept from before."""
        self.first = 0
        self.cost: list[float] = [0.0]
        self.start: list[int] = [0]
        self.piece: list[int | tuple[int, ...] | None] = [None]
        self.steps: list[tuple] = [(0, None, None, 0)]  # of the earlier boundaries
        self.open: list[tuple[int, tuple]] = []  # (start, node) of pieces that may still grow
        self.full = 2 * self.model.longest  # boundary at which paths are next tried for a common one

    def feed(self, text: str) -> None:
        at, n = 0, len(text)
        while at < n:
            last = self.first + len(self.cost) - 1
            if last >= self.full:
                self._converge()
            till = at + self.full - last
            self._search(text if at == 0 and till >= n else text[at:till])
            at = till

    def _search(self, text: str) -> None:
        """The boundaries of ``text``; the window holds all of it."""
        model, cost, from_, ids, base = self.model, self.cost, self.start, self.piece, self.first
        chars, n = model.root[0], len(text)
        at = len(cost) - 1  # index of the boundary before the text
        end = at + n
        cost += [math.inf] * n
        from_ += [-1] * n
        ids += [None] * n
        grown = []
        for s, node in self.open:  # of equal costs the longest last piece stays, since earlier starts come first
            so_far, j = cost[s - base], at
            for c in text:
                node = node[0].get(c)
                if node is None:
                    break
                j += 1
                if node[1] >= 0 and so_far + node[2] < cost[j]:
                    cost[j], from_[j], ids[j] = so_far + node[2], s, node[1]
                if not node[0]:
                    break
            else:
                grown.append((s, node))
        text = " " * at + text  # a character is at the index of the boundary before it
        for i in range(at, end):
            so_far, j, c = cost[i], i + 1, text[i]
            node = chars.get(c)
            if node is None or node[1] < 0:
                bytes_ = model.fallback(c)
                total = so_far + model.byte_cost * len(bytes_)
                if total < cost[j]:
                    cost[j], from_[j], ids[j] = total, base + i, bytes_
                if node is None:
                    continue
                children = node[0]
            else:
                children, id_, price = node
                if so_far + price < cost[j]:
                    cost[j], from_[j], ids[j] = so_far + price, base + i, id_
            while children:
                if j == end:
                    grown.append((base + i, node))
                    break
                node = children.get(text[j])
                if node is None:
                    break
                j += 1
                children, id_, price = node
                if id_ >= 0 and so_far + price < cost[j]:
                    cost[j], from_[j], ids[j] = so_far + price, base + i, id_
        self.open = grown

    @property
    def back(self) -> list[tuple]:
        steps, first = self.steps, self.first
        for i in range(len(steps), len(self.cost)):
            step, ids = steps[self.start[i] - first], self.piece[i]
            # a repeated piece is one step: the boundary between is no place to meet, but the chain stays short
            steps.append((first + i, step[1], ids, step[3] + 1) if step[2] == ids and type(ids) is int else (first + i, step, ids, 1))
        return steps

    def met(self, boundary: int) -> bool:
        """Whether all live paths go through ``boundary``, the one before the last character."""
        return self.first <= boundary and (not self.open or self.open[0][0] >= boundary) and (len(self.cost) < 2 or self.start[-1] == boundary)

    def take(self, boundary: int) -> None:
        """Commits up to ``boundary``."""
        late, out, known, i = [], [], len(self.steps), boundary - self.first
        while i >= known:
            late.append(self.piece[i])
            i = self.start[i] - self.first
        step = self.steps[i]
        while step[1] is not None:
            out.append(step)
            step = step[1]
        for _, _, ids, n in reversed(out):
            self.ids += ids if type(ids) is tuple else [ids] * n
        for ids in reversed(late):
            if type(ids) is tuple:
                self.ids += ids
            else:
                self.ids.append(ids)

    def _converge(self) -> None:
        """Commits up to the last step that the paths of all live boundaries share, and forgets boundaries that no live piece starts at."""
        last = self.first + len(self.cost) - 1
        starts = {last, *(s for s, _ in self.open)}
        back = self.back
        live = {id(x): x for x in (back[s - self.first] for s in starts)}
        while len(live) > 1:
            step = max(live.values(), key=lambda x: x[0])
            del live[id(step)]
            if step[1] is None:
                break
            live[id(step[1])] = step[1]
        keep = min(starts)
        meet = next(iter(live.values())) if len(live) == 1 else None
        if meet is not None and meet[1] is not None and meet[0] >= self.first:
            self.take(meet[0])
            self._cut(meet, keep)
        else:
            self._cut(None, keep)
        self.full = last + self.model.longest

    def _cut(self, root: tuple | None, keep: int) -> None:
        """Boundaries from ``keep`` on stay; their chains end at ``root``, whose ids are committed."""
        at = keep - self.first
        low = min(self.cost[at:])
        self.cost, self.start, self.piece = [x - low for x in self.cost[at:]], self.start[at:], self.piece[at:]
        self.steps, self.first = self.steps[at:], keep
        if root is None:
            return
        made: dict[int, tuple] = {id(root): (root[0], None, None, 0)}

        def again(step: tuple) -> tuple:
            chain = []
            while id(step) not in made:
                chain.append(step)
                step = step[1]
            for x in reversed(chain):
                made[id(x)] = (x[0], made[id(x[1])], x[2], x[3])
            return made[id(chain[0])] if chain else made[id(step)]

        live = {s for s, _ in self.open} | {self.first + len(self.cost) - 1}
        self.steps = [again(x) if self.first + i in live else (self.first + i, None, None, 0) for i, x in enumerate(self.steps)]

    def close(self) -> list[int]:
        self.take(self.first + len(self.cost) - 1)
        self.restart()
        return self.ids


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def _packed(model: Model, text: str) -> bytes:
    """Packed ids of a text, its first character included, from one stream over all of it."""
    parts, out, stream, i = _PART.findall(text), [], Stream(model), 0
    n = len(parts)
    young, old = model.young, model.old
    while i < n:
        part = parts[i]
        after = parts[i + 1][0] if i + 1 < n else ""
        ids = young[after].get(part)
        if ids is None and (ids := old[after].get(part)) is not None:
            model.remember(after, part, ids)
            young, old = model.young, model.old
        if ids is not None:
            out.append(ids)
            i += 1
            continue
        stream.ids, begin, at, fed = [], i, 0, 0
        stream.restart()
        while True:
            at += len(parts[i])
            i += 1
            if i == n:
                stream.feed(parts[-1][fed:])
                ids = stream.close()
                break
            stream.feed(parts[i - 1][fed:] + parts[i][0])
            if stream.met(at):
                stream.take(at)
                ids = stream.ids
                break
            fed = 1
        model.commits += 1
        packed = array("I", ids).tobytes()
        out.append(packed)
        if at <= SHORT and i - begin == 1:
            model.remember(parts[i][0] if i < n else "", parts[begin], packed)
            young, old = model.young, model.old
    return b"".join(out)


def encode_texts(model: Model, texts: pa.Array) -> list[np.ndarray]:
    """Ids of each text; like the library, a space is put in front and U+2581 counts as a space. Empty and null: none."""
    return [np.frombuffer(_packed(model, " " + t.replace("▁", " ")) if t else b"", "<u4") for t in texts.to_pylist()]


def encode_text(model: Model, text: str) -> np.ndarray:
    return encode_texts(model, pa.array([text], pa.string()))[0]


def decode_ids(model: Model, ids: np.ndarray) -> bytes:
    """UTF-8 of the ids' text, put together by index; the space put in front is taken off."""
    out = []
    for at in range(0, len(ids), 100_000):
        part = ids[at : at + 100_000]
        n = model.size[part]
        upto = n.cumsum()
        out.append(model.flat[np.repeat(model.first[part] - upto + n, n) + np.arange(upto[-1])].tobytes())
    return b"".join(out).removeprefix(b" ")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as array<int> for every row of ``docs``; null and empty texts have none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = load(path)
        for b in batches:
            for part in portions(b, 1000, 4_000_000):
                yield {"id": part.column("id"), "ids": [x.astype(np.int32) for x in encode_texts(model, part.column("text"))]}

    return map_arrow(picked(docs, id_col, text_col), {"id": "long", "ids": "array<int>"}, rows)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(id, text) of (id, ids); null ids give an empty text, bytes that are no UTF-8 become U+FFFD."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = load(path)
        for b in batches:
            yield {"id": b.column("id"), "text": [decode_ids(model, np.array(x or [], np.int64)).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]}

    return map_arrow(coded.select("id", "ids"), {"id": "long", "text": "string"}, rows)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, n_ids, ids_crc32, text_crc32, exact) for every row: what encoding gave, and
    whether decoding gives the text again (all but U+2581, which decodes as a space). Null: empty.

    ids_crc32 is over little-endian 32-bit ids, text_crc32 over the decoded text in UTF-8. Repeated rows are each
    answered, a null id stays null, an empty table gives no rows and other columns may have any names. A text takes
    some 26 bytes of memory a byte, for its list of stretches; the stream itself keeps its window only. Of paths of equal cost the one whose last piece is longest is taken.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = load(path)
        for b in batches:
            for part in portions(b, 1000, 4_000_000):
                out = {k: [] for k in ("n_ids", "ids_crc32", "text_crc32", "exact")}
                for text, ids in zip(text_bytes(part), encode_texts(model, part.column("text"))):
                    again = decode_ids(model, ids)
                    for k, v in zip(out, (len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(again), again == text)):
                        out[k].append(v)
                yield {"id": part.column("id"), "n_chars": pc.utf8_length(pc.fill_null(part.column("text"), "")).cast(pa.int64())} | out

    return map_arrow(picked(docs, id_col, text_col), {"id": "long", "n_chars": "long", "n_ids": "long", "ids_crc32": "long", "text_crc32": "long", "exact": "boolean"}, rows)
