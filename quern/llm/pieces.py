"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into three machines. The normaliser prefixes a space
and writes spaces as the piece alphabet's mark. The piece machine is a trie that
reads characters and writes pieces, with byte arcs for characters outside the
vocabulary. A constraint machine has one state per piece, and an arc from piece
a to piece b of weight 0 if merging the characters of "ab" by the model's merge
order leaves exactly a, b, of infinite weight otherwise. A text's encoding is
the tropical-semiring shortest path of its composition with the three.

Why the constraint machine: the model merges pairs by rank, and the cheapest sum
of piece scores is in general not what merging gives. But merging has a local
character: a sequence of pieces is the result of merging if and only if every
neighbouring pair is. So the only path of finite weight is the right one, and
every position of a text has one state at most.

Texts are cut where no piece can reach across (before a run of spaces and around
line ends), so a unit is composed once and kept. New units of a batch go through
the machines in lockstep, as arrays.

Nulls and limits: a null text is the empty text, with no ids; texts and units of
any length are encoded whole; rows with a null ``doc_id`` and repeated rows are
encoded like others; columns beyond ``doc_id`` and ``text`` are not read; an
empty table gives no rows. The mark itself in a text reads as a space.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.shared import documents, only, slices, small_batches, texts_of

MARK = "▁"
#: Piece types of the model format: normal 1, unknown 2, control 3, user-defined 4, unused 5, byte 6.
NORMAL, BYTE = 1, 6
UNIT = re.compile(r" *[^ \n]+|\n| +")
#: Units kept per worker; the frequent ones come first by themselves.
KEPT = 300_000
#: Longer units are composed one by one, in stretches of so many positions.
LOCKSTEP, STRETCH = 40, 1 << 16
#: Constraint arcs remembered per worker; beyond, they are worked out anew.
ARCS = 2_000_000
NONE, START, OUTSIDE = -1, -2, -3


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a serialised message's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[i : i + size]
            i += size


class Table:
    """An integer-to-integer map in arrays, looked up for many keys at once; absent keys give -1."""

    def __init__(self, bits: int = 12):
        self._reset(bits)

    def _reset(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct, absent keys."""
        if (self.used + len(keys)) * 2 > 1 << self.bits:
            full = self.keys >= 0
            keys, values = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values])
            self._reset(max(self.bits + 1, (4 * len(keys)).bit_length()))
        self.used += len(keys)
        slot = self._slot(keys)
        while len(keys):
            slot, first = np.unique(slot, return_index=True)
            free = self.keys[slot] < 0
            placed = first[free]
            self.keys[slot[free]], self.values[slot[free]] = keys[placed], values[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, values = keys[rest], values[rest]
            slot = self._slot(keys)
            for _ in range(1 << self.bits):
                taken = self.keys[slot] >= 0
                if not taken.any():
                    break
                slot[taken] = (slot[taken] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Transducer:
    """The compiled model."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        if trainer.get(3) != 2 or normaliser.get(2) or normaliser.get(4, 1) or not trainer.get(35):
            raise ValueError("the model must merge pairs, keep texts as they are, and have bytes to fall back on")
        self.rank = {p: (-s, k) for k, (p, s) in enumerate(zip(self.pieces, self.scores, strict=True)) if kinds[k] == NORMAL}
        self.number = {p: k for p, (_, k) in self.rank.items()}
        self.byte = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if kinds[k] == BYTE}
        self.longest = max(map(len, self.number))
        # The trie: edges keyed by node and character, and the piece that ends at a node.
        nodes, edges, ends = 1, {}, {}
        for piece, k in self.number.items():
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                if key not in edges:
                    edges[key] = nodes
                    nodes += 1
                node = edges[key]
            ends[node] = k
        self.edges = Table()
        self.edges.add(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32))
        self.ends = np.full(nodes, NONE, np.int32)
        self.ends[list(ends)] = list(ends.values())
        self.allowed = Table()  # constraint arcs met so far
        self.free: dict[int, bool] = {}  # those of long units, for single looks
        self.kept: dict[str, bytes] = {}
        # What a piece stands for when decoding.
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kinds[k] == BYTE else p.replace(MARK, " ").encode() if kinds[k] == NORMAL else b"" for k, p in enumerate(self.pieces)]

    def merged(self, text: str) -> list[str]:
        """The pieces that merging neighbours by rank leaves of a short text."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def arc(self, before: int, piece: int) -> bool:
        """Whether the constraint machine has a finite arc; START and OUTSIDE stand for no piece before."""
        want = [self.pieces[piece]] if before < 0 else [self.pieces[before], self.pieces[piece]]
        return self.merged("".join(want)) == want

    def allows(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The same for many pairs, remembered."""
        if self.allowed.used >= ARCS:
            self.allowed = Table()
        keys = (np.where(before < 0, len(self.pieces), before).astype(np.int64) << 32) | piece
        out = self.allowed.get(keys)
        missing = np.unique(keys[out < 0])
        if len(missing):
            values = [self.arc(-1 if key >> 32 == len(self.pieces) else key >> 32, key & 0xFFFFFFFF) for key in missing.tolist()]
            self.allowed.add(missing, np.array(values, np.int32))
            out = self.allowed.get(keys)
        return out == 1

    def compose(self, units: list[str]) -> list[bytes]:
        """Shortest paths of units of similar length, in lockstep: ids as little-endian 32-bit integers."""
        sizes = np.array([len(u) for u in units])
        width, n = int(sizes.max()), len(units)
        points = np.zeros((n, width + self.longest), np.int64)
        flat = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        inside = np.arange(width + self.longest)[None, :] < sizes[:, None]
        points[inside] = flat
        last = np.full((n, width + 1), NONE, np.int32)  # the one state of finite weight at each position
        back = np.zeros((n, width + 1), np.int32)
        last[:, 0] = START
        for j in range(width):
            rows = np.flatnonzero((last[:, j] != NONE) & (sizes > j))
            node = np.zeros(len(rows), np.int64)
            before = last[rows, j]
            for k in range(1, self.longest + 1):
                node = self.edges.get(node.astype(np.int64) << 21 | points[rows, j + k - 1])
                if k == 1 and (out := node < 0).any():
                    last[rows[out], j + 1], back[rows[out], j + 1] = OUTSIDE, j
                live = (node >= 0) & (sizes[rows] >= j + k)
                rows, node, before = rows[live], node[live], before[live]
                if not len(rows):
                    break
                piece = self.ends[node]
                some = np.flatnonzero(piece >= 0)
                some = some[self.allows(before[some], piece[some])]
                last[rows[some], j + k], back[rows[some], j + k] = piece[some], j
        out: list[list[int]] = [[] for _ in units]
        place, rows = sizes.copy(), np.arange(n)
        steps = []
        while len(rows):
            steps.append((rows, last[rows, place[rows]], back[rows, place[rows]]))
            place[rows] = back[rows, place[rows]]
            rows = rows[place[rows] > 0]
        for rows, piece, begin in reversed(steps):
            for r, p, b in zip(rows.tolist(), piece.tolist(), begin.tolist(), strict=True):
                if p == OUTSIDE:
                    out[r] += [self.byte[x] for x in units[r][b].encode("utf-8")]
                else:
                    out[r].append(p)
        return [np.array(x, "<i4").tobytes() for x in out]

    def arcs_of(self, points: np.ndarray, begin: int, end: int) -> tuple[list[int], list[int], list[int]]:
        """The piece machine's arcs from the positions of a stretch: where each position's arcs lie, and their ends and pieces."""
        rows, node, found = np.arange(begin, end), np.zeros(end - begin, np.int64), []
        for k in range(1, self.longest + 1):
            inside = rows + k <= len(points)
            rows, node = rows[inside], node[inside]
            node = self.edges.get(node << 21 | points[rows + k - 1])
            rows, node = rows[node >= 0], node[node >= 0].astype(np.int64)
            if not len(rows):
                break
            piece = self.ends[node]
            found.append(np.stack([rows[piece >= 0], rows[piece >= 0] + k, piece[piece >= 0]]))
        starts, ends, pieces = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        order = np.argsort(starts, kind="stable")
        return np.searchsorted(starts[order], np.arange(begin, end + 1)).tolist(), ends[order].tolist(), pieces[order].tolist()

    def compose_long(self, unit: str) -> bytes:
        """The same for one long unit: its arcs stretch by stretch for all positions at once, then one step a position along the path."""
        n, free, none = len(unit), self.free, len(self.pieces)
        points = np.frombuffer(unit.encode("utf-32-le"), "<u4").astype(np.int64)
        last, back = array("i", [NONE]) * (n + 1), array("i", [0]) * (n + 1)
        last[0] = START
        for begin in range(0, n, STRETCH):
            end = min(n, begin + STRETCH)
            at, ends, pieces = self.arcs_of(points, begin, end)
            for j in range(begin, end):
                before = last[j]
                if before == NONE:
                    continue
                if unit[j] not in self.number:
                    last[j + 1], back[j + 1] = OUTSIDE, j
                head = (before if before >= 0 else none) << 32
                for x in range(at[j - begin], at[j - begin + 1]):
                    fits = free.get(head | pieces[x])
                    if fits is None:
                        if len(free) >= ARCS:
                            free.clear()
                        fits = free[head | pieces[x]] = self.arc(before, pieces[x])
                    if fits:
                        last[ends[x]], back[ends[x]] = pieces[x], j
        out, place = array("i"), n
        while place:
            begin = back[place]
            out.extend([self.byte[x] for x in reversed(unit[begin].encode("utf-8"))] if last[place] == OUTSIDE else [last[place]])
            place = begin
        return np.array(out[::-1], "<i4").tobytes()

    def learn(self, units: set[str]) -> dict[str, bytes]:
        """Encodings of new units, composed in groups of similar length."""
        got: dict[str, bytes] = {}
        ordered = sorted(units, key=len)
        i = 0
        while i < len(ordered):
            size = len(ordered[i])
            j = i + 1
            while j < len(ordered) and size <= LOCKSTEP and len(ordered[j]) <= max(size + 3, size * 5 // 4) and j - i < 20_000:
                j += 1
            marked = [u.replace(" ", MARK) for u in ordered[i:j]]
            got.update(zip(ordered[i:j], self.compose(marked) if size <= LOCKSTEP else map(self.compose_long, marked), strict=True))
            i = j
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        cut = [UNIT.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        new: set[str] = set()
        for units in cut:
            new.update(u for u in units if u not in self.kept)
        known = self.learn(new) if new else {}
        for unit, ids in known.items():
            if len(self.kept) >= KEPT:
                break
            if len(unit) <= LOCKSTEP:
                self.kept[unit] = ids
        either = {**known, **{u: self.kept[u] for units in cut for u in units if u in self.kept}} if known else self.kept
        return [b"".join(map(either.__getitem__, units)) for units in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that encoding put first."""
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text, ids (array of integers) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for b in batches:
            texts = texts_of(b)
            for i, j in slices(texts):
                rows = machine.encode(texts[i:j])
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(texts[i:j], pa.string()), ids], ["doc_id", "text", "ids"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (with ``ids``) plus ``decoded``."""
    small_batches(encoded.sparkSession)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            values, edges = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            texts = [machine.decode(values[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    both = decode(encode(documents(spark, sf_dir), model), model)
    return both.select("doc_id", F.size("ids").alias("n_ids"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))
