"""Packing: order-preserving dynamic programming over window cuts, with monotone queues.

Documents in ascending ``doc_id`` within each input partition form one stream of
tokens; every document ends with id 0. The stream is cut into windows of at most
``length`` tokens. A window pays its padding (none at a power of two), a fixed
price per window, and for its cut: nothing at a document's end, little at a
sentence's end, more inside a sentence. The cheapest cuts come from

    f[j] = cut[j] + min over i of f[i] + window(position[j] - position[i])

over candidate borders. Padding falls by one per token, so f[i] + position[i]
is kept in a monotone queue for windows up to ``length``, and in further ones
for spans that hold forced cuts, each after exactly ``length`` tokens.

The stream is handled in stretches of ``stretch`` tokens: a stretch's plan is
fixed up to its last few windows, the rest is planned again with what follows.
Nothing is shuffled, memory is one stretch plus one document, and a task that
is run again yields the same rows. ``sequence_id`` holds the input partition in
its upper half.

Nulls and limits: a null text is the empty text, one token (id 0); null
``doc_id`` rows are packed first; repeated rows are packed each; a text of any
length is cut into as many windows as it needs; of cuts that cost the same the
longer window wins; columns beyond ``doc_id`` and ``text`` are not read, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import documents, only, small_batches, texts_of


@dataclass(frozen=True)
class PackingParams:
    length: int = 1024
    window_price: int = 8
    sentence_price: int = 1
    forced_price: int = 6
    #: Forced cuts in a row at most, between borders.
    forced: int = 3
    #: Sentences' ends closer than this to the last candidate are no candidates; 1 takes them all.
    spacing: int = 1
    stretch: int = 1 << 19
    end_id: int = 0


#: What the file's "ByteLevel" pre-tokenizer stands for: a fixed pattern.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters for which both tokenizer libraries are known to split alike: Latin, Greek and Cyrillic scripts, general punctuation.
_SPACES = re.compile(r"\s+")
_PLAIN = re.compile(r"[^\x00-ɏͰ-ӿ‐-‧‰-⁞₠-₿]")


#: The faster library keeps a state for each character of a run of white space, and gives up at a million or so; texts with runs beyond this are not for it.
RUN = 10_000


def _long_run(text: str) -> bool:
    """Whether a run of white space reaches RUN: then half of it follows on one of the characters looked at here."""
    half = RUN // 2
    return any(text[at].isspace() and _SPACES.match(text, at).end() - at >= half for at in range(0, len(text), half))


class Encoder:
    """Ids as the tokenizer file gives them, and whether an id ends a sentence.

    Plain texts go through a faster library on the same vocabulary and merges,
    which gives the same ids; texts with other characters, with the string of
    a special token, or with long runs of white space go through the tokenizer itself. So do all texts where the
    file asks for anything but plain byte-level pairs, merged in the order of
    their ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        # The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = self.slow.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ranks = {}
        for piece, k in vocabulary.items():
            if piece not in self.special:
                raw = bytes(byte[c] for c in piece)
                ranks[raw] = k
                self.ends[k] = b"\n" in raw or raw.rstrip(b" \"')").endswith((b".", b"!", b"?"))
        self.fast = tiktoken.Encoding("packing", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}) if self._plain(spec) else None

    @staticmethod
    def _plain(spec: dict) -> bool:
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return False
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return False
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        return merged == sorted(merged) and len(set(merged)) == len(merged)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or _PLAIN.search(text) or any(s in text for s in self.special) or _long_run(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def padding(n: int, length: int) -> int:
    return 0 if n & (n - 1) == 0 else length - n


def borders(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, p: PackingParams) -> tuple[list[int], list[int]]:
    """Candidate cuts of a stretch and their prices; ``ends`` are the documents' ends."""
    inner = np.flatnonzero(sentence[ids]) + 1
    price = {0: 0, len(ids): p.forced_price}
    last = 0
    for x in inner.tolist():
        if x - last >= p.spacing:
            price[x] = p.sentence_price
            last = x
    price.update(dict.fromkeys(ends.tolist(), 0))
    at = sorted(price)
    for a, b in zip(at, at[1:], strict=False):
        for x in range(a + p.length // 2, b, p.length // 2):  # a sentence longer than half a window
            price[x] = p.forced_price
    at = sorted(price)
    return at, [price[x] for x in at]


def cuts(at: list[int], price: list[int], p: PackingParams) -> list[int]:
    """Ends of the cheapest windows that cover positions at[0] to at[-1]."""
    m, length = len(at), p.length
    f, back, keys = [0] * m, [0] * m, [0] * m
    x_ = np.array(at, np.int64)
    # Starts of windows without padding, for all borders at once: pairs of a border and an earlier one at a power of two from it.
    plain: list[list[int]] = [[] for _ in range(m)]
    for d in [1 << k for k in range(length.bit_length() - 1)] + [length]:
        i = np.searchsorted(x_, x_ - d)
        for j in np.flatnonzero(x_[i] == x_ - d).tolist():
            plain[j].append(int(i[j]))
    # A span with h forced cuts starts in [low[h], low[h - 1]), more than ``length`` before its end, so the cheapest starts of all such spans
    # that end within ``length`` of a border are found at once when the borders before that one are done.
    low = [np.searchsorted(x_, x_ - (h + 1) * length) for h in range(p.forced + 1)]
    cost = np.array([(h + 1) * length + h * (p.forced_price + p.window_price) for h in range(1, p.forced + 1)], np.int64)[:, None]
    ranges = np.stack([np.stack(low[1:]), np.stack(low[:-1])], 2) if p.forced else None
    some = ranges[:, :, 0] < ranges[:, :, 1] if p.forced else None
    done, never = np.zeros(m, np.int64), 1 << 60
    queue: deque[int] = deque()  # starts of windows without forced cuts, by rising key (f + position): its head is the cheapest
    first = 0
    while first < m:
        end = bisect_right(at, at[first] + length, first)
        far = [never] * (end - first)
        if p.forced and first:
            least = np.minimum.reduceat(done[:end], ranges[:, first:end].ravel())[::2].reshape(p.forced, -1)
            far = np.where(some[:, first:end], least + cost, never).min(0).tolist()
        for j in range(max(first, 1), end):
            x = at[j]
            key = keys[j - 1]
            while queue and keys[queue[-1]] >= key:
                queue.pop()
            queue.append(j - 1)
            while queue and at[queue[0]] < x - length:
                queue.popleft()
            # In keys, which lack the border's own position; of equal ones the span with fewer forced cuts, and of these the later start.
            best, who = (keys[queue[0]] + length, queue[0]) if queue else (never, 0)
            if far[j - first] < best:
                best, who = far[j - first], -1  # its start is looked up below, if the way back comes here
            best -= x
            for i in plain[j]:
                if f[i] < best:
                    best, who = f[i], i
            f[j], back[j] = best + price[j] + p.window_price, who
            keys[j] = f[j] + x
        done[first:end] = keys[first:end]
        first = end
    out, j = [], m - 1
    while j:
        i = back[j]
        if i < 0:
            starts = [(int(done[low[h][j] : low[h - 1][j]].min()) + int(cost[h - 1, 0]), h) for h in range(1, p.forced + 1) if low[h][j] < low[h - 1][j]]
            h = min(starts)[1]
            part = done[low[h][j] : low[h - 1][j]]
            i = int(low[h - 1][j]) - 1 - int(part[::-1].argmin())
        out += [at[j], *reversed(range(at[i] + length, at[j], length))]
        j = i
    return out[::-1]


def plan(stream: Iterator[tuple[object, np.ndarray]], sentence: np.ndarray, p: PackingParams) -> Iterator[tuple]:
    """(doc_id, start, ids, doc_tokens, sequence, offset) of each piece; ``stream`` yields documents in order."""
    held: list[list] = []  # doc_id, ids, tokens already emitted
    size = sequence = 0

    def emit(last: bool) -> Iterator[tuple]:
        nonlocal size, sequence
        rest = [d[1][d[2] :] for d in held]
        ids, ends = np.concatenate(rest), np.cumsum([len(r) for r in rest])
        fixed = cuts(*borders(ids, ends, sentence, p), p)
        if not last:
            fixed = [x for x in fixed if x <= len(ids) - 16 * p.length]
        begin = 0
        for end in fixed:
            offset = 0
            while begin < end:
                d = held[0]
                n = min(end - begin, len(d[1]) - d[2])
                yield d[0], d[2], d[1][d[2] : d[2] + n], len(d[1]), sequence, offset
                d[2], begin, offset, size = d[2] + n, begin + n, offset + n, size - n
                if d[2] == len(d[1]):
                    held.pop(0)
            sequence += 1

    for doc_id, ids in stream:
        held.append([doc_id, ids, 0])
        size += len(ids)
        if size >= p.stretch:
            yield from emit(False)
    if held:
        yield from emit(True)


def pack(docs: DataFrame, tokenizer: str, params: PackingParams = PackingParams()) -> DataFrame:
    """Pieces with their token ids: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    p = params
    small_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer), TaskContext.get().partitionId() << 32
        end = np.array([p.end_id], np.uint32)

        def stream() -> Iterator[tuple[object, np.ndarray]]:
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                    yield doc_id, np.concatenate([encode(text), end])

        rows: list[tuple] = []
        for doc_id, start, ids, total, sequence, offset in plan(stream(), encode.ends, p):
            rows.append((doc_id, start, len(ids), ids.astype("<u4", copy=False).tobytes(), total, base + sequence, offset))
            if len(rows) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    ordered = only(docs, doc_id="long", text="string").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packed_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in the ids' place."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_digest(pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
