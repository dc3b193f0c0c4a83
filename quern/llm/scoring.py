"""LM scoring: stupid-backoff scores from n-gram count tables partitioned by hash.

Counts are taken over all documents. A text's words lie between ASCII white
space, and with backoff factor a

    S(w | context) = count(context w) / count(context)   if the n-gram is in its table,
                     a * S(w | shorter context)          else; S(w) = count(w) / N.

Tables hold every n-gram of the corpus; a caller may ask for those of two words
and more that it has at least ``least`` times. ``count_tables`` gives them as
plain rows. For scores the join is relational on packed rows: documents are
gathered into blocks; a block's distinct n-grams with their counts go, sorted, to
the partition that their hash names; a partition is one part of a count table,
which it makes by adding the counts of all blocks, and joins to the n-grams asked
for; a block then sums the logarithms of its exploded n-grams per document.
Pre-aggregation by block keeps the most frequent n-gram at one entry per block.
With ``least`` above 1, n-grams of three words and more are only asked for where
both their parts are in the table, since no others can be. Blocks and partitions
are bounded in words; their number grows with the corpus, and a message between
the two holds fewer entries the larger the corpus is.

Nulls and limits: a null text is the empty text; a text without words scores 0
with a null mean; rows with a null ``doc_id`` count and are scored; repeated
rows count each and are scored each; texts of any length are whole; equal texts
have equal scores; columns beyond ``doc_id`` and ``text`` are not read, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import batches_of, documents, only, slices, small_batches, stage, texts_of
from quern.llm.textkernel import SPACES, Tokens, mix


@dataclass(frozen=True)
class ScoringParams:
    order: int = 3
    least: int = 1
    backoff: float = 0.4
    block_words: int = 1_000_000
    part_words: int = 4_000_000

    @property
    def at_once(self) -> int:
        """Orders that are asked for together, before any answer is known: all, unless tables leave something out."""
        return self.order if self.least <= 1 else min(2, self.order)


_CODEC = "zstd"


def pack(values: np.ndarray) -> bytes:
    """A compressed array, byte planes together."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T) if len(values) else np.zeros(0, np.uint8)
    raw = planes.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def unpack(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec=_CODEC, asbytes=True) if size else b"", np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def _ascending(hashes: np.ndarray) -> bytes:
    """As differences (modulo 2**64, so any order comes back, and ascending runs take less room)."""
    return pack(np.diff(hashes, prepend=np.uint64(0)))


def _restored(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def ngrams(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that end at each position; 0 where the text has fewer before it."""
    out = np.zeros(len(words), np.uint64)
    if len(words) >= n:
        h = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k] + np.uint64(k))
        out[n - 1 :] = np.maximum(h, np.uint64(1))
        inside = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first)) >= n - 1
        out[~inside] = 0
    return out


class Block:
    """Words of some documents, and what is known of their n-grams so far: per position the counts by order."""

    def __init__(self, row: dict, parts: int, answers: dict[int, dict[int, np.ndarray]], known: int, p: ScoringParams):
        """``known``: the orders whose answers are in; a block may have asked nothing of one."""
        self.p, self.parts = p, parts
        self.ids, self.first = row["ids"], np.concatenate([[0], np.cumsum(unpack(row["sizes"], "<i8"))])
        self.words = _restored(row["dictionary"])[unpack(row["words"], "<u4")]
        self.counts: list[np.ndarray] = []
        for n in range(1, known + 1):
            where = self.asked(n)[1]
            own = answers.get(n, {})
            got = np.concatenate([np.zeros(0, np.int64), *(own[k] for k in sorted(own))])
            total = np.zeros(len(self.words), np.int64)
            total[where >= 0] = got[where[where >= 0]]
            self.counts.append(total)

    def asked(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams to ask for, ascending, and each position's place among them (or -1)."""
        grams = ngrams(self.words, self.first, n)
        wanted = grams > 0
        if n > self.p.at_once:  # both parts of n - 1 words must be frequent
            frequent = self.counts[n - 2] >= self.p.least
            wanted &= frequent & np.append(False, frequent[:-1])
        distinct, inverse = np.unique(grams[wanted], return_inverse=True)
        where = np.full(len(grams), -1)
        where[wanted] = inverse
        return distinct, where

    def requests(self, block: int, n: int) -> Iterator[dict]:
        distinct, where = self.asked(n)
        own = np.bincount(where[where >= 0], minlength=len(distinct)).astype("<u4")
        part = (distinct.astype(np.float64) * (self.parts / 2.0**64)).astype(np.int64).clip(0, self.parts - 1)
        part = np.maximum.accumulate(part)  # equal hashes give equal parts, and the order stays
        edges = np.searchsorted(part, np.arange(self.parts + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            s = slice(edges[k], edges[k + 1])
            yield {"part": k, "block": block, "hashes": _ascending(distinct[s]), "own": pack(own[s])}

    def scores(self, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Per document its number of words and the sum of their log scores."""
        p = self.p
        place = np.arange(len(self.words)) - np.repeat(self.first[:-1], np.diff(self.first))
        reach = np.minimum(place + 1, p.order)  # words that a context and its word can have here
        log = np.zeros(len(self.words))
        open_ = np.ones(len(self.words), bool)
        for n in range(p.order, 0, -1):
            found = open_ & (self.counts[n - 1] >= (p.least if n > 1 else 1))
            if n > 1:
                below = np.append(0, self.counts[n - 2][:-1])[found]
            else:
                below = total
            log[found] = np.log(self.counts[n - 1][found] / below) + (reach[found] - n) * math.log(p.backoff)
            open_ &= ~found
        sums = np.add.reduceat(np.append(log, 0.0), self.first[:-1]) if len(self.first) > 1 else np.zeros(0)
        sizes = np.diff(self.first)
        return sizes, np.where(sizes > 0, sums, 0.0)


def backoff_scores(docs: DataFrame, params: ScoringParams = ScoringParams()) -> DataFrame:
    """doc_id, n_words, log_score (sum of the words' ln S) of every row."""
    spark, p = docs.sparkSession, params
    small_batches(spark)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids, hashes, sizes = [], [], []

        def block() -> pa.RecordBatch:
            nonlocal number
            words = np.concatenate([np.zeros(0, np.uint64), *hashes])
            dictionary, index, times = np.unique(words, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words get small numbers, which take less room
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            dictionary, index = dictionary[order], rank[index]
            row = {"block": [(task << 32) + number], "ids": pa.array([ids], pa.list_(pa.int64())), "n": [len(words)], "sizes": [pack(np.concatenate(sizes).astype("<i8"))], "dictionary": [_ascending(dictionary)], "words": [pack(index.astype("<u4"))]}
            number += 1
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            texts, doc_ids = texts_of(b), b.column(0).to_pylist()
            for i, j in slices(texts):
                t = Tokens(texts[i:j], SPACES)
                ids += doc_ids[i:j]
                hashes.append(t.hash)
                sizes.append(np.diff(t.first))
                if sum(map(len, hashes)) >= p.block_words:
                    yield block()
                    ids, hashes, sizes = [], [], []
        if ids:
            yield block()

    blocks = stage(spark, only(docs, doc_id="long", text="string").mapInArrow(gather, "block long, ids array<long>, n long, sizes binary, dictionary binary, words binary"), "scoring-blocks")
    total = blocks.agg(F.sum("n")).head()[0] or 0
    parts = max(16, math.ceil(total / p.part_words))

    def opened(left: pa.Table, right: pa.Table, known: int) -> tuple[int, Block] | None:
        rows = left.to_pylist()
        if not rows:
            return None
        answers: dict[int, dict[int, np.ndarray]] = {}
        for n, part, counts in zip(*(right.column(c).to_pylist() for c in ("n", "part", "counts")), strict=True):
            answers.setdefault(n, {})[part] = unpack(counts, "<i8")
        return rows[0]["block"], Block(rows[0], parts, answers, known, p)

    asking = "n int, part int, block long, hashes binary, own binary"
    columns = ["n", "part", "block", "hashes", "own"]
    request_type = pa.schema([("n", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("own", pa.binary())])

    def ask(n: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            got = opened(left, right, n - 1)
            rows = [r | {"n": n} for r in got[1].requests(got[0], n)] if got else []
            return pa.Table.from_pylist([{c: r[c] for c in columns} for r in rows], schema=request_type)

        return run

    def count(t: pa.Table) -> pa.Table:
        """Adds the counts of one partition of one table, and answers every block."""
        hashes = [_restored(h) for h in t.column("hashes").to_pylist()]
        own = [unpack(c, "<u4") for c in t.column("own").to_pylist()]
        distinct, where = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(where, weights=np.concatenate(own), minlength=len(distinct)).astype("<i8")[where]
        edges = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
        counts = [pack(totals[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        return pa.table({"n": t.column("n"), "part": t.column("part"), "block": t.column("block"), "counts": pa.array(counts, pa.binary())})

    def begin(orders: tuple[int, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    opened_ = Block(row, parts, {}, 0, p)
                    for n in orders:
                        rows = [r | {"n": n} for r in opened_.requests(row["block"], n)]
                        yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in rows], schema=request_type)

        return run

    def counted(requests: DataFrame, name: str) -> DataFrame:
        with batches_of(spark, 1):  # a row is a block, or a message of one
            return stage(spark, requests.groupBy("n", "part").applyInArrow(count, "n int, part int, block long, counts binary"), f"scoring-answers-{name}")

    # A round for short n-grams and one for each longer order, so that the files of one round are gone before the next.
    answers = counted(blocks.mapInArrow(begin(tuple(range(1, min(2, p.order) + 1))), asking), "first")
    for n in range(3, p.order + 1):
        if n <= p.at_once:
            requests = blocks.mapInArrow(begin((n,)), asking)
        else:
            requests = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask(n), asking)
        answers = answers.unionByName(counted(requests, str(n)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        got = opened(left, right, p.order)
        sizes, sums = got[1].scores(total) if got else (np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"doc_id": pa.array(got[1].ids if got else [], pa.int64()), "n_words": pa.array(sizes, pa.int64()), "log_score": pa.array(sums, pa.float64())})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, log_score double")


def count_tables(docs: DataFrame, params: ScoringParams = ScoringParams()) -> DataFrame:
    """n, words (array), count: the corpus's n-grams as plain rows, one table per n, partitioned by the n-gram's hash.

    Two aggregations per n-gram: within tasks first, so a frequent one is one row a task.
    """
    p = params
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\r\\f\\x0b]+"), lambda w: w != "")
    rows = only(docs, text="string").select(words.alias("w"))
    at = rows.select("w", F.explode(F.sequence(F.lit(1), F.lit(p.order))).alias("n")).filter("size(w) >= n")
    grams = at.select("n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i")).select("n", F.slice("w", F.col("i"), F.col("n")).alias("words"))
    counted = grams.groupBy("n", "words").agg(F.count("*").alias("count"))
    return counted.filter((F.col("n") == 1) | (F.col("count") >= p.least))


def op4_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_scores(documents(spark, sf_dir))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), mean.alias("mean_log_score"))


#: The same scores in DuckDB's SQL, order 3.
SCORING_SQL = """
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, i, w[i] AS w3, w[i-1] AS w2, w[i-2] AS w1
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)
), p2 AS (
  SELECT doc_id, i, w3, CASE WHEN i > 1 THEN w2 END AS w2, CASE WHEN i > 2 THEN w1 END AS w1 FROM p
), c1 AS (SELECT w3 AS a, count(*) AS n FROM p2 GROUP BY 1),
c2 AS (SELECT w2 AS a, w3 AS b, count(*) AS n FROM p2 WHERE w2 IS NOT NULL GROUP BY 1, 2),
c3 AS (SELECT w1 AS a, w2 AS b, w3 AS c, count(*) AS n FROM p2 WHERE w1 IS NOT NULL GROUP BY 1, 2, 3),
total AS (SELECT count(*) AS n FROM p2),
s AS (
  SELECT p2.doc_id,
    CASE WHEN c3.n IS NOT NULL THEN ln(c3.n / d2.n)
         WHEN c2.n IS NOT NULL THEN ln(c2.n / d1.n) + (least(p2.i, 3) - 2) * ln(0.4)
         ELSE ln(c1.n / total.n) + (least(p2.i, 3) - 1) * ln(0.4) END AS s
  FROM p2 CROSS JOIN total JOIN c1 ON c1.a = p2.w3
  LEFT JOIN c2 ON c2.a = p2.w2 AND c2.b = p2.w3
  LEFT JOIN c1 d1 ON d1.a = p2.w2
  LEFT JOIN c3 ON c3.a = p2.w1 AND c3.b = p2.w2 AND c3.c = p2.w3
  LEFT JOIN c2 d2 ON d2.a = p2.w1 AND d2.b = p2.w2
), g AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM s GROUP BY 1)
SELECT t.doc_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_words, round(coalesce(g.s, 0), 4) AS log_score,
       CASE WHEN g.n > 0 THEN round(g.s / g.n, 6) END AS mean_log_score
FROM t LEFT JOIN g USING (doc_id)
"""
