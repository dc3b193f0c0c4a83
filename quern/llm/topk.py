"""Exact top-k search: norm buckets with per-bucket pruning, then verified inner products.

Candidates are dealt by their length (norm) into ranges, cut at quantiles, and
ranges into blocks of bounded size. Every query first meets the range of the
longest vectors. With its k-th best score s from there, a range whose longest
vector has length l can only help it if the cosine reaches s / (|q| l), the local
threshold; a query goes to the ranges where that is at most 1 and to no others,
and candidates go to as many blocks of queries as their range is asked by. So
what is pruned is not shuffled. In the worst case (equal lengths, or scores of 0
and less) every block of candidates meets every block of queries.

Inside a block the candidates are sorted by length and cut into buckets, and for
a query and its k-th best score so far

* a bucket with a local threshold above 1 is skipped;
* high thresholds use coordinate pruning: on the query's strongest coordinates
  a unit vector within the threshold's angle must lie in an interval;
* otherwise length pruning keeps the bucket's prefix that is long enough.

What is left is verified with exact products: in doubles or 64-bit integers where
the lengths say that these hold them, else in integers of any size. Each meeting
sends at most k rows per query on, and a windowed rank keeps the best k of those.

Nulls and limits: a vector that is null or holds a null, NaN or infinite
component takes no part; an empty one does (its products are 0); components
count as floor(256 x), whatever their size; a score that a long cannot hold is an
error; shorter vectors are padded with zeros; a null ``vec_id`` takes no part;
rows that repeat a ``vec_id`` are each a candidate and each a query, which leaves
out one row equal to it in id and vector, its own; ties go to the smaller
``vec_id``; columns beyond ``vec_id`` and ``embedding`` are not read, whatever
their names; a query with fewer than k candidates returns all of them; an empty
table of either kind gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import only, stage
from quern.session import ship


@dataclass(frozen=True)
class TopKParams:
    k: int = 5
    scale: int = 256
    block: int = 8192
    query_block: int = 1024
    bucket: int = 512
    #: Ranges of lengths at most; a row of each comes to the driver.
    ranges: int = 32
    coordinates: int = 3
    #: Local thresholds from which the intervals of coordinate pruning are narrow enough to pay.
    coordinate_from: float = 0.7


def matrix(table: pa.Table, name: str, width: int) -> np.ndarray:
    """A column of arrays of whole numbers as rows of ``width`` doubles, padded with zeros."""
    out = np.zeros((table.num_rows, width))
    if table.num_rows:
        lists = table.column(name).combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    if not np.isfinite(out).all():
        raise ValueError("a component does not fit a double after scaling, so no long holds its products")
    return out


def products(q: np.ndarray, c: np.ndarray, kind: type, own: tuple = ()) -> np.ndarray:
    """Exact inner products of rows of whole numbers as 64-bit integers; 0 at the places ``own``, which do not count."""
    got = q @ c.T
    if own:
        got[own] = 0
    if kind is object and got.size and max(abs(int(got.max())), abs(int(got.min()))) >= 1 << 63:
        raise ValueError("an inner product does not fit a long")
    return got.astype(np.int64)


def exact_kind(q: np.ndarray, c: np.ndarray, reach: float) -> type:
    """In which numbers products of at most ``reach`` (and their partial sums) are exact."""
    if reach < 2.0**52:
        return np.float64
    large = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
    return np.int64 if reach < 2.0**62 and large < 2.0**62 else object


def as_kind(x: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return x.astype(kind)
    out = np.empty(x.shape, object)
    out[...] = [[int(v) for v in row] for row in x.tolist()] if x.size else 0
    return out


def best(q: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best k entries of each query, and each query's k-th score (or the least number)."""
    order = np.lexsort((ids, -scores, q))
    q, scores, ids = q[order], scores[order], ids[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = rank < k
    least = np.full(n, np.iinfo(np.int64).min)
    full = rank == k - 1
    least[q[full]] = scores[full]
    return q[keep], scores[keep], ids[keep], least


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, p: TopKParams, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact best k of a block of candidates for each query, from the scores in ``floor`` on: query row, score, id."""
    q_norm, c_norm = np.sqrt((q**2).sum(1)), np.sqrt((c**2).sum(1))
    kind = exact_kind(q, c, float(q_norm.max(initial=0)) * float(c_norm.max(initial=0)))
    order = np.lexsort((c_ids, -c_norm))
    plain, c_ids, c_norm = c[order], c_ids[order], c_norm[order]
    # A query's own row: the first one equal to it.
    asked = np.flatnonzero(np.isin(c_ids, q_ids))[::-1].tolist()
    place = {(int(c_ids[k]), (plain[k] + 0.0).tobytes()): k for k in asked}
    own = np.array([place.get((i, v.tobytes()), -1) for i, v in zip(q_ids.tolist(), q + 0.0, strict=True)], np.int64)
    c, qx = as_kind(plain, kind), as_kind(q, kind)
    unit = q / np.where(q_norm > 0, q_norm, 1)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1)[:, : p.coordinates]
    n = len(q)
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    least = np.full(n, np.iinfo(np.int64).min) if floor is None else floor.copy()
    floor = least.copy()
    for a in range(0, len(c), p.bucket):
        block, ids, norms = c[a : a + p.bucket], c_ids[a : a + p.bucket], c_norm[a : a + p.bucket]
        with np.errstate(divide="ignore", invalid="ignore"):
            need = least / q_norm  # length a candidate needs at cosine 1
            local = need / norms[0]
        idle = (least > 0) & ((q_norm == 0) | (norms[0] == 0) | (local > 1 + 1e-9))
        narrow = ~idle & (least > 0) & (local >= p.coordinate_from)
        wide = np.flatnonzero(~idle & ~narrow)
        found = [held]
        if len(wide):
            # Length pruning; at or below 0 every length may help.
            reach = len(block) if (least[wide] <= 0).any() else int((norms >= need[wide].min() * (1 - 1e-9)).sum())
            mine = own[wide] - a
            some = np.flatnonzero((mine >= 0) & (mine < reach))
            scores = products(qx[wide], block[:reach], kind, (some, mine[some]))
            scores[some, mine[some]] = np.iinfo(np.int64).min
            bar = least[wide]
            if reach > p.k:
                bar = np.maximum(bar, np.partition(scores, reach - p.k, axis=1)[:, reach - p.k])
            i, j = np.nonzero((scores >= bar[:, None]) & (scores > np.iinfo(np.int64).min))
            found.append((wide[i], scores[i, j], ids[j]))
        if narrow.any():
            directions = plain[a : a + p.bucket] / np.where(norms > 0, norms, 1)[:, None]
            for i in np.flatnonzero(narrow).tolist():
                # cos >= t confines a unit vector's coordinate to within the angle of t around the query's.
                t, x = min(local[i], 1.0), unit[i, focus[i]]
                side, size = np.where(x < 0, -1.0, 1.0), np.abs(x)
                slack = np.sqrt((1 - x * x).clip(0) * (1 - t * t)) + 1e-9
                turned = directions[:, focus[i]] * side
                at = np.flatnonzero(((turned >= size * t - slack) & ((size >= t) | (turned <= size * t + slack))).all(1))
                at = at[at + a != own[i]]
                scores = products(qx[i : i + 1], block[at], kind)[0]
                ok = scores >= least[i]
                found.append((np.full(int(ok.sum()), i), scores[ok], ids[at][ok]))
        if len(found) > 1:
            *held, least = best(*(np.concatenate(x) for x in zip(*found, strict=True)), p.k, n)
            least = np.maximum(least, floor)
    return held


def _numbers(df: DataFrame, p: TopKParams) -> DataFrame:
    """vec_id, v (whole numbers, as doubles), norm of the rows that take part."""
    rows = only(df, vec_id="long", embedding="array<double>").filter("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    # From 2**52 on a double has no fraction, and beyond 2**63 it is no long.
    whole = lambda y: F.when(F.abs(y) >= 2.0**52, y).otherwise(F.floor(F.when(F.abs(y) < 2.0**52, y)).cast("double"))
    v = F.transform("embedding", lambda x: whole(x * float(p.scale)))
    return rows.select("vec_id", v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)))


def top_k(queries: DataFrame, candidates: DataFrame, params: TopKParams = TopKParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the best k inner products of each query row against all candidate rows but its own."""
    p, spark = params, candidates.sparkSession
    ship(spark)
    c = _numbers(candidates, p)
    # Equal query rows ask once and are told each.
    name = (F.xxhash64("vec_id", "v").alias("q1"), F.xxhash64(F.lit(1), F.col("v")).alias("q2"))
    q = _numbers(queries, p).groupBy("vec_id", *name).agg(F.first("v").alias("v"), F.first("norm").alias("norm"), F.count("*").alias("copies"))
    q = stage(spark, q, "topk-queries")
    asked = q.agg(F.count("*").alias("m"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w")).head()
    sizes = c.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w")).head()
    width, count = max(1, sizes["w"], asked["w"]), max(1, min(p.ranges, -(-sizes["n"] // p.block)))
    edges = c.agg(F.percentile_approx("norm", F.array(*(F.lit(k / count) for k in range(1, count))), 1000).alias("e")).head()["e"] if count > 1 else []
    edges = sorted(set(edges or []))
    # Range 0 holds the longest vectors.
    c = c.withColumn("range", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e > F.col("norm"))) if edges else F.lit(0))
    found = {r["range"]: r for r in c.groupBy("range").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()}  # a row per range
    subs = [max(1, -(-found[r]["n"] // p.block)) if r in found else 1 for r in range(len(edges) + 1)]

    def pick(values: list, at: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), at)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            i = s = v = np.zeros(0, np.int64)
            q1 = q2 = i
        else:
            floor = b.column("floor").to_numpy()
            i, s, v = search_block(b.column("vec_id").to_numpy(), matrix(b, "v", width), a.column("vec_id").to_numpy(), matrix(a, "v", width), p, floor)
            q1, q2 = b.column("q1").to_numpy()[i], b.column("q2").to_numpy()[i]
            i = b.column("vec_id").to_numpy()[i]
        return pa.table({"query_id": pa.array(i, pa.int64()), "q1": pa.array(q1, pa.int64()), "q2": pa.array(q2, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

    def meetings(rows: DataFrame, named: DataFrame, counts: dict[int, int]) -> DataFrame:
        """``rows`` of candidates against ``named`` (queries with range and floor); ``counts`` queries ask a range."""
        blocks = [-(-counts.get(r, 0) // p.query_block) for r in range(len(subs))]
        cut = lambda at, number: F.pmod(F.xxhash64("vec_id", "v", F.lit(at)), number).cast("int")
        each = lambda number: F.explode(F.sequence(F.lit(0), number - 1))
        left = rows.withColumn("blocks", pick(blocks, F.col("range"))).filter("blocks > 0").withColumn("cb", cut(0, pick(subs, F.col("range"))))
        left = left.select("vec_id", "v", "range", "cb", each(F.col("blocks")).alias("qb"))
        right = named.withColumn("qb", cut(7, pick(blocks, F.col("range")))).withColumn("cb", each(pick(subs, F.col("range"))))
        at = ("range", "cb", "qb")
        met = left.groupBy(*at).cogroup(right.select("vec_id", "q1", "q2", "v", "floor", *at).groupBy(*at)).applyInArrow(meet, "query_id long, q1 long, q2 long, vec_id long, score long")
        order = Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.k)

    least = np.iinfo(np.int64).min
    best = meetings(c.filter("range = 0"), q.withColumn("range", F.lit(0)).withColumn("floor", F.lit(least)), {0: asked["m"]})
    if len(subs) > 1:
        best = stage(spark, best.drop("rank"), "topk-first")
        bars = best.groupBy("query_id", "q1", "q2").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == p.k)
        known = q.join(bars.select(F.col("query_id").alias("vec_id"), "q1", "q2", "s"), ["vec_id", "q1", "q2"], "left").withColumn("floor", F.coalesce("s", F.lit(least)))
        ends = F.array(*(F.struct(F.lit(r).alias("range"), F.lit(float(found[r]["most"])).alias("most")) for r in range(1, len(subs)) if r in found))
        # A hair's breadth for the rounding of lengths.
        may = F.filter(ends, lambda e: (F.col("floor") <= 0) | (e["most"] * F.col("norm") * (1 + 1e-9) >= F.col("floor")))
        sent = stage(spark, known.select("vec_id", "q1", "q2", "v", "floor", F.explode(may).alias("e")).select("vec_id", "q1", "q2", "v", "floor", "e.range"), "topk-sent")
        counts = {r["range"]: r["n"] for r in sent.groupBy("range").agg(F.count("*").alias("n")).collect()}  # a row per range
        further = meetings(c.filter("range > 0"), sent, counts).drop("rank")
        order = Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "vec_id")
        best = best.unionByName(further).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.k)
    told = best.join(q.select(F.col("vec_id").alias("query_id"), "q1", "q2", "copies"), ["query_id", "q1", "q2"])
    return told.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


#: The whole result in DuckDB's SQL.
TOPK_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
