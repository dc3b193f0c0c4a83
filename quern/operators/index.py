"""Inverted-file index: every vector belongs to the list of its nearest centroid, a search probes a few lists.

Centroids are fitted on a bounded sample (the ``sample_rows`` rows with the
smallest hash of their id); every row is indexed. Results are approximate:
``recall`` compares them with an exact search, and more probes raise it. Vectors that
are null, empty, longer than the centroids or hold no numbers are not indexed and find nothing.

``exact`` finds what an exact search finds, by the triangle inequality on angles: a list
whose nearest possible member cannot reach a query's k-th best score is not probed for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import normalized
from quern.operators.search import nearest, rows_of, type_of, usable
from quern.session import ship, stage


def fit_centroids(vectors: DataFrame, lists: int = 64, sample_rows: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Unit centroids by spherical k-means on the sample; ``vectors`` has id and vector."""
    sample = vectors.filter(usable(F.col("vector"))).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select(normalized(F.col("vector")).alias("v")).toArrow()  # sample_rows rows
    x = rows_of(sample.column("v"), max([len(v) for v in sample.column("v").to_pylist()], default=1))
    if not len(x):
        return np.zeros((0, 1))
    centers = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        nearest = (x @ centers.T).argmax(1)
        for k in range(len(centers)):
            if (own := nearest == k).any():
                total = x[own].sum(0)
                centers[k] = total / max(np.sqrt((total * total).sum()), 1e-12)
    return centers


def _lists_of(df: DataFrame, centers: np.ndarray, name: str, choose, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (``name``, vector, ``keep``) with its unit vector as ``v`` and, of each row, the numbers of lists that ``choose`` marks in order.

    ``choose`` takes the cosines of a batch to all centroids (rows x lists) and the
    batch, and gives for each row the lists' order and how many of them count.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(centers)  # lists x dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = rows_of(b.column(1), shared.value.shape[1]) @ shared.value.T
            order, counts = choose(near, b)
            taken = np.arange(order.shape[1])[None, :] < np.asarray(counts)[:, None]
            offsets = np.concatenate([[0], np.cumsum(taken.sum(1))]).astype(np.int32)
            flat = order[taken].astype(np.int32)
            cosines = np.take_along_axis(near, order, 1)[taken]
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (flat, cosines)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], [name, "v", *keep, "lists", "cosines"])

    fits = usable(F.col("vector")) & (F.size("vector") <= centers.shape[1])
    kept = "".join(f", {c} {type_of(df, c)}" for c in keep)
    return df.filter(fits).select(name, normalized(F.col("vector")).alias("v"), *keep).mapInArrow(run, f"{name} {type_of(df, name)}, v array<double>{kept}, lists array<int>, cosines array<double>")


def _nearest(count: int):
    return lambda near, b: (np.argsort(-near, axis=1, kind="stable"), np.full(len(near), count))


def build(vectors: DataFrame, centers: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, v, list, near (cosine to the list's centroid) and ``keep`` of every row; write it partitioned by ``list`` to let a search prune."""
    if not len(centers):
        return vectors.limit(0).select("id", F.array().cast("array<double>").alias("v"), F.lit(0).alias("list"), F.lit(0.0).alias("near"), *keep)
    return _lists_of(vectors, centers, "id", _nearest(1), keep).select("id", "v", F.col("lists")[0].alias("list"), F.col("cosines")[0].alias("near"), *keep)


def _met(asked: DataFrame, index: DataFrame, centers: np.ndarray, k: int, block: int, query_block: int = 16_384) -> DataFrame:
    """query_id, id, score: the best k of every probed list for ``asked`` (query_id, v, list), which is read twice. Long lists, and many queries of one list, are dealt into blocks of bounded size."""
    counts = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row per list
    parts = [-(-counts.get(x, 0) // block) for x in range(len(centers))]
    pieces = F.get(F.array(*map(F.lit, parts or [0])), F.col("list"))
    shares = -(-(asked.groupBy("list").count().agg(F.max("count")).head()[0] or 1) // query_block)
    left = index.select("id", "v", "list", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")).withColumn("piece", F.pmod(F.xxhash64("id"), F.greatest(pieces, F.lit(1))).cast("int"))
    right = asked.filter(pieces > 0).select("query_id", "v", "list", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int").alias("share"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], []]
        if a.num_rows and b.num_rows:
            ids = a.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            best, scores = nearest(rows_of(b.column("v"), centers.shape[1]), rows_of(a.column("v"), centers.shape[1])[order], k)
            out = [np.repeat(b.column("query_id").to_numpy(), best.shape[1]), ids[order][best].ravel(), scores.ravel()]
        return pa.table({"query_id": pa.array(out[0], b.schema.field("query_id").type), "id": pa.array(out[1], a.schema.field("id").type), "score": pa.array(out[2], pa.float64())})

    return left.groupBy("list", "piece", "share").cogroup(right.groupBy("list", "piece", "share")).applyInArrow(meet, f"query_id {type_of(asked, 'query_id')}, id {type_of(index, 'id')}, score double")


def _ranked(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def probe(queries: DataFrame, index: DataFrame, centers: np.ndarray, k: int = 10, probes: int = 8, block: int = 16_384) -> DataFrame:
    """query_id, id, score, rank: the best k of the probed lists."""
    asked = _lists_of(queries, centers, "query_id", _nearest(probes)).select("query_id", "v", F.explode("lists").alias("list"))
    return _ranked(_met(stage(queries.sparkSession, asked, "index-asked"), index, centers, k, block), k)


def exact(queries: DataFrame, index: DataFrame, centers: np.ndarray, k: int = 10, probes: int = 4, block: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """query_id, id, score, rank: the best k of all of ``index``, and the lists that were probed (query_id, list).

    The ``probes`` nearest lists of a query give a first k-th best score; a list
    whose centroid is at angle t and whose farthest member is at angle r from the
    centroid holds nothing nearer than t - r, and is probed only if that can
    reach the score. ``index`` may be a part of a built one, as a filter leaves it.
    """
    spark = queries.sparkSession
    if not len(centers):
        none = queries.join(index.select("id"), F.lit(False))
        return none.select("query_id", "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")), none.select("query_id", F.lit(0).alias("list"))
    radius = np.full(len(centers), -np.inf)  # of an empty list: nothing is there
    for r in index.groupBy("list").agg(F.min("near").alias("near")).collect():  # a row per list
        radius[r["list"]] = np.arccos(np.clip(r["near"], -1, 1))

    def bounds(near: np.ndarray) -> np.ndarray:
        gap = np.arccos(np.clip(near, -1, 1)) - radius
        return np.where(radius == -np.inf, -np.inf, np.cos(np.clip(gap, 0, np.pi)))

    first = _lists_of(queries, centers, "query_id", lambda near, b: (np.argsort(-bounds(near), axis=1, kind="stable"), np.full(len(near), probes)))
    first = stage(spark, first.select("query_id", "v", F.explode("lists").alias("list")), "index-first")
    found = stage(spark, _ranked(_met(first, index, centers, k, block), k), "index-found")
    least = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))

    def reaching(near: np.ndarray, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        best, bar = bounds(near), b.column(2).to_numpy(zero_copy_only=False)
        return np.argsort(-best, axis=1, kind="stable"), (best >= bar[:, None] - 1e-7).sum(1)

    with_least = queries.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    more = _lists_of(with_least, centers, "query_id", reaching, ("least",)).select("query_id", "v", F.explode("lists").alias("list")).join(first.select("query_id", "list"), ["query_id", "list"], "left_anti")
    more = stage(spark, more, "index-more")
    both = found.select("query_id", "id", "score").unionByName(_met(more, index, centers, k, block))
    return _ranked(both, k), first.select("query_id", "list").unionByName(more.select("query_id", "list"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact results that were found."""
    hit = exact.join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).head()[0]
