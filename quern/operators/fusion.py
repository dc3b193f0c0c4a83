"""Rank fusion: reciprocal ranks over any number of streams, and blending with a second score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_streams(candidates: DataFrame, tenant: str | None = None, depth: int | None = None) -> DataFrame:
    """``rank`` by falling score within each stream, ties by position, after the tenant filter (null-safe).

    With a ``depth``, ranks beyond it go, and every task drops them before a
    stream's rows meet, so a long stream costs its depth.
    """
    rows = candidates.filter(F.col("tenant_id").eqNullSafe(F.lit(tenant))) if "tenant_id" in candidates.columns else candidates
    order = Window.partitionBy("stream").orderBy(F.desc("score"), "pos")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= depth) if depth is not None else ranked


def rrf(ranked: DataFrame, k: float = 60.0, top: int | None = 10) -> DataFrame:
    """id, rrf_score, lineage (stream to its last rank), first_seen, and metadata where given.

    ``ranked`` has stream, stream_ord, id, rank. An id that a stream holds twice
    counts twice and keeps the later rank; the first non-empty metadata in order
    of stream and rank stays. One shuffle by id, partial sums before it.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    by_stream = [F.sum(1.0 / (k + F.col("rank"))).alias("part"), F.max("rank").alias("rank"), F.min(F.struct("stream_ord", "rank")).alias("seen")]
    if "metadata" in ranked.columns:
        full = F.size("metadata") > 0
        by_stream.append(F.min(F.when(full, F.struct("stream_ord", "rank"))).alias("at"))
        by_stream.append(F.min_by(F.when(full, F.col("metadata")), F.when(full, F.struct("stream_ord", "rank"))).alias("metadata"))
    parts = ranked.groupBy("id", "stream").agg(*by_stream)
    total = [F.sum("part").alias("rrf_score"), F.map_from_entries(F.collect_list(F.struct("stream", "rank"))).alias("lineage"), F.min("seen").alias("first_seen")]
    if "metadata" in ranked.columns:
        total.append(F.coalesce(F.min_by("metadata", "at"), F.create_map().cast("map<string,string>")).alias("metadata"))
    out = parts.groupBy("id").agg(*total)  # a row per stream at most within an id
    return out.orderBy(F.desc("rrf_score"), "first_seen").limit(top) if top is not None else out


def rrf_lists(lists: DataFrame, k: float = 60.0, top: int | None = 5) -> DataFrame:
    """Fusion of lists that are ranked already: ``lists`` has list_ord, ids (array of struct with id). The last item of an id wins."""
    rows = lists.select("list_ord", F.posexplode("items").alias("pos", "item"))
    fused = rows.groupBy("item.id").agg(F.sum(1.0 / (k + F.col("pos") + 1)).alias("rrf_score"), F.max_by("item", F.struct("list_ord", "pos")).alias("item"), F.min(F.struct("list_ord", "pos")).alias("first_seen"))
    return fused.orderBy(F.desc("rrf_score"), "first_seen").limit(top) if top is not None else fused


def blend(fused: DataFrame, cross: DataFrame | None, alpha: float = 0.5, top: int = 10, tenant: str | None = None) -> DataFrame:
    """id, tenant_id, score, rrf_score: alpha * scaled fusion + (1 - alpha) * scaled cross score (missing: -100).

    Without cross scores, or with an empty table of them, the score is the raw
    fusion. A range below a millionth scales to 0. The ranges come from one
    aggregate over the fused rows, joined back as a row, so no window gathers all
    rows in a task.
    """
    raw = fused.select("id", F.col("rrf_score").alias("score"), "rrf_score")
    if cross is not None and not cross.isEmpty():
        both = fused.join(cross.select("id", F.col("score").alias("ce")), "id", "left").withColumn("ce", F.coalesce("ce", F.lit(-100.0)))
        ends = both.agg(F.min("rrf_score").alias("r0"), F.max("rrf_score").alias("r1"), F.min("ce").alias("c0"), F.max("ce").alias("c1")).head()
        if ends["r0"] is not None:

            def scaled(col: str, low: float, high: float):
                return F.lit(0.0) if high - low < 1e-6 else (F.col(col) - low) / (high - low)

            score = alpha * scaled("rrf_score", ends["r0"], ends["r1"]) + (1 - alpha) * scaled("ce", ends["c0"], ends["c1"])
            raw = both.select("id", score.alias("score"), "rrf_score")
    best = raw.orderBy(F.desc("score"), "id").limit(top)
    return best.select("id", F.lit(tenant).cast("string").alias("tenant_id"), "score", "rrf_score")


def re_rank_and_blend(tenant: str, sparse: DataFrame, dense: DataFrame, cross: DataFrame | None = None, top: int = 10, alpha: float = 0.5, k: float = 60.0, depth: int | None = None) -> DataFrame:
    """Both streams (id, tenant_id, score, pos) cut to the tenant, ranked, fused and blended."""
    parts = [df.select("id", "tenant_id", "score", "pos").withColumn("stream", F.lit(name)).withColumn("stream_ord", F.lit(n)) for n, (name, df) in enumerate((("sparse", sparse), ("dense", dense)))]
    return blend(rrf(ranked_streams(parts[0].unionByName(parts[1]), tenant, depth), k, None), cross, alpha, top, tenant)


def hybrid(dense: DataFrame, sparse: DataFrame, alpha: float = 0.7) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse over the union of ids; a missing side counts 0. One shuffle by id."""
    rows = dense.select("id", (alpha * F.col("score")).alias("part")).unionByName(sparse.select("id", ((1 - alpha) * F.col("score")).alias("part")))
    return rows.groupBy("id").agg(F.sum("part").alias("score"))
