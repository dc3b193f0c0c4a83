"""The registered queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import rl
from quern.functions.machines import Backlog, Breaker, CallWrapper, MicroBatcher, Router, TokenBucket, WaitingBucket, WorkerBatcher
from quern.functions.vectors import cosine, literal
from quern.operators import agents, fusion, graph_index, graphs, index, learning, payloads, postings, resilience, search, telemetry, text
from quern.session import keep, shared_dir
from quern.sources.stores import mock_embeddings, streams_of
from quern.streaming.processors import answered, attempts, latest_results, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a tenant, roles and a payload derived from their numbers."""
    df = table(spark, sf_dir, "embeddings")
    roles = F.when(F.col("vec_id") % 3 == 1, F.array(F.lit("analyst"))).when(F.col("vec_id") % 3 == 2, F.array(F.lit("admin"), F.lit("ops"))).otherwise(F.array().cast("array<string>"))
    payload = F.create_map(F.lit("category"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd"))
    return df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", F.concat(F.lit("T"), (F.col("label") % 4).cast("string")).alias("tenant_id"), roles.alias("allowed_roles"), payload.alias("payload"))


def vector_of(spark: SparkSession, sf_dir: str, number: int) -> list[float]:
    """One query vector: a row of fixed size."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == number).head()["embedding"]]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select("event_id", "user_id", "event_type", "value", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


_V = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS nrm FROM v),
q AS (SELECT e AS qe, nrm AS qn FROM n WHERE vec_id = 0),
s AS (SELECT n.*, list_dot_product(e, qe) / (nrm * qn) AS score FROM n CROSS JOIN q)"""
_E = "e AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {k} ORDER BY ts, event_id) AS rn FROM events)"


# Vector search -------------------------------------------------------------------------------------------------


@query(f"WITH {_V} SELECT vec_id, round(score, 6) AS score FROM s WHERE label % 4 = 2 AND vec_id % 3 IN (0, 1) ORDER BY s.score DESC, vec_id LIMIT 10")
def vector_topk_rbac(spark: SparkSession, d: str) -> DataFrame:
    found = search.search(vectors(spark, d), vector_of(spark, d, 0), search.visible("T2", ["analyst"]), 10)
    return found.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_V} SELECT vec_id, round(score, 6) AS score FROM s WHERE label % 2 = 0 ORDER BY s.score DESC, vec_id LIMIT 5")
def vector_topk_payload(spark: SparkSession, d: str) -> DataFrame:
    found = search.search(vectors(spark, d), vector_of(spark, d, 0), search.payload_matches({"category": "even"}), 5)
    return found.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_V} SELECT vec_id, round(score, 6) AS score FROM s WHERE label % 2 = 1 ORDER BY s.score DESC, vec_id LIMIT 5")
def vector_topk_null_filter(spark: SparkSession, d: str) -> DataFrame:
    """A filter value of None matches the key that no row has."""
    found = search.search(vectors(spark, d), vector_of(spark, d, 0), search.payload_matches({"category": "odd", "absent": None}), 5)
    return found.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS nrm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) / (q.nrm * c.nrm) AS score FROM n q CROSS JOIN n c WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 3"""
)
def vector_topk_multi(spark: SparkSession, d: str) -> DataFrame:
    all_ = vectors(spark, d).select("id", "vector")
    asked = all_.filter(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")
    found = search.search_many(asked, all_, 3)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(ORACLE_SQL["vector_topk_multi"].replace("q.vec_id AS query_id, c.vec_id AS vec_id", "'q' || q.vec_id AS query_id, 'v' || c.vec_id AS vec_id"))
def vector_topk_named(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are strings."""
    named = lambda letter, name: F.concat(F.lit(letter), F.col("id").cast("string")).alias(name)
    all_ = vectors(spark, d)
    found = search.search_many(all_.filter("id % 20 = 0").select(named("q", "query_id"), "vector"), all_.select(named("v", "id"), "vector"), 3)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT user_id, event_id, event_type, value, first_seq FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS first_seq FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def vector_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return search.upsert_latest(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type", "value", "first_seq")


@query("SELECT 'T' || (label % 4) AS tenant_id, count(*) AS n, count(*) FILTER (len(embedding) = 64) AS n_valid FROM embeddings GROUP BY 1")
def store_size(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).groupBy("tenant_id").agg(F.count("*").alias("n"), F.count_if(F.size("vector") == 64).alias("n_valid"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS nrm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) / (q.nrm * c.nrm) AS score FROM n q CROSS JOIN n c WHERE q.vec_id % 2 = 1 AND c.vec_id % 2 = 0)
SELECT query_id, vec_id, round(1 - score, 6) AS distance, 1 - score <= 0.66 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS r FROM s) WHERE r = 1"""
)
def semantic_cache(spark: SparkSession, d: str) -> DataFrame:
    all_ = vectors(spark, d).select("id", "vector")
    found = search.semantic_cache(all_.filter("id % 2 = 1").withColumnRenamed("id", "query_id"), all_.filter("id % 2 = 0"), 0.66)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "hit")


@query()
def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """Approximate neighbours through the inverted-file index; a test measures recall against the exact search."""
    all_ = vectors(spark, d).select("id", "vector")
    centers = index.fit_centroids(all_, 16)
    asked = all_.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    found = index.probe(asked, index.build(all_, centers), centers, 5, 12)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(ORACLE_SQL["vector_topk_multi"].replace("rank <= 3", "rank <= 5"))
def ann_topk_all_lists(spark: SparkSession, d: str) -> DataFrame:
    """The index with every list probed, which is exact."""
    all_ = vectors(spark, d).select("id", "vector")
    centers = index.fit_centroids(all_, 16)
    found = index.probe(all_.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), index.build(all_, centers), centers, 5, 16)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(ORACLE_SQL["vector_topk_multi"].replace("rank <= 3", "rank <= 5"))
def ann_topk_exact(spark: SparkSession, d: str) -> DataFrame:
    """The index probed as far as its lists can hold something near enough."""
    all_ = vectors(spark, d).select("id", "vector")
    centers = index.fit_centroids(all_, 16)
    found, _ = index.exact(all_.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), index.build(all_, centers), centers, 5)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(ORACLE_SQL["vector_topk_multi"].replace("rank <= 3", "rank <= 5"))
def hnsw_full_beam(spark: SparkSession, d: str) -> DataFrame:
    """The layered graph with a beam as wide as a shard, which is exact."""
    all_ = vectors(spark, d).select("id", "vector")
    graph = graph_index.build(all_, shard_rows=1024)
    found = graph_index.search(all_.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), graph, 5, beam=100_000)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query()
def hnsw_topk(spark: SparkSession, d: str) -> DataFrame:
    """Approximate neighbours through the layered graph; a test measures recall against the exact search."""
    all_ = vectors(spark, d).select("id", "vector")
    found = graph_index.search(all_.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), graph_index.build(all_), 5, beam=96)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_FILTERED = ORACLE_SQL["vector_topk_multi"].replace("SELECT vec_id, list_transform", "SELECT vec_id, label, list_transform").replace("q.vec_id % 20 = 0", "q.vec_id % 20 = 0 AND c.label % 4 = 2 AND c.vec_id % 3 IN (0, 1)")


def _payload_search(spark: SparkSession, d: str, way: str) -> DataFrame:
    """Rows of one tenant that an analyst may see, nearest to every twentieth vector."""
    all_ = vectors(spark, d)
    folder = f"{shared_dir(spark)}/payloads-{uuid.uuid4().hex}"
    keep(spark, folder)
    built = payloads.build(all_, {"tenant": F.col("tenant_id"), "role": F.col("allowed_roles"), "category": F.col("payload")["category"]}, folder, 16)
    asked = all_.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    found, _ = payloads.search(built, asked, {"tenant": "T2", "role": [None, "analyst"], "category": "even"}, 3, way=way)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(_FILTERED)
def payload_filter_first(spark: SparkSession, d: str) -> DataFrame:
    return _payload_search(spark, d, "filter")


@query(_FILTERED)
def payload_index_first(spark: SparkSession, d: str) -> DataFrame:
    return _payload_search(spark, d, "index")


_CACHE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS nrm FROM v),
s AS (SELECT q.vec_id AS query_id, c.label, c.vec_id, list_dot_product(q.e, c.e) / (q.nrm * c.nrm) AS score FROM n q CROSS JOIN n c WHERE q.vec_id % 2 = 1 AND c.vec_id % 2 = 0),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) = 1)"""


@query(f"WITH {_CACHE} SELECT query_id, 1 - score <= 0.66 AS hit, CASE WHEN 1 - score <= 0.66 THEN 'label ' || label ELSE 'computed ' || query_id END AS value, 1 - score > 0.66 AS added FROM b")
def cached_answers(spark: SparkSession, d: str) -> DataFrame:
    """Hits answered from the cache, misses computed and added to it."""
    all_ = vectors(spark, d)
    cache = all_.filter("id % 2 = 0").select("id", "vector", F.concat(F.lit("label "), F.col("label").cast("string")).alias("value"))
    probes = all_.filter("id % 2 = 1").select(F.col("id").alias("query_id"), "vector")
    answers, new = search.cached_answers(probes, cache, lambda rows: rows.withColumn("value", F.concat(F.lit("computed "), F.col("query_id").cast("string"))), 0.66)
    added = new.select(F.col("id").alias("query_id"), F.lit(True).alias("added"))
    return answers.join(added, "query_id", "left").select("query_id", "hit", "value", F.coalesce("added", F.lit(False)).alias("added"))


def _in_order(ttl: str) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, e, sqrt(list_dot_product(e, e)) AS nrm FROM v),
d AS (SELECT b.i, a.i AS j, round(1 - list_dot_product(a.e, b.e) / (a.nrm * b.nrm), 9) AS far FROM n a JOIN n b ON a.i < b.i WHERE 1 - list_dot_product(a.e, b.e) / (a.nrm * b.nrm) <= 0.66 AND {ttl}),
m AS (SELECT n.i, coalesce(list(d.j) FILTER (d.j IS NOT NULL), []) AS js FROM n LEFT JOIN d ON d.i = n.i GROUP BY n.i),
r(i, made) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT m.i, CASE WHEN list_has_any(made, js) THEN made ELSE list_append(made, m.i) END FROM r JOIN m ON m.i = r.i + 1),
l AS (SELECT unnest(made) AS i FROM r WHERE i = (SELECT max(i) FROM r)), b AS (SELECT d.i, min(far) AS far, arg_min(j, far * 1e6 + j * 1e-6) AS j FROM d JOIN l ON l.i = d.j GROUP BY d.i)
SELECT n.vec_id AS query_id, CASE WHEN l.i IS NULL THEN o.vec_id ELSE n.vec_id END AS leader, l.i IS NULL AS hit, CASE WHEN l.i IS NULL THEN round(b.far, 6) END AS distance FROM n LEFT JOIN l ON l.i = n.i LEFT JOIN b ON b.i = n.i LEFT JOIN n o ON o.i = b.j"""


def _cached_in_order(spark: SparkSession, d: str, ttl: float | None) -> DataFrame:
    probes = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("time"))
    return search.cache_in_order(probes, 0.66, ttl).select("query_id", "leader", "hit", F.round("distance", 6).alias("distance"))


@query(_in_order("true"))
def cache_in_order(spark: SparkSession, d: str) -> DataFrame:
    """A cache that all vectors go through in order: misses become entries, later ones hit them."""
    return _cached_in_order(spark, d, None)


@query(_in_order("b.vec_id - a.vec_id <= 100"))
def cache_with_lifetime(spark: SparkSession, d: str) -> DataFrame:
    """The same with entries that live for a time."""
    return _cached_in_order(spark, d, 100.0)


# Fusion --------------------------------------------------------------------------------------------------------


def two_streams(spark: SparkSession, d: str) -> DataFrame:
    """The 50 nearest of vectors 0 and 1, with metadata on every third row."""
    parts = {}
    for name, number in (("a", 0), ("b", 1)):
        near = search.search(vectors(spark, d), vector_of(spark, d, number), F.lit(True), 50)
        meta = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("stream"), F.lit(name))).otherwise(F.create_map().cast("map<string,string>"))
        parts[name] = near.select("id", F.round("score", 9).alias("score"), F.col("id").alias("pos"), meta.alias("metadata"), F.col("label"))
    return streams_of(**parts)


_STREAMS = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS nrm FROM v),
s AS (SELECT q.vec_id AS stream, n.vec_id, n.label, list_dot_product(n.e, q.e) / (n.nrm * q.nrm) AS score FROM n JOIN n q ON q.vec_id IN (0, 1)),
r0 AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY stream ORDER BY score DESC, vec_id) <= 50),
r AS (SELECT stream, vec_id, label, row_number() OVER (PARTITION BY stream ORDER BY round(score, 9) DESC, vec_id) AS rank FROM r0),
f AS (SELECT vec_id, any_value(label) AS label, sum(1.0 / (60 + rank)) AS rrf, max(rank) FILTER (stream = 0) AS rank_a, max(rank) FILTER (stream = 1) AS rank_b,
             min(stream * 1000 + rank) AS seen, CASE WHEN vec_id % 3 = 0 THEN CASE WHEN min(stream) = 0 THEN 'a' ELSE 'b' END END AS meta FROM r GROUP BY vec_id)"""


@query(f"WITH {_STREAMS} SELECT vec_id, round(rrf, 9) AS rrf_score, coalesce(rank_a, 0) AS rank_a, coalesce(rank_b, 0) AS rank_b, meta FROM f ORDER BY rrf DESC, seen LIMIT 10")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.rrf(fusion.ranked_streams(two_streams(spark, d), depth=50), 60.0, 10)
    rank = lambda s: F.coalesce(F.try_element_at("lineage", F.lit(s)), F.lit(0)).cast("long")
    return fused.select(F.col("id").alias("vec_id"), F.round("rrf_score", 9).alias("rrf_score"), rank("a").alias("rank_a"), rank("b").alias("rank_b"), F.try_element_at("metadata", F.lit("stream")).alias("meta"))


@query(
    """WITH l AS (SELECT conv_id AS list_ord, turn AS pos, role AS id, text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY list_ord ORDER BY pos) AS rank FROM l)
SELECT id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, arg_max(text, list_ord * 100000 + rank) AS text FROM r GROUP BY id"""
)
def rrf_lists_lastwins(spark: SparkSession, d: str) -> DataFrame:
    """Lists of conversation turns: the item is the role, its text the attribute of which the last wins."""
    turns = table(spark, d, "conversations")
    lists = turns.groupBy(F.col("conv_id").alias("list_ord")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("id"), x["text"].alias("text"))).alias("items"))
    return fusion.rrf_lists(lists, top=None).select("id", F.round("rrf_score", 9).alias("rrf_score"), F.col("item.text").alias("text"))


@query(
    f"""WITH {_STREAMS}, c AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN label / 10 ELSE -100.0 END AS ce FROM f),
m AS (SELECT min(rrf) AS r0, max(rrf) AS r1, min(ce) AS c0, max(ce) AS c1 FROM c)
SELECT vec_id, round(0.5 * (rrf - r0) / (r1 - r0) + 0.5 * (ce - c0) / (c1 - c0), 9) AS score FROM c CROSS JOIN m ORDER BY 0.5 * (rrf - r0) / (r1 - r0) + 0.5 * (ce - c0) / (c1 - c0) DESC, vec_id LIMIT 10"""
)
def blend_ce(spark: SparkSession, d: str) -> DataFrame:
    streams = two_streams(spark, d)
    fused = fusion.rrf(fusion.ranked_streams(streams.drop("metadata"), depth=50), 60.0, None)
    cross = streams.filter("id % 2 = 0").select("id", (F.col("label") / 10).alias("score")).distinct()
    return fusion.blend(fused, cross, 0.5, 10).select(F.col("id").alias("vec_id"), F.round("score", 9).alias("score"))


@query(f"WITH {_STREAMS} SELECT vec_id, round(rrf, 9) AS score FROM f ORDER BY rrf DESC, vec_id LIMIT 10")
def blend_raw(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.rrf(fusion.ranked_streams(two_streams(spark, d).drop("metadata"), depth=50), 60.0, None)
    return fusion.blend(fused, None).select(F.col("id").alias("vec_id"), F.round("score", 9).alias("score"))


@query(
    f"""WITH {_V}, s1 AS (SELECT s.*, 0 AS stream FROM s), s2 AS (SELECT n.*, list_dot_product(n.e, q.e) / (n.nrm * q.nrm) AS score, 1 AS stream FROM n JOIN n q ON q.vec_id = 1),
r AS (SELECT vec_id, label, stream, row_number() OVER (PARTITION BY stream ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (SELECT vec_id, label, score, stream FROM s1 UNION ALL SELECT vec_id, label, score, stream FROM s2) WHERE label % 4 = 2 QUALIFY rank <= 40),
f AS (SELECT vec_id, any_value(label) AS label, sum(1.0 / (60 + rank)) AS rrf FROM r GROUP BY vec_id), c AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN label / 10 + vec_id % 7 ELSE -100.0 END AS ce FROM f),
m AS (SELECT min(rrf) AS r0, max(rrf) AS r1, min(ce) AS c0, max(ce) AS c1 FROM c),
x AS (SELECT vec_id, rrf, 0.5 * (rrf - r0) / (r1 - r0) + 0.5 * (ce - c0) / (c1 - c0) AS score FROM c CROSS JOIN m)
SELECT vec_id, 'T2' AS tenant_id, round(score, 9) AS score, round(rrf, 9) AS rrf_score FROM x ORDER BY x.score DESC, vec_id LIMIT 10"""
)
def blend_tenant(spark: SparkSession, d: str) -> DataFrame:
    """Two streams of all tenants, cut to one tenant before ranks are given."""
    stream = lambda q: vectors(spark, d).select("id", "tenant_id", "label", F.round(cosine(F.col("vector"), literal(vector_of(spark, d, q))), 9).alias("score"), F.col("id").alias("pos"))
    cross = vectors(spark, d).filter("id % 2 = 0").select("id", (F.col("label") / 10 + F.col("id") % 7).alias("score"))
    found = fusion.re_rank_and_blend("T2", stream(0), stream(1), cross, 10, depth=40)
    return found.select(F.col("id").alias("vec_id"), "tenant_id", F.round("score", 9).alias("score"), F.round("rrf_score", 9).alias("rrf_score"))


@query(f"WITH {_STREAMS} SELECT vec_id, round(rrf, 9) AS score FROM f ORDER BY rrf DESC, vec_id LIMIT 10")
def blend_empty(spark: SparkSession, d: str) -> DataFrame:
    """An empty table of cross scores is none."""
    fused = fusion.rrf(fusion.ranked_streams(two_streams(spark, d).drop("metadata"), depth=50), 60.0, None)
    empty = fused.select("id", F.lit(0.0).alias("score")).limit(0)
    return fusion.blend(fused, empty).select(F.col("id").alias("vec_id"), F.round("score", 9).alias("score"))


@query(f"WITH {_STREAMS} SELECT DISTINCT vec_id FROM r")
def union_candidates(spark: SparkSession, d: str) -> DataFrame:
    return two_streams(spark, d).select(F.col("id").alias("vec_id")).distinct()


# Text ----------------------------------------------------------------------------------------------------------

_BM25 = """t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}]+'), lambda w: w <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS f1, len(list_filter(w, lambda x: x = 'que')) AS f2, len(list_filter(w, lambda x: x = 'der')) AS f3 FROM t),
st AS (SELECT count(*) AS n_docs, avg(n) AS mean, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2, count(*) FILTER (f3 > 0) AS d3 FROM c),
b AS (SELECT doc_id, ln(1 + (n_docs - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean))
  + ln(1 + (n_docs - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * n / mean))
  + ln(1 + (n_docs - d3 + 0.5) / (d3 + 0.5)) * f3 * 2.2 / (f3 + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM c CROSS JOIN st WHERE f1 + f2 + f3 > 0)"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY round(b.score, 9) DESC, doc_id LIMIT 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = text.bm25(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "The, que der!")
    return scored.orderBy(F.desc(F.round("score", 9)), "id").limit(10).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_BM25_MANY = """t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}]+'), lambda w: w <> '') AS w FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean FROM t),
tf AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS f FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t) GROUP BY doc_id, term),
idf AS (SELECT term, ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf CROSS JOIN st GROUP BY term),
q AS (SELECT DISTINCT doc_id AS query_id, unnest(list_filter(string_split_regex(lower(substr(text, 1, 40)), '[^\\p{L}]+'), lambda w: w <> '')) AS term FROM documents WHERE doc_id % 20 = 0),
b AS (SELECT query_id, doc_id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) CROSS JOIN st GROUP BY query_id, doc_id)"""


@query(f"WITH {_BM25_MANY} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b) WHERE rank <= 5")
def bm25_many(spark: SparkSession, d: str) -> DataFrame:
    """The first words of every twentieth document as queries, through the inverted index."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = docs.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.substring("text", 1, 40).alias("text"))
    built = postings.build(docs)
    folder = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    keep(spark, folder)
    built.save(folder)
    found, _ = postings.search(postings.load(spark, folder), asked, 5)
    return found.select("query_id", F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {_BM25}, k AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b QUALIFY rank <= 3)
SELECT 'the que der' AS query, count(*) AS n, md5(string_agg(d.text, chr(10) || '---' || chr(10) ORDER BY rank)) AS context_md5 FROM k JOIN documents d USING (doc_id)"""
)
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the best documents as one context, best first."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    best = text.bm25(docs, "the que der").orderBy(F.desc(F.round("score", 9)), "id").limit(3)
    hits = best.join(docs, "id").withColumn("query", F.lit("the que der"))
    return agents.context(hits.withColumn("order", F.struct(-F.round("score", 9), "id")), "query", "order", "text").select("query", "n", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query(
    f"""WITH {_V}, {_BM25}, u AS (SELECT vec_id AS id, 0.7 * score AS p FROM s UNION ALL SELECT doc_id, 0.3 * score FROM b)
SELECT id, round(sum(p), 6) AS score FROM u GROUP BY id"""
)
def hybrid_alpha(spark: SparkSession, d: str) -> DataFrame:
    q = vector_of(spark, d, 0)
    dense = vectors(spark, d).select("id", cosine(F.col("vector"), literal(q)).alias("score"))
    sparse = text.bm25(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "the que der")
    return fusion.hybrid(dense, sparse, 0.7).select("id", F.round("score", 6).alias("score"))


_HYBRID_BM25 = _BM25.replace("FROM documents)", "FROM documents JOIN embeddings ON vec_id = doc_id WHERE label % 2 = 0)", 1)


@query(
    f"""WITH {_V}, {_HYBRID_BM25}, u AS (SELECT vec_id AS id, 0.7 * score AS p FROM s JOIN documents ON doc_id = vec_id WHERE label % 2 = 0 UNION ALL SELECT doc_id, 0.3 * score FROM b),
g AS (SELECT id, sum(p) AS score FROM u GROUP BY id) SELECT id, round(score, 6) AS score FROM g ORDER BY round(g.score, 9) DESC, id LIMIT 10"""
)
def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Dense and sparse scores of the rows that a payload filter lets through."""
    rows = vectors(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    found = search.filtered_hybrid(rows, vector_of(spark, d, 0), "the que der", search.payload_matches({"category": "even"}), 0.7, 10)
    return found.orderBy(F.desc(F.round("score", 9)), "id").select("id", F.round("score", 6).alias("score"))


@query(
    """WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 51, 0) + 1, 150)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id, start // 150 AS chunk_no, start, length(substr(text, start + 1, 200)) AS n_chars, md5(substr(text, start + 1, 200)) AS chunk_md5 FROM c"""
)
def chunk_docs(spark: SparkSession, d: str) -> DataFrame:
    rows = text.chunks(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 200, 50)
    return rows.select(F.col("id").alias("doc_id"), F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start").cast("long").alias("start"), F.length("chunk").cast("long").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query(
    """WITH g AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g'), '[0-9]{13,19}', '[NUMBER]', 'g') AS masked,
  len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) + len(regexp_extract_all(text, '[0-9]{13,19}')) AS findings, text FROM documents)
SELECT doc_id, md5(masked) AS masked_md5, CAST(findings AS INTEGER) AS findings,
  CASE WHEN regexp_matches(text, '(?i)ignore (all )?(previous|prior) instructions') OR findings > 2 THEN 'REJECT' WHEN findings > 0 THEN 'MASK' ELSE 'PASS' END AS route FROM g"""
)
def guard_route(spark: SparkSession, d: str) -> DataFrame:
    rows = text.guard(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.md5(F.col("masked").cast("binary")).alias("masked_md5"), "findings", "route")


# Evaluation and agents -----------------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS claims, round(sum(quality) / count(*), 6) AS faithfulness FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("supported", F.col("quality") == 1)
    return agents.faithfulness(claims, "lang").select("lang", "claims", F.round("faithfulness", 6).alias("faithfulness"))


@query(f"WITH {_V} SELECT label, round(avg(score), 6) AS relevance FROM s GROUP BY label")
def answer_relevance(spark: SparkSession, d: str) -> DataFrame:
    score = cosine(F.col("vector"), literal(vector_of(spark, d, 0)))
    return vectors(spark, d).groupBy("label").agg(F.round(F.avg(score), 6).alias("relevance"))


@query(f"WITH {_V} SELECT vec_id, CASE WHEN (1 + round(score, 9)) / 2 < 0.55 THEN 'PAUSED' ELSE 'CONTINUE' END AS status FROM s")
def hitl_gate(spark: SparkSession, d: str) -> DataFrame:
    """Confidence is how near an answer's vector is to the question's."""
    near = F.round(cosine(F.col("vector"), literal(vector_of(spark, d, 0))), 9)
    return vectors(spark, d).select(F.col("id").alias("vec_id"), agents.paused((1 + near) / 2, 0.55).alias("status"))


@query("SELECT CAST(n AS INTEGER) AS adapters, CAST(140.0 * n AS DOUBLE) AS full_gb, CAST(140.0 + 0.2 * n AS DOUBLE) AS shared_gb FROM range(1, 51) t(n)")
def serving_memory(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    full, one = agents.serving_memory(140.0, n, 0.2)
    return spark.range(1, 51).select(n.cast("int").alias("adapters"), full.alias("full_gb"), one.alias("shared_gb"))


@query(
    """SELECT conv_id, coalesce(arg_max(length(text), turn) FILTER (role = 'user'), -1) AS user_chars, coalesce(arg_max(length(text), turn) FILTER (role = 'assistant'), -1) AS assistant_chars, max(turn) AS version
FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"""
)
def state_deltas(spark: SparkSession, d: str) -> DataFrame:
    said = lambda role: F.when(F.col("role") == role, F.length("text")).cast("long")
    deltas = table(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", said("user").alias("user_chars"), said("assistant").alias("assistant_chars"))
    return agents.latest_state(deltas, "conv_id", "turn", ["user_chars", "assistant_chars"]).fillna(-1, ["user_chars", "assistant_chars"])


@query(
    """WITH v AS (SELECT unnest([0, 1, 2, 4, 7]) AS turn), q AS (SELECT DISTINCT conv_id, v.turn FROM conversations CROSS JOIN v)
SELECT q.conv_id, q.turn, arg_max(length(text), c.turn) FILTER (role = 'user') AS user_chars, arg_max(length(text), c.turn) FILTER (role = 'assistant') AS assistant_chars
FROM q LEFT JOIN conversations c ON c.conv_id = q.conv_id AND c.turn <= q.turn AND c.text IS NOT NULL GROUP BY q.conv_id, q.turn"""
)
def state_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation's state at several of its versions."""
    turns = table(spark, d, "conversations")
    said = lambda role: F.when(F.col("role") == role, F.length("text")).cast("long")
    deltas = turns.select("conv_id", "turn", said("user").alias("user_chars"), said("assistant").alias("assistant_chars"))
    asked = turns.select("conv_id").distinct().select("conv_id", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 1, 2, 4, 7)))).alias("turn"))
    return agents.state_at(deltas, asked, "conv_id", "turn", ["user_chars", "assistant_chars"], width=2)


@query("SELECT CASE WHEN regexp_matches(text, '(?i)\\b(related|between|connect\\w*|path)\\b') THEN 'GRAPH' ELSE 'VECTOR' END AS path, count(*) AS n FROM conversations GROUP BY 1")
def intent_router(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy(agents.intent(F.col("text")).alias("path")).agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT DISTINCT conv_id, CAST(conv_id % 2 = 0 AS INT) + CAST(conv_id % 3 = 0 AS INT) AS n1, CAST(conv_id % 5 <> 0 AS INT) AS more FROM conversations),
l AS (SELECT conv_id, CASE WHEN least(1.0, n1 * 0.3) >= 0.85 THEN 1 WHEN least(1.0, (n1 + more) * 0.3) >= 0.85 THEN 2 ELSE 3 END AS loops, n1, more FROM c)
SELECT 'question ' || conv_id AS user_query, CAST(loops AS INTEGER) AS loops, CAST(n1 + (loops - 1) * more AS BIGINT) AS n_docs, CAST(least(1.0, (n1 + (loops - 1) * more) * 0.3) AS DOUBLE) AS sufficiency,
 printf('Synthesized response for ''question %d'' from %d context sources. Sufficiency reached: %.2f in %d loop(s).', conv_id, n1 + (loops - 1) * more, CAST(least(1.0, (n1 + (loops - 1) * more) * 0.3) AS DOUBLE), loops) AS synthesis FROM l"""
)
def agentic_loop(spark: SparkSession, d: str) -> DataFrame:
    """Which sub-queries find a document follows from the conversation's number."""
    asked = table(spark, d, "conversations").select(F.concat(F.lit("question "), F.col("conv_id").cast("string")).alias("user_query")).distinct()

    def fetch(rows: DataFrame) -> DataFrame:
        number = F.regexp_extract("user_query", r"(\d+)", 1).cast("long")
        first, second = F.col("sub_query").endswith(agents.FIRST_QUERIES[0]) & (number % 2 == 0), F.col("sub_query").endswith(agents.FIRST_QUERIES[1]) & (number % 3 == 0)
        return rows.filter(first | second | (F.col("sub_query").contains(agents.REFINEMENT) & (number % 5 != 0)))

    return agents.bounded_search(asked, fetch).select("user_query", "loops", "n_docs", F.round("sufficiency", 6).alias("sufficiency"), "synthesis")


_SUB_QUERIES = ", ".join([f"(1, '{x}')" for x in agents.FIRST_QUERIES] + [f"({k + 1}, '{agents.REFINEMENT}{k}')" for k in (1, 2)])


@query(
    f"""WITH {_BM25_MANY[: _BM25_MANY.index("q AS (")]} u AS (SELECT DISTINCT substr(text, 1, 40) AS user_query FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL),
s AS (SELECT user_query, loop, user_query || suffix AS sub_query FROM u CROSS JOIN (VALUES {_SUB_QUERIES}) x(loop, suffix)),
q AS (SELECT DISTINCT sub_query, unnest(list_filter(string_split_regex(lower(sub_query), '[^\\p{{L}}]+'), lambda w: w <> '')) AS term FROM s),
b AS (SELECT sub_query, doc_id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) CROSS JOIN st GROUP BY sub_query, doc_id),
k AS (SELECT sub_query, doc_id FROM b QUALIFY row_number() OVER (PARTITION BY sub_query ORDER BY round(score, 9) DESC, doc_id) = 1 AND round(score, 9) >= 8),
f AS (SELECT s.*, doc_id FROM s JOIN k USING (sub_query)), c AS (SELECT user_query, count(*) AS n FROM f WHERE loop <= 2 GROUP BY user_query)
SELECT f.user_query, CAST(f.loop AS INTEGER) AS loop, f.sub_query, f.doc_id FROM f LEFT JOIN c USING (user_query) WHERE f.loop < 3 OR coalesce(c.n, 0) < 3"""
)
def agentic_documents(spark: SparkSession, d: str) -> DataFrame:
    """Search loops over the documents themselves: each sub-query brings its best document, if that is good enough."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    folder = f"{shared_dir(spark)}/loop-postings-{uuid.uuid4().hex}"
    keep(spark, folder)
    postings.build(docs).save(folder)
    built = postings.load(spark, folder)
    asked = docs.filter("id % 20 = 0 and text is not null").select(F.substring("text", 1, 40).alias("user_query")).distinct()

    def fetch(rows: DataFrame) -> DataFrame:
        found, _ = postings.search(built, rows.select(F.col("sub_query").alias("query_id"), F.col("sub_query").alias("text")), 1)
        return rows.join(found.filter(F.round("score", 9) >= 8).select(F.col("query_id").alias("sub_query"), F.col("id").alias("doc_id")), "sub_query")

    _, gathered = agents.bounded_search(asked, fetch, documents=True)
    return gathered.select("user_query", "loop", "sub_query", "doc_id")


_EDGES = """e0 AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    link = lambda t, p, x, q, y: table(spark, d, t).select(F.concat(F.lit(p), F.col(x).cast("string")).alias("a"), F.concat(F.lit(q), F.col(y).cast("string")).alias("b"))
    return link("customer", "c", "c_custkey", "n", "c_nationkey").union(link("supplier", "s", "s_suppkey", "n", "s_nationkey")).union(link("nation", "n", "n_nationkey", "r", "n_regionkey"))


@query(
    f"""WITH RECURSIVE {_EDGES}, w(node, depth) AS (SELECT 'c1', 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < 3)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node"""
)
def graph_k_hop(spark: SparkSession, d: str) -> DataFrame:
    return agents.k_hop(edges(spark, d), spark.createDataFrame([("c1",)], "node string"), 3)


def _propagation(rounds: int) -> str:
    parts = [f"WITH {_EDGES}, l0 AS (SELECT DISTINCT a AS node, a AS community FROM e)"]
    for k in range(rounds):
        parts.append(f"l{k + 1} AS (SELECT node, community FROM (SELECT e.a AS node, l.community, count(*) AS n FROM e JOIN l{k} l ON l.node = e.b GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, community) = 1)")
    return ", ".join(parts) + f" SELECT node, community FROM l{rounds}"


@query(_propagation(3))
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    return agents.label_propagation(edges(spark, d), 3)


@query()
def graph_leiden(spark: SparkSession, d: str) -> DataFrame:
    """Communities by modularity; tests hold it against label propagation and brute force."""
    return graphs.leiden(edges(spark, d))


_TYPED = """e0 AS (SELECT 'c' || c_custkey AS a, 'lives' AS type, 'n' || c_nationkey AS b FROM customer UNION SELECT 's' || s_suppkey, 'sells', 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'part', 'r' || n_regionkey FROM nation),
e AS (SELECT a, type, b FROM e0 UNION SELECT b, type, a FROM e0)"""
_PATHS = f"""WITH RECURSIVE {_TYPED}, w(node, path, types) AS (SELECT a, [a], CAST([] AS VARCHAR[]) FROM e WHERE a IN ('c1', 'c2', 'c3') GROUP BY a
UNION ALL SELECT e.b, list_append(path, e.b), list_append(types, e.type) FROM w JOIN e ON e.a = w.node WHERE len(types) < {{most}} AND NOT list_contains(path, e.b))
SELECT array_to_string(path, '>') AS path, array_to_string(types, '>') AS types FROM w WHERE len(types) >= {{least}} AND {{where}}"""


def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    link = lambda t, p, x, kind, q, y: table(spark, d, t).select(F.concat(F.lit(p), F.col(x).cast("string")).alias("a"), F.lit(kind).alias("type"), F.concat(F.lit(q), F.col(y).cast("string")).alias("b"))
    return link("customer", "c", "c_custkey", "lives", "n", "c_nationkey").union(link("supplier", "s", "s_suppkey", "sells", "n", "s_nationkey")).union(link("nation", "n", "n_nationkey", "part", "r", "n_regionkey"))


def _told(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("nodes", ">").alias("path"), F.array_join("types", ">").alias("types"))


@query(_PATHS.format(most=3, least=2, where="true"))
def graph_paths(spark: SparkSession, d: str) -> DataFrame:
    """All paths of two or three edges, either way, from three customers."""
    start = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "node string")
    return _told(graphs.paths(typed_edges(spark, d), start, least=2, most=3, direction="any"))


@query(_PATHS.format(most=4, least=1, where="node LIKE 's%'"))
def graph_paths_between(spark: SparkSession, d: str) -> DataFrame:
    """All paths of at most four edges from three customers to any supplier, grown from the end with fewer edges."""
    start = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "node string")
    end = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return _told(graphs.paths(typed_edges(spark, d), start, end, most=4, direction="any"))


def _walked(steps: int) -> str:
    parts = ["p0 AS (SELECT query_id, node, 1.0 AS p FROM h)"]
    for k in range(steps):
        parts.append(f"p{k + 1} AS (SELECT query_id, node, sum(p) AS p FROM (SELECT query_id, g.b AS node, 0.85 * p / deg AS p FROM p{k} JOIN g ON g.a = p{k}.node UNION ALL SELECT query_id, node, 0.15 FROM h) GROUP BY 1, 2)")
    return ", ".join(parts)


@query(
    f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS nrm FROM v),
g0 AS (SELECT 'v' || vec_id AS a, 'l' || label AS b FROM v UNION ALL SELECT 'v' || vec_id, 't' || (vec_id % 7) FROM v), g1 AS (SELECT a, b FROM g0 UNION ALL SELECT b, a FROM g0),
g AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS deg FROM g1), h AS (SELECT vec_id AS query_id, 'l' || label AS node FROM v WHERE vec_id % 50 = 0), {_walked(3)},
s AS (SELECT 'graph' AS stream, query_id, CAST(substr(node, 2) AS BIGINT) AS id, p AS score FROM p3 WHERE node LIKE 'v%'
  UNION ALL SELECT 'vector', q.vec_id, c.vec_id, list_dot_product(q.e, c.e) / (q.nrm * c.nrm) FROM n q CROSS JOIN n c WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY stream, query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 20),
f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS rrf FROM r GROUP BY query_id, id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, id) AS rank FROM f QUALIFY rank <= 5)
SELECT query_id, count(*) AS n, md5(string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank)) AS context_md5 FROM k JOIN documents ON doc_id = id WHERE text IS NOT NULL GROUP BY query_id"""
)
def graph_vector_context(spark: SparkSession, d: str) -> DataFrame:
    """Graph path beside vector path: a walk from each question's entity, and its nearest vectors, fused, with the texts as context."""
    all_ = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    linked = all_.select(node("v", "id").alias("a"), node("l", "label").alias("b")).union(all_.select(node("v", "id").alias("a"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("b")))
    asked = all_.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    # Questions of one entity share its walk, and of each walk only what the fusion looks at goes to its questions.
    walked, walks = graphs.shared_walks(linked, asked.select("query_id", node("l", "label").alias("node")), 3)
    reached = walked.filter("node like 'v%'").select("walk", F.substring("node", 2, 20).cast("long").alias("id"), F.col("p").alias("score"))
    by_graph = graphs.best_of(reached, "walk", 20).join(walks, "walk").select("query_id", "id", "score")
    by_vector = search.search_many(asked.select("query_id", "vector"), all_.select("id", "vector"), 20).select("query_id", "id", "score")
    hits = graphs.fused_streams([by_graph, by_vector], 20, top=5).join(table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text"), "id")
    return agents.context(hits, "query_id", "rank", "text").select("query_id", "n", F.md5(F.col("context").cast("binary")).alias("context_md5"))


_LORA = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
t AS (SELECT vec_id, e, list_transform(range(1, 65), lambda i: i / 64) AS w1, list_transform(range(1, 65), lambda i: (i % 5) / 4) AS w2, list_transform(range(1, 65), lambda i: 0.5 - (i % 3) / 4) AS a FROM v)
SELECT vec_id, round(list_dot_product(e, w1) + 2.0 * list_dot_product(e, a), 6) AS h1, round(list_dot_product(e, w2) + 2.0 * 2 * list_dot_product(e, a), 6) AS h2 FROM t"""


@query(_LORA)
def lora_forward(spark: SparkSession, d: str) -> DataFrame:
    """Two outputs of all 64 components: W is 2 x 64, A 1 x 64, B 2 x 1."""
    rows = lambda m: F.array(*(literal(r) for r in m))
    w = [[i / 64 for i in range(1, 65)], [(i % 5) / 4 for i in range(1, 65)]]
    a = [[0.5 - (i % 3) / 4 for i in range(1, 65)]]
    h = agents.lora_forward(F.col("vector"), rows(w), rows(a), rows([[1], [2]]), 2.0, 1)
    return vectors(spark, d).select(F.col("id").alias("vec_id"), h.alias("h")).select("vec_id", F.round(F.col("h")[0], 6).alias("h1"), F.round(F.col("h")[1], 6).alias("h2"))


# Telemetry -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, round(CASE WHEN value * (event_id % 3) > 0 THEN (event_id % 200) / (value * (event_id % 3) / 1000) ELSE 0 END, 4) AS throughput_tps FROM events")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    tps = telemetry.throughput(F.col("event_id") % 200, F.lit(0.0), F.col("value") * (F.col("event_id") % 3))
    return table(spark, d, "events").select("event_id", F.round(tps, 4).alias("throughput_tps"))


@query("SELECT event_id, event_type, round(quantile_cont(value, 0.5) OVER w, 6) AS p50, round(quantile_cont(value, 0.99) OVER w, 6) AS p99 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)")
def rolling_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = telemetry.rolling_percentiles_split(events(spark, d), ["event_type"], "us", "event_id", "value", 1000)
    return rows.select("event_id", "event_type", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


@query(
    """SELECT event_id, 'llm_generation_metrics' AS event_type, 'T' || (user_id % 4) AS tenant_id, event_type AS model_variant, CAST(event_id % 50 AS BIGINT) AS prompt_tokens,
round(quantile_cont(value, 0.5) OVER w, 4) AS ttft_p50_ms FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"""
)
def payload_json(spark: SparkSession, d: str) -> DataFrame:
    """Fields read back from the exported JSON; the percentile is compared before its rounding."""
    n = F.col("event_id")
    rolled = telemetry.rolling_percentiles_split(events(spark, d), ["event_type"], "us", "event_id", "value", 100)
    rows = rolled.select(n, F.concat(F.lit("T"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"), F.col("event_type").alias("model_variant"), (F.col("us") / 1e6).alias("timestamp"), (n % 50).alias("prompt_tokens"), (n % 200).alias("completion_tokens"), F.col("value").alias("ttft_ms"), (F.col("value") * 2).alias("total_latency_ms"), "p50", "p99")
    rows = rows.withColumn("throughput_tps", telemetry.throughput(F.col("completion_tokens"), F.col("ttft_ms"), F.col("total_latency_ms")))
    get = lambda path: F.get_json_object("payload", path)
    coded = telemetry.payload(rows, "event_id", "p50")
    same = F.abs(get("$.metrics.ttft_p50_ms").cast("double") - F.col("p50")) <= 0.005000001
    return coded.select("event_id", get("$.event_type").alias("event_type"), get("$.tenant_id").alias("tenant_id"), get("$.model_variant").alias("model_variant"), get("$.metrics.prompt_tokens").cast("long").alias("prompt_tokens"), F.when(same, F.round("p50", 4)).alias("ttft_p50_ms"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 9) AS mean_value FROM events GROUP BY 1, 2")
def windowed_count(spark: SparkSession, d: str) -> DataFrame:
    rows = windowed_counts(table(spark, d, "events"), "ts", "event_type")
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean_value", 9).alias("mean_value"))


# Limits, breakers, batches -------------------------------------------------------------------------------------

_BUCKET = """WITH RECURSIVE {e}, k AS (SELECT *, {cap} AS cap, {rate} AS rate FROM e),
r AS (SELECT event_id, user_id, rn, us, CAST(cap - 1 AS DOUBLE) AS tok, TRUE AS allowed FROM k WHERE rn = 1
UNION ALL SELECT k.event_id, k.user_id, k.rn, k.us,
  CASE WHEN least(cap, r.tok + (k.us - r.us) / 1e6 * rate) >= 1 THEN least(cap, r.tok + (k.us - r.us) / 1e6 * rate) - 1 ELSE least(cap, r.tok + (k.us - r.us) / 1e6 * rate) END,
  least(cap, r.tok + (k.us - r.us) / 1e6 * rate) >= 1 FROM r JOIN k ON k.user_id = r.user_id AND k.rn = r.rn + 1)
SELECT event_id, user_id, round(tok, 6) AS tokens, allowed FROM r"""
_RATE = "(CAST(1 AS DOUBLE) / 36000)"


@query(_BUCKET.format(e=_E.format(k="user_id"), cap="CAST(3 AS DOUBLE)", rate=_RATE))
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    rows = resilience.token_bucket(events(spark, d), "user_id", ["ts", "event_id"], "us", TokenBucket(3.0, 1 / 36000))
    return rows.select("event_id", "user_id", F.round("tokens", 6).alias("tokens"), "allowed")


@query(_BUCKET.format(e=_E.format(k="user_id"), cap="CASE WHEN user_id % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(3 AS DOUBLE) END", rate=f"CASE WHEN user_id % 2 = 0 THEN CAST(1 AS DOUBLE) / 18000 ELSE {_RATE} END"))
def token_bucket_custom(spark: SparkSession, d: str) -> DataFrame:
    """Clients with even numbers have limits of their own."""
    calls = events(spark, d)
    limits = calls.filter("user_id % 2 = 0").select("user_id").distinct().select("user_id", F.lit(1.0).alias("capacity"), F.lit(1 / 18000).alias("rate"))
    rows = resilience.token_bucket(calls, "user_id", ["ts", "event_id"], "us", TokenBucket(3.0, 1 / 36000), limits)
    return rows.select("event_id", "user_id", F.round("tokens", 6).alias("tokens"), "allowed")


@query(
    f"""WITH RECURSIVE {_E.format(k="user_id")},
r AS (SELECT event_id, user_id, rn, us AS granted, CAST(2 AS DOUBLE) AS tok FROM e WHERE rn = 1
UNION ALL SELECT e.event_id, e.user_id, e.rn,
  greatest(e.us, r.granted) + CASE WHEN least(3.0::DOUBLE, r.tok + (greatest(e.us, r.granted) - r.granted) / 1e6 * {_RATE}) < 1 THEN CAST(trunc((1 - least(3.0::DOUBLE, r.tok + (greatest(e.us, r.granted) - r.granted) / 1e6 * {_RATE})) / {_RATE} * 1e6) AS BIGINT) ELSE 0 END,
  greatest(least(3.0::DOUBLE, r.tok + (greatest(e.us, r.granted) - r.granted) / 1e6 * {_RATE}), 1) - 1
FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, user_id, CAST(round(granted / 1e6) AS BIGINT) AS granted_s FROM r"""
)
def token_grant_time(spark: SparkSession, d: str) -> DataFrame:
    rows = resilience.grant_times(events(spark, d), "user_id", ["ts", "event_id"], "us", WaitingBucket(3.0, 1 / 36000))
    return rows.select("event_id", "user_id", F.round(F.col("granted_us") / 1e6).cast("long").alias("granted_s"))


def _breaker_sql(variant: int, fails: str = "event_type = 'error'", timeout: int = 86_400_000_000, threshold: int = 2, out: str = "") -> str:
    closed = "CLOSED" if variant == 3 else "HALF_OPEN"
    blocked = f"r.kind = 'OPEN' AND e.us - r.since {'<=' if variant == 2 else '<'} {timeout}"
    trips = f"r.failures + 1 >= {threshold}" + (f" OR (CASE WHEN r.kind = 'OPEN' THEN '{closed}' ELSE r.kind END) = 'HALF_OPEN'" if variant == 1 else "")
    stays = f"CASE WHEN r.kind = 'OPEN' THEN '{closed}' ELSE r.kind END"
    return f"""WITH RECURSIVE {_E.format(k="user_id")},
r AS (SELECT event_id, user_id, rn, TRUE AS allowed, 'CLOSED' AS kind, CASE WHEN {fails} THEN 1 ELSE 0 END AS failures, CAST(0 AS BIGINT) AS since FROM e WHERE rn = 1
UNION ALL SELECT e.event_id, e.user_id, e.rn, NOT ({blocked}),
  CASE WHEN {blocked} THEN r.kind WHEN NOT (e.{fails}) THEN 'CLOSED' WHEN {trips} THEN 'OPEN' ELSE {stays} END,
  CASE WHEN {blocked} THEN r.failures WHEN NOT (e.{fails}) THEN 0 ELSE r.failures + 1 END,
  CASE WHEN {blocked} OR NOT (e.{fails}) OR NOT ({trips}) THEN r.since ELSE e.us END
FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
{out or "SELECT event_id, allowed, kind AS state, CAST(failures AS BIGINT) AS failures FROM r"}"""


def _breaker(variant: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        calls = events(spark, d).withColumn("ok", F.col("event_type") != "error")
        return resilience.breaker(calls, "user_id", ["ts", "event_id"], "us", "ok", Breaker(variant, 2, 86_400_000_000)).select("event_id", "allowed", "state", "failures")

    run.__name__ = f"breaker_v{variant}"
    return run


for _variant in (1, 2, 3):
    query(_breaker_sql(_variant))(_breaker(_variant))


_CALL = """SELECT event_id, CASE WHEN allowed AND event_id % 6 <= 3 THEN 'OK' WHEN event_id % 2 = 0 THEN 'FALLBACK' WHEN allowed THEN 'FAILED' ELSE 'OPEN' END AS outcome,
CASE WHEN NOT allowed THEN 0 WHEN event_id % 6 <= 3 THEN event_id % 6 + 1 ELSE 4 END AS attempts, kind AS state, CAST(failures AS BIGINT) AS failures FROM r"""


@query(_breaker_sql(1, "event_id % 6 > 3", out=_CALL))
def call_wrapper(spark: SparkSession, d: str) -> DataFrame:
    """The event's number says which attempt succeeds (from 1 to 6, of 4) and whether there is a fallback."""
    n = F.col("event_id")
    calls = events(spark, d).select("event_id", "user_id", "ts", "us", (n % 6 + 1).alias("ok_at"), (n % 2 == 0).alias("fallback"))
    rows = resilience.wrapped_calls(calls, "user_id", ["ts", "event_id"], "us", "us", "ok_at", "fallback", CallWrapper(Breaker(1, 2, 86_400_000_000), 4))
    return rows.select("event_id", "outcome", "attempts", "state", "failures")


def _routed_sql(timeout: int, threshold: int) -> str:
    """Three breakers of the second variant beside each other, one row per request."""
    names = {"v": "event_id % 3 = 0", "p": "event_id % 4 = 0", "f": "event_id % 7 = 0"}
    blocked = {k: f"(r.{k}k = 'OPEN' AND e.us - r.{k}s <= {timeout})" for k in names}
    code = "(e.event_type = 'purchase')"
    ok = {k: f"(NOT (e.{x}))" for k, x in names.items()}
    tried = {"v": f"({code} AND NOT {blocked['v']})"}
    won_v = f"({tried['v']} AND {ok['v']})"
    tried["p"] = f"(NOT {blocked['p']} AND NOT {won_v})"
    won_p = f"({tried['p']} AND {ok['p']})"
    tried["f"] = f"(NOT {code} AND NOT {blocked['f']} AND NOT {won_p})"
    won_f = f"({tried['f']} AND {ok['f']})"
    new = []
    for k in names:
        trips = f"r.{k}n + 1 >= {threshold}"
        new.append(f"CASE WHEN NOT {tried[k]} THEN r.{k}k WHEN {ok[k]} THEN 'CLOSED' WHEN {trips} THEN 'OPEN' WHEN r.{k}k = 'OPEN' THEN 'HALF_OPEN' ELSE r.{k}k END")
        new.append(f"CASE WHEN NOT {tried[k]} THEN r.{k}n WHEN {ok[k]} THEN 0 ELSE r.{k}n + 1 END")
        new.append(f"CASE WHEN {tried[k]} AND NOT {ok[k]} AND {trips} THEN e.us ELSE r.{k}s END")
    provider = f"CASE WHEN {won_v} THEN 'vllm_local' WHEN {won_p} THEN 'saas_primary' WHEN {won_f} THEN 'saas_fallback' END"
    tries = " + ".join(f"CAST({tried[k]} AS INTEGER)" for k in names)
    start = ", ".join(f"'CLOSED' AS {k}k, CAST(0 AS INTEGER) AS {k}n, CAST(0 AS BIGINT) AS {k}s" for k in names)
    return f"""WITH RECURSIVE {_E.format(k="user_id")},
r AS (SELECT DISTINCT CAST(NULL AS BIGINT) AS event_id, user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS provider, 0 AS tried, FALSE AS code, {start} FROM e
UNION ALL SELECT e.event_id, e.user_id, e.rn, {provider}, {tries}, {code}, {", ".join(new)} FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, provider, (code AND provider = 'saas_primary') OR (NOT code AND provider = 'saas_fallback') AS is_fallback, CAST(tried AS BIGINT) AS tried, CASE WHEN provider IS NULL THEN 'EXHAUSTED' ELSE 'OK' END AS status FROM r WHERE rn > 0"""


@query(_routed_sql(86_400_000_000, 2))
def route_with_breakers(spark: SparkSession, d: str) -> DataFrame:
    """A router per user; the event's number says which providers would answer."""
    n = F.col("event_id")
    fine = F.transform("chain", lambda p: F.when(p == "vllm_local", n % 3 != 0).when(p == "saas_primary", n % 4 != 0).otherwise(n % 7 != 0))
    asked = events(spark, d).withColumn("chain", resilience.route(F.when(F.col("event_type") == "purchase", resilience.CODE).otherwise("chat"))).withColumn("fine", fine)
    breakers = tuple((name, Breaker(2, 2, 86_400_000_000)) for name in ("vllm_local", "saas_primary", "saas_fallback"))
    return resilience.routed(asked, ["user_id"], ["ts", "event_id"], "us", "chain", "fine", Router(breakers)).select("event_id", "provider", "is_fallback", "tried", "status")


_CLIENT = "e AS (SELECT event_id, client AS user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS rn FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'key-' || (user_id % 5) ELSE 'host-' || user_id END AS client FROM events))"


@query(_BUCKET.format(e=_CLIENT, cap="CAST(3 AS DOUBLE)", rate=_RATE).replace("SELECT event_id, user_id, round(tok, 6) AS tokens, allowed FROM r", "SELECT event_id, user_id AS client, round(tok, 6) AS tokens, CASE WHEN allowed THEN 200 ELSE 429 END AS status FROM r"))
def request_limits(spark: SparkSession, d: str) -> DataFrame:
    """Requests by API key where there is one (an empty one is none), else by host."""
    u = F.col("user_id")
    key = F.when(u % 3 == 0, F.concat(F.lit("key-"), (u % 5).cast("string"))).when(u % 3 == 1, "")
    asked = events(spark, d).select("event_id", "ts", "us", key.alias("api_key"), F.concat(F.lit("host-"), u.cast("string")).alias("host"))
    return resilience.limit_requests(asked, "api_key", "host", ["ts", "event_id"], "us", TokenBucket(3.0, 1 / 36000)).select("event_id", "client", F.round("tokens", 6).alias("tokens"), "status")


_LOOP = """WITH RECURSIVE {e},
r AS (SELECT DISTINCT CAST(NULL AS BIGINT) AS event_id, event_type, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS batch_no, CAST(0 AS BIGINT) AS position, CAST(0 AS BIGINT) AS begin_us, CAST(0 AS BIGINT) AS items, CAST(0 AS BIGINT) AS batch FROM e
UNION ALL SELECT event_id, event_type, rn, b1, c1, CASE WHEN c1 + 1 = 4 THEN greatest(s2, us) + 5000000000 ELSE s2 END, CASE WHEN c1 + 1 = 4 THEN 0 ELSE c1 + 1 END, CASE WHEN c1 + 1 = 4 THEN b1 + 1 ELSE b1 END FROM (
  SELECT *, CASE WHEN c1 = 0 AND us >= s1 + 40000000000 THEN s1 + (us - s1) // 40000000000 * 40000000000 ELSE s1 END AS s2 FROM (
    SELECT e.event_id, e.event_type, e.rn, e.us, CASE WHEN r.items > 0 AND e.us >= r.begin_us + 40000000000 THEN r.begin_us + 45000000000 ELSE r.begin_us END AS s1,
      CASE WHEN r.items > 0 AND e.us >= r.begin_us + 40000000000 THEN 0 ELSE r.items END AS c1, CASE WHEN r.items > 0 AND e.us >= r.begin_us + 40000000000 THEN r.batch + 1 ELSE r.batch END AS b1
    FROM r JOIN e ON e.event_type = r.event_type AND e.rn = r.rn + 1)))
SELECT event_id, event_type, batch_no, position FROM r WHERE rn > 0"""


@query(_LOOP.format(e=_E.format(k="event_type")))
def microbatch_worker(spark: SparkSession, d: str) -> DataFrame:
    rows = resilience.worker_batches(events(spark, d), ["event_type"], ["ts", "event_id"], "us", WorkerBatcher(4, 40_000_000_000, 5_000_000_000))
    return rows.select("event_id", "event_type", "batch_no", "position")


@query(
    f"""WITH RECURSIVE {_E.format(k="event_type")},
r AS (SELECT event_id, event_type, rn, us AS first, CAST(0 AS BIGINT) AS batch_no, CAST(0 AS BIGINT) AS position FROM e WHERE rn = 1
UNION ALL SELECT e.event_id, e.event_type, e.rn,
  CASE WHEN r.position + 1 >= 4 OR e.us >= r.first + 40000000000 THEN e.us ELSE r.first END,
  CASE WHEN r.position + 1 >= 4 OR e.us >= r.first + 40000000000 THEN r.batch_no + 1 ELSE r.batch_no END,
  CASE WHEN r.position + 1 >= 4 OR e.us >= r.first + 40000000000 THEN 0 ELSE r.position + 1 END
FROM r JOIN e ON e.event_type = r.event_type AND e.rn = r.rn + 1)
SELECT event_id, event_type, batch_no, position FROM r"""
)
def microbatch(spark: SparkSession, d: str) -> DataFrame:
    rows = resilience.micro_batches(events(spark, d), ["event_type"], ["ts", "event_id"], "us", MicroBatcher(4, 40_000_000_000))
    return rows.select("event_id", "event_type", "batch_no", "position")


@query(
    f"""WITH RECURSIVE {_E.format(k="event_type")},
r AS (SELECT event_id, event_type, rn, us + 2000000000 AS busy, CAST(1 AS BIGINT) AS depth, FALSE AS dropped FROM e WHERE rn = 1
UNION ALL SELECT event_id, event_type, rn, CASE WHEN d >= 3 THEN b ELSE b + 2000000000 END, CASE WHEN d >= 3 THEN d ELSE d + 1 END, d >= 3 FROM (
  SELECT e.event_id, e.event_type, e.rn, greatest(r.busy, e.us) AS b, CAST(ceil((greatest(r.busy, e.us) - e.us) / 2000000000) AS BIGINT) AS d FROM r JOIN e ON e.event_type = r.event_type AND e.rn = r.rn + 1))
SELECT event_id, event_type, depth, dropped FROM r"""
)
def load_shedding(spark: SparkSession, d: str) -> DataFrame:
    rows = resilience.shed_load(events(spark, d), ["event_type"], ["ts", "event_id"], "us", Backlog(3, 2_000_000_000))
    return rows.select("event_id", "event_type", "depth", "dropped")


@query(
    _BUCKET.format(e=_E.format(k="user_id"), cap="CAST(3 AS DOUBLE)", rate=_RATE).replace("SELECT event_id, user_id, round(tok, 6) AS tokens, allowed FROM r", "")
    + """, g AS (SELECT e.event_id, e.event_type, e.us, row_number() OVER (PARTITION BY e.event_type ORDER BY e.ts, e.event_id) AS rn FROM r JOIN e USING (event_id) WHERE r.allowed),
b AS (SELECT event_id, event_type, rn, us AS first, CAST(0 AS BIGINT) AS batch_no, CAST(0 AS BIGINT) AS position FROM g WHERE rn = 1
UNION ALL SELECT g.event_id, g.event_type, g.rn,
  CASE WHEN b.position + 1 >= 4 OR g.us >= b.first + 40000000000 THEN g.us ELSE b.first END,
  CASE WHEN b.position + 1 >= 4 OR g.us >= b.first + 40000000000 THEN b.batch_no + 1 ELSE b.batch_no END,
  CASE WHEN b.position + 1 >= 4 OR g.us >= b.first + 40000000000 THEN 0 ELSE b.position + 1 END
FROM b JOIN g ON g.event_type = b.event_type AND g.rn = b.rn + 1)
SELECT event_id, event_type AS adapter, batch_no, position FROM b"""
)
def adapter_gateway(spark: SparkSession, d: str) -> DataFrame:
    """Requests that their client's bucket admits, in micro-batches per adapter."""
    admitted = resilience.token_bucket(events(spark, d), "user_id", ["ts", "event_id"], "us", TokenBucket(3.0, 1 / 36000)).filter("allowed")
    rows = resilience.micro_batches(admitted, ["event_type"], ["ts", "event_id"], "us", MicroBatcher(4, 40_000_000_000))
    return rows.select("event_id", F.col("event_type").alias("adapter"), "batch_no", "position")


# Retry and routing ---------------------------------------------------------------------------------------------


@query(
    f"""WITH {_E.format(k="user_id")}, a AS (SELECT user_id, (rn - 1) // 4 AS task, (rn - 1) % 4 + 1 AS attempt, event_type NOT IN ('error', 'view', 'click') AS ok FROM e),
g AS (SELECT user_id, task, min(attempt) FILTER (ok) AS won, count(*) FILTER (NOT ok) AS failed FROM a GROUP BY 1, 2)
SELECT user_id, task, least(coalesce(won - 1, failed), 4) AS retry_count, CASE WHEN won IS NULL AND failed > 3 THEN 'DEAD' WHEN won IS NOT NULL THEN 'DELIVERED' ELSE 'PENDING' END AS status FROM g"""
)
def retry_dlq(spark: SparkSession, d: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    attempts = events(spark, d).withColumn("n", number).select("user_id", F.floor(F.col("n") / 4).alias("task"), (F.col("n") % 4 + 1).alias("attempt"), (~F.col("event_type").isin("error", "view", "click")).alias("ok"))
    return resilience.retry_outcomes(attempts, ["user_id", "task"])


@query("SELECT event_id, least(5.0, 0.5 * pow(2, event_id % 6)) AS cap_s, 0.5 * pow(1.5, event_id % 6) AS step_delay_s FROM events")
def backoff_caps(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 6
    return table(spark, d, "events").select("event_id", resilience.backoff_cap(n).alias("cap_s"), resilience.geometric_delay(n).alias("step_delay_s"))


@query(
    """WITH o AS (SELECT event_id, list_transform(range(1, 6), lambda k: CASE WHEN (event_id * 7 + k * 13) % 10 < 6 THEN 'transient' WHEN (event_id * 7 + k * 13) % 10 = 6 THEN 'permanent' ELSE 'success' END) AS a FROM events),
i AS (SELECT event_id, a, list_filter(range(1, 6), lambda k: a[k] <> 'transient') AS hit FROM o)
SELECT event_id, coalesce(a[hit[1]], 'transient') AS outcome, coalesce(hit[1], 5) AS attempts FROM i"""
)
def retry_declarative(spark: SparkSession, d: str) -> DataFrame:
    roll = lambda k: (F.col("event_id") * 7 + k * 13) % 10
    attempts = F.array(*(F.when(roll(k) < 6, "transient").when(roll(k) == 6, "permanent").otherwise("success") for k in range(1, 6)))
    rows = table(spark, d, "events").select("event_id", attempts.alias("a"))
    return rows.select("event_id", resilience.first_success(F.col("a")).alias("outcome"), resilience.attempts_made(F.col("a")).alias("attempts"))


@query(
    """WITH c AS (SELECT event_id, event_type = 'purchase' AS code, event_id % 5 <> 0 AND event_id % 3 <> 0 AS v, event_id % 4 <> 0 AS p, event_id % 7 <> 0 AS f FROM events)
SELECT event_id AS request_id, CASE WHEN code AND v THEN 'vllm_local' WHEN p THEN 'saas_primary' WHEN NOT code AND f THEN 'saas_fallback' END AS provider,
 CASE WHEN code AND v THEN FALSE WHEN p THEN code WHEN NOT code AND f THEN TRUE ELSE FALSE END AS is_fallback, CASE WHEN (code AND v) OR p OR (NOT code AND f) THEN 'OK' ELSE 'EXHAUSTED' END AS status FROM c"""
)
def route_fallback(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "events").select(F.col("event_id").alias("request_id"), resilience.route(F.when(F.col("event_type") == "purchase", "code_gen").otherwise("chat")).alias("route"))
    n = F.col("request_id")
    row = lambda name, allowed, ok: F.struct(F.lit(name).alias("provider"), allowed.alias("allowed"), ok.alias("ok"))
    outcomes = ids.select("request_id", F.explode(F.array(row("vllm_local", n % 5 != 0, n % 3 != 0), row("saas_primary", F.lit(True), n % 4 != 0), row("saas_fallback", F.lit(True), n % 7 != 0))).alias("o")).select("request_id", "o.*")
    return resilience.fall_back(ids, outcomes).fillna(False, ["is_fallback"])


@query(
    """WITH c AS (SELECT doc_id, unnest(range(0, 4)) AS attempt FROM documents),
h AS (SELECT doc_id, attempt, CAST(attempt >= doc_id % 6 AS BOOLEAN) AS ok FROM c),
g AS (SELECT doc_id, min(attempt) FILTER (ok) AS won FROM h GROUP BY 1),
d AS (SELECT d.doc_id, g.won, md5(coalesce(text, '')) AS code FROM documents d JOIN g USING (doc_id))
SELECT doc_id AS id, CASE WHEN won IS NULL THEN 'DEAD' ELSE 'DELIVERED' END AS status, CAST(coalesce(won, 4) AS INTEGER) AS retry_count,
  CASE WHEN won IS NOT NULL THEN round(('0x' || substr(code, 1, 4))::BIGINT / 32768.0 - 1, 6) END AS first_component FROM d"""
)
def delivered_or_dead(spark: SparkSession, d: str) -> DataFrame:
    """Every task of the texts ends in results or dead letters; the number of its attempts follows from its id."""
    tasks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("tenant_id"), "text")

    def provider(rows: DataFrame) -> DataFrame:
        made = mock_embeddings(rows, 16, 0)
        return made.withColumn("ok", F.col("retry_count") >= F.col("id") % 6).withColumn("error", F.when(~F.col("ok"), "transient"))

    done, dead = attempts(tasks, provider)
    rows = done.select("id", F.lit("DELIVERED").alias("status"), "retry_count", F.round(F.col("embedding")[0], 6).alias("first_component"))
    return rows.unionByName(dead.select("id", F.lit("DEAD").alias("status"), "retry_count", F.lit(None).cast("double").alias("first_component")))


@query(
    """WITH s AS (SELECT row_number() OVER () AS n, sale_id, sold_at FROM sales),
m AS (SELECT n, min(shipped_at) AS done_at FROM s JOIN sale_lines l ON l.sale_id = s.sale_id AND shipped_at >= sold_at AND shipped_at <= sold_at + INTERVAL 10 DAY GROUP BY n),
a AS (SELECT n, any_value(done_at) AS done_at, min(CAST(line_no AS VARCHAR)) AS answer FROM m JOIN s USING (n) JOIN sale_lines l ON l.sale_id = s.sale_id AND l.shipped_at = m.done_at GROUP BY n)
SELECT sale_id AS request_id, sold_at AS asked_at, done_at, answer, CASE WHEN done_at IS NULL THEN 'TIMED_OUT' ELSE 'OK' END AS status FROM s LEFT JOIN a USING (n)"""
)
def request_results(spark: SparkSession, d: str) -> DataFrame:
    """Sales as requests, the first shipment within ten days as their result."""
    requests = table(spark, d, "sales").select(F.col("sale_id").alias("request_id"), F.col("sold_at").alias("asked_at"))
    results = table(spark, d, "sale_lines").select(F.col("sale_id").alias("request_id"), F.col("shipped_at").alias("done_at"), F.col("line_no").cast("string").alias("answer"))
    return answered(requests, results, "10 days")


@query()
def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all texts by the mock provider with its failures, which come from a CRC that DuckDB does not have; a test repeats it."""
    tasks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("tenant_id"), "text")
    done, dead = attempts(tasks, lambda rows: mock_embeddings(rows, 16, 40))
    out = done.select("id", "retry_count", F.lit("DELIVERED").alias("status"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("vector_sum"))
    return out.unionByName(dead.select("id", "retry_count", F.lit("DEAD").alias("status"), F.lit(None).cast("double").alias("vector_sum")))


@query("SELECT user_id % 4 AS tenant_id, event_type AS id, event_id AS batch, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 4, event_type ORDER BY event_id DESC) = 1")
def result_store(spark: SparkSession, d: str) -> DataFrame:
    """The last result per tenant and id."""
    rows = table(spark, d, "events").select((F.col("user_id") % 4).alias("tenant_id"), F.col("event_type").alias("id"), F.col("event_id").alias("batch"), "value")
    return latest_results(rows)


@query(
    f"""WITH {_E.format(k="user_id")}, a AS (SELECT user_id, us, (rn - 1) // 4 AS task, (rn - 1) % 4 + 1 AS attempt, event_type NOT IN ('error', 'view', 'click') AS ok FROM e),
h AS (SELECT min(us) + (max(us) - min(us)) // 2 AS stop FROM a),
g AS (SELECT user_id, task, min(attempt) FILTER (ok AND us <= stop) AS won, count(*) FILTER (NOT ok AND us <= stop) AS failed FROM a CROSS JOIN h GROUP BY 1, 2)
SELECT user_id, task, least(coalesce(won - 1, failed), 4) AS retry_count, CASE WHEN won IS NULL AND failed > 3 THEN 'DEAD' WHEN won IS NOT NULL THEN 'DELIVERED' ELSE 'PENDING' END AS status FROM g"""
)
def drain_at_stop(spark: SparkSession, d: str) -> DataFrame:
    """What is delivered, dead and still pending when the worker stops half way through the log."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    log = events(spark, d).withColumn("n", number).select("user_id", "us", F.floor(F.col("n") / 4).alias("task"), (F.col("n") % 4 + 1).alias("attempt"), (~F.col("event_type").isin("error", "view", "click")).alias("ok"))
    ends = log.agg(F.min("us").alias("a"), F.max("us").alias("b")).head()
    return resilience.outcomes_at(log, ["user_id", "task"], "us", F.lit(ends["a"] + (ends["b"] - ends["a"]) // 2))


# Learning ------------------------------------------------------------------------------------------------------


def steps(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events(spark, d).select("event_id", F.col("user_id").alias("traj"), t.alias("t"), (F.col("value") / 97).alias("reward"), ((n % 10) / 10).alias("v"), (-(n % 7 + 1) / 10).alias("logp"), (-(n % 5 + 1) / 10).alias("logp_old"), (-(n % 6 + 1) / 10).alias("ref"))


_S = "s AS (SELECT event_id, user_id AS traj, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value / 97 AS reward, (event_id % 10) / 10 AS v, -(event_id % 7 + 1) / 10 AS logp, -(event_id % 5 + 1) / 10 AS logp_old, -(event_id % 6 + 1) / 10 AS ref FROM events)"


@query(f"WITH {_S} SELECT a.event_id, round(sum(pow(0.9, b.t - a.t) * b.reward), 6) AS g FROM s a JOIN s b ON a.traj = b.traj AND b.t >= a.t GROUP BY a.event_id")
def discounted_return(spark: SparkSession, d: str) -> DataFrame:
    return learning.discounted_return(steps(spark, d), gamma=0.9).select("event_id", F.round("g", 6).alias("g"))


@query(
    f"""WITH {_S}, d AS (SELECT *, reward + 0.9 * lead(v, 1, 0) OVER (PARTITION BY traj ORDER BY t) - v AS delta FROM s)
SELECT a.event_id, round(any_value(a.delta), 6) AS delta, round(sum(pow(0.9 * 0.8, b.t - a.t) * b.delta), 6) AS gae FROM d a JOIN d b ON a.traj = b.traj AND b.t >= a.t GROUP BY a.event_id"""
)
def gae(spark: SparkSession, d: str) -> DataFrame:
    return learning.gae(steps(spark, d), gamma=0.9, lam=0.8).select("event_id", F.round("delta", 6).alias("delta"), F.round("gae", 6).alias("gae"))


@query(
    f"""WITH {_S}, g AS (SELECT a.event_id, a.traj, a.logp, a.v, sum(pow(0.9, b.t - a.t) * b.reward) AS g FROM s a JOIN s b ON a.traj = b.traj AND b.t >= a.t GROUP BY ALL)
SELECT traj, round(sum(logp), 6) AS log_prob, round(exp(sum(logp)), 9) AS prob, round(avg(logp * g), 6) AS reinforce, round(avg(logp * (g - v)), 6) AS with_baseline FROM g GROUP BY traj"""
)
def reinforce_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = learning.discounted_return(steps(spark, d), gamma=0.9)
    return rows.groupBy("traj").agg(F.round(F.sum("logp"), 6).alias("log_prob"), F.round(F.exp(F.sum("logp")), 9).alias("prob"), F.round(F.avg(F.col("logp") * F.col("g")), 6).alias("reinforce"), F.round(F.avg(F.col("logp") * (F.col("g") - F.col("v"))), 6).alias("with_baseline"))


@query(
    f"""WITH {_S}, r AS (SELECT traj, exp(logp - logp_old) AS ratio, reward - v AS adv, v, reward, logp FROM s),
c AS (SELECT traj, least(ratio * adv, greatest(least(ratio, 1.2), 0.8) * adv) AS clip, (reward - v) * (reward - v) AS vf, -exp(logp) * logp AS ent FROM r)
SELECT traj, round(avg(clip), 6) AS clip, round(avg(clip - 0.5 * vf + 0.01 * ent), 6) AS objective FROM c GROUP BY traj"""
)
def ppo_clip(spark: SparkSession, d: str) -> DataFrame:
    adv = F.col("reward") - F.col("v")
    clip = rl.clipped_surrogate(F.col("logp"), F.col("logp_old"), adv, 0.2)
    whole = rl.composite(clip, adv * adv, -F.exp("logp") * F.col("logp"))
    return steps(spark, d).groupBy("traj").agg(F.round(F.avg(clip), 6).alias("clip"), F.round(F.avg(whole), 6).alias("objective"))


@query(
    f"""WITH {_S} SELECT traj, round(avg(1 / (1 + exp(-(reward - v)))), 6) AS bt, round(avg(ln(1 + exp(v - reward))), 6) AS nll,
 round(avg(ln(1 + exp(-0.1 * ((logp - ref) - (logp_old - ref))))), 6) AS dpo, round(avg(CASE WHEN t % 2 = 0 THEN 1 - 1 / (1 + exp(-0.1 * ((logp - ref) - 0.05))) ELSE 1 - 1 / (1 + exp(-0.1 * (0.05 - (logp - ref)))) END), 6) AS kto,
 round(avg(exp(ref - logp) - (ref - logp) - 1), 6) AS kl FROM s GROUP BY traj"""
)
def preference_losses(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    mean = lambda x, name: F.round(F.avg(x), 6).alias(name)
    return steps(spark, d).groupBy("traj").agg(
        mean(rl.bradley_terry(c("reward"), c("v")), "bt"),
        mean(rl.reward_nll(c("reward"), c("v")), "nll"),
        mean(rl.dpo(c("logp"), c("logp_old"), c("ref"), c("ref")), "dpo"),
        mean(rl.kto(c("logp") - c("ref"), c("t") % 2 == 0, F.lit(0.05)), "kto"),
        mean(rl.kl_token(c("logp"), c("ref")), "kl"),
    )


@query("SELECT event_id, round((value - avg(value) OVER w) / sqrt(var_pop(value) OVER w + 1e-8), 6) AS adv FROM events WINDOW w AS (PARTITION BY user_id)")
def grpo_adv(spark: SparkSession, d: str) -> DataFrame:
    rollouts = table(spark, d, "events").select("event_id", F.col("user_id").alias("prompt"), F.col("value").alias("reward"))
    return learning.group_advantages(rollouts).select("event_id", F.round("adv", 6).alias("adv"))


@query(
    f"""WITH {_S}, x AS (SELECT traj % 10 AS prompt, traj AS output, least(exp(logp - logp_old) * (reward - v), greatest(least(exp(logp - logp_old), 1.2), 0.8) * (reward - v)) - 0.04 * (exp(ref - logp) - (ref - logp) - 1) AS o FROM s),
y AS (SELECT prompt, output, avg(o) AS o FROM x GROUP BY 1, 2) SELECT prompt, round(avg(o), 6) AS objective FROM y GROUP BY prompt"""
)
def grpo_objective(spark: SparkSession, d: str) -> DataFrame:
    tokens = steps(spark, d).select((F.col("traj") % 10).alias("prompt"), F.col("traj").alias("output"), (F.col("reward") - F.col("v")).alias("adv"), "logp", "logp_old", "ref")
    return learning.grpo_objective(tokens).select("prompt", F.round("objective", 6).alias("objective"))


@query(
    """WITH c AS (SELECT event_id, user_id AS x, 1 / count(*) OVER (PARTITION BY user_id) AS ref, value / 100 AS r FROM events), m AS (SELECT *, max(r) OVER (PARTITION BY x) AS top FROM c)
SELECT event_id, round(ref * exp((r - top) / 0.5) / sum(ref * exp((r - top) / 0.5)) OVER (PARTITION BY x), 8) AS policy FROM m"""
)
def closed_form_policy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    sizes = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    choices = rows.join(sizes, "user_id").select("event_id", F.col("user_id").alias("x"), (1 / F.col("n")).alias("ref"), (F.col("value") / 100).alias("r"))
    return learning.closed_form_policy(choices, 0.5).select("event_id", F.round("policy", 8).alias("policy"))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """Nations as states; action 0 moves on by 1 or 5, action 1 doubles the number."""
    n = F.col("n_nationkey")
    row = lambda a, s2, p: F.struct(F.lit(a).alias("a"), s2.alias("s2"), F.lit(p).alias("p"))
    moves = F.explode(F.array(row(0, (n + 1) % 25, 0.7), row(0, (n + 5) % 25, 0.3), row(1, (n * 2) % 25, 1.0)))
    return table(spark, d, "nation").select(n.alias("s"), "n_regionkey", moves.alias("m")).select("s", "m.a", "m.s2", "m.p", (F.col("n_regionkey") * (F.col("m.a") + 1) / 10).alias("r"))


def _sweeps(best: str, count: int) -> str:
    parts = [
        """WITH t AS (SELECT n_nationkey AS s, a, CASE WHEN a = 0 AND k = 0 THEN (n_nationkey + 1) % 25 WHEN a = 0 THEN (n_nationkey + 5) % 25 ELSE (n_nationkey * 2) % 25 END AS s2,
  CASE WHEN a = 0 AND k = 0 THEN 0.7 WHEN a = 0 THEN 0.3 ELSE 1.0 END AS p, n_regionkey * (a + 1) / 10 AS r FROM nation CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0)) m(a, k)),
v0 AS (SELECT DISTINCT s, CAST(0 AS DOUBLE) AS v FROM t)"""
    ]
    for k in range(count):
        parts.append(f"v{k + 1} AS (SELECT s, {best} AS v FROM (SELECT t.s, t.a, sum(p * (r + 0.9 * v.v)) AS q FROM t JOIN v{k} v ON v.s = t.s2 GROUP BY 1, 2) GROUP BY s)")
    return ", ".join(parts) + f" SELECT s, round(v, 6) AS v FROM v{count}"


@query(_sweeps("max(q)", 6))
def value_iteration(spark: SparkSession, d: str) -> DataFrame:
    return learning.value_iteration(transitions(spark, d), 6, 0.9).select("s", F.round("v", 6).alias("v"))


@query(_sweeps("sum(CASE WHEN a = 0 THEN 0.25 ELSE 0.75 END * q)", 6))
def policy_evaluation(spark: SparkSession, d: str) -> DataFrame:
    moves = transitions(spark, d)
    policy = moves.select("s", "a").distinct().withColumn("pi", F.when(F.col("a") == 0, 0.25).otherwise(0.75))
    return learning.policy_evaluation(moves, policy, 6, 0.9).select("s", F.round("v", 6).alias("v"))


@query(_sweeps("max(q)", 40).replace("0.9 *", "0.5 *"))
def values_converged(spark: SparkSession, d: str) -> DataFrame:
    """Optimality sweeps until the values are known to within a billionth."""
    values, _, _ = learning.optimal_values(transitions(spark, d), 0.5, 1e-9)
    return values.select("s", F.round("v", 6).alias("v"))
