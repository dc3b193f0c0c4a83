"""Layered proximity graphs (HNSW): one per shard of bounded size, searched best-first under a filter.

Rows are dealt into shards by a hash of their id and place. Within a shard every row has a
level, drawn from the hash, so that each layer holds a fixed share of the one
below; a layer links each of its rows to near ones in different directions (a
candidate is taken if it is nearer to the row than to those taken before), both
ways, and joins what is left apart. A search descends greedily through the
layers and then walks the lowest one from the best row on, with a beam of ``beam`` rows
that pass the filter; rows that do not pass are walked over, not returned.

Results are approximate, a wider beam finds more, and a beam as wide as a shard
is exact, since a layer is connected. A row of the graph is a node with its links, so the
graph is a table: write it, read it back, search it.

Nulls and limits: vectors that are null, empty or hold no numbers are neither
indexed nor asked; shorter ones count as if they ended in zeros; ids are numbers or
strings; repeated rows are nodes each; ties go to the smaller id; an empty graph finds nothing.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import normalized
from quern.operators.search import nearest, rows_of, type_of, usable
from quern.session import ship


def _links(x: np.ndarray, own: np.ndarray, most: int) -> dict[int, list[int]]:
    """Links of the rows ``own`` among each other: near ones in different directions, both ways, all connected."""
    near: dict[int, list[int]] = {int(k): [] for k in own}
    v = x[own]
    wide = min(len(own) - 1, 3 * most)
    for a in range(0, len(own), 1024):
        scores = v[a : a + 1024] @ v.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, :wide]
        for i, candidates in enumerate(best):
            among = v[candidates] @ v[candidates].T
            taken: list[int] = []
            for c in range(len(candidates)):
                if len(taken) < most and all(scores[i, candidates[c]] >= among[c, t] for t in taken):
                    taken.append(c)
            # What is left over fills up to half, so a row in a dense place keeps its nearest.
            rest = [c for c in range(len(candidates)) if c not in taken][: max(0, most // 2 - len(taken))]
            near[int(own[a + i])] = [int(own[candidates[c]]) for c in sorted(taken + rest)]
    for k, links in list(near.items()):
        for other in links:
            if k not in near[other]:
                near[other].append(k)
    # Parts that no link joins: the first row of each is linked with the nearest row of what is joined already.
    joined, rest = set(), [int(k) for k in own]
    while rest:
        part, todo = set(), [rest[0]]
        while todo:
            k = todo.pop()
            if k not in part:
                part.add(k)
                todo += [o for o in near[k] if o not in part]
        if joined:
            others = np.array(sorted(joined))
            other = int(others[np.argmax(x[others] @ x[rest[0]])])
            near[rest[0]].append(other)
            near[other].append(rest[0])
        joined |= part
        rest = [k for k in rest if k not in joined]
    return near


def build(vectors: DataFrame, keep: tuple[str, ...] = (), shard_rows: int = 4096, links: int = 16, share: int = 16) -> DataFrame:
    """shard, node, id, v, links (for each layer, from the lowest) and ``keep`` of every row of ``vectors`` (id, vector)."""
    ship(vectors.sparkSession)
    rows = vectors.filter(usable(F.col("vector"))).select("id", normalized(F.col("vector")).alias("v"), *keep)
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    place = F.monotonically_increasing_id()  # rows of one repeated id are dealt out too
    dealt = rows.select(F.pmod(F.xxhash64("id", place), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("id", place, F.lit("level")), F.lit(2**32)).alias("draw"), "*")

    def graph(t: pa.Table) -> pa.Table:
        t = t.sort_by([("draw", "ascending"), ("id", "ascending")])
        width = max([len(v) for v in t.column("v").to_pylist()], default=1)
        x = rows_of(t.column("v"), width)
        draws = t.column("draw").to_numpy() / 2.0**32
        level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(share)).astype(int), 16)
        level[0] = level.max()  # the first row is where searches enter
        out: list[list[list[int]]] = [[] for _ in range(len(x))]
        for layer in range(int(level.max()) + 1):
            for k, near in _links(x, np.flatnonzero(level >= layer), links).items():
                out[k].append(near)
        added = {"shard": t.column("shard"), "node": pa.array(range(len(x)), pa.int32()), "id": t.column("id"), "v": t.column("v"), "links": pa.array(out, pa.list_(pa.list_(pa.int32())))}
        return pa.table(added | {c: t.column(c) for c in keep})

    kept = "".join(f", {c} {type_of(rows, c)}" for c in keep)
    return dealt.groupBy("shard").applyInArrow(graph, f"shard int, node int, id {type_of(rows, 'id')}, v array<double>, links array<array<int>>{kept}")


def walk(x: np.ndarray, links: list[list[list[int]]], q: np.ndarray, ok: np.ndarray, beam: int) -> list[tuple[float, int]]:
    """(score, node) of the rows that a search for ``q`` ends with, at most ``beam`` of those that are ``ok``."""
    at, score = 0, float(x[0] @ q)
    for layer in range(len(links[0]) - 1, 0, -1):
        while links[at][layer]:
            near = np.array(links[at][layer])
            scores = x[near] @ q
            best = int(scores.argmax())
            if scores[best] <= score:
                break
            at, score = int(near[best]), float(scores[best])
    seen = np.zeros(len(x), bool)
    seen[at] = True
    todo = [(-score, at)]
    found: list[tuple[float, int]] = [(score, at)] if ok[at] else []
    while todo:
        score, at = heapq.heappop(todo)
        if len(found) >= beam and -score < found[0][0]:
            break
        near = np.array([k for k in links[at][0] if not seen[k]], int)
        if not len(near):
            continue
        seen[near] = True
        for s, k in zip((x[near] @ q).tolist(), near.tolist(), strict=True):
            if len(found) < beam or s > found[0][0]:
                heapq.heappush(todo, (-s, k))
                if ok[k]:
                    heapq.heappush(found, (s, k))
                    if len(found) > beam:
                        heapq.heappop(found)
    return found


def search(queries: DataFrame, graph: DataFrame, k: int = 10, beam: int = 64, where: Column | None = None, query_block: int = 1024) -> DataFrame:
    """query_id, id, score, rank: the best k rows of ``graph`` that pass ``where`` (over its kept columns) for ``queries`` (query_id, vector)."""
    ship(graph.sparkSession)
    asked = queries.filter(usable(F.col("vector"))).select("query_id", normalized(F.col("vector")).alias("v"))
    n, shards = asked.count(), graph.agg(F.coalesce(F.max("shard"), F.lit(-1))).head()[0] + 1
    blocks = max(1, -(-n // query_block))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(max(count, 1) - 1)))
    ok = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    nodes = graph.select("shard", "node", "id", "v", "links", ok.alias("ok"), each(blocks).alias("block"))
    right = asked.select("query_id", "v", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), each(shards).alias("shard"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            a = a.sort_by("node")
            width = max(len(v) for t in (a, b) for v in t.column("v").to_pylist())
            x, q = rows_of(a.column("v"), width), rows_of(b.column("v"), width)
            passes, ids = a.column("ok").to_numpy(zero_copy_only=False), a.column("id").to_pylist()
            if max(beam, k) >= a.num_rows:
                # A walk with such a beam comes to every row, since the lowest layer is connected: products give the same.
                fits = np.flatnonzero(passes)
                fits = fits[np.argsort(a.column("id").to_numpy()[fits], kind="stable")]
                best, scores = nearest(q, x[fits], k)
                names = np.repeat(np.arange(len(q)), best.shape[1])
                return pa.table({"query_id": b.column("query_id").take(pa.array(names)), "id": a.column("id").take(pa.array(fits[best].ravel())), "score": scores.ravel()})
            links = a.column("links").to_pylist()
            for name, one in zip(b.column("query_id").to_pylist(), q, strict=True):
                found = sorted(((-round(s, 12), ids[j], s) for s, j in walk(x, links, one, passes, max(beam, k))))[:k]
                for column, values in zip(out, ([name] * len(found), [f[1] for f in found], [f[2] for f in found]), strict=True):
                    column += values
        return pa.table({"query_id": pa.array(out[0], b.schema.field("query_id").type), "id": pa.array(out[1], a.schema.field("id").type), "score": pa.array(out[2], pa.float64())})

    met = nodes.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, f"query_id {type_of(asked, 'query_id')}, id {type_of(graph, 'id')}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
