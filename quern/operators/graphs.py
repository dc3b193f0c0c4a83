"""Graphs: communities by modularity, path patterns, and random walks from a question's entities.

Edges are tables (a, b and where needed type, w). A hub is the key of many edges,
so whatever is looked up for a hub is dealt over salts (of other nodes one row is enough), and
sums are combined before they meet. Every round is written, so plans do not grow with rounds.
Tables of nodes and edges meet by sort-merge joins (``shuffled``): they are so small as files that
Spark would send them whole through the driver.

Nulls and limits: edges with a null end take no part; repeated edges weigh as
often as they are there; loops count in a node's weight; ties go to the value
named in each function; an empty table of edges gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import stage


#: Edges beyond which a node is a hub.
HUB = 10_000


def shuffled(df: DataFrame) -> DataFrame:
    """A table that grows with the graph: a join deals it out, and never collects it in the driver to broadcast it."""
    return df.hint("merge")


def salted(both: DataFrame, parts: int) -> DataFrame:
    """``both`` (a, b, ...) with a salt that spreads the edges to a hub ``b``; that of all other edges is 0."""
    hubs = both.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") > HUB).select("b", F.lit(True).alias("hub"))  # one for HUB edges at most
    salt = F.when(F.col("hub"), F.pmod(F.xxhash64("a", "b"), F.lit(parts))).otherwise(F.lit(0).cast("long"))
    return both.join(F.broadcast(hubs), "b", "left").select(*both.columns, salt.alias("salt"))


def dealt(rows: DataFrame, both: DataFrame, parts: int) -> DataFrame:
    """``rows`` (b, ...) with the salts that the edges ``both`` to the node have: all for a hub, 0 for others."""
    hubs = both.filter("salt > 0").select("b", F.lit(parts - 1).cast("long").alias("most")).distinct()  # a row per HUB edges at most
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("most", F.lit(0).cast("long"))))
    return shuffled(rows.join(F.broadcast(hubs), "b", "left").select(*rows.columns, salts.alias("salt")))


def _both_ways(edges: DataFrame, parts: int) -> DataFrame:
    """a, b, w of every edge in both directions, and a salt that spreads a hub's edges; write it, since ``dealt`` reads it again."""
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    one = edges.filter("a is not null and b is not null").select("a", "b", w.alias("w"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return salted(both.groupBy("a", "b").agg(F.sum("w").alias("w")), parts)


def _toward(both: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """a, label, w: how much of a node's weight goes to each label (of ``labels``: node, label) among its neighbours."""
    at = dealt(labels.select(F.col("node").alias("b"), "label"), both, parts)
    return both.join(at, ["b", "salt"]).groupBy("a", "label").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0, parts: int = 16) -> float:
    """Share of the weight inside communities (node, community), less what random ends would give."""
    both = stage(edges.sparkSession, _both_ways(edges, parts), "modularity-edges")
    labels = communities.select("node", F.col("community").alias("label"))
    near = _toward(both, labels, parts).join(shuffled(labels.select(F.col("node").alias("a"), F.col("label").alias("own"))), "a")
    total = near.groupBy("own").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("label") == F.col("own"), F.col("w")).otherwise(0.0)).alias("inside"))
    sums = total.agg(F.sum("k").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares")).head()
    return sums["inside"] / sums["m2"] - resolution * sums["squares"] / sums["m2"] ** 2 if sums["m2"] else 0.0


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """node, component (its smallest node), over undirected edges (a, b): smallest neighbour, then the label's own label, until nothing changes."""
    spark = nodes.sparkSession
    both = stage(spark, edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    labels = stage(spark, nodes.select("node", F.col("node").alias("component")), "component-0")
    for k in range(rounds):
        near = both.join(shuffled(labels), F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(shuffled(near), "node", "left").select("node", F.col("component").alias("before"), F.least("component", F.coalesce("near", "component")).alias("component"))
        low = stage(spark, low, f"component-low-{k}")
        jump = low.select(F.col("node").alias("at"), F.col("component").alias("next"))
        labels = stage(spark, low.join(shuffled(jump), F.col("component") == F.col("at")).select("node", "before", F.least("component", "next").alias("component")), f"component-{k + 1}")
        changed = labels.filter(F.col("component") != F.col("before")).isEmpty()
        labels = labels.select("node", "component")
        if changed:
            break
    return labels


class _Level:
    """One level of the hierarchy: its graph, and the moves within it."""

    def __init__(self, both: DataFrame, resolution: float, parts: int, number: int):
        self.both, self.resolution, self.parts, self.number, self.spark = both, resolution, parts, number, both.sparkSession
        self.nodes = stage(self.spark, both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")), f"leiden-nodes-{number}")
        sums = both.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("m2"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("w"))), F.lit(0.0)).alias("loops")).head()
        self.m2, self.loops, self.apart = sums["m2"], sums["loops"], both.filter("a <> b")

    def turn(self, node: str, round_: int, share: int = 2) -> Column:
        """Whose turn it is: one of ``share`` nodes moves in a round, so neighbours do not swap places for ever."""
        return F.pmod(F.xxhash64(F.col(node), F.lit(self.number), F.lit(round_)), F.lit(share)) == 0

    def moved(self, labels: DataFrame, rounds: int) -> DataFrame:
        """Labels (node, label) after rounds of moves to the neighbouring community that gains most; the best of all rounds."""
        best, stalled, spark = None, 0, self.spark
        for r in range(rounds + 1):
            own = labels.join(shuffled(self.nodes), "node").select(F.col("node").alias("a"), F.col("label").alias("own"), "k")
            near = _toward(self.apart, labels, self.parts).unionByName(labels.select(F.col("node").alias("a"), "label", F.lit(0.0).alias("w"))).groupBy("a", "label").agg(F.sum("w").alias("w"))
            total = own.groupBy(F.col("own").alias("label")).agg(F.sum("k").alias("total"))
            near = stage(spark, near.join(shuffled(own), "a").join(shuffled(total), "label"), f"leiden-near-{self.number}-{r}")
            mine = near.filter(F.col("label") == F.col("own"))
            inside = mine.agg(F.sum("w")).head()[0] + self.loops
            squares = mine.groupBy("label").agg(F.first("total").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).head()[0]
            q = inside / self.m2 - self.resolution * squares / self.m2**2
            if best is None or q > best[0] + 1e-9:
                best, stalled = (q, labels, near), 0
            else:
                stalled += 1
            if r == rounds or stalled >= 4:
                break
            near = best[2]  # after a round that lost, fewer nodes move from the best state, in the end the one that gains most
            mine = F.col("label") == F.col("own")
            gain = F.round(F.col("w") - self.resolution * F.col("k") * (F.col("total") - F.when(mine, F.col("k")).otherwise(0.0)) / self.m2, 9)
            # Two nodes on their own would swap labels: only the one with the greater label goes to the other.
            swap = ~mine & (F.col("total") == F.col("k")) & (F.col("own_total") == F.col("k")) & (F.col("label") > F.col("own"))
            alone = near.filter(mine).select(F.col("a").alias("a_"), F.col("total").alias("own_total"))
            near = near.join(shuffled(alone), F.col("a") == F.col("a_")).filter(~swap)
            to = near.groupBy("a").agg(F.max(F.struct(gain.alias("gain"), mine.alias("stays"), "label")).alias("to"), F.max(F.when(mine, gain)).alias("now"), F.first("own").alias("own"))
            to = stage(spark, to.select(F.col("a").alias("node"), "own", F.col("to.label").alias("label"), (F.col("to.gain") - F.col("now")).alias("more")), f"leiden-to-{self.number}-{r}")
            wants = to.filter("label <> own")
            if wants.isEmpty():
                break
            chosen = wants.filter(self.turn("node", r, 2 << stalled)) if stalled < 3 else wants.orderBy(F.desc("more"), "node").limit(1)
            chosen = chosen.select("node", F.col("label").alias("new"))
            labels = stage(spark, to.join(shuffled(chosen), "node", "left").select("node", F.coalesce("new", "own").alias("label")), f"leiden-labels-{self.number}-{r}")
        return best[1]

    def refined(self, labels: DataFrame, rounds: int = 4) -> DataFrame:
        """node, label: communities cut into parts that are connected, each grown by single nodes that join a part which stays."""
        spark = self.spark
        same = self.apart.join(shuffled(labels.select(F.col("node").alias("a"), F.col("label").alias("la"))), "a").join(dealt(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), self.apart, self.parts), ["b", "salt"])
        inner = stage(spark, same.filter("la = lb").select("a", "b", "w", "salt"), f"leiden-inner-{self.number}")
        parts = stage(spark, self.nodes.select("node", F.col("node").alias("label")), f"leiden-parts-{self.number}")
        for r in range(rounds):
            sizes = parts.join(shuffled(self.nodes), "node").groupBy("label").agg(F.count("*").alias("n"), F.sum("k").alias("total"))
            stays = sizes.filter((F.col("n") > 1) | ~self.turn("label", 100 + r))
            alone = parts.join(shuffled(sizes.filter("n = 1").select("label")), "label").filter(self.turn("node", 100 + r)).join(shuffled(self.nodes), "node").select(F.col("node").alias("a"), "k")
            near = _toward(inner, parts, self.parts).join(shuffled(alone), "a").join(shuffled(stays), "label")
            gain = F.round(F.col("w") - self.resolution * F.col("k") * F.col("total") / self.m2, 9)
            to = near.withColumn("gain", gain).filter("gain > 0").groupBy(F.col("a").alias("node")).agg(F.max_by("label", F.struct("gain", "label")).alias("to"))
            to = stage(spark, to, f"leiden-join-{self.number}-{r}")
            parts = stage(spark, parts.join(shuffled(to), "node", "left").select("node", F.coalesce("to", "label").alias("label")), f"leiden-parts-{self.number}-{r}")
            if to.isEmpty() and r:
                break
        return parts


def _folded(both: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, to) of one neighbour and no loop with that neighbour, and the edges that are left when they become its loops.

    Of two nodes that have only each other the greater goes. Such a node's edges are
    told by their pair of ends, so a hub's are dealt over all tasks.
    """
    spark = both.sparkSession
    pair = (F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    lone = both.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"), F.min("w").alias("w")).filter("n = 1 and a <> b")
    ends = lone.select(*pair, "a", "w").groupBy("low", "high").agg(F.max("a").alias("node"), F.min("w").alias("w"))
    goes = stage(spark, ends.withColumn("to", F.when(F.col("node") == F.col("low"), F.col("high")).otherwise(F.col("low"))), "leiden-goes")
    rest = both.select("a", "b", "w", *pair).join(shuffled(goes.select("low", "high")), ["low", "high"], "left_anti").select("a", "b", "w")
    loops = goes.select(F.col("to").alias("a"), F.col("to").alias("b"), (2 * F.col("w")).alias("w"))
    left = rest.unionByName(loops).groupBy("a", "b").agg(F.sum("w").alias("w"))
    return goes.select("node", "to"), stage(spark, salted(left, parts), "leiden-folded")


def leiden(edges: DataFrame, resolution: float = 1.0, levels: int = 8, rounds: int = 16, parts: int = 16) -> DataFrame:
    """node, community (its smallest node) by modularity: moves, refinement and aggregation, level by level.

    In a level nodes move to the neighbouring community of greatest gain, half of
    them a round; a round that gains nothing is taken back, and fewer move in the next. Communities are
    then refined into connected parts, parts become the nodes of the next level,
    and start there in their communities. It ends when refinement joins nothing more. A
    community that is left in several pieces is cut into them, which never lowers modularity.

    Up to a resolution of 1 a node of one neighbour loses nothing in that neighbour's community, whatever
    that is, so such nodes are folded into their neighbours first, and rounds see the others only.
    """
    spark = edges.sparkSession
    both = first = stage(spark, _both_ways(edges, parts), "leiden-edges")
    place = stage(spark, both.select(F.col("a").alias("node")).distinct().withColumn("at", F.col("node")), "leiden-place")
    labels = place.select("node", F.col("node").alias("label"))
    if place.isEmpty():
        return labels.withColumnRenamed("label", "community")
    if resolution <= 1:
        goes, both = _folded(both, parts)
        place = stage(spark, place.join(shuffled(goes), "node", "left").select("node", F.coalesce("to", "at").alias("at")), "leiden-place-folded")
        labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for number in range(levels):
        level = _Level(both, resolution, parts, number)
        labels = level.moved(labels, rounds)
        if number == levels - 1:
            break
        refined = level.refined(labels).withColumnRenamed("label", "part")
        counts = refined.agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts")).head()
        if counts["n"] == counts["parts"]:
            break
        place = stage(spark, place.join(shuffled(refined.select(F.col("node").alias("at"), "part")), "at").select("node", F.col("part").alias("at")), f"leiden-place-{number}")
        labels = stage(spark, refined.join(shuffled(labels), "node").select(F.col("part").alias("node"), "label").distinct(), f"leiden-start-{number}")
        to = lambda end: refined.select(F.col("node").alias(end), F.col("part").alias(f"p{end}"))  # noqa: E731, B023
        merged = both.join(shuffled(to("a")), "a").join(dealt(to("b"), both, parts), ["b", "salt"]).groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("w").alias("w"))
        both = stage(spark, salted(merged, parts), f"leiden-edges-{number}")
    found = stage(spark, place.join(shuffled(labels.select(F.col("node").alias("at"), "label")), "at").select("node", "label"), "leiden-found")
    end = lambda e: found.select(F.col("node").alias(e), F.col("label").alias(f"l{e}"))
    inside = first.join(shuffled(end("a")), "a").join(dealt(end("b"), first, parts), ["b", "salt"]).filter("la = lb").select("a", "b")
    return components(found.select("node"), inside).withColumnRenamed("component", "community")


def paths(edges: DataFrame, start: DataFrame, end: DataFrame | None = None, types: list[str] | None = None, least: int = 1, most: int = 3, direction: str = "out") -> DataFrame:
    """nodes, types: every path of ``least`` to ``most`` edges (a, type, b) from a start node to an end node (node; any, if None).

    No path holds a node twice. Edges are followed "out" (a to b), "in" or "any" way;
    repeated edges of one type are one. With both ends given, paths grow from
    the end whose nodes have fewer edges. A hop is a join on the last node: a
    hub's edges are dealt over salts, and so are the paths that come to it.
    """
    if direction not in ("out", "in", "any") or not 0 <= least <= most:
        raise ValueError("direction is out, in or any, and least is at most most")
    spark, salts = edges.sparkSession, 8
    kept = edges.filter("a is not null and b is not null").select("a", "type", "b")
    kept = kept if types is None else kept.filter(F.col("type").isin(types))
    turned = kept.select(F.col("b").alias("a"), "type", F.col("a").alias("b"))
    steps = {"out": kept, "in": turned, "any": kept.union(turned)}[direction].distinct()
    steps = stage(spark, steps.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts))), "path-steps")
    begin, backward = start.select("node").distinct(), False
    if end is not None:
        end = end.select("node").distinct()
        cost = lambda nodes, column: nodes.join(steps, F.col("node") == F.col(column)).count()
        if cost(end, "b") < cost(begin, "a"):
            begin, end, backward = end, begin, True
            steps = steps.select(F.col("b").alias("a"), "type", F.col("a").alias("b"), F.pmod(F.xxhash64("a"), F.lit(salts)).alias("salt"))
    front = begin.select("node", F.array("node").alias("nodes"), F.array().cast("array<string>").alias("types"))
    found = [front] if least == 0 else []
    for hop in range(1, most + 1):
        dealt = front.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        near = dealt.join(steps, (dealt["node"] == steps["a"]) & (dealt["salt"] == steps["salt"])).filter(~F.array_contains("nodes", F.col("b")))
        front = stage(spark, near.select(F.col("b").alias("node"), F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("types", F.col("type")).alias("types")), f"path-{hop}")
        if hop >= least:
            found.append(front)
        if front.isEmpty():
            break
    all_ = found[0] if found else front
    for more in found[1:]:
        all_ = all_.unionByName(more)
    all_ = all_ if end is None else all_.join(end, "node", "left_semi")
    return all_.select(F.reverse("nodes").alias("nodes"), F.reverse("types").alias("types")) if backward else all_.select("nodes", "types")


def shared_walks(edges: DataFrame, anchors: DataFrame, steps: int = 8, restart: float = 0.15, least: float = 0.0, parts: int = 16) -> tuple[DataFrame, DataFrame]:
    """walk, node, p: where walks over undirected edges from each set of anchors are after ``steps``; and query_id, walk of each question.

    A walk starts at one of a question's anchors (query_id, node), goes to a neighbour by weight,
    and returns to an anchor with chance ``restart``. All walks go at once, and questions of the same
    anchors share one, which is named by the smallest of them: rows grow with different sets of anchors, not with questions. With a
    ``least`` above 0, shares below it are not followed further. Anchors that no edge has are left out.
    """
    spark = edges.sparkSession
    both = _both_ways(edges, parts)
    degree = both.groupBy(F.col("a").alias("b")).agg(F.sum("w").alias("k"))
    # A step goes from b to a: salts are those of b.
    both = stage(spark, both.join(shuffled(degree), "b").select("a", "b", (F.col("w") / F.col("k")).alias("share"), "salt"), "walk-edges")
    known = anchors.select("query_id", "node").distinct().join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    sets = stage(spark, known.groupBy("query_id").agg(F.sort_array(F.collect_set("node")).alias("nodes")), "walk-sets")
    walks = stage(spark, sets.groupBy("nodes").agg(F.min("query_id").alias("walk")), "walk-names")
    asked = stage(spark, sets.join(shuffled(walks), "nodes").select("query_id", "walk"), "walk-asked")
    home = stage(spark, walks.select("walk", F.explode("nodes").alias("node"), (1.0 / F.size("nodes")).alias("p")), "walk-home")
    at = home
    for k in range(steps):
        going = at.filter(F.col("p") >= least)
        from_ = dealt(going.select("walk", F.col("node").alias("b"), "p"), both, parts)
        near = both.join(from_, ["b", "salt"]).groupBy("walk", F.col("a").alias("node")).agg(F.sum((1 - restart) * F.col("p") * F.col("share")).alias("p"))
        back = home.select("walk", "node", (restart * F.col("p")).alias("p"))
        at = stage(spark, near.unionByName(back).groupBy("walk", "node").agg(F.sum("p").alias("p")), f"walk-{k}")
    return at, asked


def random_walk(edges: DataFrame, anchors: DataFrame, steps: int = 8, restart: float = 0.15, least: float = 0.0, parts: int = 16) -> DataFrame:
    """query_id, node, p: the walks of ``shared_walks``, whole, for every question."""
    at, asked = shared_walks(edges, anchors, steps, restart, least, parts)
    return at.join(shuffled(asked), "walk").select("query_id", "node", "p")


def best_of(scored: DataFrame, key: str, depth: int) -> DataFrame:
    """The ``depth`` best rows (key, id, score) of each key, in the order of ``fused_streams``."""
    order = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth).drop("rank")


def fused_streams(streams: list[DataFrame], depth: int, k: float = 60.0, top: int = 10) -> DataFrame:
    """query_id, id, rrf_score, rank: for every question, streams (query_id, id, score) ranked to ``depth``, and fused by reciprocal rank."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = lambda c: Window.partitionBy("query_id").orderBy(F.desc(F.round(c, 9)), "id")
    parts = None
    for df in streams:
        ranked = df.select("query_id", "id", F.row_number().over(order("score")).alias("rank")).filter(F.col("rank") <= depth)
        part = ranked.select("query_id", "id", (1.0 / (k + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy("query_id", "id").agg(F.sum("part").alias("rrf_score"))
    return fused.withColumn("rank", F.row_number().over(order("rrf_score"))).filter(F.col("rank") <= top)
