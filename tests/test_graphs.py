"""Communities, paths and walks against brute force on small graphs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import agents, graphs
from quern.plans.catalogue import edges as nations


def frame(spark, rows):
    return spark.createDataFrame([(str(a), str(b)) for a, b in rows], "a string, b string").coalesce(1)


def quality(rows, community):
    """Modularity by its definition, over ordered pairs of nodes."""
    nodes = sorted({x for e in rows for x in e})
    at = {x: k for k, x in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for a, b in rows:
        w[at[a], at[b]] += 1
        w[at[b], at[a]] += 1
    k, m2 = w.sum(1), w.sum()
    return sum(w[i, j] - k[i] * k[j] / m2 for i in range(len(nodes)) for j in range(len(nodes)) if community[nodes[i]] == community[nodes[j]]) / m2


def connected(rows, members):
    members, seen, todo = set(members), set(), [min(members)]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b for a, b in (*rows, *((b, a) for a, b in rows)) if a == x and b in members]
    return seen == members


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]
        yield [[items[0]], *rest]


def by_node(df):
    return {r["node"]: r["community"] for r in df.collect()}


CLIQUES = [(a, b) for base in (0, 4, 8) for a, b in itertools.combinations(range(base, base + 4), 2)] + [(3, 4), (7, 8), (11, 0)]


def test_cliques_are_found(spark):
    rows = [(f"{a:02}", f"{b:02}") for a, b in CLIQUES]
    got = by_node(graphs.leiden(frame(spark, rows)))
    assert got == {f"{k:02}": f"{4 * (k // 4):02}" for k in range(12)}
    assert abs(graphs.modularity(frame(spark, rows), spark.createDataFrame(list(got.items()), "node string, community string")) - quality(rows, got)) < 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_small_graphs_against_all_partitions(spark, seed):
    rnd = random.Random(seed)
    rows = [(str(a), str(b)) for a, b in itertools.combinations(range(7), 2) if rnd.random() < 0.45] + [("0", "0"), ("1", "2"), ("1", "2")]
    got = by_node(graphs.leiden(frame(spark, rows)))
    nodes = sorted({x for e in rows for x in e})
    best = max(quality(rows, {x: k for k, part in enumerate(p) for x in part}) for p in partitions(nodes))
    assert set(got) == set(nodes) and quality(rows, got) >= 0.9 * best  # a heuristic: near the best, not always it
    assert all(connected(rows, [x for x in got if got[x] == c]) and c == min(x for x in got if got[x] == c) for c in set(got.values()))


def test_no_less_than_label_propagation(spark, small):
    rows = nations(spark, small)
    found, other = graphs.leiden(rows), agents.label_propagation(rows, 3)
    assert graphs.modularity(rows, found) >= graphs.modularity(rows, other) - 1e-9
    pairs, got = [(r["a"], r["b"]) for r in rows.collect()], by_node(found)
    near: dict = {}
    for a, b in pairs:
        if got[a] == got[b]:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    for c in set(got.values()):  # from the community's smallest node all of it is reached
        seen, todo = set(), [c]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near.get(x, [])
        assert seen == {x for x in got if got[x] == c}


def test_nodes_of_one_neighbour_go_with_it_at_once(spark):
    rows = [(f"h{h}", f"x{h}{k:02}") for h in (0, 1) for k in range(20)] + [("h0", "h1"), ("p", "q"), ("p", "q"), ("z", "z"), ("h1", "h1")]
    got = by_node(graphs.leiden(frame(spark, rows), levels=1, rounds=0))
    assert got == {x: ("p" if x in "pq" else "z" if x == "z" else f"h{x[1]}") for e in rows for x in e}
    assert quality(rows, by_node(graphs.leiden(frame(spark, rows)))) >= quality(rows, got) - 1e-9
    goes, left = graphs._folded(graphs._both_ways(frame(spark, rows), 4), 4)
    assert goes.count() == 41 and left.agg(F.sum("w")).head()[0] == 2 * len(rows) and left.filter("a like 'x%' or b like 'x%'").isEmpty()
    above = by_node(graphs.leiden(frame(spark, rows), resolution=50.0))
    assert above["x000"] != above["h0"]  # beyond a resolution of 1 they may lose, so they are not folded


def test_odd_edges(spark):
    rows = spark.createDataFrame([("a", None), (None, None), ("a", "b"), ("b", "a"), ("c", "c")], "a string, b string")
    assert by_node(graphs.leiden(rows)) == {"a": "a", "b": "a", "c": "c"}
    assert graphs.leiden(rows.limit(0)).count() == 0 and graphs.modularity(rows.limit(0), rows.limit(0).select(F.col("a").alias("node"), F.col("b").alias("community"))) == 0.0
    assert {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame([(k,) for k in range(9)], "node long"), spark.createDataFrame([(8, 7), (7, 3), (1, 2), (5, 1)], "a long, b long")).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6, 7: 3, 8: 3}


def walked(rows, start, end, types, least, most, direction):
    steps = {(a, t, b) for a, t, b in rows if types is None or t in types}
    steps = {"out": steps, "in": {(b, t, a) for a, t, b in steps}, "any": steps | {(b, t, a) for a, t, b in steps}}[direction]
    out, front = [], [((x,), ()) for x in start]
    for hop in range(most + 1):
        out += [p for p in front if hop >= least and (end is None or p[0][-1] in end)]
        front = [((*nodes, b), (*kinds, t)) for nodes, kinds in front for a, t, b in steps if a == nodes[-1] and b not in nodes]
    return sorted(out)


@pytest.mark.parametrize("case", [(None, None, 1, 3, "out"), (None, ["x"], 0, 4, "any"), (["g", "a"], None, 1, 4, "any"), (["g"], None, 2, 5, "in"), ([str(x) for x in "abcdefg"], None, 1, 2, "out")])
def test_paths(spark, case):
    end, types, least, most, direction = case
    rnd = random.Random(7)
    rows = [(rnd.choice("abcdefg"), rnd.choice("xy"), rnd.choice("abcdefg")) for _ in range(16)] + [("a", "x", "a"), ("a", "x", "b"), ("a", "x", "b")]
    df = spark.createDataFrame([*rows, (None, "x", "a")], "a string, type string, b string").coalesce(1)
    nodes = lambda names: spark.createDataFrame([(x,) for x in names], "node string")
    got = graphs.paths(df, nodes(["a", "b"]), None if end is None else nodes(end), types, least, most, direction)
    assert sorted((tuple(r["nodes"]), tuple(r["types"])) for r in got.collect()) == walked(rows, ["a", "b"], end, types, least, most, direction)


def test_walks(spark):
    rnd = random.Random(3)
    rows = [(str(rnd.randrange(8)), str(rnd.randrange(8))) for _ in range(14)] + [("0", "1"), ("0", "1"), ("2", "2")]
    names = sorted({x for e in rows for x in e})
    w = np.zeros((len(names), len(names)))
    for a, b in rows:
        w[names.index(a), names.index(b)] += 1
        w[names.index(b), names.index(a)] += 1
    w /= w.sum(1)[:, None]
    anchors = [(1, names[0]), (1, names[2]), (2, names[1]), (2, "not there"), (3, "not there")]
    got = graphs.random_walk(frame(spark, rows), spark.createDataFrame(anchors, "query_id long, node string"), 5, 0.2)
    for q, own in ((1, [0, 2]), (2, [1])):
        home = np.zeros(len(names))
        home[own] = 1 / len(own)
        p = home
        for _ in range(5):
            p = 0.8 * p @ w + 0.2 * home
        mine = {r["node"]: r["p"] for r in got.filter(F.col("query_id") == q).collect()}
        assert np.allclose([mine.get(x, 0.0) for x in names], p) and abs(sum(mine.values()) - 1) < 1e-9
    assert got.filter("query_id = 3").isEmpty()


def test_tables_of_nodes_are_dealt_and_not_sent_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(graphs, "HUB", 10)
    rows = [(str(k), "hub") for k in range(30)] + [("hub", str(k)) for k in range(30)]
    both = graphs.salted(frame(spark, rows), 4).cache()
    assert both.filter("salt > 0 and b <> 'hub'").isEmpty() and not both.filter("salt > 0").isEmpty()
    labels = both.select("b").distinct().withColumn("label", F.col("b"))
    at = graphs.dealt(labels, both, 4)
    assert {r["b"]: r["count"] for r in at.groupBy("b").count().collect()} == {str(k): 1 for k in range(30)} | {"hub": 4}
    met = both.join(at, ["b", "salt"])
    assert met.count() == 60 and "SortMergeJoin [b" in met._jdf.queryExecution().executedPlan().toString()


def test_questions_of_the_same_anchors_share_a_walk(spark):
    rows = [(str(k), f"l{k % 3}") for k in range(30)]
    anchors = [(q, f"l{q % 3}") for q in range(60)] + [(q, x) for q in (70, 71, 72) for x in ("l0", "l1")] + [(71, "l1"), (72, "not there"), (80, "not there")]
    at, asked = graphs.shared_walks(frame(spark, rows), spark.createDataFrame(anchors, "query_id long, node string"), 3)
    assert {r["query_id"]: r["walk"] for r in asked.collect()} == {q: q % 3 for q in range(60)} | {q: 70 for q in (70, 71, 72)}
    assert at.select("walk").distinct().count() == 4 and at.count() <= 3 * 11 + 22
    best = graphs.best_of(at.select("walk", F.col("node").alias("id"), F.col("p").alias("score")), "walk", 2)
    assert sorted((r["walk"], r["id"]) for r in best.filter("walk < 3").collect()) == [(k, x) for k in range(3) for x in sorted([f"l{k}", {0: "0", 1: "1", 2: "11"}[k]])]
