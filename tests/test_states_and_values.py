"""State as of a version, values to convergence, percentiles by rank: against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import agents, learning, telemetry


def test_state_as_of_a_version(spark):
    """A key with most of the deltas, nulls everywhere, versions before, between and after."""
    rnd = random.Random(2)
    deltas = [(rnd.choice([None, 1, 1, 1, 1, 2, 3]), rnd.choice([None, *range(-5, 60)]), rnd.choice([None, rnd.randrange(99)]), rnd.choice([None, "x", "y"])) for _ in range(400)]
    asked = [(k, v, f"q{k}{v}") for k in (None, 1, 2, 9) for v in (None, -9, -5, 0, 3, 4, 30, 31, 500)] + [(1, 4, "again")]
    got = agents.state_at(spark.createDataFrame(deltas, "key long, n long, a long, b string"), spark.createDataFrame(asked, "key long, n long, kind string"), "key", "n", ["a", "b"], width=4)
    want = []
    for k, v, name in asked:
        row = [k, v, name]
        for f in (2, 3):
            found = [(d[1], d[f]) for d in deltas if d[0] == k and d[1] is not None and v is not None and d[1] <= v and d[f] is not None]
            row.append(max(found)[1] if found else None)
        want.append(tuple(row))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_hot_key_is_many_groups(spark):
    deltas = spark.range(20_000).select(F.lit(1).alias("key"), F.col("id").alias("n"), (F.col("id") % 7).alias("a"))
    got = agents.state_at(deltas, spark.createDataFrame([(1, 12_345), (1, 10**6)], "key int, n long"), "key", "n", ["a"], width=100)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 12_345, 12_345 % 7), (1, 10**6, 19_999 % 7)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("range" in line for line in plan.split("\n") if "Window" in line)


@pytest.fixture(scope="module")
def process(spark):
    """A random decision process: states 0 to 11, two actions, and its arrays."""
    rnd = np.random.default_rng(4)
    p, r = rnd.random((12, 2, 12)) ** 3, rnd.normal(size=(12, 2, 12))
    p /= p.sum(2, keepdims=True)
    rows = [(s, a, t, float(p[s, a, t]), float(r[s, a, t])) for s in range(12) for a in range(2) for t in range(12)]
    return spark.createDataFrame(rows, "s int, a int, s2 int, p double, r double").coalesce(1).cache(), p, r


@pytest.mark.parametrize("gamma", [0.0, 0.6])
def test_values_are_within_the_bound(spark, process, gamma):
    df, p, r = process
    reward = (p * r).sum(2)
    pi = np.array([[0.25, 0.75]] * 12)
    # Under a policy the values solve a linear system.
    want = np.linalg.solve(np.eye(12) - gamma * np.einsum("sa,sat->st", pi, p), (pi * reward).sum(1))
    policy = spark.createDataFrame([(s, a, float(pi[s, a])) for s in range(12) for a in range(2)], "s int, a int, pi double")
    values, bound, sweeps = learning.policy_values(df, policy, gamma, 1e-3)
    got = np.array([r["v"] for r in values.orderBy("s").collect()])
    assert bound <= 1e-3 and np.abs(got - want).max() <= bound + 1e-12 and sweeps < 40
    # The best policy's values are a fixed point: solve for the greedy policy and check that it is optimal.
    values, bound, _ = learning.optimal_values(df, gamma, 1e-3)
    best = {r["s"]: r["a"] for r in learning.greedy_policy(df, values, gamma).collect()}
    chosen = np.array([best[s] for s in range(12)])
    exact = np.linalg.solve(np.eye(12) - gamma * p[np.arange(12), chosen], reward[np.arange(12), chosen])
    assert (exact >= (reward + gamma * p @ exact).max(1) - 1e-9).all()
    assert np.abs(np.array([r["v"] for r in values.orderBy("s").collect()]) - exact).max() <= bound + 1e-12


def test_few_sweeps_say_how_far_they_are(spark, process):
    _, bound, sweeps = learning.optimal_values(process[0], 0.9, 1e-9, most=2)
    assert sweeps == 2 and bound > 1e-9
    with pytest.raises(ValueError):
        learning.optimal_values(process[0], 1.0)
    assert learning.optimal_values(process[0].limit(0), 0.5)[0].count() == 0


def test_one_time_is_many_slices(spark):
    """All rows of one key at one time: slices by rank, and the percentiles of a plain frame."""
    df = spark.range(30_000).select(F.lit(None).cast("string").alias("k0"), F.lit(5).alias("time"), F.col("id").alias("n"), F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 13 == 0, float("nan")).otherwise((F.col("id") * 7919) % 1000).cast("double").alias("value"), F.lit("x").alias("slice"))
    got = telemetry.rolling_percentiles_split(df, ["k0"], "time", "n", "value", size=50, rows=2_000).orderBy("n").collect()
    assert len(got) == 30_000 and got[0].__fields__ == [*df.columns, "p50", "p99"]
    values = [r["value"] for r in got]
    for k in [0, 1, 2, 49, 50, 51, *range(1900, 2100), *range(15_000, 30_000, 37)]:
        frame = [v for v in values[max(0, k - 49) : k + 1] if v is not None and v == v]
        want = tuple(np.percentile(frame, q) for q in (50, 99)) if frame else (None, None)
        assert (got[k]["p50"], got[k]["p99"]) == pytest.approx(want) if frame else (got[k]["p50"], got[k]["p99"]) == want
    from quern.session import shared_dir

    staged = sorted(p for p in __import__("pathlib").Path(shared_dir(spark).removeprefix("file://")).glob("quern-rolling-slices-*"))
    assert spark.read.parquet(f"file://{max(staged, key=lambda p: p.stat().st_mtime)}").count() >= 15
