"""Trajectory, preference and Markov-decision operators on tables of steps, pairs and transitions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import rl
from quern.operators.fold import ordered_fold
from quern.session import stage


@dataclass(frozen=True)
class Discounted:
    """Running sum of rewards seen from the end: G = r + gamma G."""

    gamma: float
    name: str = "g"

    @property
    def outputs(self) -> tuple:
        return ((self.name, "double"),)

    def start(self) -> tuple:
        return (0.0,)

    def step(self, state: tuple, reward: float) -> tuple[tuple, tuple]:
        g = reward + self.gamma * state[0]
        return (g,), (g,)


@dataclass(frozen=True)
class Carry:
    """What a block's last step sees of the blocks after it: their discounted return, block by block from the end."""

    gamma: float
    outputs = (("carry_", "double"),)

    def start(self) -> tuple:
        return (0.0,)

    def step(self, state: tuple, own: float, steps: int) -> tuple[tuple, tuple]:
        return (own + self.gamma**steps * state[0],), (state[0],)


def discounted(steps: DataFrame, value: str, out: str, traj: str, t: str, gamma: float, block: int = 512) -> DataFrame:
    """``steps`` plus ``out``: per step, ``value`` plus gamma times what the next step has.

    A trajectory is cut by its step numbers into blocks. Within a block the sum is
    a window in the engine; per block one row, its sum and length, is folded from
    the end on; a step adds what is carried into its block, discounted by its
    distance. So a long trajectory is many tasks' work, and only its blocks meet
    in one. Null values count 0.
    """
    if gamma == 0:
        return steps.withColumn(out, F.coalesce(F.col(value), F.lit(0.0)))
    # Powers within a block must not leave the range of doubles.
    size = max(1, min(block, int(200 / -math.log(gamma)))) if 0 < gamma < 1 else block
    cut = steps.withColumn("block_", F.floor(F.col(t) / size))
    back = Window.partitionBy(traj, "block_").orderBy(F.desc(t))
    cut = cut.withColumn("left_", F.row_number().over(back))  # steps from here to the block's end, this one included
    power = lambda n: F.pow(F.lit(float(gamma)), n)
    # Weights grow towards the block's end by negative powers, so that nearer steps weigh more.
    local = F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0)) * power(-F.col("left_"))).over(back.rowsBetween(Window.unboundedPreceding, 0)) * power(F.col("left_"))
    cut = cut.withColumn("local_", local)
    heads = cut.groupBy(traj, "block_").agg(F.max_by("local_", "left_").alias("own_"), F.max("left_").alias("steps_")).withColumn("order_", -F.col("block_"))
    carried = ordered_fold(heads, [traj], ["order_"], Carry(gamma), ["own_", "steps_"]).select(F.col(traj).alias("traj_"), F.col("block_").alias("b_"), "carry_")
    joined = cut.join(carried, F.col(traj).eqNullSafe(F.col("traj_")) & F.col("block_").eqNullSafe(F.col("b_")))
    return joined.withColumn(out, F.col("local_") + power(F.col("left_")) * F.col("carry_")).select(*steps.columns, out)


def discounted_return(steps: DataFrame, traj: str = "traj", t: str = "t", gamma: float = 0.99) -> DataFrame:
    """``steps`` plus g, the discounted return from each step on."""
    return discounted(steps, "reward", "g", traj, t, gamma)


def td_error(steps: DataFrame, traj: str = "traj", t: str = "t", gamma: float = 0.99) -> DataFrame:
    """``steps`` plus delta = r + gamma V(next) - V; the value after the last step is 0."""
    following = F.lead("v", 1, 0.0).over(Window.partitionBy(traj).orderBy(t))
    return steps.withColumn("delta", F.col("reward") + gamma * following - F.col("v"))


def gae(steps: DataFrame, traj: str = "traj", t: str = "t", gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """``steps`` plus delta and gae, the (gamma lambda)-discounted sum of later deltas."""
    return discounted(td_error(steps, traj, t, gamma), "delta", "gae", traj, t, gamma * lam)


def advantage(q: Column, v: Column) -> Column:
    """How much better an action is than its state: A = Q - V."""
    return q - v


def group_advantages(rollouts: DataFrame, group: str = "prompt", epsilon: float = 1e-8) -> DataFrame:
    """``rollouts`` plus adv. Group moments are aggregated first and joined, so a large group is not one task's work."""
    moments = rollouts.groupBy(group).agg(F.avg("reward").alias("__mean"), F.var_pop("reward").alias("__var"))
    return rollouts.join(moments, group).withColumn("adv", rl.group_advantage(F.col("reward"), F.col("__mean"), F.col("__var"), epsilon)).drop("__mean", "__var")


def grpo_objective(tokens: DataFrame, epsilon: float = 0.2, beta: float = 0.04) -> DataFrame:
    """objective per prompt: mean over outputs of the mean over their tokens; ``tokens`` has prompt, output, adv, logp, logp_old, ref."""
    per = rl.clipped_surrogate(F.col("logp"), F.col("logp_old"), F.col("adv"), epsilon) - beta * rl.kl_token(F.col("logp"), F.col("ref"))
    outputs = tokens.groupBy("prompt", "output").agg(F.avg(per).alias("o"))
    return outputs.groupBy("prompt").agg(F.avg("o").alias("objective"))


def closed_form_policy(choices: DataFrame, beta: float = 1.0) -> DataFrame:
    """``choices`` (x, y, ref, r) plus policy, proportional to ref exp(r / beta) within x; the greatest reward is taken out first."""
    top = choices.groupBy("x").agg(F.max("r").alias("__top"))
    rows = choices.join(top, "x").withColumn("__w", F.col("ref") * F.exp((F.col("r") - F.col("__top")) / beta))
    total = rows.groupBy("x").agg(F.sum("__w").alias("__z"))
    return rows.join(total, "x").withColumn("policy", F.col("__w") / F.col("__z")).drop("__top", "__w", "__z")


def action_values(transitions: DataFrame, values: DataFrame, gamma: float) -> DataFrame:
    """s, a, q of one sweep: expected reward plus discounted value of the next state."""
    known = values.select(F.col("s").alias("s2"), F.col("v").alias("v2"))
    rows = transitions.join(known, "s2", "left")
    return rows.groupBy("s", "a").agg(F.sum(F.col("p") * (F.col("r") + gamma * F.coalesce("v2", F.lit(0.0)))).alias("q"))


def value_iteration(transitions: DataFrame, sweeps: int = 10, gamma: float = 0.9) -> DataFrame:
    """s, v after ``sweeps`` optimality sweeps from 0."""
    values = transitions.select("s").distinct().withColumn("v", F.lit(0.0))
    for _ in range(sweeps):
        values = action_values(transitions, values, gamma).groupBy("s").agg(F.max("q").alias("v"))
    return values


def _converged(spark, start: DataFrame, sweep, gamma: float, tolerance: float, most: int) -> tuple[DataFrame, float, int]:
    """Sweeps until the values are within ``tolerance`` of the fixed point, by the contraction: gamma / (1 - gamma) times the last change bounds the distance."""
    if not 0 <= gamma < 1 or tolerance <= 0:
        raise ValueError("gamma lies in [0, 1), and the tolerance is above 0")
    values, bound = stage(spark, start, "values-0"), float("inf")
    for k in range(1, most + 1):
        both = sweep(values).join(values.select(F.col("s").alias("s_"), F.col("v").alias("before")), F.col("s") == F.col("s_"), "left")
        both = stage(spark, both.select("s", "v", F.coalesce("before", F.lit(0.0)).alias("before")), f"values-{k}")
        change = both.agg(F.coalesce(F.max(F.abs(F.col("v") - F.col("before"))), F.lit(0.0))).head()[0]
        values, bound = both.select("s", "v"), change * gamma / (1 - gamma)
        if bound <= tolerance:
            return values, bound, k
    return values, bound, most


def optimal_values(transitions: DataFrame, gamma: float = 0.9, tolerance: float = 1e-6, most: int = 1000) -> tuple[DataFrame, float, int]:
    """s, v of the best policy, a bound on the greatest error of any v, and the sweeps it took; ``transitions`` has s, a, s2, p, r.

    Each sweep is written, so a plan holds one. States without transitions have the value 0.
    """
    start = transitions.select("s").distinct().withColumn("v", F.lit(0.0))
    return _converged(transitions.sparkSession, start, lambda v: action_values(transitions, v, gamma).groupBy("s").agg(F.max("q").alias("v")), gamma, tolerance, most)


def policy_values(transitions: DataFrame, policy: DataFrame, gamma: float = 0.9, tolerance: float = 1e-6, most: int = 1000) -> tuple[DataFrame, float, int]:
    """s, v under ``policy`` (s, a, pi), with the bound and the sweeps."""
    start = transitions.select("s").distinct().withColumn("v", F.lit(0.0))

    def sweep(values: DataFrame) -> DataFrame:
        q = action_values(transitions, values, gamma)
        return q.join(policy, ["s", "a"]).groupBy("s").agg(F.sum(F.col("pi") * F.col("q")).alias("v"))

    return _converged(transitions.sparkSession, start, sweep, gamma, tolerance, most)


def greedy_policy(transitions: DataFrame, values: DataFrame, gamma: float = 0.9) -> DataFrame:
    """s, a, q: the action of greatest value in each state, to nine digits; ties to the smaller action."""
    q = action_values(transitions, values, gamma)
    return q.groupBy("s").agg(F.min_by(F.struct("a", "q"), F.struct(-F.round("q", 9), "a")).alias("best")).select("s", "best.a", "best.q")


def policy_evaluation(transitions: DataFrame, policy: DataFrame, sweeps: int = 10, gamma: float = 0.9) -> DataFrame:
    """s, v after ``sweeps`` expectation sweeps under ``policy`` (s, a, pi)."""
    values = transitions.select("s").distinct().withColumn("v", F.lit(0.0))
    for _ in range(sweeps):
        q = action_values(transitions, values, gamma)
        values = q.join(policy, ["s", "a"]).groupBy("s").agg(F.sum(F.col("pi") * F.col("q")).alias("v"))
    return values
