"""Reinforcement- and preference-learning quantities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clipped_surrogate(logp: Column, logp_old: Column, advantage: Column, epsilon: float = 0.2) -> Column:
    """min(ratio A, clip(ratio) A) of proximal policy optimisation."""
    ratio = F.exp(logp - logp_old)
    held = F.least(F.greatest(ratio, F.lit(1 - epsilon)), F.lit(1 + epsilon))
    return F.least(ratio * advantage, held * advantage)


def composite(clip: Column, value_loss: Column, entropy: Column, c1: float = 0.5, c2: float = 0.01) -> Column:
    """CLIP - c1 VF + c2 entropy; c1 and c2 are our defaults, the text leaves them open."""
    return clip - c1 * value_loss + c2 * entropy


def bradley_terry(better: Column, worse: Column) -> Column:
    return sigmoid(better - worse)


def reward_nll(better: Column, worse: Column) -> Column:
    return softplus(worse - better)


def dpo(logp_w: Column, logp_l: Column, ref_w: Column, ref_l: Column, beta: float = 0.1) -> Column:
    """Direct preference loss of a pair."""
    return softplus(-beta * ((logp_w - ref_w) - (logp_l - ref_l)))


def kto(log_ratio: Column, desirable: Column, z0: Column, beta: float = 0.1, w_good: float = 1.0, w_bad: float = 1.0) -> Column:
    """w (1 - v) with v the sigmoid of +-beta (log ratio - z0); our stated choice of weights and value function."""
    return F.when(desirable, w_good * (1 - sigmoid(beta * (log_ratio - z0)))).otherwise(w_bad * (1 - sigmoid(beta * (z0 - log_ratio))))


def kl_token(logp: Column, ref: Column) -> Column:
    """rho - ln rho - 1 with rho = reference / policy; never negative."""
    return F.exp(ref - logp) - (ref - logp) - 1


def group_advantage(reward: Column, mean: Column, variance: Column, epsilon: float = 1e-8) -> Column:
    """Reward against its group, epsilon under the root."""
    return (reward - mean) / F.sqrt(variance + epsilon)
