"""Score formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geneweft.config import FunctionalConfig, KineticConfig, ViabilityConfig


def sigmoid_on(value: Column, threshold: float, slope: float = 0.01) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-slope) * (value - F.lit(threshold))))


def sigmoid_off(value: Column, threshold: float, slope: float = 0.01) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(slope) * (value - F.lit(threshold))))


def compliance_term(value: Column, expected: Column, cfg: FunctionalConfig) -> Column:
    """Per-state agreement with the truth table; null (skipped) for anything but 0 and 1."""
    return F.when(expected == 1, sigmoid_on(value, cfg.on)).when(expected == 0, sigmoid_off(value, cfg.off))


def fold_ratio(min_on: Column, max_off: Column) -> Column:
    return min_on / (max_off + F.lit(1e-6))


def fc_score(fc: Column, two_sided: Column, cfg: FunctionalConfig) -> Column:
    powered = F.pow(fc, F.lit(cfg.n_hill))
    return F.when(
        two_sided, F.lit(100.0) * powered / (F.lit(cfg.k_ideal**cfg.n_hill) + powered)
    ).otherwise(F.lit(0.0))


def margin_score(min_on: Column, max_off: Column, n_on: Column, n_off: Column, cfg: FunctionalConfig) -> Column:
    headroom = F.greatest(F.lit(0.0), min_on - F.lit(cfg.on))
    on_part = F.when(n_on > 0, F.lit(50.0) * (F.lit(1.0) - F.exp(F.lit(-0.001) * headroom))).otherwise(F.lit(0.0))
    off_part = F.when(n_off > 0, F.lit(50.0) * F.exp(F.lit(-0.02) * max_off)).otherwise(F.lit(0.0))
    return on_part + off_part


def retention(fc_mean: Column, fc_std: Column, cfg: KineticConfig) -> Column:
    return F.exp(F.lit(-cfg.k_cv) * variation(fc_mean, fc_std)) * F.least(F.lit(1.0), fc_mean / F.lit(cfg.fc_ideal))


def variation(fc_mean: Column, fc_std: Column) -> Column:
    return F.when(fc_mean > 0, fc_std / fc_mean).otherwise(F.lit(0.0))


def temporal_score(rise: Column, cfg: KineticConfig) -> Column:
    return F.exp(F.lit(-math.log(2.0) / max(cfg.t_target, 1e-6)) * rise)


def burden_penalty(burden: Column, cfg: KineticConfig) -> Column:
    exponent = F.lit(cfg.k_burden) * (burden - F.lit(cfg.limit_soft))
    clipped = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), exponent))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(clipped))


def ockham(nodes: Column, edges: Column) -> Column:
    complexity = nodes + F.lit(0.5) * edges - F.lit(5.5)
    return F.exp(F.lit(-0.1) * F.greatest(F.lit(0.0), complexity))


def repeat_penalty(repeats: Column) -> Column:
    return F.pow(F.lit(0.6), repeats.cast("double"))


def rating(score: Column, cfg: ViabilityConfig = ViabilityConfig()) -> Column:
    return (
        F.when(score >= cfg.excellent, F.lit("Excellent"))
        .when(score >= cfg.passing, F.lit("Pass"))
        .otherwise(F.lit("Fail"))
    )
