"""Scalar scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def efficiency_reward(success: Column, took: Column, expected: float) -> Column:
    """Half of the share of time saved by a successful, faster run; else 0."""
    return F.when(success & (took < expected), 0.5 * (1 - took / expected)).otherwise(F.lit(0.0))


def reward(success: Column, took: Column, expected: float, quality: Column, feedback: Column) -> Column:
    """Success or failure, efficiency, half the quality, feedback."""
    base = F.when(success, 1.0).otherwise(-1.0)
    return base + efficiency_reward(success, took, expected) + 0.5 * F.coalesce(quality, F.lit(0.0)) + F.coalesce(feedback, F.lit(0.0))


def relevance_of_signals(clicked: Column, dwell: Column, rating: Column, cited: Column) -> Column:
    """0.5, 0.3 for a click, dwell up to a half; a rating takes their place; 0.4 for a citation; clamped."""
    seen = 0.5 + F.when(clicked, 0.3).otherwise(0.0) + F.least(F.lit(0.5), F.coalesce(dwell, F.lit(0.0)) / 240)
    return clamp(F.coalesce(0.2 + rating * 0.8 * 0.8, seen) + F.when(cited, 0.4).otherwise(0.0))


def features_score(*features: tuple[Column, float]) -> Column:
    """The sum of the weights of true features."""
    out = F.lit(0.0)
    for condition, weight in features:
        out = out + F.when(F.coalesce(condition, F.lit(False)), weight).otherwise(0.0)
    return out


def content_plausibility(ic: Column) -> Column:
    return clamp((ic - 1) / 0.7)


def blend(a: Column, b: Column) -> Column:
    """The mean, or what is there."""
    return F.coalesce((a + b) / 2, a, b)


def remaining_ms(elapsed: Column, percent: Column) -> Column:
    """elapsed / (p / 100) - elapsed; 0 below five percent."""
    return F.when(percent >= 5, elapsed / (percent / 100.0) - elapsed).otherwise(F.lit(0.0))


def connectivity(ratio: Column, low: float, high: float) -> Column:
    """1 inside the benchmark's range, the share of it outside."""
    return F.when(ratio < low, ratio / low).when(ratio > high, high / ratio).otherwise(F.lit(1.0))


def model_size(gb: Column) -> Column:
    return F.when(gb < 5, "fast").when(gb < 20, "balanced").otherwise("quality")


def position(page: Column, total: Column) -> Column:
    """Start, middle or end of a document by quarters; unknown pages are in the middle."""
    return F.when(page.isNull() | total.isNull() | (total == 0), "middle").when(page < total * 0.25, "start").when(page > total * 0.75, "end").otherwise("middle")
