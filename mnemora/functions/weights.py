"""Strength of edges over time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.config import DEFAULT, GraphConfig
from mnemora.functions.dates import days_between, days_floored


def stability(reinforcements: Column, config: GraphConfig = DEFAULT) -> Column:
    return F.lit(1.0) + F.lit(config.reinforcement_boost) * F.ln(reinforcements + 1)


def current_weight(base: Column, reinforcements: Column, days: Column, config: GraphConfig = DEFAULT) -> Column:
    """Decayed weight; the stability is computed anew, a stored one plays no part."""
    return F.greatest(F.lit(0.0), base * F.exp(-(F.lit(config.decay_rate) * days) / stability(reinforcements, config)))


def edge_weight(now: Column, config: GraphConfig = DEFAULT) -> Column:
    """Of an edges row, at an instant."""
    return current_weight(F.col("base_weight"), F.col("reinforcement_count"), days_between(F.col("last_reinforced"), now), config)


def weight_at_date(at: Column, config: GraphConfig = DEFAULT) -> Column:
    """As views over time show it: by the stored stability, the base weight until the last reinforcement."""
    last = F.col("last_reinforced")
    shown = F.col("base_weight") * F.exp(-(F.lit(config.decay_rate) * days_floored(at, last)) / F.col("stability"))
    return F.when(at <= last, F.col("base_weight")).otherwise(F.greatest(F.lit(0.0), shown))


def days_until_dormant(base: Column, reinforcements: Column, days: Column, config: GraphConfig = DEFAULT) -> Column:
    left = stability(reinforcements, config) / config.decay_rate * F.ln(base / config.visibility_threshold) - days
    return F.when(base > 0, F.round(F.greatest(F.lit(0.0), left))).otherwise(F.lit(0.0)).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def node_size(degree: Column, mentions: Column) -> Column:
    return F.least(F.lit(18.0), F.lit(3.0) + 1.5 * F.log2(degree + 1.0) + 0.8 * F.log2(mentions + 1.0))


def node_opacity(strongest: Column) -> Column:
    return F.lit(0.3) + F.least(strongest, F.lit(1.0)) * 0.7


def edge_width(weight: Column, base: Column, thin: float = 0.3, thick: float = 2.5) -> Column:
    """Between two widths by the part of its base weight that an edge has left."""
    left = F.when(base > 0, weight / base).otherwise(F.lit(0.0))
    return F.lit(thin) + (thick - thin) * F.least(left, F.lit(1.0))


def depth(days: Column) -> Column:
    """The place on the time axis of a view: two units back for each day."""
    return -2.0 * days


def origin_factor(private_nodes: Column, configured: float = 0.6) -> Column:
    return F.when(private_nodes < 50, 0.9).when(private_nodes < 100, 0.75).otherwise(configured)
