"""Levels, ratios, similarity and priority columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake import constants as K


def level_for_score(score: Column) -> Column:
    return reduce(lambda w, f: w.when(score >= f[0], f[1]), K.LEVEL_FLOORS[1:], F.when(score >= K.LEVEL_FLOORS[0][0], K.LEVEL_FLOORS[0][1])).otherwise("watch")


def level_with_thresholds(score: Column, watch: Column, low: Column, medium: Column) -> Column:
    return F.when(score <= watch, "watch").when(score <= low, "low").when(score <= medium, "medium").otherwise("high")


def level_rank(level: Column) -> Column:
    """0 for watch to 3 for high, -1 for others."""
    return reduce(lambda w, x: w.when(level == x[1], x[0]), list(enumerate(K.LEVELS))[1:], F.when(level == "watch", 0)).otherwise(-1)


def recency(published: Column, cutoff: Column) -> Column:
    hours = F.greatest(F.lit(0.0), (F.unix_micros(cutoff.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 3.6e9)
    return reduce(lambda w, r: w.when(hours <= r[0], r[1]), K.RECENCY[1:], F.when(hours <= K.RECENCY[0][0], K.RECENCY[0][1])).otherwise(0)


def corroboration(domains: Column) -> Column:
    return F.when(domains >= 4, 30).when(domains == 3, 22).when(domains == 2, 15).otherwise(0)


def tier_weight(tier: Column) -> Column:
    pairs = list(K.SOURCE_TIERS.items())
    return reduce(lambda w, p: w.when(tier == p[0], p[1]), pairs[1:], F.when(tier == pairs[0][0], pairs[0][1])).otherwise(0)


def relevance(region_hit: Column, platform_hit: Column, product_hit: Column, no_products: Column) -> Column:
    """8 for the region, 6 for the platform, 6 for a product or 3 where none is asked for; 20 at most."""
    return F.least(F.lit(20), F.when(region_hit, 8).otherwise(0) + F.when(platform_hit, 6).otherwise(0) + F.when(product_hit, 6).when(no_products, 3).otherwise(0))


def ratio(n: Column, d: Column) -> Column:
    """Rounded to four places; null without a denominator."""
    return F.round(F.try_divide(n.cast("double"), d.cast("double")), 4)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(F.round(2 * precision * recall / (precision + recall), 4))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; null only if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), None).otherwise(both / (F.size(a) + F.size(b) - both))


def confidence(score: Column, threshold: float) -> Column:
    return F.when(score >= 0.95, "high").when(score >= threshold, "medium").otherwise("low")


def agreement(a: Column, b: Column) -> Column:
    """1 for equal levels, less by a third for each step between."""
    return 1 - F.abs(level_rank(a) - level_rank(b)) / F.lit(3)


def weighted(parts: dict[str, tuple[float, Column]]) -> Column:
    """Mean by weight of the parts that are not null, added in the given order; 0 if all are null."""
    total = top = F.lit(0.0)
    for weight, value in parts.values():
        total = total + F.when(value.isNotNull(), F.lit(weight)).otherwise(0.0)
        top = top + F.coalesce(F.lit(weight) * value, F.lit(0.0))
    return F.when(total > 0, top / total).otherwise(0.0)


def dashboard_priority(depth: Column, missing: Column, conditional: Column, no_public: Column, bad_states: Column) -> Column:
    base = F.when(depth == "full", 0).when(depth == "hybrid", 40).otherwise(70)
    return F.least(F.lit(100), base + 20 * missing + 10 * conditional + F.when(no_public, 15).otherwise(0) + 10 * bad_states)


def source_depth(types: Column, all_verified: Column, verified_public: Column) -> Column:
    return F.when((types >= 3) & all_verified & (verified_public >= 1), "full").when(types >= 2, "hybrid").otherwise("constrained")


def numeric_delta(current: Column, previous: Column) -> Column:
    return F.round(current.cast("double") - previous.cast("double"), 4)
