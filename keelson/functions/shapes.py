"""Scores of what a column can be, from its name and its distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import CONTINUOUS, TEMPORAL, ColumnEvidence
from . import names

# Least scores.
MEASURE, GRAIN, DESCRIPTIVE, LOOKUP = 0.4, 0.5, 0.35, 0.5


def _unit(x: float) -> float:
    return min(max(x, 0.0), 1.0)


def measure_score(c: ColumnEvidence) -> float:
    """Numeric spread decides; a name only adds to it."""
    named = names.measure_like(c.column)
    never = (
        c.distinct <= 1 or not c.numeric or names.time_like(c.column) or names.place_like(c.column)
        or names.key_like(c.column) or names.grain_like(c.column)
        or (c.kind != CONTINUOUS and c.uniqueness >= 0.95 and not named)
        or (c.distinct <= 2 and c.entropy_ratio <= 0 and c.variation <= 0)
    )
    if never:
        return 0.0
    base = 0.3 if c.kind == CONTINUOUS else 0.1
    spread = 0.15 * _unit(1 - c.uniqueness) + 0.2 * _unit(c.entropy_ratio) + 0.3 * _unit(c.variation)
    return min(base + spread + 0.1 * (c.distinct >= 3) + 0.15 * named, 1.0)


def is_measure(c: ColumnEvidence) -> bool:
    return measure_score(c) >= MEASURE


def grain_score(c: ColumnEvidence) -> float:
    if c.null_ratio > 0.2 or c.distinct <= 1 or is_measure(c):
        return 0.0
    named = names.key_like(c.column) or names.grain_like(c.column)
    timed = c.kind == TEMPORAL or names.time_like(c.column)
    return min(0.6 * named + 0.55 * timed + 0.55 * (c.uniqueness >= 0.95), 1.0)


def is_grain(c: ColumnEvidence) -> bool:
    return grain_score(c) >= GRAIN


def descriptive_score(c: ColumnEvidence) -> float:
    place = names.place_like(c.column)
    never = (
        (c.distinct <= 1 and not place) or names.key_like(c.column) or names.grain_like(c.column)
        or c.kind == TEMPORAL or names.time_like(c.column) or is_measure(c) or c.uniqueness >= 0.95
    )
    return 0.0 if never else min(0.35 + 0.25 * max(0.0, 1 - c.uniqueness) + 0.15 * place, 1.0)


def is_descriptive(c: ColumnEvidence) -> bool:
    return descriptive_score(c) >= DESCRIPTIVE


def lookup_score(c: ColumnEvidence) -> float:
    never = (
        c.null_ratio > 0.05 or c.distinct <= 1 or c.kind == TEMPORAL or names.time_like(c.column)
        or is_measure(c) or names.grain_like(c.column)
    )
    if never:
        return 0.0
    return min(0.55 * names.key_like(c.column) + 0.25 * (0.01 <= c.uniqueness < 0.95) + 0.25 * _unit(c.identifiability), 1.0)


def is_lookup_key(c: ColumnEvidence) -> bool:
    return lookup_score(c) >= LOOKUP


# -- the same over a profile DataFrame --------------------------------------

def _one(flag: Column) -> Column:
    return flag.cast("double")


def _unit_col(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def shape_columns(profile: str = "") -> dict[str, Column]:
    """measure_score, grain_score, descriptive_score, lookup_score of the rows of a profile."""
    c = lambda n: F.col(f"{profile}{n}")
    name, kind, zero = c("column_name"), c("kind"), F.lit(0.0)
    key, grain, place = names.key_like_col(name), names.grain_like_col(name), names.place_like_col(name)
    timed, named = names.time_like_col(name), names.measure_like_col(name)
    distinct, unique = c("distinct_count"), c("uniqueness_ratio")
    never = (
        (distinct <= 1) | ~kind.isin("integer", "continuous") | timed | place | key | grain
        | ((kind != CONTINUOUS) & (unique >= 0.95) & ~named)
        | ((distinct <= 2) & (c("entropy_ratio") <= 0) & (c("variation_coefficient") <= 0))
    )
    measure = F.when(never, zero).otherwise(F.least(
        F.when(kind == CONTINUOUS, 0.3).otherwise(0.1) + (0.15 * _unit_col(1 - unique) + 0.2 * _unit_col(c("entropy_ratio"))
        + 0.3 * _unit_col(c("variation_coefficient"))) + 0.1 * _one(distinct >= 3) + 0.15 * _one(named), F.lit(1.0)))
    is_m, is_time = measure >= MEASURE, (kind == TEMPORAL) | timed
    grain_s = F.when((c("null_ratio") > 0.2) | (distinct <= 1) | is_m, zero).otherwise(
        F.least(0.6 * _one(key | grain) + 0.55 * _one(is_time) + 0.55 * _one(unique >= 0.95), F.lit(1.0)))
    descriptive = F.when(((distinct <= 1) & ~place) | key | grain | is_time | is_m | (unique >= 0.95), zero).otherwise(
        F.least(0.35 + 0.25 * F.greatest(zero, 1 - unique) + 0.15 * _one(place), F.lit(1.0)))
    lookup = F.when((c("null_ratio") > 0.05) | (distinct <= 1) | is_time | is_m | grain, zero).otherwise(
        F.least(0.55 * _one(key) + 0.25 * _one((unique >= 0.01) & (unique < 0.95)) + 0.25 * _unit_col(c("identifiability_score")), F.lit(1.0)))
    return {"measure_score": measure, "grain_score": grain_s, "descriptive_score": descriptive, "lookup_score": lookup}
