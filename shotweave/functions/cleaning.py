"""Validity and cleaning of entity strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotweave.functions.text import strip, words

# Reject codes and limits of the cleaning step, checked in this order.
NULL_ENTITY, TOO_SMALL, TOO_LIGHT, TOO_HEAVY, KEPT = -1, -2, -3, -4, 0
MIN_SIZE, MIN_WEIGHT, MAX_WEIGHT = 2, 50, 900


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def is_valid(text: Column, brackets: str = "()", min_tokens: int = 1) -> Column:
    """Non-null, at least ``min_tokens`` tokens, and as many opening as closing brackets."""
    opening, closing = brackets
    return (
        text.isNotNull()
        & (F.size(words(text)) >= min_tokens)
        & (occurrences(text, opening) == occurrences(text, closing))
    )


def component_size(component: Column) -> Column:
    return F.size(words(component))


def largest_component(text: Column, separator: str = ".") -> Column:
    """Largest part between separators as ``struct(size, component)``; the first one on ties.

    Blank parts are dropped. NULL if no part is left.
    """
    parts = F.filter(F.split(text, F.lit(f"\\Q{separator}\\E")), lambda p: strip(p) != "")
    sized = F.transform(
        parts, lambda p, i: F.struct(component_size(p).alias("size"), (-i).alias("back"), strip(p).alias("component"))
    )
    best = F.array_max(sized)
    return F.when(best.isNotNull(), F.struct(best["size"].alias("size"), best["component"].alias("component")))


def reject_reason(entity: Column, size: Column, weight: Column, min_size: int = MIN_SIZE,
                  min_weight: float = MIN_WEIGHT, max_weight: float = MAX_WEIGHT) -> Column:
    """Reject code of an entity, ``0`` if it is kept. The first failing check decides."""
    return (
        F.when(entity.isNull(), NULL_ENTITY)
        .when(F.coalesce(size, F.lit(0)) <= min_size, TOO_SMALL)
        .when(weight < min_weight, TOO_LIGHT)
        .when(weight > max_weight, TOO_HEAVY)
        .otherwise(KEPT)
    )
