"""Set arithmetic on arrays that keeps order and repeats, unlike ``array_except``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schemas import ATTRIBUTIONS


def _or_empty(names: Column) -> Column:
    return F.coalesce(names, F.array().cast("array<string>"))


def _lowered(names: Column) -> Column:
    return F.transform(_or_empty(names), lambda x: F.lower(x))


def missing(required: Column, confirmed: Column) -> Column:
    """What of ``required`` isn't in ``confirmed``; case is ignored, null counts as empty."""
    known = _lowered(confirmed)
    return F.filter(_or_empty(required), lambda x: ~F.array_contains(known, F.lower(x)))


def present(required: Column, confirmed: Column) -> Column:
    known = _lowered(confirmed)
    return F.filter(_or_empty(required), lambda x: F.array_contains(known, F.lower(x)))


def by_attribution(mentions: Column, attribution: str) -> Column:
    """Skill names of one class, in source order."""
    return F.transform(F.filter(mentions, lambda m: m["attribution"] == attribution), lambda m: m["skill"])


def attribution_columns(mentions: Column) -> list[Column]:
    return [by_attribution(mentions, name).alias(f"skills_{name}") for name in ATTRIBUTIONS]
