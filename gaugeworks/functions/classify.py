"""Classes and flags.  Priority rules are ordered ``CASE`` expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_matching(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """Value of the first rule that holds."""
    case = None
    for test, value in rules:
        case = F.when(test, F.lit(value)) if case is None else case.when(test, F.lit(value))
    return case.otherwise(F.lit(otherwise)) if case is not None else F.lit(otherwise)


def bitmask(flags: Sequence[tuple[Column, int]]) -> Column:
    """Sum of the bits whose flag is true; null flags are false."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(c, F.lit(bit)).otherwise(F.lit(0)) for c, bit in flags))


def tags(rules: Sequence[tuple[Column, str]]) -> Column:
    """All labels whose rule holds, in rule order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(v)) for c, v in rules))))


def band(x: Column, edges: Sequence[float], null_as_zero: bool = False) -> Column:
    """Index of the half-open bin [edge, next edge); the last is open; null below the first edge."""
    v = F.coalesce(x, F.lit(0)) if null_as_zero else x
    case = F.when(v.isNull() | (v < edges[0]), F.lit(None).cast("int"))
    for i, hi in enumerate(edges[1:]):
        case = case.when(v < hi, F.lit(i))
    return case.otherwise(F.lit(len(edges) - 1))


def season(month: Column) -> Column:
    """Meteorological season of a month number."""
    return first_matching([(month.isin(12, 1, 2), "winter"), (month.isin(3, 4, 5), "spring"), (month.isin(6, 7, 8), "summer"), (month.isin(9, 10, 11), "fall")])


def assistance_state(program: Column, registrations: Column, amount: Column) -> Column:
    """Survivor assistance of a county: awards, program without awards, designation only, or contradictory."""
    amount, registrations = F.coalesce(amount, F.lit(0)), F.coalesce(registrations, F.lit(0))
    return first_matching(
        [
            (program & (amount > 0), "IHP_WITH_AWARDS"),
            (program & (registrations > 0), "IHP_NO_AWARDS"),
            (program, "IA_ONLY"),
            ((amount > 0) | (registrations > 0), "IA_ONLY_ANOMALY"),
        ],
        "NONE",
    )


def freshness(age_days: Column, cadence_days: Column) -> Column:
    """fresh, aging, stale, static (no cadence) or unknown (no age)."""
    grace = cadence_days + F.greatest(cadence_days, F.lit(7))
    return first_matching([(cadence_days.isNull(), "static"), (age_days.isNull(), "unknown"), (age_days <= grace, "fresh"), (age_days <= 5 * cadence_days, "aging")], "stale")
