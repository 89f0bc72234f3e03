"""Rounding of reported figures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Digits kept of a computed double before it is rounded for a report. What lies beyond
# depends on the order in which partitions were summed.
STABLE_DIGITS = 9


def reported(value: Column | str, digits: int) -> Column:
    """`value` rounded half up as a decimal number.

    Cutting the unstable digits first means a mean that falls exactly between two roundings
    is always rounded up, however the rows were partitioned.
    """
    return F.round(F.round(value, STABLE_DIGITS), digits)
