"""Ratios, rounding and binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Plain ratio, null on a zero denominator."""
    return F.try_divide(a, b)


def ratio_or_zero(a: Column, b: Column) -> Column:
    """ratio with 0 for a zero or missing denominator."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def sum_or_zero(c: Column) -> Column:
    """Sum that skips nulls and is 0 for a group without values."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def round4(c: Column) -> Column:
    """four decimals, ties to even."""
    return F.bround(c, 4)


def equal_width_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """right-closed equal-width bin 0..bins-1 over [lo, hi], both ends included."""
    width = (hi - lo) / F.lit(float(bins))
    raw = F.ceil(F.try_divide(v - lo, width)) - 1
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), raw)).cast("int")


def edge_bin(v: Column, edges: Column) -> Column:
    """right-closed bin over an array of rising edges; null outside (first, last]."""
    below = F.size(F.filter(edges, lambda e: e < v))
    return F.when((below > 0) & (below < F.size(edges)), below - 1)


def labelled_bin(v: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """label of the right-closed interval that holds the value; null outside."""
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        hit = (v > lo) & (v <= hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out
