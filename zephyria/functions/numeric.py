"""Numeric column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARD_DIGITS = 9


def _half_even(c: Column, digits: int) -> Column:
    # rint on the scaled value is what array libraries call "round"; F.round is
    # half-up and F.bround works on the decimal expansion, and both differ from it.
    # Adding 0.0 turns a negative zero into a plain zero.
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def guard(c: Column) -> Column:
    """Drop the last bits, which depend on the order in which tasks add floats."""
    return _half_even(c, GUARD_DIGITS)


def rnd(c: Column, digits: int) -> Column:
    """Half-even rounding to ``digits`` that is stable under re-partitioning."""
    return _half_even(guard(c), digits)


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (greatest/least alone would skip it)."""
    out = c
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    return F.when(c.isNotNull(), out)


def no_nan(c: Column) -> Column:
    """NaN to NULL. Spark sorts NaN above every number, so comparisons would flip."""
    return F.nanvl(c, F.lit(None).cast("double"))


def sentinel_to_null(c: Column, sentinel: float) -> Column:
    return F.nullif(c, F.lit(float(sentinel)))


def rescale(c: Column, lo: Column, hi: Column) -> Column:
    """(c - lo) / (hi - lo); a constant column becomes 0."""
    span = hi - lo
    return (c - lo) / F.when(span == 0, F.lit(1.0)).otherwise(span)


def unscale(c: Column, lo: Column, hi: Column) -> Column:
    """Inverse of :func:`rescale`, with the same rule for a constant column."""
    span = hi - lo
    return c * F.when(span == 0, F.lit(1.0)).otherwise(span) + lo
