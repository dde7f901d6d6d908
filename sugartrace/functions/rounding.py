"""The rounding modes the results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    """Server-side rounding: scale, round ties to even, scale back."""
    if digits == 0:
        return F.rint(value)
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def settled(value: Column) -> Column:
    """Drop the noise of summation order, so a distributed mean lands on the same side of a tie."""
    return F.round(value, 9)


def half_up(value: Column, digits: int = 0) -> Column:
    """SQL report rounding (ties away from zero)."""
    return F.round(value, digits)


def display(value: Column, digits: int = 0) -> Column:
    """Display rounding: floor(x + 0.5) at the given digit."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale
