"""Rounding that every engine repeats exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half-up rounding by one multiplication, one floor and one division."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def padded(n: Column, digits: int) -> Column:
    """A whole number as text, with zeros in front up to ``digits``; longer numbers stay whole, which ``lpad`` alone would cut."""
    return F.when(n < 10**digits, F.lpad(n.cast("string"), digits, "0")).otherwise(n.cast("string"))
