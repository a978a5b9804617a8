"""Neighbourhood kernels and their schedules as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def decay(start: float, end: float, t: Column, steps: int) -> Column:
    """Exponential decay from ``start`` towards ``end`` over ``steps``."""
    return F.lit(start - end) * F.exp(-10.0 * t / F.lit(float(steps))) + F.lit(end)


def gaussian(d2: Column, radius: Column, rate: Column | float = 1.0) -> Column:
    return F.lit(rate) * F.exp(-d2 / (4.0 * radius * radius))


def sinc(d: Column, radius: Column, rate: Column | float = 1.0) -> Column:
    x = d / radius * math.pi
    return F.lit(rate) * F.when(x == 0, 1.0).otherwise(F.sin(x) / x)


def toric_squared(i1: Column, j1: Column, i2: Column, j2: Column, rows: int, cols: int) -> Column:
    """Squared grid distance on a torus, in closed form."""
    di, dj = F.abs(i1 - i2), F.abs(j1 - j2)
    di, dj = F.least(di, rows - di), F.least(dj, cols - dj)
    return (di * di + dj * dj).cast("double")


def planar_squared(i1: Column, j1: Column, i2: Column, j2: Column) -> Column:
    return ((i1 - i2) * (i1 - i2) + (j1 - j2) * (j1 - j2)).cast("double")
