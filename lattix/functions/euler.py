"""Euler angles in any of the 24 orders of axes, named like ``sxyz``: static or rotating frame, then the axes in turn."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattix.functions.geometry import let, quaternion_about, quaternion_matrix, quaternion_multiply, vec

#: All orders: no axis follows itself.
ORDERS = [f"{frame}{a}{b}{c}" for frame in "sr" for a, b, c in product("xyz", repeat=3) if a != b != c]
UNIT = {"x": (1, 0, 0), "y": (0, 1, 0), "z": (0, 0, 1)}


def quaternion_from_euler(a: Column, b: Column, c: Column, axes: str = "sxyz") -> Column:
    """Turns about the axes in order: about fixed axes later turns are factors on the left, about turned ones on the right."""
    turns = [quaternion_about(angle, vec(*UNIT[axis])) for angle, axis in zip((a, b, c), axes[1:])]
    first, second, third = turns if axes[0] == "r" else turns[::-1]
    return quaternion_multiply(quaternion_multiply(first, second), third)


def euler_matrix(a: Column, b: Column, c: Column, axes: str = "sxyz") -> Column:
    return quaternion_matrix(quaternion_from_euler(a, b, c, axes))


def euler_from_matrix(m: Column, axes: str = "sxyz") -> Column:
    """The three angles; the last turn about a static axis is 0 where it and the first are about the same line.

    A rotating order is the static one of the reversed axes, its angles reversed. For static axes i, j, k the entries
    of the product of the three turns are solved for the angles; an order that runs against x, y, z, x turns the
    other way.
    """
    i, j, last = ("xyz".index(x) for x in (axes[1:] if axes[0] == "s" else axes[:0:-1]))
    k, way = 3 - i - j, 1.0 if j == (i + 1) % 3 else -1.0

    def solve(m: Column) -> Column:
        at = lambda r, c: m[4 * r + c]
        flat = way * F.atan2(-at(j, k), at(j, j))
        if last == i:
            tilt = F.sqrt(at(i, j) * at(i, j) + at(i, k) * at(i, k))
            middle = way * F.atan2(tilt, at(i, i))
            angles, degenerate = (way * F.atan2(at(i, j), at(i, k)), middle, way * F.atan2(at(j, i), -at(k, i))), (flat, middle, F.lit(0.0))
        else:
            tilt = F.sqrt(at(i, i) * at(i, i) + at(j, i) * at(j, i))
            middle = way * F.atan2(-at(k, i), tilt)
            angles, degenerate = (way * F.atan2(at(k, j), at(k, k)), middle, way * F.atan2(at(j, i), at(i, i))), (flat, middle, F.lit(0.0))
        if axes[0] == "r":
            angles, degenerate = angles[::-1], degenerate[::-1]
        return F.when(tilt > 1e-12, vec(*angles)).otherwise(vec(*degenerate))

    return let(m, solve)


def euler_from_quaternion(q: Column, axes: str = "sxyz") -> Column:
    return euler_from_matrix(quaternion_matrix(q), axes)
