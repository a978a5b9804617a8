"""3-D vectors, quaternions [w, x, y, z] and 4 x 4 row-major transforms as array expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattix.functions.vectors import dot, norm


def vec(*parts) -> Column:
    return F.array(*(p if isinstance(p, Column) else F.lit(float(p)) for p in parts))


def let(*args):
    """``let(a, b, ..., body)``: ``body`` over values that are computed once and named, so that nested formulas stay small."""
    *values, body = args
    if not values:
        return body()
    first, *rest = values
    return F.transform(F.array(first), lambda x: let(*rest, lambda *more: body(x, *more)))[0]


def cross(a: Column, b: Column) -> Column:
    return let(a, b, lambda a, b: vec(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]))


def angle(a: Column, b: Column, directed: bool = True) -> Column:
    """Angle between vectors in [0, pi]; undirected ones in [0, pi / 2]."""
    c = dot(a, b) / (norm(a) * norm(b))
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c if directed else F.abs(c)))
    return F.acos(c)


def quaternion_about(theta: Column, axis: Column) -> Column:
    return let(F.sin(theta / 2) / norm(axis), axis, lambda s, u: vec(F.cos(theta / 2), u[0] * s, u[1] * s, u[2] * s))


def quaternion_multiply(a: Column, b: Column) -> Column:
    return let(a, b, lambda a, b: vec(
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    ))


def rotation_between(a: Column, b: Column) -> Column:
    """``[angle, x, y, z]`` of the turn that lays ``a`` along ``b``; null where they lie along one line, which leaves the axis open."""

    def of(c: Column, length: Column) -> Column:
        return F.when(length > 0, vec(angle(a, b), *(c[k] / length for k in range(3))))

    return let(cross(a, b), lambda c: let(norm(c), lambda n: of(c, n)))


def quaternion_conjugate(q: Column) -> Column:
    return let(q, lambda q: vec(q[0], -q[1], -q[2], -q[3]))


def quaternion_inverse(q: Column) -> Column:
    return let(q, dot(q, q), lambda q, n: F.transform(quaternion_conjugate(q), lambda x: x / n))


def quaternion_slerp(a: Column, b: Column, t: Column | float, spin: int = 0, shortest: bool = True) -> Column:
    """Between two unit quaternions, with ``spin`` half turns more, along the shorter arc or else as they stand; the start where the two are one rotation."""
    t = F.lit(t)
    raw = dot(a, b)
    side = F.signum(raw) if shortest else F.lit(1.0)
    d = F.least(F.abs(raw), F.lit(1.0)) if shortest else F.greatest(F.lit(-1.0), F.least(raw, F.lit(1.0)))
    one = F.sin(F.acos(d)) < 1e-12
    w = F.acos(d) + spin * math.pi
    mixed = F.zip_with(a, b, lambda x, y: (F.sin((1 - t) * w) * x + F.sin(t * w) * side * y) / F.sin(w))
    return F.when(t == 0, a).when(t == 1, b).when(one, a).otherwise(mixed)


def quaternion_matrix(q: Column) -> Column:
    def matrix(q: Column) -> Column:
        n = dot(q, q)
        w, x, y, z = (q[k] for k in range(4))
        s = 2.0 / n
        return vec(
            1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w), 0,
            s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w), 0,
            s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y), 0,
            0, 0, 0, 1,
        )

    return let(q, matrix)


def identity() -> Column:
    return vec(*(float(r == c) for r in range(4) for c in range(4)))


def translation(d: Column) -> Column:
    return vec(1, 0, 0, d[0], 0, 1, 0, d[1], 0, 0, 1, d[2], 0, 0, 0, 1)


def scaling(factor: Column) -> Column:
    return vec(factor, 0, 0, 0, 0, factor, 0, 0, 0, 0, factor, 0, 0, 0, 0, 1)


def rotation(theta: Column, axis: Column) -> Column:
    return quaternion_matrix(quaternion_about(theta, axis))


def reflection(point: Column, normal: Column) -> Column:
    """Mirror at the plane through ``point``."""
    n = [normal[k] / norm(normal) for k in range(3)]
    d = point[0] * n[0] + point[1] * n[1] + point[2] * n[2]
    rows = [x for r in range(3) for x in (*(F.lit(float(r == c)) - 2 * n[r] * n[c] for c in range(3)), 2 * d * n[r])]
    return vec(*rows, 0, 0, 0, 1)


def multiply(a: Column, b: Column) -> Column:
    return let(a, b, lambda a, b: vec(*(sum((a[4 * r + k] * b[4 * k + c] for k in range(1, 4)), a[4 * r] * b[c]) for r in range(4) for c in range(4))))


def transpose(m: Column) -> Column:
    return let(m, lambda m: vec(*(m[4 * c + r] for r in range(4) for c in range(4))))


def apply(m: Column, p: Column) -> Column:
    return let(m, p, lambda m, p: vec(*(m[4 * r] * p[0] + m[4 * r + 1] * p[1] + m[4 * r + 2] * p[2] + m[4 * r + 3] for r in range(3))))


def euler_matrix(x: Column, y: Column, z: Column) -> Column:
    """Static axes x, y, z in this order."""
    one = lambda *a: vec(*a)
    return multiply(multiply(rotation(z, one(0, 0, 1)), rotation(y, one(0, 1, 0))), rotation(x, one(1, 0, 0)))


def euler_from_matrix(m: Column) -> Column:
    """Angles about the static axes x, y, z; z is 0 where x and z turn about the same axis."""
    c = F.sqrt(m[0] * m[0] + m[4] * m[4])
    y = F.atan2(-m[8], c)
    return F.when(c > 1e-12, vec(F.atan2(m[9], m[10]), y, F.atan2(m[4], m[0]))).otherwise(vec(F.atan2(-m[6], m[5]), y, 0))


def determinant3(m: Column) -> Column:
    return m[0] * (m[5] * m[10] - m[6] * m[9]) - m[1] * (m[4] * m[10] - m[6] * m[8]) + m[2] * (m[4] * m[9] - m[5] * m[8])
