"""More 4 x 4 transforms: array expressions where a formula is closed, NumPy over Arrow batches where it needs a decomposition."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lattix.functions.geometry import cross, euler_matrix, let, multiply, quaternion_matrix, scaling, translation, vec
from lattix.functions.vectors import dot, norm, unit


def _mapped(kernel: Callable[..., np.ndarray], *args: Column) -> Column:
    """``kernel`` on each row's arrays; null where an argument is null."""

    @F.arrow_udf("array<double>")
    def of(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns))
        return pa.array([None if any(x is None for x in r) else np.ravel(kernel(*map(np.array, r))).tolist() for r in rows], pa.list_(pa.float64()))

    return of(*args)


def _unit_vector_at(m: np.ndarray, value: float) -> np.ndarray:
    """The real eigenvector whose eigenvalue is nearest to ``value``."""
    values, vectors = np.linalg.eig(m)
    return np.real(vectors[:, np.argmin(abs(values - value))])


def inverse(m: Column) -> Column:
    return _mapped(lambda a: np.linalg.inv(a.reshape(4, 4)), m)


def concatenated(*matrices: Column) -> Column:
    out = matrices[0]
    for m in matrices[1:]:
        out = multiply(out, m)
    return out


def is_same(a: Column, b: Column) -> Column:
    """Equal after scaling by the last element, to a relative 1e-5 or an absolute 1e-8."""
    own = lambda m: let(m, lambda m: F.transform(m, lambda v: v / m[15]))
    return F.forall(F.zip_with(own(a), own(b), lambda p, q: F.abs(p - q) <= 1e-8 + 1e-5 * F.abs(q)), lambda v: v)


def translation_from(m: Column) -> Column:
    return vec(m[3], m[7], m[11])


def rotation_from(m: Column) -> Column:
    """``[angle, x, y, z]``: the axis is the direction that stays, the angle is signed to match it."""

    def kernel(a: np.ndarray) -> np.ndarray:
        r = a.reshape(4, 4)[:3, :3]
        axis = _unit_vector_at(r, 1.0)
        axis = axis / np.linalg.norm(axis)
        skew = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
        return np.r_[math.atan2(skew @ axis, np.trace(r) - 1.0), axis]

    return _mapped(kernel, m)


def reflection_from(m: Column) -> Column:
    """``[point, normal]`` of the mirror."""

    def kernel(a: np.ndarray) -> np.ndarray:
        a = a.reshape(4, 4)
        normal = _unit_vector_at(a[:3, :3], -1.0)
        return np.r_[a[:3, 3] / 2, normal / np.linalg.norm(normal)]

    return _mapped(kernel, m)


def scale_from(m: Column) -> Column:
    """``[factor, origin, direction]``; a uniform scaling has a direction of NaN."""

    def kernel(a: np.ndarray) -> np.ndarray:
        a = a.reshape(4, 4)
        factor = np.trace(a[:3, :3]) - 2.0
        values = np.real(np.linalg.eigvals(a[:3, :3]))
        if np.abs(values - factor).min() < 1e-8:
            direction = _unit_vector_at(a[:3, :3], factor)
            direction = direction / np.linalg.norm(direction)
        else:
            factor, direction = (factor + 2.0) / 3.0, np.full(3, np.nan)
        origin = _unit_vector_at(a, 1.0)
        return np.r_[factor, origin[:3] / origin[3], direction]

    return _mapped(kernel, m)


def scaling_along(factor: Column, origin: Column, direction: Column) -> Column:
    d = unit(direction)
    k = 1 - factor
    rows = [x for r in range(3) for x in (*(F.lit(float(r == c)) - k * d[r] * d[c] for c in range(3)), k * dot(origin, d) * d[r])]
    return vec(*rows, 0, 0, 0, 1)


def projection(point: Column, normal: Column, direction: Column | None = None, perspective: Column | None = None, pseudo: bool = False) -> Column:
    """Onto the plane: orthogonal, along ``direction``, or from the point ``perspective`` (``pseudo``: keeps depths apart)."""
    n = unit(normal)
    if perspective is not None:
        gap = dot(F.zip_with(perspective, point, lambda a, b: a - b), n)
        rows = [x for r in range(3) for x in (*(F.when(F.lit(r == c), gap).otherwise(0.0) - perspective[r] * n[c] - (n[r] * n[c] if pseudo else 0.0) for c in range(3)), dot(point, n) * (perspective[r] + (n[r] if pseudo else 0.0)))]
        return vec(*rows, *(-n[c] for c in range(3)), dot(perspective, n))
    d = n if direction is None else direction
    rows = [x for r in range(3) for x in (*(F.lit(float(r == c)) - d[r] * n[c] / dot(d, n) for c in range(3)), d[r] * dot(point, n) / dot(d, n))]
    return vec(*rows, 0, 0, 0, 1)


def _null(m: np.ndarray) -> np.ndarray:
    """The direction that ``m`` takes closest to 0."""
    return np.linalg.svd(m)[2][-1]


def _fixed_point(m: np.ndarray) -> np.ndarray:
    """A point that ``m`` leaves where it is, of those the one nearest to the origin."""
    point = np.linalg.lstsq(m[:3, :3] / m[3, 3] - np.eye(3), -m[:3, 3] / m[3, 3], rcond=None)[0]
    return point


#: A projection's kinds as ``projection_from`` tells them.
ORTHOGONAL, PARALLEL, PERSPECTIVE = 0.0, 1.0, 2.0


def projection_from(m: Column, pseudo: bool = False) -> Column:
    """``[kind, point, normal, direction, perspective]`` (1 and 3 each) of a matrix of ``projection``; null if it is none.

    ``kind`` is 0 for an orthogonal projection, 1 for one along ``direction``, 2 for one from the point ``perspective``;
    what a kind does not have is 0. A parallel projection takes ``direction`` to 0 and leaves the points of its plane,
    whose ``normal`` no image of it has; one from a point leaves the plane's points, too, which hold where the last row
    gives the normal. ``pseudo``: the matrix keeps depths apart.
    """

    def kernel(a: np.ndarray) -> np.ndarray:
        a, none = a.reshape(4, 4), np.zeros(3)
        if np.abs(a[3, :3]).max() < 1e-12 * np.abs(a).max():
            a = a / a[3, 3]
            low = np.linalg.svd(a[:3, :3])[1]
            if low[2] > 1e-8 * low[0]:
                return np.full(13, np.nan)
            direction, normal = _null(a[:3, :3]), _null(a[:3, :3].T)
            if normal @ direction < 0:
                normal = -normal
            kind = ORTHOGONAL if np.allclose(direction, normal, atol=1e-8) else PARALLEL
            return np.r_[kind, _fixed_point(a), normal, none if kind == ORTHOGONAL else direction, none]
        # The scale is that at which the last row is the unit normal, turned. Across the normal the matrix is a number,
        # and along it the rest is the eye (with depths apart, the eye and the normal).
        a = a / np.linalg.norm(a[3, :3])
        gap = (np.trace(a[:3, :3]) - a[3, :3] @ a[:3, :3] @ a[3, :3]) / 2
        eye = -(np.eye(3) * gap - a[:3, :3]) @ a[3, :3]
        if pseudo:
            if eye @ a[3, :3] + a[3, 3] > 0:  # the matrix has been turned over
                a, gap = -a, -gap
            eye = eye + a[3, :3]
        normal, depth = -a[3, :3], a[3, 3] - gap
        return np.r_[PERSPECTIVE, depth * normal, normal, none, eye]

    found = _mapped(kernel, m)
    return F.when(~F.isnan(found[0]), found)


def shear_from(m: Column) -> Column:
    """``[angle, direction, point, normal]`` (1 and 3 each) of a matrix of ``shear``, the angle not negative; null if it is none.

    What a shear adds to the identity is one direction times the normal, so both are the singular vectors of its only
    singular value, the angle's tangent.
    """

    def kernel(a: np.ndarray) -> np.ndarray:
        a = a.reshape(4, 4) / a[15]
        u, s, vt = np.linalg.svd(a[:3, :3] - np.eye(3))
        direction, normal = u[:, 0], vt[0]
        if s[1] > 1e-6 * max(1.0, s[0]) or abs(direction @ normal) > 1e-4 or np.abs(a[3, :3]).max() > 1e-12:
            return np.full(10, np.nan)
        if s[0] == 0:
            return np.r_[0.0, direction, np.zeros(3), normal]
        point = -(direction @ a[:3, 3]) / s[0] * normal
        return np.r_[math.atan(s[0]), direction, point, normal]

    found = _mapped(kernel, m)
    return F.when(~F.isnan(found[0]), found)


def clip(left: float, right: float, bottom: float, top: float, near: float, far: float, perspective: bool = False) -> Column:
    """A viewing volume to the cube from -1 to 1."""
    if left >= right or bottom >= top or near >= far or (perspective and near <= 0):
        raise ValueError("not a viewing volume")
    w, h, d = right - left, top - bottom, far - near
    if perspective:
        return vec(2 * near / w, 0, (left + right) / (left - right), 0, 0, 2 * near / h, (bottom + top) / (bottom - top), 0, 0, 0, (far + near) / d, -2 * near * far / d, 0, 0, -1, 0)
    return vec(2 / w, 0, 0, -(right + left) / w, 0, 2 / h, 0, -(top + bottom) / h, 0, 0, 2 / d, -(far + near) / d, 0, 0, 0, 1)


def shear(angle: Column, direction: Column, point: Column, normal: Column) -> Column:
    """Along ``direction``, which lies in the plane; fails if it does not."""
    n, d, t = unit(normal), unit(direction), F.tan(angle)
    d = F.when(F.abs(dot(n, d)) > 1e-6, F.raise_error(F.lit("direction and normal are not orthogonal")).cast("array<double>")).otherwise(d)
    rows = [x for r in range(3) for x in (*(F.lit(float(r == c)) + t * d[r] * n[c] for c in range(3)), -t * dot(point, n) * d[r])]
    return vec(*rows, 0, 0, 0, 1)


def compose(scale: Column, shears: Column, angles: Column, translate: Column, perspective: Column | None = None) -> Column:
    """Scale, then shear (xy, xz, yz), turn about static x, y, z, then move; ``perspective`` is the last row that comes after all, and the whole is scaled to end in 1."""
    stretched = vec(scale[0], 0, 0, 0, 0, scale[1], 0, 0, 0, 0, scale[2], 0, 0, 0, 0, 1)
    sheared = vec(1, shears[0], shears[1], 0, 0, 1, shears[2], 0, 0, 0, 1, 0, 0, 0, 0, 1)
    whole = concatenated(translation(translate), euler_matrix(angles[0], angles[1], angles[2]), sheared, stretched)
    if perspective is None:
        return whole
    last = vec(1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, *(perspective[k] for k in range(4)))
    return let(concatenated(last, whole), lambda m: F.transform(m, lambda x: x / m[15]))


def decompose(m: Column) -> Column:
    """``[scale, shears, angles, translation]`` (3 each) and ``perspective`` (4), the inverse of ``compose``: Gram-Schmidt on the columns.

    A matrix that is singular without its last row, or ends in 0, fails.
    """

    def kernel(a: np.ndarray) -> np.ndarray:
        a = a.reshape(4, 4)
        if abs(a[3, 3]) < 1e-12 * np.abs(a).max():
            raise ValueError("the last element of the matrix is zero")
        a = a / a[3, 3]
        plain = np.vstack([a[:3], [0.0, 0.0, 0.0, 1.0]])
        if np.linalg.svd(a[:3, :3])[1][-1] < 1e-14 * np.abs(a[:3, :3]).max():
            raise ValueError("the matrix is singular")
        last = np.linalg.solve(plain.T, a[3]) if a[3, :3].any() else np.array([0.0, 0.0, 0.0, 1.0])
        q, r = np.linalg.qr(a[:3, :3])
        sign = np.where(np.diag(r) < 0, -1.0, 1.0)
        q, r = q * sign, r * sign[:, None]
        if np.linalg.det(q) < 0:
            q, r = -q, -r
        s = np.diag(r)
        shears = np.array([r[0, 1] / s[1], r[0, 2] / s[2], r[1, 2] / s[2]])
        y = math.asin(-np.clip(q[2, 0], -1, 1))
        flat = abs(math.cos(y)) < 1e-12
        x, z = (math.atan2(-q[1, 2], q[1, 1]), 0.0) if flat else (math.atan2(q[2, 1], q[2, 2]), math.atan2(q[1, 0], q[0, 0]))
        return np.r_[s, shears, x, y, z, a[:3, 3], last]

    return _mapped(kernel, m)


def orthogonalization(lengths: Column, degrees: Column) -> Column:
    """Fractional coordinates of a crystal cell to Cartesian ones."""
    a, b, c = (lengths[k] for k in range(3))
    ca, cb, cg = (F.cos(F.radians(degrees[k])) for k in range(3))
    sa, sb = F.sin(F.radians(degrees[0])), F.sin(F.radians(degrees[1]))
    co = (ca * cb - cg) / (sa * sb)
    return vec(a * sb * F.sqrt(1 - co * co), 0, 0, 0, -a * sb * co, b * sa, 0, 0, a * cb, b * ca, c, 0, 0, 0, 0, 1)


def quaternion_from(m: Column) -> Column:
    """The unit quaternion, w not negative: the largest eigenvector of the symmetric form, which averages out noise."""

    def kernel(a: np.ndarray) -> np.ndarray:
        r = a.reshape(4, 4)[:3, :3]
        k = np.zeros((4, 4))
        k[0, 0] = np.trace(r)
        k[0, 1:] = k[1:, 0] = [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]
        k[1:, 1:] = r + r.T - np.trace(r) * np.eye(3)
        q = np.linalg.eigh(k)[1][:, -1]
        return q if q[0] >= 0 else -q

    return _mapped(kernel, m)


def quaternion_from_euler(x: Column, y: Column, z: Column) -> Column:
    """Static axes x, y, z in this order."""
    (cx, sx), (cy, sy), (cz, sz) = ((F.cos(a / 2), F.sin(a / 2)) for a in (x, y, z))
    return vec(cx * cy * cz + sx * sy * sz, sx * cy * cz - cx * sy * sz, cx * sy * cz + sx * cy * sz, cx * cy * sz - sx * sy * cz)


def random_quaternion(a: Column, b: Column, c: Column) -> Column:
    """Even over rotations, from three even numbers in [0, 1)."""
    one, two, t = F.sqrt(1 - a), F.sqrt(a), 2 * math.pi
    return vec(F.cos(t * c) * two, F.sin(t * b) * one, F.cos(t * b) * one, F.sin(t * c) * two)


def random_rotation(a: Column, b: Column, c: Column) -> Column:
    return quaternion_matrix(random_quaternion(a, b, c))


def superimposition(v0: Column, v1: Column, scale: bool = False) -> Column:
    """The rotation, move (and scale) that lays the points ``v0`` (x, y, z in turn) best on ``v1``."""

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.reshape(-1, 3), b.reshape(-1, 3)
        ca, cb = a.mean(0), b.mean(0)
        u, _, vt = np.linalg.svd((b - cb).T @ (a - ca))
        u[:, -1] *= np.sign(np.linalg.det(u @ vt))
        r = u @ vt * (np.sqrt(((b - cb) ** 2).sum() / ((a - ca) ** 2).sum()) if scale else 1.0)
        return np.vstack([np.column_stack([r, cb - r @ ca]), [0, 0, 0, 1]])

    return _mapped(kernel, v0, v1)


def affine(v0: Column, v1: Column, shears: bool = True, scale: bool = True, total: bool = False) -> Column:
    """The affine transform from ``v0`` to ``v1`` (x, y, z in turn) of least squares; without ``shears`` a rotation, a move and, with ``scale``, one factor.

    ``total``: errors of both point sets count, by the leading singular vectors of the two side by side, not those of
    ``v1`` alone.
    """
    if not shears:
        return superimposition(v0, v1, scale)

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.reshape(-1, 3), b.reshape(-1, 3)
        if not total:
            found = np.linalg.lstsq(np.column_stack([a, np.ones(len(a))]), b, rcond=None)[0]
            return np.vstack([found.T, [0, 0, 0, 1]])
        ca, cb = a.mean(0), b.mean(0)
        lead = np.linalg.svd(np.column_stack([a - ca, b - cb]), full_matrices=False)[2][: np.linalg.matrix_rank(a - ca)]
        turn = np.linalg.lstsq(lead[:, :3], lead[:, 3:], rcond=None)[0].T
        return np.vstack([np.column_stack([turn, cb - turn @ ca]), [0, 0, 0, 1]])

    return _mapped(kernel, v0, v1)


def on_sphere(x: Column, y: Column, centre: tuple[float, float], radius: float) -> Column:
    """A window's point on the unit sphere in front of it; points outside are drawn to its rim."""
    u, v = (x - centre[0]) / radius, (F.lit(centre[1]) - y) / radius
    n = u * u + v * v
    return F.when(n > 1, vec(u / F.sqrt(n), v / F.sqrt(n), 0)).otherwise(vec(u, v, F.sqrt(F.greatest(1 - n, F.lit(0.0)))))


def on_axis(point: Column, axis: Column) -> Column:
    """The unit vector perpendicular to ``axis`` nearest to ``point``, in the upper half space."""
    flat = F.zip_with(point, F.transform(axis, lambda a: a * dot(axis, point)), lambda p, a: p - a)
    up = F.when(flat[2] < 0, F.transform(flat, lambda x: -x)).otherwise(flat)
    aside = F.when(axis[2] == 1.0, vec(1, 0, 0)).otherwise(unit(vec(-axis[1], axis[0], 0)))
    return F.when(norm(flat) > 0, unit(up)).otherwise(aside)


def nearest_axis(point: Column, axes: list[Column]) -> Column:
    """The axis that ``point`` is nearest to when constrained to it; the first among equals."""
    ranked = F.array(*(F.struct((-dot(on_axis(point, a), point)).alias("d"), F.lit(k).alias("k"), a.alias("a")) for k, a in enumerate(axes)))
    return F.array_min(ranked)["a"]


def chirality(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Triple product of three successive bonds, as unit vectors."""
    bond = lambda p, q: unit(F.zip_with(q, p, lambda y, x: y - x))
    return dot(cross(bond(a, b), bond(b, c)), bond(c, d))


def uniform_scale(factor: Column, origin: Column) -> Column:
    return multiply(multiply(translation(origin), scaling(factor)), translation(F.transform(origin, lambda x: -x)))
