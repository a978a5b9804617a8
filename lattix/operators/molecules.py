"""Shapes of point groups: principal axes, descriptors by charge, chirality, coordinates, alignment, principal components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.functions.vectors import distance, dot, norm, squared_distance, total, unit
from lattix.operators.linalg import moments

#: Blocks of twelve numbers of a descriptor, in order.
PARTS = ["global", "plus", "minus", "polar", "hydrophobic"]


def principal_axes(points: np.ndarray) -> np.ndarray:
    """Twelve numbers: the centre, and the ends of the three axes from it, each as long as the deviation along it.

    An axis points to the side with more points, or else to the farthest one. No point: zeros; one: its place and zeros.
    """
    out = np.zeros(12)
    if len(points):
        centre = out[:3] = points.mean(0)
        if len(points) > 1:
            variance, axes = np.linalg.eigh(np.cov(points, rowvar=False))
            variance, axes = variance[::-1], axes[:, ::-1]
            along = (points - centre) @ axes
            side = np.sign(np.sign(along).sum(0))
            farthest = np.sign(along[np.abs(along).argmax(0), range(3)])
            out[3:] = (centre + (axes * np.where(side == 0, farthest, side) * np.sqrt(np.clip(variance, 0, None))).T).ravel()
    return out


def descriptor(points: np.ndarray, charges: np.ndarray) -> np.ndarray:
    """Sixty numbers: the axes of all points and of those of each class of charge."""
    size = np.abs(charges)
    classes = [np.full(len(points), True), charges >= 1, charges <= -1, (size >= 0.5) & (size < 1), size < 0.5]
    return np.concatenate([principal_axes(points[c]) for c in classes])


def descriptors(atoms: DataFrame) -> DataFrame:
    """``atoms(mol, atom_id, x, y, z, charge)`` -> ``(mol, v)``; a molecule's atoms, some hundreds, meet in one row."""

    @F.arrow_udf("array<double>")
    def of(rows: pa.Array) -> pa.Array:
        found = []
        for row in rows:
            a = np.array([[p["x"], p["y"], p["z"], p["charge"]] for p in row.as_py()], float).reshape(-1, 4)
            found.append(descriptor(a[:, :3], a[:, 3]).tolist())
        return pa.array(found, pa.list_(pa.float64()))

    whole = atoms.groupBy("mol").agg(F.sort_array(F.collect_list(F.struct("atom_id", "x", "y", "z", "charge"))).alias("p"))
    return whole.select("mol", of("p").alias("v"))


# The class of each residue type; others have none.
RESIDUES = {
    "LYS": "plus", "ARG": "plus", "ASP": "minus", "GLU": "minus", "GLN": "polar", "ASN": "polar", "SER": "polar", "CYS": "polar", "THR": "polar",
    "ILE": "hydrophobic", "VAL": "hydrophobic", "LEU": "hydrophobic", "MET": "hydrophobic", "PHE": "hydrophobic", "TYR": "hydrophobic", "TRP": "hydrophobic",
}


def residue_descriptors(atoms: DataFrame) -> DataFrame:
    """``atoms(mol, atom_id, x, y, z, res_type)`` -> ``(mol, v)``: like ``descriptors``, with the classes of residue types in place of charges."""

    @F.arrow_udf("array<double>")
    def of(rows: pa.Array) -> pa.Array:
        found = []
        for row in rows:
            points = np.array([[p["x"], p["y"], p["z"]] for p in row.as_py()], float).reshape(-1, 3)
            kinds = np.array([RESIDUES.get(p["res_type"]) for p in row.as_py()], object)
            found.append(np.concatenate([principal_axes(points), *(principal_axes(points[kinds == k]) for k in PARTS[1:])]).tolist())
        return pa.array(found, pa.list_(pa.float64()))

    whole = atoms.groupBy("mol").agg(F.sort_array(F.collect_list(F.struct("atom_id", "x", "y", "z", "res_type"))).alias("p"))
    return whole.select("mol", of("p").alias("v"))


def rotated(v: Column, turn: Column) -> Column:
    """Each triple of ``v`` turned by the 3 x 3 matrix ``turn`` (row by row)."""
    row = lambda k, r: F.aggregate(F.sequence(F.lit(0), F.lit(2)), F.lit(0.0), lambda s, c: s + F.get(turn, F.lit(3 * r) + c) * F.get(v, 3 * k + c))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 3).cast("int") - 1), lambda k: F.array(row(k, 0), row(k, 1), row(k, 2))))


def split(v: Column, part: str) -> Column:
    """A struct of one part of a descriptor: ``centre``, and ``unit`` and ``norm`` of its three axes."""
    at = 12 * PARTS.index(part)
    centre = F.slice(v, at + 1, 3)
    axes = [F.zip_with(F.slice(v, at + 4 + 3 * k, 3), centre, lambda a, b: a - b) for k in range(3)]
    return F.struct(centre.alias("centre"), F.array(*map(unit, axes)).alias("unit"), F.array(*map(norm, axes)).alias("norm"))


def chirality(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Triple product of the steps between four points over the cube of the middle one's length."""
    gap = lambda p, q: F.zip_with(q, p, lambda x, y: x - y)
    one, two, three = gap(a, b), gap(b, c), gap(c, d)
    cross = F.array(*(F.get(one, F.lit(i)) * F.get(two, F.lit(j)) - F.get(one, F.lit(j)) * F.get(two, F.lit(i)) for i, j in ((1, 2), (2, 0), (0, 1))))
    return dot(cross, three) / F.pow(norm(two), 3)


def chiralities(xyz: Column) -> Column:
    """The chirality of every four points in a row of an array of points."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(xyz) - 4, F.lit(0))), lambda k: k + 3 < F.size(xyz))
    return F.transform(starts, lambda k: chirality(*(F.get(xyz, k + n) for n in range(4))))


def coordinates(v: Column) -> Column:
    """Points from a neuron of 9 n numbers: n x 4 vectors, 4 x n projections and n means of a Gram matrix, whose three largest eigenpairs are the axes."""

    @F.arrow_udf("array<array<double>>")
    def of(rows: pa.Array) -> pa.Array:
        found = []
        for row in rows:
            a = np.array(row.as_py(), float)
            n = len(a) // 9
            gram = a[: 4 * n].reshape(n, 4) @ a[4 * n : 8 * n].reshape(4, n) + a[8 * n : 9 * n, None]
            values, axes = np.linalg.eig(gram - gram.mean(1, keepdims=True))
            top = np.argsort(-np.abs(values), kind="stable")[:3]
            found.append(np.real(np.sqrt(np.abs(values[top])) * axes[:, top]).tolist())
        return pa.array(found, pa.list_(pa.list_(pa.float64())))

    return of(v)


def aligned(points: DataFrame, reference: list[list[float]]) -> DataFrame:
    """``(id, xyz)``: the points of each row centred and turned onto the centred ``reference`` by the best rotation."""
    ref = np.array(reference, float)
    ref = ref - ref.mean(0)

    @F.arrow_udf("array<array<double>>")
    def of(rows: pa.Array) -> pa.Array:
        found = []
        for row in rows:
            a = np.array(row.as_py(), float)
            a = a - a.mean(0)
            u, _, vt = np.linalg.svd(a.T @ ref)
            u[:, -1] *= np.sign(np.linalg.det(u @ vt)) or 1.0
            found.append((a @ u @ vt).tolist())
        return pa.array(found, pa.list_(pa.list_(pa.float64())))

    return points.select("id", of("xyz").alias("xyz"))


def principal_components(data: DataFrame, k: int = 4) -> DataFrame:
    """``(component, value, share, v)`` of the covariance of ``data(v)``; only d x d sums reach the driver. The largest element of a vector is positive."""
    n, _, scatter = moments(data)
    values, axes = np.linalg.eigh(scatter / max(n - 1, 1))
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])
    rows = [(c, float(values[c]), float(values[c] / values.sum()), axes[:, c].tolist()) for c in range(min(k, len(values)))]
    return data.sparkSession.createDataFrame(rows, "component int, value double, share double, v array<double>")


def pca_scores(data: DataFrame, k: int = 4) -> DataFrame:
    """``(id, scores, residual)``: coordinates along the first ``k`` components, and the distance to what they rebuild.

    The mean and the components, d numbers each, go with the plan; the scores are sums within the row.
    """
    _, mean, _ = moments(data)
    axes = [r.v for r in principal_components(data, k).orderBy("component").collect()]
    centred = F.zip_with("v", F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
    rows = data.select("id", centred.alias("c")).withColumn("scores", F.array(*(dot(F.col("c"), F.array(*map(F.lit, a))) for a in axes)))
    rebuilt = F.transform(F.sequence(F.lit(1), F.size("c")), lambda d: dot(F.col("scores"), F.array(*(F.get(F.array(*map(F.lit, a)), d - 1) for a in axes))))
    return rows.withColumn("rebuilt", rebuilt).select("id", "scores", distance(F.col("c"), F.col("rebuilt")).alias("residual"))


def rmsd(points: DataFrame, reference: list[list[float]]) -> DataFrame:
    """``(id, rmsd)`` to ``reference`` as the points stand, without a rotation."""
    ref = F.array(*(F.array(*map(F.lit, map(float, p))) for p in reference))
    return points.select("id", F.sqrt(total(F.zip_with("xyz", ref, squared_distance)) / len(reference)).alias("rmsd"))


def atom_distances(points: DataFrame, reference: list[list[float]]) -> DataFrame:
    """``(id, atom, d)``: how far each point is from its place in ``reference``."""
    ref = F.array(*(F.array(*map(F.lit, map(float, p))) for p in reference))
    return points.select("id", F.posexplode(F.zip_with("xyz", ref, distance)).alias("atom", "d"))


def rmsd_spread(frames: DataFrame, bmus: DataFrame) -> DataFrame:
    """``(nid, n, mean, spread)``: for each neuron its frames' root mean square distance to their mean structure, and how that varies.

    ``frames(id, xyz)``, ``bmus(id, nid)``. Means are sums by neuron, atom and axis, combined before the shuffle.
    """
    placed = frames.join(bmus.select("id", "nid"), "id")
    flat = placed.select("nid", F.posexplode(F.flatten("xyz")).alias("k", "x")).groupBy("nid", "k").agg(F.avg("x").alias("m"))
    means = flat.groupBy("nid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("mean"))
    away = F.sqrt(squared_distance(F.flatten("xyz"), F.col("mean")) / F.size("xyz"))
    return placed.join(means, "nid").select("nid", away.alias("r")).groupBy("nid").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("spread"))
