"""Trajectory frames met over a map: how far structures of neighbouring cells are apart, and features of their Gram matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.functions.vectors import dot, squared_distance
from lattix.operators.grid import EIGHT
from lattix.operators.project import representatives


def _around(placed: DataFrame, rows: int, cols: int, steps) -> DataFrame:
    """``placed(nid, ...)`` with ``other``: each cell ``steps`` away on the torus, as often as steps lead there."""
    stepped = placed.withColumn("s", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps))))
    i, j = F.pmod(F.expr(f"nid div {cols}") + F.col("s.a"), F.lit(rows)), F.pmod(F.col("nid") % cols + F.col("s.b"), F.lit(cols))
    return stepped.withColumn("other", (i * cols + j).cast("int")).drop("s")


def _apart():
    return F.sqrt(squared_distance(F.flatten("xyz"), F.flatten("ref")) / F.size("ref"))


def _centres(frames: DataFrame, bmus: DataFrame) -> DataFrame:
    """``(nid, xyz)`` of the input nearest to each neuron that has any."""
    return frames.join(representatives(bmus).select("nid", "id"), "id").select("nid", "xyz")


def rmsd_map(frames: DataFrame, bmus: DataFrame, rows: int, cols: int) -> DataFrame:
    """``(nid, n, val)``: the mean distance of each cell's representative to those of its eight toric neighbours, as the points stand.

    ``frames(id, xyz)``, ``bmus(id, nid, qe)``. Cells without an input are absent here and skipped as neighbours; a cell
    whose neighbours are all empty has null. A neighbour that several steps lead to, on a small torus, counts as often.
    Only a map's structures meet, eight times each.
    """
    centres = _centres(frames, bmus)
    sent = _around(centres, rows, cols, EIGHT).select(F.col("other").alias("nid"), F.col("xyz").alias("ref"))
    met = centres.join(sent, "nid", "left").select("nid", F.when(F.col("ref").isNotNull(), _apart()).alias("r"))
    return met.groupBy("nid").agg(F.count("r").alias("n"), F.avg("r").alias("val"))


def rmsd_map_all(frames: DataFrame, bmus: DataFrame, rows: int, cols: int) -> DataFrame:
    """``(nid, n, val)``: the mean distance of each cell's representative to all inputs of the cell and its eight toric neighbours; zeros are left out.

    Each frame is sent once, to its own cell, where the structures of the nine cells about it lie as one short array;
    what is summed are distances. A cell whose distances are all 0 has null.
    """
    sent = _around(_centres(frames, bmus).withColumnRenamed("nid", "centre").withColumn("nid", F.col("centre")), rows, cols, [(0, 0), *EIGHT])
    near = sent.groupBy(F.col("other").alias("nid")).agg(F.collect_list(F.struct("centre", F.col("xyz").alias("ref"))).alias("near"))
    placed = frames.join(bmus.select("id", "nid"), "id").join(near, "nid")
    far = placed.select(F.explode(F.transform("near", lambda x: F.struct(x["centre"].alias("nid"), F.sqrt(squared_distance(F.flatten("xyz"), F.flatten(x["ref"])) / F.size(x["ref"])).alias("r")))).alias("m"))
    return far.groupBy("m.nid").agg(F.count(F.when(F.col("m.r") != 0, 1)).alias("n"), F.avg(F.when(F.col("m.r") != 0, F.col("m.r"))).alias("val"))


def _principal(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of frames (n, atoms, 3): squared distances, their row means, and the ``k`` leading eigenvectors and all eigenvalues of their rows' covariance."""
    gaps = ((points[:, :, None] - points[:, None]) ** 2).sum(3)
    means = gaps.mean(2)
    centred = gaps - means[:, :, None]
    values, vectors = np.linalg.eigh(centred @ centred.transpose(0, 2, 1) / (gaps.shape[2] - 1))
    return gaps, means, values[:, ::-1], vectors[:, :, ::-1][:, :, :k]


#: Numbers of frames' matrices that are held at once.
HELD = 1 << 22


def distance_features(frames: DataFrame, reference: list[list[float]], k: int = 4, projection: bool = True) -> DataFrame:
    """``(id, descriptor, axes, eigenvalues, means)`` of each frame's matrix of squared distances between its points.

    ``axes`` are the ``k`` leading eigenvectors of the covariance of the matrix' rows, point by point, each turned so that
    it agrees with that of ``reference`` (three numbers a point; the trajectory's first frame, say); ``descriptor`` is
    the matrix projected on them, or the axes themselves, axis by axis; ``means`` are the rows'. The three arrays
    together rebuild the points (``molecules.coordinates``). The reference goes with the task, frames are never shuffled.
    A sign that the reference leaves open (a product of 0) is 0, and so is that axis.
    """
    first = _principal(np.array([reference], float), k)[3][0]
    kind = "descriptor array<double>, axes array<double>, eigenvalues array<double>, means array<double>"

    @F.arrow_udf(kind)
    def of(rows: pa.Array) -> pa.Array:
        out: list[list[np.ndarray]] = [[], [], [], []]
        step = max(1, HELD // max(1, len(first) ** 2))
        for at in range(0, len(rows), step):
            points = np.array(rows[at : at + step].to_pylist(), float)
            gaps, means, values, axes = _principal(points, k)
            axes = axes * np.sign((axes * first).sum(1))[:, None, :]
            told = axes.transpose(0, 2, 1)
            for kept, x in zip(out, (told @ gaps if projection else told, axes, values, means)):
                kept.extend(x.reshape(len(points), -1).tolist())
        return pa.StructArray.from_arrays([pa.array(x, pa.list_(pa.float64())) for x in out], ["descriptor", "axes", "eigenvalues", "means"])

    return frames.select("id", of("xyz").alias("f")).select("id", "f.*")


def pair_features(frames: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """``(id, v)``: for each pair of points two numbers, their distance and the product of the normals of the planes that
    they span with the points before and after; pairs at an end of the chain of the first frame are left out.

    A product is a share of both normals' lengths over all frames (the roots of their sums of squares, one row of sums);
    null if one is 0 throughout.
    """
    atoms = len(frames.select("xyz").first()[0])
    pairs = [(a, b) for a, b in pairs if min(a, b) > 0 and max(a, b) < atoms - 1]
    at = lambda k: F.get("xyz", F.lit(k))
    gap = lambda p, q: F.zip_with(q, p, lambda x, y: x - y)

    def normal(k: int):
        a, b = gap(at(k), at(k + 1)), gap(at(k), at(k - 1))
        return F.array(*(F.get(a, F.lit(i)) * F.get(b, F.lit(j)) - F.get(a, F.lit(j)) * F.get(b, F.lit(i)) for i, j in ((1, 2), (2, 0), (0, 1))))

    used = sorted({k for p in pairs for k in p})
    normals = frames.select("id", "xyz", F.array(*map(normal, used)).alias("normals")) if used else frames.select("id", "xyz", F.array().cast("array<array<double>>").alias("normals"))
    n = {k: F.get("normals", F.lit(x)) for x, k in enumerate(used)}
    length = normals.agg(F.array(*(F.sqrt(F.sum(dot(n[k], n[k]))) for k in used)).alias("length")) if used else None
    numbers = [x for a, b in pairs for x in (F.sqrt(squared_distance(at(a), at(b))), F.try_divide(dot(n[a], n[b]), F.get("length", F.lit(used.index(a))) * F.get("length", F.lit(used.index(b)))))]
    placed = normals if length is None else normals.withColumn("length", length.scalar())
    return placed.select("id", (F.array(*numbers) if numbers else F.array().cast("array<double>")).alias("v"))


def violations(frames: DataFrame, bmus: DataFrame, pairs: list[tuple[int, int]], most: float) -> DataFrame:
    """``(nid, frames, violated, mean)``: how many of the pairs of points of each neuron's frames lie farther apart than ``most``, in all and a frame."""
    gaps = F.array(*(F.sqrt(squared_distance(F.get("xyz", F.lit(a)), F.get("xyz", F.lit(b)))) for a, b in pairs))
    counted = frames.select("id", F.size(F.filter(gaps, lambda d: d > most)).cast("long").alias("over"))
    return counted.join(bmus.select("id", "nid"), "id").groupBy("nid").agg(F.count("*").alias("frames"), F.sum("over").alias("violated"), F.avg("over").alias("mean"))
