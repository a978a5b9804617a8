"""Grid fields as landscapes: regions, peaks, densities by level, seams, merge trees with their saddles, two-ended searches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.operators.graphs import components
from lattix.operators.grid import FOUR, neighbours, slices
from lattix.plans.tables import written


def region(field: DataFrame, scale: float = 1.0, low: bool = True) -> DataFrame:
    """The cells below (above) the mean by ``scale`` population deviations."""
    mean, spread = field.agg(F.avg("val")).scalar(), field.agg(F.stddev_pop("val")).scalar()
    return field.where(F.col("val") < mean - scale * spread if low else F.col("val") > mean + scale * spread)


def peaks(field: DataFrame, rows: int, cols: int) -> DataFrame:
    """Planar 3 x 3 maxima, without the inside of a background of zeros."""
    around = neighbours(field, rows, cols, False).join(field.select(F.col("nid").alias("other"), F.col("val").alias("far")), "other")
    around = around.groupBy("nid").agg(F.max("far").alias("top"), F.max(F.abs("far")).alias("size"))
    return field.join(around, "nid").where("val >= top and not (val = 0 and size = 0)").drop("top", "size")


def lowered(field: DataFrame, rows: int, cols: int, toric: bool = True) -> DataFrame:
    """``field`` with each cell's least value within its 3 x 3 window."""
    around = neighbours(field, rows, cols, toric).join(field.select(F.col("nid").alias("other"), F.col("val").alias("far")), "other")
    least = around.groupBy("nid").agg(F.min("far").alias("far"))
    return field.join(least, "nid", "left").withColumn("val", F.least("val", "far")).drop("far")


def level_density(field: DataFrame, hits: DataFrame, rows: int, cols: int, levels: int) -> DataFrame:
    """``(nid, val)``: at each level below which a cell lies, the mean of ``hits(nid, val)`` over its 4-connected toric component; then the mean over levels."""
    cells = written(slices(field, levels), "cells")
    size = rows * cols
    node = lambda c: (F.col("level") * size + F.col(c)).cast("long")
    near = neighbours(field, rows, cols, True, FOUR).join(cells, "nid")
    near = near.join(cells.select("level", F.col("nid").alias("other")), ["level", "other"], "left_semi")
    links = near.select(node("nid").alias("src"), node("other").alias("dst")).unionByName(cells.select(node("nid").alias("src"), node("nid").alias("dst")))
    groups = components(links).select("component", (F.col("node") % size).cast("int").alias("nid"))
    groups = written(groups, "groups")
    mean = groups.join(hits.select("nid", "val"), "nid").groupBy("component").agg(F.avg("val").alias("mean"))
    return groups.join(mean, "component").groupBy("nid").agg(F.avg("mean").alias("val"))


def seamless(labels: DataFrame, rows: int, cols: int) -> DataFrame:
    """``labels(nid, i, j, label)`` with labels that meet across the torus' seams made one, numbered from 1; 0 is no label."""
    live = labels.where("label <> 0")
    across = lambda axis, last: live.where(F.col(axis) == 0).alias("a").join(live.where(F.col(axis) == last).alias("b"), F.col(f"a.{'j' if axis == 'i' else 'i'}") == F.col(f"b.{'j' if axis == 'i' else 'i'}")).select(F.col("a.label").alias("src"), F.col("b.label").alias("dst"))
    own = live.select(F.col("label").alias("src"), F.col("label").alias("dst"))
    groups = components(across("i", rows - 1).unionByName(across("j", cols - 1)).unionByName(own).distinct())
    named = groups.select("node", F.dense_rank().over(Window.orderBy("component")).alias("new"))  # a row for each label
    return labels.join(named, labels.label == named.node, "left").select("nid", "i", "j", F.coalesce("new", F.lit(0)).alias("label"))


def merge_tree(values: np.ndarray) -> pd.DataFrame:
    """``(step, a, b, height, saddle, n)``: how the toric basins of a field merge as the water rises.

    Cells are flooded in order of (value, cell). The cell at which two basins meet is their saddle; basins bear the
    cells of their minima, and the one with the higher minimum, b, is absorbed by a. ``n``: cells flooded in both.
    """
    rows, cols = values.shape
    flat, root, low, count, out = values.ravel(), {}, {}, {}, []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for cell in sorted(range(flat.size), key=lambda k: (flat[k], k)):
        i, j = divmod(cell, cols)
        met = {find(m) for m in ((i + a) % rows * cols + (j + b) % cols for a in (-1, 0, 1) for b in (-1, 0, 1)) if m in root}
        basins = sorted(met, key=lambda r: (flat[low[r]], low[r]))
        root[cell], low[cell], count[cell] = cell, cell, 1
        if not basins:
            continue
        first, *others = basins
        root[cell] = first
        count[first] += 1
        for other in others:
            root[other] = first
            count[first] += count[other]
            out.append((len(out), low[first], low[other], float(flat[cell]), cell, count[first]))
    return pd.DataFrame(out, columns=["step", "a", "b", "height", "saddle", "n"])


def step_and_slide(values: np.ndarray, start: int, stop: int, step: float, tolerance: float) -> pd.DataFrame:
    """``(side, at, nid, val)``: two cells of like value walk towards each other, by climbs and along levels.

    Climb: each end goes to its neighbour nearest to the other end until its value differs by over ``step``. Slide: each
    end goes on among the neighbours within ``tolerance`` of its value, as long as the ends come nearer. Every move
    shortens the toric distance, so the search ends, with the ends side by side.
    """
    if abs(values.flat[start] - values.flat[stop]) > tolerance:
        raise ValueError("the two ends differ in value")
    rows, cols = values.shape

    def gap(m: int, n: int) -> float:
        di, dj = abs(m // cols - n // cols), abs(m % cols - n % cols)
        return float(np.hypot(min(di, rows - di), min(dj, cols - dj)))

    def around(n: int) -> list[int]:
        i, j = divmod(n, cols)
        return sorted({(i + a) % rows * cols + (j + b) % cols for a in (-1, 0, 1) for b in (-1, 0, 1)} - {n})

    walks = [[start], [stop]]
    apart = lambda: gap(walks[0][-1], walks[1][-1])
    while apart() > 2**0.5:
        for own, other in (walks, walks[::-1]):
            began = values.flat[own[-1]]
            while apart() > 2**0.5:
                own.append(min(around(own[-1]), key=lambda m: (gap(m, other[-1]), m)))
                if abs(values.flat[own[-1]] - began) > step:
                    break
        for own, other in (walks, walks[::-1]):
            level = values.flat[own[-1]]
            while apart() > 2**0.5:
                even = [m for m in around(own[-1]) if abs(values.flat[m] - level) <= tolerance]
                best = min(even, key=lambda m: (gap(m, other[-1]), m), default=None)
                if best is None or gap(best, other[-1]) >= apart():
                    break
                own.append(best)
    return pd.DataFrame([(s, k, n, float(values.flat[n])) for s, walk in enumerate(walks) for k, n in enumerate(walk)], columns=["side", "at", "nid", "val"])


def spectrum(values: np.ndarray) -> pd.DataFrame:
    """``(nid, re, im)`` of the two-dimensional discrete Fourier transform of a field."""
    found = np.fft.fft2(values).ravel()
    return pd.DataFrame({"nid": np.arange(found.size, dtype=np.int32), "re": found.real, "im": found.imag})
