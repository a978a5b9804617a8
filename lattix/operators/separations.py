"""The separation index along all thresholds of a map, from one sequence of merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.operators.bmu import gathered, rows_of
from lattix.operators.grid import FOUR, edges
from lattix.operators.graphs import unsymmetrized
from lattix.operators.networks import reconnected
from lattix.plans.tables import written

#: Neurons whose distances to all others a task holds at once.
ROWS_HELD = 64


def _apart(some: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Distances of two sets of vectors, summed dimension by dimension, so that equal pairs give equal bits."""
    out = np.zeros((len(some), len(w)))
    for k in range(w.shape[1]):
        out += (some[:, k, None] - w[None, :, k]) ** 2
    return np.sqrt(out)


def _merges(w: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(height, kept, gone)`` of each merge in order: the clusters named by one of their neurons, and all heights."""
    height = np.sqrt(sum((w[ends[:, 0], k] - w[ends[:, 1], k]) ** 2 for k in range(w.shape[1])))
    order = np.lexsort((ends[:, 1], ends[:, 0], height))
    root = np.arange(len(w))
    out = []
    for a, b in ends[order]:
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[b] = a
        out.append((a, b))
    return height[order], np.array(out, np.int64).reshape(-1, 2)


def merges(book: DataFrame, rows: int, cols: int) -> tuple[list, np.ndarray, np.ndarray, float]:
    """The neurons of a planar map, ``height`` and pair of clusters of each merge in order (by places), and the largest border.

    The merges are the edges of a spanning tree of least weight, found in rounds of joins: one less than neurons, so
    that a map's size (checked) comes to the driver.
    """
    cells = gathered(book)
    w, at = np.array([r.w for r in cells]), {r.nid: k for k, r in enumerate(cells)}
    borders = written(edges(book, rows, cols, False, FOUR), "borders")
    tree = unsymmetrized(reconnected(borders.where("false"), borders)).collect()
    height, pairs = _merges(w, np.array([(at[r.src], at[r.dst]) for r in tree], np.int64).reshape(-1, 2))
    border = max((float(_apart(w[[at[r.src]]], w[[at[r.dst]]])[0, 0]) for r in borders.orderBy(F.desc("w")).limit(8).collect()), default=0.0)
    return cells, height, pairs, border


def _terms(w: np.ndarray, height: np.ndarray, merges: np.ndarray, span: float, border: float):
    """For each number of merges: the neurons' parts of the looseness and of the distances, and the least threshold that makes them."""
    share = height / border if border else height

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_HELD):
                part = batch.slice(at, ROWS_HELD)
                sums = _apart(rows_of(part.column(1), w.shape[1]), w)
                own = part.column(0).to_numpy().astype(np.int64)
                levels = np.unique(sums / span if span else sums)
                found = np.searchsorted(levels, share)
                cuts = np.where(found < len(levels), levels[np.minimum(found, len(levels) - 1)], np.inf)
                size, here = np.ones(len(w)), np.arange(len(own))
                total = sums.sum(1)  # over clusters: a neuron's distances to one, by its size
                loose, far = np.zeros(len(merges) + 1), np.zeros(len(merges) + 1)
                far[0] = (total - sums[here, own]).sum()
                for t, (a, b) in enumerate(merges, 1):
                    total -= sums[:, a] / size[a] + sums[:, b] / size[b]
                    sums[:, a] += sums[:, b]
                    size[a] += size[b]
                    total += sums[:, a] / size[a]
                    own[own == b] = a
                    n = size[own]
                    inside = sums[here, own]
                    loose[t] = (inside[n > 1] / (n[n > 1] - 1)).sum()
                    far[t] = ((total - inside / n) / n).sum()
                steps = np.arange(len(merges) + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(loose), pa.array(far), pa.array(np.concatenate([[0.0], cuts]))], ["t", "loose", "far", "cut"])

    return work


def separation_sweep(codebook: DataFrame, rows: int, cols: int) -> DataFrame:
    """``(step, cut, clusters, xi, gradient)`` of the planar map at each threshold that changes its clusters, down to two of them.

    Neurons side by side whose distance, as a share of the largest such distance, is at most the threshold are of one
    cluster. Thresholds are the distances of any two neurons as shares of the largest; ``xi`` is ``separation`` of the
    clusters, ``gradient`` its change by the threshold's, null at threshold 0.

    The clusters of all thresholds are one sequence of merges: the edges of a spanning tree of least weight (found in
    rounds of joins) in order. Along it each neuron keeps the sum of its distances to every cluster, which a merge
    changes by an addition, so each neuron needs its own row of distances only, and tasks work on some rows each and
    hand on sums by merge. The codebook and the tree, a map's size (checked), go with the tasks.
    """
    codebook = written(codebook.select("nid", "i", "j", "w"), "book")
    cells, height, pairs, border = merges(codebook, rows, cols)
    w = np.array([r.w for r in cells])
    spark = codebook.sparkSession
    placed = spark.createDataFrame([(k, r.w) for k, r in enumerate(cells)], "k int, w array<double>").repartition(max(1, min(len(cells) // ROWS_HELD, 4096)), "k")

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(1), w.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array([max(float(_apart(x[a : a + ROWS_HELD], w).max()) for a in range(0, len(x), ROWS_HELD))])], ["d"])

    span = placed.mapInArrow(widest, "d double").agg(F.max("d")).first()[0] or 0.0
    terms = placed.mapInArrow(_terms(w, height, pairs, span, border), "t int, loose double, far double, cut double")
    sums = terms.groupBy("t").agg(F.sum("loose").alias("loose"), F.sum("far").alias("far"), F.min("cut").alias("cut"))
    last = sums.groupBy("cut").agg(F.max(F.struct("t", "loose", "far")).alias("s")).select("cut", "s.*")
    n, m = len(cells), F.lit(len(cells)) - F.col("t")
    rated = last.select("cut", m.cast("long").alias("clusters"), (m * (F.col("loose") / n) / (F.nullif("far", F.lit(0.0)) / (m * m))).alias("xi")).where("clusters > 1")
    order = Window.orderBy("cut")  # a row for each merge at most
    change = (F.col("xi") - F.lag("xi", 1, 0.0).over(order)) / F.nullif(F.col("cut") - F.lag("cut", 1, 0.0).over(order), F.lit(0.0))
    return rated.select(F.row_number().over(order).alias("step"), "cut", "clusters", "xi", change.alias("gradient"))


def best_separation(sweep: DataFrame) -> DataFrame:
    """The row of ``separation_sweep`` at which the index falls most steeply, the last of equal ones; no row if it never falls."""
    kept = sweep.where("gradient < 0").select((-F.col("gradient")).alias("fall"), "step", "cut", "clusters", "xi", "gradient")
    return kept.agg(F.max(F.struct("fall", "step", "cut", "clusters", "xi", "gradient")).alias("b")).where("b is not null").select("b.step", "b.cut", "b.clusters", "b.xi", "b.gradient")
