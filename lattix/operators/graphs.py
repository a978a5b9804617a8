"""Edge tables ``(src, dst, w)``: set operations, components, shortest paths, thresholds and floods on grids."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.operators.grid import FOUR, neighbours
from lattix.plans.tables import written


def symmetrized(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, the smaller weight where they differ."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.min("w").alias("w"))


def unsymmetrized(edges: DataFrame) -> DataFrame:
    """One direction of each edge."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("w").alias("w"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def smallest(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min(F.struct("w", "src", "dst")).alias("m")).select("m.src", "m.dst", "m.w")


def pruned(edges: DataFrame, most: float) -> DataFrame:
    return edges.where(F.col("w") <= most)


def adjacency(edges: DataFrame) -> DataFrame:
    """``(r, c, val)``, dense over the vertices; 0 where there is no edge. For graphs of a grid's size."""
    nodes = vertices(edges)
    cells = nodes.select(F.col("node").alias("r")).withColumn("c", F.explode(nodes.agg(F.array_sort(F.collect_list("node")).alias("a")).scalar()))
    return cells.join(edges.select(F.col("src").alias("r"), F.col("dst").alias("c"), "w"), ["r", "c"], "left").select("r", "c", F.coalesce("w", F.lit(0.0)).alias("val"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The edges of both; where both have one, the second's weight stands."""
    return a.join(b.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "w").unionByName(b.select("src", "dst", "w"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node reachable, edges taken as undirected.

    Labels take the minimum of their neighbours' and jump to their label's label, so chains shrink by half a round;
    every round is written to the shared folder.
    """
    edges = written(edges.select("src", "dst"), "edges")
    both = edges.union(edges.select("dst", "src")).distinct()
    labels = vertices(edges).withColumn("component", F.col("node"))
    while True:
        far = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("low"))
        stepped = labels.join(far, labels.node == far.src, "left").select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        up = stepped.select(F.col("node").alias("at"), F.col("component").alias("higher"))
        jumped = stepped.join(up, stepped.component == up["at"]).select("node", "old", F.least("component", "higher").alias("component"))
        jumped = written(jumped, "labels")
        done = jumped.where("component <> old").isEmpty()
        labels = jumped.select("node", "component")
        if done:
            return labels


#: Rounds between two looks for a negative cycle.
CYCLE_CHECK = 16


def shortest_lengths(edges: DataFrame, source: int) -> DataFrame:
    """``(node, dist)`` from ``source`` by relaxation: each round extends only the paths that got shorter, until none is.

    A negative cycle within reach fails: without one no path gets shorter after as many rounds as there are nodes.
    """
    spark = edges.sparkSession
    edges = written(edges, "edges")
    best = spark.createDataFrame([(source, 0.0)], "node int, dist double")
    fresh = best
    rounds = 0
    while True:
        reached = fresh.join(edges, fresh.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        joined = best.join(reached, "node", "full").select("node", "dist", F.least("dist", "new").alias("least"))
        joined = written(joined, "reached")
        fresh = joined.where("dist is null or least < dist").select("node", F.col("least").alias("dist"))
        best = joined.select("node", F.col("least").alias("dist"))
        if fresh.isEmpty():
            return best
        rounds += 1
        if rounds % CYCLE_CHECK == 0 and rounds > best.count():
            raise ValueError("the edges hold a negative cycle")


def threshold_clusters(field: DataFrame, rows: int, cols: int, share: float) -> DataFrame:
    """``(nid, label)``: 4-connected toric groups of the cells below ``share`` of the largest value, labelled from 1 by mean value."""
    field = written(field, "field")
    low = field.where(F.col("val") < share * field.agg(F.max("val")).scalar())
    low = low.select("nid", "i", "j", "val")
    pairs = neighbours(low, rows, cols, True, FOUR)
    pairs = pairs.join(low.select(F.col("nid").alias("other")), "other", "left_semi")
    links = pairs.select(F.col("nid").alias("src"), F.col("other").alias("dst")).unionByName(low.select(F.col("nid").alias("src"), F.col("nid").alias("dst")))
    groups = components(links).join(low.select(F.col("nid").alias("node"), "val"), "node")
    ranked = groups.groupBy("component").agg(F.avg("val").alias("mean")).select("component", F.row_number().over(Window.orderBy("mean", "component")).alias("label"))
    return groups.join(ranked, "component").select(F.col("node").alias("nid"), "label")


def threshold_sweep(field: DataFrame, rows: int, cols: int) -> DataFrame:
    """``(step, cut, nid, label)``: the groups of ``threshold_clusters`` below every distinct value, steps from 1 in ascending order.

    All steps are grouped at once, as one graph that holds each cell once for every step in which it is low. No other
    cut gives another grouping, so nothing is missed between two steps. The least value has no cell below it.
    """
    field = written(field, "field")
    values = field.where("val is not null").select("val").distinct()  # a grid's values
    cuts = values.select(F.row_number().over(Window.orderBy("val")).alias("step"), F.col("val").alias("cut"))
    found = cuts.agg(F.collect_list(F.struct("step", "cut"))).scalar()
    low = field.withColumn("cuts", found).select("nid", "val", F.explode(F.filter("cuts", lambda c: c["cut"] > F.col("val"))).alias("c"))
    low = written(low.select("c.step", "c.cut", "nid", "val"), "low")
    pairs = low.select("step", "nid").join(neighbours(field, rows, cols, True, FOUR), "nid")
    pairs = pairs.join(low.select("step", F.col("nid").alias("other")), ["step", "other"], "left_semi")
    node = lambda cell: F.col("step").cast("long") * (rows * cols) + F.col(cell)
    links = pairs.select(node("nid").alias("src"), node("other").alias("dst")).unionByName(low.select(node("nid").alias("src"), node("nid").alias("dst")))
    groups = components(links).join(low.withColumn("node", node("nid")), "node")
    order = Window.partitionBy("step").orderBy("mean", "component")
    ranked = groups.groupBy("step", "component").agg(F.avg("val").alias("mean")).select("component", F.row_number().over(order).alias("label"))
    return groups.join(ranked, "component").select("step", "cut", "nid", "label")


def cluster_stats(field: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label, n, mean, median, low)`` of the field's values in each cluster."""
    return field.join(labels, "nid").groupBy("label").agg(F.count("*").alias("n"), F.avg("val").alias("mean"), F.median("val").alias("median"), F.min("val").alias("low"))


def watershed(values: np.ndarray) -> np.ndarray:
    """Labels from 1 of the basins of a toric grid: cells are flooded in order of (value, cell), each to the basin of its lowest flooded neighbour."""
    rows, cols = values.shape
    labels = np.zeros(values.shape, int)
    count = 0
    for v, n in sorted((float(x), k) for k, x in enumerate(values.ravel())):
        i, j = divmod(n, cols)
        around = [(values[a, b], a * cols + b, labels[a, b]) for a, b in (((i + di) % rows, (j + dj) % cols) for di in (-1, 0, 1) for dj in (-1, 0, 1) if di or dj) if labels[a, b]]
        if around:
            labels[i, j] = min(around)[2]
        else:
            count += 1
            labels[i, j] = count
    return labels


def least_path(values: np.ndarray, start: int, goal: int) -> list[int]:
    """The toric path whose highest cell is lowest, then whose sum is least."""
    rows, cols = values.shape
    heap, seen = [((float(values.flat[start]), float(values.flat[start])), start, [start])], set()
    while heap:
        (top, total), n, path = heapq.heappop(heap)
        if n == goal:
            return path
        if n in seen:
            continue
        seen.add(n)
        i, j = divmod(n, cols)
        for di in (-1, 0, 1):
            for dj in (-1, 0, 1):
                m = (i + di) % rows * cols + (j + dj) % cols
                if m not in seen:
                    v = float(values.flat[m])
                    heapq.heappush(heap, ((max(top, v), total + v), m, [*path, m]))
    return []


def monte_carlo(values: np.ndarray, start: int, steps: int, temperature: float, seed: int = 0) -> list[int]:
    """A Metropolis walk over toric neighbours."""
    rng = np.random.default_rng(seed)
    rows, cols = values.shape
    out, n = [start], start
    for _ in range(steps):
        i, j = divmod(n, cols)
        di, dj = rng.integers(-1, 2, 2)
        m = (i + di) % rows * cols + (j + dj) % cols
        if rng.random() < np.exp(min(0.0, -(values.flat[m] - values.flat[n]) / temperature)):
            n = int(m)
        out.append(n)
    return out


def on_grid(field: DataFrame, rows: int, cols: int, kernel, schema: str) -> DataFrame:
    """Run an order-dependent kernel on a whole grid field (some thousand cells) in one task."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full(rows * cols, np.inf)
        grid[pdf.nid.to_numpy()] = pdf.val.to_numpy()
        return kernel(grid.reshape(rows, cols))

    return field.select("nid", "val", F.lit(0).alias("k")).groupBy("k").applyInPandas(work, schema)
