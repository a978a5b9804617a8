"""Clusters of neurons: looseness, distances between clusters, orders, and rescaled grid fields."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.functions.vectors import distance
from lattix.operators.grid import neighbours
from lattix.plans.tables import BLOCK, in_blocks, with_running_max


def neuron_pairs(codebook: DataFrame) -> DataFrame:
    """``(a, b, d)`` of all neurons a < b. The square of a map's size; the inputs take no part."""
    cells = codebook.agg(F.array_sort(F.collect_list(F.struct("nid", "w")))).scalar()
    far = codebook.withColumn("cells", cells).select(F.col("nid").alias("a"), "w", F.explode("cells").alias("o"))
    return far.where("o.nid > a").select("a", F.col("o.nid").alias("b"), distance(F.col("w"), F.col("o.w")).alias("d"))


def labelled_pairs(codebook: DataFrame, labels: DataFrame) -> DataFrame:
    """``(a, b, d, la, lb)`` with the labels of both neurons."""
    one = labels.select(F.col("nid").alias("a"), F.col("label").alias("la"))
    two = labels.select(F.col("nid").alias("b"), F.col("label").alias("lb"))
    return neuron_pairs(codebook).join(one, "a").join(two, "b")


def looseness(codebook: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label, n, val)``: mean distance within each cluster, 0 for a single neuron."""
    inside = labelled_pairs(codebook, labels).where("la = lb").groupBy(F.col("la").alias("label")).agg(F.avg("d").alias("val"))
    return labels.groupBy("label").agg(F.count("*").alias("n")).join(inside, "label", "left").fillna(0.0, ["val"])


def cluster_distance(codebook: DataFrame, labels: DataFrame) -> DataFrame:
    """``(la, lb, val)``: mean distance of the neurons of two clusters, la < lb."""
    pairs = labelled_pairs(codebook, labels).where("la <> lb")
    return pairs.groupBy(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")).agg(F.avg("d").alias("val"))


def looseness_map(codebook: DataFrame, labels: DataFrame) -> DataFrame:
    """``(nid, label, val)``: each cell with the looseness of its cluster."""
    return labels.join(looseness(codebook, labels).select("label", "val"), "label").select("nid", "label", "val")


def separation(codebook: DataFrame, labels: DataFrame) -> DataFrame:
    """``(clusters, val)``: clusters times the mean looseness over the mean distance; null for one cluster.

    The looseness is averaged over cells, those of label 0 included; the distance over the square matrix of the
    clusters from 1 on, its diagonal of zeros included.
    """
    loose = looseness_map(codebook, labels).agg(F.max("label").alias("m"), F.avg("val").alias("l"))
    far = cluster_distance(codebook, labels.where("label > 0")).agg(2 * F.sum("val")).scalar()
    return loose.select(F.col("m").cast("long").alias("clusters"), F.when(F.col("m") > 1, F.col("m") * F.col("l") / (far / (F.col("m") * F.col("m")))).alias("val"))


def borders(codebook: DataFrame, rows: int, cols: int, steps) -> DataFrame:
    """``(src, dst, w)``: distances to planar neighbours as a share of the largest."""
    from lattix.operators.grid import edges

    found = edges(codebook, rows, cols, False, steps)
    return found.withColumn("w", F.col("w") / found.agg(F.max("w")).scalar())


def window_umatrix(codebook: DataFrame, rows: int, cols: int) -> DataFrame:
    """``(nid, val)``: mean of all pair distances within each planar 3 x 3 window."""
    around = neighbours(codebook, rows, cols, False).unionByName(codebook.select("nid", F.col("nid").alias("other")))
    one, two = around.select("nid", F.col("other").alias("a")), around.select("nid", F.col("other").alias("b"))
    pairs = one.join(two, "nid").where("a < b")  # at most 36 for each neuron
    return pairs.join(neuron_pairs(codebook), ["a", "b"]).groupBy("nid").agg(F.avg("d").alias("val"))


def histogram(values: DataFrame, value: str, bins: int) -> DataFrame:
    """``(bin, n)`` of even bins over the range, the last one closed; bins count from 0, empty ones are absent."""
    low, high = values.agg(F.min(value)).scalar(), values.agg(F.max(value)).scalar()
    at = F.least(F.floor((F.col(value) - low) / F.nullif(high - low, F.lit(0.0)) * bins), F.lit(bins - 1))
    return values.where(F.col(value).isNotNull()).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def equalized(field: DataFrame, bins: int = 256) -> DataFrame:
    """``field`` with values laid on 0 to 255 by the cumulated histogram, linear between the bins' left edges."""
    span = field.agg(F.min("val").alias("low"), F.max("val").alias("high"))
    low, high = span.select("low").scalar(), span.select("high").scalar()
    counts = histogram(field, "val", bins).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n")))).scalar()
    upto = lambda b: F.map_values(F.map_filter("counts", lambda k, _: k <= b))
    cumulated = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.aggregate(upto(b), F.lit(0).cast("long"), lambda s, x: s + x))
    whole = field.agg(F.count("val")).scalar()
    place = (F.col("val") - low) / F.nullif(high - low, F.lit(0.0)) * bins
    left = F.least(F.floor(place), F.lit(bins - 1)).cast("int")
    part = F.when(left == bins - 1, 0.0).otherwise(place - left)
    at = field.withColumn("counts", counts).withColumn("cum", cumulated).withColumn("left", F.coalesce(left, F.lit(0))).withColumn("part", F.coalesce(part, F.lit(0.0)))
    here, following = F.get("cum", F.col("left")), F.get("cum", F.least(F.col("left") + 1, F.lit(bins - 1)))
    return at.withColumn("val", 255.0 / whole * (here + F.col("part") * (following - here))).drop("counts", "cum", "left", "part")


def rank_diagonal(field: DataFrame) -> DataFrame:
    """``field`` with values projected on the line from the first to the last point (rank, value) of the distinct values."""
    distinct = field.select("val").distinct()
    ranked = distinct.select("val", (F.row_number().over(Window.orderBy("val")) - 1).cast("double").alias("rank"))  # a grid's values
    low, high = field.agg(F.min("val")).scalar(), field.agg(F.max("val")).scalar()
    last = distinct.agg(F.count("*") - 1).scalar().cast("double")
    share = (F.col("rank") * last + F.col("val") * (high - low)) / (last * last + (high - low) * (high - low))
    return field.join(ranked.withColumn("new", share * (high - low) + low), "val").select(*(F.col("new").alias("val") if c == "val" else c for c in field.columns))


def average_linkage(matrix: np.ndarray) -> list[tuple[int, int, float, int]]:
    """``(a, b, height, count)`` of agglomeration by mean distance; new clusters are numbered on from the last item.

    For the square matrix of a map's clusters, on the driver.
    """
    n = len(matrix)
    sizes, live, far = {i: 1 for i in range(n)}, list(range(n)), {(i, j): float(matrix[i, j]) for i in range(n) for j in range(i + 1, n)}
    out = []
    for new in range(n, 2 * n - 1):
        height, a, b = min((far[i, j], i, j) for x, i in enumerate(live) for j in live[x + 1 :])
        live = [k for k in live if k not in (a, b)]
        for k in live:
            near = lambda m: far[min(k, m), max(k, m)]  # noqa: E731, B023
            far[k, new] = (near(a) * sizes[a] + near(b) * sizes[b]) / (sizes[a] + sizes[b])
        sizes[new] = sizes[a] + sizes[b]
        live.append(new)
        out.append((a, b, height, sizes[new]))
    return out


def linkage(codebook: DataFrame) -> DataFrame:
    """``(step, a, b, height, n)`` of the neurons."""
    pairs = neuron_pairs(codebook).collect()
    index = {k: x for x, k in enumerate(sorted({p.a for p in pairs} | {p.b for p in pairs}))}
    matrix = np.zeros((len(index), len(index)))
    for p in pairs:
        matrix[index[p.a], index[p.b]] = matrix[index[p.b], index[p.a]] = p.d
    rows = [(k, *x) for k, x in enumerate(average_linkage(matrix))]
    return codebook.sparkSession.createDataFrame(rows, "step int, a int, b int, height double, n int")


def convergence(steps: DataFrame, error: str = "qe", by: str = "id") -> DataFrame:
    """``(*, rho, epsilon)``: largest error of the training steps so far, and each error as a share of it.

    Steps are sorted in blocks, so that a series of any length is spread over tasks.
    """
    rows = with_running_max(in_blocks(steps, [by], ["t"]), [by], ["t"], error, "rho").drop(BLOCK)
    return rows.withColumn("epsilon", F.col(error) / F.nullif(F.col("rho"), F.lit(0.0)))
