"""Codebooks: ``(nid, i, j, w)`` on a grid of ``rows`` x ``cols`` neurons, nid = i * cols + j."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions.vectors import doubles


def vectors(table: DataFrame, id: str = "vec_id", v: str = "embedding", *more: str) -> DataFrame:
    """``(id, v, *more)`` with double elements."""
    return table.select(F.col(id).alias("id"), doubles(v).alias("v"), *more)


def from_rows(table: DataFrame, rows: int, cols: int, id: str = "vec_id", v: str = "embedding") -> DataFrame:
    """The rows of id 0 to rows * cols - 1 as the grid."""
    n = F.col(id).cast("int")
    return table.where(F.col(id).between(0, rows * cols - 1)).select(n.alias("nid"), F.floor(n / cols).cast("int").alias("i"), (n % cols).alias("j"), doubles(v).alias("w"))


def bounds(data: DataFrame) -> DataFrame:
    """``(dim, low, high)`` of each dimension."""
    return data.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def _grid(spark: SparkSession, w: np.ndarray, cols: int) -> DataFrame:
    return spark.createDataFrame([(k, k // cols, k % cols, [float(x) for x in row]) for k, row in enumerate(w)], "nid int, i int, j int, w array<double>")


def random_init(data: DataFrame, rows: int, cols: int, seed: int = 0) -> DataFrame:
    """Uniform within the bounds of each dimension."""
    lim = np.array([(r.low, r.high) for r in bounds(data).orderBy("dim").collect()])
    w = np.random.default_rng(seed).uniform(lim[:, 0], lim[:, 1], (rows * cols, len(lim)))
    return _grid(data.sparkSession, w, cols)


def pca_init(data: DataFrame, rows: int, cols: int, seed: int = 0) -> DataFrame:
    """A plane through the first two principal components' ranges; the others uniform in theirs. One d x d matrix comes to the driver."""
    from lattix.operators.linalg import moments

    n, mean, scatter = moments(data)
    values, axes = np.linalg.eigh(scatter)
    order = np.argsort(-values)
    axes = axes[:, order]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    spark, flat = data.sparkSession, axes.T.tolist()
    scores = data.select(F.array(*(F.aggregate(F.zip_with("v", F.array(*map(F.lit, a)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for a in flat)).alias("v"))
    lim = np.array([(r.low, r.high) for r in bounds(scores).orderBy("dim").collect()]) - (mean @ axes)[:, None]
    coords = np.random.default_rng(seed).uniform(lim[:, 0], lim[:, 1], (rows * cols, len(lim)))
    coords[:, 0] = np.repeat(np.linspace(*lim[0], rows), cols)
    if len(lim) > 1:
        coords[:, 1] = np.tile(np.linspace(*lim[1], cols), rows)
    return _grid(spark, coords @ axes.T + mean, cols)
