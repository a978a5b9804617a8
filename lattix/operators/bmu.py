"""Best-matching units: for each vector the nearest neurons of a codebook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.functions.kernels import gaussian, toric_squared
from lattix.functions.vectors import distance, total
from lattix.plans.tables import written

#: Neurons that are laid beside every vector at once; larger codebooks are met in blocks.
BLOCK = 4096


def candidates(data: DataFrame, codebook: DataFrame, measure: Callable[[Column, Column], Column] = distance, size: int | None = None) -> DataFrame:
    """``data`` with ``near``: ``(d, nid, i, j)`` of every neuron, one row for each vector and block of the codebook.

    A codebook of one block is read as a scalar subquery: no join, no shuffle. A larger one is joined by block.
    ``size``: of the codebook, where it is known.
    """
    cell = F.struct("nid", "i", "j", "w")
    near = lambda c: F.transform(c, lambda n: F.struct(measure(F.col("v"), n["w"]).alias("d"), n["nid"].alias("nid"), n["i"].alias("i"), n["j"].alias("j")))
    blocks = -(-(codebook.count() if size is None else size) // BLOCK)
    if blocks <= 1:
        one = codebook.agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        return data.withColumn("cells", one.scalar()).withColumn("near", near(F.col("cells"))).drop("cells")
    parts = codebook.groupBy((F.col("nid") % blocks).alias("block")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    sent = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return sent.join(parts, "block").withColumn("near", near(F.col("cells"))).drop("cells", "block")


def assign(data: DataFrame, codebook: DataFrame, measure: Callable[[Column, Column], Column] = distance) -> DataFrame:
    """``data`` less ``v``, with ``nid, i, j, qe`` of the nearest neuron (ties to the smallest nid)."""
    keep = [c for c in data.columns if c != "v"]
    many = (size := codebook.count()) > BLOCK
    if many:  # rows are told apart by a written key, so that repeated ones stay
        data = written(data.withColumn("__row", F.monotonically_increasing_id()), "rows")
    best = candidates(data, codebook, measure, size).select(*keep, *(["__row"] if many else []), F.array_min("near").alias("b"))
    if many:
        best = best.groupBy(*keep, "__row").agg(F.min("b").alias("b"))
    return best.select(*keep, "b.nid", "b.i", "b.j", F.col("b.d").alias("qe"))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as a matrix; fails on null vectors, null elements and other lengths, which would shift rows."""
    if column.null_count or column.flatten().null_count or len(column.flatten()) != len(column) * width:
        raise ValueError(f"vectors must have {width} elements, none of them null; leave others out before")
    return np.asarray(column.flatten(), float).reshape(len(column), width)


def whole(data: DataFrame, codebook: DataFrame) -> DataFrame:
    """``data`` with ``near`` of all neurons, one row for each input; without a shuffle for a codebook of one block."""
    if (size := codebook.count()) <= BLOCK:
        return candidates(data, codebook, size=size)
    keyed = written(data.withColumn("__row", F.monotonically_increasing_id()), "rows")
    near = candidates(keyed, codebook, size=size).groupBy("__row").agg(F.flatten(F.collect_list("near")).alias("near"))
    return keyed.join(near, "__row").drop("__row")


#: Numbers of a codebook that may be sent with a task.
SENT = 1 << 26


def gathered(codebook: DataFrame, limit: int = SENT) -> list:
    """The rows of a codebook by nid; fails where it has more than ``limit`` numbers, before more than that is collected."""
    rows = sorted(codebook.limit(limit // 8 + 1).collect(), key=lambda r: r.nid)  # sorted here, which spares a shuffle
    if len(rows) * (len(rows[0].w) if rows else 0) > limit:
        raise ValueError("the codebook is too large to send; use assign, or a smaller map")
    return rows


def assign_arrow(data: DataFrame, codebook: DataFrame, limit: int = SENT) -> DataFrame:
    """``data`` less ``v``, with ``nid, i, j, qe``, by NumPy over Arrow batches, which pays for large maps; the codebook (``limit`` numbers at most) goes with the task."""
    rows = gathered(codebook, limit)
    w = np.array([r.w for r in rows])
    nid, i, j = (np.array([r[k] for r in rows], np.int32) for k in ("nid", "i", "j"))
    square = (w**2).sum(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(batch.schema.get_field_index("v")), w.shape[1])
            best, far = np.empty(len(x), np.int64), np.empty(len(x))
            step = max(1, (1 << 20) // max(1, len(w)))
            for a in range(0, len(x), step):
                some = x[a : a + step]
                # The product finds the nearest, whose distance is then taken from the difference.
                near = (square[None, :] - 2 * (some @ w.T)).argmin(1)
                best[a : a + step], far[a : a + step] = near, np.sqrt(((some - w[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(nid[best]), pa.array(i[best]), pa.array(j[best]), pa.array(far)], [*keep, "nid", "i", "j", "qe"])

    keep = [c for c in data.columns if c != "v"]
    kinds = {f.name: f.dataType.simpleString() for f in data.schema}
    return data.mapInArrow(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "nid int, i int, j int, qe double"]))


def nearest(data: DataFrame, codebook: DataFrame, k: int) -> DataFrame:
    """``(id, rank, nid, qe)``: the ``k`` nearest neurons of each row."""
    top = whole(data, codebook).select("id", F.slice(F.array_sort("near"), 1, k).alias("top"))
    return top.select("id", F.posexplode("top").alias("rank", "b")).select("id", (F.col("rank") + 1).alias("rank"), "b.nid", F.col("b.d").alias("qe"))


def within_spread(data: DataFrame, codebook: DataFrame, scale: float = 1.0) -> DataFrame:
    """``(id, nid, d)``: each input's region, the neurons nearer than the mean of its distances less ``scale`` standard deviations."""
    far = whole(data, codebook).select("id", "near", F.transform("near", lambda x: x["d"]).alias("ds"))
    mean = far.withColumn("mean", total(F.col("ds")) / F.size("ds"))
    spread = F.sqrt(total(F.transform("ds", lambda d: (d - F.col("mean")) * (d - F.col("mean")))) / F.size("ds"))
    limited = mean.withColumn("limit", F.col("mean") - F.lit(float(scale)) * spread)
    return limited.select("id", F.explode(F.filter("near", lambda x: x["d"] < F.col("limit"))).alias("b")).select("id", "b.nid", "b.d")


def exponents(data: DataFrame, codebook: DataFrame, rows: int, cols: int, radius: float = 1.0) -> DataFrame:
    """``(id, nid, s)``: the best-matching unit, and minus the sum of squared distances, weighed by the kernel about it, over the largest one."""
    near = whole(data, codebook).select("id", "near", F.array_min("near").alias("b"))
    weighed = F.transform("near", lambda x: gaussian(toric_squared(x["i"], x["j"], F.col("b.i"), F.col("b.j"), rows, cols), F.lit(radius)) * x["d"] * x["d"])
    most = F.array_max(F.transform("near", lambda x: x["d"] * x["d"]))
    return near.select("id", "b.nid", (-total(weighed) / F.nullif(most, F.lit(0.0))).alias("s"))


def probability(data: DataFrame, codebook: DataFrame, rows: int, cols: int, radius: float = 1.0) -> DataFrame:
    """``(id, nid, p)``: each input's best-matching unit and the exponential of its ``exponents``; 1 where all distances are 0."""
    return exponents(data, codebook, rows, cols, radius).select("id", "nid", F.exp(F.coalesce("s", F.lit(0.0))).alias("p"))


def density_probability(data: DataFrame, codebook: DataFrame, rows: int, cols: int, radius: float = 1.0) -> DataFrame:
    """``(nid, p)``: the exponential of the mean exponent of the inputs that a neuron is best for; other neurons are absent."""
    return exponents(data, codebook, rows, cols, radius).groupBy("nid").agg(F.exp(F.avg(F.coalesce("s", F.lit(0.0)))).alias("p"))
