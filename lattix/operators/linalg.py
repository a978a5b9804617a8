"""Matrix statistics of vector tables as aggregates; matrices in long form ``(r, c, val)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.functions.vectors import distance, total


def _products(centre: list[float] | None):
    def work(batches):
        n, sums, squares = 0, None, None
        for batch in batches:
            if batch.num_rows:
                if batch.column(0).null_count or batch.column(0).flatten().null_count:
                    raise ValueError("null vectors or elements; leave them out before")
                x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
                x = x if centre is None else x - np.array(centre)
                n, sums, squares = n + len(x), x.sum(0) + (0 if sums is None else sums), x.T @ x + (0 if squares is None else squares)
        if n:
            r, c = np.divmod(np.arange(squares.size), len(sums))
            cols = [r.astype(np.int32), c.astype(np.int32), np.full(len(r), n), sums[r], sums[c], squares.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["r", "c", "n", "sr", "sc", "src"])

    return work


def product_sums(data: DataFrame, centre: list[float] | None = None) -> DataFrame:
    """``(r, c, n, sr, sc, src)``: sums over rows of each pair of dimensions, about ``centre`` if given.

    Each partition gives one Gram matrix, so d x d rows for each are shuffled, whatever the number of inputs.
    """
    part = data.select("v").mapInArrow(_products(centre), "r int, c int, n long, sr double, sc double, src double")
    return part.groupBy("r", "c").agg(*(F.sum(k).alias(k) for k in ("n", "sr", "sc", "src")))


def scatter(data: DataFrame) -> DataFrame:
    """The scatter matrix about the mean, two passes for accuracy."""
    means = data.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"))
    mean = [r.m for r in means.orderBy("d").collect()]
    return product_sums(data, mean).select("r", "c", F.col("src").alias("val"))


def covariance(data: DataFrame) -> DataFrame:
    n = data.agg(F.count("*")).scalar()
    return scatter(data).withColumn("val", F.col("val") / n)


def correlation(matrix: DataFrame) -> DataFrame:
    """A covariance scaled by its diagonal."""
    own = matrix.where("r = c").select(F.col("r").alias("k"), F.sqrt("val").alias("s"))
    a, b = own.select(F.col("k").alias("r"), F.col("s").alias("sr")), own.select(F.col("k").alias("c"), F.col("s").alias("sc"))
    return matrix.join(a, "r").join(b, "c").select("r", "c", (F.col("val") / (F.col("sr") * F.col("sc"))).alias("val"))


def moments(data: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and scatter about the mean on the driver: d and d x d numbers, in two passes for accuracy."""
    means = data.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m")).orderBy("d").collect()
    mean = np.array([r.m for r in means])
    rows = product_sums(data, mean.tolist()).collect()
    out = np.zeros((len(mean), len(mean)))
    for r in rows:
        out[r.r, r.c] = r.src - r.sr * r.sc / r.n
    return rows[0].n, mean, out


def block_trace(matrix: DataFrame, size: int = 3) -> DataFrame:
    """Trace of each ``size`` x ``size`` block over ``size``."""
    r, c = F.floor(F.col("r") / size).cast("int"), F.floor(F.col("c") / size).cast("int")
    return matrix.where(F.col("r") % size == F.col("c") % size).groupBy(r.alias("r"), c.alias("c")).agg((F.sum("val") / size).alias("val"))


def block_mean(matrix: DataFrame, size: int = 3) -> DataFrame:
    r, c = F.floor(F.col("r") / size).cast("int"), F.floor(F.col("c") / size).cast("int")
    return matrix.groupBy(r.alias("r"), c.alias("c")).agg(F.avg("val").alias("val"))


def lower_triangle(matrix: DataFrame) -> DataFrame:
    return matrix.where("c < r")


def strongest(matrix: DataFrame, threshold: float, negative: bool = False) -> DataFrame:
    """Pairs below the diagonal of one sign beyond ``threshold``, strongest first."""
    sign = F.col("val") < -threshold if negative else F.col("val") > threshold
    return lower_triangle(matrix).where(sign).orderBy(F.col("val").asc() if negative else F.col("val").desc(), "r", "c")


def rms(matrix: DataFrame, size: int = 3) -> DataFrame:
    """``(atom, axis, val)``: roots of the diagonal, ``size`` for each atom."""
    return matrix.where("r = c").select(F.floor(F.col("r") / size).cast("int").alias("atom"), (F.col("r") % size).alias("axis"), F.sqrt("val").alias("val"))


def atoms(data: DataFrame) -> DataFrame:
    """``(id, xyz)``: vectors of 3 n numbers as arrays of points."""
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 3).cast("int") - 1), lambda k: F.slice("v", k * 3 + 1, 3))
    return data.withColumn("xyz", points).drop("v")


def pair_distances(points: DataFrame) -> DataFrame:
    """``(id, a, b, d)`` of the points of each row, a < b: the whole row's work stays in it."""
    pair = F.flatten(F.transform("xyz", lambda p, a: F.transform("xyz", lambda q, b: F.struct(a.alias("a"), b.alias("b"), distance(p, q).alias("d")))))
    return points.select("id", F.explode(F.filter(pair, lambda x: x["a"] < x["b"])).alias("e")).select("id", "e.*")


def drid(points: DataFrame) -> DataFrame:
    """``(id, atom, mu, nu, xi)``: moments of the inverse distances of each point to the others; the third root keeps its sign."""
    others = F.transform("xyz", lambda p, a: F.transform(F.filter(F.transform("xyz", lambda q, b: F.struct(b.alias("b"), q.alias("q"))), lambda x: x["b"] != a), lambda x: 1 / distance(p, x["q"])))
    rows = points.select("id", F.posexplode(others).alias("atom", "inv"))
    rows = rows.withColumn("mu", total(F.col("inv")) / F.size("inv"))
    moment = lambda n: total(F.transform("inv", lambda x: F.pow(x - F.col("mu"), F.lit(float(n))))) / F.size("inv")
    third = moment(3)
    return rows.select("id", "atom", "mu", F.sqrt(moment(2)).alias("nu"), (F.signum(third) * F.cbrt(F.abs(third))).alias("xi"))


def restraint_potential(r, r0: float, r1: float, r2: float, k: float = 1.0):
    """Flat between r0 and r1, square beyond, linear from r2."""
    return F.when(r < r0, k / 2 * (r - r0) * (r - r0)).when(r <= r1, 0.0).when(r <= r2, k / 2 * (r - r1) * (r - r1)).otherwise(k / 2 * (r2 - r1) * (2 * r - r2 - r1))


def kabsch(points: DataFrame, reference: list[list[float]]) -> DataFrame:
    """``(id, rmsd)`` after the best rotation onto ``reference``."""
    ref = np.array(reference, float)
    ref = ref - ref.mean(0)

    @F.arrow_udf("double")
    def of(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows:
            a = np.array(r.as_py(), float)
            a = a - a.mean(0)
            u, s, vt = np.linalg.svd(a.T @ ref)
            s[-1] *= np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0
            out.append(float(np.sqrt(max(0.0, ((a**2).sum() + (ref**2).sum() - 2 * s.sum()) / len(ref)))))
        return pa.array(out, pa.float64())

    return points.select("id", of("xyz").alias("rmsd"))
