"""Values of an atom matrix laid on atoms: eigenvectors, and contrasts of any two clusters of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_rows(matrix: DataFrame, size: int = 3) -> DataFrame:
    """``(r, c, v)``: each ``size`` x ``size`` block of ``matrix(r, c, val)``, row by row; one with a missing cell has null there."""
    n = F.col("r") % size * size + F.col("c") % size
    cells = matrix.select(F.expr(f"r div {size}").cast("int").alias("br"), F.expr(f"c div {size}").cast("int").alias("bc"), n.cast("int").alias("n"), "val")
    held = cells.groupBy("br", "bc").agg(F.map_from_entries(F.collect_list(F.struct("n", "val"))).alias("m"))
    return held.select(F.col("br").alias("r"), F.col("bc").alias("c"), F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.try_element_at("m", k)).alias("v"))


def row_vectors(matrix: DataFrame) -> DataFrame:
    """``(id, v)``: the rows of ``matrix(r, c, val)`` as inputs of a map."""
    return matrix.groupBy(F.col("r").cast("long").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "val"))), lambda x: x["val"]).alias("v"))


def eigen_projection(components: DataFrame, component: int) -> DataFrame:
    """``(atom, val)``: how much a component of ``principal_components`` moves each atom: its three entries times the eigenvalue, without their signs, one row an entry."""
    one = components.where(F.col("component") == component)
    return one.select("value", F.posexplode("v").alias("k", "x")).select(F.expr("k div 3").alias("atom"), (F.col("k") % 3).alias("axis"), F.abs(F.col("value") * F.col("x")).alias("val"))


def atom_spread(covariance: DataFrame) -> DataFrame:
    """``(atom, val)``: the root of the mean variance of each atom's three coordinates, as a share of the largest."""
    own = covariance.where("r = c").groupBy(F.expr("r div 3").cast("int").alias("atom")).agg(F.sqrt(F.sum("val") / 3).alias("val"))
    return own.withColumn("val", F.col("val") / F.nullif(own.agg(F.max("val")).scalar(), F.lit(0.0)))


def contrasts(labels: DataFrame, spread: DataFrame) -> DataFrame:
    """``(one, two, atom, val)`` for each two clusters of ``labels(atom, label)``, ``one`` the smaller label: the spread of
    an atom of the first, minus that of an atom of the second; other atoms, whose value is 0, are left out.

    Each atom meets the labels that there are, not the other atoms.
    """
    kinds = labels.select("label").distinct().agg(F.array_sort(F.collect_set("label")).alias("kinds")).scalar()
    met = labels.join(spread, "atom").withColumn("other", F.explode(kinds)).where("other <> label")
    sign = F.when(F.col("label") < F.col("other"), 1.0).otherwise(-1.0)
    return met.select(F.least("label", "other").alias("one"), F.greatest("label", "other").alias("two"), "atom", (sign * F.col("val")).alias("val"))


def displacements(labels: DataFrame, covariance: DataFrame) -> DataFrame:
    """``(one, two, atom, axis, val)`` for each two clusters: how far each atom of either is moved along each axis, the root of its variance."""
    own = covariance.where("r = c").select(F.expr("r div 3").cast("int").alias("atom"), (F.col("r") % 3).alias("axis"), F.sqrt("val").alias("val"))
    kinds = labels.select("label").distinct().agg(F.array_sort(F.collect_set("label")).alias("kinds")).scalar()
    met = labels.withColumn("other", F.explode(kinds)).where("other <> label").join(own, "atom")
    return met.select(F.least("label", "other").alias("one"), F.greatest("label", "other").alias("two"), "atom", "axis", "val")
