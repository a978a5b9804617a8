"""Choosing atoms and residues: by values, by likeness to other atoms, by a docking motif; pairs of residues; matrices in another order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.operators.bmu import assign
from lattix.operators.contrasts import row_vectors


def chosen(atoms: DataFrame, values: Mapping[str, Sequence]) -> DataFrame:
    """The atoms that have one of the values in any of the fields; without fields all. A field that is null is none of them."""
    if not values:
        return atoms
    hit = F.lit(False)
    for field, some in values.items():
        hit = hit | F.coalesce(F.col(field).isin(list(some)), F.lit(False))
    return atoms.where(hit)


def same_as(atoms: DataFrame, picked: DataFrame, field: str, by: Sequence[str] = ("path",)) -> DataFrame:
    """The atoms of a structure whose ``field`` is that of one of its ``picked(count)`` atoms (null is like null)."""
    like = atoms.join(picked, [*by, "count"], "left_semi").select(*(F.col(k).alias(f"__{k}") for k in by), F.col(field).alias("__value")).distinct()
    on = F.col(field).eqNullSafe(F.col("__value"))
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return atoms.join(like, on, "left_semi")


def pocket(atoms: DataFrame, motif: DataFrame, by: str = "mol") -> DataFrame:
    """The atoms of each molecule that its ``motif(mol, resname, resid, atomname)`` names, numbered anew from 1 in their order.

    ``atoms`` are those of ``read_mol2``, whose residues are told by ``residue``, type and number in one word; rows of a
    motif that repeat count once. Numbers are made within a molecule, some thousand atoms.
    """
    named = motif.select(F.col(by).alias("__mol"), F.concat("resname", F.col("resid").cast("string")).alias("__residue"), F.col("atomname").alias("__name")).distinct()
    kept = atoms.join(named, (F.col(by) == F.col("__mol")) & (F.col("residue") == F.col("__residue")) & (F.col("atom_name") == F.col("__name")), "left_semi")
    order = Window.partitionBy(by).orderBy("atom_id")
    return kept.withColumn("atom_id", F.row_number().over(order))


def residue_pairs(atoms: DataFrame, by: str = "path", atomname: str = "CA") -> DataFrame:
    """``(path, resid1, seg1, resid2, seg2)`` of each two residues of a structure, less its first and last, in their order.

    A residue is told by its atom of the name. The square of a chain's length; structures are worked on in parallel.
    """
    ca = atoms.where(F.col("atomname") == atomname)
    ends = ca.groupBy(by).agg(F.min("count").alias("first"), F.max("count").alias("last"))
    inner = ca.join(ends, by).where((F.col("count") > F.col("first")) & (F.col("count") < F.col("last"))).select(by, "count", "resid", "segid")
    one = inner.select(by, F.col("count").alias("a"), F.col("resid").alias("resid1"), F.col("segid").alias("seg1"))
    two = inner.select(by, F.col("count").alias("b"), F.col("resid").alias("resid2"), F.col("segid").alias("seg2"))
    return one.join(two, by).where("a < b").select(by, "resid1", "seg1", "resid2", "seg2")


def co_clustered(labels: DataFrame) -> DataFrame:
    """``(r, c, val)`` for each two items of one cluster of ``labels(item, label)``, both ways and with itself: the cluster's label.

    For the clusters of a matrix' rows; the rest of the square is 0 and left out.
    """
    one, two = labels.select(F.col("item").alias("r"), "label"), labels.select(F.col("item").alias("c"), "label")
    return one.join(two, "label").select("r", "c", F.col("label").alias("val"))


def sorted_matrix(matrix: DataFrame, labels: DataFrame, size: int = 1) -> DataFrame:
    """``matrix(r, c, val)`` with rows and columns in the order of ``labels(item, label)``, then of items; an item has ``size`` of each (3: x, y, z)."""
    rank = (F.row_number().over(Window.orderBy("label", "item")) - 1).alias("rank")  # a row for each item
    placed = labels.select("item", rank)
    new = lambda c: placed.select(F.col("item").alias(f"{c}_item"), F.col("rank").alias(f"{c}_rank"))
    cells = matrix.withColumn("r_item", F.expr(f"r div {size}")).withColumn("c_item", F.expr(f"c div {size}"))
    joined = cells.join(new("r"), "r_item").join(new("c"), "c_item")
    return joined.select((F.col("r_rank") * size + F.col("r") % size).cast("int").alias("r"), (F.col("c_rank") * size + F.col("c") % size).cast("int").alias("c"), "val")


def rows_by_neuron(matrix: DataFrame, codebook: DataFrame) -> DataFrame:
    """``(r, c, val)``: each row of ``matrix`` as the map has learnt it, the weights of its best-matching unit."""
    found = assign(row_vectors(matrix), codebook).select("id", "nid")
    return found.join(codebook.select("nid", "w"), "nid").select(F.col("id").cast("int").alias("r"), F.posexplode("w").alias("c", "val"))
