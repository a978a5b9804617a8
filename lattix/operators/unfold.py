"""Clusters of a toric map laid out on the plane, so that those across a seam come out in one piece."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.operators.grid import EIGHT
from lattix.plans.tables import written


def _steps(cells: DataFrame, rows: int, cols: int, steps) -> DataFrame:
    """``(src, dst, a, b)`` between cells of one label: ``dst`` is ``(a, b)`` away from ``src`` on the torus."""
    moved = cells.select(F.col("nid").alias("src"), "label", "i", "j", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps))).alias("s")).select("src", "label", "s.a", "s.b", "i", "j")
    moved = moved.withColumn("dst", (F.pmod(F.col("i") + F.col("a"), F.lit(rows)) * cols + F.pmod(F.col("j") + F.col("b"), F.lit(cols))).cast("int"))
    return moved.join(cells.select(F.col("nid").alias("dst"), "label"), ["dst", "label"]).where("src <> dst").select("src", "dst", "a", "b")


def unfolded(labels: DataFrame, rows: int, cols: int, steps=EIGHT) -> DataFrame:
    """``(nid, label, piece, u, v, wraps)`` of ``labels(nid, label)``: where each cell lies beside the others of its piece.

    A piece is what neighbours of one label connect on the torus, named by its least cell, which keeps its own place;
    all others count from there across the seams. ``wraps`` says that a piece closes around the torus, so that no
    layout keeps all neighbours side by side: each cell then has one of its places. Label 0 is left out.

    Each cell carries the least cell it knows of and its place from there; in a round it takes over what a neighbour
    knows, moved by the step between them, and what that cell knows in turn, so rounds grow with the logarithm of a
    piece's diameter. Every round is written; a place only changes together with a smaller name.
    """
    cells = labels.where("label <> 0").select("nid", "label", F.expr(f"nid div {cols}").cast("int").alias("i"), (F.col("nid") % cols).alias("j"))
    cells = written(cells, "cells")
    links = written(_steps(cells, rows, cols, steps), "steps")
    state = written(cells.select("nid", F.col("nid").alias("root"), F.lit(0).alias("u"), F.lit(0).alias("v")), "places")
    while True:
        known = state.select(F.col("nid").alias("dst"), F.col("root").alias("r"), F.col("u").alias("du"), F.col("v").alias("dv"))
        told = links.join(known, "dst").select(F.col("src").alias("nid"), F.struct(F.col("r").alias("root"), (F.col("du") - F.col("a")).alias("u"), (F.col("dv") - F.col("b")).alias("v")).alias("m"))
        least = told.groupBy("nid").agg(F.min("m").alias("m"))
        met = state.join(least, "nid", "left").select("nid", F.col("root").alias("old"), F.when(F.col("m.root") < F.col("root"), F.col("m")).otherwise(F.struct("root", "u", "v")).alias("m")).select("nid", "old", "m.*")
        up = met.select(F.col("nid").alias("root"), F.col("root").alias("next"), F.col("u").alias("nu"), F.col("v").alias("nv"))
        jumped = met.join(up, "root").select("nid", "old", F.col("next").alias("root"), (F.col("u") + F.col("nu")).alias("u"), (F.col("v") + F.col("nv")).alias("v"))
        jumped = written(jumped, "places")
        done = jumped.where("root <> old").isEmpty()
        state = jumped.drop("old")
        if done:
            break
    one = state.select(F.col("nid").alias("src"), "root", "u", "v")
    two = state.select(F.col("nid").alias("dst"), F.col("u").alias("du"), F.col("v").alias("dv"))
    torn = links.join(one, "src").join(two, "dst").groupBy("root").agg(F.bool_or((F.col("du") - F.col("u") != F.col("a")) | (F.col("dv") - F.col("v") != F.col("b"))).alias("wraps"))
    placed = state.join(cells.select("nid", "label"), "nid").join(torn, "root", "left")
    i, j = F.expr(f"root div {cols}").cast("int"), F.col("root") % cols
    return placed.select("nid", "label", F.col("root").alias("piece"), (i + F.col("u")).alias("u"), (j + F.col("v")).alias("v"), F.coalesce("wraps", F.lit(False)).alias("wraps"))


def unfolded_inputs(bmus: DataFrame, places: DataFrame) -> DataFrame:
    """``bmus(id, nid, ...)`` with the place of each input's neuron in the layout of ``unfolded``; inputs of no piece are left out."""
    return bmus.join(places.select("nid", "label", "piece", "u", "v"), "nid")
