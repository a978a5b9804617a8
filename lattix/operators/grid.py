"""Grid fields ``(nid, i, j, val)``: neighbours, U-matrix, extrema, slices, tiling."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions.vectors import distance

EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def neighbours(cells: DataFrame, rows: int, cols: int, toric: bool = True, steps=EIGHT) -> DataFrame:
    """``(nid, other)`` for each cell of ``cells`` and neighbour within the grid; coinciding neighbours of small tori once."""
    far = cells.select("nid", "i", "j", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps))).alias("s"))
    i, j = F.col("i") + F.col("s.a"), F.col("j") + F.col("s.b")
    if toric:
        i, j = F.pmod(i, F.lit(rows)), F.pmod(j, F.lit(cols))
    far = far.select("nid", i.alias("i"), j.alias("j"))
    far = far.where(F.col("i").between(0, rows - 1) & F.col("j").between(0, cols - 1))
    return far.select("nid", (F.col("i") * cols + F.col("j")).alias("other")).where("nid <> other").distinct()


def edges(codebook: DataFrame, rows: int, cols: int, toric: bool = True, steps=EIGHT) -> DataFrame:
    """``(src, dst, w)``: distance of each neuron to each neighbour, in both directions."""
    pairs = neighbours(codebook, rows, cols, toric, steps)
    a, b = codebook.select(F.col("nid"), F.col("w").alias("wa")), codebook.select(F.col("nid").alias("other"), F.col("w").alias("wb"))
    return pairs.join(a, "nid").join(b, "other").select(F.col("nid").alias("src"), F.col("other").alias("dst"), distance(F.col("wa"), F.col("wb")).alias("w"))


def umatrix(codebook: DataFrame, rows: int, cols: int, toric: bool = True) -> DataFrame:
    """``(nid, i, j, val)``: mean distance of a neuron to its neighbours; live cells only where rows are missing."""
    mean = edges(codebook, rows, cols, toric).groupBy(F.col("src").alias("nid")).agg(F.avg("w").alias("val"))
    return codebook.select("nid", "i", "j").join(mean, "nid", "left")


def extrema(field: DataFrame, rows: int, cols: int, least: bool = True, toric: bool = True) -> DataFrame:
    """The cells with no neighbour below (above) them; plateaus count."""
    pairs = neighbours(field, rows, cols, toric)
    other = field.select(F.col("nid").alias("other"), F.col("val").alias("far"))
    best = pairs.join(other, "other").groupBy("nid").agg((F.min if least else F.max)("far").alias("far"))
    return field.join(best, "nid").where(F.col("val") <= F.col("far") if least else F.col("val") >= F.col("far")).drop("far")


def basin(field: DataFrame, rows: int, cols: int, least: bool = True) -> DataFrame:
    """``(nid, target)``: the neighbour, or the cell itself, of least (largest) value: one step of descent, ties to the smallest nid."""
    pairs = neighbours(field, rows, cols).unionByName(field.select("nid", F.col("nid").alias("other")))
    value = F.col("far") if least else -F.col("far")
    far = pairs.join(field.select(F.col("nid").alias("other"), F.col("val").alias("far")), "other")
    return far.groupBy("nid").agg(F.min(F.struct(value.alias("v"), F.col("other"))).alias("m")).select("nid", F.col("m.other").alias("target"))


def gradient(codebook: DataFrame, field: DataFrame, rows: int, cols: int, signed: bool = True) -> DataFrame:
    """``(nid, di, dj)``: sum over the eight toric neighbours of the unit step towards them times their codebook distance.

    ``signed``: times the sign of how much lower the field is there, so that the sum points down.
    """
    own = field.join(codebook.select("nid", "w"), "nid")
    stepped = own.select("nid", "i", "j", "val", "w", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EIGHT))).alias("s"))
    other = (F.pmod(F.col("i") + F.col("s.a"), F.lit(rows)) * cols + F.pmod(F.col("j") + F.col("s.b"), F.lit(cols))).alias("other")
    stepped = stepped.select("nid", "val", "w", "s", other).join(own.select(F.col("nid").alias("other"), F.col("val").alias("far"), F.col("w").alias("wo")), "other")
    length = F.sqrt(F.col("s.a") * F.col("s.a") + F.col("s.b") * F.col("s.b"))
    pull = distance(F.col("w"), F.col("wo")) * (F.signum(F.col("val") - F.col("far")) if signed else F.lit(1.0))
    return stepped.groupBy("nid").agg(*(F.sum(pull * F.col(f"s.{k}") / length).alias(f"d{n}") for k, n in (("a", "i"), ("b", "j"))))


def neighbours_nd(spark: SparkSession, shape: tuple[int, ...], toric: bool = True) -> DataFrame:
    """``(nid, other)`` of a grid of any number of dimensions, the last one running fastest: all cells one step away along any axes."""
    steps = [s for s in product((-1, 0, 1), repeat=len(shape)) if any(s)]
    cells = spark.range(math.prod(shape)).select(F.col("id").cast("int").alias("nid"))
    far = cells.select("nid", F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps))).alias("s"))
    other, inside, size = F.lit(0), F.lit(True), math.prod(shape)
    for k, n in enumerate(shape):
        size //= n
        at = F.expr(f"nid div {size} % {n}") + F.col("s")[k]
        inside = inside & at.between(0, n - 1)
        other = other + F.pmod(at, F.lit(n)) * size
    far = far if toric else far.where(inside)
    return far.select("nid", other.cast("int").alias("other")).where("nid <> other").distinct()


def umatrix_nd(codebook: DataFrame, shape: tuple[int, ...], toric: bool = True) -> DataFrame:
    """``(nid, val)``: mean distance of a neuron to its neighbours on a grid of any number of dimensions."""
    pairs = neighbours_nd(codebook.sparkSession, shape, toric)
    a, b = codebook.select("nid", F.col("w").alias("wa")), codebook.select(F.col("nid").alias("other"), F.col("w").alias("wb"))
    return pairs.join(a, "nid").join(b, "other").groupBy("nid").agg(F.avg(distance(F.col("wa"), F.col("wb"))).alias("val"))


def slices(field: DataFrame, levels: int, band: bool = False) -> DataFrame:
    """``(level, nid)``: cells at or below each of ``levels`` even cuts of the range, or only those of the band below each."""
    span = field.agg(F.min("val").alias("low"), F.max("val").alias("high"))
    at = field.withColumn("span", F.struct(span.select("low").scalar().alias("low"), span.select("high").scalar().alias("high")))
    height = F.col("span.high") - F.col("span.low")
    first = F.greatest(F.lit(1), F.ceil((F.col("val") - F.col("span.low")) / height * levels - 1e-9)).cast("int")
    first = F.when(height > 0, first).otherwise(1)
    return at.select(F.explode(F.array(first) if band else F.sequence(first, F.lit(levels))).alias("level"), "nid")


def tiled(field: DataFrame, rows: int, cols: int, times: int) -> DataFrame:
    """``times`` x ``times`` copies side by side, with the cell each came from."""
    k = F.sequence(F.lit(0), F.lit(times - 1))
    spread = field.withColumn("a", F.explode(k)).withColumn("b", F.explode(k))
    return spread.select((F.col("i") + F.col("a") * rows).alias("u"), (F.col("j") + F.col("b") * cols).alias("v"), "nid", "val")


def rolled(field: DataFrame, rows: int, cols: int, di: int, dj: int) -> DataFrame:
    i, j = F.pmod(F.col("i") + di, F.lit(rows)), F.pmod(F.col("j") + dj, F.lit(cols))
    return field.select((i * cols + j).alias("nid"), i.alias("i"), j.alias("j"), "val")


def condensed(field: DataFrame, rows: int, cols: int) -> DataFrame:
    """``(i, j, val)``: ``field(u, v, val)`` of 3 x 3 tiles of ``rows`` x ``cols`` folded into one by the least value.

    0 stands for no value, and only values within the range of the tile at (1, 2) count; 0 where there is none.
    """
    tile = (F.expr(f"u div {rows}") * 3 + F.expr(f"v div {cols}")).alias("tile")
    known = field.select((F.col("u") % rows).alias("i"), (F.col("v") % cols).alias("j"), tile, F.nullif("val", F.lit(0.0)).alias("val"))
    span = known.where("tile = 5").agg(F.min("val").alias("low"), F.max("val").alias("high"))
    inside = known.withColumns({k: span.select(k).scalar() for k in ("low", "high")})
    return inside.groupBy("i", "j").agg(F.coalesce(F.min(F.when(F.col("val").between(F.col("low"), F.col("high")), F.col("val"))), F.lit(0.0)).alias("val"))


def dense(values: DataFrame, cells: DataFrame, fill: Column | float | int | None = None) -> DataFrame:
    """``values(nid, val)`` on all ``cells``; ``fill`` where there is none."""
    out = cells.select("nid", "i", "j").join(values, "nid", "left")
    return out if fill is None else out.withColumn("val", F.coalesce("val", F.lit(fill)))
