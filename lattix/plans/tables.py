"""Results that several steps read: written once, which also cuts the plan between rounds of an iteration."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lattix-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again."""
    path = f"{folder(df.sparkSession)}/map-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BLOCK = "__block"


def in_blocks(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``df`` sorted by ``key`` and ``order`` over all partitions and written, each file a ``BLOCK``: a key with most rows lies in many."""
    return written(df.orderBy(*key, *order), "blocks").select("*", F.col("_metadata.file_name").alias(BLOCK))


def _beside(rows: DataFrame, parts: DataFrame, key: list[str], *columns: str) -> DataFrame:
    """``rows`` with ``columns`` of their key's and block's row of ``parts``; null keys are a key."""
    named = parts.select(*(F.col(k).alias(f"__k{n}") for n, k in enumerate(key)), F.col(BLOCK).alias("__at"), *columns)
    on = F.col(BLOCK) == F.col("__at")
    for n, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{n}"))
    return rows.join(named, on).drop("__at", *(f"__k{n}" for n in range(len(key))))


def with_next(rows: DataFrame, key: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """``rows`` of ``in_blocks`` with ``out``, ``value`` in the key's next row: within a block, or the first of the block after it. The last row has null."""
    held = rows.withColumn("__value", F.struct(value.alias("x")))
    firsts = held.groupBy(*key, BLOCK).agg(F.min(F.struct(*order, "__value")).alias("first"))
    ahead = firsts.withColumn("__ahead", F.lead("first").over(Window.partitionBy(*key).orderBy("first"))["__value"])  # a row for each block
    own = F.lead("__value").over(Window.partitionBy(*key, BLOCK).orderBy(*order))
    return _beside(held.withColumn("__own", own), ahead, key, "__ahead").withColumn(out, F.coalesce("__own", "__ahead")["x"]).drop("__own", "__ahead", "__value")


def with_running_max(rows: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` of ``in_blocks`` with ``out``, the largest ``value`` of the key up to the row: within a block, and of the blocks before it."""
    parts = rows.groupBy(*key, BLOCK).agg(F.min(F.struct(*order)).alias("first"), F.max(value).alias("most"))
    before = Window.partitionBy(*key).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    parts = parts.withColumn("__before", F.max("most").over(before))
    own = F.max(value).over(Window.partitionBy(*key, BLOCK).orderBy(*order))
    return _beside(rows.withColumn("__own", own), parts, key, "__before").withColumn(out, F.greatest("__own", "__before")).drop("__own", "__before")


def with_number(rows: DataFrame, key: list[str], order: list[str], out: str) -> DataFrame:
    """``rows`` of ``in_blocks`` numbered from 1 within their key: within a block, after the rows of the blocks before it."""
    parts = rows.groupBy(*key, BLOCK).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    parts = parts.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*key, BLOCK).orderBy(*order))
    return _beside(rows.withColumn("__own", own), parts, key, "__before").withColumn(out, F.col("__own") + F.col("__before")).drop("__own", "__before")
