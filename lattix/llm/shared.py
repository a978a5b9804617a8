"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word everywhere in this subpackage (ASCII white space parts words).
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of text that one Arrow batch to or from a Python worker holds, about; rows of a batch are Spark's own setting.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. A temporary one only where none is set and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lattix-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, after bounding the session's Arrow batches in bytes where nobody has: ten thousand long texts don't fit a worker."""
    conf = docs.sparkSession.conf
    if conf.get(_BATCH, "1b") == "1b":
        conf.set(_BATCH, str(BATCH_BYTES))
    return docs


def stash(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage: what reads the result does not depend on executors that made it, and it is computed once.
    Spark knows its size on disk, so it broadcasts it in a join only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = f"{shared_dir(df.sparkSession)}/lattix-{tag}-{uuid.uuid4().hex}"
    for paths in _recording:
        paths.append(path)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_recording: list[list[str]] = []


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """While it lasts, ``stash`` adds the paths that it writes to ``paths``."""
    _recording.append(paths)
    try:
        yield
    finally:
        _recording.remove(paths)


def clear(docs: DataFrame, paths: list[str]) -> None:
    """Deletes the tables at ``paths`` and empties the list, if ``docs`` is read from files and from none of them.

    For the beginning of a step whose input has been written elsewhere: then nothing reads what the steps before it
    wrote for themselves. A table that is not read from files clears nothing.
    """
    files = docs.inputFiles()
    if files and not any(p.rsplit("/", 1)[-1] in f for f in files for p in paths):
        spark, jvm = docs.sparkSession, docs.sparkSession._jvm
        while paths:
            path = jvm.org.apache.hadoop.fs.Path(paths.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, *apart: str) -> DataFrame:
    """The columns ``apart`` of ``docs`` and all others in a struct ``row``, so that a job's own names can't clash with them."""
    rest = [quoted(c) for c in docs.columns if c not in apart]
    return docs.select(*apart, (F.struct(*rest) if rest else F.lit(None)).alias("row"))


def unpacked(df: DataFrame, names: list[str], *apart: str) -> DataFrame:
    """The columns ``names`` of what ``packed`` made."""
    return df.select(*(F.col(c) if c in apart else F.col("row").getField(c).alias(c) for c in names))


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``rank`` from 0 in ``order``: rows are range-sorted and written, then numbered by file and row, so no task has them all."""
    rows = stash(df.orderBy(*order), "ranked").select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = rows.groupBy(F.col("__file").alias("__name")).agg(F.count("*").alias("__n"))
    before = counts.select("__name", (F.sum("__n").over(Window.orderBy("__name")) - F.col("__n")).alias("__before"))
    return rows.join(before, F.col("__file") == F.col("__name")).withColumn("rank", F.col("__before") + F.col("__row")).drop("__file", "__row", "__name", "__n", "__before")
