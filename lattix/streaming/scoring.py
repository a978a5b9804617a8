"""A map on a stream: scoring, hits in windows of event time, and training by mini-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.operators.bmu import assign_arrow
from lattix.operators.train import batch_step, fixed


def score(stream: DataFrame, codebook: DataFrame) -> DataFrame:
    """A stream ``(id, v, ...)`` with ``nid, i, j, qe`` in place of ``v``: stateless, so it appends. Event times pass, for ``windowed_hits``."""
    return assign_arrow(stream, codebook)


def windowed_hits(scored: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(start, nid, hits, mean_qe)`` by window of event time; rows later than the watermark are dropped."""
    counted = scored.withWatermark(at, late).groupBy(F.window(at, width), "nid").agg(F.count("*").alias("hits"), F.avg("qe").alias("mean_qe"))
    return counted.select(F.col("window.start").alias("start"), "nid", "hits", "mean_qe")


def mini_batch_trainer(codebook: DataFrame, rows: int, cols: int, radius: float, rate: float = 0.5, path: str | None = None) -> tuple[Callable[[DataFrame, int], None], Callable[[], DataFrame]]:
    """``(on_batch, current)`` for ``writeStream.foreachBatch``: each batch moves the map by ``rate`` towards its batch update.

    With ``path``, a shared folder, the map is written after each batch, and a trainer that is made anew goes on from
    the last one: a batch that comes again after a restart has been learnt and is passed over.
    """
    spark = codebook.sparkSession
    held, last = [fixed(codebook)], -1
    if path is not None:
        try:
            saved = spark.read.parquet(path)
            last = saved.agg(F.max("batch")).first()[0]
            held = [fixed(saved.where(F.col("batch") == last).select("nid", "i", "j", "w"))]
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
    done = [last]

    def on_batch(batch: DataFrame, number: int) -> None:
        if number <= done[0] or batch.isEmpty():
            return
        new = batch_step(batch, held[0], rows, cols, radius).select("nid", F.col("w").alias("new"))
        moved = F.zip_with("w", "new", lambda a, b: a + rate * (b - a))
        held[0] = fixed(held[0].join(new, "nid", "left").select("nid", "i", "j", F.coalesce(moved, "w").alias("w")))
        done[0] = number
        if path is not None:
            held[0].coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return on_batch, lambda: held[0]
