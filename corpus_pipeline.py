"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Any column may be null and texts may be empty or very long. The first stage drops documents without ten words, so null
and empty texts end there; null languages and sources are groups and a source of their own. Documents of a null id
stay until the last stage, rows that are equal in all columns are treated alike, extra columns pass up to the last
stage whatever their names, and an empty table gives an empty result. A stage's result is to be written before the next
stage is called: that one, if its input is read from files, deletes what the stages before it wrote for themselves.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattix.llm import linededup, mixing, packing, quality, simhash
from lattix.llm.shared import clear, recorded, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """A stage that first deletes what those before it have left in the shared folder."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(docs, _left)
        with recorded(_left):
            return stage(spark, docs, sf_dir)

    return run


@_tidy
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep; repeated rows stay or go together."""
    return quality.keep_good(docs)


@_tidy
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; documents that have nothing else are dropped. Rows of equal id and text are one document."""
    return linededup.drop_repeated(docs)


@_tidy
def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more: that of the smallest id, with the rows that repeat it; groups of only null ids stay."""
    return simhash.keep_one_similar(docs)


@_tidy
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in training order; rows of equal id and text are one document."""
    return mixing.mixed_documents(docs)


@_tidy
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their ids and their sequences, numbered in training order."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", rules), ("line dedup", lines), ("simhash near-dedup", duplicates), ("mixing", mixture), ("packing", sequences)]
#: SQL can't express SimHash, the tokenizer or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{own}/stage{k}")
            docs = spark.read.schema(docs.schema).parquet(f"{own}/stage{k}")
    return docs
