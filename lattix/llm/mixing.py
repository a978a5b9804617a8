"""Mixing sources to target weights as a curriculum whose weights change over the training run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.llm.shared import WORD, packed, stash, unpacked

#: A source is read so many times at most.
MOST_EPOCHS = 3
#: Rows that one window partition orders, on average.
BLOCK = 2000
#: Schedule by a source's class (1, 2, 3, repeating): (time, relative weight) knots over the run, linear between them.
SCHEDULES: Mapping[int, list[tuple[float, float]]] = {1: [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)], 2: [(0.0, 1.0), (1.0, 1.0)], 3: [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]}


def source_targets(sizes: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """``(source, class, source_size, docs, target)`` from ``sizes(source, size)``.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Each gets its share of the sum of all sizes; targets
    stop at ``most`` times the source's size and the excess is shared by weight among the others until none is above.
    The result of that process is min(most * size, level * weight): sources are sorted by size / weight and the level
    is the first that no later source exceeds; of equal ratios the first has the highest. One row a source, ordered in one window.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ordered = by_source.withColumn("class", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1)
    cap = most * F.col("source_size")
    by_ratio = Window.orderBy(cap / F.col("class"), "class", F.asc_nulls_last("source"))
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("class").over(after)
    leveled = ordered.withColumn("level", F.when(level * F.col("class") <= cap, level))
    leveled = leveled.withColumn("level", F.max_by("level", F.when(F.col("level").isNotNull(), F.struct((-cap / F.col("class")).alias("ratio"), "level"))).over(Window.partitionBy()))
    return leveled.select("source", "class", "source_size", "docs", F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("class"), cap.cast("double"))).alias("target"))


def _segments(knots: list[tuple[float, float]]) -> Column:
    """The schedule's segments with the share of its integral before each."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    done = [sum(areas[:i]) / sum(areas) for i in range(len(areas) + 1)]
    return F.array(*(F.struct(F.lit(done[i]).alias("from"), F.lit(done[i + 1]).alias("to"), F.lit(a[0]).alias("t0"), F.lit(b[0] - a[0]).alias("dt"), F.lit(a[1]).alias("w0"), F.lit(b[1]).alias("w1")) for i, (a, b) in enumerate(zip(knots, knots[1:]))))


def position(share: Column, kind: Column, schedules: Mapping[int, list[tuple[float, float]]] = SCHEDULES) -> Column:
    """Time in [0, 1] at which a source of class ``kind`` has had ``share`` of its demand: the inverse of the integral.

    Within a linear segment the demand is quadratic in time; the root is taken in the form that holds for any slope.
    """
    table = F.when(F.lit(False), _segments(next(iter(schedules.values()))))
    for k, knots in schedules.items():
        table = table.when(kind == k, _segments(knots))
    s = F.get(F.filter(table, lambda x: (share <= x["to"]) | (x["to"] >= 1.0)), 0)
    part = (share - s["from"]) / (s["to"] - s["from"])
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + part * (s["w1"] * s["w1"] - s["w0"] * s["w0"]), F.lit(0.0)))
    return s["t0"] + s["dt"] * part * (s["w0"] + s["w1"]) / F.nullif(s["w0"] + root, F.lit(0.0))


def mix(docs: DataFrame, seed: int = 0, cut_last: bool = True, text: str = "text", id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``(id, size, source, source_size, target, taken, visits, *keep)`` for every row of ``docs(id, source, text)``.

    A source is a stream of its documents in hashed order, read again from the start when it ends: so many whole
    rounds, then part of one, until its target is met; no document comes more than ``MOST_EPOCHS`` times. The
    cumulative words before a visit say where in the run it stands. ``visits`` holds ``(epoch, words, position)`` of each.
    ``cut_last``: the document in which a stream ends is read up to there, so that words taken equal the rounded
    target; else it is read if over half of it is due. Running sums are made within hash blocks of some thousand rows,
    then over blocks, so that a source with most rows is spread out.

    Null texts and texts without a word have size 0 and are never visited, but returned; so is a source of size 0. Null sources are a source,
    the last. Rows of equal id are ordered by size; equal ones are interchangeable. Reruns agree. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    keep = keep or []
    sizes = docs.select(F.col(id).alias("id"), "source", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep)
    sizes = stash(sizes, "sizes")
    plan = stash(source_targets(sizes), "targets").withColumnRenamed("source", "p_source")
    rows = sizes.join(plan, sizes["source"].eqNullSafe(plan["p_source"])).drop("p_source")
    key = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    rows = rows.withColumn("key", key).withColumn("block", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32 * F.ceil(F.col("docs") / BLOCK)).cast("int"))
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    ahead = blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), (F.sum("words").over(Window.partitionBy("source").orderBy("block")) - F.col("words")).alias("ahead"))
    inside = Window.partitionBy("source", "block").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("within", F.sum("size").over(inside) - F.col("size"))
    ahead = stash(ahead, "blocks")
    rows = rows.join(ahead, rows["source"].eqNullSafe(ahead["b_source"]) & (rows["block"] == ahead["b_block"]))
    before = F.col("ahead") + F.col("within")
    due = F.round("target").cast("long")
    rest = lambda e: due - e * F.col("source_size") - before  # noqa: E731  words still due when this visit begins
    size = F.col("size")
    words = (lambda e: F.greatest(F.lit(0).cast("long"), F.least(size, rest(e)))) if cut_last else (lambda e: F.when(2 * rest(e) >= size, size).otherwise(F.lit(0).cast("long")))
    share = lambda e: F.least((e * F.col("source_size") + before) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(1.0))
    total = F.col("target")
    visits = F.filter(F.array(*(F.struct(F.lit(e).alias("epoch"), words(e).alias("words"), position(share(e), F.col("class")).alias("position")) for e in range(MOST_EPOCHS))), lambda v: v["words"] > 0)
    done = rows.withColumn("visits", visits)
    return done.select(F.col("id").alias(id), "size", "source", "source_size", total.alias("target"), F.aggregate("visits", F.lit(0).cast("long"), lambda n, v: n + v["words"]).alias("taken"), "visits", *keep)


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row for each visit with ``epoch``, ``words`` and ``position``, range-sorted by position (ties by id and epoch)."""
    visits = mixed.select("*", F.explode("visits").alias("v")).select(*(c for c in mixed.columns if c != "visits"), "v.epoch", "v.words", "v.position")
    return visits.orderBy("position", mixed.columns[0], "epoch")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` mixed: each document once for each whole visit, in training order, with the columns of ``docs``.

    Visits are found without the texts and joined to them by id and text hash; rows that repeat both are one document
    with the visits of all. Other columns pass, whatever their names.
    """
    hashed = packed(docs, "doc_id", "text", "source").withColumn("__key", F.struct("doc_id", F.xxhash64("text").alias("hash")))
    mixed = mix(hashed, seed, cut_last=False, keep=["__key"]).where(F.size("visits") > 0)
    visits = mixed.groupBy("__key").agg(F.flatten(F.collect_list("visits")).alias("__visits"))
    # One key for the join and the repeated rows, so that texts are shuffled once for both. A null id in it is like another.
    once = hashed.join(visits, "__key").dropDuplicates(["__key"])
    read = once.select("doc_id", "text", "source", "row", F.explode("__visits").alias("__visit"))
    return unpacked(read.orderBy("__visit.position", "doc_id", "__visit.epoch"), docs.columns, "doc_id", "text", "source")
