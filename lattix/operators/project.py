"""Aggregations of inputs onto the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.operators.grid import dense
from lattix.plans.tables import BLOCK, in_blocks, with_next, with_number


def density(bmus: DataFrame, cells: DataFrame) -> DataFrame:
    """Hits of each neuron, 0 where there are none."""
    return dense(bmus.groupBy("nid").agg(F.count("*").alias("val")), cells, 0)


def representatives(bmus: DataFrame) -> DataFrame:
    """``(nid, id, qe)``: the input nearest to each neuron that has any."""
    return bmus.groupBy("nid").agg(F.min(F.struct("qe", "id")).alias("m")).select("nid", "m.id", "m.qe")


def quantization_error(bmus: DataFrame) -> DataFrame:
    return bmus.groupBy("nid").agg(F.count("*").alias("hits"), F.avg("qe").alias("mean_qe"), F.max("qe").alias("max_qe"))


def projection(bmus: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """Mean of a scalar of the inputs on each neuron; null where there are none."""
    return dense(bmus.groupBy("nid").agg(F.avg(value).alias("val")), cells)


def active_map(bmus: DataFrame, cells: DataFrame, active: Column) -> DataFrame:
    """``(nid, i, j, actives, total)``."""
    counts = bmus.groupBy("nid").agg(F.count_if(active).alias("actives"), F.count("*").alias("total"))
    return cells.select("nid", "i", "j").join(counts, "nid", "left").fillna(0, ["actives", "total"])


def members(bmus: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label, n, id)``: the inputs of each cluster of neurons, a row each, with their number; label 0 is left out."""
    found = bmus.join(labels, "nid").where("label <> 0").select("label", "id")
    return found.join(found.groupBy("label").agg(F.count("*").alias("n")), "label").select("label", "n", "id")


def best_pose(scores: DataFrame, group: str, score: str, *more: str) -> DataFrame:
    """The row of least score of each group."""
    return scores.groupBy(group).agg(F.min(F.struct(score, *more)).alias("m")).select(group, "m.*")


def co_membership(a: DataFrame, b: DataFrame, id: str = "id", label: str = "nid") -> DataFrame:
    """``(label_a, label_b, n)``: how many inputs two clusterings put in each pair of clusters."""
    return a.select(id, F.col(label).alias("label_a")).join(b.select(id, F.col(label).alias("label_b")), id).groupBy("label_a", "label_b").agg(F.count("*").alias("n"))


def transitions(ordered: DataFrame, key: list[str], order: list[str], state: str = "nid") -> DataFrame:
    """``(src, dst, n)``: moves between successive states of each trajectory, which are sorted in blocks, so that one of any length is spread over tasks."""
    rows = in_blocks(ordered.select(*key, *order, state), key, order)
    moved = with_next(rows, key, order, F.col(state), "dst").where(F.col("dst").isNotNull())
    return moved.groupBy(F.col(state).alias("src"), "dst").agg(F.count("*").alias("n"))


def flow(ordered: DataFrame, key: list[str], order: list[str], rows: int, cols: int, inward: bool = False, normed: bool = False) -> DataFrame:
    """``(nid, di, dj, moves)``: sum of unit vectors from each cell to the nearest image of the next on the torus; stays are skipped.

    ``inward``: from each cell to where the trajectory came from; ``normed``: the mean in place of the sum.
    """
    moved = steps(ordered, key, order, rows, cols).where("a <> 0 or b <> 0")
    length = F.sqrt((F.col("a") * F.col("a") + F.col("b") * F.col("b")).cast("double")) * (-1 if inward else 1)
    of = F.avg if normed else F.sum
    return moved.groupBy((F.col("next.nid") if inward else F.col("nid")).alias("nid")).agg(of(F.col("a") / length).alias("di"), of(F.col("b") / length).alias("dj"), F.count("*").alias("moves"))


def last_visits(ordered: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``(*key, nid, last)``: the number, from 1, of the last step that a trajectory takes from each cell; its last row takes none."""
    rows = with_next(with_number(in_blocks(ordered.select(*key, *order, "nid"), key, order), key, order, "number"), key, order, F.lit(True), "more")
    return rows.where("more").groupBy(*key, "nid").agg(F.max("number").alias("last"))


def steps(ordered: DataFrame, key: list[str], order: list[str], rows: int, cols: int) -> DataFrame:
    """``(*key, *order, nid, i, j, next, a, b)``: each state but a trajectory's last, and the step from it to the nearest image of the next on
    the torus; of two as near, the one that does not cross the seam."""
    placed = in_blocks(ordered.select(*key, *order, "nid", "i", "j"), key, order)
    moved = with_next(placed, key, order, F.struct("nid", "i", "j"), "next").where("next is not null").drop(BLOCK)

    def step(c: str, n: int) -> Column:
        d = F.col(f"next.{c}") - F.col(c)
        return F.when(2 * d > n, d - n).when(2 * d < -n, d + n).otherwise(d)

    return moved.withColumn("a", step("i", rows)).withColumn("b", step("j", cols))


def flux_classes(moves: DataFrame, classes: int) -> DataFrame:
    """``(src, dst, n, class)``: moves between different states in even classes of the largest count."""
    top = moves.where("src <> dst").agg(F.max("n").alias("top")).scalar()
    return moves.where("src <> dst").withColumn("class", F.ceil(F.col("n") * classes / top).cast("int"))


def roc_points(scored: DataFrame, score: str, active: Column, bins: int = 64) -> DataFrame:
    """``(score, tp, fp, fpr, tpr)``: cumulated counts after each distinct score in ascending order.

    Counts of distinct scores are summed within ``bins`` ranges between approximate quantiles, and the ranges' totals
    before them, so that no task has all rows, however the scores are spread.
    """
    per = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(active).alias("p"), F.count_if(~active).alias("n"))
    cuts = per.agg(F.percentile_approx("score", [k / bins for k in range(1, bins)]).alias("cuts")).scalar()
    per = per.withColumn("cuts", cuts).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("score")))).drop("cuts")
    totals = per.groupBy("bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    w = Window.orderBy("bin")  # one row for each bin
    before = totals.select("bin", (F.sum("p").over(w) - F.col("p")).alias("bp"), (F.sum("n").over(w) - F.col("n")).alias("bn"), F.sum("p").over(Window.partitionBy()).alias("all_p"), F.sum("n").over(Window.partitionBy()).alias("all_n"))
    inside = Window.partitionBy("bin").orderBy("score")
    out = per.select("bin", "score", F.sum("p").over(inside).alias("ip"), F.sum("n").over(inside).alias("inn")).join(before, "bin")
    tp, fp = F.col("ip") + F.col("bp"), F.col("inn") + F.col("bn")
    return out.select("bin", "score", tp.alias("tp"), fp.alias("fp"), (fp / F.col("all_n")).alias("fpr"), (tp / F.col("all_p")).alias("tpr"))


def auc(scored: DataFrame, score: str, active: Column) -> DataFrame:
    """``(auc)``: the trapezoid sum over distinct scores: each has half of its own negatives' share of the positives before or in it."""
    per = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(active).alias("p"), F.count_if(~active).alias("n"))
    points = roc_points(scored, score, active).drop("bin")
    joined = points.join(per, "score")
    return joined.agg((F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def sensitivity(bmus: DataFrame, active: Column, label: str = "nid") -> DataFrame:
    """``(label, se, sp, gamma)`` of each cluster taken as the answer."""
    counts = bmus.groupBy(F.col(label).alias("label")).agg(F.count_if(active).alias("k"), F.count_if(~active).alias("u"))
    k, u = bmus.agg(F.count_if(active)).scalar(), bmus.agg(F.count_if(~active)).scalar()
    se, sp = F.col("k") / k, 1 - F.col("u") / u
    return counts.select("label", se.alias("se"), sp.alias("sp"), F.sqrt((1 - sp) * (1 - sp) + (1 - se) * (1 - se)).alias("gamma"))


def roc_sweep(bmus: DataFrame, sweep: DataFrame, active: Column) -> DataFrame:
    """``(step, cut, clusters, label, se, sp, gamma)``: the cluster nearest to the perfect corner at each step of ``graphs.threshold_sweep``.

    Inputs are counted by neuron before the sweep, so that only a map's rows meet its steps. Ties go to the smaller label.
    """
    hits = bmus.groupBy("nid").agg(F.count_if(active).alias("k"), F.count_if(~active).alias("u"))
    k, u = bmus.agg(F.count_if(active)).scalar(), bmus.agg(F.count_if(~active)).scalar()
    counts = sweep.join(hits, "nid", "left").fillna(0, ["k", "u"]).groupBy("step", "cut", "label").agg(F.sum("k").alias("k"), F.sum("u").alias("u"))
    rated = counts.withColumn("se", F.col("k") / F.nullif(k, F.lit(0))).withColumn("sp", 1 - F.col("u") / F.nullif(u, F.lit(0)))
    rated = rated.withColumn("gamma", F.sqrt((1 - F.col("sp")) * (1 - F.col("sp")) + (1 - F.col("se")) * (1 - F.col("se"))))
    best = rated.groupBy("step", "cut").agg(F.count("*").alias("clusters"), F.min(F.struct("gamma", "label", "se", "sp")).alias("b"))
    return best.select("step", "cut", "clusters", "b.label", "b.se", "b.sp", "b.gamma")


def roc_best(steps: DataFrame) -> DataFrame:
    """The row of ``roc_sweep`` with the smallest gamma, the earliest of equal ones."""
    columns = ["gamma", "step", "cut", "clusters", "label", "se", "sp"]
    return steps.where("gamma is not null").agg(F.min(F.struct(*columns)).alias("b")).where("b is not null").select(*(f"b.{c}" for c in columns))
