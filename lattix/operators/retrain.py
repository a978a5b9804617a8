"""Rating a map's clusters by how they part actives from others, and training again on what the best cluster holds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.operators import bmu, codebook, separations, train
from lattix.plans.tables import written


def merge_clusters(book: DataFrame, rows: int, cols: int, hits: DataFrame) -> tuple[DataFrame, list[float]]:
    """``(cluster, born, died, neurons, k, u)`` of every cluster along the merges of a map, from ``hits(nid, k, u)``.

    A cluster stands after ``born`` merges and until the one of number ``died``; ``neurons`` are its members, its least
    one names it. A map of n neurons has 2 n - 1; the sum of their members is n * n / 2 at most. Beside it the least
    threshold of each step.
    """
    cells, height, merges, border = separations.merges(book, rows, cols)
    counts = {r.nid: (r.k, r.u) for r in hits.join(book.select("nid"), "nid", "left_semi").collect()}  # a row for each neuron at most
    nid = [r.nid for r in cells]
    own = {x: ([n], *counts.get(n, (0, 0)), 0) for x, n in enumerate(nid)}
    # Equal heights are one step: only the last of them is a clustering that a threshold makes.
    step = np.searchsorted(np.unique(height), height) + 1
    out = []
    for (a, b), t in zip(merges.tolist(), step.tolist()):
        for x in (a, b):
            members, k, u, born = own[x]
            if born < t:
                out.append((min(members), born, t, sorted(members), k, u))
        one, two = own[a], own.pop(b)
        own[a] = (one[0] + two[0], one[1] + two[1], one[2] + two[2], t)
    last = int(step[-1]) + 1 if len(step) else 1
    out += [(min(m), born, last, sorted(m), k, u) for m, k, u, born in own.values()]
    found = book.sparkSession.createDataFrame(out, "cluster int, born int, died int, neurons array<int>, k long, u long")
    cuts = np.concatenate([[0.0], np.unique(height) / (border or 1.0)])
    return found, [float(c) for c in cuts]


def roc_merges(book: DataFrame, rows: int, cols: int, bmus: DataFrame, active: Column, by_sensitivity: bool = False) -> DataFrame:
    """``(step, cut, clusters, cluster, neurons, se, sp, gamma)``: the best cluster of each clustering that a threshold of the planar map's borders makes.

    ``cut`` is the least threshold of the clustering, as in ``separation_sweep``; ``clusters`` counts those with inputs,
    and only these are rated: by the distance ``gamma`` to the perfect corner, or first by sensitivity. Ties go to the
    cluster of the least neuron. Inputs are counted by neuron before; along the merges counts are sums, and a cluster
    is rated once and spread over the steps that it lasts.
    """
    hits = bmus.groupBy("nid").agg(F.count_if(active).alias("k"), F.count_if(~active).alias("u"))
    hits = written(hits, "hits")
    found, cuts = merge_clusters(written(book.select("nid", "i", "j", "w"), "book"), rows, cols, hits)
    k, u = hits.agg(F.sum("k")).scalar(), hits.agg(F.sum("u")).scalar()
    rated = found.where("k + u > 0").withColumn("se", F.col("k") / F.nullif(k, F.lit(0))).withColumn("sp", 1 - F.col("u") / F.nullif(u, F.lit(0)))
    rated = rated.withColumn("gamma", F.sqrt((1 - F.col("sp")) * (1 - F.col("sp")) + (1 - F.col("se")) * (1 - F.col("se"))))
    lasting = rated.withColumn("step", F.explode(F.sequence("born", F.col("died") - 1)))
    order = ["less", "gamma", "cluster"] if by_sensitivity else ["gamma", "cluster"]
    best = lasting.withColumn("less", -F.col("se")).groupBy("step").agg(F.count("*").alias("clusters"), F.min_by(F.struct("cluster", "neurons", "se", "sp", "gamma"), F.struct(*order)).alias("b"))
    cut = F.get(F.array(*map(F.lit, cuts)), F.col("step"))
    return best.select("step", cut.alias("cut"), "clusters", "b.*")


def best_step(steps: DataFrame, by_sensitivity: bool = False) -> DataFrame:
    """The row of ``roc_merges`` of least gamma, or of most sensitivity and then least gamma; the first of equal ones."""
    order = F.struct(-F.col("se"), "gamma", "step") if by_sensitivity else F.struct("gamma", "step")
    known = steps.where("gamma is not null")
    return known.agg(F.min_by(F.struct(*steps.columns), order).alias("b")).where("b is not null").select("b.*")


def trainer(rows: int, cols: int, radii: list[float], seed: int = 0) -> Callable[[DataFrame], DataFrame]:
    """Training by batch steps from a random map within the bounds of the data; a map is planar, as the clusters are."""
    return lambda data: train.batch_train(data, codebook.random_init(data, rows, cols, seed), rows, cols, radii, toric=False)


def narrowed(data: DataFrame, active: Column, rows: int, cols: int, learn: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, rate and keep the inputs of the best cluster, again and again, until their number stays.

    ``data(id, v, ...)`` -> ``rounds(round, n, cut, clusters, se, sp, gamma, held)``, ``members(id)`` and ``maps(round, nid, i, j, w)``. The best
    cluster is that of most sensitivity; a round whose best cluster misses an active ends it, and the members of the
    round before stand (all inputs, if it is the first). Inputs and maps of each round are written; only a row comes
    to the driver.
    """
    spark = data.sparkSession
    inputs, told, maps, before = written(data, "inputs"), [], None, None
    members = inputs.select("id")
    while True:
        book = written(learn(inputs.select("id", "v")), "map")
        own = book.select(F.lit(len(told)).alias("round"), "nid", "i", "j", "w")
        maps = own if maps is None else maps.unionByName(own)
        bmus = written(bmu.assign(inputs, book), "bmus")
        best = best_step(roc_merges(book, rows, cols, bmus, active, True), True).first()
        if best is None:
            break
        inside = bmus.where(F.col("nid").isin(best.neurons)).select("id")
        kept = written(inputs.join(inside.distinct(), "id", "left_semi"), "inputs")
        held = kept.count()
        told.append((len(told), inputs.count(), best.cut, best.clusters, best.se, best.sp, best.gamma, held))
        if best.se != 1:
            break
        inputs, members = kept, kept.select("id")
        if held == before:
            break
        before = held
    rounds = spark.createDataFrame(told, "round int, n long, cut double, clusters long, se double, sp double, gamma double, held long")
    return rounds, members, maps


def learning_sizes(data: DataFrame, active: Column, rows: int, cols: int, learn: Callable[[DataFrame], DataFrame], step: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Maps trained on all actives and 0, ``step``, 2 ``step``, ... others, each rated on all inputs.

    -> ``sizes(others, se, sp, gamma, best, most_sensitive)`` and ``maps(others, nid, i, j, w)``. ``step`` is the number
    of actives if it is not given. Others come in the order of their hashed id, so a size holds the smaller ones. The
    best size is that of least gamma; the most sensitive one that of most sensitivity, then of least gamma (the first
    of equal ones).
    """
    data = written(data.withColumn("active", active), "inputs")
    actives, others = data.agg(F.count_if("active"), F.count_if(~F.col("active"))).first()
    step = step or max(1, actives)
    told, maps = [], None
    # The largest hash of each size's others: one sorted pass over (hash, id), of which a size takes a prefix.
    order = data.where("not active").select(F.xxhash64("id").alias("h"), "id")
    for n in range(0, others, step):
        some = order.orderBy("h", "id").limit(n).select("id") if n else order.select("id").limit(0)
        taken = data.where("active").unionByName(data.where("not active").join(some, "id", "left_semi"))
        book = written(learn(written(taken.select("id", "v"), "taken")), "map")
        bmus = written(bmu.assign(data, book), "bmus")
        best = best_step(roc_merges(book, rows, cols, bmus, F.col("active"))).first()
        told.append((n, best.se, best.sp, best.gamma))
        own = book.select(F.lit(n).cast("long").alias("others"), "nid", "i", "j", "w")
        maps = own if maps is None else maps.unionByName(own)
    first = min(told, key=lambda x: (x[3], x[0]), default=None)
    widest = min(told, key=lambda x: (-x[1], x[3], x[0]), default=None)
    sizes = data.sparkSession.createDataFrame([(*x, x is first, x is widest) for x in told], "others long, se double, sp double, gamma double, best boolean, most_sensitive boolean")
    return sizes, maps
