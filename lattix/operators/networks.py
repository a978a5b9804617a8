"""More on edge tables ``(src, dst, w)`` of a map's size: paths between many nodes, thresholds, reconnection, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.operators.bmu import nearest
from lattix.operators.graphs import CYCLE_CHECK, components, symmetrized, vertices
from lattix.plans.tables import written


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """``(src, near)``: each node's neighbours, nearest first. A grid's node has eight at most."""
    return edges.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "dst"))), lambda x: x["dst"]).alias("near"))


def distinct_weights(edges: DataFrame) -> DataFrame:
    return edges.select("w").distinct()


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """``edges`` less the pairs ``gone(src, dst)``."""
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def selected(edges: DataFrame, most: float, least: float = 0.0) -> DataFrame:
    """For each node its edges in order of weight, up to the first that is not between ``least`` and ``most``."""
    upto = Window.partitionBy("src").orderBy("w", "dst").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return edges.withColumn("ok", F.bool_and(F.col("w").between(least, most)).over(upto)).where("ok").drop("ok")


def covering(edges: DataFrame) -> DataFrame:
    """The edges up to the least weight at which every node has one."""
    own = edges.groupBy("src").agg(F.min("w").alias("w"))
    return edges.where(F.col("w") <= own.agg(F.max("w")).scalar())


def grown(edges: DataFrame) -> DataFrame:
    """The edges that a growing threshold takes in, without the long ones between parts that shorter ones join already.

    Thresholds are the distinct weights in order. Each looks at the nodes whose own shortest edge is not below the
    lower limit, and at all their edges up to the threshold. If these touch as many nodes as at the threshold before,
    nothing is taken and the threshold becomes the lower limit; else all are taken. It ends when all nodes are touched.

    A lower limit changes what is looked at only once it passes some node's shortest edge, so a round finds all
    thresholds up to there at once: each node's first threshold is a grouped minimum, their counts a running sum over
    the weights (a map's number of rows). There are fewer rounds than nodes; each takes one row to the driver.
    """
    edges = written(edges.select("src", "dst", "w"), "edges")
    own = edges.groupBy("src").agg(F.min("w").alias("own"))
    edges = written(edges.join(own, "src"), "growing")
    everyone = vertices(edges).count()
    weights = edges.select("w").distinct()
    low, before, at = float("-inf"), -1, float("-inf")
    taken = []
    while True:
        seen = edges.where(F.col("own") >= low)
        least = seen.agg(F.min("own")).first()[0]
        if least is None:
            break
        first = seen.select(F.explode(F.array("src", "dst")).alias("node"), "w").groupBy("node").agg(F.min("w").alias("w")).groupBy("w").agg(F.count("*").alias("new"))
        order = Window.orderBy("w")
        curve = weights.join(first, "w", "left").select("w", F.sum(F.coalesce("new", F.lit(0))).over(order).alias("n")).where(F.col("w") > at)
        curve = curve.withColumn("stall", F.col("n") == F.lag("n", 1, before).over(order))
        ends = (F.col("stall") & (F.col("w") > least)) | (F.col("n") == everyone)
        curve = written(curve.withColumn("end", ends), "curve")
        end = curve.where("end").agg(F.min_by(F.struct("w", "stall"), "w")).first()[0]
        upto = curve if end is None else curve.where(F.col("w") <= end["w"])
        grew = upto.where("not stall").agg(F.max(F.struct("w", "n"))).first()[0]
        if grew is not None:
            taken.append(seen.where(F.col("w") <= grew["w"]).select("src", "dst", "w"))
            before = grew["n"]
        if end is None or not end["stall"] or before == everyone:
            break
        low = at = end["w"]
    out = edges.where("false").select("src", "dst", "w")
    for part in taken:
        out = out.unionByName(part)
    return out.distinct()


def cleaned(edges: DataFrame) -> DataFrame:
    """A complete graph of lengths between nodes less its long edges: those that ``grown`` takes, both ways, with pieces
    joined by their shortest edges and each node left over by its shortest edge to the rest (ties by its end)."""
    edges = written(symmetrized(edges), "lengths")
    core = written(symmetrized(grown(edges)), "core")
    inside = written(vertices(core), "inside")
    both = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")
    joined = reconnected(core, both)
    others = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_anti").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")
    last = others.groupBy("src").agg(F.min(F.struct("w", "dst")).alias("m")).select("src", "m.dst", "m.w")
    return joined.unionByName(last).unionByName(last.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def route_lengths(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(route, length)`` of ``routes(route, step, node)``; null where a step has no edge."""
    moves = routes.select("route", F.col("node").alias("src"), F.lead("node").over(Window.partitionBy("route").orderBy("step")).alias("dst")).where("dst is not null")
    joined = moves.join(edges, ["src", "dst"], "left").groupBy("route").agg(F.sum("w").alias("length"), F.count("*").alias("steps"), F.count("w").alias("known"))
    return joined.select("route", F.when(F.col("steps") == F.col("known"), F.col("length")).alias("length"))


def paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, node, dist, path)``: a shortest path from each of ``sources(node)`` to all it reaches.

    All sources advance together, a step each round, and only paths that got shorter are extended; among equal lengths
    the path with fewer steps stays, then the smaller one. Rounds end when no
    path got shorter; a negative cycle within reach fails. Each round is written.
    """
    edges = written(edges.select("src", "dst", "w"), "edges")
    best = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"), F.array("node").alias("path"))
    fresh = best
    rounds = 0
    while True:
        longer = fresh.join(edges, fresh.node == edges.src).select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.concat("path", F.array("dst")).alias("path"))
        both = best.withColumn("new", F.lit(False)).unionByName(longer.withColumn("new", F.lit(True)))
        least = both.groupBy("source", "node").agg(F.min(F.struct("dist", "new", "path")).alias("m")).select("source", "node", "m.*")
        least = written(least, "paths")
        best, fresh = least.drop("new"), least.where("new").drop("new")
        if fresh.isEmpty():
            return best
        rounds += 1
        if rounds % CYCLE_CHECK == 0 and rounds > best.select("node").distinct().count():
            raise ValueError("the edges hold a negative cycle")


def longest_path(found: DataFrame, ends: DataFrame) -> DataFrame:
    """The longest of the shortest paths that end in ``ends(node)``."""
    inside = found.join(ends.select("node"), "node", "left_semi")
    return inside.agg(F.max(F.struct("dist", "source", "node", "path")).alias("m")).where("m is not null").select("m.source", "m.node", "m.dist", "m.path")


def graph_distance(found: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """The closest pair of nodes of two node sets by the lengths of ``paths``; no row if there is none."""
    pairs = found.join(one.select(F.col("node").alias("source")), "source", "left_semi").join(two.select("node"), "node", "left_semi")
    return pairs.agg(F.min(F.struct("dist", "source", "node")).alias("m")).where("m is not null").select("m.source", "m.node", "m.dist")


def reconnected(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """``edges`` and the fewest, shortest ``candidates`` that join their pieces (nodes of the candidates without an edge are pieces).

    In each round every piece takes its shortest edge to another one, ties by its ends, so no round closes a cycle and
    the pieces at least halve. Both directions of an added edge are returned.
    """
    edges, candidates = written(edges.select("src", "dst", "w"), "edges"), written(candidates.select("src", "dst", "w"), "candidates")
    alone = vertices(candidates).select(F.col("node").alias("src"), F.col("node").alias("dst"))
    while True:
        piece = written(components(edges.select("src", "dst").unionByName(alone)), "pieces")
        a, b = piece.select(F.col("node").alias("src"), F.col("component").alias("ca")), piece.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
        across = candidates.join(a, "src").join(b, "dst").where("ca <> cb")
        ends = across.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("w", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).alias("e"))
        new = written(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "joining")
        if new.isEmpty():
            return edges
        edges = written(edges.unionByName(new.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")).unionByName(new.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w")), "edges")


def pruned_above(edges: DataFrame, threshold: float) -> DataFrame:
    """The edges longer than ``threshold``, reconnected by the others."""
    return reconnected(edges.where(F.col("w") > threshold), edges)


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with most nodes, ties to the smaller component."""
    edges = written(edges, "edges")
    groups = written(components(edges), "groups")
    top = groups.groupBy("component").agg(F.count("*").alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component")))).scalar()
    return edges.join(groups.where(F.col("component") == top).select(F.col("node").alias("src")), "src", "left_semi")


def graph_clusters(codebook: DataFrame, minima: DataFrame, found: DataFrame, k: int = 3) -> DataFrame:
    """``(nid, cluster)``: of the ``k`` minima nearest to each neuron by weight, the one nearest by path."""
    centres = codebook.join(minima.select("nid"), "nid", "left_semi")
    near = nearest(codebook.select(F.col("nid").cast("long").alias("id"), F.col("w").alias("v")), centres, k)
    lengths = found.select(F.col("source").alias("nid"), F.col("node").cast("long").alias("id"), "dist")
    return near.join(lengths, ["id", "nid"]).groupBy(F.col("id").cast("int").alias("nid")).agg(F.min_by("nid", F.struct("dist", "qe", "nid")).alias("cluster"))


def force_layout(edges: DataFrame, positions: DataFrame, iterations: int = 50, fixed: DataFrame | None = None, heat: float = 0.1) -> DataFrame:
    """``positions(node, x, y)`` after rounds of forces: all nodes repel, joined ones attract, and steps shrink evenly.

    The step of a node is its force's direction times the heat. Each node meets the array of all positions (a graph of
    a map's size), so nodes are worked on in parallel and only the positions are gathered; each round is written.
    Nodes of ``fixed(node)`` stay.
    """
    links = written(edges.select("src", "dst").where("src <> dst").distinct(), "links")
    place = written(positions.select("node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "place")
    n, width, height = place.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    rest = ((width * height / n) ** 0.5 or 1.0) if n else 1.0
    held = None if fixed is None else fixed.select("node").withColumn("held", F.lit(True))
    for step in range(iterations):
        now = heat * (1 - step / (iterations + 1))
        cloud = place.agg(F.array_sort(F.collect_list(F.struct("node", "x", "y")))).scalar()
        far = lambda dx, dy: F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(0.01))

        def push(axis: str):
            def add(total, o):
                dx, dy = F.col("x") - o["x"], F.col("y") - o["y"]
                return total + (dx if axis == "x" else dy) * rest**2 / F.pow(far(dx, dy), 2)

            return F.aggregate("cloud", F.lit(0.0), add)

        pushed = place.withColumn("cloud", cloud).select("node", "x", "y", push("x").alias("px"), push("y").alias("py"))
        here, there = place.select(F.col("node").alias("src"), "x", "y"), place.select(F.col("node").alias("dst"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        dx, dy = F.col("ox") - F.col("x"), F.col("oy") - F.col("y")
        pulled = links.join(here, "src").join(there, "dst").groupBy(F.col("src").alias("node")).agg(F.sum(dx * far(dx, dy) / rest).alias("ax"), F.sum(dy * far(dx, dy) / rest).alias("ay"))
        force = pushed.join(pulled, "node", "left").select("node", "x", "y", (F.col("px") + F.coalesce("ax", F.lit(0.0))).alias("fx"), (F.col("py") + F.coalesce("ay", F.lit(0.0))).alias("fy"))
        length = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
        scale = F.lit(now) / F.when(length < 0.01, 0.1).otherwise(length)
        if held is not None:
            force = force.join(held, "node", "left")
            scale = F.when(F.col("held"), 0.0).otherwise(scale)
        place = written(force.select("node", (F.col("x") + F.col("fx") * scale).alias("x"), (F.col("y") + F.col("fy") * scale).alias("y")), "place")
    return place
