"""Registered queries of the network, landscape and molecule operators and their SQL, on the same 4 x 4 map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.catalog import BASE, COLS, EDGE, FIELD, LEVELS, LONG, ROWS, Tables, query
from lattix.operators import codebook, graphs, grid, landscape, linalg, molecules, networks, project

WALKS = BASE.removeprefix("WITH ") + ", low AS (SELECT nid FROM book WHERE i = j), walks(source, node, dist, seen) AS (SELECT nid, nid, 0.0::DOUBLE, [nid] FROM low UNION ALL SELECT source, dst, dist + w, list_append(seen, dst) FROM walks JOIN edges ON src = node WHERE NOT list_contains(seen, dst) AND len(seen) < 16), lengths AS (SELECT source, node, min(dist) AS dist, arg_min(seen, {'d': dist, 'n': len(seen), 's': seen}) AS path FROM walks GROUP BY 1, 2)"


def _ends(t: Tables) -> DataFrame:
    """The diagonal's neurons."""
    return t.map.where("i = j").select(F.col("nid").alias("node"))


def _paths(t: Tables) -> DataFrame:
    return networks.paths(t.edges, _ends(t))


@query(BASE + "SELECT src, list(dst ORDER BY w, dst) AS near FROM edges GROUP BY src")
def neighbour_lists(t: Tables) -> DataFrame:
    return networks.neighbour_lists(t.edges)


@query(BASE + f"SELECT DISTINCT {EDGE} FROM edges")
def distinct_weights(t: Tables) -> DataFrame:
    return networks.distinct_weights(t.edges)


@query(BASE + f"SELECT src, dst, {EDGE} FROM edges WHERE NOT (src = 0 AND dst = 1)")
def delete_edge(t: Tables) -> DataFrame:
    return networks.without(t.edges, t.edges.where("src = 0 and dst = 1"))


@query(BASE + f"SELECT src, dst, {EDGE} FROM (SELECT *, bool_and(edges.w BETWEEN 1.2 AND 1.4) OVER (PARTITION BY src ORDER BY edges.w, dst) AS ok FROM edges) edges WHERE ok")
def select_edges(t: Tables) -> DataFrame:
    return networks.selected(t.edges, 1.4, 1.2)


@query(BASE + f"SELECT src, dst, {EDGE} FROM edges WHERE edges.w <= (SELECT max(w) FROM (SELECT min(w) AS w FROM edges GROUP BY src))")
def covering_edges(t: Tables) -> DataFrame:
    return networks.covering(t.edges)


@query(BASE + "SELECT i AS route, sum(edges.w) AS length FROM book JOIN edges ON src = nid AND dst = nid + 1 WHERE j < 3 GROUP BY i".replace("sum(edges.w)", "round(sum(edges.w), 6)"))
def route_lengths(t: Tables) -> DataFrame:
    return networks.route_lengths(t.map.select(F.col("i").alias("route"), F.col("j").alias("step"), F.col("nid").alias("node")), t.edges)


@query("WITH RECURSIVE " + WALKS + " SELECT source, node, round(dist, 6) AS dist, path FROM lengths")
def all_paths(t: Tables) -> DataFrame:
    return _paths(t)


@query("WITH RECURSIVE " + WALKS + ", ends AS (SELECT * FROM lengths WHERE node IN (SELECT nid FROM low)) SELECT source, node, round(dist, 6) AS dist, path FROM ends ORDER BY ends.dist DESC, source DESC, node DESC LIMIT 1")
def longest_path(t: Tables) -> DataFrame:
    return networks.longest_path(_paths(t), _ends(t))


@query("WITH RECURSIVE " + WALKS + ", ends AS (SELECT * FROM lengths WHERE source < 8 AND node >= 8) SELECT source, node, round(dist, 6) AS dist FROM ends ORDER BY ends.dist, source, node LIMIT 1")
def graph_distance(t: Tables) -> DataFrame:
    return networks.graph_distance(_paths(t), _ends(t).where("node < 8"), t.map.select(F.col("nid").alias("node")).where("node >= 8"))


@query("WITH RECURSIVE " + WALKS + ", near AS (SELECT g.a AS nid, g.b AS source, d FROM gaps g JOIN low ON g.b = low.nid QUALIFY row_number() OVER (PARTITION BY g.a ORDER BY d, g.b) <= 3) SELECT nid, arg_min(source, {'l': dist, 'd': d, 's': source}) AS cluster FROM near JOIN lengths ON near.source = lengths.source AND node = nid GROUP BY nid".replace("arg_min(source", "arg_min(near.source").replace("'s': source", "'s': near.source"))
def graph_clusters(t: Tables) -> DataFrame:
    return networks.graph_clusters(t.map, _ends(t).withColumnRenamed("node", "nid"), _paths(t))


@query()
def reconnected_edges(t: Tables) -> DataFrame:
    return networks.pruned_above(t.edges, 1.45)


@query()
def largest_component(t: Tables) -> DataFrame:
    return networks.largest_component(graphs.pruned(t.edges, 1.35))


@query()
def force_layout(t: Tables) -> DataFrame:
    return networks.force_layout(t.edges, t.map.select(F.col("nid").alias("node"), F.col("i").alias("x"), F.col("j").alias("y")), 4)


@query(BASE + f"SELECT nid, i, j, {FIELD} FROM u WHERE u.val < (SELECT avg(val) - 0.5 * stddev_pop(val) FROM u)")
def low_region(t: Tables) -> DataFrame:
    return landscape.region(t.umatrix, 0.5)


@query(BASE + f"SELECT nid, i, j, {FIELD} FROM u WHERE u.val > (SELECT avg(val) + 0.5 * stddev_pop(val) FROM u)")
def high_region(t: Tables) -> DataFrame:
    return landscape.region(t.umatrix, 0.5, low=False)


@query(BASE + f"SELECT nid, i, j, {FIELD} FROM u WHERE val >= (SELECT max(o.val) FROM planar JOIN u o ON planar.other = o.nid WHERE planar.nid = u.nid)")
def planar_peaks(t: Tables) -> DataFrame:
    return landscape.peaks(t.umatrix, ROWS, COLS)


@query(BASE + "SELECT nid, i, j, round(least(val, (SELECT min(o.val) FROM toric JOIN u o ON toric.other = o.nid WHERE toric.nid = u.nid)), 6) AS val FROM u")
def lowered_field(t: Tables) -> DataFrame:
    return landscape.lowered(t.umatrix, ROWS, COLS)


@query("WITH RECURSIVE " + BASE.removeprefix("WITH ") + LEVELS + """, cell AS (SELECT unnest(range(first, 11))::INTEGER AS level, nid FROM cuts),
near AS (SELECT a.level, t.nid, t.other FROM toric t JOIN cell a ON t.nid = a.nid JOIN cell b ON t.other = b.nid AND a.level = b.level WHERE t.nid // 4 = t.other // 4 OR t.nid % 4 = t.other % 4),
reach(level, node, root) AS (SELECT level, nid, nid FROM cell UNION SELECT near.level, other, root FROM reach JOIN near ON reach.node = near.nid AND reach.level = near.level),
comp AS (SELECT level, node, min(root) AS c FROM reach GROUP BY 1, 2),
h AS (SELECT nid, (SELECT count(*) FROM bmus WHERE b.nid = book.nid) AS n FROM book),
mean AS (SELECT level, c, avg(n) AS m FROM comp JOIN h ON node = nid GROUP BY 1, 2)
SELECT node AS nid, round(avg(m), 6) AS val FROM comp JOIN mean USING (level, c) GROUP BY node""")
def level_density(t: Tables) -> DataFrame:
    return landscape.level_density(t.umatrix, project.density(t.bmus, t.map), ROWS, COLS, 10)


_LABEL = "CASE WHEN j = 0 THEN 1 WHEN j = 3 THEN 2 WHEN i = 0 THEN 3 WHEN i = 3 THEN 4 ELSE 0 END"


@query("WITH RECURSIVE " + BASE.removeprefix("WITH ") + f""", lab AS (SELECT nid, i, j, {_LABEL} AS label FROM book),
seam AS (SELECT a.label AS x, b.label AS y FROM lab a JOIN lab b ON (a.i = 0 AND b.i = 3 AND a.j = b.j) OR (a.j = 0 AND b.j = 3 AND a.i = b.i) WHERE a.label > 0 AND b.label > 0),
both_ways AS (SELECT x, y FROM seam UNION SELECT y, x FROM seam),
reach(node, root) AS (SELECT DISTINCT label, label FROM lab WHERE label > 0 UNION SELECT y, root FROM reach JOIN both_ways ON node = x),
named AS (SELECT node, dense_rank() OVER (ORDER BY c)::INTEGER AS new FROM (SELECT node, min(root) AS c FROM reach GROUP BY node))
SELECT nid, i, j, coalesce(new, 0)::INTEGER AS label FROM lab LEFT JOIN named ON label = node""")
def seamless_labels(t: Tables) -> DataFrame:
    return landscape.seamless(t.map.select("nid", "i", "j", F.expr(_LABEL).alias("label")), ROWS, COLS)


@query()
def merge_tree(t: Tables) -> DataFrame:
    field = grid.umatrix(codebook.from_rows(t.embeddings, 8, 8), 8, 8)
    return graphs.on_grid(field, 8, 8, landscape.merge_tree, "step int, a int, b int, height double, saddle int, n int")


@query()
def step_and_slide(t: Tables) -> DataFrame:
    walk = lambda g: landscape.step_and_slide(g, 0, 10, 0.05, 10.0)
    return graphs.on_grid(t.umatrix, ROWS, COLS, walk, "side int, at int, nid int, val double")


@query(BASE + """, f AS (SELECT a.nid, 2 * pi() * (a.i * b.i + a.j * b.j) / 4 AS turn, val FROM book a, u b)
SELECT nid, round(sum(val * cos(turn)), 5) + 0.0 AS re, round(sum(-val * sin(turn)), 5) + 0.0 AS im FROM f GROUP BY nid""")
def field_spectrum(t: Tables) -> DataFrame:
    found = graphs.on_grid(t.umatrix, ROWS, COLS, landscape.spectrum, "nid int, re double, im double")
    return found.select("nid", (F.round("re", 5) + 0.0).alias("re"), (F.round("im", 5) + 0.0).alias("im"))


def _molecules(t: Tables) -> DataFrame:
    """Four atoms of each embedding, with the next four dimensions for charges."""
    row = t.data.select(F.col("id").alias("mol"), F.col("v"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("atom_id"))
    at = lambda k: F.get("v", k)
    return row.select("mol", "atom_id", *(at(F.col("atom_id") * 3 + k).alias(n) for k, n in enumerate("xyz")), (at(F.col("atom_id") + 12) * 8).alias("charge"))


@query()
def molecule_descriptors(t: Tables) -> DataFrame:
    return molecules.descriptors(_molecules(t))


_FULL = "WITH p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) "


@query(_FULL + "SELECT id, round(-v[2], 6) + 0.0 AS x, round(v[1], 6) + 0.0 AS y, round(v[3], 6) + 0.0 AS z, round(-v[59], 6) + 0.0 AS last FROM p")
def rotate_descriptor(t: Tables) -> DataFrame:
    turn = F.array(*(F.lit(float(x)) for x in (0, -1, 0, 1, 0, 0, 0, 0, 1)))
    turned = t.data.select("id", molecules.rotated(F.slice("v", 1, 60), turn).alias("d"))
    return turned.select("id", *(F.get("d", F.lit(k)).alias(n) for k, n in ((0, "x"), (1, "y"), (2, "z"), (57, "last"))))


@query(_FULL + ", q AS (SELECT id, v[13:15] AS c, list_transform(list_zip(v[16:18], v[13:15]), lambda p: p[1] - p[2]) AS a FROM p) SELECT id, round(c[1], 6) + 0.0 AS centre, round(sqrt(list_sum(list_transform(a, lambda x: x * x))), 6) AS norm, round(a[1] / sqrt(list_sum(list_transform(a, lambda x: x * x))), 6) + 0.0 AS unit FROM q")
def split_descriptor(t: Tables) -> DataFrame:
    part = t.data.select("id", molecules.split(F.slice("v", 1, 60), "plus").alias("s"))
    return part.select("id", F.col("s.centre")[0].alias("centre"), F.col("s.norm")[0].alias("norm"), F.col("s.unit")[0][0].alias("unit"))


@query(LONG + """, g AS (SELECT x.id, x.a AS k, list_transform(list_zip(y.p, x.p), lambda q: q[1] - q[2]) AS a, list_transform(list_zip(z.p, y.p), lambda q: q[1] - q[2]) AS b, list_transform(list_zip(w.p, z.p), lambda q: q[1] - q[2]) AS c
FROM points x JOIN points y ON y.id = x.id AND y.a = x.a + 1 JOIN points z ON z.id = x.id AND z.a = x.a + 2 JOIN points w ON w.id = x.id AND w.a = x.a + 3)
SELECT id, k AS at, round(((a[2] * b[3] - a[3] * b[2]) * c[1] + (a[3] * b[1] - a[1] * b[3]) * c[2] + (a[1] * b[2] - a[2] * b[1]) * c[3]) / pow(sqrt(b[1] * b[1] + b[2] * b[2] + b[3] * b[3]), 3), 5) + 0.0 AS val FROM g""")
def chiralities(t: Tables) -> DataFrame:
    found = linalg.atoms(t.long).select("id", F.posexplode(molecules.chiralities(F.col("xyz"))).alias("at", "val"))
    return found.withColumn("val", F.round("val", 5) + 0.0)


@query()
def neuron_coordinates(t: Tables) -> DataFrame:
    return t.data.select("id", molecules.coordinates(F.slice("v", 1, 36)).alias("xyz"))


@query()
def aligned_frames(t: Tables) -> DataFrame:
    points = linalg.atoms(t.long)
    return molecules.aligned(points, points.where("id = 0").first().xyz)


@query()
def principal_components(t: Tables) -> DataFrame:
    return molecules.principal_components(codebook.vectors(t.embeddings), 4)
