"""Registered queries of separations, growing graphs, retraining, frames, unfolding and contrasts, and their SQL, on the same 4 x 4 map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.catalog import BASE, COLS, EDGE, LONG, PAIRS, ROWS, Tables, query
from lattix.operators import contrasts, frames, graphs, linalg, molecules, networks, retrain, separations, unfold

RECURSIVE = "WITH RECURSIVE " + BASE.removeprefix("WITH ")

SEPARATION = RECURSIVE + """, span AS MATERIALIZED (SELECT *, d / (SELECT max(d) FROM gaps) AS share FROM gaps),
tv AS MATERIALIZED (SELECT DISTINCT share AS cut FROM span),
border AS MATERIALIZED (SELECT src, dst, edges.w / (SELECT max(w) FROM edges) AS w FROM edges),
reach(cut, node, root) AS (SELECT cut, nid, nid FROM tv, book UNION SELECT r.cut, b.dst, r.root FROM reach r JOIN border b ON r.node = b.src AND b.w <= r.cut),
comp AS MATERIALIZED (SELECT cut, node, min(root) AS c FROM reach GROUP BY cut, node),
num AS (SELECT cut, count(DISTINCT c) AS m FROM comp GROUP BY cut),
changed AS MATERIALIZED (SELECT cut, m FROM (SELECT *, lag(m) OVER (ORDER BY cut) AS before FROM num) WHERE m > 1 AND m IS DISTINCT FROM before),
cells AS MATERIALIZED (SELECT x.cut, x.c AS ca, y.c AS cb, g.a, g.b, g.d FROM changed JOIN comp x USING (cut) JOIN comp y ON x.cut = y.cut JOIN gaps g ON g.a = x.node AND g.b = y.node),
loose AS (SELECT cut, sum(n * val) / 16 AS khi FROM (SELECT cut, ca, count(DISTINCT a) AS n, coalesce(avg(d) FILTER (a < b), 0) AS val FROM cells WHERE ca = cb GROUP BY cut, ca) GROUP BY cut),
far_off AS (SELECT cut, sum(val) AS far FROM (SELECT cut, ca, cb, avg(d) AS val FROM cells WHERE ca <> cb GROUP BY cut, ca, cb) GROUP BY cut),
rated AS (SELECT cut, m AS clusters, m * khi / (far / (m * m)) AS xi FROM changed JOIN loose USING (cut) JOIN far_off USING (cut)),
swept AS (SELECT row_number() OVER o::INTEGER AS step, cut, clusters, xi, (xi - lag(xi, 1, 0.0) OVER o) / nullif(cut - lag(cut, 1, 0.0) OVER o, 0) AS gradient FROM rated WINDOW o AS (ORDER BY cut))
"""
_TOLD = "SELECT step, round(cut, 6) + 0.0 AS cut, clusters, round(xi, 6) + 0.0 AS xi, round(gradient, 5) + 0.0 AS gradient FROM swept"


def _fifth(df: DataFrame) -> DataFrame:
    return df.withColumn("gradient", F.round("gradient", 5) + 0.0)


@query(SEPARATION + _TOLD)
def separation_sweep(t: Tables) -> DataFrame:
    return _fifth(separations.separation_sweep(t.map, ROWS, COLS))


@query(SEPARATION + _TOLD + " WHERE gradient < 0 ORDER BY swept.gradient, step DESC LIMIT 1")
def best_separation(t: Tables) -> DataFrame:
    return _fifth(separations.best_separation(separations.separation_sweep(t.map, ROWS, COLS)))


#: Distances of 12 points on a line of growing gaps and of all other neurons: a complete graph.
GROWN = RECURSIVE + """, lengths AS MATERIALIZED (SELECT a AS src, b AS dst, d AS w, min(d) OVER (PARTITION BY a) AS own FROM gaps WHERE a <> b),
ds AS MATERIALIZED (SELECT row_number() OVER (ORDER BY w) AS k, w FROM (SELECT DISTINCT w FROM lengths)),
ends AS MATERIALIZED (SELECT src AS v, w, own FROM lengths UNION ALL SELECT dst, w, own FROM lengths),
state(k, w, low, used, n, grew, done) AS (SELECT 0::BIGINT, 0.0::DOUBLE, '-inf'::DOUBLE, '-inf'::DOUBLE, -1::BIGINT, false, false UNION ALL
  SELECT x.k, x.w, CASE WHEN x.seen = x.n THEN x.w ELSE x.low END, x.low, x.seen, x.seen <> x.n, x.seen = 16 FROM (
    SELECT d.k, d.w, s.low, s.n, (SELECT count(DISTINCT v) FROM ends e WHERE e.own >= s.low AND e.w <= d.w) AS seen FROM state s JOIN ds d ON d.k = s.k + 1 WHERE NOT s.done) x),
grown AS (SELECT DISTINCT src, dst, l.w FROM lengths l JOIN state s ON s.grew AND l.own >= s.used AND l.w <= s.w)
"""


def _lengths(t: Tables) -> DataFrame:
    """All distances of two neurons, both ways."""
    from lattix.operators.clusters import neuron_pairs

    pairs = neuron_pairs(t.map)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("d").alias("w")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("d").alias("w")))


@query(GROWN + "SELECT src, dst, round(w, 6) AS w FROM grown")
def grown_edges(t: Tables) -> DataFrame:
    return networks.grown(_lengths(t))


@query()
def cleaned_graph(t: Tables) -> DataFrame:
    return networks.cleaned(_lengths(t))


MERGED = RECURSIVE + """, top AS (SELECT max(edges.w) AS w FROM edges),
tv AS MATERIALIZED (SELECT row_number() OVER (ORDER BY cut) - 1 AS t, cut FROM (SELECT -1.0::DOUBLE AS cut UNION SELECT DISTINCT edges.w FROM edges)),
reach(t, node, root) AS (SELECT t, nid, nid FROM tv, book UNION SELECT r.t, e.dst, r.root FROM reach r JOIN tv USING (t) JOIN edges e ON r.node = e.src AND e.w <= tv.cut),
comp AS MATERIALIZED (SELECT t, node, min(root) AS c FROM reach GROUP BY t, node),
num AS (SELECT t, count(DISTINCT c) AS m FROM comp GROUP BY t),
kept AS (SELECT t, row_number() OVER (ORDER BY t)::INTEGER - 1 AS step FROM (SELECT *, lag(m) OVER (ORDER BY t) AS before FROM num) WHERE m IS DISTINCT FROM before),
hits AS MATERIALIZED (SELECT b.nid AS node, label = 3 AS k FROM bmus),
rated AS (SELECT t, c, count(*) FILTER (k) / (SELECT count(*) FROM hits WHERE k) AS se, 1 - count(*) FILTER (NOT k) / (SELECT count(*) FROM hits WHERE NOT k) AS sp FROM comp JOIN hits USING (node) GROUP BY t, c),
far_off AS (SELECT step, t, c, se, sp, sqrt((1 - sp) * (1 - sp) + (1 - se) * (1 - se)) AS gamma, count(*) OVER (PARTITION BY t) AS clusters FROM rated JOIN kept USING (t)),
bests AS (SELECT step, greatest(tv.cut, 0.0) / (SELECT w FROM top) AS cut, clusters, c AS cluster, (SELECT list(node ORDER BY node) FROM comp WHERE comp.t = far_off.t AND comp.c = far_off.c) AS neurons, se, sp, gamma
  FROM far_off JOIN tv USING (t) QUALIFY row_number() OVER (PARTITION BY step ORDER BY {order}, c) = 1)
SELECT step, round(cut, 6) AS cut, clusters, cluster, neurons, round(se, 6) AS se, round(sp, 6) AS sp, round(gamma, 6) AS gamma FROM bests"""


def _rated(t: Tables, by_sensitivity: bool = False) -> DataFrame:
    return retrain.roc_merges(t.map, ROWS, COLS, t.bmus.withColumnRenamed("label", "kind"), F.col("kind") == 3, by_sensitivity)


@query(MERGED.replace("{order}", "gamma"))
def roc_merges(t: Tables) -> DataFrame:
    return _rated(t)


@query(MERGED.replace("{order}", "se DESC, gamma"))
def roc_merges_sensitive(t: Tables) -> DataFrame:
    return _rated(t, True)


@query(MERGED.replace("{order}", "gamma") + " ORDER BY bests.gamma, step LIMIT 1")
def roc_merges_best(t: Tables) -> DataFrame:
    return retrain.best_step(_rated(t))


@query()
def narrowed_rounds(t: Tables) -> DataFrame:
    data = t.data.join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "id")
    return retrain.narrowed(data, F.col("label") == 3, ROWS, COLS, retrain.trainer(ROWS, COLS, [2.0, 1.0]))[0]


@query()
def learning_sizes(t: Tables) -> DataFrame:
    data = t.data.join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "id")
    others = data.where("label <> 3").count()
    return retrain.learning_sizes(data, F.col("label") == 3, ROWS, COLS, retrain.trainer(ROWS, COLS, [2.0, 1.0]), step=others // 3 + 1)[0]


CENTRES = BASE + """, centre AS MATERIALIZED (SELECT nid, d.v[1:63] AS p FROM (SELECT b.nid AS nid, arg_min(id, {'q': qe, 'id': id}) AS id FROM bmus GROUP BY b.nid) JOIN data d USING (id)),
around AS (SELECT c.nid, ((c.nid // 4 + s.a + 4) % 4) * 4 + (c.nid % 4 + s.b + 4) % 4 AS other, c.p FROM centre c, steps s)
"""


@query(CENTRES + "SELECT a.nid, count(c.nid) AS n, round(avg(list_distance(a.p, c.p) / sqrt(21)), 6) AS val FROM around a LEFT JOIN centre c ON a.other = c.nid GROUP BY a.nid")
def rmsd_map(t: Tables) -> DataFrame:
    return frames.rmsd_map(linalg.atoms(t.long), t.bmus, ROWS, COLS)


@query(CENTRES + """, nine AS (SELECT * FROM around UNION ALL SELECT nid, nid, p FROM centre),
far_off AS (SELECT n.nid, list_distance(n.p, d.v[1:63]) / sqrt(21) AS r FROM nine n JOIN bmus m ON m.b.nid = n.other JOIN data d USING (id))
SELECT nid, count(*) FILTER (r <> 0) AS n, round(avg(r) FILTER (r <> 0), 6) AS val FROM far_off GROUP BY nid""")
def rmsd_map_all(t: Tables) -> DataFrame:
    return frames.rmsd_map_all(linalg.atoms(t.long), t.bmus, ROWS, COLS)


@query()
def distance_features(t: Tables) -> DataFrame:
    points = linalg.atoms(t.long)
    return frames.distance_features(points, points.where("id = 0").first().xyz)


_TRIPLES = [(1, 5), (3, 12), (7, 19)]
_NORMALS = ", ".join(f"({k})" for k in sorted({k for p in _TRIPLES for k in p}))
FEATURES = LONG + f""", bond AS (SELECT id, x.a AS k, list_transform(list_zip(y.p, x.p), lambda q: q[1] - q[2]) AS u, list_transform(list_zip(z.p, x.p), lambda q: q[1] - q[2]) AS w, x.p
  FROM points x JOIN points y USING (id) JOIN points z USING (id) WHERE y.a = x.a + 1 AND z.a = x.a - 1 AND x.a IN (SELECT * FROM (VALUES {_NORMALS}))),
normal AS MATERIALIZED (SELECT id, k, p, [u[2] * w[3] - u[3] * w[2], u[3] * w[1] - u[1] * w[3], u[1] * w[2] - u[2] * w[1]] AS n FROM bond),
length AS MATERIALIZED (SELECT k, sqrt(sum(list_dot_product(n, n))) AS s FROM normal GROUP BY k),
wanted AS (SELECT * FROM (VALUES {', '.join(f'({x}, {a}, {b})' for x, (a, b) in enumerate(_TRIPLES))}) AS t(pair, a, b))
SELECT x.id, pair, round(list_distance(x.p, y.p), 6) AS distance, round(list_dot_product(x.n, y.n) / (sx.s * sy.s) * 1000, 6) + 0.0 AS product
FROM wanted JOIN normal x ON x.k = wanted.a JOIN normal y ON y.k = wanted.b AND x.id = y.id JOIN length sx ON sx.k = wanted.a JOIN length sy ON sy.k = wanted.b"""


@query(FEATURES)
def pair_features(t: Tables) -> DataFrame:
    found = frames.pair_features(linalg.atoms(t.long), [(0, 4), *_TRIPLES, (5, 20)])
    at = F.explode(F.sequence(F.lit(0), F.lit(len(_TRIPLES) - 1))).alias("pair")
    return found.select("id", "v", at).select("id", "pair", F.get("v", 2 * F.col("pair")).alias("distance"), (F.get("v", 2 * F.col("pair") + 1) * 1000).alias("product"))


@query(BASE + """, far_off AS (SELECT id, (list_distance(v[1:3], v[31:33]) > 0.25)::INTEGER + (list_distance(v[4:6], v[61:63]) > 0.25)::INTEGER AS over FROM data)
SELECT b.nid AS nid, count(*) AS frames, sum(over)::BIGINT AS violated, round(avg(over), 6) AS mean FROM far_off JOIN bmus USING (id) GROUP BY b.nid""")
def restraint_violations(t: Tables) -> DataFrame:
    return frames.violations(linalg.atoms(t.long), t.bmus, [(0, 10), (1, 20)], 0.25)


_LABELLED = LONG + """, lab AS (SELECT DISTINCT a AS atom, (a % 4)::INTEGER AS label FROM points), own AS MATERIALIZED (SELECT (r // 3)::INTEGER AS atom, (r % 3)::INTEGER AS axis, val FROM cov WHERE r = c)
"""


def _atom_labels(t: Tables) -> DataFrame:
    """21 atoms in four clusters."""
    return linalg.covariance(t.long).where("r = c").select(F.expr("r div 3").cast("int").alias("atom"), (F.expr("r div 3") % 4).cast("int").alias("label")).distinct()


@query(_LABELLED + """, spread AS (SELECT atom, sqrt(sum(val) / 3) AS s FROM own GROUP BY atom)
SELECT k.one, k.two, atom, round((CASE WHEN label = k.one THEN s ELSE -s END) / (SELECT max(s) FROM spread), 6) AS val FROM lab JOIN spread USING (atom),
(SELECT x AS one, y AS two FROM range(4) a(x), range(4) b(y) WHERE x < y) k WHERE label IN (k.one, k.two)""")
def cluster_contrasts(t: Tables) -> DataFrame:
    found = contrasts.contrasts(_atom_labels(t), contrasts.atom_spread(linalg.covariance(t.long)))
    return found.select(F.col("one").cast("long").alias("one"), F.col("two").cast("long").alias("two"), "atom", "val")


@query(_LABELLED + """SELECT k.one, k.two, atom, axis, round(sqrt(val), 6) AS val FROM lab JOIN own USING (atom),
(SELECT x AS one, y AS two FROM range(4) a(x), range(4) b(y) WHERE x < y) k WHERE label IN (k.one, k.two)""")
def cluster_displacements(t: Tables) -> DataFrame:
    found = contrasts.displacements(_atom_labels(t), linalg.covariance(t.long))
    return found.select(F.col("one").cast("long").alias("one"), F.col("two").cast("long").alias("two"), "atom", "axis", "val")


@query(LONG + "SELECT (r // 3)::INTEGER AS r, (c // 3)::INTEGER AS c, round(list(val ORDER BY r, c)[2], 6) + 0.0 AS second, round(list_sum(list(val ORDER BY r, c)), 6) + 0.0 AS total, count(*)::INTEGER AS n FROM cov GROUP BY r // 3, c // 3")
def block_rows(t: Tables) -> DataFrame:
    blocks = contrasts.block_rows(linalg.covariance(t.long))
    return blocks.select("r", "c", F.get("v", F.lit(1)).alias("second"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("v").alias("n"))


@query(LONG + "SELECT r::BIGINT AS id, round(sum(val), 6) + 0.0 AS total, round(sum(val * c), 5) + 0.0 AS moment FROM cov GROUP BY r")
def row_vectors(t: Tables) -> DataFrame:
    rows = contrasts.row_vectors(linalg.covariance(t.long))
    moment = F.aggregate(F.transform("v", lambda x, k: x * k), F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"), (F.round(moment, 5) + 0.0).alias("moment"))


_SEAMS = "CASE WHEN i IN (0, 3) AND j IN (0, 3) THEN 1 WHEN i = 1 AND j IN (1, 2) THEN 2 WHEN i = 3 AND j = 2 THEN 1 ELSE 0 END"


@query(RECURSIVE + f""", lab AS (SELECT nid, i, j, {_SEAMS} AS label FROM book),
reach(nid, label, piece, u, v) AS (SELECT nid, label, nid, i, j FROM lab WHERE label > 0 UNION
  SELECT m.nid, m.label, r.piece, r.u + s.a, r.v + s.b FROM reach r JOIN steps s ON true JOIN lab m ON m.label = r.label AND m.i = (r.u + s.a + 8) % 4 AND m.j = (r.v + s.b + 8) % 4)
SELECT nid, label, piece, u, v, false AS wraps FROM reach QUALIFY piece = min(piece) OVER (PARTITION BY nid)""")
def unfolded_clusters(t: Tables) -> DataFrame:
    return unfold.unfolded(t.map.select("nid", F.expr(_SEAMS).alias("label")), ROWS, COLS)


@query()
def eigen_projection(t: Tables) -> DataFrame:
    return contrasts.eigen_projection(molecules.principal_components(t.long, 2), 0)
