"""Registered queries of the map-analysis operators and their SQL. Maps are 4 x 4: the embeddings of id 0 to 15."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions import euler, geometry, kernels, transforms, vectors
from lattix.operators import bmu, clusters, codebook, graphs, grid, linalg, molecules, project, train

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS = COLS = 4
#: Decimals of results, which sums in another order must not change.
DIGITS = 6


class Tables:
    """The inputs that queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def data(self) -> DataFrame:
        return codebook.vectors(self.embeddings)

    @property
    def map(self) -> DataFrame:
        return codebook.from_rows(self.embeddings, ROWS, COLS)

    @property
    def bmus(self) -> DataFrame:
        return bmu.assign(codebook.vectors(self.embeddings, "vec_id", "embedding", "label"), self.map)

    @property
    def umatrix(self) -> DataFrame:
        return grid.umatrix(self.map, ROWS, COLS)

    @property
    def edges(self) -> DataFrame:
        return grid.edges(self.map, ROWS, COLS, False, grid.FOUR)

    @property
    def long(self) -> DataFrame:
        """63 of the 64 dimensions, 21 points of three."""
        return self.data.select("id", F.slice("v", 1, 63).alias("v"))

    @property
    def walk(self) -> DataFrame:
        """Events as states on the grid: by value along i, by hour along j."""
        i, j = F.least(F.floor(F.col("value") / 125), F.lit(3)).cast("int"), F.floor(F.hour("ts") / 6).cast("int")
        return self.events.select("user_id", "ts", "event_id", i.alias("i"), j.alias("j"), (i * 4 + j).alias("nid"))

    @property
    def labels(self) -> DataFrame:
        return self.map.select("nid", F.col("i").alias("label"))

    @property
    def uneven(self) -> DataFrame:
        """Clusters of 1, 3, 5 and 7 neurons, labelled from 0."""
        return self.map.select("nid", F.when(F.col("nid") < 1, 0).when(F.col("nid") < 4, 1).when(F.col("nid") < 9, 2).otherwise(3).alias("label"))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to ``DIGITS`` decimals, without a negative zero."""
    return df.select(*((F.round(c, DIGITS) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        own = name or f.__name__
        QUERIES[own] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
        if sql:
            ORACLES[own] = sql.strip()
        return f

    return add


BASE = """WITH data AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings),
book AS (SELECT id::INTEGER AS nid, (id // 4)::INTEGER AS i, (id % 4)::INTEGER AS j, v AS w FROM data WHERE id BETWEEN 0 AND 15),
far AS (SELECT id, label, v, nid, i, j, sqrt(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM data, book),
bmus AS (SELECT id, any_value(label) AS label, arg_min({'nid': nid, 'i': i, 'j': j}, {'d': d, 'nid': nid}) AS b, min(d) AS qe FROM far GROUP BY id),
steps AS (SELECT a, b FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b) WHERE a <> 0 OR b <> 0),
toric AS (SELECT DISTINCT nid, (((i + a + 4) % 4) * 4 + (j + b + 4) % 4)::INTEGER AS other FROM book, steps),
planar AS (SELECT DISTINCT nid, ((i + a) * 4 + j + b)::INTEGER AS other, a = 0 OR b = 0 AS straight FROM book, steps WHERE i + a BETWEEN 0 AND 3 AND j + b BETWEEN 0 AND 3),
gaps AS (SELECT x.nid AS a, y.nid AS b, sqrt(list_sum(list_transform(list_zip(x.w, y.w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM book x, book y),
u AS (SELECT t.nid, any_value(t.nid // 4)::INTEGER AS i, any_value(t.nid % 4)::INTEGER AS j, avg(d) AS val FROM toric t JOIN gaps g ON t.nid = g.a AND t.other = g.b GROUP BY t.nid),
edges AS (SELECT nid AS src, other AS dst, d AS w FROM planar JOIN gaps ON nid = a AND other = b WHERE straight)
"""
MATRIX = """WITH short AS (SELECT vec_id AS id, list_transform(embedding[1:{n}], lambda x: x::DOUBLE) AS v FROM embeddings),
cells AS (SELECT id, (k - 1)::INTEGER AS k, v[k] AS x FROM (SELECT id, v, unnest(range(1, {n} + 1)) AS k FROM short)),
pairs AS (SELECT a.k AS r, b.k AS c, count(*) AS n, sum(a.x * b.x) - sum(a.x) * sum(b.x) / count(*) AS s FROM cells a JOIN cells b USING (id) GROUP BY 1, 2),
cov AS (SELECT r, c, s / n AS val FROM pairs),
corr AS (SELECT cov.r, cov.c, cov.val / (sqrt(x.val) * sqrt(y.val)) AS val FROM cov JOIN cov x ON x.r = x.c AND x.r = cov.r JOIN cov y ON y.r = y.c AND y.c = cov.c),
points AS (SELECT id, a::INTEGER AS a, v[3 * a + 1:3 * a + 3] AS p FROM (SELECT id, v, unnest(range(0, {n} // 3)) AS a FROM short))
"""
LONG, FULL = (MATRIX.replace("{n}", str(n)) for n in (63, 64))
WALK = """WITH walk AS (SELECT user_id, ts, event_id, least(floor(value / 125), 3)::INTEGER AS i, (extract(hour FROM ts) // 6)::INTEGER AS j FROM events),
states AS (SELECT *, i * 4 + j AS nid, lead(i * 4 + j) OVER w AS dst, lead(i) OVER w - i AS di, lead(j) OVER w - j AS dj FROM walk WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
moves AS (SELECT nid AS src, dst, count(*) AS n FROM states WHERE dst IS NOT NULL GROUP BY 1, 2)
"""
BMU_SQL = BASE + "SELECT id, b.nid AS nid, b.i AS i, b.j AS j, round(qe, 6) AS qe FROM bmus"
FIELD = "round(val, 6) + 0.0 AS val"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    hits = project.density(t.bmus, t.map).withColumnRenamed("val", "hits")
    return rounded(t.umatrix.join(hits.select("nid", "hits"), "nid"))


@query(BASE + "SELECT u.nid, u.i, u.j, round(val, 6) AS val, (SELECT count(*) FROM bmus WHERE b.nid = u.nid) AS hits FROM u")
def map_overview(t: Tables) -> DataFrame:
    return flagship(t.spark, t.dir)


@query(BMU_SQL)
def bmu_assign(t: Tables) -> DataFrame:
    return bmu.assign(t.data, t.map)


@query(BMU_SQL)
def bmu_assign_arrow(t: Tables) -> DataFrame:
    return bmu.assign_arrow(t.data, t.map)


def _other_bmu(d: str) -> str:
    return BASE + f"SELECT id, arg_min(nid, {{'d': d, 'nid': nid}}) AS nid, round(min(d), 6) AS qe FROM (SELECT id, nid, {d} AS d FROM data, book) GROUP BY id"


@query(_other_bmu("1 - list_sum(list_transform(list_zip(v, w), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(w, lambda x: x * x))))"))
def bmu_cosine(t: Tables) -> DataFrame:
    return bmu.assign(t.data, t.map, vectors.cosine_distance).select("id", "nid", "qe")


@query(_other_bmu("sqrt(list_sum(list_transform(list_zip(v[1:16], w[1:16]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"))
def bmu_subpart(t: Tables) -> DataFrame:
    cut = lambda df, c: df.withColumn(c, F.slice(c, 1, 16))
    return bmu.assign(cut(t.data, "v"), cut(t.map, "w")).select("id", "nid", "qe")


@query(_other_bmu("sqrt(list_sum(list_transform(list_zip(v, w, range(0, 64)), lambda p: CASE WHEN (id + p[3]) % 7 = 0 THEN 0.0 ELSE (p[1] - p[2]) * (p[1] - p[2]) END)))"))
def bmu_masked(t: Tables) -> DataFrame:
    masked = t.data.withColumn("v", F.transform("v", lambda x, k: F.when((F.col("id") + k) % 7 != 0, x)))
    return bmu.assign(masked, t.map, vectors.masked_distance).select("id", "nid", "qe")


@query(BASE + "SELECT id, rank::INTEGER AS rank, nid, round(d, 6) AS qe FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS rank FROM far) WHERE rank <= 3")
def bmu_top3(t: Tables) -> DataFrame:
    return bmu.nearest(t.data, t.map, 3)


@query(BASE + "SELECT id, nid, round(d, 6) AS d FROM (SELECT *, avg(d) OVER (PARTITION BY id) - stddev_pop(d) OVER (PARTITION BY id) AS most FROM far) WHERE d < most")
def region_per_input(t: Tables) -> DataFrame:
    return bmu.within_spread(t.data, t.map)


TORUS = "(least(abs({a}.i - {b}.i), 4 - abs({a}.i - {b}.i)) ** 2 + least(abs({a}.j - {b}.j), 4 - abs({a}.j - {b}.j)) ** 2)"
EXPONENTS = BASE + ", best AS (SELECT id, b.nid AS nid, b.i AS i, b.j AS j FROM bmus), ex AS (SELECT best.id, any_value(best.nid) AS nid, -sum(exp(-" + TORUS.format(a="far", b="best") + " / 4.0) * d * d) / max(d * d) AS s FROM far JOIN best USING (id) GROUP BY best.id) "


@query(EXPONENTS + "SELECT id, nid, round(exp(s), 6) AS p FROM ex")
def bmu_probability(t: Tables) -> DataFrame:
    return bmu.probability(t.data, t.map, ROWS, COLS)


@query(EXPONENTS + "SELECT nid, round(exp(avg(s)), 6) AS p FROM ex GROUP BY nid")
def density_probability(t: Tables) -> DataFrame:
    return bmu.density_probability(t.data, t.map, ROWS, COLS)


@query(BASE + "SELECT nid, i, j, (SELECT count(*) FROM bmus WHERE b.nid = book.nid) AS val FROM book")
def hit_density(t: Tables) -> DataFrame:
    return project.density(t.bmus, t.map)


@query(BASE + "SELECT b.nid AS nid, arg_min(id, {'q': qe, 'id': id}) AS id, round(min(qe), 6) AS qe FROM bmus GROUP BY b.nid")
def representative(t: Tables) -> DataFrame:
    return project.representatives(t.bmus)


@query(BASE + "SELECT b.nid AS nid, count(*) AS hits, round(avg(qe), 6) AS mean_qe, round(max(qe), 6) AS max_qe FROM bmus GROUP BY b.nid")
def quantization_error(t: Tables) -> DataFrame:
    return project.quantization_error(t.bmus)


@query(BASE + "SELECT nid, i, j, (SELECT round(avg(label), 6) FROM bmus WHERE b.nid = book.nid) AS val FROM book")
def data_projection(t: Tables) -> DataFrame:
    return project.projection(t.bmus, t.map, "label")


@query(BASE + "SELECT nid, i, j, (SELECT count(*) FROM bmus WHERE b.nid = book.nid AND label = 3) AS actives, (SELECT count(*) FROM bmus WHERE b.nid = book.nid) AS total FROM book")
def active_map(t: Tables) -> DataFrame:
    return project.active_map(t.bmus, t.map, F.col("label") == 3)


@query(BASE + "SELECT b.i AS label, count(*) OVER (PARTITION BY b.i) AS n, id FROM bmus WHERE b.i <> 0")
def cluster_members(t: Tables) -> DataFrame:
    return project.members(t.bmus.drop("label"), t.labels)


@query(BASE + "SELECT b.nid AS label_a, label AS label_b, count(*) AS n FROM bmus GROUP BY 1, 2")
def co_membership(t: Tables) -> DataFrame:
    return project.co_membership(t.bmus.select("id", "nid"), t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("nid")))


@query(BASE + f"SELECT nid, i, j, {FIELD} FROM u")
def umatrix_toric(t: Tables) -> DataFrame:
    return t.umatrix


@query(BASE + "SELECT nid, any_value(nid // 4)::INTEGER AS i, any_value(nid % 4)::INTEGER AS j, round(avg(d), 6) AS val FROM planar JOIN gaps ON nid = a AND other = b GROUP BY nid")
def umatrix_planar(t: Tables) -> DataFrame:
    return grid.umatrix(t.map, ROWS, COLS, False)


@query(BASE + ", round_about AS (SELECT nid, other FROM planar UNION ALL SELECT nid, nid FROM book) SELECT x.nid, round(avg(d), 6) AS val FROM round_about x JOIN round_about y ON x.nid = y.nid AND x.other < y.other JOIN gaps ON a = x.other AND b = y.other GROUP BY x.nid")
def umatrix_window(t: Tables) -> DataFrame:
    return clusters.window_umatrix(t.map, ROWS, COLS)


def _extrema(fn: str, op: str) -> str:
    return BASE + f"SELECT nid, i, j, {FIELD} FROM u WHERE val {op} (SELECT {fn}(o.val) FROM toric JOIN u o ON toric.other = o.nid WHERE toric.nid = u.nid)"


@query(_extrema("min", "<="))
def local_minima(t: Tables) -> DataFrame:
    return grid.extrema(t.umatrix, ROWS, COLS)


@query(_extrema("max", ">="))
def local_maxima(t: Tables) -> DataFrame:
    return grid.extrema(t.umatrix, ROWS, COLS, least=False)


@query(BASE + "SELECT nid, arg_min(other, {'v': o.val, 'n': other}) AS target FROM (SELECT nid, other FROM toric UNION ALL SELECT nid, nid FROM book) x JOIN u o ON x.other = o.nid GROUP BY x.nid".replace("SELECT nid, arg_min", "SELECT x.nid, arg_min"))
def descent_basin(t: Tables) -> DataFrame:
    return grid.basin(t.umatrix, ROWS, COLS)


@query(BASE + "SELECT x.nid, round(sum(sign(x.val - y.val) * d * s.a / sqrt(s.a * s.a + s.b * s.b)), 6) + 0.0 AS di, round(sum(sign(x.val - y.val) * d * s.b / sqrt(s.a * s.a + s.b * s.b)), 6) + 0.0 AS dj FROM u x, steps s, u y, gaps g WHERE y.nid = ((x.i + s.a + 4) % 4) * 4 + (x.j + s.b + 4) % 4 AND g.a = x.nid AND g.b = y.nid GROUP BY x.nid")
def vector_field(t: Tables) -> DataFrame:
    return grid.gradient(t.map, t.umatrix, ROWS, COLS)


def _nd(shape: tuple[int, ...], toric: bool) -> str:
    """Pairs of cells whose coordinates differ by one at most along each axis, around the edge on a torus."""
    size, tests = 1, []
    for n in reversed(shape):
        gap = f"abs((a.id // {size}) % {n} - (b.id // {size}) % {n})"
        tests.append(f"least({gap}, {n} - {gap}) <= 1" if toric else f"{gap} <= 1")
        size *= n
    return f"SELECT a.id::INTEGER AS nid, b.id::INTEGER AS other FROM (SELECT unnest(range({size})) AS id) a, (SELECT unnest(range({size})) AS id) b WHERE a.id <> b.id AND {' AND '.join(tests)}"


_GAP = "round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS d"


def _gaps(t: Tables, pairs: DataFrame) -> DataFrame:
    """``pairs(nid, other)`` of neurons, which are the embeddings of these ids, with their distance."""
    a, b = t.data.select(F.col("id").alias("nid"), F.col("v").alias("a")), t.data.select(F.col("id").alias("other"), F.col("v").alias("b"))
    return pairs.join(a, "nid").join(b, "other").select("nid", "other", vectors.distance(F.col("a"), F.col("b")).alias("d"))


@query(BASE + f"SELECT a.id::INTEGER AS nid, b.id::INTEGER AS other, {_GAP} FROM (SELECT *, count(*) OVER () AS n FROM data) a JOIN data b ON b.id = (a.id + 1) % a.n OR b.id = (a.id + a.n - 1) % a.n WHERE a.id <> b.id")
def neighbours_1d(t: Tables) -> DataFrame:
    """All embeddings as a ring."""
    return _gaps(t, grid.neighbours_nd(t.spark, (t.data.count(),)))


def _register_nd() -> None:
    for shape, toric in (((3, 4, 5), True), ((3, 4, 5), False), ((2, 3, 3, 4), True)):
        sql = BASE + f", near AS ({_nd(shape, toric)}) SELECT nid, other, {_GAP} FROM near JOIN data a ON nid = a.id JOIN data b ON other = b.id"
        query(sql, f"neighbours_{len(shape)}d" + ("" if toric else "_planar"))(lambda t, shape=shape, toric=toric: _gaps(t, grid.neighbours_nd(t.spark, shape, toric)))


_register_nd()


@query(BASE + f", near AS ({_nd((2, 2, 4), True)}) SELECT nid, round(avg(d), 6) AS val FROM near JOIN gaps ON nid = a AND other = b GROUP BY nid")
def umatrix_3d(t: Tables) -> DataFrame:
    return grid.umatrix_nd(t.map, (2, 2, 4))


LEVELS = ", cuts AS (SELECT nid, greatest(1, ceil((val - low) / (high - low) * 10 - 1e-9))::INTEGER AS first FROM u, (SELECT min(val) AS low, max(val) AS high FROM u))"


@query(BASE + LEVELS + " SELECT unnest(range(first, 11))::INTEGER AS level, nid FROM cuts")
def slice_cumulative(t: Tables) -> DataFrame:
    return grid.slices(t.umatrix, 10)


@query(BASE + LEVELS + " SELECT first AS level, nid FROM cuts")
def slice_band(t: Tables) -> DataFrame:
    return grid.slices(t.umatrix, 10, band=True)


@query(BASE + f"SELECT (i + 4 * a)::INTEGER AS u, (j + 4 * b)::INTEGER AS v, nid, {FIELD} FROM u, (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS b)")
def expand(t: Tables) -> DataFrame:
    return grid.tiled(t.umatrix, ROWS, COLS, 3)


@query(BASE + f"SELECT (((i + 1) % 4) * 4 + (j + 2) % 4)::INTEGER AS nid, ((i + 1) % 4)::INTEGER AS i, ((j + 2) % 4)::INTEGER AS j, {FIELD} FROM u")
def roll(t: Tables) -> DataFrame:
    return grid.rolled(t.umatrix, ROWS, COLS, 1, 2)


@query(BASE + """, tiles AS (SELECT i + 4 * a AS u, j + 4 * b AS v, i, j, 3 * a + b AS tile, CASE WHEN (i + 4 * a + 2 * (j + 4 * b)) % 5 = 0 THEN 0.0 ELSE val * (1 + 0.004::DOUBLE * (3 * a + b)) END AS val FROM u, (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS b)),
span AS (SELECT min(val) AS low, max(val) AS high FROM tiles WHERE tile = 5 AND val <> 0)
SELECT i, j, round(coalesce(min(val) FILTER (val <> 0 AND val BETWEEN low AND high), 0.0), 6) AS val FROM tiles, span GROUP BY i, j""")
def condense(t: Tables) -> DataFrame:
    tile = F.expr("u div 4 * 3 + v div 4")
    uneven = F.when((F.col("u") + 2 * F.col("v")) % 5 == 0, 0.0).otherwise(F.col("val") * (1 + 0.004 * tile))
    return grid.condensed(grid.tiled(t.umatrix, ROWS, COLS, 3).withColumn("val", uneven), ROWS, COLS)


@query(BASE + ", cells AS (SELECT unnest(v) AS x, unnest(range(0, 64))::INTEGER AS dim FROM data) SELECT dim, round(min(x), 6) + 0.0 AS low, round(max(x), 6) + 0.0 AS high FROM cells GROUP BY dim")
def init_bounds(t: Tables) -> DataFrame:
    return codebook.bounds(t.data)


@query()
def random_init(t: Tables) -> DataFrame:
    return codebook.random_init(t.data, ROWS, COLS)


@query()
def pca_init(t: Tables) -> DataFrame:
    return codebook.pca_init(t.data, ROWS, COLS)


def _batch(toric: bool) -> str:
    di, dj = ("least(abs(a.i - b.i), 4 - abs(a.i - b.i))", "least(abs(a.j - b.j), 4 - abs(a.j - b.j))") if toric else ("(a.i - b.i)", "(a.j - b.j)")
    return BASE + f""", h AS (SELECT a.nid AS src, b.nid AS dst, b.i, b.j, exp(-({di} * {di} + {dj} * {dj}) / 4.0) AS h FROM book a, book b),
sums AS (SELECT b.nid AS nid, dim, sum(x) AS x, count(*) AS n FROM (SELECT b, unnest(v) AS x, unnest(range(0, 64)) AS dim FROM bmus JOIN data USING (id)) GROUP BY 1, 2),
new AS (SELECT dst, h.i, h.j, dim, sum(h * x) / sum(h * n) AS x FROM h JOIN sums ON src = nid GROUP BY 1, 2, 3, 4)
SELECT dst AS nid, i, j, round(sum(x), 6) + 0.0 AS total, round(sum(x * dim), 4) + 0.0 AS moment FROM new GROUP BY 1, 2, 3"""


def _summed(book: DataFrame) -> DataFrame:
    moment = F.aggregate(F.transform("w", lambda x, k: x * k), F.lit(0.0), lambda s, x: s + x)
    return book.select("nid", "i", "j", vectors.total(F.col("w")).alias("total"), F.round(moment, 4).alias("moment"))


@query(_batch(True))
def batch_step_toric(t: Tables) -> DataFrame:
    return _summed(train.batch_step(t.data, t.map, ROWS, COLS, 1.0))


@query(_batch(False))
def batch_step_planar(t: Tables) -> DataFrame:
    return _summed(train.batch_step(t.data, t.map, ROWS, COLS, 1.0, toric=False))


@query()
def batch_train(t: Tables) -> DataFrame:
    return train.batch_train(t.data, t.map, ROWS, COLS, [2.0, 1.5, 1.0])


@query()
def online_train(t: Tables) -> DataFrame:
    return train.train_online(t.data, t.map, ROWS, COLS)


@query()
def growing_train(t: Tables) -> DataFrame:
    return train.train_growing(t.data)


@query(BASE + """, t AS (SELECT id, b.nid AS nid, (6.25 - 3.0) * exp(-10.0 * id / n) + 3.0 AS r, least(b.i, 4 - b.i) ** 2 + least(b.j, 4 - b.j) ** 2 AS q FROM bmus, (SELECT count(*) AS n FROM bmus))
SELECT id, nid, round(r, 6) AS radius, round(exp(-q / (4 * r * r)), 6) AS gauss, CASE WHEN q = 0 THEN 1.0 ELSE round(sin(sqrt(q) / r * pi()) / (sqrt(q) / r * pi()), 6) + 0.0 END AS sinc FROM t""")
def kernel_values(t: Tables) -> DataFrame:
    """The pull of each input on the first neuron, were the inputs met in the order of their ids while the radius shrinks."""
    met = t.bmus.withColumn("r", kernels.decay(6.25, 3.0, F.col("id"), t.embeddings.count())).withColumn("q", kernels.toric_squared(F.col("i"), F.col("j"), F.lit(0), F.lit(0), ROWS, COLS).cast("double"))
    sinc = F.when(F.col("q") == 0, 1.0).otherwise(kernels.sinc(F.sqrt("q"), F.col("r")))
    return met.select("id", "nid", F.col("r").alias("radius"), kernels.gaussian(F.col("q"), F.col("r")).alias("gauss"), sinc.alias("sinc"))


@query(BASE + "SELECT id, label AS series, round(qe, 6) AS qe, round(max(qe) OVER w, 6) AS rho, round(qe / nullif(max(qe) OVER w, 0), 6) AS epsilon FROM bmus WINDOW w AS (PARTITION BY label ORDER BY id)")
def rho_epsilon(t: Tables) -> DataFrame:
    done = clusters.convergence(t.bmus.withColumn("t", F.col("id")), by="label")
    return done.select("id", F.col("label").alias("series"), "qe", "rho", "epsilon")


EDGE = "round(w, 6) AS w"


@query(BASE + f"SELECT src, dst, {EDGE} FROM edges")
def grid_edges(t: Tables) -> DataFrame:
    return t.edges


@query(BASE + f"SELECT src, dst, {EDGE} FROM edges WHERE src < dst")
def unsymmetrize(t: Tables) -> DataFrame:
    return graphs.unsymmetrized(t.edges)


@query(BASE + f"SELECT src, dst, {EDGE} FROM edges")
def symmetrize(t: Tables) -> DataFrame:
    return graphs.symmetrized(graphs.unsymmetrized(t.edges))


@query(BASE + "SELECT DISTINCT src AS node FROM edges")
def vertices(t: Tables) -> DataFrame:
    return graphs.vertices(t.edges)


@query(BASE + f"SELECT src, dst, {EDGE} FROM edges ORDER BY edges.w, src, dst LIMIT 1")
def smallest_edge(t: Tables) -> DataFrame:
    return graphs.smallest(t.edges)


@query(BASE + f"SELECT src, dst, {EDGE} FROM edges WHERE edges.w <= 1.35")
def prune_edges(t: Tables) -> DataFrame:
    return graphs.pruned(t.edges, 1.35)


@query(BASE + "SELECT x.nid AS r, y.nid AS c, round(coalesce(edges.w, 0.0), 6) AS val FROM book x CROSS JOIN book y LEFT JOIN edges ON src = x.nid AND dst = y.nid")
def adjacency(t: Tables) -> DataFrame:
    return graphs.adjacency(t.edges)


@query(BASE + ", other AS (SELECT src, dst, w * 1.5 AS w FROM edges WHERE (src + dst) % 3 = 0 UNION ALL SELECT src, dst + 100, w FROM edges WHERE src = 1), joint AS (SELECT * FROM other UNION ALL SELECT * FROM edges e WHERE w <= 1.35 AND NOT EXISTS (FROM other o WHERE o.src = e.src AND o.dst = e.dst)) SELECT src, dst, round(w, 6) AS w FROM joint")
def merge_graphs(t: Tables) -> DataFrame:
    heavier = t.edges.where((F.col("src") + F.col("dst")) % 3 == 0).withColumn("w", F.col("w") * 1.5)
    return graphs.merged(graphs.pruned(t.edges, 1.35), heavier.unionByName(t.edges.where("src = 1").withColumn("dst", F.col("dst") + 100)))


@query("WITH RECURSIVE " + BASE.removeprefix("WITH ") + ", reach(node, root) AS (SELECT DISTINCT src, src FROM edges WHERE w <= 1.35 UNION SELECT dst, root FROM reach JOIN edges ON src = node WHERE w <= 1.35) SELECT node, min(root) AS component FROM reach GROUP BY node")
def components(t: Tables) -> DataFrame:
    return graphs.components(graphs.pruned(t.edges, 1.35))


@query("WITH RECURSIVE " + BASE.removeprefix("WITH ") + ", walks(node, dist, seen) AS (SELECT 0, 0.0::DOUBLE, [0] UNION ALL SELECT dst, dist + w, list_append(seen, dst) FROM walks JOIN edges ON src = node WHERE NOT list_contains(seen, dst) AND len(seen) < 16) SELECT node, round(min(dist), 6) AS dist FROM walks GROUP BY node")
def shortest_lengths(t: Tables) -> DataFrame:
    return graphs.shortest_lengths(t.edges, 0)


@query("WITH RECURSIVE " + BASE.removeprefix("WITH ") + """, low AS (SELECT * FROM u WHERE val < 0.99 * (SELECT max(val) FROM u)),
near AS (SELECT DISTINCT t.nid, t.other FROM toric t JOIN low a ON t.nid = a.nid JOIN low b ON t.other = b.nid WHERE a.i = b.i OR a.j = b.j),
reach(node, root) AS (SELECT nid, nid FROM low UNION SELECT other, root FROM reach JOIN near ON nid = node),
comp AS (SELECT node, min(root) AS c FROM reach GROUP BY node),
ranked AS (SELECT c, row_number() OVER (ORDER BY m, c)::INTEGER AS label FROM (SELECT c, avg(val) AS m FROM comp JOIN low ON node = nid GROUP BY c))
SELECT node AS nid, label FROM comp JOIN ranked USING (c)""")
def threshold_clusters(t: Tables) -> DataFrame:
    return graphs.threshold_clusters(t.umatrix, ROWS, COLS, 0.99)


SWEEP = "WITH RECURSIVE " + BASE.removeprefix("WITH ") + """, fixed AS MATERIALIZED (SELECT * FROM u),
cuts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY val)::INTEGER AS step, val AS cut FROM (SELECT DISTINCT val FROM fixed)),
low AS MATERIALIZED (SELECT step, cut, nid, i, j, val FROM fixed JOIN cuts ON val < cut),
near AS MATERIALIZED (SELECT DISTINCT a.step, t.nid, t.other FROM toric t JOIN low a ON t.nid = a.nid JOIN low b ON t.other = b.nid AND a.step = b.step WHERE a.i = b.i OR a.j = b.j),
reach(step, node, root) AS (SELECT step, nid, nid FROM low UNION SELECT near.step, other, root FROM reach JOIN near ON nid = node AND near.step = reach.step),
comp AS (SELECT step, node AS nid, min(root) AS c FROM reach GROUP BY step, node),
ranked AS (SELECT step, c, row_number() OVER (PARTITION BY step ORDER BY m, c)::INTEGER AS label FROM (SELECT step, c, avg(val) AS m FROM comp JOIN low USING (step, nid) GROUP BY step, c)),
sweep AS MATERIALIZED (SELECT step, cut, nid, label FROM comp JOIN ranked USING (step, c) JOIN cuts USING (step))
"""
RATED = """, hits AS MATERIALIZED (SELECT b.nid AS nid, label = 3 AS k FROM bmus),
rated AS (SELECT step, cut, sweep.label, count(*) FILTER (k) / (SELECT count(*) FROM hits WHERE k) AS se, 1 - count(*) FILTER (NOT k) / (SELECT count(*) FROM hits WHERE NOT k) AS sp FROM sweep LEFT JOIN hits USING (nid) GROUP BY ALL),
far_off AS (SELECT *, sqrt((1 - sp) * (1 - sp) + (1 - se) * (1 - se)) AS gamma, count(*) OVER (PARTITION BY step) AS clusters FROM rated),
bests AS (SELECT step, round(cut, 6) AS cut, clusters, label, round(se, 6) AS se, round(sp, 6) AS sp, round(gamma, 6) AS gamma, gamma AS exact FROM far_off QUALIFY row_number() OVER (PARTITION BY step ORDER BY gamma, label) = 1)
"""


@query(SWEEP + "SELECT step, round(cut, 6) AS cut, nid, label FROM sweep")
def threshold_sweep(t: Tables) -> DataFrame:
    return graphs.threshold_sweep(t.umatrix, ROWS, COLS)


def _roc_steps(t: Tables) -> DataFrame:
    return project.roc_sweep(t.bmus.withColumnRenamed("label", "kind"), graphs.threshold_sweep(t.umatrix, ROWS, COLS), F.col("kind") == 3)


@query(SWEEP + RATED + "SELECT * EXCLUDE (exact) FROM bests")
def roc_sweep(t: Tables) -> DataFrame:
    return _roc_steps(t)


@query(SWEEP + RATED + "SELECT * EXCLUDE (exact) FROM bests ORDER BY exact, step LIMIT 1")
def roc_best(t: Tables) -> DataFrame:
    return project.roc_best(_roc_steps(t))


@query(BASE + "SELECT (a // 4)::INTEGER AS label, 4::BIGINT AS n, round(avg(d), 6) AS val FROM gaps WHERE a < b AND a // 4 = b // 4 GROUP BY a // 4")
def looseness(t: Tables) -> DataFrame:
    return clusters.looseness(t.map, t.labels)


@query(BASE + "SELECT (a // 4)::INTEGER AS la, (b // 4)::INTEGER AS lb, round(avg(d), 6) AS val FROM gaps WHERE a // 4 < b // 4 GROUP BY 1, 2")
def cluster_distance(t: Tables) -> DataFrame:
    return clusters.cluster_distance(t.map, t.labels)


UNEVEN = BASE + ", lab AS (SELECT nid, CASE WHEN nid < 1 THEN 0 WHEN nid < 4 THEN 1 WHEN nid < 9 THEN 2 ELSE 3 END AS label FROM book), cells AS (SELECT x.label AS la, y.label AS lb, g.a, g.b, g.d FROM gaps g JOIN lab x ON g.a = x.nid JOIN lab y ON g.b = y.nid), loose AS (SELECT la AS label, sum(d) / greatest(1, count(DISTINCT a) * (count(DISTINCT a) - 1)) AS val FROM cells WHERE la = lb GROUP BY la) "


@query(UNEVEN + "SELECT nid, label, round(val, 6) AS val FROM lab JOIN loose USING (label)")
def looseness_map(t: Tables) -> DataFrame:
    return clusters.looseness_map(t.map, t.uneven)


@query(UNEVEN + ", square AS (SELECT la, lb, CASE WHEN la = lb THEN 0.0 ELSE avg(d) END AS val FROM cells WHERE la > 0 AND lb > 0 GROUP BY la, lb) SELECT 3::BIGINT AS clusters, round(3 * (SELECT avg(val) FROM lab JOIN loose USING (label)) / (SELECT avg(val) FROM square), 6) AS val")
def cluster_separation(t: Tables) -> DataFrame:
    return clusters.separation(t.map, t.uneven)


@query(BASE + "SELECT i AS label, count(*) AS n, round(avg(val), 6) AS mean, round(median(val), 6) AS median, round(min(val), 6) AS low FROM u GROUP BY i")
def cluster_stats(t: Tables) -> DataFrame:
    return graphs.cluster_stats(t.umatrix, t.labels)


@query()
def linkage(t: Tables) -> DataFrame:
    return clusters.linkage(t.map)


@query(BASE + "SELECT bin::INTEGER AS bin, count(*) AS n FROM (SELECT least(floor((qe - low) / (high - low) * 20), 19) AS bin FROM bmus, (SELECT min(qe) AS low, max(qe) AS high FROM bmus)) GROUP BY bin")
def histogram(t: Tables) -> DataFrame:
    return clusters.histogram(t.bmus, "qe", 20)


@query()
def equalize(t: Tables) -> DataFrame:
    return clusters.equalized(t.umatrix, 32)


@query(BASE + ", k AS (SELECT *, dense_rank() OVER (ORDER BY val) - 1 AS r, min(val) OVER () AS low, max(val) OVER () - min(val) OVER () AS h, (SELECT count(DISTINCT val) - 1 FROM u) AS last FROM u) SELECT nid, i, j, round((r * last + val * h) / (last * last + h * h) * h + low, 6) AS val FROM k")
def rank_diagonal(t: Tables) -> DataFrame:
    return clusters.rank_diagonal(t.umatrix)


@query()
def watershed_clusters(t: Tables) -> DataFrame:
    flood = lambda g: pd.DataFrame({"nid": np.arange(g.size, dtype=np.int32), "label": graphs.watershed(g).ravel()})
    return graphs.on_grid(t.umatrix, ROWS, COLS, flood, "nid int, label int")


@query()
def least_path(t: Tables) -> DataFrame:
    def walk(g):
        path = graphs.least_path(g, 0, 10)
        return pd.DataFrame({"step": range(len(path)), "nid": path})

    return graphs.on_grid(t.umatrix, ROWS, COLS, walk, "step int, nid int")


@query()
def monte_carlo_path(t: Tables) -> DataFrame:
    def walk(g):
        path = graphs.monte_carlo(g, 0, 200, 0.01)
        return pd.DataFrame({"step": range(len(path)), "nid": path})

    return graphs.on_grid(t.umatrix, ROWS, COLS, walk, "step int, nid int")


@query("SELECT l_orderkey, round(min(l_extendedprice), 6) AS l_extendedprice, arg_min(l_linenumber, {'p': l_extendedprice, 'n': l_linenumber}) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def best_pose(t: Tables) -> DataFrame:
    return project.best_pose(t.lineitem, "l_orderkey", "l_extendedprice", "l_linenumber")


ROC = """WITH per AS (SELECT c_acctbal AS score, count(*) FILTER (c_mktsegment = 'BUILDING') AS p, count(*) FILTER (c_mktsegment <> 'BUILDING') AS n FROM customer GROUP BY 1),
roc AS (SELECT score, p, n, sum(p) OVER (ORDER BY score)::BIGINT AS tp, sum(n) OVER (ORDER BY score)::BIGINT AS fp, sum(p) OVER () AS ps, sum(n) OVER () AS ns FROM per)
"""


@query(ROC + "SELECT round(score, 6) + 0.0 AS score, tp, fp, round(fp / ns, 6) AS fpr, round(tp / ps, 6) AS tpr FROM roc")
def roc_points(t: Tables) -> DataFrame:
    return project.roc_points(t.customer, "c_acctbal", F.col("c_mktsegment") == "BUILDING").drop("bin")


@query(ROC + "SELECT round(sum(n * (tp - p / 2)) / (any_value(ps) * any_value(ns)), 6) AS auc FROM roc")
def auc(t: Tables) -> DataFrame:
    return project.auc(t.customer, "c_acctbal", F.col("c_mktsegment") == "BUILDING")


@query(BASE + ", k AS (SELECT b.nid AS label, count(*) FILTER (label = 3) / (SELECT count(*) FROM bmus WHERE label = 3) AS se, 1 - count(*) FILTER (label <> 3) / (SELECT count(*) FROM bmus WHERE label <> 3) AS sp FROM bmus GROUP BY b.nid) SELECT label, round(se, 6) AS se, round(sp, 6) AS sp, round(sqrt((1 - sp) * (1 - sp) + (1 - se) * (1 - se)), 6) AS gamma FROM k")
def cluster_sensitivity(t: Tables) -> DataFrame:
    return project.sensitivity(t.bmus.withColumnRenamed("label", "kind"), F.col("kind") == 3)


@query(WALK + "SELECT src, dst, n FROM moves")
def bmu_transitions(t: Tables) -> DataFrame:
    return project.transitions(t.walk, ["user_id"], ["ts", "event_id"])


_IMAGE = "CASE WHEN 2 * {d} > 4 THEN {d} - 4 WHEN 2 * {d} < -4 THEN {d} + 4 ELSE {d} END"
STEPS = WALK + f", s AS (SELECT nid, dst, {_IMAGE.format(d='di')} AS a, {_IMAGE.format(d='dj')} AS b FROM states WHERE dst IS NOT NULL)\n"


def _flow(at: str, of: str, sign: str) -> str:
    return STEPS + f"SELECT {at} AS nid, round({of}({sign}a / sqrt(a * a + b * b)), 6) + 0.0 AS di, round({of}({sign}b / sqrt(a * a + b * b)), 6) + 0.0 AS dj, count(*) AS moves FROM s WHERE a <> 0 OR b <> 0 GROUP BY {at}"


@query(_flow("nid", "sum", ""))
def flow_map(t: Tables) -> DataFrame:
    return project.flow(t.walk, ["user_id"], ["ts", "event_id"], ROWS, COLS)


@query(_flow("dst", "avg", "-"))
def inward_flow(t: Tables) -> DataFrame:
    return project.flow(t.walk, ["user_id"], ["ts", "event_id"], ROWS, COLS, inward=True, normed=True)


@query(WALK + "SELECT user_id, nid, max(k) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM states) WHERE dst IS NOT NULL GROUP BY user_id, nid")
def last_visits(t: Tables) -> DataFrame:
    return project.last_visits(t.walk, ["user_id"], ["ts", "event_id"])


@query(WALK + "SELECT src, dst, n, ceil(n * 6 / (SELECT max(n) FROM moves WHERE src <> dst))::INTEGER AS class FROM moves WHERE src <> dst")
def flux_classes(t: Tables) -> DataFrame:
    return project.flux_classes(project.transitions(t.walk, ["user_id"], ["ts", "event_id"]), 6)


@query(FULL + "SELECT r, c, round(s, 6) + 0.0 AS val FROM pairs")
def scatter(t: Tables) -> DataFrame:
    return linalg.scatter(t.data)


@query(FULL + f"SELECT r, c, {FIELD} FROM cov")
def covariance(t: Tables) -> DataFrame:
    return linalg.covariance(t.data)


@query(FULL + f"SELECT r, c, {FIELD} FROM corr")
def correlation(t: Tables) -> DataFrame:
    return linalg.correlation(linalg.covariance(t.data))


@query(LONG + "SELECT (r // 3)::INTEGER AS r, (c // 3)::INTEGER AS c, round(sum(val) / 3, 6) + 0.0 AS val FROM corr WHERE r % 3 = c % 3 GROUP BY 1, 2".replace("GROUP BY 1, 2", "GROUP BY r // 3, c // 3"))
def block_trace(t: Tables) -> DataFrame:
    return linalg.block_trace(linalg.correlation(linalg.covariance(t.long)))


@query(LONG + "SELECT (r // 3)::INTEGER AS r, (c // 3)::INTEGER AS c, round(avg(val), 6) + 0.0 AS val FROM corr GROUP BY r // 3, c // 3")
def block_mean(t: Tables) -> DataFrame:
    return linalg.block_mean(linalg.correlation(linalg.covariance(t.long)))


@query(FULL + f"SELECT r, c, {FIELD} FROM corr WHERE c < r")
def lower_triangle(t: Tables) -> DataFrame:
    return linalg.lower_triangle(linalg.correlation(linalg.covariance(t.data)))


@query(FULL + f"SELECT r, c, {FIELD} FROM corr WHERE c < r AND corr.val > 0.01 ORDER BY corr.val DESC, r, c")
def strongest_pairs(t: Tables) -> DataFrame:
    return linalg.strongest(linalg.correlation(linalg.covariance(t.data)), 0.01)


@query(LONG + "SELECT (r // 3)::INTEGER AS atom, (r % 3)::INTEGER AS axis, round(sqrt(val), 6) AS val FROM cov WHERE r = c")
def rms_fluctuation(t: Tables) -> DataFrame:
    return linalg.rms(linalg.covariance(t.long))


PAIRS = ", gaps AS (SELECT x.id, x.a, y.a AS b, list_distance(x.p, y.p) AS d FROM points x JOIN points y ON x.id = y.id AND x.a <> y.a)"


@query(LONG + PAIRS + " SELECT id, a, b, round(d, 6) AS d FROM gaps WHERE a < b")
def pairwise_distance(t: Tables) -> DataFrame:
    return linalg.pair_distances(linalg.atoms(t.long))


@query(LONG + PAIRS + ", m AS (SELECT id, a, 1 / d AS x, avg(1 / d) OVER (PARTITION BY id, a) AS mu FROM gaps), k AS (SELECT id, a, any_value(mu) AS mu, avg((x - mu) * (x - mu)) AS m2, avg((x - mu) ** 3) AS m3 FROM m GROUP BY id, a) SELECT id, a AS atom, round(mu, 6) AS mu, round(sqrt(m2), 6) AS nu, round(sign(m3) * cbrt(abs(m3)), 4) + 0.0 AS xi FROM k")
def drid(t: Tables) -> DataFrame:
    return linalg.drid(linalg.atoms(t.long)).withColumn("xi", F.round("xi", 4))


@query(LONG + PAIRS + " SELECT id, a, b, round(CASE WHEN d < 0.15 THEN 0.5 * (d - 0.15) * (d - 0.15) WHEN d <= 0.25 THEN 0.0 WHEN d <= 0.35 THEN 0.5 * (d - 0.25) * (d - 0.25) ELSE 0.5 * (0.35::DOUBLE - 0.25::DOUBLE) * (2 * d - 0.35::DOUBLE - 0.25::DOUBLE) END, 6) AS e FROM gaps WHERE a < b")
def restraint_potential(t: Tables) -> DataFrame:
    found = linalg.pair_distances(linalg.atoms(t.long))
    return found.select("id", "a", "b", linalg.restraint_potential(F.col("d"), 0.15, 0.25, 0.35).alias("e"))


@query()
def kabsch_rmsd(t: Tables) -> DataFrame:
    points = linalg.atoms(t.long)
    return linalg.kabsch(points, points.where("id = 0").first().xyz)


Q4 = "WITH p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) "


@query(Q4 + """SELECT id, round(v[1] * v[5] - v[2] * v[6] - v[3] * v[7] - v[4] * v[8], 6) + 0.0 AS w, round(v[1] * v[6] + v[2] * v[5] + v[3] * v[8] - v[4] * v[7], 6) + 0.0 AS x,
round(v[1] * v[7] - v[2] * v[8] + v[3] * v[5] + v[4] * v[6], 6) + 0.0 AS y, round(v[1] * v[8] + v[2] * v[7] - v[3] * v[6] + v[4] * v[5], 6) + 0.0 AS z FROM p""")
def quaternion_product(t: Tables) -> DataFrame:
    q = geometry.quaternion_multiply(F.slice("v", 1, 4), F.slice("v", 5, 4))
    return t.data.select("id", q.alias("q")).select("id", *(F.col("q")[k].alias(n) for k, n in enumerate("wxyz")))


@query(Q4 + "SELECT id, round(acos(greatest(-1, least(1, list_cosine_similarity(v[1:3], v[4:6])))), 6) AS angle, round(v[2] * v[6] - v[3] * v[5], 6) + 0.0 AS x, round(v[3] * v[4] - v[1] * v[6], 6) + 0.0 AS y, round(v[1] * v[5] - v[2] * v[4], 6) + 0.0 AS z FROM p")
def vector_angle_and_product(t: Tables) -> DataFrame:
    a, b = F.slice("v", 1, 3), F.slice("v", 4, 3)
    return t.data.select("id", geometry.angle(a, b).alias("angle"), geometry.cross(a, b).alias("c")).select("id", "angle", *(F.col("c")[k].alias(n) for k, n in enumerate("xyz")))


@query(Q4 + "SELECT id, round(v[1], 6) + 0.0 AS x, round(v[2], 6) + 0.0 AS y, round(v[3], 6) + 0.0 AS z FROM p")
def euler_round_trip(t: Tables) -> DataFrame:
    v = F.col("v")
    e = geometry.euler_from_matrix(F.col("m"))
    return t.data.select("id", geometry.euler_matrix(v[0], v[1], v[2]).alias("m")).select("id", e.alias("e")).select("id", *(F.col("e")[k].alias(n) for k, n in enumerate("xyz")))


@query(Q4 + "SELECT id, round(1 + v[1] * v[1], 6) AS s, round(v[4], 6) + 0.0 AS shear, round(v[7], 6) + 0.0 AS turn, round(v[10], 6) + 0.0 AS move FROM p")
def decompose_round_trip(t: Tables) -> DataFrame:
    v = F.col("v")
    m = transforms.compose(F.transform(F.slice(v, 1, 3), lambda x: 1 + x * x), F.slice(v, 4, 3), F.slice(v, 7, 3), F.slice(v, 10, 3))
    d = t.data.select("id", F.explode(F.array(m)).alias("m")).select("id", transforms.decompose(F.col("m")).alias("d"))
    return d.select("id", *(F.col("d")[k].alias(n) for k, n in ((0, "s"), (3, "shear"), (6, "turn"), (9, "move"))))


@query()
def pca_scores(t: Tables) -> DataFrame:
    return molecules.pca_scores(t.data)


@query(LONG + ", first AS (SELECT a, p AS q FROM points WHERE id = 0) SELECT id, round(sqrt(avg(list_distance(p, q) ** 2)), 6) AS rmsd FROM points JOIN first USING (a) GROUP BY id")
def plain_rmsd(t: Tables) -> DataFrame:
    points = linalg.atoms(t.long)
    return molecules.rmsd(points, points.where("id = 0").first().xyz)


@query(LONG + ", first AS (SELECT a, p AS q FROM points WHERE id = 0) SELECT id, a AS atom, round(list_distance(p, q), 6) AS d FROM points JOIN first USING (a)")
def atom_distances(t: Tables) -> DataFrame:
    points = linalg.atoms(t.long)
    return molecules.atom_distances(points, points.where("id = 0").first().xyz)


@query(BASE + """, flat AS (SELECT d.id, b.nid AS nid, unnest(v[1:63]) AS x, unnest(range(1, 64)) AS k FROM data d JOIN bmus USING (id)), means AS (SELECT nid, k, avg(x) AS m FROM flat GROUP BY 1, 2),
away AS (SELECT f.nid, f.id, sqrt(sum((x - m) * (x - m)) / 21) AS r FROM flat f JOIN means USING (nid, k) GROUP BY 1, 2)
SELECT nid, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS spread FROM away GROUP BY nid""")
def rmsd_spread(t: Tables) -> DataFrame:
    return molecules.rmsd_spread(linalg.atoms(t.long), t.bmus)


def _turn_sql(axes: str) -> str:
    """The nine entries of the product of three turns about axes, multiplied out as text."""

    def one(axis: str, angle: str) -> list[list[str]]:
        i, out = "xyz".index(axis), [["1.0" if r == c else "0.0" for c in range(3)] for r in range(3)]
        j, k = (i + 1) % 3, (i + 2) % 3
        out[j][j] = out[k][k] = f"cos({angle})"
        out[j][k], out[k][j] = f"-sin({angle})", f"sin({angle})"
        return out

    def times(a, b):
        return [["(" + " + ".join(f"({a[r][k]}) * ({b[k][c]})" for k in range(3)) + ")" for c in range(3)] for r in range(3)]

    turns = [one(axis, f"v[{n + 1}]") for n, axis in enumerate(axes[1:])]
    a, b, c = turns if axes[0] == "r" else turns[::-1]
    m = times(times(a, b), c)
    return f"SELECT id, '{axes}' AS axes, " + ", ".join(f"round({m[r][c]}, 6) + 0.0 AS m{r}{c}" for r in range(3) for c in range(3)) + " FROM p"


@query("WITH p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings) " + " UNION ALL ".join(map(_turn_sql, euler.ORDERS)))
def euler_orders(t: Tables) -> DataFrame:
    v = lambda k: F.col("v")[k] * 3
    turned = t.data.select("id", F.explode(F.array(*(F.struct(F.lit(o).alias("axes"), euler.euler_matrix(v(0), v(1), v(2), o).alias("m")) for o in euler.ORDERS))).alias("e"))
    return turned.select("id", "e.axes", *(F.col("e.m")[4 * r + c].alias(f"m{r}{c}") for r in range(3) for c in range(3)))


@query()
def euler_angles_of_orders(t: Tables) -> DataFrame:
    v = lambda k: F.col("v")[k] * 3
    turned = t.data.select("id", F.explode(F.array(*(F.struct(F.lit(o).alias("axes"), euler.euler_from_matrix(euler.euler_matrix(v(0), v(1), v(2), o), o).alias("e")) for o in euler.ORDERS))).alias("x"))
    return turned.select("id", "x.axes", "x.e")
