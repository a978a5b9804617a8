"""Formulas against plain NumPy, golden values and maps of real size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix import catalog
from lattix.functions import euler
from lattix.operators import bmu, graphs, linalg, molecules, train
from lattix.sources import dcd  # noqa: F401


def one(spark, **columns):
    return list(spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first())


def test_euler_golden_values(spark):
    a, b, c = (F.lit(float(x)) for x in (1, 2, 3))
    syxz, ryzx, q = one(spark, m=euler.euler_matrix(a, b, c, "syxz"), n=euler.euler_matrix(a, b, c, "ryzx"), q=euler.quaternion_from_euler(a, b, c, "ryxz"))
    assert sum(syxz[:3]) == pytest.approx(-1.34786452) and sum(ryzx[:3]) == pytest.approx(-0.383436184)
    assert q == pytest.approx([0.435953, 0.310622, -0.718287, 0.444435], abs=1e-6)
    turn = F.array(*map(F.lit, (0.99810947, 0.06146124, 0.0, 0.0)))
    assert one(spark, e=euler.euler_from_quaternion(turn))[0] == pytest.approx([0.123, 0, 0], abs=1e-6)


def test_euler_angles_give_the_same_turn_in_all_orders(spark):
    rng = np.random.default_rng(3)
    rows = rng.uniform(-math.pi, math.pi, (20, 3)).tolist() + [[0.3, 0.0, 0.4], [0.3, math.pi / 2, 0.4], [0.2, math.pi, 0.1]]
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>")
    v = F.col("v")
    for order in euler.ORDERS:
        m = df.select(euler.euler_matrix(v[0], v[1], v[2], order).alias("m"))
        e = m.select("m", euler.euler_from_matrix(F.col("m"), order).alias("e"))
        for r in e.select("m", euler.euler_matrix(F.col("e")[0], F.col("e")[1], F.col("e")[2], order).alias("again")).collect():
            assert r.again == pytest.approx(r.m, abs=1e-7), order


def test_scores_and_residuals(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 3
    found = sorted(molecules.pca_scores(spark.createDataFrame([(k, r) for k, r in enumerate(x.tolist())], "id long, v array<double>"), 2).collect())
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred)
    axes = axes[:2] * np.sign(axes[:2][range(2), np.abs(axes[:2]).argmax(1)])[:, None]
    scores = centred @ axes.T
    assert np.allclose([r.scores for r in found], scores)
    assert np.allclose([r.residual for r in found], np.linalg.norm(centred - scores @ axes, axis=1))


@pytest.fixture(scope="module")
def large(spark):
    rng = np.random.default_rng(5)
    w, x = rng.normal(size=(2500, 8)), rng.normal(size=(300, 8))
    book = spark.createDataFrame([(k, k // 50, k % 50, r) for k, r in enumerate(w.tolist())], "nid int, i int, j int, w array<double>")
    return w, x, book, spark.createDataFrame([(k, r) for k, r in enumerate(x.tolist())], "id long, v array<double>")


def test_a_map_of_50_by_50(spark, large):
    w, x, book, data = large
    d = np.linalg.norm(x[:, None] - w[None], axis=2)
    best = d.argmin(1)
    for found in (bmu.assign(data, book), bmu.assign_arrow(data, book)):
        rows = sorted(found.select("id", "nid", "qe").collect())
        assert [r.nid for r in rows] == best.tolist() and np.allclose([r.qe for r in rows], d.min(1))
    gap = np.abs(np.arange(50)[:, None] - np.arange(50)[None])
    gap = np.minimum(gap, 50 - gap) ** 2
    h = np.exp(-(gap[:, None, :, None] + gap[None, :, None, :]).reshape(2500, 2500) / 16)
    hits, sums = np.bincount(best, minlength=2500), np.zeros((2500, 8))
    np.add.at(sums, best, x)
    new = sorted(train.batch_step(data, book, 50, 50, 2.0).collect())
    assert np.allclose([r.w for r in new], (h @ sums) / (h @ hits)[:, None])
    p = {r.id: r.p for r in bmu.probability(data, book, 50, 50).collect()}
    k = np.exp(-(gap[:, None, :, None] + gap[None, :, None, :]).reshape(2500, 2500) / 4)
    assert np.allclose([p[i] for i in range(300)], np.exp(-(k[best] * d**2).sum(1) / (d**2).max(1)))


def test_a_map_in_blocks_gives_what_one_block_gives(spark, large, monkeypatch):
    _, _, book, data = large
    few = data.limit(20)
    want = [sorted(map(tuple, f.collect())) for f in (bmu.nearest(few, book, 3), bmu.within_spread(few, book), bmu.probability(few, book, 50, 50))]
    monkeypatch.setattr(bmu, "BLOCK", 900)
    got = [sorted(map(tuple, f.collect())) for f in (bmu.nearest(few, book, 3), bmu.within_spread(few, book), bmu.probability(few, book, 50, 50))]
    assert len(want[0]) == 60
    for a, b in zip(want, got):
        assert len(a) == len(b) and all(x == pytest.approx(y) for x, y in zip(a, b))


def test_null_vectors_fail_loudly(spark):
    book = spark.createDataFrame([(0, 0, 0, [0.0, 0.0])], "nid int, i int, j int, w array<double>")
    for bad in (None, [1.0, None], [1.0]):
        with pytest.raises(Exception, match="null"):
            bmu.assign_arrow(spark.createDataFrame([(0, [1.0, 2.0]), (1, bad)], "id long, v array<double>"), book).collect()
    with pytest.raises(Exception, match="null"):
        linalg.covariance(spark.createDataFrame([(0, [1.0, 2.0]), (1, None)], "id long, v array<double>")).collect()


def test_the_second_graph_wins(spark):
    a = spark.createDataFrame([(0, 1, 1.0), (1, 2, 5.0)], "src int, dst int, w double")
    b = spark.createDataFrame([(1, 2, 9.0), (2, 3, 1.0)], "src int, dst int, w double")
    assert sorted(map(tuple, graphs.merged(a, b).collect())) == [(0, 1, 1.0), (1, 2, 9.0), (2, 3, 1.0)]


def test_angles_query_turns_back(spark, sf):
    rows = catalog.QUERIES["euler_angles_of_orders"](spark, sf).where("axes in ('sxyz', 'rzxz')").limit(50).collect()
    assert all(len(r.e) == 3 and all(abs(x) <= math.pi + 1e-9 for x in r.e) for r in rows) and rows
