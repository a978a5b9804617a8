"""Inverses of the transform builders on random arguments: what they tell builds the same matrix again."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.functions import geometry as g
from lattix.functions import transforms as t


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = [(k, *(rng.normal(size=3).tolist() for _ in range(4)), float(rng.uniform(-1.4, 1.4)), rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for k in range(60)]
    return spark.createDataFrame(data, "id int, a array<double>, b array<double>, c array<double>, d array<double>, x double, p array<double>, q array<double>").cache()


def same(df, one, two):
    got = df.select(t.is_same(one, two).alias("same")).collect()
    assert got and all(r.same for r in got)


@pytest.mark.parametrize("kind", ["orthogonal", "parallel", "perspective", "pseudo"])
def test_projections(rows, kind):
    n = F.col("b")
    m = {"orthogonal": t.projection(F.col("a"), n), "parallel": t.projection(F.col("a"), n, F.col("c")), "perspective": t.projection(F.col("a"), n, perspective=F.col("d")), "pseudo": t.projection(F.col("a"), n, perspective=F.col("d"), pseudo=True)}[kind]
    built = rows.withColumn("m", m).withColumn("m", F.transform("m", lambda x: x * (F.col("id") % 3 - 1.5))).withColumn("f", t.projection_from(F.col("m"), kind == "pseudo"))
    built = built.withColumns({k: F.slice("f", at, 3) for k, at in (("point", 2), ("normal", 5), ("direction", 8), ("eye", 11))}).cache()
    assert {r[0] for r in built.select(F.col("f")[0]).collect()} == {0.0 if kind == "orthogonal" else 1.0 if kind == "parallel" else 2.0}
    again = {"orthogonal": t.projection(F.col("point"), F.col("normal")), "parallel": t.projection(F.col("point"), F.col("normal"), F.col("direction")), "perspective": t.projection(F.col("point"), F.col("normal"), perspective=F.col("eye")), "pseudo": t.projection(F.col("point"), F.col("normal"), perspective=F.col("eye"), pseudo=True)}[kind]
    same(built, again, F.col("m"))


def test_shears(rows):
    m = t.shear(F.col("x"), g.cross(F.col("a"), F.col("b")), F.col("c"), F.col("b"))
    built = rows.withColumn("m", m).withColumn("f", t.shear_from(F.col("m"))).cache()
    same(built, t.shear(F.col("f")[0], F.slice("f", 2, 3), F.slice("f", 5, 3), F.slice("f", 8, 3)), F.col("m"))
    assert all(math.isclose(abs(r.x), r.angle, abs_tol=1e-9) for r in built.select("x", F.col("f")[0].alias("angle")).collect())
    plain = rows.limit(1).select(t.shear_from(g.translation(F.col("a"))).alias("moved"), t.shear_from(g.vec(*np.eye(4).ravel())).alias("none"), t.projection_from(g.vec(*np.eye(4).ravel())).alias("no")).first()
    assert plain.moved is None or plain.moved[0] == 0 and plain.none[0] == 0 and plain.no is None


def test_composed_with_perspective(rows):
    angles = F.transform("c", lambda x: x / 2)
    m = t.compose(F.col("a"), F.col("b"), angles, F.col("d"), F.col("p"))
    built = rows.withColumn("m", m).withColumn("f", t.decompose(F.col("m"))).cache()
    part = lambda k, n=3: F.slice("f", k + 1, n)
    same(built, t.compose(part(0), part(3), part(6), part(9), part(12, 4)), F.col("m"))
    plain = rows.withColumn("m", t.compose(F.col("a"), F.col("b"), angles, F.col("d"))).withColumn("f", t.decompose(F.col("m")))
    assert all(r.f[12:] == [0.0, 0.0, 0.0, 1.0] for r in plain.collect())
    for bad in (np.diag([1, 1, 1, 0.0]), np.diag([1, 0.0, 1, 1])):
        with pytest.raises(Exception, match="zero|singular"):
            rows.limit(1).select(t.decompose(g.vec(*bad.ravel()))).collect()


def test_affine_options(spark, rows):
    rng = np.random.default_rng(3)
    q, s, move = np.linalg.qr(rng.normal(size=(3, 3)))[0], 1.7, np.array([1.0, -2.0, 0.5])
    q *= np.sign(np.linalg.det(q))
    a = rng.normal(size=(20, 3))
    skew = rng.normal(size=(3, 3))
    df = spark.createDataFrame([(a.ravel().tolist(), (a @ (s * q).T + move).ravel().tolist(), (a @ skew.T + move).ravel().tolist())], "a array<double>, b array<double>, c array<double>")
    got = df.select(t.affine(F.col("a"), F.col("b"), shears=False).alias("similar"), t.affine(F.col("a"), F.col("b"), shears=False, scale=False).alias("rigid"), t.affine(F.col("a"), F.col("c")).alias("full"), t.affine(F.col("a"), F.col("c"), total=True).alias("total")).first()
    of = lambda m: np.array(m).reshape(4, 4)
    assert np.allclose(of(got.similar)[:3, :3], s * q) and np.allclose(of(got.similar)[:3, 3], move)
    assert np.allclose(of(got.rigid)[:3, :3], q)
    assert all(np.allclose(of(x)[:3, :3], skew) and np.allclose(of(x)[:3, 3], move) for x in (got.full, got.total))
    # Golden: a rectangle seen by a camera (fixed values).
    flat = lambda x, y: [v for p in zip(x, y, [0, 0, 0, 0]) for v in map(float, p)]
    seen = spark.createDataFrame([(flat([0, 1031, 1031, 0], [0, 0, 1600, 1600]), flat([675, 826, 826, 677], [55, 52, 281, 277]))], "a array<double>, b array<double>")
    m = of(seen.select(t.affine(F.col("a"), F.col("b"), total=True).alias("m")).first().m)
    assert np.allclose(m[:2, [0, 1, 3]], [[0.14549, 0.00062, 675.50008], [0.00048, 0.14094, 53.24971]], atol=6e-6)


def test_slerp_with_spin_and_long_arc(rows):
    own = lambda c: F.transform(c, lambda x: x / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y)))
    df = rows.select("id", own("p").alias("p"), own("q").alias("q")).cache()
    for spin, shortest in ((0, True), (1, True), (2, False), (0, False)):
        for f in (0.0, 0.3, 1.0):
            for r in df.select("p", "q", g.quaternion_slerp(F.col("p"), F.col("q"), f, spin, shortest).alias("m")).collect():
                a, b = np.array(r.p), np.array(r.q)
                d = a @ b
                if shortest and d < 0 and 0 < f < 1:
                    b, d = -b, -d
                w = math.acos(d) + spin * math.pi
                want = a if f == 0 else b if f == 1 else (math.sin((1 - f) * w) * a + math.sin(f * w) * b) / math.sin(w)
                assert np.allclose(r.m, want)
