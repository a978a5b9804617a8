"""Trajectories by ranges of frames, and operators on frames, against plain NumPy."""

import numpy as np
import pytest

from lattix.operators import frames as fr
from lattix.sources import dcd, trajectory


def test_trajectory_by_ranges_of_frames(spark, tmp_path):
    rng = np.random.default_rng(0)
    v, box = rng.normal(size=(1000, 36)).astype("f4").astype(float), rng.uniform(1, 9, (1000, 6))
    df = spark.createDataFrame([(k, v[k].tolist(), box[k].tolist()) for k in rng.permutation(1000).tolist()], "at int, v array<double>, box array<double>").repartition(5)
    to = f"{tmp_path}/out"
    trajectory.write_trajectory(df, to, "at", file_frames=150)
    back = trajectory.frame_id(trajectory.read_trajectory(spark, to))
    rows = back.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1000))
    assert np.array_equal(np.array([r.v for r in rows]), v) and np.array_equal(np.array([r.box for r in rows]), box)
    name = rows[0].path
    h = trajectory._header(name)
    assert h["cell"] and h["frames"] == sum(r.path == name for r in rows)
    # A split of three frames: tasks never hold a file.
    size = dcd.frame_bytes(h)
    few = spark.read.format("trajectory").option("splitBytes", str(3 * size)).option("atoms", "0,11").option("frames", "70").load(to)
    assert few.rdd.getNumPartitions() >= few.count() / 3
    got = {(r.path, r.frame): r.v for r in few.collect()}
    assert all(list(got[r.path, r.frame]) == r.v[:3] + r.v[33:36] for r in rows if r.frame < 70) and max(f for _, f in got) == 69
    parsed = list(dcd.parse(open(name, "rb").read()))
    assert [list(x) for _, x, _ in parsed] == [r.v for r in rows if r.path == name]
    # Written again without cells, over what is there; files of another reader are read, too.
    trajectory.write_trajectory(df.drop("box").where("at < 10"), to, "at")
    again = trajectory.read_trajectory(spark, f"{to}/part-*.dcd").collect()
    assert sorted(r.v for r in again) == sorted(v[:10].tolist()) and all(r.box is None for r in again)
    (tmp_path / "one.dcd").write_bytes(dcd.encode([v[0], v[1]]))
    assert [r.v for r in trajectory.read_trajectory(spark, f"file://{tmp_path}/one.dcd").orderBy("frame").collect()] == v[:2].tolist()
    (tmp_path / "bad.dcd").write_bytes(b"no trajectory")
    with pytest.raises(Exception, match="trajectory"):
        trajectory.read_trajectory(spark, f"{tmp_path}/bad.dcd").count()
    with pytest.raises(Exception, match="nothing"):
        trajectory.read_trajectory(spark, f"{tmp_path}/nothing").count()


def placed(spark, n=60, rows=3, cols=4, empty=(5,)):
    rng = np.random.default_rng(1)
    xyz = rng.normal(size=(n, 7, 3))
    nid = [int(c) for c in rng.choice([c for c in range(rows * cols) if c not in empty], n)]
    frames = spark.createDataFrame([(k, xyz[k].tolist()) for k in range(n)], "id long, xyz array<array<double>>")
    bmus = spark.createDataFrame([(k, nid[k], float((k * 7) % n)) for k in range(n)], "id long, nid int, qe double")
    return xyz, nid, frames, bmus


@pytest.mark.parametrize("rows, cols, empty", [(3, 4, (5,)), (4, 3, (0, 1, 2)), (2, 2, ())])
def test_rmsd_maps(spark, rows, cols, empty):
    xyz, nid, frames, bmus = placed(spark, rows=rows, cols=cols, empty=empty)
    n = len(xyz)
    best = {c: min((k for k in range(n) if nid[k] == c), key=lambda k: (k * 7) % n) for c in set(nid)}
    r = lambda a, b: np.sqrt(((xyz[a] - xyz[b]) ** 2).sum() / 7)
    one, many = {}, {}
    for c, k in best.items():
        around = [((c // cols + a) % rows) * cols + (c % cols + b) % cols for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
        far = [r(k, best[x]) for x in around if x in best]
        one[c] = (len(far), np.mean(far) if far else None)
        far = [x for x in (r(k, m) for y in [c, *around] for m in range(n) if nid[m] == y) if x]
        many[c] = (len(far), np.mean(far) if far else None)
    for want, got in ((one, fr.rmsd_map(frames, bmus, rows, cols)), (many, fr.rmsd_map_all(frames, bmus, rows, cols))):
        got = {x.nid: (x.n, x.val) for x in got.collect()}
        assert got.keys() == want.keys()
        assert all(got[c][0] == want[c][0] and got[c][1] == pytest.approx(want[c][1]) for c in want)


def test_distance_features(spark):
    xyz, _, frames, _ = placed(spark)
    got = {r.id: r for r in fr.distance_features(frames, xyz[0].tolist(), 3).collect()}
    first = None
    for k in range(len(xyz)):
        gaps = ((xyz[k][:, None] - xyz[k][None]) ** 2).sum(2)
        values, axes = np.linalg.eig(np.cov(gaps - gaps.mean(1)[:, None]))
        order = np.argsort(values.real)[::-1]
        values, axes = values.real[order], axes.real[:, order[:3]]
        first = axes if first is None else first
        mine = np.array(got[k].axes).reshape(7, 3)
        same = np.sign((axes * mine).sum(0))  # eigenvectors have no sign of their own; ours is held against frame 0 below
        assert np.allclose(mine, axes * same) and np.allclose(got[k].eigenvalues, values) and np.allclose(got[k].means, gaps.mean(1))
        assert np.allclose(np.array(got[k].descriptor).reshape(3, 7), mine.T @ gaps)
        assert ((mine * np.array(got[0].axes).reshape(7, 3)).sum(0) > 0).all()
    plain = fr.distance_features(frames, xyz[0].tolist(), 3, projection=False).where("id = 4").first()
    assert np.allclose(np.array(plain.descriptor).reshape(3, 7).T.ravel(), plain.axes)


def test_pair_features_and_violations(spark):
    xyz, nid, frames, bmus = placed(spark)
    got = {r.id: r.v for r in fr.pair_features(frames, [(1, 3), (0, 2), (2, 5), (4, 6)]).collect()}
    columns = []
    for a, b in ((1, 3), (2, 5)):
        normal = lambda k: np.cross(xyz[:, k + 1] - xyz[:, k], xyz[:, k - 1] - xyz[:, k])
        columns += [np.linalg.norm(xyz[:, a] - xyz[:, b], axis=1), (normal(a) * normal(b)).sum(1) / np.linalg.norm(normal(a)) / np.linalg.norm(normal(b))]
    want = np.stack(columns, 1)
    assert all(np.allclose(got[k], want[k]) for k in range(len(xyz)))
    over = (np.stack([np.linalg.norm(xyz[:, a] - xyz[:, b], axis=1) for a, b in ((0, 2), (1, 6))], 1) > 2).sum(1)
    rows = {r.nid: tuple(r)[1:] for r in fr.violations(frames, bmus, [(0, 2), (1, 6)], 2.0).collect()}
    for c in set(nid):
        mine = over[[k for k in range(len(nid)) if nid[k] == c]]
        assert rows[c] == (len(mine), mine.sum(), pytest.approx(mine.mean()))
