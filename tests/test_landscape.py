import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.operators import graphs, landscape, linalg, molecules, networks

RNG = np.random.default_rng(7)


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    joined = []
    for w, a, b in pairs:
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
            joined.append((w, a, b))
    return joined


def test_reconnected_is_shortest(spark):
    nodes = range(12)
    links = [(float(w), a, b) for w, (a, b) in zip(RNG.permutation(66), itertools.combinations(nodes, 2))]
    kept = [(50.0, 0, 1), (51.0, 2, 3), (52.0, 3, 4)]
    table = lambda rows: spark.createDataFrame([(a, b, w) for w, a, b in rows] + [(b, a, w) for w, a, b in rows], "src int, dst int, w double")
    got = {(r.w, r.src, r.dst) for r in networks.reconnected(table(kept), table(links)).collect() if r.src < r.dst}
    assert got == set(union(kept + sorted(links), nodes)) and len(got) == 11


def test_largest_component_ties_to_the_smaller(spark):
    edges = spark.createDataFrame([(5, 6, 1.0), (6, 5, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "src int, dst int, w double")
    assert {r.src for r in networks.largest_component(edges).collect()} == {1, 2}


def test_route_without_an_edge_has_no_length(spark):
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0)], "src int, dst int, w double")
    routes = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("b", 0, 2), ("b", 1, 0)], "route string, step int, node int")
    assert {r.route: r.length for r in networks.route_lengths(routes, edges).collect()} == {"a": 5.0, "b": None}


def test_no_pair_gives_no_row(spark):
    found = spark.createDataFrame([(0, 1, 2.0, [0, 1])], "source int, node int, dist double, path array<int>")
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "node int")
    assert networks.graph_distance(found, nodes(0), nodes(5)).count() == 0
    assert networks.longest_path(found, nodes(7)).count() == 0
    assert networks.graph_distance(found, nodes(0), nodes(1)).first().dist == 2.0


def test_layout_against_numpy(spark):
    place = RNG.random((6, 2))
    pairs = [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src int, dst int, w double")
    start = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(place)], "node int, x double, y double")
    fixed = spark.createDataFrame([(5,)], "node int")
    got = {r.node: (r.x, r.y) for r in networks.force_layout(edges, start, 3, fixed).collect()}
    rest = np.sqrt(np.prod(place.max(0) - place.min(0)) / 6)
    for step in range(3):
        new = place.copy()
        for a in range(5):
            force = np.zeros(2)
            for b in range(6):
                d = place[a] - place[b]
                size = max(np.hypot(*d), 0.01)
                force += d * (rest**2 / size**2 - ((a, b) in pairs or (b, a) in pairs) * size / rest)
            new[a] += force * 0.1 * (1 - step / 4) / (np.hypot(*force) if np.hypot(*force) >= 0.01 else 0.1)
        place = new
    assert all(np.allclose(got[k], place[k]) for k in range(6))


def test_merge_heights_are_the_lowest_passes():
    field = RNG.random((5, 6))
    tree = landscape.merge_tree(field)
    flat = field.ravel()
    assert len(tree) == len(np.unique(graphs.watershed(field))) - 1 and tree.n.iloc[-1] <= flat.size
    assert list(tree.height) == sorted(tree.height) == [flat[s] for s in tree.saddle]
    for m in tree.itertuples():  # b meets a lower minimum first at this height
        lower = [k for k in {*tree.a, *tree.b} if (flat[k], k) < (flat[m.b], m.b)]
        assert min(max(flat[c] for c in graphs.least_path(field, m.b, k)) for k in lower) == m.height


def test_step_and_slide_ends_meet():
    field = np.add.outer(np.cos(np.arange(12)), np.sin(np.arange(10)))
    found = landscape.step_and_slide(field, 3, 83, 0.3, 10.0)
    ends = [found[found.side == s].nid.iloc[-1] for s in (0, 1)]
    gaps = [abs(ends[0] // 10 - ends[1] // 10), abs(ends[0] % 10 - ends[1] % 10)]
    assert min(gaps[0], 12 - gaps[0]) <= 1 and min(gaps[1], 10 - gaps[1]) <= 1
    with pytest.raises(ValueError):
        landscape.step_and_slide(field, 0, 35, 0.3, 1e-9)


def test_peaks_leave_the_background(spark):
    values = np.zeros((5, 5))
    values[2, 2] = 1.0
    field = spark.createDataFrame([(k, k // 5, k % 5, float(x)) for k, x in enumerate(values.ravel())], "nid int, i int, j int, val double")
    assert [r.nid for r in landscape.peaks(field, 5, 5).collect()] == [12]


def test_descriptor_turns_with_its_points(spark):
    points, charges = RNG.random((12, 3)) * 4, np.array([1, 2, 1.5, -1, -2, -3, 0.7, -0.6, 0.5, 0.1, 0.0, -0.2])
    angle = 0.7
    turn = np.array([[np.cos(angle), -np.sin(angle), 0], [np.sin(angle), np.cos(angle), 0], [0, 0, 1]])
    d = molecules.descriptor(points, charges)
    assert d.shape == (60,) and np.allclose(d[:3], points.mean(0)) and np.allclose(d[12:15], points[:3].mean(0))
    want = molecules.descriptor(points @ turn.T, charges)
    got = spark.range(1).select(molecules.rotated(F.array(*map(F.lit, d.tolist())), F.array(*map(F.lit, turn.ravel().tolist())))).first()[0]
    assert np.allclose(got, want)
    assert not molecules.principal_axes(np.zeros((0, 3))).any() and molecules.principal_axes(np.ones((1, 3))).tolist() == [1.0] * 3 + [0.0] * 9


def test_alignment_reaches_the_least_rmsd(spark):
    ref = RNG.random((5, 3))
    rows = [(k, RNG.random((5, 3)).tolist()) for k in range(4)]
    points = spark.createDataFrame(rows, "id int, xyz array<array<double>>")
    least = {r.id: r.rmsd for r in linalg.kabsch(points, ref.tolist()).collect()}
    for r in molecules.aligned(points, ref.tolist()).collect():
        gap = np.array(r.xyz) - (ref - ref.mean(0))
        assert np.sqrt((gap**2).sum(1).mean()) == pytest.approx(least[r.id])


def test_components_against_numpy(spark):
    x = RNG.random((50, 3)) @ np.diag([3.0, 2, 1])
    data = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, v array<double>")
    got = molecules.principal_components(data, 2).orderBy("component").collect()
    values, axes = np.linalg.eigh(np.cov(x.T))
    assert [r.value for r in got] == pytest.approx(values[::-1][:2].tolist())
    assert all(abs(np.dot(r.v, axes[:, 2 - k])) == pytest.approx(1.0) for k, r in enumerate(got))
