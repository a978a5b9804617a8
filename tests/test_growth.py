"""Separation along merges, growing graphs and the rest of this family against brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from lattix.operators import networks, separations
from lattix.operators.clusters import separation


def book(spark, w, rows, cols):
    return spark.createDataFrame([(k, k // cols, k % cols, list(map(float, x))) for k, x in enumerate(w)], "nid int, i int, j int, w array<double>")


def brute_sweep(w, rows, cols):
    n = rows * cols
    d = np.sqrt(((w[:, None] - w[None]) ** 2).sum(2))
    near = {(a, b): d[a, b] for a in range(n) for b in (a + 1, a + cols) if (b == a + 1 and (a + 1) % cols) or (b == a + cols and b < n)}
    top, out, before = max(near.values()), [], (0.0, 0.0, 0)
    for cut in np.unique(d / d.max()):
        label = list(range(n))
        for (a, b), x in near.items():
            if x / top <= cut:
                label = [min(label[a], label[b]) if y in (label[a], label[b]) else y for y in label]
        groups = [[k for k in range(n) if label[k] == c] for c in sorted(set(label))]
        m = len(groups)
        if m == before[2]:
            continue
        if m == 1:
            break
        loose = sum(len(g) * np.mean([d[a, b] for a, b in combinations(g, 2)]) for g in groups if len(g) > 1) / n
        far = sum(d[np.ix_(g, h)].mean() for g in groups for h in groups if g is not h) / m**2
        xi = m * loose / far
        out.append((cut, m, xi, (xi - before[1]) / (cut - before[0]) if cut > before[0] else None, label))
        before = (cut, xi, m)
    return out


@pytest.mark.parametrize("rows, cols, seed", [(4, 5, 0), (7, 6, 1), (1, 9, 2)])
def test_separation_of_every_threshold(spark, rows, cols, seed):
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(rows * cols, 3)) + 4 * (np.arange(rows * cols) % cols > cols // 2)[:, None]
    w[1] = w[0]  # two equal neighbours are one cluster from the start
    want = brute_sweep(w, rows, cols)
    sweep = separations.separation_sweep(book(spark, w, rows, cols), rows, cols)
    got = sweep.orderBy("step").collect()
    assert [(r.step, r.clusters) for r in got] == [(k + 1, x[1]) for k, x in enumerate(want)]
    for r, x in zip(got, want):
        assert math.isclose(r.cut, x[0], abs_tol=1e-12) and math.isclose(r.xi, x[2], rel_tol=1e-9, abs_tol=1e-12)
        assert (r.gradient is None) == (x[3] is None) and (x[3] is None or math.isclose(r.gradient, x[3], rel_tol=1e-8))
    best = separations.best_separation(sweep).collect()
    falls = [x for x in want if x[3] is not None and x[3] < 0]
    assert [r.clusters for r in best] == [min(reversed(falls), key=lambda x: x[3])[1]][: len(falls)]
    labels = spark.createDataFrame([(k, sorted(set(want[2][4])).index(c) + 1) for k, c in enumerate(want[2][4])], "nid int, label int")
    assert math.isclose(separation(book(spark, w, rows, cols), labels).first().val, got[2].xi, rel_tol=1e-9)


def brute_grown(g):
    """The rule as it is told, threshold by threshold."""
    everyone = set(g) | {b for near in g.values() for b in near}
    taken, before, low = {}, -1, -math.inf
    for t in sorted({w for near in g.values() for w in near.values()}):
        some = {}
        for a, near in g.items():
            for w, b in sorted((w, b) for b, w in near.items()):
                if not low <= w <= t:
                    break
                some[a, b] = w
        touched = {x for e in some for x in e}
        if len(touched) == before:
            low = t
        else:
            taken |= some
            before = len(touched)
        if len(touched) == len(everyone):
            break
    return taken


def brute_cleaned(g, taken):
    e = {}
    for (a, b), w in taken.items():
        e[a, b] = e[b, a] = w
    while True:
        pieces, left = [], {x for p in e for x in p}
        inside = set(left)
        while left:
            group, todo = set(), [min(left)]
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += [b for a, b in e if a == x]
            pieces.append(group)
            left -= group
        if len(pieces) < 2:
            break
        for p in pieces:
            w, a, b = min((g[x][y], min(x, y), max(x, y)) for x in p for y in inside - p)
            e[a, b] = e[b, a] = w
    for x in set(g) - inside:
        w, y = min((g[x][y], y) for y in inside)
        e[x, y] = e[y, x] = w
    return e


@pytest.mark.parametrize("kind", ["clustered", "uniform", "line", "ties"])
def test_growing_and_cleaned_graphs(spark, kind):
    random.seed(len(kind))
    if kind == "clustered":
        at = [(10 * (k % 4) + random.random(), 10 * (k // 4 % 2) + random.random()) for k in range(20)]
    elif kind == "line":
        at = [(1.3**k, 0.0) for k in range(12)]
    elif kind == "ties":
        at = [(k % 4, k // 4) for k in range(12)]
    else:
        at = [(random.random(), random.random()) for _ in range(16)]
    g = {a: {b: math.dist(at[a], at[b]) for b in range(len(at)) if b != a} for a in range(len(at))}
    edges = spark.createDataFrame([(a, b, w) for a, near in g.items() for b, w in near.items()], "src int, dst int, w double")
    taken = brute_grown(g)
    assert {(r.src, r.dst): r.w for r in networks.grown(edges).collect()} == taken
    assert {(r.src, r.dst): r.w for r in networks.cleaned(edges).collect()} == brute_cleaned(g, taken)
    assert kind not in ("clustered", "line") or len(taken) < networks.covering(edges).count()


def test_growing_graph_without_edges(spark):
    edges = spark.createDataFrame([], "src int, dst int, w double")
    assert networks.grown(edges).count() == 0 and networks.cleaned(edges).count() == 0


def brute_roc(w, rows, cols, hits, by_sensitivity):
    """``hits``: (k, u) of each neuron."""
    n = rows * cols
    near = {(a, b): math.dist(w[a], w[b]) for a in range(n) for b in (a + 1, a + cols) if (b == a + 1 and (a + 1) % cols) or (b == a + cols and b < n)}
    top, ks, us, out = max(near.values()), sum(h[0] for h in hits), sum(h[1] for h in hits), []
    for cut in [-1.0, *sorted(set(near.values()))]:
        label = list(range(n))
        for (a, b), x in near.items():
            if x <= cut:
                label = [min(label[a], label[b]) if y in (label[a], label[b]) else y for y in label]
        if out and label == out[-1][-1]:
            continue
        rated = []
        for c in set(label):
            k, u = (sum(hits[x][y] for x in range(n) if label[x] == c) for y in (0, 1))
            if k + u:
                se, sp = k / ks, 1 - u / us
                rated.append((se, sp, math.hypot(1 - sp, 1 - se), c))
        se, sp, gamma, c = min(rated, key=lambda x: (-x[0], x[2], x[3]) if by_sensitivity else (x[2], x[3]))
        out.append((max(cut, 0) / top, len(rated), c, [x for x in range(n) if label[x] == c], se, sp, gamma, label))
    return out


@pytest.mark.parametrize("by_sensitivity", [False, True])
def test_roc_of_every_clustering(spark, by_sensitivity):
    from pyspark.sql import functions as F

    from lattix.operators import retrain

    rng = np.random.default_rng(4)
    w = rng.integers(0, 6, size=(20, 2)).astype(float)  # equal borders are one step
    nid = rng.integers(0, 14, 90)
    kind = (rng.random(90) < 0.3).astype(int)
    bmus = spark.createDataFrame([(k, int(x), int(y)) for k, (x, y) in enumerate(zip(nid, kind))], "id long, nid int, kind int")
    hits = [(int(((nid == c) & (kind == 1)).sum()), int(((nid == c) & (kind == 0)).sum())) for c in range(20)]
    want = brute_roc(w, 4, 5, hits, by_sensitivity)
    steps = retrain.roc_merges(book(spark, w, 4, 5), 4, 5, bmus, F.col("kind") == 1, by_sensitivity)
    got = [tuple(r) for r in steps.orderBy("step").collect()]
    # A border of length 0 joins neurons before the first step.
    want = want if want[0][0] == 0 and len(want) == len(got) else want[1:]
    assert [(g[0], *g[2:5]) for g in got] == [(k, x[1], x[2], x[3]) for k, x in enumerate(want)]
    assert all(np.allclose([g[1], *g[5:]], [x[0], *x[4:7]]) for g, x in zip(got, want))
    best = retrain.best_step(steps, by_sensitivity).first()
    pick = min(range(len(want)), key=lambda k: (-want[k][4], want[k][6], k) if by_sensitivity else (want[k][6], k))
    assert best.step == pick


def test_narrowing_rounds(spark):
    from pyspark.sql import functions as F

    from lattix.operators import retrain

    rng = np.random.default_rng(2)
    actives = rng.normal(0, 0.2, (30, 4)) + [3, 0, 0, 0]
    others = np.concatenate([rng.normal(0, 0.2, (120, 4)) + [-3, 0, 0, 0], rng.normal(0, 0.2, (60, 4)) + [3, 1.5, 0, 0]])
    x = np.concatenate([actives, others])
    data = spark.createDataFrame([(k, v.tolist(), k < 30) for k, v in enumerate(x)], "id long, v array<double>, known boolean")
    learn = retrain.trainer(3, 4, [2.0, 1.0])
    rounds, members, maps = retrain.narrowed(data, F.col("known"), 3, 4, learn)
    rounds, kept = rounds.orderBy("round").collect(), {r.id for r in members.collect()}
    told, ids, before = [], list(range(len(x))), None
    for t in range(len(rounds)):
        w = np.array([r.w for r in maps.where(f"round = {t}").orderBy("nid").collect()])
        own = ((x[ids][:, None] - w[None]) ** 2).sum(2).argmin(1)
        hits = [(sum(1 for k, c in zip(ids, own) if c == n and k < 30), sum(1 for k, c in zip(ids, own) if c == n and k >= 30)) for n in range(12)]
        best = min(brute_roc(w, 3, 4, hits, True), key=lambda y: (-y[4], y[6]))
        inside = [k for k, c in zip(ids, own) if c in best[3]]
        told.append((len(ids), best[4], len(inside)))
        if best[4] != 1:
            break
        ids, stop, before = inside, len(inside) == before, len(inside)
        if stop:
            break
    assert [(r.n, r.se, r.held) for r in rounds] == told and kept == set(ids) and set(range(30)) <= kept and len(kept) < len(x)
    sizes, _ = retrain.learning_sizes(data, F.col("known"), 3, 4, learn, step=90)
    rows = sizes.orderBy("others").collect()
    assert [r.others for r in rows] == [0, 90] and sum(r.best for r in rows) == 1 == sum(r.most_sensitive for r in rows)
    assert min(r.gamma for r in rows) == next(r.gamma for r in rows if r.best)
