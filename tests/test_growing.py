"""The growing map against a plain loop over its cells."""

import math
import time

import numpy as np
import pytest

from lattix.operators import train


def plain(x, side=3, threshold=1.0, rounds=2, seed=0):
    rng = np.random.default_rng(seed)
    cells = {(i, j): x[rng.integers(len(x))].astype(float) for i in range(side) for j in range(side)}
    limit, steps = threshold * float(np.linalg.norm(x - x.mean(0), axis=1).mean()), rounds * len(x)
    for t in range(steps):
        v, keys = x[t % len(x)], list(cells)
        d = np.sqrt(((np.array([cells[k] for k in keys]) - v) ** 2).sum(1))
        b = keys[int(d.argmin())]
        r, a = train.decay(1.5, 1.0, t, steps), train.decay(0.5, 0.0, t, steps)
        for k in keys:
            h = a * math.exp(-((k[0] - b[0]) ** 2 + (k[1] - b[1]) ** 2) / (2 * r) ** 2)
            if h > 1e-4:
                cells[k] -= h * (cells[k] - v)
        free = [c for c in ((b[0] + 1, b[1]), (b[0] - 1, b[1]), (b[0], b[1] + 1), (b[0], b[1] - 1)) if c not in cells]
        if d.min() > limit and len(cells) < len(x) and free:
            cells[free[0]] = cells[b] + (v - cells[b]) / 2
    return [(i, j, w) for (i, j), w in sorted(cells.items())]


def alike(a, b):
    return [c[:2] for c in a] == [c[:2] for c in b] and np.allclose([c[2] for c in a], [c[2] for c in b], rtol=0, atol=1e-12, equal_nan=True)


RNG = np.random.default_rng(4)
INPUTS = {
    "normal": (RNG.normal(size=(600, 8)), 1.0),
    "ties": (RNG.integers(0, 3, (500, 3)).astype(float), 0.3),
    "far from zero": (1e8 + RNG.normal(size=(300, 6)), 0.5),
    "all the same": (np.ones((30, 3)), 1.0),
    "one": (np.ones((1, 3)), 1.0),
    "undefined": (np.where(RNG.random((40, 3)) < 0.05, np.nan, RNG.normal(size=(40, 3))), 1.0),
}


@pytest.mark.parametrize("name", INPUTS)
def test_same_as_the_plain_loop(name):
    x, threshold = INPUTS[name]
    assert alike(train.growing(x, threshold=threshold), plain(x, threshold=threshold))


def test_a_step_does_not_visit_every_cell():
    x = np.random.default_rng(5).normal(size=(1500, 5))
    start = time.process_time()
    found = train.growing(x, threshold=0.2)
    middle = time.process_time()
    want = plain(x, threshold=0.2)
    assert len(found) > 500 and alike(found, want)
    assert middle - start < (time.process_time() - middle) / 2


def test_query_is_ordered_by_id_and_takes_empty_tables(spark):
    x = np.random.default_rng(6).normal(size=(200, 4))
    ids = np.random.default_rng(7).permutation(200)
    data = spark.createDataFrame([(int(k), x[k].tolist()) for k in ids], "id long, v array<double>").repartition(5)
    assert alike(sorted((r.i, r.j, np.array(r.w)) for r in train.train_growing(data).collect()), plain(x))
    assert train.train_growing(data.where("false")).collect() == []
