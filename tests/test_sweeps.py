"""Sweeps of thresholds against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from lattix.operators import graphs, project

ROWS, COLS = 5, 6


def groups_below(values, cut):
    """Labels from 1 by mean value of the toric 4-connected groups below ``cut``."""
    low, seen, found = {n for n, v in values.items() if v is not None and v < cut}, set(), []
    for n in sorted(low):
        if n in seen:
            continue
        stack, group = [n], set()
        while stack:
            c = stack.pop()
            if c in group:
                continue
            group.add(c)
            i, j = divmod(c, COLS)
            stack += [m for m in ((i + 1) % ROWS * COLS + j, (i - 1) % ROWS * COLS + j, i * COLS + (j + 1) % COLS, i * COLS + (j - 1) % COLS) if m in low]
        seen |= group
        found.append(group)
    found.sort(key=lambda g: (sum(values[n] for n in g) / len(g), min(g)))
    return {n: k for k, g in enumerate(found, 1) for n in g}


def field(spark, values):
    return spark.createDataFrame([(n, *divmod(n, COLS), v) for n, v in values.items()], "nid int, i int, j int, val double")


def test_sweep_visits_every_grouping(spark):
    rng = np.random.default_rng(8)
    values = {n: float(v) for n, v in enumerate(rng.integers(0, 12, ROWS * COLS))}  # with ties
    values[7] = None
    want = {(step, cut, n, k) for step, cut in enumerate(sorted({v for v in values.values() if v is not None}), 1) for n, k in groups_below(values, cut).items()}
    assert {tuple(r) for r in graphs.threshold_sweep(field(spark, values), ROWS, COLS).select("step", "cut", "nid", "label").collect()} == want


def test_sweep_of_flat_and_empty_fields_is_empty(spark):
    assert graphs.threshold_sweep(field(spark, {0: 1.0, 1: 1.0}), ROWS, COLS).count() == 0
    assert graphs.threshold_sweep(field(spark, {}), ROWS, COLS).count() == 0


def test_best_cut(spark):
    rng = np.random.default_rng(9)
    values = {n: float(v) for n, v in enumerate(rng.permutation(ROWS * COLS))}
    hits = [(int(n), bool(rng.random() < (0.8 if values[int(n)] < 12 else 0.1))) for n in rng.integers(0, ROWS * COLS, 400)]
    k, u = sum(a for _, a in hits), sum(not a for _, a in hits)
    want = {}
    for step, cut in enumerate(sorted(values.values()), 1):
        labels = groups_below(values, cut)
        for label in set(labels.values()):
            se = sum(a for n, a in hits if labels.get(n) == label) / k
            sp = 1 - sum(not a for n, a in hits if labels.get(n) == label) / u
            want[step] = min(want.get(step, (9.0,)), (float(np.hypot(1 - sp, 1 - se)), label))
    sweep = graphs.threshold_sweep(field(spark, values), ROWS, COLS)
    steps = project.roc_sweep(spark.createDataFrame(hits, "nid int, active boolean"), sweep, F.col("active"))
    got = {r.step: (r.gamma, r.label) for r in steps.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[s][0] - want[s][0]) < 1e-9 and got[s][1] == want[s][1] for s in want)
    best = project.roc_best(steps).collect()
    assert len(best) == 1 and abs(best[0].gamma - min(want.values())[0]) < 1e-9
    assert project.roc_best(steps.where("false")).count() == 0
