"""Series that lie in several blocks give what one ordered pass gives."""

import random

import pytest

from lattix.operators import clusters, project
from lattix.plans import tables


@pytest.fixture
def walk(spark):
    random.seed(2)
    rows = [(k if k is None else "one" if k < 250 else f"u{k % 3}", t, random.randrange(4), random.randrange(5)) for t in range(400) for k in [random.choice([None, *range(300)])]]
    return [(k, t, i, j, 5 * i + j) for k, t, i, j in rows], spark.createDataFrame([(k, t, i, j, 5 * i + j) for k, t, i, j in rows], "key string, t int, i int, j int, nid int").repartition(7)


def series(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_blocks_are_many(spark, walk):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, df = walk
        placed = tables.in_blocks(df, ["key"], ["t"])
        assert placed.where("key = 'one'").select(tables.BLOCK).distinct().count() > 2
        moves, visits = {}, {}
        for key, s in series(rows).items():
            for n, (x, y) in enumerate(zip(s, s[1:]), 1):
                moves[x[4], y[4]] = moves.get((x[4], y[4]), 0) + 1
                visits[key, x[4]] = n
        assert {(r.src, r.dst): r.n for r in project.transitions(df, ["key"], ["t"]).collect()} == moves
        assert {(r.key, r.nid): r.last for r in project.last_visits(df, ["key"], ["t"]).collect()} == visits
        errors = df.selectExpr("key", "t", "cast(nid * 7 % 11 as double) as qe")
        got = {(r.key, r.t): (r.rho, r.epsilon) for r in clusters.convergence(errors, by="key").collect()}
        for key, s in series(rows).items():
            top = 0.0
            for x in s:
                e = float(x[4] * 7 % 11)
                top = max(top, e)
                assert got[key, x[1]] == (top, e / top if top else None)
        flow = {r.nid: (r.di, r.dj, r.moves) for r in project.flow(df, ["key"], ["t"], 4, 5, inward=True).collect()}
        want = {}
        near = lambda d, n: d - n if 2 * d > n else d + n if 2 * d < -n else d
        for s in series(rows).values():
            for x, y in zip(s, s[1:]):
                a, b = near(y[2] - x[2], 4), near(y[3] - x[3], 5)
                if a or b:
                    u, v, n = want.get(y[4], (0, 0, 0))
                    size = (a * a + b * b) ** 0.5
                    want[y[4]] = (u - a / size, v - b / size, n + 1)
        assert flow.keys() == want.keys() and all(flow[k] == pytest.approx(want[k]) for k in want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
