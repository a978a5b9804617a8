"""Unfolded clusters, contrasts and structure files against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.operators import contrasts, unfold
from lattix.sources import text


def layout(label, rows, cols):
    """By walking from each piece's least cell: one place of each cell, and whether some step disagrees."""
    place, piece, torn = {}, {}, {}
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    for start in sorted(label):
        if start in place:
            continue
        place[start], piece[start], torn[start], todo = divmod(start, cols), start, False, [start]
        while todo:
            n = todo.pop(0)
            for a, b in around:
                m = (n // cols + a) % rows * cols + (n % cols + b) % cols
                if m == n or label.get(m) != label[n]:
                    continue
                at = place[n][0] + a, place[n][1] + b
                if m not in place:
                    place[m], piece[m] = at, start
                    todo.append(m)
                elif place[m] != at:
                    torn[start] = True
    return place, piece, torn


@pytest.mark.parametrize("rows, cols, kinds, seed", [(6, 7, 4, 0), (9, 8, 5, 1), (12, 12, 6, 2)])
def test_unfolded_pieces(spark, rows, cols, kinds, seed):
    rng = random.Random(seed)
    label = {n: rng.randrange(kinds) for n in range(rows * cols)}
    for a in (-1, 0):  # a block across both seams, alone
        for b in (-1, 0):
            label[(a % rows) * cols + b % cols] = 99
    live = {n: k for n, k in label.items() if k}
    place, piece, torn = layout(live, rows, cols)
    got = unfold.unfolded(spark.createDataFrame(list(label.items()), "nid int, label int"), rows, cols).collect()
    assert {r.nid: r.piece for r in got} == piece and all(r.wraps == torn[r.piece] for r in got)
    for r in got:
        assert r.u % rows == r.nid // cols and r.v % cols == r.nid % cols
        assert torn[r.piece] or (r.u, r.v) == place[r.nid]
    block = [r for r in got if r.label == 99]
    assert max(r.u for r in block) - min(r.u for r in block) == 1 == max(r.v for r in block) - min(r.v for r in block)


def test_a_ring_wraps_and_inputs_follow(spark):
    label = {n: int(n // 5 == 1) for n in range(20)}
    places = unfold.unfolded(spark.createDataFrame(list(label.items()), "nid int, label int"), 4, 5)
    assert [r.wraps for r in places.collect()] == [True] * 5
    bmus = spark.createDataFrame([(1, 6), (2, 6), (3, 0)], "id long, nid int")
    assert sorted(r.id for r in unfold.unfolded_inputs(bmus, places).collect()) == [1, 2]
    assert unfold.unfolded(places.select("nid", "label").limit(0), 4, 5).count() == 0


def test_contrasts_of_clusters(spark):
    rng = np.random.default_rng(0)
    cov = rng.random((15, 15)) + 1
    label = [2, 2, 5, 5, 9]
    matrix = spark.createDataFrame([(r, c, float(cov[r, c])) for r in range(15) for c in range(15)], "r int, c int, val double")
    labels = spark.createDataFrame(list(enumerate(label)), "atom int, label int")
    spread = np.sqrt(cov.diagonal().reshape(5, 3).mean(1))
    spread /= spread.max()
    got = {(r.one, r.two, r.atom): r.val for r in contrasts.contrasts(labels, contrasts.atom_spread(matrix)).collect()}
    want = {(a, b, k): spread[k] * ((x == a) - (x == b)) for a in (2, 5, 9) for b in (2, 5, 9) if a < b for k, x in enumerate(label) if x in (a, b)}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    moved = {(r.one, r.two, r.atom, r.axis): r.val for r in contrasts.displacements(labels, matrix).collect()}
    assert len(moved) == 3 * len(want) and all(np.isclose(x, np.sqrt(cov[3 * k[2] + k[3], 3 * k[2] + k[3]])) for k, x in moved.items())
    blocks = {(r.r, r.c): r.v for r in contrasts.block_rows(matrix).collect()}
    assert len(blocks) == 25 and np.array_equal(np.array(blocks[1, 4]).reshape(3, 3), cov[3:6, 12:15])
    assert {r.id: r.v for r in contrasts.row_vectors(matrix).collect()} == {k: x.tolist() for k, x in enumerate(cov)}


def test_a_hundred_structures_at_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(m, k + 1, k, ["N", "CA", "HG11"][k % 3], "ALA", "A", k // 3 + 1, [round(float(x), 3) for x in rng.normal(size=3)], 1.5, "PRO1") for m in range(100) for k in range(int(rng.integers(1, 12)))]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    atoms = spark.createDataFrame(rows, "mol long, index int, count int, atomname string, resname string, chain string, resid smallint, coord array<float>, beta float, segid string")
    bonds = spark.createDataFrame([(0, 1, b) for b in range(2, 8)], "mol long, a int, b int")
    text.write_structures(text.structure_lines(atoms, "mol", bonds=bonds), f"{tmp_path}/s")
    back = text.read_pdb(spark, f"{tmp_path}/s/key=*").withColumn("mol", F.regexp_extract("path", r"key=(\d+)", 1).cast("long"))
    want = sorted((r[0], r[2], r[1], *r[3:7], np.array(r[7], "f4").tolist(), *r[8:]) for r in rows)
    assert sorted(tuple(r) for r in back.select("mol", "count", "index", "atomname", "resname", "chain", "resid", "coord", "beta", "segid").collect()) == want
    lines = [r.value for r in spark.read.text(f"{tmp_path}/s/key=0").collect()]
    assert lines[-1] == "END" and [x for x in lines if x.startswith("CONECT")][:2] == ["CONECT    1    2    3    4    5", "CONECT    1    6    7"]
    # Frames of a cluster as models of one file, in order.
    text.write_structures(text.structure_lines(atoms.withColumn("cluster", F.lit(7)), "cluster", model="mol"), f"{tmp_path}/c")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/c/key=7").collect()]
    assert [x for x in lines if x.startswith("MODEL")] == [f"MODEL {m + 1:8d}" for m in range(100)] and lines.count("ENDMDL") == 100
