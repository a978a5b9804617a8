"""Selections, residue descriptors, orders of matrices, and streams that compose and restart."""

import math

import numpy as np
from pyspark.sql import functions as F

from lattix.functions import geometry as g
from lattix.operators import bmu, codebook, molecules, selections
from lattix.sources import text
from lattix.streaming import scoring

ATOMS = "path string, index int, count int, atomname string, resname string, chain string, resid smallint, segid string"


def atoms(spark):
    rows = [("p", k + 1, k, ["N", "CA", "C"][k % 3], ["ALA", "LYS", "GLY"][k // 3 % 3], "A" if k < 12 else None, k // 3 + 1, "S1") for k in range(18)]
    return rows, spark.createDataFrame([*rows, ("q", 1, 0, "CA", "ALA", "A", 1, "S2")], ATOMS)


def test_selections(spark):
    rows, df = atoms(spark)
    both = selections.chosen(df.where("path = 'p'"), {"atomname": ["CA"], "resid": [1, 4]})
    assert sorted(r["count"] for r in both.collect()) == [r[2] for r in rows if r[3] == "CA" or r[6] in (1, 4)]
    assert selections.chosen(df, {}).count() == 19 and selections.chosen(df, {"chain": ["A", "B"]}).count() == 13
    picked = spark.createDataFrame([("p", 4), ("p", 13)], "path string, count int")
    assert sorted(r["count"] for r in selections.same_as(df, picked, "resname").collect()) == [r[2] for r in rows if r[4] == "LYS"]
    assert sorted(r["count"] for r in selections.same_as(df, picked.where("count = 13"), "chain").collect()) == list(range(12, 18))
    pairs = [tuple(r)[1:] for r in selections.residue_pairs(df).collect()]
    assert sorted(pairs) == [(a, "S1", b, "S1") for a in range(2, 6) for b in range(a + 1, 6)]


def test_pocket_of_a_molecule(spark, tmp_path):
    lines = ["@<TRIPOS>MOLECULE", "m1", "@<TRIPOS>ATOM", *(f"{k + 1} {['CA', 'CB', 'N'][k % 3]} {k}.0 0.5 1.0 C.3 {k // 3 + 1} {['ALA', 'LYS'][k // 3]}{k // 3 + 7} 0.25" for k in range(6)), "@<TRIPOS>BOND"]
    (tmp_path / "m1.mol2").write_text("\n".join(lines))
    read = text.read_mol2(spark, str(tmp_path / "m1.mol2"))
    motif = spark.createDataFrame([("m1", "LYS", 8, "CA"), ("m1", "LYS", 8, "CA"), ("m1", "ALA", 7, "N"), ("m2", "ALA", 7, "CB")], "mol string, resname string, resid int, atomname string")
    found = selections.pocket(read, motif)
    assert [(r.atom_id, r.atom_name, r.residue, r.x) for r in found.orderBy("atom_id").collect()] == [(1, "N", "ALA7", 2.0), (2, "CA", "LYS8", 3.0)]
    text.write_structures(text.mol2_lines(found), f"{tmp_path}/out")
    again = text.read_mol2(spark, f"{tmp_path}/out/key=m1")
    assert sorted(tuple(r)[1:] for r in again.collect()) == sorted(tuple(r)[1:] for r in found.select(again.columns).collect())


def test_residue_descriptors(spark):
    rng = np.random.default_rng(0)
    kinds = ["LYS", "ASP", "SER", "PHE", "HOH", "ARG", "LYS"]
    xyz = rng.normal(size=(7, 3))
    df = spark.createDataFrame([("m", k, *map(float, xyz[k]), kinds[k]) for k in range(7)], "mol string, atom_id int, x double, y double, z double, res_type string")
    v = np.array(molecules.residue_descriptors(df).first().v)
    for at, some in ((0, range(7)), (12, [0, 5, 6]), (24, [1]), (36, [2]), (48, [3])):
        assert np.allclose(v[at : at + 12], molecules.principal_axes(xyz[list(some)]))


def test_rotation_between_vectors(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(rng.normal(size=3).tolist(), rng.normal(size=3).tolist()) for _ in range(30)] + [([1.0, 2.0, 3.0], [2.0, 4.0, 6.0])], "a array<double>, b array<double>")
    rows = df.select("a", "b", g.rotation_between(F.col("a"), F.col("b")).alias("r")).collect()
    assert rows[-1].r is None
    for row in rows[:-1]:
        a, b, (turn, *axis) = np.array(row.a), np.array(row.b), row.r
        k = np.array(axis)
        moved = a * math.cos(turn) + np.cross(k, a) * math.sin(turn) + k * (k @ a) * (1 - math.cos(turn))
        assert np.allclose(moved / np.linalg.norm(a), b / np.linalg.norm(b)) and math.isclose(k @ k, 1)


def test_orders_of_matrices(spark):
    rng = np.random.default_rng(2)
    m, label = rng.random((12, 12)), [3, 1, 2, 1]
    matrix = spark.createDataFrame([(r, c, float(m[r, c])) for r in range(12) for c in range(12)], "r int, c int, val double")
    labels = spark.createDataFrame(list(enumerate(label)), "item int, label int")
    order = np.argsort(label, kind="stable")
    dense = lambda df, n: np.array([x for _, _, x in sorted(map(tuple, df.collect()))]).reshape(n, n)
    at = (3 * order[:, None] + np.arange(3)).ravel()
    assert np.array_equal(dense(selections.sorted_matrix(matrix, labels, 3), 12), m[np.ix_(at, at)])
    assert np.array_equal(dense(selections.sorted_matrix(matrix.where("r < 4 and c < 4"), labels), 4), m[:4, :4][np.ix_(order, order)])
    pairs = {(r.r, r.c): r.val for r in selections.co_clustered(labels).collect()}
    assert pairs == {(a, b): label[a] for a in range(4) for b in range(4) if label[a] == label[b]}
    book = spark.createDataFrame([(k, 0, k, m[3 * k].tolist()) for k in range(4)], "nid int, i int, j int, w array<double>")
    near = ((m[:, None] - m[None, ::3]) ** 2).sum(2).argmin(1)
    assert np.array_equal(dense(selections.rows_by_neuron(matrix, book), 12), m[3 * near])


def test_a_scored_stream_is_counted_by_window_and_a_trainer_goes_on(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    data = codebook.vectors(table).withColumn("ts", F.timestamp_seconds(F.col("id") * 60))
    book = codebook.from_rows(table, 4, 4)
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    hits = scoring.windowed_hits(scoring.score(stream, book), late="1000 hours")
    hits.writeStream.trigger(availableNow=True).outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).format("memory").queryName("hit_windows").start().awaitTermination()
    want = bmu.assign(data, book).groupBy(F.window("ts", "1 hour").start.alias("start"), "nid").agg(F.count("*").alias("hits"))
    assert sorted(map(tuple, spark.table("hit_windows").select("start", "nid", "hits").collect())) == sorted(map(tuple, want.collect()))
    saved, plain = str(tmp_path / "map"), stream.select("id", "v")
    on_batch, current = scoring.mini_batch_trainer(book, 4, 4, 1.0, path=saved)
    learnt = []
    plain.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).foreachBatch(lambda b, n: (learnt.append(n), on_batch(b, n))[0]).start().awaitTermination()
    after, again = scoring.mini_batch_trainer(book, 4, 4, 1.0, path=saved)
    weights = lambda df: {r.nid: r.w for r in df.collect()}
    assert len(learnt) == 3 and weights(again()) == weights(current())
    after(codebook.vectors(table), 2)  # the last batch, sent again
    assert weights(again()) == weights(current())
    after(codebook.vectors(table), 3)
    assert weights(again()) != weights(current())
