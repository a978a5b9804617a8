import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.functions import geometry as g
from lattix.functions import transforms as t
from lattix.operators import clusters, codebook, graphs, train
from lattix.sources import dcd, text
from lattix.streaming import scoring

PDB = [
    "ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  2.50      PRO1",
    "HETATM    2  CA  ALA A   1      11.639   6.071  -5.147  1.00  0.00      PRO1",
    "END",
    "ATOM      3  C   ALA A   2       1.000   2.000   3.000  1.00  0.00      PRO1",
]


def test_pdb_round_trip(spark, tmp_path):
    (tmp_path / "a.pdb").write_text("\n".join(PDB))
    atoms = text.read_pdb(spark, str(tmp_path / "a.pdb"))
    rows = atoms.orderBy("count").collect()
    assert [(r["index"], r["count"], r.atomname, r.resid, r.segid) for r in rows] == [(1, 0, "N", 1, "PRO1"), (2, 1, "CA", 1, "PRO1")]
    text.write_pdb(atoms, str(tmp_path / "out"))
    again = text.read_pdb(spark, str(tmp_path / "out")).orderBy("count").collect()
    assert [r[1:] for r in again] == [r[1:] for r in rows]


def test_matrix_restraints_and_sections(spark, tmp_path):
    (tmp_path / "m").write_text("1 2.5\n\n 3 4\n")
    assert sorted(map(tuple, text.read_matrix(spark, str(tmp_path / "m")).collect())) == [(0, 0, 1.0), (0, 1, 2.5), (1, 0, 3.0), (1, 1, 4.0)]
    (tmp_path / "r").write_text("1 A 20 B\n")
    assert tuple(text.read_restraints(spark, str(tmp_path / "r")).first()) == (1, "A", 20, "B")
    (tmp_path / "s").write_text("<K>\none\n# no\n<K>\n<U>\ntwo\n<U>\n")
    found = text.sections(text.numbered(spark, str(tmp_path / "s")), ["K", "U"])
    assert sorted(map(tuple, found.collect())) == [("one", "K"), ("two", "U")]


def test_mol2(spark, tmp_path):
    (tmp_path / "x.mol2").write_text("@<TRIPOS>MOLECULE\nlig\n@<TRIPOS>ATOM\n1 C1 0.0 1.0 2.0 C.3 1 ALA1 0.5\n2 C2 nan 1.0 2.0 C.3 1 ALA1 0.5\n@<TRIPOS>BOND\n1 1 2 1\n")
    rows = text.read_mol2(spark, str(tmp_path / "x.mol2")).collect()
    assert [(r.mol, r.atom_id, r.x, r.res_type, r.charge) for r in rows] == [("lig", 1, 0.0, "ALA", 0.5)]


def test_dcd_round_trip(spark, tmp_path):
    frames = [np.arange(6) + k for k in range(3)]
    df = spark.createDataFrame([(0, k, [float(x) for x in v]) for k, v in enumerate(frames)], "part long, frame long, v array<double>")
    (tmp_path / "a.dcd").write_bytes(bytes(dcd.dcd_files(df).first().content))
    got = dcd.read_dcd(spark, str(tmp_path / "a.dcd")).orderBy("frame").collect()
    assert [r.v for r in got] == [v.tolist() for v in frames] and got[0].box is None
    assert dcd.read_dcd(spark, str(tmp_path / "a.dcd"), atoms=[1]).where("frame = 0").first().v == [3.0, 4.0, 5.0]


def value(spark, column):
    return spark.range(1).select(F.lit(1.0).alias("one")).select(column).first()[0]


def test_transform_values(spark):
    q = g.quaternion_multiply(g.vec(4, 1, -2, 3), g.vec(8, -5, 6, 7))
    assert value(spark, q) == [28.0, -44.0, -14.0, 48.0]
    assert value(spark, F.aggregate(t.orthogonalization(g.vec(10, 10, 10), g.vec(90, 90, 90)), F.lit(0.0), lambda s, x: s + x)) == pytest.approx(31.0)
    m = F.array(*map(F.lit, np.linalg.inv(np.diag([1.0, 2, 4, 1])).ravel().tolist()))
    assert np.allclose(value(spark, t.inverse(m)), np.diag([1.0, 2, 4, 1]).ravel())
    r = spark.range(1).select(F.explode(F.array(g.rotation(F.lit(0.5), g.vec(0, 0, 1)))).alias("m"))
    assert np.allclose(np.abs(r.select(t.rotation_from(F.col("m"))).first()[0]), [0.5, 0, 0, 1])
    assert np.allclose(r.select(t.quaternion_from(F.col("m"))).first()[0], [np.cos(0.25), 0, 0, np.sin(0.25)])
    assert value(spark, t.is_same(g.identity(), g.identity())) is True
    assert np.allclose(value(spark, t.quaternion_from_euler(F.lit(0.0), F.lit(0.0), F.lit(0.5))), [np.cos(0.25), 0, 0, np.sin(0.25)])
    move = value(spark, t.superimposition(g.vec(0, 0, 0, 1, 0, 0, 0, 1, 0), g.vec(1, 1, 1, 2, 1, 1, 1, 2, 1)))
    assert np.allclose(move, [1, 0, 0, 1, 0, 1, 0, 1, 0, 0, 1, 1, 0, 0, 0, 1])


def test_watershed_and_paths():
    field = np.array([[0.0, 5, 5, 5], [5, 5, 5, 5], [5, 5, 1, 5], [5, 5, 5, 5]])
    labels = graphs.watershed(field)
    assert labels.min() == 1 and labels[0, 0] != labels[2, 2] and len(np.unique(labels)) == 2
    path = graphs.least_path(field, 0, 10)
    assert path[0] == 0 and path[-1] == 10
    assert clusters.average_linkage(np.array([[0, 1.0, 4], [1, 0, 6], [4, 6, 0]])) == [(0, 1, 1.0, 2), (2, 3, 5.0, 3)]


def test_stream_scores_and_trains(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    data, book = codebook.vectors(table), codebook.from_rows(table, 4, 4)
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    on_batch, current = scoring.mini_batch_trainer(book, 4, 4, 1.0)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).foreachBatch(on_batch).start().awaitTermination()
    step = {r.nid: r.w for r in train.batch_step(data, book, 4, 4, 1.0).collect()}
    start = {r.nid: r.w for r in book.collect()}
    assert all(np.allclose(r.w, (np.array(start[r.nid]) + step[r.nid]) / 2) for r in current().collect())
    scoring.score(stream, book).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).format("memory").queryName("scored").start().awaitTermination()
    assert spark.table("scored").count() == data.count()
