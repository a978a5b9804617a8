"""Text sources and sinks of molecules and matrices: fixed columns and white-space numbers as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Name, first column (from 1), width and type of an atom record.
ATOM = [("index", 7, 5, "int"), ("atomname", 13, 4, "string"), ("resname", 18, 3, "string"), ("chain", 22, 1, "string"), ("resid", 23, 4, "smallint"), ("x", 31, 8, "float"), ("y", 39, 8, "float"), ("z", 47, 8, "float"), ("beta", 61, 6, "float"), ("segid", 73, 4, "string")]


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``(path, at, value)``: the lines of each file in its order.

    Files are read whole, each by one task, since only a file's own text tells a line's number; a folder of many files
    is read in parallel.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    lines = whole.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "value"))
    return lines


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """``(path, index, count, atomname, resname, chain, resid, coord, beta, segid)`` of ATOM and HETATM records before END."""
    lines = numbered(spark, path)
    end = F.min(F.when(F.col("value").startswith("END"), F.col("at"))).over(Window.partitionBy("path"))
    rows = lines.withColumn("end", end).where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM")).where("end is null or at < end")
    cut = {n: F.trim(F.substring("value", a, w)) for n, a, w, _ in ATOM}
    got = rows.select("path", "at", *(F.nullif(cut[n], F.lit("")).cast(t).alias(n) for n, _, _, t in ATOM))
    count = (F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1).cast("int")
    return got.select("path", "index", count.alias("count"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("atomname", "resname", "chain")), "resid", F.array("x", "y", "z").alias("coord"), "beta", F.coalesce("segid", F.lit("")).alias("segid"))


def pdb_lines(atoms: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, count, value)``: the record of each atom."""
    name = F.when(F.length("atomname") < 4, F.concat(F.lit(" "), F.rpad("atomname", 3, " "))).otherwise(F.col("atomname"))
    text = F.format_string("ATOM  %5d %s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f      %-4s", "index", name, "resname", "chain", F.col("resid").cast("int"), *(F.col("coord")[k] for k in range(3)), F.lit(1.0), "beta", "segid")
    return atoms.select(*keep, "count", text.alias("value"))


def write_pdb(atoms: DataFrame, path: str) -> None:
    """One file below ``path`` with the atoms in order; a structure is some thousand rows."""
    pdb_lines(atoms).coalesce(1).sortWithinPartitions("count").select("value").write.text(path)


def structure_lines(atoms: DataFrame, key: str, model: str | None = None, bonds: DataFrame | None = None) -> DataFrame:
    """``(key, at, value)``: the lines of a structure of each ``key``: its atoms in order of ``count``, its ``bonds(key, a, b)`` of atom numbers, END.

    With ``model`` a key has a numbered model for each of its values, in their order, between MODEL and ENDMDL. Lines
    are rows with a place; no structure is gathered. An atom's bonds are told four a line, in order.
    """
    zero, parts = F.lit(0).cast("long"), []
    own = F.col(model).cast("long") if model else zero
    values = pdb_lines(atoms.withColumn("__place", F.struct(F.col(key).alias("key"), own.alias("model"))), "__place")
    parts.append(values.select("__place.key", F.struct(F.lit(0).alias("part"), F.col("__place.model").alias("model"), F.lit(1).alias("kind"), F.col("count").cast("long").alias("n")).alias("at"), "value"))
    if model:
        each = atoms.select(F.col(key).alias("key"), own.alias("model")).distinct()
        for kind, text in ((0, F.format_string("MODEL %8d", F.col("model") + 1)), (2, F.lit("ENDMDL"))):
            parts.append(each.select("key", F.struct(F.lit(0).alias("part"), "model", F.lit(kind).alias("kind"), zero.alias("n")).alias("at"), text.alias("value")))
    if bonds is not None:
        both = bonds.select(F.col(key).alias("key"), "a", "b").unionByName(bonds.select(F.col(key).alias("key"), F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        four = both.withColumn("nth", F.expr("(row_number() over (partition by key, a order by b) - 1) div 4")).groupBy("key", "a", "nth").agg(F.array_sort(F.collect_list("b")).alias("bs"))
        text = F.concat(F.format_string("CONECT%5d", "a"), F.array_join(F.transform("bs", lambda b: F.format_string("%5d", b)), ""))
        parts.append(four.select("key", F.struct(F.lit(1).alias("part"), F.col("a").cast("long").alias("model"), F.lit(0).alias("kind"), F.col("nth").cast("long").alias("n")).alias("at"), text.alias("value")))
    parts.append(atoms.select(F.col(key).alias("key")).distinct().select("key", F.struct(F.lit(2).alias("part"), zero.alias("model"), F.lit(0).alias("kind"), zero.alias("n")).alias("at"), F.lit("END").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_structures(lines: DataFrame, path: str) -> None:
    """A file of each key of ``structure_lines`` below ``path/key=...``, many at once: lines are shuffled by key and sorted
    within a task, which holds no structure; a key's lines stay in one file."""
    lines.repartition("key").sortWithinPartitions("key", "at").select("key", "value").write.partitionBy("key").text(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(r, c, val)`` of white-space numbers, one row of the matrix for each line; blank lines are skipped."""
    lines = numbered(spark, path).where(F.trim("value") != "")
    rows = lines.select((F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1).alias("r"), F.split(F.trim("value"), r"\s+").alias("x"))
    return rows.select("r", F.posexplode("x").alias("c", "val")).select("r", "c", F.col("val").cast("double").alias("val"))


def read_restraints(spark: SparkSession, path: str) -> DataFrame:
    """``(resid1, seg1, resid2, seg2)``."""
    x = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(x) >= 4).select(*(x[k].cast(t).alias(n) for k, (n, t) in enumerate((("resid1", "int"), ("seg1", "string"), ("resid2", "int"), ("seg2", "string")))))


def read_rms(spark: SparkSession, path: str) -> DataFrame:
    """``(atom, rmsx, rmsy, rmsz)`` after two header lines."""
    x = F.split(F.trim("value"), r"\s+")
    return numbered(spark, path).where("at >= 2").where(F.size(x) >= 4).select(x[0].cast("int").alias("atom"), *(x[k].cast("double").alias(f"rms{n}") for k, n in ((1, "x"), (2, "y"), (3, "z"))))


def read_mol2(spark: SparkSession, path: str) -> DataFrame:
    """``(path, mol, atom_id, atom_name, x, y, z, atom_type, res_id, res_type, charge, residue)`` of ATOM sections; rows without numbers are dropped.

    A line belongs to the last section mark before it, found by a running maximum within its file.
    """
    w = Window.partitionBy("path").orderBy("at")
    lines = numbered(spark, path)
    mark = F.when(F.col("value").startswith("@<TRIPOS>"), F.col("at"))
    lines = lines.withColumn("section", F.last(F.when(mark.isNotNull(), F.col("value")), True).over(w))
    rows = lines.withColumn("above", F.lag("value").over(w))
    rows = rows.withColumn("mol", F.last(F.when(F.trim("above") == "@<TRIPOS>MOLECULE", F.trim("value")), True).over(w))
    x = F.split(F.trim("value"), r"\s+")
    rows = rows.where((F.trim("section") == "@<TRIPOS>ATOM") & (F.col("value") != F.col("section"))).where(F.size(x) >= 9)
    num = lambda k: F.expr(f"try_cast(split(trim(value), '\\\\s+')[{k}] as double)")
    out = rows.select("path", "mol", x[0].try_cast("int").alias("atom_id"), x[1].alias("atom_name"), num(2).alias("x"), num(3).alias("y"), num(4).alias("z"), x[5].alias("atom_type"), x[6].try_cast("int").alias("res_id"), F.substring(x[7], 1, 3).alias("res_type"), num(8).alias("charge"), x[7].alias("residue"))
    return out.where("not (isnan(x) or isnan(y) or isnan(z)) and x is not null and y is not null and z is not null")


def write_points(field: DataFrame, path: str, spacing: float = 1.0) -> None:
    """The cells of ``field(x, y, z, val)`` that are not 0, as numbered text points."""
    text = F.format_string("C %.3f %.3f %.3f", *(F.col(k) * spacing for k in ("x", "y", "z")))
    field.where("val <> 0").coalesce(1).sortWithinPartitions("z", "y", "x").select(text.alias("value")).write.text(path)


def mol2_lines(atoms: DataFrame) -> DataFrame:
    """``(key, at, value)`` of ``read_mol2`` rows, for ``write_structures``: a MOLECULE and ATOM section of each molecule and an empty BOND section."""
    told = F.concat_ws("\t", *(F.col(c).cast("string") for c in ("atom_id", "atom_name", "x", "y", "z", "atom_type", "res_id", "residue", "charge")))
    head = atoms.select("mol").distinct().select("mol", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("n"), v.alias("value")) for k, v in enumerate((F.lit("@<TRIPOS>MOLECULE"), F.col("mol"), F.lit("@<TRIPOS>ATOM"), F.lit("@<TRIPOS>BOND")))))).alias("x"))
    rows = atoms.select("mol", F.struct(F.lit(1).alias("part"), F.col("atom_id").cast("long").alias("n")).alias("at"), told.alias("value"))
    edges = head.select("mol", F.struct(F.when(F.col("x.n") < 3, 0).otherwise(2).alias("part"), F.col("x.n").alias("n")).alias("at"), "x.value")
    return edges.unionByName(rows).withColumnRenamed("mol", "key")


def sections(lines: DataFrame, tags: list[str]) -> DataFrame:
    """``(name, kind)``: the lines between a tag and its next appearance, comments (#) and blanks left out."""
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    out: Column = F.lit(None).cast("string")
    for t in tags:
        seen = F.coalesce(F.sum((F.trim("value") == f"<{t}>").cast("int")).over(w), F.lit(0))
        out = F.when(seen % 2 == 1, F.lit(t)).otherwise(out)
    named = lines.withColumn("kind", out).where("kind is not null")
    return named.where(~F.trim("value").rlike("^(#.*|<.*>|)$")).select(F.trim("value").alias("name"), "kind")
