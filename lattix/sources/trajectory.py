"""Binary coordinate trajectories as a data source: read by ranges of frames, written as files that are committed together.

    spark.dataSource.register(TrajectorySource)
    frames = spark.read.format("trajectory").option("atoms", "0,1,5").load("/data/run*.dcd")
    in_order(frames, "frame").write.format("trajectory").mode("overwrite").save("/data/out")

Frames have a fixed size, so a file's frames are dealt to tasks by their bytes; a task seeks to its own. Paths are those
that ``pyarrow.fs`` opens: local or mounted folders, file://, hdfs://, s3://, gs://.
"""

from __future__ import annotations

import fnmatch
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lattix.sources.dcd import frame_bytes, header

#: Bytes of frames that a task reads, that it holds at once, and frames of a written file, if options don't say otherwise.
SPLIT_BYTES, HELD_BYTES, FILE_FRAMES = 64 << 20, 8 << 20, 4096
#: Bytes from which a header is read first; longer ones are read again.
HEAD = 1 << 12
_SCHEMA = "path string, frame long, v array<double>, box array<double>"
_NUMBERS = pa.list_(pa.float64())


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """``(path, bytes)`` of a file, of those below a folder, or of those that a pattern names in its folder; hidden ones are left out."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    folder, pattern = (inner, "*") if info.type == fs.FileType.Directory else (inner.rsplit("/", 1)[0], inner.rsplit("/", 1)[-1])
    found = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and f.base_name[0] not in "._" and fnmatch.fnmatch(f.base_name, pattern)]
    if not found:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((prefix + f.path, f.size) for f in found)


def _header(path: str) -> dict:
    system, inner = _opened(path)
    with system.open_input_file(inner) as f:
        for size in (HEAD, 1 << 20):
            try:
                return header(f.read_at(min(size, f.size()), 0))
            except struct.error:
                if size >= f.size():
                    raise ValueError(f"{path} is not a coordinate trajectory") from None
    raise ValueError(f"{path} has a header of over a megabyte")


@dataclass
class Frames(InputPartition):
    path: str
    first: int
    count: int
    head: dict


class TrajectoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.most = int(options["frames"]) if "frames" in options else None
        self.atoms = np.array([int(a) for a in options["atoms"].split(",")]) if options.get("atoms") else None

    def partitions(self) -> list[Frames]:
        out = []
        for path, size in _files(self.path):
            head = _header(path)
            each = frame_bytes(head)
            # The number of frames is that of the bytes, whatever the header says.
            count = (size - head["start"]) // each
            count = count if self.most is None else min(count, self.most)
            step = max(1, self.split // each)
            out += [Frames(path, at, min(step, count - at), head) for at in range(0, count, step)]
        return out or [Frames("", 0, 0, {})]

    def read(self, part: Frames) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        o, n, each = part.head["order"], part.head["atoms"], frame_bytes(part.head)
        cell, record = 56 * part.head["cell"], 4 * n + 8
        system, inner = _opened(part.path)
        step = max(1, HELD_BYTES // each)
        with system.open_input_file(inner) as f:
            for at in range(part.first, part.first + part.count, step):
                some = min(step, part.first + part.count - at)
                raw = np.frombuffer(f.read_at(some * each, part.head["start"] + at * each), np.uint8).reshape(some, each)
                axes = [np.ascontiguousarray(raw[:, cell + a * record + 4 : cell + a * record + 4 + 4 * n]).view(o + "f4") for a in range(3)]
                points = np.stack(axes, 2).astype(float)
                points = points if self.atoms is None else points[:, self.atoms]
                numbers = points.shape[1] * 3
                v = pa.ListArray.from_arrays(pa.array(np.arange(some + 1) * numbers, pa.int32()), pa.array(points.ravel()))
                box = pa.nulls(some, _NUMBERS)
                if cell:
                    box = pa.ListArray.from_arrays(pa.array(np.arange(some + 1) * 6, pa.int32()), pa.array(np.ascontiguousarray(raw[:, 4:52]).view(o + "f8").ravel().astype(float)))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * some), pa.array(np.arange(at, at + some)), v, box], ["path", "frame", "v", "box"])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def encoded(v: np.ndarray, box: np.ndarray | None, title: str = "written by lattix") -> bytes:
    """A whole little-endian file of frames ``v`` (frames, numbers) with unit cells ``box`` (frames, 6) or without."""
    mark = lambda size: np.frombuffer(struct.pack("<i", size), np.uint8)
    record = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    frames, n = len(v), v.shape[1] // 3
    # Frames, first step, interval, steps; whether there are cells; the version.
    numbers = [frames, 1, 1, frames] + [0] * 6 + [int(box is not None)] + [0] * 8 + [24]
    out = io.BytesIO()
    out.write(record(b"CORD" + struct.pack("<20i", *numbers)) + record(struct.pack("<i", 1) + title.encode()[:80].ljust(80)) + record(struct.pack("<i", n)))
    parts = [] if box is None else [np.broadcast_to(mark(48), (frames, 4)), box.astype("<f8").view(np.uint8).reshape(frames, 48), np.broadcast_to(mark(48), (frames, 4))]
    for a in range(3):
        axis = np.ascontiguousarray(v.reshape(frames, n, 3)[:, :, a], "<f4").view(np.uint8).reshape(frames, 4 * n)
        parts += [np.broadcast_to(mark(4 * n), (frames, 4)), axis, np.broadcast_to(mark(4 * n), (frames, 4))]
    out.write(np.concatenate(parts, 1).tobytes())
    return out.getvalue()


class TrajectoryWriter(DataSourceArrowWriter):
    """Each task writes files of some frames beside their place; the driver moves all there once every task has ended."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.frames, self.overwrite = options["path"].rstrip("/"), int(options.get("fileframes", FILE_FRAMES)), overwrite
        self.staged = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, staged = _opened(self.staged)
        system.create_dir(staged, recursive=True)
        task = TaskContext.get()
        names, v, box, held = [], [], [], 0

        def flush() -> None:
            nonlocal v, box, held
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(names):05d}.dcd"
            cells = None if any(b is None for b in box) else np.array(box, float)
            with system.open_output_stream(f"{staged}/{name}") as f:
                f.write(encoded(np.array(v, float), cells))
            names.append(name)
            v, box, held = [], [], 0

        for batch in batches:
            columns = batch.schema.names
            cells = batch.column(columns.index("box")).to_pylist() if "box" in columns else [None] * batch.num_rows
            for row, cell in zip(batch.column(columns.index("v")), cells):
                numbers = np.array(row.as_py(), float)
                if v and len(numbers) != len(v[0]):
                    flush()  # a file has one number of points
                v.append(numbers)
                box.append(cell)
                if (held := held + 1) >= self.frames:
                    flush()
        if v:
            flush()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, staged = _opened(self.staged)
        _, path = _opened(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.path.rsplit("/", 1)[-1] != staged.rsplit("/", 1)[-1]:
                    (system.delete_file if f.type == fs.FileType.File else system.delete_dir)(f.path)
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{staged}/{name}", f"{path}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, staged = _opened(self.staged)
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


class TrajectorySource(DataSource):
    """Options: ``atoms`` (places from 0, by commas), ``frames`` (of each file at most), ``splitBytes`` of a task; ``fileFrames`` of a written file.

    Reads ``(path, frame, v, box)``; ``frame`` counts from 0 in its file, ``box`` is null in files without unit cells.
    Writes ``v`` and, if each row of a file has one, ``box``; rows are written in the order they come in.
    """

    @classmethod
    def name(cls) -> str:
        return "trajectory"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> TrajectoryReader:
        return TrajectoryReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> TrajectoryWriter:
        return TrajectoryWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def in_order(frames: DataFrame, *by: str) -> DataFrame:
    """``frames(v, box)`` sorted over all partitions, so that the names of the files that are written put them in order."""
    return frames.orderBy(*by).select("v", *(c for c in ("box",) if c in frames.columns))


def read_trajectory(spark, path: str, atoms: list[int] | None = None, frames: int | None = None) -> DataFrame:
    spark.dataSource.register(TrajectorySource)
    reader = spark.read.format("trajectory")
    if atoms is not None:
        reader = reader.option("atoms", ",".join(map(str, atoms)))
    return (reader if frames is None else reader.option("frames", str(frames))).load(path)


def write_trajectory(frames: DataFrame, path: str, *by: str, file_frames: int = FILE_FRAMES) -> None:
    """Files below ``path`` in the order of ``by``, which replace what is there."""
    frames.sparkSession.dataSource.register(TrajectorySource)
    in_order(frames, *by).write.format("trajectory").mode("overwrite").option("fileFrames", str(file_frames)).save(path)


def frame_id(frames: DataFrame) -> DataFrame:
    """``frames`` with ``id``, the place of each over all files in the order of their names: files' counts are summed, frames are not sorted."""
    from pyspark.sql import Window

    counts = frames.groupBy("path").agg(F.count("*").alias("n"))
    before = counts.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("before"))  # a row for each file
    return frames.join(before, "path").withColumn("id", F.col("before") + F.col("frame")).drop("before")
