"""Binary coordinate trajectories: a reader split by frames, and a writer."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def header(raw: bytes) -> dict:
    """Byte order, atoms, frames, whether there are unit cells, and where the frames begin; from a file's first bytes."""
    for order in "<>":
        if struct.unpack_from(order + "i", raw)[0] == 84:
            break
    else:
        raise ValueError("not a coordinate trajectory")
    frames, cell = (struct.unpack_from(order + "i", raw, 8 + 4 * k)[0] for k in (0, 10))
    at = 92
    at += 8 + struct.unpack_from(order + "i", raw, at)[0]
    atoms = struct.unpack_from(order + "i", raw, at + 4)[0]
    return {"order": order, "frames": frames, "cell": bool(cell), "atoms": atoms, "start": at + 12}


def frame_bytes(h: dict) -> int:
    return 56 * h["cell"] + 3 * (4 * h["atoms"] + 8)


def parse(raw: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """``(frame, v, box)`` of a whole file; the number of frames is that of the bytes, whatever the header says."""
    h = header(raw)
    size, o, n = frame_bytes(h), h["order"], h["atoms"]
    for k in range((len(raw) - h["start"]) // size):
        at, box = h["start"] + k * size, None
        if h["cell"]:
            box = np.frombuffer(raw, o + "f8", 6, at + 4).astype(float)
            at += 56
        axes = [np.frombuffer(raw, o + "f4", n, at + a * (4 * n + 8) + 4) for a in range(3)]
        yield k, np.stack(axes, 1).ravel().astype(float), box


def read_dcd(spark: SparkSession, path: str, atoms: list[int] | None = None) -> DataFrame:
    """``(path, frame, v, box)`` of each frame; ``atoms``: only these, by place from 0.

    Files are read whole, one for each row of a task; a long trajectory is kept as many files.
    """
    keep = None if atoms is None else np.array([3 * a + k for a in atoms for k in range(3)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0), batch.column(1)):
                for k, v, box in parse(raw.as_py()):
                    v = v if keep is None else v[keep]
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([k], pa.int64()), pa.array([v.tolist()], pa.list_(pa.float64())), pa.array([None if box is None else box.tolist()], pa.list_(pa.float64()))], ["path", "frame", "v", "box"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "path string, frame long, v array<double>, box array<double>")


def encode(frames: list[np.ndarray], title: str = "written by lattix") -> bytes:
    """A whole little-endian file of frames of 3 n numbers."""
    record = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    numbers = [0] * 20
    numbers[0], numbers[19] = len(frames), 24
    n = len(frames[0]) // 3 if frames else 0
    out = [record(b"CORD" + struct.pack("<20i", *numbers)), record(struct.pack("<i", 1) + title.encode()[:80].ljust(80)), record(struct.pack("<i", n))]
    for v in frames:
        out += [record(np.ascontiguousarray(v.reshape(-1, 3)[:, a], "<f4").tobytes()) for a in range(3)]
    return b"".join(out)


def dcd_files(frames: DataFrame, part: str = "part") -> DataFrame:
    """``(part, content)``: a file of the frames (in their order) of each ``part``, small enough for a task."""
    import pandas as pd

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({part: [key[0]], "content": [encode([np.array(v) for v in pdf.sort_values("frame").v])]})

    return frames.select(F.col(part).cast("long").alias(part), "frame", "v").groupBy(part).applyInPandas(work, f"{part} long, content binary")
