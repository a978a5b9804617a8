"""Training a codebook: batch steps as aggregates, ordered online and growing training as single-task kernels."""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.operators.bmu import gathered, rows_of


def _sums(w: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, hits = np.zeros_like(w), np.zeros(len(w), np.int64)
        step = max(1, (1 << 22) // w.size)
        for batch in batches:
            x = rows_of(batch.column(0), w.shape[1])
            for a in range(0, len(x), step):
                some = x[a : a + step]
                best = ((some[:, None, :] - w[None]) ** 2).sum(2).argmin(1)
                np.add.at(sums, best, some)
                hits += np.bincount(best, minlength=len(w))
        if (live := np.flatnonzero(hits)).size:
            yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(hits[live]), pa.array(sums[live].tolist(), pa.list_(pa.float64()))], ["nid", "n", "x"])

    return work


def batch_step(data: DataFrame, codebook: DataFrame, rows: int, cols: int, radius: float, toric: bool = True) -> DataFrame:
    """One batch update: each neuron becomes the kernel-weighted mean of all inputs.

    Each partition sums its inputs by their best-matching unit and those sums are shuffled (a map's size for each
    partition). The sums of all, a map's size, are spread over the neighbourhood by products of kernel blocks with
    them, so the kernel's cost depends on the map alone. A neuron that no input reaches (its kernel is 0 in doubles)
    keeps its weights.
    """
    cells = gathered(codebook)
    sums = data.select("v").mapInArrow(_sums(np.array([r.w for r in cells])), "nid int, n long, x array<double>")
    sums = sums.select("nid", "n", F.posexplode("x").alias("dim", "x")).groupBy("nid", "dim").agg(F.sum("x").alias("sx"), F.sum("n").alias("n"))
    sums = sums.groupBy("nid").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "sx"))), lambda s: s["sx"]).alias("x")).collect()
    at = np.array([(r.i, r.j) for r in cells], float)
    hits, total = np.zeros(len(cells)), np.zeros((len(cells), len(cells[0].w)))
    for r in sums:
        hits[r.nid], total[r.nid] = r.n, r.x
    new, old = np.empty_like(total), np.array([r.w for r in cells])
    for a in range(0, len(cells), 1024):
        d = np.abs(at[a : a + 1024, None, :] - at[None])
        if toric:
            d = np.minimum(d, np.array([rows, cols]) - d)
        h = np.exp(-(d**2).sum(2) / (4 * radius * radius))
        mass = (h @ hits)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            new[a : a + 1024] = np.where(mass > 0, (h @ total) / mass, old[a : a + 1024])
    return data.sparkSession.createDataFrame([(r.nid, r.i, r.j, w) for r, w in zip(cells, new.tolist())], "nid int, i int, j int, w array<double>")


def fixed(codebook: DataFrame) -> DataFrame:
    """The codebook as a local table: cuts the plan between steps of training (some thousand rows)."""
    return codebook.sparkSession.createDataFrame(gathered(codebook), codebook.schema)


def batch_train(data: DataFrame, codebook: DataFrame, rows: int, cols: int, radii: list[float], toric: bool = True) -> DataFrame:
    for r in radii:
        codebook = fixed(batch_step(data, codebook, rows, cols, r, toric))
    return codebook


def decay(start: float, end: float, t: int, steps: int) -> float:
    return (start - end) * math.exp(-10.0 * t / steps) + end


#: (learning rate start and end, radius start and end, rounds over the data) of each phase.
PHASES = [(0.5, 0.25, 6.25, 3.0, 1), (0.25, 0.0, 4.0, 1.0, 2)]


def online(x: np.ndarray, w: np.ndarray, rows: int, cols: int, phases=PHASES, seed: int = 0, toric: bool = True) -> np.ndarray:
    """Stochastic training in seeded order: every neuron moves towards each input by the kernel about its best-matching unit."""
    w, rng = w.copy(), np.random.default_rng(seed)
    gi, gj = np.divmod(np.arange(rows * cols), cols)
    for a0, a1, r0, r1, rounds in phases:
        order, steps = rng.permutation(len(x)), rounds * len(x)
        for t in range(steps):
            v = x[order[t % len(x)]]
            b = int(((w - v) ** 2).sum(1).argmin())
            di, dj = np.abs(gi - gi[b]), np.abs(gj - gj[b])
            if toric:
                di, dj = np.minimum(di, rows - di), np.minimum(dj, cols - dj)
            r = decay(r0, r1, t, steps)
            h = decay(a0, a1, t, steps) * np.exp(-(di * di + dj * dj) / (2 * r) ** 2)
            w -= h[:, None] * (w - v)
    return w


#: A growing map's kernel leaves cells that it would move by less as they are.
STILL = 1e-4
#: Its learning rate and radius, start and end.
GROWING = (0.5, 0.0, 1.5, 1.0)


def growing(x: np.ndarray, side: int = 3, threshold: float = 1.0, rounds: int = 2, seed: int = 0) -> list[tuple[int, int, np.ndarray]]:
    """A planar map that adds cells beside the one whose error passes ``threshold`` times the inputs' mean distance from their mean.

    A step is one product of the map with its input: the exact distance is taken of those cells only that rounding may
    make the nearest, and only the cells of the disc where the kernel passes ``STILL`` are moved.
    """
    a0, a1, r0, r1 = GROWING
    rng, width = np.random.default_rng(seed), x.shape[1]
    cells = [(i, j) for i in range(side) for j in range(side)]
    w = np.array([x[rng.integers(len(x))] for _ in cells], float)
    norms = np.einsum("ij,ij->i", w, w)
    reach = math.isqrt(int((2 * r0) ** 2 * math.log(a0 / STILL)))
    squares = [np.add.outer(o * o, o * o) for o in (np.arange(-k, k + 1) for k in range(reach + 1))]
    # Which cell is where, with ``edge`` places before the first row and column and at least ``reach`` free ones all around.
    edge = 2 * reach
    place = np.full((side + 2 * edge,) * 2, -1)
    place[edge : edge + side, edge : edge + side] = np.arange(len(cells)).reshape(side, side)
    mean, step = x.mean(0), max(1, (1 << 20) // width)
    limit = threshold * float(np.concatenate([np.linalg.norm(x[a : a + step] - mean, axis=1) for a in range(0, len(x), step)]).mean())
    rounding, peak = 16 * (width + 8) * np.finfo(float).eps, float(norms.max())
    n, steps = len(cells), rounds * len(x)
    for t in range(steps):
        v = x[t % len(x)]
        near = norms[:n] - 2 * (w[:n] @ v)
        close = np.flatnonzero(~(near > near.min() + rounding * (peak + v @ v)))
        d = np.sqrt(((w[close] - v) ** 2).sum(1))
        best = int(close[d.argmin()])
        bi, bj = cells[best]
        r, a = decay(r0, r1, t, steps), decay(a0, a1, t, steps)
        if a > STILL:
            h = np.array([a * math.exp(-s / (2 * r) ** 2) for s in range(int((2 * r) ** 2 * math.log(a / STILL)) + 2)])
            moved = int((h > STILL).sum())
            k = math.isqrt(moved - 1)
            around = place[bi + edge - k : bi + edge + k + 1, bj + edge - k : bj + edge + k + 1]
            met = (around >= 0) & (squares[k] < moved)
            at = around[met]
            old = w[at]
            old -= h[squares[k][met]][:, None] * (old - v)
            w[at] = old
            norms[at] = new = np.einsum("ij,ij->i", old, old)
            peak = max(peak, float(new.max()))
        if d.min() > limit and n < len(x):
            for di, dj in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                i, j = bi + di, bj + dj
                if place[i + edge, j + edge] < 0:
                    if n == len(w):
                        w, norms = np.concatenate([w, np.empty_like(w)]), np.concatenate([norms, np.empty_like(norms)])
                    w[n] = w[best] + (v - w[best]) / 2
                    norms[n] = w[n] @ w[n]
                    peak = max(peak, float(norms[n]))
                    place[i + edge, j + edge] = n
                    cells.append((i, j))
                    n += 1
                    if min(i + edge, j + edge, len(place) - 1 - i - edge, len(place) - 1 - j - edge) < reach + 1:
                        more = len(place) // 2
                        place, edge = np.pad(place, more, constant_values=-1), edge + more
                    break
    return [(*c, w[k]) for c, k in sorted(zip(cells, range(n)))]


def train_online(data: DataFrame, codebook: DataFrame, rows: int, cols: int, maps: int = 1, seed: int = 0) -> DataFrame:
    """``(map, nid, i, j, w)``: online updates don't commute, so each map is one task over the ordered inputs; ``maps`` seeds run side by side.

    For data that one task can hold; ``batch_train`` is the distributed way.
    """
    start = np.array([r.w for r in codebook.orderBy("nid").collect()])

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("id").v.tolist())
        w = online(x, start, rows, cols, seed=seed + int(key[0]))
        n = np.arange(len(w))
        return pd.DataFrame({"map": int(key[0]), "nid": n, "i": n // cols, "j": n % cols, "w": w.tolist()})

    many = data.select(F.explode(F.sequence(F.lit(0), F.lit(maps - 1))).alias("map"), "id", "v")
    return many.groupBy("map").applyInPandas(work, "map int, nid int, i int, j int, w array<double>")


def _stored(batches: Iterator[pa.RecordBatch], at: str) -> np.ndarray:
    """The vectors of all batches, in their order, as a matrix mapped from the file ``at``: the task holds one batch."""
    rows = width = 0
    with open(at, "wb") as f:
        for batch in batches:
            if batch.num_rows:
                width = width or len(batch.column(0)[0])
                f.write(np.ascontiguousarray(rows_of(batch.column(0), width)))
                rows += batch.num_rows
    return np.asarray(np.memmap(at, float, "r", shape=(rows, width))) if rows * width else np.empty((rows, width))


def train_growing(data: DataFrame, threshold: float = 1.0, seed: int = 0) -> DataFrame:
    """``(i, j, w)`` of a growing map: one ordered task, like ``train_online``.

    Spark sorts its inputs (on disk where they are many) and the task maps them from a file, so it holds the map only.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as own:
            x = _stored(batches, os.path.join(own, "inputs"))
            found = growing(x, threshold=threshold, seed=seed) if len(x) else []
        i, j, w = ([c[k] for c in found] for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([c.tolist() for c in w], pa.list_(pa.float64()))], ["i", "j", "w"])

    return data.select("id", "v").coalesce(1).sortWithinPartitions("id").select("v").mapInArrow(work, "i int, j int, w array<double>")
