"""SimHash near-duplicates: every pair of fingerprints within a Hamming radius, found by comparing tiles exactly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.components import components
from lattix.llm.shared import bounded, stash

#: Fingerprints in a tile, on average at most.
TILE = 1024
#: Shingles whose bits are counted at once, so that a very long text needs no more memory.
CHUNK = 1 << 15
#: Min-hash bands and the values in each: texts of Jaccard similarity 0.8 share a band but for 2 in 10,000.
BANDS = 16
BAND_ROWS = 4
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts of a band's value that are all compared with one another at once; more are dealt to groups of so many and meet
#: one text besides, and what that leaves apart is compared in tiles.
BUCKET = 16
#: Sets in such a tile and bytes of their shingles, on average at most; minima of 64 that sets of 0.8 share but for 2 in 10,000.
TILE_SETS, TILE_BYTES, AGREE = 256, 8 << 20, 40


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of UTF-8 text over word shingles, repeats counted; 0 where it has no word.

    A-Z are lower-cased; a text of fewer words is one shingle; a bit is set if over half of the XXH64 (seed 42) have it.
    """
    return _fingerprint(_hashes(text, shingle))


def _hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """The XXH64 (seed 42) of each word shingle, repeats kept, in chunks."""
    words = (text or b"").lower().split()
    if not words:
        return
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        yield np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], "<u8")


def _fingerprint(chunks: Iterable[np.ndarray]) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for hashes in chunks:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """``docs`` with the column ``out``: the fingerprint as a signed long (null text: 0)."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    return bounded(docs).withColumn(out, of(F.col(text).cast("binary")))


def _linked(radius: int):
    def work(batches):
        for batch in batches:
            a, b, same = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            left, right = [], []
            for i, own in enumerate(same):
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
                if own:
                    near = np.triu(near, 1)
                count = int(near.sum())
                if not count:
                    continue
                if count <= 2 * (len(x) + len(y)):
                    r, c = np.nonzero(near)
                    left.append(x[r])
                    right.append(y[c])
                else:
                    for nodes, labels in _stars(x, y, near):
                        left.append(nodes)
                        right.append(labels)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return work


def _stars(x: np.ndarray, y: np.ndarray, near: np.ndarray):
    """The components of a tile pair's links as stars: a link for each node at most, whatever the number of pairs."""
    top = np.iinfo(np.int64).max
    rows, cols = near.any(1), near.any(0)
    lx, ly = np.where(rows, x, top), np.where(cols, y, top)
    place = {}
    if x is y or np.array_equal(x, y):
        near, place = near | near.T, {"same": True}
        lx = ly = np.where(near.any(1), x, top)
        rows = cols = near.any(1)
    while True:
        ny = np.minimum(ly, np.where(near, lx[:, None], top).min(0))
        nx = np.minimum(lx, np.where(near, ny[None, :], top).min(1))
        if place:
            nx = ny = np.minimum(nx, ny)
        if np.array_equal(nx, lx) and np.array_equal(ny, ly):
            break
        lx, ly = nx, ny
    return [(x[rows], lx[rows]), (y[cols], ly[cols])]


def link_fingerprints(fps: DataFrame, radius: int = 3, fp: str = "fp", tile: int = TILE) -> DataFrame:
    """``(a, b)``: links that connect exactly the distinct fingerprints of ``fps`` reachable in steps of ``radius`` bits.

    Fingerprints are laid in tiles by the population counts of their four 16-bit quarters. Two fingerprints within the
    radius have counts that differ by no more in sum, so only such tile pairs are compared (65 of the neighbouring
    count vectors for radius 3), each exactly by exclusive-or and bit counts in numpy. A full cell is cut in
    several tiles by hash. A pair of tiles returns no more links than four times its rows.
    """
    counts = [F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]
    cells = fps.where(F.col(fp).isNotNull()).select(F.col(fp).alias("fp")).distinct().select("fp", sum((c * (32**q) for q, c in enumerate(counts)), F.lit(0)).cast("int").alias("cell"))
    # At most 17 ** 4 cells of a few bytes each: broadcasting them is bounded.
    parts = stash(cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")), "cells")
    tiles = cells.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = stash(tiles.groupBy("cell", "part").agg(F.collect_list("fp").alias("fps")), "tiles")
    steps = [sum(d * 32**q for q, d in enumerate(s)) for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius and s >= (0, 0, 0, 0)]
    near = tiles.select(F.explode(F.array(*(F.col("cell") + s for s in steps))).alias("other"), F.col("cell").alias("own"), F.col("part").alias("own_part"), F.col("fps").alias("own_fps"))
    # Joined by cell and part, so that the middle cells, which hold most tiles, are spread out.
    known = parts.withColumnRenamed("cell", "p_cell")
    near = near.join(F.broadcast(known), near.other == known.p_cell).withColumn("other_part", F.explode(F.sequence(F.when(F.col("own") == F.col("other"), F.col("own_part")).otherwise(F.lit(0)), F.col("parts") - 1))).drop("p_cell", "parts")
    pairs = near.join(tiles, (near.other == tiles.cell) & (near.other_part == tiles.part))
    pairs = pairs.select("own_fps", "fps", F.expr("own = cell and own_part = part").alias("same"))
    return pairs.mapInArrow(_linked(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``: fingerprint and smallest id reachable over links.

    Equal fingerprints are one node, so thousands of copies cost one comparison. Texts that are null, empty or without
    a word have fingerprint zero and link like any other. Repeated rows return repeated rows. Null ids join their
    group but are never its smallest id; a group that has only null ids has a null ``component_id``. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    marked = stash(fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "fp", shingle).select("id", "fp"), "fingerprints")
    groups = stash(marked.groupBy("fp").agg(F.min("id").alias("least")), "groups")
    roots = components(link_fingerprints(groups, radius)).select(F.col("node").alias("fp"), "root")
    linked = groups.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    found = stash(linked.join(least, "root").select("fp", "component"), "components").unionByName(groups.join(roots, "fp", "left_anti").select("fp", F.col("least").alias("component")))
    return marked.join(found, "fp").select(F.col("id").alias(id), "fp", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one whose id is the component's.

    Groups that have only null ids keep all their rows; rows that repeat the kept id stay (``doc_id`` is a key of
    ``documents``).
    """
    kept = near_duplicates(docs, radius, shingle).where("doc_id = component_id or component_id is null").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def _bands(shingles: np.ndarray) -> tuple[list[int], bytes]:
    """A value for each band: a hash of ``BAND_ROWS`` minima of the shingles' hashes; and the last byte of each minimum."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK // 8):
        least = np.minimum(least, (shingles[at : at + CHUNK // 8][None, :] * _FACTORS).min(1))
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))], least.astype(np.uint8).tobytes()


def _sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, fp, digest, bands, minima)``; equal digests (128 bits) are equal sets of shingles."""

    @F.arrow_udf("fp long, digest binary, bands array<long>, minima binary")
    def of(texts: pa.Array) -> pa.Array:
        fps, digests, bands, minima = [], [], [], []
        for t in texts:
            chunks = list(_hashes(t.as_py(), shingle))
            shingles = np.unique(np.concatenate(chunks)) if chunks else np.empty(0, np.uint64)
            fps.append(_fingerprint(chunks))
            digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            values, last = _bands(shingles)
            bands.append(np.array(values, np.uint64).view(np.int64))
            minima.append(last)
        return pa.StructArray.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(minima, pa.binary())], ["fp", "digest", "bands", "minima"])

    return bounded(docs).select("doc_id", of(F.col("text").cast("binary")).alias("s")).select("doc_id", "s.*")


def _shingles(docs: DataFrame, shingle: int) -> DataFrame:
    """``(node, shingles)``: the sorted distinct hashes as little-endian bytes."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(np.concatenate([np.empty(0, "<u8"), *_hashes(t.as_py(), shingle)])).tobytes() for t in texts], pa.binary())

    return docs.select("node", of(F.col("text").cast("binary")).alias("shingles"))


def _similar(similarity: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                small, large = sorted((len(one), len(two)))
                shared = len(np.intersect1d(one, two, True)) if small >= similarity * large else 0
                keep.append(shared > 0 and shared >= similarity * (small + large - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return work


def _apart(similarity: float):
    """Links between the sets of two tiles that are not connected yet; of two roots the first found is enough."""

    def side(rows: pa.StructArray):
        shingles = [np.frombuffer(x.as_py(), "<u8") for x in rows.field("shingles")]
        minima = np.frombuffer(b"".join(rows.field("minima").to_pylist()), np.uint8).reshape(len(rows), -1)
        bands = rows.field("bands").flatten().to_numpy().reshape(len(rows), -1)
        return rows.field("node").to_numpy(), rows.field("root").to_numpy(), minima, bands, shingles, np.array([len(x) for x in shingles])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                band = batch.column("band")[i].as_py()
                (a, ra, ma, ba, sa, na), (b, rb, mb, bb, sb, nb) = side(batch.column("one")[i].values), side(batch.column("two")[i].values)
                near = ra[:, None] != rb[None, :]
                near &= np.minimum(na[:, None], nb[None, :]) >= similarity * np.maximum(na[:, None], nb[None, :])
                # A pair is met in the first band that it shares only.
                near &= (ba[:, None, :] == bb[None, :, :]).argmax(2) == np.flatnonzero(ba[0] == band)[0]
                near &= (ma[:, None, :] == mb[None, :, :]).sum(2) >= AGREE
                left, right, done = [], [], set()
                for x, y in zip(*np.nonzero(near)):
                    if (key := (min(ra[x], rb[y]), max(ra[x], rb[y]))) in done:
                        continue
                    shared = len(np.intersect1d(sa[x], sb[y], True))
                    if shared and shared >= similarity * (na[x] + nb[y] - shared):
                        done.add(key)
                        left.append(min(a[x], b[y]))
                        right.append(max(a[x], b[y]))
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return work


def _remaining(large: DataFrame, sets: DataFrame, shingles: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame | None:
    """Links among the sets of ``large(band, node)`` that ``pairs`` do not connect: none if all sets of each band are one component.

    Sets outside of a band's largest component meet all others of the band, in tiles that are joined by (band, part),
    so that a band with many sets is spread out.
    """
    placed = large.select("band", "node").join(components(pairs), "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    placed = stash(placed, "placed")
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1")
    sizes = stash(sizes, "open")
    if sizes.isEmpty():
        return None
    members = placed.join(sizes.drop("roots"), "band").join(sets.select("node", "bands", "minima"), "node").join(shingles, "node")
    members = stash(members, "members")
    parts = members.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum(F.octet_length("shingles")) / TILE_BYTES)).cast("int").alias("parts"))
    dealt = members.join(stash(parts, "parts"), "band").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = F.collect_list(F.struct("node", "root", "minima", "bands", "shingles"))
    tiles = stash(dealt.groupBy("band", "part").agg(rows.alias("rows"), F.max("parts").alias("parts"), F.bool_or(F.col("root") != F.col("main")).alias("some")), "settiles")
    one = tiles.select("band", "part", F.col("rows").alias("one"), F.col("some").alias("some_one"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("other"))
    two = tiles.select(F.col("band").alias("o_band"), F.col("part").alias("o_part"), F.col("rows").alias("two"), "some")
    both = one.join(two, (F.col("band") == F.col("o_band")) & (F.col("other") == F.col("o_part"))).where("some or some_one")
    return both.select("band", "one", "two").mapInArrow(_apart(similarity), "a long, b long")


def similar_pairs(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(nodes, pairs)``: ``nodes(node)``, the smallest id of each set of word shingles, and ``pairs(a, b)`` of nodes whose sets have a Jaccard similarity of ``similarity`` or more.

    Candidates share a min-hash band or are linked by fingerprints within 3 bits; each is then compared exactly, so no
    other pair is returned. A fingerprint radius alone doesn't do: at 0.8 fingerprints differ by about 10 of 64 bits, so
    tiles would meet nearly all others. A band's value that many sets have makes no square of pairs: each set meets
    some ``BUCKET`` others and the set that shares most bands; of what is still apart then, a pair is returned for each
    two components that some pair of the value connects (``_remaining``). So of a value's sets not all pairs are
    returned, but all that are connected by pairs are connected by those returned.
    """
    marked = stash(_sketched(docs, shingle), "sketches")
    nodes = stash(marked.groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")
    kept = nodes.where("node is not null").withColumnRenamed("digest", "d")
    sets = stash(marked.join(kept, (marked.doc_id == kept.node) & (marked.digest == kept.d)).select("node", "fp", "bands", "minima").dropDuplicates(["node"]), "sets")
    exploded = sets.select("node", F.explode("bands").alias("band"))
    many = exploded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = stash(exploded.join(many, "band").withColumn("part", F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("n") / BUCKET))), "bands")
    one, two = shared.select("band", "part", F.col("node").alias("a")), shared.select("band", "part", F.col("node").alias("b"))
    inside = one.join(two, ["band", "part"]).where("a < b").select("a", "b")
    large = shared.where(F.col("n") > BUCKET)
    weights = large.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = large.join(weights, "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("hub")).select("band", F.col("hub.node").alias("hub"))
    stars = large.join(hubs, "band").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).where("a < b")
    groups = sets.groupBy("fp").agg(F.min("node").alias("least"))
    equal = sets.join(groups, "fp").select(F.col("least").alias("a"), F.col("node").alias("b")).where("a < b")
    ends = groups.select(F.col("fp").alias("a"), F.col("least").alias("x")), groups.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    near = link_fingerprints(groups).join(ends[0], "a").join(ends[1], "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b")
    pairs = stash(inside.unionByName(stars).unionByName(equal).unionByName(near).distinct(), "pairs")
    used = stash(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "used")
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(used, "node", "left_semi").dropDuplicates(["node"])
    shingles = stash(_shingles(texts, shingle), "shingles")
    both = pairs.join(shingles.withColumnRenamed("shingles", "x"), F.col("a") == F.col("node")).drop("node").join(shingles.withColumnRenamed("shingles", "y"), F.col("b") == F.col("node"))
    linked = stash(both.select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long"), "linked")
    more = _remaining(large, sets, shingles, linked, similarity)
    return nodes.select("node"), linked if more is None else linked.unionByName(more)


def keep_one_similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group linked by ``similar_pairs`` or equal sets of shingles.

    Null ids and repeated rows are treated as in ``keep_one``.
    """
    nodes, pairs = similar_pairs(docs, similarity, shingle)
    gone = components(pairs).where("node <> root").select("node")
    kept = stash(nodes.join(gone, "node", "left_anti").distinct(), "kept")
    # What goes is mostly little: written first, it is sent to the texts if its size allows it, and these are not shuffled.
    ids = docs.select(F.col("doc_id").alias("gone_id")).where("gone_id is not null").distinct()
    out = stash(ids.join(kept, ids["gone_id"] == kept["node"], "left_anti"), "gone")
    left = docs.join(out, docs["doc_id"] == out["gone_id"], "left_anti")
    return left if not kept.where("node is null").isEmpty() else left.where(F.col("doc_id").isNotNull())
