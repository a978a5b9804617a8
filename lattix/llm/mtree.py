"""Exact top-k inner products with one distributed M-tree, searched best first within stored metric bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.llm.shared import stash

#: Vectors below a child of the root, queries of one block, entries of a leaf page: on average at most.
TREE, QUERIES, PAGE = 4096, 512, 256
#: Children of the root at most, and bytes of their pivots, which every routing task gets; a child with more vectors is cut in parts.
ROOTS, ROOT_BYTES = 4096, 8 << 20
#: Blocks of queries that meet the table of nodes in one group.
MEET = 8
#: Bounds are loosened by this share, so that rounding never hides a vector.
LOOSE = 1e-9
NONE = np.iinfo(np.int64).min


def _raised(rows: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more dimension, so that the inner product is a metric.

    x' = (x, sqrt(m - x.x)), m the largest x.x, has |q' - x'|**2 = q.q + m - 2 q.x for q' = (q, 0).
    """
    return np.column_stack([rows, np.sqrt(np.maximum(0.0, most - np.einsum("ij,ij->i", rows, rows)))])


class MTree:
    """A child of the root: leaf pages under pivots.

    It keeps its own pivot and covering radius; a page keeps its pivot, covering radius and distance to the child's
    pivot; entries keep their distance to the page's pivot, and lie in its order.
    """

    FIELDS = "pivot array<double>, radius double, most double, pivots array<double>, radii array<double>, ups array<double>, ends array<int>, far array<double>, flat array<long>, ids array<array<long>>"

    def __init__(self, pivot, radius, most, pivots, radii, ups, ends, far, flat, ids):
        self.pivot, self.radius, self.most = pivot, radius, most
        self.pivots, self.radii, self.ups, self.ends, self.far, self.ids = pivots.reshape(len(radii), -1), radii, ups, ends, far, ids
        self.plain = flat.reshape(len(far), -1)
        self.least = np.array([i[0] for i in ids], np.int64)
        # Sums of products under 2 ** 53 are exact in double precision, whose products are much faster.
        self.rows = self.plain.astype(np.float64)
        self.limit = 2**52 / max(float(np.abs(self.plain).max(initial=0)) * self.plain.shape[1], 1.0)
        self.scored = 0

    @classmethod
    def build(cls, ids: list[list[int]], plain: np.ndarray, page: int = PAGE) -> MTree:
        rows = plain.astype(np.float64)
        most = float(np.einsum("ij,ij->i", rows, rows).max(initial=0.0))
        points = _raised(rows, most)
        rng = np.random.default_rng(len(rows))
        pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def middle(members):
            return points[members][np.argmin(np.linalg.norm(points[members] - points[members].mean(0), axis=1))]

        def lay(members):
            pivot = middle(members)
            far = np.linalg.norm(points[members] - pivot, axis=1)
            if len(members) > page and far.max() > 0.0:
                seeds = points[rng.choice(members, min(len(members), -(-len(members) // page)), replace=False)]
                nearest = np.argmin((seeds**2).sum(1)[None, :] - 2 * points[members] @ seeds.T, axis=1)
                parts = [members[nearest == k] for k in np.unique(nearest)]
                if len(parts) == 1:
                    parts = np.array_split(members[np.argsort(far, kind="stable")], -(-len(members) // page))
                for p in parts:
                    lay(p)
            else:
                by = np.argsort(far, kind="stable")
                pages.append((members[by], far[by], pivot))

        lay(np.arange(len(rows)))
        pivot = middle(np.arange(len(rows)))
        order = np.concatenate([p[0] for p in pages])
        pivots = np.array([p[2] for p in pages])
        return cls(pivot, float(np.linalg.norm(points - pivot, axis=1).max()), most, pivots, np.array([p[1][-1] for p in pages]), np.linalg.norm(pivots - pivot, axis=1), np.cumsum([len(p[0]) for p in pages]), np.concatenate([p[1] for p in pages]), plain[order].ravel(), [ids[i] for i in order])

    def row(self) -> list:
        return [self.pivot, self.radius, self.most, self.pivots.ravel(), self.radii, self.ups, self.ends, self.far, self.plain.ravel(), self.ids]

    def search(self, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(score, entry)``, each a row of ``k`` for a query: the largest inner products, ties to the smaller least id.

        ``floor``: scores that a query has elsewhere for its k-th (``NONE``: not yet); less is not looked for. Places
        that stay free have the score ``NONE``. Pages are read by the least distance that they can hold for a query of
        the block; queries whose k-th score a page can't beat, by its distance or already by that to the pivot above,
        skip it, and entries outside of the ring that the k-th score allows are not scored.
        """
        n, rows, asked = len(queries), self.rows, queries.astype(np.float64)
        if float(np.abs(queries).max(initial=0)) >= self.limit:
            rows, asked = self.plain, queries
        points = np.column_stack([queries.astype(np.float64), np.zeros(n)])
        base = np.einsum("ij,ij->i", points, points) + self.most
        best, held = np.full((n, k), NONE), np.zeros((n, k), np.int64)
        floor = np.full(n, NONE) if floor is None else floor

        def reach_of(kth, base):
            known = np.sqrt(np.maximum(0.0, base - 2.0 * kth)) * (1 + LOOSE) + 1e-6
            return np.where(kth == NONE, np.inf, known)

        reach = reach_of(floor, base)
        above = np.linalg.norm(points - self.pivot, axis=1)
        close = np.abs(above[:, None] - self.ups[None, :]) - self.radii[None, :] <= reach[:, None]
        some = np.flatnonzero(close.any(0))
        square = (points**2).sum(1)[:, None] + (self.pivots[some] ** 2).sum(1)[None, :] - 2 * points @ self.pivots[some].T
        away = np.sqrt(np.maximum(0.0, square))
        low = np.where(close[:, some], np.maximum(0.0, away * (1 - LOOSE) - self.radii[some] - 1e-6), np.inf)
        for at in np.argsort(low.min(0), kind="stable") if n else ():
            here = np.flatnonzero(low[:, at] <= reach)
            if not len(here):
                continue
            start, end = (self.ends[some[at] - 1] if some[at] else 0), self.ends[some[at]]
            far, d, r = self.far[start:end], away[here, at], reach[here] + 1e-6
            a, b = start + np.searchsorted(far, (d - r).min(), "left"), start + np.searchsorted(far, (d + r).max(), "right")
            scores = (rows[a:b] @ asked[here].T).astype(np.int64)
            self.scored += scores.size
            kth = np.maximum(best[here, k - 1], floor[here])
            if (free := kth == NONE).any() and b - a > k:
                # Not all of the first page: its own k-th score is a floor already.
                kth = np.where(free, np.partition(scores, b - a - k, axis=0)[b - a - k], kth)
            entry, query = np.nonzero(scores >= kth[None, :])
            if not len(entry):
                continue
            touched = np.unique(query)
            owner = np.concatenate([np.repeat(touched, k), query])
            value = np.concatenate([best[here[touched]].ravel(), scores[entry, query]])
            where = np.concatenate([held[here[touched]].ravel(), a + entry])
            order = np.lexsort((self.least[where], ~value, owner))
            owner, value, where = owner[order], value[order], where[order]
            first = np.searchsorted(owner, touched)
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
            keep = place < k
            best[here[owner[keep]], place[keep]], held[here[owner[keep]], place[keep]] = value[keep], where[keep]
            reach[here] = reach_of(np.maximum(best[here, k - 1], floor[here]), base[here])
        return best, held


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, width)


def _router(pivots: dict[int, np.ndarray]) -> Callable:
    """Adds ``root``: the nearest pivot of the same width, -1 if there is none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, v = batch.column("width").to_numpy(), batch.column("v")
            root = np.full(batch.num_rows, -1, np.int32)
            for w in np.unique(widths):
                if (p := pivots.get(int(w))) is not None:
                    own = np.flatnonzero(widths == w)
                    x = _lists(v.take(pa.array(own)), int(w)).astype(np.float64)
                    root[own] = np.argmin((p**2).sum(1)[None, :] - 2 * x @ p.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(root)], [*batch.schema.names, "root"])

    return work


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(pa.float64()), pa.float64(), pa.float64(), *[pa.list_(pa.float64())] * 3, pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
    names = [f.split()[0] for f in MTree.FIELDS.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            tree = MTree.build(batch.column("ids")[i].as_py(), _lists(batch.column("vs")[i].values, batch.column("width")[i].as_py()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("width", "root", "part")), *(pa.array([x], t) for x, t in zip(tree.row(), kinds))], ["width", "root", "part", *names])


def _tree(batch: pa.RecordBatch, i: int) -> MTree:
    columns = [batch.column(f.split()[0])[i] for f in MTree.FIELDS.split(", ")]
    return MTree(*(x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) and not pa.types.is_list(x.type.value_type) else x.as_py() for x in columns))


def _search(k: int, first: bool) -> Callable:
    """Searches a block of queries in a tree; ``first``: the block goes on with its k-th scores, else there are some."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                now = tuple(batch.column(c)[i].as_py() for c in ("width", "root", "part"))
                if now != key:
                    key, tree = now, _tree(batch, i)
                qids = batch.column("qids")[i].values.to_numpy()
                queries = _lists(batch.column("qs")[i].values, now[0])
                floor = None if first else batch.column("kth")[i].values.to_numpy()
                tree.scored = 0
                score, entry = tree.search(queries, k, floor)
                lists = [(q, s[s != NONE], e[s != NONE]) for q, s, e in zip(qids.tolist(), score, entry)]
                found = [[q, int(s), int(v)] for q, ss, es in lists for s, e in zip(ss, es) for v in tree.ids[e]]
                hits = pa.array([[{"qid": q, "score": s, "vec_id": v} for q, s, v in found]], pa.list_(pa.struct([("qid", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])))
                out = [hits, pa.array([tree.scored], pa.int64())]
                names = ["hits", "scored"]
                if first:
                    out += [batch.column(c).slice(i, 1) for c in ("q_root", "q_part", "width", "part", "qids", "qs")] + [pa.array([score[:, k - 1]], pa.list_(pa.int64()))]
                    names += ["q_root", "q_part", "q_width", "home", "qids", "qs", "kth"]
                yield pa.RecordBatch.from_arrays(out, names)

    return work


_HITS = "hits array<struct<qid:long, score:long, vec_id:long>>, scored long"


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a group that some query of a block must still look into, but the one that it began with."""
    for batch in batches:
        for i in range(batch.num_rows):
            width, q_root, q_part, home = (batch.column(c)[i].as_py() for c in ("q_width", "q_root", "q_part", "home"))
            queries = _lists(batch.column("qs")[i].values, width).astype(np.float64)
            kth = batch.column("kth")[i].values.to_numpy()
            nodes = batch.column("nodes")[i].values
            root, part = nodes.field("root").to_numpy(), nodes.field("part").to_numpy()
            pivots = _lists(nodes.field("pivot"), width + 1)
            square = (queries**2).sum(1)
            away = np.sqrt(np.maximum(0.0, square[:, None] + (pivots**2).sum(1)[None, :] - 2 * queries @ pivots[:, :-1].T))
            known = np.sqrt(np.maximum(0.0, square[:, None] + nodes.field("most").to_numpy()[None, :] - 2.0 * kth[:, None])) * (1 + LOOSE) + 1e-6
            reach = np.where(kth[:, None] == NONE, np.inf, known)
            hit = (away * (1 - LOOSE) - nodes.field("radius").to_numpy()[None, :] - 1e-6 <= reach).any(0) & ~((root == q_root) & (part == home))
            n = int(hit.sum())
            yield pa.RecordBatch.from_arrays([pa.array([width] * n, pa.int32()), pa.array([q_root] * n, pa.int32()), pa.array([q_part] * n, pa.int32()), pa.array(root[hit], pa.int32()), pa.array(part[hit], pa.int32())], ["q_width", "q_root", "q_part", "root", "part"])


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``part``: those of a (width, root) in parts of about ``size`` by hash."""
    counts = stash(rows.groupBy("width", "root").agg(F.ceil(F.count("*") / size).cast("int").alias("parts")), "counts")
    return rows.join(counts, ["width", "root"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))


def _found(vectors: DataFrame, asked: DataFrame, k: int, tree: int = TREE) -> DataFrame:
    """``(hits, scored)``: what each block of ``asked(qid, v)`` finds in each node that it looks into, and the scores computed there."""
    least = Window.partitionBy("v").orderBy("id")
    points = vectors.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = stash(points.withColumn("width", F.size("v")), "points")
    count, width = points.agg(F.count("*"), F.max("width")).first()
    want = max(1, min(ROOTS, ROOT_BYTES // (8 * (width or 1)), -(-count // tree)))
    # Pivots: those of the smallest hashes, distinct vectors all; the sample is bounded by ROOTS and ROOT_BYTES.
    sample = points.select("width", "v").orderBy(F.xxhash64("v", F.lit(1))).limit(want).collect()
    pivots = {w: np.array([r["v"] for r in sample if r["width"] == w], np.float64) for w in {r["width"] for r in sample}}
    routed = stash(points.mapInArrow(_router(pivots), "v array<long>, ids array<long>, width int, root int"), "routed")
    trees = _dealt(routed, tree).groupBy("width", "root", "part").agg(F.collect_list("v").alias("vs"), F.collect_list("ids").alias("ids"))
    # Few trees share a task: their rows are small, but their work is not.
    tasks = max(1, -(-count // tree))
    trees = stash(trees.repartition(tasks, "width", "root", "part").mapInArrow(_built, f"width int, root int, part int, {MTree.FIELDS}"), "trees")
    asked = asked.select("qid", "v", F.size("v").alias("width")).mapInArrow(_router(pivots), "qid long, v array<long>, width int, root int")
    blocks = _dealt(stash(asked, "asked"), QUERIES).groupBy("width", "root", "part").agg(F.collect_list("v").alias("qs"), F.collect_list("qid").alias("qids"))
    blocks = blocks.select("width", "root", F.col("part").alias("q_part"), F.col("root").alias("q_root"), "qids", "qs")
    parts = trees.groupBy("width", "root").agg((F.max("part") + 1).alias("parts"))
    home = blocks.join(parts, ["width", "root"]).withColumn("part", F.pmod("q_part", "parts").cast("int")).drop("parts")
    began = home.repartition(tasks, "width", "root", "part").join(trees, ["width", "root", "part"])
    began = stash(began.mapInArrow(_search(k, True), f"{_HITS}, q_root int, q_part int, q_width int, home int, qids array<long>, qs array<array<long>>, kth array<long>"), "begun")
    node = F.struct("root", "part", "pivot", "radius", "most")
    salts = max(1, -(-began.count() // MEET))
    salted = trees.select("width", F.pmod(F.xxhash64("root", "part"), F.lit(max(1, tasks // 1024))).alias("group"), node.alias("node"))
    nodes = salted.groupBy("width", "group").agg(F.collect_list("node").alias("nodes")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    meet = began.select("q_width", "q_root", "q_part", "home", "qs", "kth", F.pmod(F.xxhash64("q_width", "q_root", "q_part"), F.lit(salts)).cast("int").alias("q_salt"))
    meet = meet.join(nodes, (F.col("q_width") == F.col("width")) & (F.col("q_salt") == F.col("salt")))
    pairs = stash(meet.select("q_width", "q_root", "q_part", "home", "qs", "kth", "nodes").mapInArrow(_open, "q_width int, q_root int, q_part int, root int, part int"), "pairs")
    sent = pairs.join(began.select("q_width", "q_root", "q_part", "qids", "qs", "kth"), ["q_width", "q_root", "q_part"]).withColumnRenamed("q_width", "width")
    rest = sent.repartition(4 * tasks, "width", "root", "part").join(trees.repartition(4 * tasks, "width", "root", "part"), ["width", "root", "part"])
    return began.select("hits", "scored").unionByName(rest.mapInArrow(_search(k, False), _HITS))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest integer inner products of each query, exact.

    ``vectors(id, v array<long>)`` and ``queries(id, v)``. Equal vectors are one entry, with the ids that can be among
    the best: its ``k`` smallest, and some for the query's own. They are dealt to the nearest of some pivots, the
    children of the root, and each child is laid in pages under pivots of its own (a child with many vectors in
    several parts). A block of queries begins in its own child; with the scores found there it looks only into
    children that can beat them. Of the k-th place's ties the smaller ids win. Vectors of another length are other
    spaces. Where the data allow no bound to cut, each block meets each child, once.
    """
    asked = stash(queries.select("v").distinct().select("v", F.monotonically_increasing_id().alias("qid")), "queries")
    # A query's own id may have several vectors: so many more are looked for, as all of them may be among the best.
    spare = vectors.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    hits = _found(vectors, asked, k + spare).select(F.explode("hits").alias("h")).select("h.qid", "h.score", "h.vec_id")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    best = hits.withColumn("place", place).where(F.col("place") <= k + spare).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    by_id = queries.join(asked, "v").select(F.col("id").alias("query_id"), "qid").join(best, "qid")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = by_id.select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def share_scored(vectors: DataFrame, queries: DataFrame, k: int = 20, tree: int = TREE) -> float:
    """Of all pairs of a distinct query and a distinct vector, the share whose score the search computes."""
    asked = stash(queries.select("v").distinct().select("v", F.monotonically_increasing_id().alias("qid")), "queries")
    scored = _found(vectors, asked, k, tree).agg(F.sum("scored")).first()[0] or 0
    return scored / max(1, asked.count() * vectors.select("v").distinct().count())


def scaled(embeddings: DataFrame, factor: int = 64) -> DataFrame:
    """``(id, v)``: ids and floor(factor * x) of each component; rows with a null id, null or empty vector, or a null or non-finite component are left out."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(factor) * x.cast("double")))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad).select(F.col("vec_id").alias("id"), whole.alias("v"))


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """``top_k`` of the rows whose ``vec_id`` is divisible by ``every``, against every row but their own id.

    Rows of equal id and vector count once; of equal id and another vector, each is a candidate (never for their
    own id), and a query asks for all. Other columns are ignored. An empty table gives an empty result.
    """
    rows = stash(scaled(embeddings).distinct(), "vectors")
    return top_k(rows, rows.where(F.col("id") % every == 0), k)
