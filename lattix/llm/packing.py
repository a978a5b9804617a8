"""Packing token pieces into sequences with a grouping genetic algorithm whose islands exchange their elites."""

from __future__ import annotations

import random
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.llm.shared import ranked, stash
from lattix.llm.tokens import with_ids

CAPACITY = 2048
#: Pieces that a group of islands packs together, on average.
BLOCK = 2048
ISLANDS = 3
EPOCHS = 3
POPULATION = 6
GENERATIONS = 16
#: Chance that a well-filled bin of the better parent is injected; emptiest bins that are opened besides.
INJECTED = 0.05
OPENED = 2
#: A child is mutated so many times at most, and until so many bring no gain: so many of its emptiest bins and as many
#: others are opened and packed again.
MUTATIONS, IDLE, REPACKED = 48, 10, 16
#: Bins of more documents exchange single ones only; more displaced ones than this are not tried in pairs.
PAIRED_BIN, PAIRED_LOOSE = 8, 64
#: An island's turn ends after so many generations without a gain.
PATIENCE = 6
#: Sequences that are filled less are opened and packed again with those of other blocks.
WELL_FILLED = 0.97
#: Such rounds at most; each has a few hundredths of the pieces of the one before.
ROUNDS = 4
#: The column of ``pieces`` that says where each stands.
PLACE = "__place"


#: A sequence in the making: how full it is, and its items.
Bin = tuple[int, list[int]]


def best_fit(sizes: list[int], items: list[int], bins: list[Bin], capacity: int) -> list[Bin]:
    """Add ``items`` in their order, each to the fullest bin with room for it. ``mask`` has a bit for each room that some bin has."""
    by_room: dict[int, list[list[int]]] = {}
    mask = 0
    for fill, b in bins:
        by_room.setdefault(capacity - fill, []).append(b)
        mask |= 1 << capacity - fill
    for i in items:
        s = sizes[i]
        if above := mask >> s:
            room = s + (above & -above).bit_length() - 1
            same = by_room[room]
            b = same.pop()
            if not same:
                mask ^= 1 << room
        else:
            b, room = [], capacity
        b.append(i)
        room -= s
        by_room.setdefault(room, []).append(b)
        mask |= 1 << room
    return [(capacity - room, b) for room, same in by_room.items() for b in same]


def fitness(bins: list[Bin], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then uneven fill: full bins beside empty ones leave more to gain."""
    return -len(bins), sum([fill * fill for fill, _ in bins]) / capacity**2


def exchange(sizes: list[int], bins: list[Bin], loose: list[int], capacity: int, rng: random.Random) -> list[int]:
    """Displaced documents, one or two, take the place of one or two smaller ones of a bin where that fills it further.

    ``bins`` change in place; returns what is displaced now, smaller in sum by all that the bins gained.
    """
    held = sorted((sizes[i], i) for i in loose)
    order = list(range(len(bins)))
    rng.shuffle(order)
    for k in order:
        fill, b = bins[k]
        room = capacity - fill
        if not room:
            continue
        if not held:
            break
        outs = [(sizes[i], (i,)) for i in b]
        if len(b) <= PAIRED_BIN:
            outs += [(sizes[x] + sizes[y], (x, y)) for n, x in enumerate(b) for y in b[:n]]
        gain, out, into = 0, (), ()
        for size, candidate in outs:
            at = bisect_right(held, (size + room, len(sizes))) - 1
            if at >= 0 and held[at][0] - size > gain:
                gain, out, into = held[at][0] - size, candidate, (at,)
            low, high = 0, len(held) - 1 if len(held) <= PAIRED_LOOSE else 0
            while low < high and gain < room:
                more = held[low][0] + held[high][0] - size
                if more > room:
                    high -= 1
                    continue
                if more > gain:
                    gain, out, into = more, candidate, (low, high)
                low += 1
            if gain == room:
                break
        if gain:
            bins[k] = fill + gain, [i for i in b if i not in out] + [held[x][1] for x in into]
            for x in reversed(into):
                del held[x]
            for i in out:
                insort(held, (sizes[i], i))
    return [i for _, i in held]


def cross(sizes: list[int], base: list[Bin], donor: list[Bin], capacity: int, rng: random.Random) -> list[Bin]:
    """Inject whole well-filled bins of ``donor`` into ``base``: bins with a duplicate go, and so do the emptiest (mutation).

    What they held besides is displaced: it first replaces smaller documents of bins that it fills further, and what
    is left is best-fitted in descending order.
    """
    ranked = sorted(donor, key=lambda b: -b[0])
    injected = [b for b in ranked[: max(1, len(ranked) // 2)] if rng.random() < INJECTED] or ranked[:1]
    taken = {i for _, b in injected for i in b}
    whole, loose = [], []
    for bin_ in base:
        if taken.isdisjoint(bin_[1]):
            whole.append(bin_)
        else:
            loose.extend([i for i in bin_[1] if i not in taken])
    whole.sort(key=lambda b: b[0])
    for _, b in whole[:OPENED]:
        loose.extend(b)
    whole = whole[OPENED:]
    loose = exchange(sizes, whole, loose, capacity, rng)
    loose.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, loose, [(fill, b[:]) for fill, b in whole + injected], capacity)


def fullest(sizes: list[int], items: list[int], capacity: int) -> list[Bin]:
    """``items`` packed one bin after another: each gets the largest item left and those others that fill it furthest.

    Bit k of ``sums[n]`` says whether some of the first n others sum to k; they descend, so large ones are taken first.
    """
    items, bins = sorted(items, key=lambda i: -sizes[i]), []
    left = sum([sizes[i] for i in items])
    while left > capacity:
        first, others = items[0], items[1:]
        room = capacity - sizes[first]
        within, sums = (1 << room + 1) - 1, [1]
        for i in others:
            sums.append((sums[-1] | sums[-1] << sizes[i]) & within)
            if sums[-1] >> room:
                break
        n, more = len(sums) - 1, sums[-1].bit_length() - 1
        left -= sizes[first] + more
        bins.append((sizes[first] + more, taken := [first]))
        apart = set()
        while more:
            n -= 1
            if not sums[n] >> more & 1:
                apart.add(n)
                taken.append(others[n])
                more -= sizes[others[n]]
        items = [i for k, i in enumerate(others) if k not in apart]
    return bins + [(left, items)] if items else bins


def mutate(sizes: list[int], bins: list[Bin], enough: int, capacity: int, rng: random.Random, times: int = MUTATIONS) -> list[Bin]:
    """Open ``REPACKED`` of the emptiest bins and as many others, and pack what they held again by ``fullest``, some ``times``.

    Room gathers so in few bins, until one is spared. What needs more bins than before is undone; ends at ``enough``
    or after ``IDLE`` times without better ``fitness``.
    """
    best, idle = fitness(bins, capacity), 0
    for _ in range(times):
        if len(bins) <= enough or idle == IDLE:
            break
        bins.sort(key=lambda b: b[0])
        least = min(REPACKED, len(bins))
        opened = {*range(least), *rng.sample(range(least, len(bins)), min(REPACKED, len(bins) - least))}
        again = fullest(sizes, [i for k in sorted(opened) for i in bins[k][1]], capacity)
        if len(again) <= len(opened):
            bins = [b for k, b in enumerate(bins) if k not in opened] + again
        score = fitness(bins, capacity)
        best, idle = (score, 0) if score > best else (best, idle + 1)
    return bins


def least_bins(sizes: list[int], capacity: int = CAPACITY) -> int:
    """So many bins are needed for certain: by the sum of sizes, and for each least size, since items over half need one
    each, and those of that size or more only fit beside such as leave them room."""
    s = np.sort(np.array(sizes, np.int64))
    upto = np.concatenate([[0], np.cumsum(s)])
    half = np.searchsorted(s, capacity // 2, "right")
    alpha = np.unique(s[:half])
    low, high = np.searchsorted(s, alpha), np.searchsorted(s, capacity - alpha, "right")
    beside = (high - half) * capacity - (upto[high] - upto[half])
    more = -((beside - (upto[half] - upto[low])) // capacity)
    by_size = len(s) - half + np.maximum(more, 0)
    return max(-(-int(upto[-1]) // capacity), len(s) - int(half), int(by_size.max(initial=0)))


def evolve(sizes: list[int], elites: list[list[list[int]]], seed: int, capacity: int = CAPACITY, population: int = POPULATION, generations: int = GENERATIONS, mutations: int = 0) -> list[list[int]]:
    """The best packing of items ``0..n-1`` that an island finds, from ``elites`` and best-fit packings in noisy descending order.

    Two parents are drawn, the better one is the donor; the child is mutated up to ``mutations`` times and takes the place of the worst if it is
    better than that and its fitness is new. Ends early where the best has as few bins as are needed for certain (``least_bins``),
    or after ``PATIENCE`` generations without a better best.
    """
    rng = random.Random(seed)
    full = [[i] for i, s in enumerate(sizes) if s >= capacity]
    rest = [i for i, s in enumerate(sizes) if s < capacity]
    enough = least_bins([sizes[i] for i in rest], capacity)
    people = [[(sum([sizes[i] for i in b]), b) for b in e if sizes[b[0]] < capacity] for e in elites]
    noise = 0.0 if not elites else 0.02 * len(people)
    while len(people) < population and not (people and len(people[-1]) <= enough):
        people.append(best_fit(sizes, sorted(rest, key=lambda i: -sizes[i] * (1 + noise * rng.random())), [], capacity))
        noise += 0.02
    scores = [fitness(p, capacity) for p in people]
    best, since = max(scores), 0
    while generations and since < PATIENCE and len(people) > 1 and -best[0] > enough:
        generations -= 1
        a, b = rng.sample(range(len(people)), 2)
        base, donor = (a, b) if scores[a] < scores[b] else (b, a)
        child = cross(sizes, people[base if rng.random() < 0.5 else donor], people[donor], capacity, rng)
        child = mutate(sizes, child, enough, capacity, rng, mutations)
        score, worst = fitness(child, capacity), min(range(len(people)), key=scores.__getitem__)
        if score > scores[worst] and score not in scores:
            people[worst], scores[worst] = child, score
        best, since = (score, 0) if score > best else (best, since + 1)
    return full + [b for _, b in people[max(range(len(people)), key=scores.__getitem__)]]


def _labels(n: int, bins: list[list[int]]) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(labels: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(labels, default=-1) + 1)]
    for i, k in enumerate(labels):
        out[k].append(i)
    return out


def _epoch(capacity: int, epoch: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, island, sizes, *elites = (batch.column(k)[i].as_py() for k in range(batch.num_columns))
                bins = evolve(sizes, [_bins(e) for e in elites if e is not None], hash((block, island, epoch)), capacity, mutations=MUTATIONS)
                solved = len(bins) <= least_bins(sizes, capacity)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([island], pa.int32()), pa.array([sizes], pa.list_(pa.int32())), pa.array([_labels(len(sizes), bins)], pa.list_(pa.int32())), pa.array([len(bins)], pa.int32()), pa.array([solved])], ["block", "island", "sizes", "elite", "bins", "solved"])

    return work


_STATE = "block long, island int, sizes array<int>, elite array<int>, bins int, solved boolean"


def _solve(blocks: DataFrame, n: int, capacity: int) -> DataFrame:
    """``n`` ``blocks(block, sizes)`` -> ``(block, elite)``: for each item its bin, from the best island.

    Blocks that an island packs in as few bins as are needed for certain leave the epochs, which end where none is left.
    The partitions are counted by work, not by bytes: few islands a task, though their rows are small.
    """
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    first = stash(blocks.select("block", F.lit(0).alias("island"), "sizes").repartition(max(1, -(-n // 4)), "block").mapInArrow(_epoch(capacity, 0), _STATE), "islands")
    over = first.where("not solved")
    done, state = first.select("block", "elite", "bins", "island"), None
    if not (left := over.count()):
        return done.select("block", "elite")
    tasks = max(1, -(-left * ISLANDS // 4))
    start = over.select("block", islands, "sizes", "elite").select("block", "island", "sizes", F.when(F.col("island") == 0, F.col("elite")).alias("elite"))
    for epoch in range(1, EPOCHS + 1):
        if state is None:
            asked = start
        else:
            open_ = state.groupBy("block").agg(F.max("solved").alias("any")).where("not any").select("block")
            migrants = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("migrant"))
            asked = state.join(open_, "block", "left_semi").join(migrants, ["block", "island"]).select("block", "island", "sizes", "elite", "migrant")
        state = stash(asked.repartition(tasks, "block", "island").mapInArrow(_epoch(capacity, epoch), _STATE), "islands")
        done = done.unionByName(state.select("block", "elite", "bins", "island"))
    return done.groupBy("block").agg(F.min_by("elite", F.struct("bins", "island")).alias("elite"))


def pack(pieces: DataFrame, size: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: each piece in a sequence of ``capacity`` at most, without gaps.

    Pieces are dealt to blocks by contiguous ranges of their order, some two thousand each: that of ``PLACE`` if they
    have it, else that of the rows. A block's islands hold populations of packings of the same pieces; between epochs
    each receives its neighbour's elite. Sequences under ``WELL_FILLED`` are opened and their pieces, in order, packed
    again in fewer blocks, until one block has them. A sequence has its pieces in order; sequences are numbered from 0
    by the mean rank of theirs. Only ranks and sizes take part; other columns are joined at the end. Sizes are from 1
    to ``capacity``, else the job fails. Repeated rows are packed one by one; an empty table gives an empty result.
    """
    names = [c for c in pieces.columns if c != PLACE]
    fits = F.assert_true(pieces[size].between(1, capacity), F.lit("a piece has no fitting size")).isNull()
    rows = F.struct(*(pieces[c] for c in names)).alias("row")
    place = F.col(PLACE) if PLACE in pieces.columns else F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at"), F.lit(0).alias("piece"))
    # Written with a number of its own, so that the pieces meet their places over one long.
    table = stash(pieces.where(fits).select(rows, place.alias("place"), F.monotonically_increasing_id().alias("key")), "pieces", "zstd")
    places = stash(ranked(table.select("place", "key", F.col(f"row.{size}").cast("int").alias("size")), ["place.file", "place.at", "place.piece"]).drop("place"), "pool")
    pool, done = places.select("rank", "size"), None
    for step in range(ROUNDS):
        count = pool.count()
        if not count and step:
            break
        n = max(1, -(-count // BLOCK))
        last = n == 1 or step == ROUNDS - 1
        numbered = pool.withColumn("at", F.col("rank")) if not step else ranked(pool.withColumnRenamed("rank", "first"), ["first"]).select(F.col("first").alias("rank"), "size", F.col("rank").alias("at"))
        dealt = numbered.withColumn("block", F.expr(f"at div {max(1, -(-count // n))}"))
        blocks = stash(dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("rank", "size"))).alias("rows")), "blocks")
        solved = _solve(blocks.select("block", F.col("rows.size").alias("sizes")), n, capacity)
        placed = blocks.join(solved, "block").select("block", F.explode(F.arrays_zip("rows", "elite")).alias("x")).select("block", "x.rows.rank", "x.rows.size", F.col("x.elite").alias("bin"))
        filled = F.expr("sum(size) over (partition by block, bin)")
        run = F.expr("sum(size) over (partition by block, bin order by rank rows between unbounded preceding and current row)")
        placed = stash(placed.repartition("block").withColumns({"filled": filled, "offset": run - F.col("size")}), "placed")
        well = F.lit(True) if last else F.col("filled") >= WELL_FILLED * capacity
        kept = placed.where(well).select("rank", F.lit(step).alias("step"), "block", "bin", "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        pool = stash(placed.where(~well).select("rank", "size"), "pool")
    key = ["step", "block", "bin"]
    order = ranked(done.groupBy(*key).agg(F.avg("rank").alias("mean")), ["mean", *key]).select(*key, F.col("rank").alias("sequence_id"))
    found = places.select("rank", "key").join(done.join(order, key), "rank").select("key", "sequence_id", F.col("offset").cast("long").alias("offset"))
    return table.join(found, "key").select(*(F.col("row").getField(c).alias(c) for c in names), "sequence_id", "offset")


def _place(docs: DataFrame) -> Column:
    """Where a row stands in the files that ``docs`` is read from; other tables are taken in the order of their rows."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        return F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at"))


def pieces(docs: DataFrame, path: str | None = None, end: int = 0, capacity: int = CAPACITY, keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids, *keep)`` and ``PLACE``: each document's ids, then ``end``, cut where longer than ``capacity``.

    ``ids`` are little-endian uint32 bytes. Null and empty texts are the end id alone. ``PLACE`` orders the pieces as
    the documents are: by file and row if they are read from files, else by row.
    """
    keep = keep or []
    encoded = with_ids(docs.select("doc_id", "text", _place(docs).alias(PLACE), *keep), path, end).drop("text")
    total = F.expr("octet_length(ids) div 4")
    cut = encoded.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(octet_length(ids) div 4 - 1) div {capacity}").cast("long"))).alias("piece"))
    start = F.col("piece") * capacity
    length = F.least(F.lit(capacity).cast("long"), total.cast("long") - start)
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), start.alias("start"), length.alias("length"), F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"), *keep, F.struct(f"{PLACE}.file", f"{PLACE}.at", F.col("piece").cast("int").alias("piece")).alias(PLACE))


def pack_documents(docs: DataFrame, path: str | None = None, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` of ``docs`` with their token ids, packed: ``sequence_id`` and ``offset`` say where each goes.

    Rows of null or repeated ids are packed like others. Other columns are ignored, whatever their names.
    """
    return pack(pieces(docs, path, end, capacity), capacity=capacity)
