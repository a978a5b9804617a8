"""Variants of a spelling: words one edit apart, found by their rarest positional bigrams, and the form each goes back to.

All bigrams of the vocabulary are put in one order, rarest first. One edit touches two bigrams at most, so two words an
edit apart share one of the three rarest of each, at the place that the edit leaves or moves it to; only words that
meet there are compared.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.shared import bounded, stash

#: Code points and occurrences that a word needs; times that a form is more frequent than its variant; one run in so many is misspelt.
LEAST_LENGTH, LEAST_COUNT, TIMES, MISSPELT = 7, 2, 10, 31
#: Bigrams of a word that are joined: one more than an edit can touch.
PREFIX = 3
#: Entries of a task's counts before they are handed on, and words whose bigrams are ordered at once.
ENTRIES, WORDS = 1 << 18, 1 << 14
#: A bit for each letter; some share one.
_BITS = np.zeros(256, np.int64)
_BITS[[*range(97, 123), *range(0xC0, 256)]] = [1 << k % 63 for k in range(90)]
#: A-Z lower-cased, a-z and the letters from C0 to FF of Latin-1 as they are, all else a space.
_RUNS = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch], misspelt: int, least: int) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            seed = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
            # Each character beyond Latin-1 becomes a question mark, which parts runs as it does.
            for run, n in Counter((text.as_py() or "").encode("latin-1", "replace").translate(_RUNS).split()).items():
                if len(run) < least:
                    continue
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed) if misspelt else 1
                if misspelt and h % misspelt == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < least:
                        continue
                found[run] += n
            if len(found) >= ENTRIES:
                yield rows()
                found = Counter()
    if found:
        yield rows()


def word_counts(docs: DataFrame, misspelt: int = 0, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Whole documents -> ``(word, n)``: runs of A-Z, a-z and C0-FF with A-Z lower-cased, of enough code points and occurrences.

    ``misspelt`` deletes one code point from about one in so many kinds of run a document, by a checksum of its id (null: empty) and the run.
    Null texts have no words. Each task counts its documents before anything is shuffled.
    """
    parts = bounded(docs).select("doc_id", "text").mapInArrow(lambda batches: _counted(batches, misspelt, least_length), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of Latin-1 characters: the code of each bigram, its place in the word, and each word's number of bigrams."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    inner = np.flatnonzero(place < np.repeat(sizes, sizes) - 1)
    return flat[inner] << 8 | flat[inner + 1], place[inner], sizes - 1


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, WORDS):
            total += np.bincount(_grams(batch.column(0)[at : at + WORDS])[0], minlength=1 << 16)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])


def _rarest(batches: Iterator[pa.RecordBatch], order: np.ndarray, prefix: int) -> Iterator[pa.RecordBatch]:
    """The first bigrams of each word in the global order (equal ones by place): ``(word, n, length, odd, gram, place)``.

    ``odd`` has the bits of the letters that a word has an odd number of: one edit changes two of them at most.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, WORDS):
            part = batch.slice(at, WORDS)
            gram, place, sizes = _grams(part.column(0))
            letters = np.frombuffer("".join(part.column(0).to_pylist()).encode("latin-1"), np.uint8)
            odd = np.bitwise_xor.reduceat(_BITS[letters], np.cumsum(sizes + 1) - sizes - 1)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            ordered = np.lexsort((place, order[gram], owner))
            first = ordered[np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < prefix]
            of = pa.array(owner[first])
            columns = [part.column(0).take(of), part.column(1).take(of), pa.array((sizes[owner[first]] + 1).astype(np.int32)), pa.array(odd[owner[first]]), pa.array(gram[first].astype(np.int32)), pa.array(place[first].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "length", "odd", "gram", "place"])


def near_words(words: DataFrame) -> DataFrame:
    """``words(word, n)`` of at least four Latin-1 characters each -> ``(a, n_a, b, n_b)``, each two that differ by one code point, once.

    The order of bigrams goes to the driver and to tasks: it has 65,536 entries at most, one for each two characters.
    Of two words of a length a shared bigram stands at the same place, else at the same or the next in the longer one;
    a bigram's words meet in a join that can be split, and no list of them is made. Two that meet are first held
    against one another by the letters that they have an odd number of, a comparison of two numbers.
    """
    counts = words.select("word").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    order = np.zeros(1 << 16, np.int64)
    for k, row in enumerate(sorted(counts, key=lambda r: (r["n"], r["gram"]))):
        order[row["gram"]] = k
    rare = stash(words.select("word", "n").mapInArrow(lambda batches: _rarest(batches, order, PREFIX), "word string, n long, length int, odd long, gram int, place int"), "bigrams")
    met = [F.struct(F.lit(d).alias("longer"), (F.col("length") + d).alias("length"), (F.col("place") + m).alias("place")) for d, m in ((0, 0), (1, 0), (1, 1))]
    sought = rare.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("odd").alias("odd_a"), "gram", F.explode(F.array(*met)).alias("at")).select("a", "n_a", "odd_a", "gram", "at.*")
    found = sought.join(rare.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("odd_b"), "gram", "length", "place"), ["gram", "length", "place"])
    close = F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2 - F.col("longer")
    found = found.where(F.when(close, (F.col("longer") == 1) | (F.col("a") < F.col("b"))).otherwise(False)).where(F.when(close, F.levenshtein("a", "b", 1) == 1).otherwise(False))
    return found.select("a", "n_a", "b", "n_b").distinct()


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``words(word, n)`` -> ``(word, form, root, n, n_near, form_n)``, a row for each word.

    ``form`` is the most frequent near word (of equals the first in code-point order) if it is ``times`` as frequent,
    else null; ``root`` is where forms lead, the word itself if it has none. Counts grow ``times``-fold a step, so
    chains are short; they are followed by doubling, one join a round, and each round is written.
    """
    pairs = stash(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n_near")))
    best = both.groupBy("word").agg(F.min(F.struct((-F.col("n_near")).alias("less"), "near")).alias("best"), F.count("*").alias("n_near"))
    placed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best"))
    placed = stash(placed.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n")), "forms")
    links = stash(placed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stash(links.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return placed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, misspelt: int = 0) -> DataFrame:
    """``variants`` of the words of whole documents; an empty table, or one without words, gives no rows."""
    return variants(stash(word_counts(docs, misspelt), "words"))
