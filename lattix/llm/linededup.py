"""Line dedup: repeated runs of lines, found with ranks by prefix doubling; the later copies are deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.llm.shared import WORD, packed, quoted, stash, unpacked

#: A run is deleted where it repeats if it has so many words.
MIN_WORDS = 50
#: What lines are trimmed of.
SPACE = " \t\n\x0b\x0c\r"
KEY = ["id", "th"]


def _ranked(keys: DataFrame, names: list[str], out: str) -> DataFrame:
    """Ranks for the distinct ``names`` that occur twice or more, increasing in their sorted order.

    A range shuffle sorts the distinct keys, whose position gives the rank: no key repeats, so no partition can be hot.
    Written before it is used, so that every later reader sees the same ranks.
    """
    twice = keys.where(" and ".join(f"{n} is not null" for n in names)).groupBy(*names).agg(F.count("*").alias("times")).where("times > 1")
    return stash(twice.orderBy(*names).select(*names, F.monotonically_increasing_id().alias(out)), "ranks")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, th, start, length, numbers)``: runs of lines of ``docs(id, th, lines)`` that an earlier place of the corpus has too.

    ``lines`` are the trimmed lines with a word and their line numbers, ``(id, th)`` names and orders the documents. Ranks of blocks of 1, 2,
    4, ... lines come by prefix doubling: the rank of a block is that of its halves' ranks sorted as pairs; runs end with
    their document. Blocks that occur once have no rank and drop out. No order of whole suffixes and no lengths of
    common prefixes are made: doubling ends at the lines that hold ``min_words`` words, and all places that share d
    lines from there are known by the ranks of the two blocks that cover these. At each line start the pieces just long enough for ``min_words`` words, forward and
    backward, are formed, and all places but the earliest of a piece are returned. Any repeated run of ``min_words``
    words is the union of such pieces, so their union is that of the maximal repeated runs; a line has a word at
    least, so a piece has no more than ``min_words`` lines.
    """
    lines = docs.select("id", "th", F.posexplode("lines").alias("at", "x")).select("id", "th", "at", "x.ln", "x.line")
    lines = stash(lines.select("id", "th", "at", "ln", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), F.regexp_count("line", F.lit(WORD)).alias("w")), "lines")
    live = lines.join(_ranked(lines, ["h1", "h2"], "r0"), ["h1", "h2"])
    doc = Window.partitionBy(*KEY)
    live = live.repartition(*KEY).dropDuplicates([*KEY, "at"])  # repeated rows; the windows reuse this shuffle
    live = live.select("id", "th", "at", "ln", "w", "r0", (F.col("at") - F.row_number().over(doc.orderBy("at"))).alias("run"))
    run = Window.partitionBy(*KEY, "run")
    live = live.withColumn("words", F.sum("w").over(run)).where(F.col("words") >= min_words).drop("words")
    live = stash(live.withColumn("cum", F.sum("w").over(run.orderBy("at"))), "live")

    ahead, behind = run.orderBy("at").rowsBetween(0, min_words - 1), run.orderBy("at").rowsBetween(1 - min_words, 0)
    need = F.col("cum") - F.col("w") + min_words
    forward = F.size(F.filter(F.collect_list("cum").over(ahead), lambda c: c < need)) + 1
    fits = F.sum("w").over(ahead) >= min_words
    longest = live.select(F.when(fits, forward).alias("n")).agg(F.max("n")).first()[0] or 0
    back = live.select(F.when(F.sum("w").over(behind) >= min_words, F.size(F.filter(F.collect_list(F.col("cum") - F.col("w")).over(behind), lambda c: c > F.col("cum") - min_words)) + 1).alias("n")).agg(F.max("n")).first()[0] or 0
    levels = max(longest, back, 1).bit_length()
    for k in range(1, levels):
        paired = live.withColumn("next", F.lead(f"r{k - 1}", 2 ** (k - 1)).over(run.orderBy("at")))
        ranks = _ranked(paired, [f"r{k - 1}", "next"], f"r{k}")
        live = stash(paired.join(ranks, [f"r{k - 1}", "next"], "left").drop("next"), "live")

    cell = F.struct("cum", "w", "ln", *(f"r{k}" for k in range(levels)))
    seen = live.select("id", "th", "at", "cum", "w", fits.alias("f_ok"), (F.sum("w").over(behind) >= min_words).alias("b_ok"), F.collect_list(cell).over(ahead).alias("fw"), F.collect_list(cell).over(behind).alias("bw"))
    seen = seen.withColumn("f_n", F.size(F.filter("fw", lambda x: x["cum"] < need)) + 1).withColumn("b_n", F.size(F.filter("bw", lambda x: x["cum"] - x["w"] > F.col("cum") - min_words)) + 1)

    def piece(cells, first, n):
        """Names of the interval: ranks of the blocks at both ends of the ``n`` lines from ``first`` (1-based) in ``cells``."""
        left = right = F.lit(None).cast("long")
        for k in range(levels):
            here = (n >= 2**k) & (n < 2 ** (k + 1))
            left = F.when(here, F.try_element_at(cells, first)[f"r{k}"]).otherwise(left)
            right = F.when(here, F.try_element_at(cells, first + n - 2**k)[f"r{k}"]).otherwise(right)
        return left, right

    fl, fr = piece(F.col("fw"), F.lit(1), F.col("f_n"))
    bl, br = piece(F.col("bw"), F.size("bw") - F.col("b_n") + 1, F.col("b_n"))
    pieces = seen.where("f_ok").select("id", "th", F.col("at").alias("start"), F.col("f_n").alias("length"), fl.alias("left"), fr.alias("right"), F.slice("fw", 1, F.col("f_n"))["ln"].alias("numbers"))
    pieces = pieces.unionByName(seen.where("b_ok").select("id", "th", (F.col("at") - F.col("b_n") + 1).alias("start"), F.col("b_n").alias("length"), bl.alias("left"), br.alias("right"), F.slice("bw", -F.col("b_n"), F.col("b_n"))["ln"].alias("numbers")))
    pieces = stash(pieces.where("left is not null and right is not null"), "pieces")
    name, place = ["length", "left", "right"], F.struct("id", "th", "start")
    # Written first: beside a plain table, Spark can split the other side where many places share an interval.
    first = pieces.groupBy(*name).agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    first = stash(first, "intervals")
    return pieces.join(first, name).where(~place.eqNullSafe(F.col("first"))).select("id", "th", "start", "length", "numbers")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` less its repeated runs of lines, and ``n_lines``, ``removed`` (line numbers from 0) beside it.

    A run of successive lines of ``min_words`` words or more that stands earlier in the corpus (documents in ascending
    id, null first, then by text hash; lines in order) is deleted, in whole; the first copy stays. Lines are compared
    trimmed; lines without a word are neither compared nor deleted, and don't break a run. A document repeats its own
    earlier runs, too. Rows that repeat both id and text are one document: each returns the same result. Null texts
    stay null with no lines, empty texts have one line. Other columns pass; those of the names of the two added ones, or
    of names beginning with ``__``, are refused (``drop_repeated`` takes any). An empty table gives an empty result.
    """
    if clash := [c for c in docs.columns if c.startswith("__") or c.lower() in ("n_lines", "removed")]:
        raise ValueError(f"columns {clash} would clash with those that are added")
    keyed = docs.withColumn("__th", F.xxhash64(F.col(text)))
    cut = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("ln"), F.btrim(x, F.lit(SPACE)).alias("line")))
    slim = keyed.select(F.col(id).alias("id"), F.col("__th").alias("th"), F.filter(cut, lambda x: x["line"] != "").alias("lines"))
    runs = repeated_runs(slim.where(F.size("lines") > 0), min_words)
    gone = runs.select("id", "th", F.explode("numbers").alias("ln")).distinct()
    gone = gone.groupBy("id", "th").agg(F.sort_array(F.collect_list("ln")).alias("__gone"))
    joined = keyed.join(gone, keyed[id].eqNullSafe(gone["id"]) & (keyed["__th"] == gone["th"]), "left").select(*(quoted(c) for c in keyed.columns), "__gone")
    # Exploded from an array of one, so that the split below is made once for a text, not once for each use.
    joined = joined.withColumn("__lines", F.explode(F.array(F.split(F.col(text), "\n"))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    out = F.when(F.col("__gone").isNotNull(), left).otherwise(F.col(text))
    count = F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).cast("long")
    return joined.select(*(out.alias(c) if c == text else quoted(c) for c in docs.columns), count.alias("n_lines"), F.coalesce("__gone", F.array().cast("array<int>")).alias("removed"))


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with deduplicated texts and ``n_chars`` to match; documents that lose their last word are dropped.

    Other columns pass, whatever their names.
    """
    done = dedup_lines(packed(docs, "doc_id", "text"), min_words)
    left = done.where((F.size("removed") == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        counted = F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
        left = left.withColumn("row", F.col("row").withField("n_chars", counted))
    return unpacked(left, docs.columns, "doc_id", "text")
