"""Quotation linking: quoted passages are joined by hash to the messages they come from, which orders replies."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.shared import bounded, ranked, stash

MARKS = re.compile(r"[ \t]*((?:>[ \t]*)+)(.*)", re.S)
ATTRIBUTION = re.compile(r"(?i)\s*(on\b.*\bwrote|.*\bschrieb|le\b.*\ba écrit|.*\bescribió)\s*:\s*")
#: Tags that open and close a quote, and lines after which all is one.
TAG = re.compile(r"(?i)\[(/?)quote\b[^\]\n]*\]")
BELOW = re.compile(r"(?i)\s*-{2,}\s*(original message|forwarded message|ursprüngliche nachricht|message d'origine|mensaje original)\s*-{2,}\s*")
PARSED = "own string, n_quotes int, passages array<struct<level:int,n:int,words:int,hash:long>>, own_hashes array<long>"


def normal(passage: str) -> str:
    """Lower case, white space as one blank, none at the ends."""
    return " ".join(passage.lower().split())


def digest(passage: str) -> int:
    return int.from_bytes(hashlib.blake2b(passage.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parse(text: str | None) -> tuple[str | None, list[tuple[int, list[str]]]]:
    """The text without quotes, and its quoted passages in order: their levels (1: one mark) and normalised lines.

    Levels add up over ``>`` marks, ``[quote]`` tags and the lines after which all is quoted. A passage is a run of
    lines of one level; a blank quoted line parts passages. A line before a quote that only says who wrote it belongs
    to the quote.
    """
    if text is None:
        return None, []
    own, passages, level_now, run, tags, below = [], [], 0, [], 0, 0

    def close():
        if lines := [x for line in run if (x := normal(line))]:
            passages.append((level_now, lines))
        run.clear()

    def feed(level, body):
        nonlocal level_now
        if level != level_now or (level and not body.strip()):
            close()
        if level and not level_now:
            while own and not own[-1].strip():
                own.pop()
            if own and ATTRIBUTION.fullmatch(own[-1]):
                own.pop()
        level_now = level
        (run if level else own).append(body)

    for line in text.split("\n"):
        found = MARKS.fullmatch(line)
        marks, body = (found[1].count(">"), found[2]) if found else (0, line)
        if BELOW.fullmatch(body):
            below += 1
            continue
        at, tagged = 0, False
        for tag in TAG.finditer(body):
            if body[at : tag.start()].strip():
                feed(marks + tags + below, body[at : tag.start()])
            tags, at, tagged = max(0, tags + (-1 if tag[1] else 1)), tag.end(), True
        if not tagged or body[at:].strip():
            feed(marks + tags + below, body[at:])
    close()
    return "\n".join(own).strip("\n"), passages


#: Words of a run that is a quote of another conversation however many have it.
OUTSIDE_WORDS = 5


def windows(lines: list[str]) -> list[tuple[int, int, int]]:
    """``(first, length, hash)`` of all runs of 1, 2, 4, ... of the lines: a run's hash is that of its halves'."""
    now, size, out = [digest(x) for x in lines], 1, []
    while now:
        out += [(i, size, h) for i, h in enumerate(now)]
        now = [digest(f"{a} {b}") for a, b in zip(now, now[size:])]
        size *= 2
    return out


def passage_hashes(lines: list[str]) -> list[tuple[int, int]]:
    """``(words, hash)`` by which a quoted passage is known: its runs of lines, and the whole of it however it is wrapped."""
    sizes = [len(x.split()) for x in lines]
    whole = " ".join(lines)
    return [(sum(sizes), digest(whole)), *((sum(sizes[i : i + n]), h) for i, n, h in windows(lines))]


def own_hashes(own: str | None) -> set[int]:
    """Hashes by which an author's own text is known: the whole, its paragraphs and its runs of lines that have a word."""
    if not own:
        return set()
    parts = [normal(own), *(normal(p) for p in re.split(r"\n[ \t]*\n", own))]
    lines = [x for line in own.split("\n") if (x := normal(line))]
    return {digest(p) for p in parts if p} | {h for *_, h in windows(lines)}


def _parsed(messages: DataFrame) -> DataFrame:
    @F.arrow_udf(PARSED)
    def of(texts: pa.Array) -> pa.Array:
        owns, counts, quoted, hashes = [], [], [], []
        for t in texts:
            own, passages = parse(t.as_py())
            owns.append(own)
            counts.append(len(passages))
            quoted.append([{"level": level, "n": n, "words": words, "hash": h} for n, (level, lines) in enumerate(passages) for words, h in passage_hashes(lines)])
            hashes.append(sorted(own_hashes(own)))
        kind = pa.list_(pa.struct([("level", pa.int32()), ("n", pa.int32()), ("words", pa.int32()), ("hash", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(owns, pa.string()), pa.array(counts, pa.int32()), pa.array(quoted, kind), pa.array(hashes, pa.list_(pa.int64()))], ["own", "n_quotes", "passages", "own_hashes"])

    return bounded(messages).withColumn("p", of(F.col("text"))).select("conv_id", "turn", "role", F.xxhash64("text").alias("th"), "p.own", "p.n_quotes", "p.passages", "p.own_hashes")


def _originals(rows: DataFrame) -> DataFrame:
    """``(rank, quoted)``: for each message with quotes that are found, the place of the message it quotes.

    A passage's hash keeps one original for each conversation and two for all, so a passage that thousands share makes
    no pairs. Words that anybody may write are no quote of another conversation: a run of under ``OUTSIDE_WORDS`` words
    counts there only if no other conversation has it, and one of a single word never.
    """
    quoted = rows.select("rank", "conv_id", F.explode("passages").alias("q")).select("rank", "conv_id", "q.*")
    place = F.struct("rank", "conv_id", "turn")
    held = rows.select("rank", "conv_id", "turn", F.explode("own_hashes").alias("hash")).join(quoted.select("hash").distinct(), "hash", "left_semi")
    own = stash(held.groupBy("conv_id", "hash").agg(F.min(place).alias("own")), "own")
    first = stash(own.groupBy("hash").agg(F.min("own").alias("first")), "first")
    others = own.join(first, "hash").where(F.col("conv_id") != F.col("first.conv_id")).groupBy("hash").agg(F.min("own").alias("second"))
    both = first.join(others, "hash", "left")
    found = quoted.join(own, ["conv_id", "hash"], "left").join(both, "hash", "left")
    inside = F.when(F.col("own.rank") < F.col("rank"), F.col("own"))
    told = (F.col("words") >= OUTSIDE_WORDS) | ((F.col("words") > 1) & F.col("second").isNull())
    outside = F.when(told, F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second")))
    found = found.withColumn("parent", F.coalesce(inside, outside)).where("parent is not null")
    return found.groupBy("rank").agg(F.min_by("parent", F.struct("level", -F.col("words"), "n", "parent.rank")).alias("quoted"))


def _before(rows: DataFrame) -> DataFrame:
    """``(rank, before)``: the first message of the turn before, found by rank, so that no conversation meets in one task."""
    slim = rows.select("rank", "conv_id", "turn")
    firsts = slim.groupBy("conv_id", "turn").agg(F.min("rank").alias("first"))
    at = stash(slim.join(firsts, ["conv_id", "turn"]), "turns")
    last = at.select(F.col("rank").alias("l_rank"), F.col("conv_id").alias("l_conv"), F.struct(F.col("first").alias("rank"), "conv_id", "turn").alias("before"))
    return at.join(last, (F.col("first") - 1 == F.col("l_rank")) & (F.col("conv_id") == F.col("l_conv"))).select("rank", "before")


def _roots(links: DataFrame) -> DataFrame:
    """``links(rank, place, parent, before)`` with ``root`` and ``depth``; where links run in a circle, some are replaced by ``before``."""
    parent = F.col("parent")
    up = stash(links.withColumns({"root": F.coalesce(parent, F.col("place")), "depth": parent.isNotNull().cast("int")}), "links")
    known, still, left = up.where("depth = 0").withColumn("open", F.lit(False)), up.where("depth > 0").withColumn("open", F.lit(True)), None
    while now := still.count():
        if now == left:  # no root was found in a round: the rest runs in circles
            later = F.col("parent.rank") > F.col("rank")
            cut = known.drop("open", "root", "depth").unionByName(still.drop("open", "root", "depth").withColumn("parent", F.when(later, F.col("before")).otherwise(parent)))
            return _roots(cut)
        left = now
        # Each round doubles the steps that a pointer spans; messages whose root is found leave the rounds.
        above = known.unionByName(still).where("depth > 0").select(F.col("rank").alias("at"), F.col("root").alias("higher"), F.col("depth").alias("more"), F.col("open").alias("on"))
        joined = still.join(above, F.col("root.rank") == F.col("at"), "left")
        moved = stash(joined.select("rank", "place", "parent", "before", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("on", F.lit(False)).alias("open")), "links")
        known, still = known.unionByName(moved.where("not open")), moved.where("open")
    return known.drop("open")


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message: ``(conv_id, turn, role, thread_conv, thread_turn, parent_conv, parent_turn, depth, n_quotes, text)``.

    A quoted passage is known by its whole and by its runs of 1, 2, 4, ... lines, normalised in case and white space; an
    original by its whole, its paragraphs and such runs of its author's own lines. A message's parent is the original
    of what it quotes at the lowest level that is found anywhere, there of the run with most words, then the first: the
    first message of its own conversation before itself that has the run, else the first of another conversation, in
    order of (conv_id, turn), earlier or later, if the run has ``OUTSIDE_WORDS`` words, or two and stands in no third one. Without a quote that is found it replies to the first message of the
    turn before it in its conversation. ``thread_*`` names the root, ``depth`` the steps to it, ``text`` is without
    quotes. Where parents run in a circle, or into one, links to later (conv_id, turn) give way to the turn before.

    Rows equal in conv_id, turn, role and text are one message; others of one (conv_id, turn) are messages of their
    own, ordered by role and a hash of the text. Rows with a null conv_id or turn link to nothing and nothing to them:
    they are roots of depth 0. Null texts stay null; empty ones have no passages. Other columns are ignored. An empty
    table gives an empty result.
    """
    whole = stash(_parsed(messages.select("conv_id", "turn", "role", "text").distinct()), "parsed")
    null = F.lit(None).cast("long")
    loose = whole.where("conv_id is null or turn is null").select("conv_id", "turn", "role", F.col("conv_id").alias("thread_conv"), F.col("turn").alias("thread_turn"), null.alias("parent_conv"), null.alias("parent_turn"), F.lit(0).alias("depth"), "n_quotes", F.col("own").alias("text"))
    rows = ranked(whole.where("conv_id is not null and turn is not null"), ["conv_id", "turn", "role", "th"])
    place = F.struct("rank", "conv_id", "turn")
    links = rows.select("rank", place.alias("place")).join(_originals(rows), "rank", "left").join(_before(rows), "rank", "left")
    up = _roots(links.select("rank", "place", F.coalesce("quoted", "before").alias("parent"), "before"))
    done = rows.select("rank", "conv_id", "turn", "role", "own", "n_quotes").join(up, "rank")
    return done.select("conv_id", "turn", "role", F.col("root.conv_id").alias("thread_conv"), F.col("root.turn").alias("thread_turn"), F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"), "depth", "n_quotes", F.col("own").alias("text")).unionByName(loose)


def reply_order(linked: DataFrame) -> DataFrame:
    """The messages with their ``position`` from 0: thread by thread, each from its root to its leaves by depth and place.

    Positions stay when the rows are written or shuffled. They come from the rows' places in a table that is sorted and
    written, so no task has a whole thread.
    """
    return ranked(linked, ["thread_conv", "thread_turn", "depth", "conv_id", "turn", "role", "text"]).withColumnRenamed("rank", "position")
