"""How the sources of a language differ in their words: an audit from smoothed shares of terms, exact in whole numbers.

A pair of sources starts from its baseline, what it would differ by if neither had any kept term: V times the
difference of their shares of zero counts. An inverted index then emits corrections only: each group's distinct shares
correct the pairs in which the other source lacks the term, and the postings of a term correct the pairs that share it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.llm.shared import bounded, stash

#: Documents of a language that a term needs, pseudo-counts of each term, parts that a share is counted in, ranks of terms that are kept.
LEAST_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Entries of a task's counts before they are handed on.
ENTRIES = 1 << 18
_KEPT = {c for c in range(256) if c >= 128 or chr(c).isalpha()}
#: ASCII letters lower-cased, other ASCII a space, bytes of other characters as they are.
_LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if c in _KEPT else 32 for c in range(256))
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> pa.RecordBatch:
        flat = [(lang, source, term.decode(), n, docs[term]) for (lang, source), (total, docs) in found.items() for term, n in total.items()]
        flat += [(lang, source, "", 0, 0) for lang, source in found]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), _FOUND.types)], schema=_FOUND)

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3))):
            total, docs = found.setdefault((lang.as_py() or "", source.as_py() or ""), (Counter(), Counter()))
            own = Counter((text.as_py() or "").encode().translate(_LETTERS).split())
            before = len(total)
            total.update(own)
            docs.update(own.keys())
            held += len(total) - before
            if held >= ENTRIES:
                yield rows()
                found, held = {}, 0
    if found:
        yield rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """Whole documents -> ``(lang, source, term, n, docs)``, and a row of the empty term with zeros for each group.

    Terms are runs of letters of A-Z, a-z and of all characters beyond ASCII; only A-Z are lower-cased. Null texts,
    languages and sources are empty strings. Each task counts its documents before anything is shuffled.
    """
    parts = bounded(docs).select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, v: str) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * v)), in decimals: counts of any table fit; null where there is no term."""
    wide = f"cast({UNIT} as decimal(10,0)) * cast({n} + {SMOOTH} as decimal(19,0))"
    return F.expr(f"1 + ({wide}) div cast({total} + {SMOOTH} * {v} as decimal(19,0))")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: in part ``pair`` how far each source is from each other one of its language,
    in part ``term`` the ``top`` terms that it uses more than its language does, ranked by value and then by item.

    Every group of documents is there, without terms too (its counts are zero); a language without kept terms has
    pairs of value 0; one with a single source has no pairs; an empty table gives no rows. Repeated rows count each.
    The counts are the only thing whose size depends on the corpus; what follows grows with vocabularies and sources.
    """
    counts = stash(term_counts(docs), "term-counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= least_docs)
    kept = stash(kept.select("lang", "term", "n_lang"), "terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    found = counts.where("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang")
    found = stash(found, "found")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "total_lang")))
    groups = stash(groups.withColumn("p0", F.when(F.col("v") > 0, _share("0", "total", "v")).otherwise(F.lit(0))), "groups")
    postings = found.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("n", "total", "v").alias("p"), _share("n_lang", "total_lang", "v").alias("q"), "p0")
    postings = stash(postings, "postings")
    terms = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    pairs = pair_values(postings, groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return terms.unionByName(pairs)


def pair_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, other, value)`` for each two sources of a language, both ways, from baselines and corrections.

    ``postings(lang, source, term, p, p0)`` has the terms that a group uses, ``groups(lang, source, v, p0)`` all groups.
    A term of ``source`` alone corrects a pair by |p - other's p0| - |p0 - other's p0|, which only depends on p: equal
    shares of a group are counted first. A term of both corrects what the two one-sided corrections left.
    """
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    base = F.abs(F.col("p0") - F.col("o0"))
    levels = postings.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("times"))
    alone = levels.join(other, "lang").where("source <> other").withColumn("value", F.col("times") * (F.abs(F.col("p") - F.col("o0")) - base)).where("value <> 0")
    one = alone.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), "value")
    mine = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("p0"))
    theirs = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("o0"))
    shared = mine.join(theirs, ["lang", "term"]).where("a < b")
    shared = shared.withColumn("value", F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("o0")) - F.abs(F.col("p0") - F.col("pb")) + base).where("value <> 0")
    begin = groups.select("lang", F.col("source").alias("a"), "v", "p0").join(other.withColumnRenamed("other", "b"), "lang").where("a < b").select("lang", "a", "b", (F.col("v") * base).alias("value"))
    total = begin.unionByName(one).unionByName(shared.select("lang", "a", "b", "value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("other")), F.struct(F.col("b").alias("source"), F.col("a").alias("other"))))
    return total.select("lang", both.alias("ab"), "value").select("lang", "ab.source", "ab.other", "value")
