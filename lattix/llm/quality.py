"""Quality rules whose cutoffs adapt to each language and source by way of mergeable quantile sketches."""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.llm.shared import bounded, quoted, stash
from lattix.llm.tokens import batched

SYMBOLS = b"#*$%&|<>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
BLANK = re.compile(rb"[\x20\x09-\x0D]")
WINDOW = 5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Relative error of a sketch's quantiles.
ERROR = 0.005
#: By metric: the outer quantile, how many times its distance from the median a value may lie beyond it, and the sides that are watched.
#: Symbols and word lengths are steady within a group, so a tenth may be odd; repeats are rare and uneven, so only the last hundredth is.
RULES: Mapping[str, tuple[float, float, str]] = {"symbol_ratio": (0.9, 2.0, "above"), "dup_line_ratio": (0.99, 1.0, "above"), "repeat_ratio": (0.99, 1.0, "above"), "word_length": (0.9, 2.0, "both")}
#: A group's sketch counts its language's (whose counts the corpus') as so many documents besides its own.
PRIOR = 20.0
#: Standard errors by which a document's own ratio may miss the fence: short documents scatter more.
DOUBT = 2.0
#: Bytes that are split into words at once.
CHUNK = 1 << 20
_MIX = np.random.default_rng(5).integers(0, 1 << 63, WINDOW + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def _hashed(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order; a long text is cut at blanks, so its words don't pile up."""
    found, at = [], 0
    while at < len(raw):
        cut = BLANK.search(raw, at + CHUNK)
        end = cut.start() if cut else len(raw)
        words = raw[at:end].split()
        found.append(np.fromiter(map(hash, words), np.int64, len(words)))
        at = end
    return np.concatenate(found).view(np.uint64) if found else np.empty(0, np.uint64)


def measure_many(texts: list[str | None]) -> np.ndarray:
    """A row of ``STATS`` for each whole text; all zero for a null or empty one.

    Repeated words are those in windows of five words that are found twice or more in the text, the first included;
    windows are told apart by 64-bit hashes. Repeated lines have a word and equal an earlier line. Words are compared
    as they stand.
    """
    out, hashes = np.zeros((len(texts), len(STATS)), np.int64), []
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        hashes.append(_hashed(raw))
        blanks = len(raw) - len(raw.translate(None, SPACE))
        out[k] = len(hashes[-1]), len(text or "") - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), 0, len(lines)
    words, sizes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64), out[:, 0]
    if len(words) >= WINDOW:
        owner = np.repeat(np.arange(len(texts)), sizes)
        n = len(words) - WINDOW + 1
        keys = owner[:n].astype(np.uint64) * _MIX[WINDOW]
        for k in range(WINDOW):
            keys += words[k : k + n] * _MIX[k]
        at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
        at = at[np.argsort(keys[at], kind="stable")]
        twin = keys[at][1:] == keys[at][:-1]
        again = at[np.append(twin, False) | np.append(False, twin)]
        edge = np.bincount(again, minlength=len(words) + 1) - np.bincount(again + WINDOW, minlength=len(words) + 1)
        out[:, 4] = np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=len(texts))
    return out


def with_stats(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with a struct of ``STATS`` (long) of each whole text."""

    @F.arrow_udf(", ".join(f"{k} long" for k in STATS))
    def of(texts: pa.Array) -> pa.Array:
        rows = np.concatenate([np.empty((0, len(STATS)), np.int64), *map(measure_many, batched(texts))])
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(STATS))], STATS)

    return bounded(docs).withColumn(out, of(F.col(text)))


def base_failed(s: str = "stats"):
    """Too short, or over a fifth of the words in repeated windows: holds at any distribution."""
    return (F.col(f"{s}.n_words") < 10) | (100 * F.col(f"{s}.n_repeat_words") > 20 * F.col(f"{s}.n_words"))


def metrics(s: str = "stats") -> dict:
    """The adaptive metrics as columns; null without words or lines."""
    words, lines = F.nullif(F.col(f"{s}.n_words"), F.lit(0)), F.nullif(F.col(f"{s}.n_lines"), F.lit(0))
    return {"symbol_ratio": F.col(f"{s}.n_symbols") / words, "dup_line_ratio": F.col(f"{s}.n_dup_lines") / lines, "repeat_ratio": F.col(f"{s}.n_repeat_words") / words, "word_length": F.col(f"{s}.word_chars") / words}


def sketch(values: DataFrame, keys: list[str], value: str = "value", error: float = ERROR) -> DataFrame:
    """Quantile sketches as rows ``(*keys, bucket, n)``: counts in buckets whose width is a fixed share of the value.

    Bucket b holds values in (g**(b-1), g**b], g = (1 + error) / (1 - error); values up to 1e-6 share the least
    bucket. Counts add, so sketches of parts, groups and days merge exactly, in any order, with the same result, and a
    sketch has no more rows than buckets (about 1,400 for values up to 1e6 at 1 %).
    """
    growth = (1 + error) / (1 - error)
    bucket = F.ceil(F.log(F.greatest(F.col(value), F.lit(1e-6))) / F.log(F.lit(growth))).cast("int").alias("bucket")
    return values.where(F.col(value).isNotNull()).groupBy(*keys, bucket).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches to the coarser ``keys``."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], at: Mapping[str, float], error: float = ERROR) -> DataFrame:
    """``(*keys, total, *names)``: quantiles of each sketch, within ``error`` of the value at that rank."""
    growth = (1 + error) / (1 - error)
    by = Window.partitionBy(*keys)
    ranked = sketches.withColumn("below", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    value = F.when(F.col("bucket") <= F.ceil(F.log(F.lit(1e-6)) / F.log(F.lit(growth))), 0.0).otherwise(2 * F.pow(F.lit(growth), F.col("bucket")) / (growth + 1))
    return ranked.withColumn("value", value).groupBy(*keys).agg(F.max("total").alias("total"), *(F.min(F.when((F.col("below") >= q * F.col("total") * (1 - 1e-12)) & (F.col("n") > 0), F.col("value"))).alias(name) for name, q in at.items()))


def blended(sketches: DataFrame, prior: float = PRIOR) -> DataFrame:
    """Sketches ``(lang, source, metric, bucket, n)`` of each group, to which its language's count as ``prior`` documents.

    The language's sketch is blended with the corpus' in the same way. So a large group goes by its own values, one of
    a few documents by its language's, and there is no size at which one takes the place of the other.
    """
    lang, whole = ["lang", "metric"], ["metric"]
    tongue = merged(sketches, lang)

    def weighted(fine: DataFrame, keys: list[str], coarse: DataFrame, to: list[str]) -> DataFrame:
        total = coarse.groupBy(*to).agg(F.sum("n").alias("total"))
        groups = fine.select(*keys).distinct().withColumnsRenamed({k: f"g_{k}" for k in keys})
        above = coarse.join(total.withColumnsRenamed({k: f"t_{k}" for k in to}), _same(to, "", "t_")).withColumn("n", F.coalesce(F.try_divide(prior * F.col("n"), F.col("total")), F.lit(0.0)))
        lent = groups.join(above, _same(to, "g_", "")).select(*(F.col(f"g_{k}").alias(k) for k in keys), "bucket", "n")
        return merged(fine.unionByName(lent), keys)

    return weighted(sketches, ["lang", "source", "metric"], weighted(tongue, lang, merged(tongue, whole), whole), lang)


def _same(keys: list[str], one: str, two: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{one}{k}").eqNullSafe(F.col(f"{two}{k}"))
    return same


def thresholds(docs: DataFrame, rules: Mapping[str, tuple[float, float, str]] = RULES, prior: float = PRIOR, error: float = ERROR) -> DataFrame:
    """``(lang, source, <metric>_low, <metric>_high)`` from ``docs(lang, source, stats)``; null languages and sources are groups.

    From each group's sketch (``blended``) come the median and an outer quantile of each metric; a fence lies ``slack``
    times their distance beyond the outer one, a sketch's bucket at least. Documents that fail the base rules are left
    out of the sketches; a group without any other takes its language's, or the corpus', whole.
    """
    passing = docs.where(~base_failed())
    long = passing.select("lang", "source", F.explode(F.create_map(*(x for k, c in metrics().items() if k in rules for x in (F.lit(k), c)))).alias("metric", "value"))
    fine = stash(sketch(long, ["lang", "source", "metric"], error=error), "sketches")
    # Groups without a passing document have a sketch, too: a bucket of no weight.
    groups = docs.select("lang", "source").distinct().select("lang", "source", F.explode(F.array(*map(F.lit, rules))).alias("metric"), F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("n"))
    own = fine.unionByName(groups)
    levels = sorted({q for q, _, _ in rules.values()})
    at = {"middle": 0.5} | {f"h{i}": q for i, q in enumerate(levels)} | {f"l{i}": 1 - q for i, q in enumerate(levels)}
    found = quantiles(stash(blended(own, prior), "blended"), ["lang", "source", "metric"], at, error)
    bounds = []
    for k, (q, slack, side) in rules.items():
        middle, i = F.col("middle"), levels.index(q)
        high, low = F.col(f"h{i}"), F.col(f"l{i}")
        bucket = 2 * error * middle
        if side == "both":
            bounds.append(F.max(F.when(F.col("metric") == k, low - F.greatest(slack * (middle - low), bucket))).alias(f"{k}_low"))
        bounds.append(F.max(F.when(F.col("metric") == k, high + F.greatest(slack * (high - middle), bucket))).alias(f"{k}_high"))
        if k == "word_length":
            bounds.append(F.max(F.when(F.col("metric") == k, middle)).alias(f"{k}_middle"))
    return found.groupBy("lang", "source").agg(*bounds)


def judge(docs: DataFrame, bounds: DataFrame, rules: Mapping[str, tuple[float, float, str]] = RULES, doubt: float = DOUBT) -> DataFrame:
    """``docs`` (with ``stats``) joined with its group's thresholds: the columns ``base_failed`` and ``kept`` are added.

    A document is out if its metric lies beyond the fence by more than ``doubt`` standard errors of its own: the root
    of its count for ratios of counts, half of the group's word length over the root of its words for word lengths.
    """
    stat = lambda k: F.col(f"stats.{k}")
    inside = F.lit(True)
    for k, (count, base) in {"symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words")}.items():
        if k in rules:
            inside = inside & F.coalesce(stat(count) - doubt * F.sqrt(stat(count)) <= F.col(f"{k}_high") * stat(base), F.lit(True))
    if "word_length" in rules:
        length, error = metrics()["word_length"], F.try_divide(doubt / 2 * F.col("word_length_middle"), F.sqrt(stat("n_words")))
        inside = inside & F.coalesce((length - error <= F.col("word_length_high")) & (length + error >= F.col("word_length_low")), F.lit(True))
    bounds = bounds.withColumnsRenamed({"lang": "b_lang", "source": "b_source"})
    joined = docs.join(bounds, docs["lang"].eqNullSafe(bounds["b_lang"]) & docs["source"].eqNullSafe(bounds["b_source"]), "left")
    failed = base_failed()
    return joined.select(*(docs[c] for c in docs.columns), failed.alias("base_failed"), (~failed & inside).alias("kept"))


def quality_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines)`` for every row.

    Null and empty texts have no words and fail; repeated rows are judged alike, each counted in the sketches; null
    languages and sources are groups of their own; other columns are ignored. An empty table gives an empty result.
    """
    stats = stash(with_stats(docs.select("doc_id", "lang", "source", "text")).drop("text"), "stats")
    bounds = stash(thresholds(stats), "thresholds")
    *first, lines = STATS
    return judge(stats, bounds).select("doc_id", *(F.col(f"stats.{k}").alias(k) for k in first), "base_failed", "kept", F.col(f"stats.{lines}").alias(lines))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever else these are named.

    Whole texts are measured once and written beside their measures; the thresholds and the filter read that table.
    Null and empty texts go, repeated rows go or stay together; an empty table gives an empty result.
    """
    names = docs.columns
    whole = docs.select("lang", "source", "text", F.struct(*map(quoted, names)).alias("row"))
    table = stash(with_stats(whole).drop("text"), "measured")
    bounds = stash(thresholds(table.select("lang", "source", "stats")), "thresholds")
    return judge(table, bounds).where("kept").select(*(F.col("row").getField(c).alias(c) for c in names))
