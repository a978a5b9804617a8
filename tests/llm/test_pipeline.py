"""The pipeline's stages on a small table, each against its operator's own rules."""

import re

import corpus_pipeline
from lattix.llm import linededup, mixing, quality


def least_of_groups(docs):
    """The smallest id of each group of documents linked by sets of five-word shingles of similarity 0.8 or more."""
    sets = {}
    for r in docs.orderBy("doc_id").collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in r.text)) if w]
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    holders, group = {}, {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    root = lambda d: d if group[d] == d else root(group[d])
    met = set()
    for ids in holders.values():
        for i, d in enumerate(ids):
            for e in ids[:i]:
                if (d, e) not in met:
                    met.add((d, e))
                    if len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]):
                        a, b = sorted((root(d), root(e)))
                        group[b] = a
    return sorted({root(d) for d in sets})


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, rules), (_, lines), (_, duplicates), (_, mixture), (_, sequences) = corpus_pipeline.STAGES
    kept = {r.doc_id for r in quality.quality_report(docs).where("kept").collect()}
    a = rules(spark, docs, sf).cache()
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == kept
    b = lines(spark, a, sf).cache()
    assert b.columns == docs.columns and linededup.dedup_lines(b).where("size(removed) > 0").count() == 0
    c = duplicates(spark, b, sf).cache()
    assert c.columns == docs.columns and sorted(r.doc_id for r in c.collect()) == least_of_groups(b)
    d = mixture(spark, c, sf).cache()
    times = {}
    for r in d.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    visits = {r.doc_id: len(r.visits) for r in mixing.mix(c, cut_last=False).collect() if r.visits}
    assert d.columns == docs.columns and times == visits
    e = sequences(spark, d, sf).groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in e) <= 2048


def test_stages_on_odd_rows_and_an_empty_table(spark, sf):
    words = " ".join(f"word{k} is the {k * 7 % 31}th" for k in range(60))
    rows = [(1, words, "en", "a", 1, "x"), (1, words, "en", "a", 1, "x"), (2, None, "en", "a", None, "x"), (3, "", None, None, 0, None), (None, words + " tail", None, None, 3, None), (4, words.replace("word7", "other"), None, "b", 4, "y"), (5, " ".join(f"u{k % 5003}" for k in range(40_000)), "de", None, 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    for table, least in ((docs, 1), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, sf).cache()
            assert table.columns == docs.columns and table.count() >= least, name
        found = corpus_pipeline.sequences(spark, table, sf).collect()
        assert len(found) >= least and {r.doc_id for r in found} <= {None, 1, 4, 5}


def test_stages_pass_columns_of_any_name(spark, sf):
    words = " ".join(f"word{k} is the {k * 7 % 31}th" for k in range(60))
    names = ["removed", "n_lines", "a.b", "__th", "__lines", "row", "kept", "stats", "visits", "size", "node", "th", "x`y"]
    row = (1, words, "en", "a", 5, *(f"v{k}" for k in range(len(names))))
    docs = spark.createDataFrame([row, (2, words.replace("is", "was"), "en", "b", 6, *names)], ["doc_id", "text", "lang", "source", "n_chars", *names])
    table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, sf).cache()
        assert table.columns == docs.columns, name
    found = {r[0]: tuple(r)[5:] for r in table.collect()}
    assert found == {1: row[5:], 2: tuple(names)}
    assert corpus_pipeline.sequences(spark, table, sf).count() >= 2


def test_a_stage_deletes_what_those_before_it_left(spark, tmp_path):
    import os

    words = " ".join(f"word{k} is the {k * 7 % 31}th" for k in range(60))
    docs = spark.createDataFrame([(1, words, "en", "a", 5), (2, words + " more", "en", "b", 6), (None, words.replace("is", "was"), "de", None, 1), (None, words.replace("is", "be"), "de", None, 2), (3, words + " more", "en", "b", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [p.removeprefix("file://") for p in corpus_pipeline._left]
        docs = stage(spark, docs, "")
        assert k < 2 or before and not any(os.path.exists(p) for p in before), name
        assert all(os.path.exists(p.removeprefix("file://")) for p in corpus_pipeline._left)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "simhash near-dedup":
            assert sorted((r.doc_id for r in docs.collect()), key=str) == [1, None, None]
    assert docs.count() >= 3
