"""The pipeline's near-dedup stage against planted copies and brute force."""

import numpy as np

import corpus_pipeline
from lattix.llm import simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_stage_drops_planted_copies_and_keeps_the_rest(spark, sf):
    rng = np.random.default_rng(3)
    rows, copies, clean = [], set(), set()
    for k in range(60):
        words = [f"v{x}" for x in rng.integers(0, 5000, 300)]
        far = words[:200] + [f"u{x}" for x in rng.integers(0, 5000, 100)]  # shares about half its shingles
        near = list(words)
        for at in rng.choice(300, 1 + k % 5, replace=False):
            near[at] = "changed"
        assert 0.8 <= jaccard(shingles(" ".join(words)), shingles(" ".join(near))) < 1
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
        copies.add(3 * k + 1)
        clean |= {3 * k, 3 * k + 2}
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.duplicates(spark, docs, sf).collect()} == clean


def test_similar_pairs_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {}
    for r in docs.where("text is not null and doc_id is not null").orderBy("doc_id").collect():
        sets.setdefault(frozenset(shingles(r.text)) if r.text.isascii() and r.text.strip() else None, r.doc_id)
    sets.pop(None, None)
    at = {}
    for s, d in sets.items():
        for x in s:
            at.setdefault(x, []).append((d, s))
    want = {(a, b) for group in at.values() if len(group) < 300 for a, s in group for b, t in group if a < b and jaccard(s, t) >= 0.8}
    got = {(r.a, r.b) for r in simhash.similar_pairs(docs)[1].collect()}
    ids = set(sets.values())
    assert want <= got and {(a, b) for a, b in got if a in ids and b in ids} == want


def test_a_large_group_makes_no_square_of_pairs(spark):
    rng = np.random.default_rng(4)
    base = [f"v{x}" for x in rng.integers(0, 5000, 400)]
    texts = [" ".join(base)]
    for _ in range(800):
        near = list(base)
        for at in rng.choice(400, 6, replace=False):
            near[at] = f"c{rng.integers(1 << 30)}"
        texts.append(" ".join(near))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one_similar(docs).collect()] == [0]
    assert simhash.keep_one_similar(docs.limit(0)).count() == 0
    assert simhash.similar_pairs(docs)[1].count() < 100 * len(texts)


def test_sets_of_one_band_that_no_hub_connects_are_all_found(spark, monkeypatch):
    """Forty families share a start that gives many the same band values; each family's copies are alike, families are not."""
    rng = np.random.default_rng(6)
    start, rows = [f"s{x}" for x in range(200)], []
    for f in range(40):
        own = [f"f{f}x{x}" for x in rng.integers(0, 10_000, 120)]
        for _ in range(6):
            near = list(own)
            near[int(rng.integers(0, 120))] = f"c{rng.integers(1 << 30)}"
            rows.append(" ".join(start + near))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    monkeypatch.setattr(simhash, "BUCKET", 3)
    monkeypatch.setattr(simhash, "TILE_SETS", 20)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets, kept = [shingles(t) for t in rows], []
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and jaccard(sets[i], sets[j]) >= 0.8:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    kept = sorted(set(group))
    assert sorted(r.doc_id for r in simhash.keep_one_similar(docs).collect()) == kept
