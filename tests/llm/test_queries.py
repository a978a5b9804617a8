"""The queries on small tables against plain Python, and those that SQL can express against SQL."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from lattix.llm import licenses, linededup, mixing, mtree, packing, quality, queries, quotes, render, simhash, tokenfiles
from lattix.llm.tokens import default_path
from tests.compare import assert_same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string"
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
RUN = "\n".join(" ".join(f"r{i}x{k}" for k in range(20)) for i in range(4))
EDGE = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 1, "x", "y"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 1, "x", "y"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 1, "x", "y"),
    (3, None, None, None, None, None, None),
    (4, "", "en", "b", 0, None, None),
    (5, " \t\n ", "en", None, 4, None, None),
    (6, LONG, "de", "b", 5, None, None),
    (7, f"start here\n{RUN}\nend", None, "c", 6, None, None),
    (8, f"other start\n\n{RUN}\nother end", "en", "c", 6, None, None),
    (None, "no id here", "en", "a", 9, None, None),
    (9, "ÀB Γδ é 中文 two", "fr", "d", 9, None, None),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_fingerprint(text):
    words = WORD.findall(low(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array([f for _, f in fps], np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3):
            x, y = find(i), find(i + 1 + int(j))
            parent[max(x, y)] = min(x, y)
    groups = {}
    for i, (d, _) in enumerate(fps):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(fps))]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


def test_simhash_query(spark, sf, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps)))
    assert want == sorted(map(tuple, queries.op1_simhash(spark, sf).collect()))


def test_simhash_edges(spark, edge):
    rows = [(r[0], r[1]) for r in EDGE]
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    want = sorted(((d, f, c) for (d, f), c in zip(fps, brute_components(fps))), key=str)
    got = [(r[0], r[1] % (1 << 64), r[2]) for r in simhash.near_duplicates(edge).collect()]
    assert want == sorted(got, key=str)
    assert simhash.near_duplicates(edge.limit(0)).count() == 0
    assert simhash.keep_one(edge).columns == edge.columns


def test_simhash_links_a_chain(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 300)
    fps = [int(b) ^ m for b in base for m in (0, 0b111, 0b111111)]
    found = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"), tile=16)
    linked = {tuple(sorted(p)) for p in found.collect()}
    assert all((min(f, f ^ 0b111), max(f, f ^ 0b111)) in linked for f in fps[::3])
    assert all(int(a ^ b).bit_count() <= 3 for a, b in linked)


def test_mixing(spark, edge, docs):
    found = mixing.mix(docs).collect()
    by = {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
    assert all(abs(t - want) <= 1 and want <= 3 * size + 1e-6 for size, want, t in by.values())
    assert sum(w for _, w, _ in by.values()) == pytest.approx(sum(s for s, _, _ in by.values()))
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in found}
    rows = mixing.mix(edge).collect()
    assert len(rows) == len(EDGE) and {r.doc_id: r.taken for r in rows}[3] == 0
    assert mixing.mix(edge.limit(0)).count() == 0
    order = [r.position for r in mixing.in_training_order(mixing.mix(docs)).collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1


def brute_stats(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    marked = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def exact_quantile(values, q):
    """Of weighted values: the first whose cumulative weight reaches the share ``q``."""
    values, total, below = sorted(values), sum(w for _, w in values), 0.0
    for v, w in values:
        below += w
        if below >= q * total * (1 - 1e-12):
            return v


def brute_fences(rows):
    """Fences from exact values: rows (lang, source, metric values by name)."""
    def blend(own, above):
        total = sum(w for _, w in above)
        return own + [(v, quality.PRIOR * w / total) for v, w in above]

    fences = {}
    for name, (q, slack, side) in quality.RULES.items():
        whole = [(m[name], 1.0) for _, _, m in rows]
        for lang, source in {r[:2] for r in rows}:
            tongue = blend([(m[name], 1.0) for a, _, m in rows if a == lang], whole)
            own = blend([(m[name], 1.0) for a, b, m in rows if (a, b) == (lang, source)], tongue)
            middle, high, low = (exact_quantile(own, x) for x in (0.5, q, 1 - q))
            fences[lang, source, name] = low - max(slack * (middle - low), 2 * quality.ERROR * middle), middle, high + max(slack * (high - middle), 2 * quality.ERROR * middle)
    return fences


def test_quality(spark, sf, docs, edge):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op4_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, *_, repeats = stats = brute_stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.base_failed and r.kept)
    assert len(quality.quality_report(edge).collect()) == len(EDGE)
    assert quality.quality_report(edge.limit(0)).count() == 0
    kept = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept
    assert quality.keep_good(edge).columns == edge.columns
    assert quality.keep_good(edge.limit(0)).count() == 0


def test_quality_edges_and_long_text(edge):
    for (_, text, *_), got in zip(EDGE, quality.measure_many([r[1] for r in EDGE]).tolist()):
        assert tuple(got[:5]) == brute_stats(text)
    long = "\n".join(f"w{k % 400_000} x{k % 7}" for k in range(500_000))
    assert tuple(quality.measure_many([long])[0][:5]) == brute_stats(long)


def test_quality_fences_adapt_and_agree_with_exact_quantiles(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(1500):
        lang, source = ("en", "de")[k % 2], ("prose", "code", "rare")[0 if k % 3 == 0 else 1 if k % 50 else 2]
        words = ["w" * int(x) for x in rng.integers(*((2, 8) if source == "prose" else (3, 14)), int(rng.integers(20, 120)))]
        words += ["%"] * int(rng.poisson(12 if source == "code" else 0.2)) + ["$$$"] * (60 if k % 31 == 0 else 0)
        rng.shuffle(words)
        lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)] + ["same line"] * int(k % 40 == 0) * 3
        rows.append((k, "\n".join(lines), lang, source))
    found = {r.doc_id: r for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    metrics = {}
    for k, r in found.items():
        n = max(r.n_words, 1)
        metrics[k] = {"symbol_ratio": r.n_symbols / n, "dup_line_ratio": r.n_dup_lines / max(r.n_lines, 1), "repeat_ratio": r.n_repeat_words / n, "word_length": r.word_chars / n}
    fences = brute_fences([(lang, source, metrics[k]) for k, _, lang, source in rows if not found[k].base_failed])
    assert fences["en", "code", "symbol_ratio"][2] > 3 * fences["en", "prose", "symbol_ratio"][2] and fences["de", "code", "word_length"][2] > fences["de", "prose", "word_length"][2] + 1
    sure = 0
    for k, _, lang, source in rows:
        r, m = found[k], metrics[k]
        margins = []  # how far inside each fence, in shares of the values a sketch may err by
        for name, count, base in (("symbol_ratio", r.n_symbols, r.n_words), ("dup_line_ratio", r.n_dup_lines, r.n_lines), ("repeat_ratio", r.n_repeat_words, r.n_words)):
            high = fences[lang, source, name][2]
            margins.append((high * base - count + quality.DOUBT * math.sqrt(count)) / max(base * (high + m[name]), 1e-9))
        low, middle, high = fences[lang, source, "word_length"]
        doubt = quality.DOUBT * middle / 2 / math.sqrt(r.n_words)
        margins += [(high + doubt - m["word_length"]) / high, (m["word_length"] + doubt - low) / high]
        if min(abs(x) for x in margins) > 8 * quality.ERROR:
            sure += 1
            assert r.kept == (not r.base_failed and min(margins) > 0), (k, margins)
    assert sure > 700 and 20 < sum(not r.kept for r in found.values()) < 400


def test_sketch_quantiles_merge(spark):
    values = [float(x) ** 2 for x in range(1, 2001)]
    df = spark.createDataFrame([(k % 3, v) for k, v in enumerate(values)], "g int, value double")
    merged = quality.merged(quality.sketch(df, ["g"]), [])
    assert merged.agg({"n": "sum"}).first()[0] == len(values)
    got = quality.quantiles(merged, [], {"a": 0.1, "b": 0.9}).first()
    for q, v in ((0.1, got.a), (0.9, got.b)):
        exact = values[math.ceil(q * len(values)) - 1]
        assert abs(v - exact) <= 0.011 * exact


def test_line_dedup_edges(spark, edge):
    out = linededup.dedup_lines(edge)
    rows = out.collect()
    assert len(rows) == len(EDGE) and out.columns == [*edge.columns, "n_lines", "removed"]
    by = {r.doc_id: r for r in rows}
    assert by[7].removed == [] and by[8].removed == [2, 3, 4, 5] and by[8].text == "other start\n\nother end"
    assert by[3].text is None and by[3].n_lines == 0 and by[4].n_lines == 1
    assert linededup.dedup_lines(edge.limit(0)).count() == 0


def test_line_dedup_runs_as_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = ["\n".join(" ".join([f"t{x}"] * int(x + 1)) for x in rng.integers(0, 6, rng.integers(0, 14))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    least, seen, want = 7, set(), {}
    for d, t in enumerate(texts):
        lines = t.split("\n") if t else []
        size = [len(x.split()) for x in lines]
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(size[i:j]) >= least and size[i:j].count(0) == 0:
                    if (key := tuple(lines[i:j])) in seen:
                        gone |= set(range(i, j))
        # a later copy within the same document counts, too
                    else:
                        seen.add(key)
        want[d] = sorted(gone)
    got = {r.doc_id: list(r.removed) for r in linededup.dedup_lines(df, least).collect()}
    assert got == want


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(default_path())
    return lambda text, end: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing(spark, sf, docs, edge, ids):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op6_packing(spark, sf).collect()
    whole, bins = {}, {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert whole.keys() == texts.keys()
    total = 0
    for d, parts in whole.items():
        own = ids(texts[d], 0)
        total += len(own)
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(own) // 2048)))
        for r in parts:
            cut = own[r.start : r.start + 2048]
            assert (r.start, r.length, r.ids_crc32) == (2048 * r.piece, len(cut), zlib.crc32(cut.tobytes()))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.02 * total / 2048 + 1
    assert packing.pack_documents(edge).where("piece = 0").count() == len(EDGE)
    assert packing.pack_documents(edge.limit(0)).count() == 0


def test_genetic_operators():
    import random

    sizes = [random.Random(3).randrange(1, 2048) for _ in range(200)]
    bins = packing.evolve(sizes, [], 1)
    assert sorted(i for b in bins for i in b) == list(range(200))
    filled = [(sum(sizes[i] for i in b), b) for b in bins]
    child = packing.cross(sizes, filled, filled[::-1], 2048, random.Random(2))
    assert sorted(i for _, b in child for i in b) == list(range(200)) and all(fill == sum(sizes[i] for i in b) <= 2048 for fill, b in child)


def test_least_bins_is_a_bound_and_ends_the_search_only_there(monkeypatch):
    import random

    rng = random.Random(5)

    def fewest(sizes, rooms=()):
        """By trying every place for each item."""
        if not sizes:
            return len(rooms)
        s, *rest = sizes
        options = {tuple(sorted((*rooms[:k], r - s, *rooms[k + 1 :]))) for k, r in enumerate(rooms) if r >= s}
        return min([fewest(rest, o) for o in options] + [fewest(rest, tuple(sorted((*rooms, 20 - s))))])

    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(7)]
        assert packing.least_bins(sizes, 20) <= fewest(sizes) <= len(packing.evolve(sizes, [], 1, 20))
    assert packing.least_bins([11] * 5 + [9, 9, 8], 20) == 5 and packing.least_bins([12] * 5 + [9] * 4, 20) == 7
    crossed, real = [], packing.cross
    monkeypatch.setattr(packing, "cross", lambda *a: crossed.append(1) or real(*a))
    over = [rng.randint(300, 1000) for _ in range(2000)]
    assert len(packing.evolve(over, [], 1)) > packing.least_bins(over) and len(crossed) >= packing.PATIENCE


def test_genetic_search_gains_over_best_fit(spark):
    import random

    rng, sizes = random.Random(1), []
    for _ in range(60):  # each three fill a sequence, so 60 sequences hold them all
        a = rng.randrange(780, 1000)
        b = rng.randrange(513, (2048 - a) // 2)
        sizes += [a, b, 2048 - a - b]
    rng.shuffle(sizes)
    plain = packing.best_fit(sizes, sorted(range(180), key=lambda i: -sizes[i]), [], 2048)
    rows = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length int")).collect()
    assert sorted(r.doc_id for r in rows) == list(range(180))
    assert len({r.sequence_id for r in rows}) <= 62 < len(plain) - 5


def test_token_files(spark, sf, docs, edge, ids, tmp_path):
    rows = {r.doc_id: r for r in queries.op8_tokenfiles(spark, sf).collect()}
    at = 0
    for d, t in sorted((r.doc_id, r.text) for r in docs.collect()):
        own = ids(t, 2)
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    to = f"file://{tmp_path}/t"
    tokenfiles.write_tokens(edge, to)
    back = tokenfiles.read_tokens(spark, to).collect()
    assert sorted((bytes(r.ids) for r in back)) == sorted(ids(r[1], 2).tobytes() for r in EDGE)
    assert {r.doc_id for r in tokenfiles.read_tokens(spark, to, [2, 9]).collect()} == {2, 9}
    tokenfiles.write_tokens(edge.limit(0), f"file://{tmp_path}/e")
    assert tokenfiles.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_search_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.5, 0.5]), (3, [1.0, 2.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [9.0])]
    found = mtree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 3, 64 * 64 * 5), (0, 2, 20, 32 * 64 * 3), (20, 1, 0, 32 * 64 * 3), (20, 2, 3, 32 * 64 * 3)]


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(0)
    spread, centres = rng.integers(-50, 50, (3000, 8)), rng.integers(-50, 50, (30, 16))
    for rows, most in ((spread, 1.0), (centres[rng.integers(0, 30, 3000)] + rng.integers(-3, 4, (3000, 16)), 0.3), (spread * 10**8, 1.0)):
        tree = mtree.MTree.build([[i] for i in range(3000)], rows, page=32)
        asked = np.arange(0, 3000, 300)
        value, entry = tree.search(rows[asked], 10)
        assert tree.scored <= most * 3000 * len(asked)
        for q, v, e in zip(asked, value, entry):
            want = sorted((-s, i) for i, s in enumerate((rows @ rows[q]).tolist()))[:10]
            assert list(zip((-v).tolist(), tree.least[e].tolist())) == want


def scan(rows, k, every=20):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    out = []
    for q in {i for i, _ in kept if i % every == 0}:
        for w in [v for i, v in kept if i == q]:
            found = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in kept if i != q and len(v) == len(w))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_search_of_clusters_and_copies_as_a_scan(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    vectors = (centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, 6)) / 50).tolist()
    rows = [(i, vectors[i]) for i in range(700)] + [(700 + i, vectors[40]) for i in range(300)]  # a third are one vector
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, label string")
    assert sorted(map(tuple, mtree.nearest(df, k=20).collect())) == scan(rows, 20)
    vectors = mtree.scaled(df)
    assert mtree.share_scored(vectors, vectors.where("id % 20 = 0"), 5, tree=60) < 0.5
    assert mtree.nearest(df.limit(0)).count() == 0
    few = rows[:5]
    assert sorted(map(tuple, mtree.nearest(spark.createDataFrame(few, "vec_id long, embedding array<double>"), k=20).collect())) == scan(few, 20)


def test_licenses(spark):
    mit = licenses.MIT.upper().replace("SUBLICENSE", "sub-licence")
    rows = [(1, "Copyright (c) 2020 A. B.\n" + mit), (2, "x\nReleased  under the MIT licence!\ny"), (3, None), (4, "..."), (5, "plain")]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == "MIT" and got[2] == (None, "MIT") and got[3] == got[4] == got[5] == (None, None)


def brute_canonical(text):
    """Word by word: copyright lines go, then runs of words are replaced left to right for each spelling."""
    lines = [x for x in low(text or "").split("\n") if not re.search(licenses.COPYRIGHT_LINE, x)]
    words = [w for w in re.split(licenses.PUNCTUATION, "\n".join(lines)) if w]
    for old, new in licenses.EQUIVALENT:
        old, out, i = old.replace("-", " ").split(), [], 0
        while i < len(words):
            if words[i : i + len(old)] == old:
                out, i = out + new.split(), i + len(old)
            else:
                out, i = [*out, words[i]], i + 1
        words = out
    return " ".join(words)


def test_licenses_as_brute_force(spark):
    wrapped = licenses.MIT.replace("sublicense", "sub-\nlicence").replace("COPYRIGHT HOLDERS", "copyright\nHOLDERS").replace("AUTHORS", "\n\tAUTHORS")
    apache = next(t for k, t in licenses.KNOWN if k == "Apache-2.0" and len(t) > 5000)
    rows = [(1, wrapped, "x"), (1, wrapped, "x"), (2, f"Copyright 2001-2020 A\n(c) 2020 B\n{licenses.MIT}\nAll rights reserved.", None), (3, "the licence licence copyright\nowner copyright owner owner", "y"), (4, None, None), (5, "", ""), (6, " \n\t. ", None), (7, apache.replace("  ", "\n"), "z"), (None, "Released under the MIT license", "q"), (8, LONG, None), (9, f"{licenses.ISC}\nmore", None), (10, "a\nlicensed under the MIT licence\nReleased under the MIT License.\nb", None)]
    known = {}
    for k, t in licenses.KNOWN:
        known.setdefault(brute_canonical(t), k)
    want = []
    for d, t, _ in rows:
        whole = brute_canonical(t)
        found = sorted({known[x] for line in (t or "").split("\n") if (x := brute_canonical(line)) in known and x})
        want.append((d, known.get(whole) if whole else None, ",".join(found) or None, hashlib.sha256(whole.encode()).hexdigest() if whole else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = [(r.doc_id, r.license, r.notices, r.digest) for r in licenses.scan(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    by = {r[0]: r for r in got}
    assert by[1][1] == by[2][1] == "MIT" and by[7][1] == "Apache-2.0" and by[9][1] is None and by[10][2] == "MIT"
    assert licenses.scan(df.limit(0)).count() == 0


def test_targets_of_sources_with_equal_ratios(spark):
    sizes = spark.createDataFrame([("a", 240), (None, 240), (None, 240)], "source string, size long")
    assert {r.source: r.target for r in mixing.source_targets(sizes).collect()} == {"a": 240.0, None: 480.0}
    sizes = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30), ("d", 1000)], "source string, size long")
    # Weights 1, 2, 3, 1: the first three stop at three times their sizes, the last has the rest.
    assert {r.source: r.target for r in mixing.source_targets(sizes).collect()} == {"a": 30.0, "b": 60.0, "c": 90.0, "d": 880.0}
    assert all(r.target > 0 for r in mixing.source_targets(spark.createDataFrame([(s, 5 * k) for s, k in zip("abcdef", (1, 2, 3, 1, 2, 3))], "source string, size long")).collect())


def test_quotes(spark):
    rows = [(1, 0, "user", "First thought.\n\nSecond thought."), (1, 1, "user", "A reply."), (2, 0, "user", "> second   THOUGHT.\nI agree."), (2, 1, "user", "On Monday X wrote:\n> I agree.\n>> Second thought.\nSo do I."), (3, 0, "user", None), (None, 0, "user", "> A reply.")]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 6
    assert (got[2, 0].parent_conv, got[2, 0].parent_turn, got[2, 0].text) == (1, 0, "I agree.")
    assert (got[2, 1].parent_conv, got[2, 1].thread_conv, got[2, 1].depth, got[2, 1].n_quotes, got[2, 1].text) == (2, 1, 2, 2, "So do I.")
    assert got[3, 0].text is None and got[None, 0].parent_conv is None


def test_quote_marks():
    text = "Hi\nOn Monday X wrote:\n> one  Two\n> three\n>\n>> deep\nmine\n[quote=Y]tagged [quote]inner[/quote] again[/quote] rest\n-----Original Message-----\nold\n> older"
    assert quotes.parse(text) == ("Hi\nmine\n rest", [(1, ["one two", "three"]), (2, ["deep"]), (1, ["tagged"]), (2, ["inner"]), (1, ["again"]), (1, ["old"]), (2, ["older"])])


def brute_links(rows):
    """Parents by comparing every run of quoted lines with every message; rows (conv, turn, role, text) in order."""
    parsed = [quotes.parse(r[3]) for r in rows]
    known = []
    for own, _ in parsed:
        lines = [x for line in (own or "").split("\n") if (x := " ".join(line.lower().split()))]
        runs = {tuple(lines[i : i + n]) for n in (1, 2, 4, 8, 16) for i in range(len(lines) - n + 1)}
        known.append((runs, {" ".join(p.lower().split()) for p in [own or "", *re.split(r"\n[ \t]*\n", own or "")]} - {""}))
    parents = []
    for m, (conv, turn, *_) in enumerate(rows):
        found = []
        for n, (level, lines) in enumerate(parsed[m][1]):
            pieces = [(None, " ".join(lines))] + [(tuple(lines[i : i + k]), None) for k in (1, 2, 4, 8, 16) for i in range(len(lines) - k + 1)]
            for run, whole in pieces:
                words = len((whole or " ".join(run)).split())
                holders = [k for k, (runs, wholes) in enumerate(known) if (run in runs if run else whole in wholes or (whole,) in runs)]
                inside = [k for k in holders if rows[k][0] == conv and k < m]
                common = len({rows[k][0] for k in holders}) > 1
                outside = [k for k in holders if rows[k][0] != conv and (words >= 5 or (words > 1 and not common))]
                if inside or outside:
                    found.append((level, -words, n, min(inside or outside)))
        before = [k for k in range(m) if rows[k][0] == conv and rows[k][1] < turn]
        parents.append(min(found)[3] if found else next(k for k in before if rows[k][1] == rows[before[-1]][1]) if before else None)
    return parents


def test_quotes_as_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, texts = [], []
    for conv in rng.permutation(30):
        for turn in range(int(rng.integers(1, 6))):
            lines = [" ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(1, 4))) for _ in range(rng.integers(1, 6))]
            text = "\n".join(x + ("\n" if rng.random() < 0.2 else "") for x in lines)
            if texts and rng.random() < 0.6:
                quoted = texts[rng.integers(max(0, len(texts) - 12), len(texts))].split("\n")
                i = rng.integers(0, len(quoted))
                text = "\n".join("> " + x.upper() for x in quoted[i : i + rng.integers(1, 4)]) + "\n" + text
            texts.append("\n".join(lines))
            rows.append((int(conv), turn, "user", text))
    rows.sort()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(df.repartition(5)).collect()}
    want = brute_links(rows)
    assert len(got) == len(rows)
    parent = {rows[k][:2]: None if p is None else rows[p][:2] for k, p in enumerate(want)}
    circle = set()
    for k in parent:  # those that a walk does not leave
        at, seen = k, set()
        while at is not None and at not in seen:
            seen.add(at)
            at = parent[at]
        if at is not None:
            circle.add(k)
    assert len(circle) < len(rows) / 2
    for k, r in got.items():
        if k not in circle or (parent[k] is not None and parent[k] < k):
            assert (None if r.parent_conv is None else (r.parent_conv, r.parent_turn)) == parent[k], k
        at, steps = k, 0
        while got[at].parent_conv is not None:
            at, steps = (got[at].parent_conv, got[at].parent_turn), steps + 1
            assert steps <= len(rows)
        assert (r.thread_conv, r.thread_turn, r.depth) == (*at, steps)


def test_words_of_anybody_are_no_quotes_of_other_conversations(spark):
    rows = [(1, 0, "user", "ok"), (1, 1, "user", "thanks a lot"), (2, 0, "user", "start"), (2, 1, "user", "> ok\nwhy"), (2, 2, "user", "more"), (3, 0, "user", "thanks a lot\nthis line is told once and has many words"), (4, 0, "user", "> thanks a lot\nbye"), (5, 0, "user", "> this line is told once and has many words\nyes"), (6, 0, "user", "rare pair"), (7, 0, "user", "> rare pair\nso")]
    found = quotes.reply_order(quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    by = {(r.conv_id, r.turn): r for r in found}
    assert (by[2, 1].parent_conv, by[2, 1].parent_turn, by[2, 2].thread_conv) == (2, 0, 2)
    assert by[4, 0].parent_conv is None and by[5, 0].parent_conv == 3 and by[7, 0].parent_conv == 6
    order = [(r.thread_conv, r.thread_turn, r.depth, r.conv_id, r.turn) for r in sorted(found, key=lambda r: r.position)]
    assert order == sorted(order) and sorted(r.position for r in found) == list(range(len(rows)))


def test_quotes_edges(spark):
    kind = "conv_id long, turn long, role string, text string, depth string"
    long = "\n".join(f"line number {k}" for k in range(20_000))
    rows = [(1, 0, "user", "one\ntwo\nthree", "x"), (1, 1, "user", "> two\n> three\nyes", "x"), (1, 1, "user", "> two\n> three\nyes", "y"), (1, 1, "user", "another of that turn", "x"), (1, 2, "user", "last", "x"), (2, 0, "user", long, "x"), (0, 0, "user", "> line number 777\n> line number 778\n> line number 779\nso", "x"), (3, 0, "user", "", None), (None, 1, None, None, None), (7, 0, "user", "> mine too\nyours too", "x"), (8, 0, "user", "> yours too\nmine too", "x")]
    found = quotes.link_quotes(spark.createDataFrame(rows, kind)).collect()
    assert len(found) == len(rows) - 1
    by = {(r.conv_id, r.turn, r.text): (r.parent_conv, r.parent_turn) for r in found}
    assert by[1, 1, "yes"] == by[1, 1, "another of that turn"] == (1, 0) and by[1, 2, "last"] == (1, 1)
    assert by[0, 0, "so"] == (2, 0) and by[3, 0, ""] == (None, None)
    assert (by[7, 0, "yours too"], by[8, 0, "mine too"]) == ((None, None), (7, 0))
    assert quotes.link_quotes(spark.createDataFrame([], kind)).count() == 0


def test_render(spark, sf):
    html = "<head><title>no</title></head><p>One<p>Two <b>bold</b><ul><li>a<li>b</ul><div hidden>x</div><span style='display:none'>y</span><table><tr><td>k<td>long<tr><td>key<td>v</table>&amp; end"
    assert render.render(html) == "One\n\nTwo bold\n\n- a\n- b\n\nk    long\nkey  v\n\n& end"
    assert render.render(None) is None and render.render("") == ""
    assert "deep" in render.render("<div>" * 5000 + "deep")
    assert queries.op5_render(spark, sf).where("text is null").count() == 0


def test_render_reads_any_page_once():
    import time

    assert render.render("<div>" * 250 + "<p style='display: none'>SECRET</p>shown") == "shown"
    assert render.render("<ul><li>" * 3000 + "x").endswith("x") and render.render("<table><tr><td>" * 2000 + "t") == "t"
    for page in ("<" + "a" * 1_000_000, "<a x='" * 100_000, "<p><button>" + "<div>" * 50_000, "<style>" + "a{" * 100_000, "<!-- " * 100_000):
        began = time.process_time()
        render.render(page)
        assert time.process_time() - began < 5


def test_render_visibility_and_forms():
    style = "<style>/* x{} */ .h{visibility:hidden} #n, p.q{display:none} @media print{b{display:none}} i{display:none!important}</style>"
    assert render.render(style + "<div class=h>no <span style='visibility:visible'>yes</span></div><p id=n>no<p class='q r'>no<p class=r><b>bold</b> <i style='display:inline'>no</i>") == "yes\n\nbold"
    assert render.render("<details>no<summary>sum</summary><summary>no</summary>no</details><details open><summary>s</summary>body</details>") == "sum\ns\nbody"
    assert render.render("<select><option>one<option selected>two</select><textarea>a &lt; b</textarea><input value=v><input type=hidden value=no><dialog>no</dialog>") == "two a < b v"
    assert render.render("a < b <b>c</b <i>d</i>") == "a < b cd"


def test_render_spans_and_wide_cells():
    page = "<table><tr><td colspan=2>wide title here<td>z<tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>中文<td>x<td>y</table>"
    assert render.render(page) == "wide title here  z\na     b          c\n      d          e\n中文  x          y"
    assert render.render("<ol start=3><li>x<ul><li>y<li>z</ul><li value=9>w</ol>") == "3. x\n   - y\n   - z\n9. w"


def test_render_reads_selectors_of_elements_within_others():
    style = "<style>.ad p{display:none} div>p.q{display:none} #a .b > i{visibility:hidden} ul li + li{display:none} .ad .in p{display:block} h1:hover{display:none}</style>"
    body = "<div class=ad><section><p>no</section><div class=in><p>back</div></div><div><p class=q>no<span><p class=q>no</span></div><section><p class=q>yes</section><div id=a><b class=b><i>no</i><u><i>yes</i></u></b></div><h1>head</h1><ul><li>a<li>b</ul>"
    assert render.render(style + body).split() == "back yes yes head - a - b".split()
    deep = "<style>.x .y .z{display:none}</style>" + "<div class=x>" * 3000 + "<div class=y>" * 3000 + "<p class=z>no<p>yes"
    assert render.render(deep).strip() == "yes"


def test_render_tables_as_large_as_their_text():
    import time

    wide = "<table><tr><td>" + "w" * 20_000 + "<td>x" + "".join(f"<tr><td>a{k}<td>b{k}" for k in range(5000)) + "</table>"
    spans = "<table>" + "<tr>" + "<td colspan=1000 rowspan=65534>c" * 60 + "".join("<tr>" + f"<td colspan=1000 rowspan={k + 2}>d" * 60 for k in range(200)) + "</table>"
    for page in (wide, spans, wide * 10, "<table>" + "<tr><td rowspan=0>r<td colspan=0>s" * 3000 + "</table>"):
        began = time.process_time()
        text = render.render(page)
        assert time.process_time() - began < 2 + 6e-6 * len(page) and len(text) < 40 * len(page)
    assert [x.split() for x in render.render(wide).split("\n")[1:]] == [[f"a{k}", f"b{k}"] for k in range(5000)]


def table_by_cells(rows):
    """A table of plain cells, row by row, laid out anew."""
    held, lines = {}, [[] for _ in rows]
    for n, row in enumerate(rows):
        at = 0
        for columns, down, text in row:
            while (n, at) in held:
                at += 1
            lines[n].append((at, columns, text))
            held |= {(n + d, at + c): 1 for d in range(down) for c in range(columns)}
            at += columns
    wide = {}
    for at, columns, text in sorted((c for r in lines for c in r), key=lambda c: c[1]):
        inside = [k for k in sorted(wide) if at <= k < at + columns]
        lacking = len(text) - sum(wide[k] for k in inside) - 2 * max(0, len(inside) - 1)
        if lacking > 0:
            wide[inside[-1] if inside else at] = wide.get(inside[-1] if inside else at, 0) + lacking
    out = []
    for r in lines:
        line = ""
        for at, _, text in r:
            start = sum(w + 2 for k, w in wide.items() if k < at)
            line = line.ljust(max(start, len(line) + 2 if line else 0)) + text
        out.append(line)
    return "\n".join(out)


def test_render_tables_as_brute_force():
    import random

    rng = random.Random(11)
    for _ in range(200):
        rows = [[(rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2]), "".join(rng.choices("abc", k=rng.randint(1, 9)))) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={c} rowspan={d}>{t}" for c, d, t in r) for r in rows) + "</table>"
        assert render.render(html) == table_by_cells(rows), rows


def brute_words(html):
    """The visible words of a plain page: what is left without hidden elements, comments and tags."""
    from html import unescape

    html = re.sub(r"(?is)<!--.*?-->|<(script|style|head|title|noscript|template)\b.*?</\1\s*>", " ", html)
    return re.sub(r"[\s]+", " ", unescape(re.sub(r"<[^>]*>", " ", html))).split()


def test_rendered_words_of_pages_as_brute_force(spark, sf):
    hidden = re.compile(r"(?i)\bhidden\b|display\s*:|visibility|<select|<input|<textarea|<img|<ol")
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = [r for r in queries.op5_render(spark, sf).collect() if not hidden.search(pages[r.page_id])]
    assert len(rows) > 50
    for r in rows:
        got = [w for line in r.text.split("\n") for w in line.removeprefix("- ").split()]
        assert "".join(got) == "".join(brute_words(pages[r.page_id]))


def test_render_edges(spark):
    rows = [(1, "u", "<p>a", "t"), (1, "u", "<p>a", "t"), (2, None, None, None), (None, "u", "", "t"), (3, "u", "<p>" + "long text " * 100_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r.text for r in render.rendered(df).collect()}
    assert got[1, "u"] == "a" and got[2, None] is None and got[None, "u"] == "" and len(got[3, "u"]) == 999_999
    assert render.rendered(df).count() == 5 and render.rendered(df).columns == df.columns and render.rendered(df.limit(0)).count() == 0


def test_token_files_of_few_or_long_documents(spark, ids, tmp_path):
    for name, texts in (("one", ["a single document of a few words"]), ("long", [LONG, LONG[:90_000]]), ("none", [None, ""])):
        to, rows = f"file://{tmp_path}/{name}", list(enumerate(texts))
        tokenfiles.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), to)
        assert bool(tokenfiles.load_dictionary(spark, to)) == (name != "none")
        got = {r.doc_id: (r.start, bytes(r.ids)) for r in tokenfiles.read_tokens(spark, to).collect()}
        at = 0
        for d, t in rows:
            assert got[d] == (at, ids(t, 2).tobytes())
            at += len(ids(t, 2))
