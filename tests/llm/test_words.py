"""Pieces, divergence and spellings against the library, plain Python and SQL, with edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import sentencepiece

from lattix.llm import divergence, pieces, queries, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, word string, `a.b` string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def edge_rows():
    random.seed(5)
    long = " ".join(random.choice(["through", "thorugh", "throughh", "bücherei", "Bücherej", "中文字", "x" * 40]) for _ in range(30_000))
    return [
        (1, "Letters, letters and LETTERS; lettars", "en", "a", 1, "x", "y", "z"),
        (1, "Letters, letters and LETTERS; lettars", "en", "a", 1, "x", "y", "z"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "b", 0, "x", "y", "z"),
        (4, " \t\n ", "en", None, 4, None, None, None),
        (None, long, "de", "b", 5, None, None, None),
        (6, "À×ÿ÷ Éclairs éclairs \u0000 ▁▁ 🤖 letters letters", "fr", "d", 9, None, None, None),
        (7, "a" * 50_000 + "ab" * 20_000, "en", "c", 9, None, None, None),
    ]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def held(spark, tmp_path, df):
    """Queries read folders."""
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def digests(processor, rows):
    out = []
    for r in rows:
        ids = processor.encode(r["text"] or "")
        out.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(processor.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def test_pieces_of_all_documents(spark, sf, processor):
    got = [tuple(r) for r in queries.op11_pieces(spark, sf).collect()]
    assert sorted(got, key=str) == digests(processor, spark.read.parquet(f"{sf}/documents.parquet").collect())


def test_pieces_of_odd_rows(spark, edge, processor, tmp_path):
    got = [tuple(r) for r in queries.op11_pieces(spark, held(spark, tmp_path, edge)).collect()]
    assert sorted(got, key=str) == digests(processor, edge.collect())
    assert pieces.decoded(pieces.encoded(edge.where("false"))).count() == 0
    kept = pieces.encoded(edge, out="found").columns
    assert kept == [*edge.columns, "found"]


def test_pieces_of_random_texts(processor):
    random.seed(3)
    model = pieces.PieceModel(pieces.default_path())
    words = [p.replace(pieces.SPACE, " ") for p in model.ids]
    texts = ["".join(random.choice(words) for _ in range(random.randint(0, 60))) for _ in range(500)]
    texts += ["".join(random.choice("abrd-=_ \n▁é中🤖") for _ in range(random.randint(0, 400))) for _ in range(500)]
    texts += [random.choice(["ab", "rd", "-", "=", "the", " ", "0"]) * random.randint(1, 1500) for _ in range(60)]
    ids, n = model.encode_many(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == processor.encode(texts)
    loose = [[random.randrange(2, 300) if random.random() < 0.5 else random.randrange(32000) for _ in range(random.randint(0, 12))] for _ in range(2000)]
    assert [model.decode(np.array(x, np.int32)) for x in loose] == [processor.decode(x) for x in loose]


def test_pieces_across_chunks(processor, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 100)
    model = pieces.PieceModel(pieces.default_path())
    random.seed(4)
    texts = ["".join(random.choice(["the ", "of", "aa", " -", "\n", "中"]) for _ in range(random.randint(0, 300))) for _ in range(100)] + ["a" * 1000]
    ids, n = model.encode_many(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == processor.encode(texts)


def brute_divergence(rows, least_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source, words = r["lang"] or "", r["source"] or "", term.findall(low(r["text"] or ""))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g for g, _ in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(groups.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s, c in groups.items():
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("least_docs, top", [(1, 3), (2, 50), (30, 50)])
def test_divergence_of_odd_rows(edge, least_docs, top):
    got = sorted(tuple(r) for r in divergence.divergence(edge, least_docs, top).collect())
    assert got == brute_divergence(edge.collect(), least_docs, top)


def test_divergence_of_sources_without_terms(spark):
    random.seed(6)
    rows = [(k, " ".join(random.choices(["ab", "cd", "ef", "gh", "IJ", "é"], k=random.randint(0, 9))) if k % 7 else "", random.choice(["en", "de", None]), random.choice("abcdefg")) for k in range(80)]
    df = spark.createDataFrame([*rows, (99, "1 2 3", "en", "z"), (98, None, "xx", "y"), (97, "", "xx", "z")], "doc_id long, text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence.divergence(df, 4, 2).collect())
    assert got == brute_divergence(df.collect(), 4, 2)
    assert divergence.divergence(df.where("false")).count() == 0


def brute_words(rows):
    run, n = re.compile("[A-Za-zÀ-ÿ]+"), Counter()
    for r in rows:
        for w in run.findall(r["text"] or ""):
            w = low(w)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n):
    found = defaultdict(list)
    for a, b in combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            found[a].append(b)
            found[b].append(a)
    form = {}
    for w in n:
        best = min(found[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(found[w]), n.get(form[w])))
    return sorted(out)


def test_spelling_of_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.op13_spelling(spark, sf).collect())
    want = brute_variants(brute_words(spark.read.parquet(f"{sf}/documents.parquet").collect()))
    assert got == want and any(form for _, form, *_ in want)


def test_spelling_of_odd_rows(spark, edge, tmp_path):
    got = sorted(tuple(r) for r in queries.op13_spelling(spark, held(spark, tmp_path, edge)).collect())
    assert got == brute_variants(brute_words(edge.collect()))
    assert spelling.spelling_variants(edge.where("false")).count() == 0


def test_spelling_of_random_words(spark):
    random.seed(8)
    base = ["".join(random.choices("abcàÿ", k=random.randint(7, 10))) for _ in range(300)]
    n = {}
    for w in base:
        n[w] = random.choice([2, 3, 30, 300, 3000, 30000])
        for _ in range(3):
            at, c = random.randrange(len(w)), random.choice("abcàÿ")
            for v in (w[:at] + c + w[at + 1 :], w[:at] + c + w[at:], w[:at] + w[at + 1 :]):
                if len(v) >= 7:
                    n.setdefault(v, random.choice([2, 20, 200]))
    got = sorted(tuple(r) for r in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect())
    assert got == brute_variants(n)
