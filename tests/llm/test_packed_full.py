"""Packing reaches the proven bound where the genetic search stayed above it; words are encoded by fewer steps only where these change nothing."""

import random

from tokenizers import Tokenizer, normalizers

from lattix.llm import packing, tokens


def test_mutations_keep_items_and_gain():
    rng = random.Random(5)
    sizes = [rng.randint(1, 2047) for _ in range(400)]
    bins = packing.best_fit(sizes, list(range(400)), [], 2048)
    for found in (packing.fullest(sizes, list(range(400)), 2048), packing.mutate(sizes, bins[:], 0, 2048, rng)):
        assert sorted(i for _, b in found for i in b) == list(range(400)) and all(fill == sum(sizes[i] for i in b) <= 2048 for fill, b in found)
        assert len(found) <= len(bins)
    assert packing.fullest(sizes, [], 2048) == [] and packing.fullest([5], [0], 5) == [(5, [0])]
    assert packing.fullest([6, 5, 4, 3, 2], [0, 1, 2, 3, 4], 10) == [(10, [0, 2]), (10, [1, 3, 4])]


def test_sequences_are_as_few_as_are_needed(spark):
    rng = random.Random(5)
    sizes = [rng.randint(300, 1000) for _ in range(2000)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length int")).collect()
    assert sorted(r.doc_id for r in rows) == list(range(2000))
    assert len({r.sequence_id for r in rows}) == packing.least_bins(sizes)


def test_quick_words_have_the_library_s_ids():
    library = Tokenizer.from_file(tokens.default_path())
    encoder = tokens.WordEncoder(tokens.default_path())
    assert encoder.quick is not encoder.tokenizer
    latin = [chr(k) for k in range(0xAA, 0x100) if chr(k).isalpha() and chr(k).lower() == chr(k)]
    rng = random.Random(2)
    words = ["".join(rng.choices(latin + list("abcdefghijklmnopqrstuvwxyz"), k=rng.randint(1, 12))) for _ in range(3000)]
    texts = [" ".join(words), "", " a\tb ", "Ünder it's don't! ЖЗ   é", *words[:50]]
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [[int.from_bytes(x[k : k + 4], "little") for k in range(0, len(x), 4)] for x in encoder.encode_many(texts)] == ids
    library.normalizer = normalizers.NFKC()
    assert tokens._bare(library) is library
