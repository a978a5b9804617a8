"""Packed sequences keep their ids and the order of the documents that they are read from."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lattix.llm import packing
from lattix.llm.tokens import default_path


def test_pipeline_returns_ids_in_training_order(spark, sf, tmp_path):
    to = f"file://{tmp_path}/ordered"
    source = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) between 20 and 3000")
    docs = [(k, r.text) for k, r in enumerate(source.select("text").limit(900).collect())] * 6
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(to)
    rows = corpus_pipeline.sequences(spark, spark.read.parquet(to), sf).collect()
    tokenizer, texts = Tokenizer.from_file(default_path()), dict(docs)
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows[::40]:
        own = np.array(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [0], "<u4")
        assert bytes(r.ids) == own[r.start : r.start + 2048].tobytes()
    assert sorted({r.sequence_id for r in rows}) == list(range(len({r.sequence_id for r in rows})))
    ordered = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    assert np.corrcoef([r.doc_id for r in ordered], range(len(ordered)))[0, 1] > 0.8
    within = {}
    for r in ordered:
        within.setdefault(r.sequence_id, []).append((r.doc_id, r.piece))
    assert all(x == sorted(x) for x in within.values())
