"""Token ids in binary shards: each document compressed alone with a shared zstandard dictionary, found by an index."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattix.llm.shared import bounded
from lattix.llm.tokens import batched, default_path, encoder

#: A block: magic, version, bytes of an id, dictionary hash, documents; then the frames; the index is in columns.
HEAD = "<4sBB16sI"
MAGIC, VERSION = b"LXTK", 1
#: A block ends at so many compressed bytes or documents.
BLOCK_BYTES, BLOCK_DOCS = 1 << 18, 512
#: The dictionary is trained on this many documents at most, those smallest by hashed id, and on so many characters of each.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 1000, 8000, 32 << 10
LEVEL = 3
_BLOCKS = "shard int, block int, first_id long, last_id long, doc_ids array<long>, offsets array<int>, n_tokens array<int>, within long, payload binary"


def _bytes(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, path: str, end: int, width: int) -> bytes:
    """A zstandard dictionary from a bounded sample of documents' serialized ids; empty only if no document has a word.

    ``SAMPLE_CHARS`` characters of ``SAMPLE_DOCS`` documents at most, so 8 MB of text at most come to the driver. Where
    they are too few or too alike to train on, the last of them are the dictionary's content as they stand.
    """
    thin = max(1, docs.count() // (4 * SAMPLE_DOCS))  # about four times as many are looked at, by hashed id
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(thin)) == 0).where(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("th"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    texts = [r["text"] for r in some.orderBy(F.xxhash64("doc_id"), "th").limit(SAMPLE_DOCS).collect()]
    tail = np.array([end], "<u4").tobytes()
    samples = [_bytes(x + tail, width) for x in encoder(path).encode_many(texts)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:]


def dictionary_hash(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _writer(path: str, end: int, width: int, raw: bytes):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, made = TaskContext.get().partitionId(), 0
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_checksum=True).compress
        words, tail, head = encoder(path), np.array([end], "<u4").tobytes(), dictionary_hash(raw)
        ids, frames, sizes, held, within = [], [], [], 0, 0

        def block():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]) + struct.calcsize(HEAD)
            payload = struct.pack(HEAD, MAGIC, VERSION, width, head, len(frames)) + b"".join(frames)
            known = [i for i in ids if i is not None]
            cols = [[shard], [made], [min(known, default=None)], [max(known, default=None)], [ids], [offsets.tolist()], [sizes], [within], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.binary()))], ["shard", "block", "first_id", "last_id", "doc_ids", "offsets", "n_tokens", "within", "payload"])

        for batch in batches:
            at = 0
            for group in batched(batch.column("text")):
                for encoded in words.encode_many(group):
                    encoded += tail
                    frame = compress(_bytes(encoded, width))
                    ids.append(batch.column("doc_id")[at].as_py())
                    frames.append(frame)
                    sizes.append(len(encoded) // 4)
                    held += len(frame)
                    at += 1
                    if held >= BLOCK_BYTES or len(frames) >= BLOCK_DOCS:
                        yield block()
                        within += sum(sizes)
                        made, ids, frames, sizes, held = made + 1, [], [], [], 0
        if frames:
            yield block()

    return work


def write_tokens(docs: DataFrame, to: str, path: str | None = None, end: int = 2) -> None:
    """Write the ids of every whole text and the id ``end`` below the folder ``to``, in ascending ``doc_id`` order.

    ``to``/dictionary: one row, the hash and bytes of the shared dictionary. ``to``/shards: blocks of whole documents,
    each a frame of its own, with ids, offsets and token counts of its documents and the tokens before it in its shard; their order is (shard, block).
    ``to``/manifest: the tokens before each shard. Spark commits the files, so tasks that are run again leave no double.
    Null ids come first, equal ids in the order of their texts' hashes; null texts are empty: the end id alone. Ids are
    longs. Other columns are ignored. An empty table writes no blocks.
    """
    spark, path = docs.sparkSession, path or default_path()
    width = 2 if max(encoder(path).tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
    slim = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw = train_dictionary(slim, path, end, width)
    spark.createDataFrame([(dictionary_hash(raw).hex(), bytearray(raw))], "hash string, bytes binary").coalesce(1).write.parquet(f"{to}/dictionary")
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(_writer(path, end, width, raw), _BLOCKS).write.option("parquet.page.size", 1 << 16).parquet(f"{to}/shards")
    own = spark.read.schema(_BLOCKS).parquet(f"{to}/shards").select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("own"))
    shards = own.groupBy("shard").agg(F.sum("own").alias("tokens"))
    # One row for each shard, whose number is that of the partitions.
    shards.select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("ahead")).coalesce(1).write.parquet(f"{to}/manifest")


def load_dictionary(spark: SparkSession, to: str) -> bytes:
    row = spark.read.parquet(f"{to}/dictionary").first()
    raw = bytes(row["bytes"])
    if dictionary_hash(raw).hex() != row["hash"]:
        raise ValueError("the dictionary does not match its hash")
    return raw


def unpack(payload: bytes, offsets: list[int], k: int, raw: bytes) -> bytes:
    """The ids of a block's ``k``-th document as little-endian uint32 bytes; only its frame is touched."""
    magic, version, width, head, _ = struct.unpack_from(HEAD, payload)
    if (magic, version) != (MAGIC, VERSION) or head != dictionary_hash(raw):
        raise ValueError("not a token block, or made with another dictionary")
    return _opened(payload, offsets, k, width, zstandard.ZstdDecompressor(dict_data=_dictionary(raw)))


def _opened(payload: bytes, offsets: list[int], k: int, width: int, unzip) -> bytes:
    found = unzip.decompress(payload[offsets[k] : offsets[k + 1]])
    return found if width == 4 else np.frombuffer(found, "<u2").astype("<u4").tobytes()


def read_tokens(spark: SparkSession, to: str, ids: list[int] | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files: ``start`` counts the ids of all documents before.

    ``ids``: only these documents; blocks that can't hold them are skipped by their first and last id, and of the others only
    the documents' own frames are decompressed.
    """
    raw = load_dictionary(spark, to)
    wanted = None if ids is None else set(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, head = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)), dictionary_hash(raw)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                magic, version, width, own, _ = struct.unpack_from(HEAD, row["payload"])
                if (magic, version) != (MAGIC, VERSION) or own != head:
                    raise ValueError("not a token block, or made with another dictionary")
                starts = row["ahead"] + row["within"] + np.concatenate([[0], np.cumsum(row["n_tokens"])])
                take = [k for k, d in enumerate(row["doc_ids"]) if wanted is None or d in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][k] for k in take], pa.int64()), pa.array([int(starts[k]) for k in take], pa.int64()), pa.array([row["n_tokens"][k] for k in take], pa.int64()), pa.array([_opened(row["payload"], row["offsets"], k, width, unzip) for k in take], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.schema(_BLOCKS).parquet(f"{to}/shards")
    index = spark.read.schema("shard int, ahead long").parquet(f"{to}/manifest")
    if wanted is not None:
        hit = F.lit(False)
        for i in sorted(x for x in wanted if x is not None):
            hit = hit | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
        blocks = blocks.where(hit if None not in wanted else hit | F.col("first_id").isNull() | F.exists("doc_ids", lambda x: x.isNull()))
    return blocks.join(index, "shard").mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")
