"""Token ids in a binary format: frequency-ranked, byte-aligned codes with separate control bytes.

A block holds the ids of some documents in ascending order of their ids. Its header lists the block's distinct
token ids from the most to the least frequent; the body writes each id's rank in one to four little-endian bytes,
as few as it needs, and the lengths stand apart, four to a control byte (two bits each, low bits first). Decoding
looks up each control byte's four lengths in a table and gathers all ranks of a block at once in numpy.

File layout of a block, all numbers little-endian: magic `MRT1`, uint32 documents, uint32 tokens, uint32 distinct
ids; uint64 ids of the documents; uint32 tokens of each; uint32 ids by rank; control bytes; data bytes.

Blocks of about BLOCK tokens are rows (part, seq, first, ...) of a Parquet table whose binary column holds the blocks as
laid out above, so that Spark's committer makes the write survive lost executors; part and seq order them. Texts are
ranged by document id, and by the text's hash where ids tie; each task encodes its range and writes its blocks in the
same pass, so texts are shuffled once and ids never. A reader adds up the tokens of each part, at most one row for each
shuffle partition, and broadcasts where parts start.

A null id sorts first; repeated ids keep a defined order (by the text's hash, then the text). Null and empty texts have
the end id only, and an empty table gives no rows. Repeated rows give one result each. A text is encoded by one task,
whatever its length up to Arrow's 2 GB. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import Encoder
from millrace.llm.common import batches, settle, stash, table, texts

END = 0  # appended to each document
BLOCK = 1 << 17  # tokens
TOGETHER = 1 << 22  # bytes of texts that are encoded at once
UNITS = 500_000  # units in a generation of the encoder's memory: some 200 bytes each, in two generations
_MAGIC = np.frombuffer(b"MRT1", dtype=np.uint8)
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def pack(ids: list[int], counts: np.ndarray, tokens: np.ndarray) -> bytes:
    """One block: document ids, tokens of each, and all token ids."""
    freq = np.bincount(tokens)  # as long as the vocabulary
    used = np.flatnonzero(freq)
    order = np.argsort(-freq[used], kind="stable")
    rank = np.zeros(len(freq), dtype=np.uint32)
    rank[used[order]] = np.arange(len(used), dtype=np.uint32)
    codes = rank[tokens]
    lengths = 1 + (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    padded = np.zeros(-(-len(codes) // 4) * 4, dtype=np.uint8)
    padded[: len(codes)] = lengths - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    body = codes.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    head = np.array([len(ids), len(tokens), len(used)], dtype="<u4")
    parts = (_MAGIC, head, np.array(ids, dtype="<i8"), counts.astype("<u4"), used[order].astype("<u4"), control.astype(np.uint8), body)
    return b"".join(p.tobytes() for p in parts)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, tokens of each, and all token ids of a block."""
    if block[:4] != b"MRT1":
        raise ValueError("not a block of token ids")
    docs, tokens, distinct = np.frombuffer(block, "<u4", 3, 4).tolist()
    at = 16
    ids = np.frombuffer(block, "<i8", docs, at)
    counts = np.frombuffer(block, "<u4", docs, at := at + 8 * docs)
    table_ = np.frombuffer(block, "<u4", distinct, at := at + 4 * docs)
    control = np.frombuffer(block, np.uint8, -(-tokens // 4), at := at + 4 * distinct)
    data = np.frombuffer(block, np.uint8, offset=at + len(control)) if at + len(control) < len(block) else np.zeros(0, np.uint8)
    lengths = _LENGTHS[control].ravel()[:tokens].astype(np.int64)
    start = np.cumsum(lengths) - lengths
    data = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    ranks = data[start]
    for k in (1, 2, 3):
        more = lengths > k
        if more.any():
            ranks[more] |= data[start[more] + k] << np.uint32(8 * k)
    return ids, counts, table_[ranks]


_BLOCK = "part int, seq int, first long, first_null int, payload binary, crc32 long, n_tokens long"
_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())


def _write(path: str | None):
    """From the documents (doc_id, text) of a range in order: blocks in order."""
    names = [x.split()[0] for x in _BLOCK.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(drop=False)
        encoder, part = Encoder.of(path, UNITS), TaskContext.get().partitionId()
        seq, first, size = 0, 0, 0
        ids, held = [], []

        def block() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(held), dtype="<u4")
            payload = pack([i or 0 for i in ids], np.array([len(t) // 4 for t in held]), tokens)
            row = (part, seq, first, sum(i is None for i in ids), payload, zlib.crc32(payload), len(tokens))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _KINDS)], names=names)

        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches(it, most=TOGETHER):
            for i, raw in zip(batch.column(0).to_pylist(), encoder.encode_batch(texts(batch))):
                if size >= BLOCK:
                    yield block()
                    seq, first, ids, held, size = seq + 1, first + size, [], [], 0
                ids.append(i)
                held.append(raw + end)
                size += len(raw) // 4 + 1
        if held:
            yield block()

    return run


def write_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the blocks of docs (doc_id, text) in the shared folder and returns the table read back."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).repartitionByRange(parts, *order)
    return stash(ranged.sortWithinPartitions(*order, "text").select("doc_id", "text").mapInArrow(_write(path), _BLOCK), "token-blocks")


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    settle()  # the tokenizer has done its work
    for batch in it:
        for first, null, payload, crc in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if zlib.crc32(payload) != crc:
                raise ValueError("a block of token ids is damaged")
            ids, counts, tokens = unpack(payload)
            counts = counts.astype(np.int64)
            start = np.cumsum(counts) - counts
            raw = tokens.astype("<u4").tobytes()
            crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=np.arange(len(ids)) < null), pa.array(start + first), pa.array(counts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the blocks."""
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("part", before.alias("start"))  # a row for each shuffle partition of the writer
    rows = blocks.join(F.broadcast(starts), "part").select((F.col("start") + F.col("first")).alias("first"), "first_null", "payload", "crc32")
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))
