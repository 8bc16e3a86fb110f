"""BPE encoding and decoding with reuse of content-defined chunks.

A polynomial rolling hash over 32 bytes cuts each text where its low bits are zero, so equal passages give equal
chunks wherever they stand. Chunks that occur more than once in the corpus are encoded once for all documents that
hold them; the others are encoded where they stand. Encoding a chunk alone is exact only between the safe points
inside it, so around each join the stretch from the last safe point before it to the first one after it is encoded
again, and widened until the kept ids on both sides end exactly at the stretch's edges. The ids then equal those of
the tokenizers library for the whole text, and decoding gives its decode(ids, skip_special_tokens=False).

Equal texts of one batch are one text until the end. The set of repeated chunks reaches the tasks as a Bloom filter of
fixed size: a false positive costs one needless trip of a chunk, nothing else. Chunks are matched by hash and then by
their bytes. A chunk with more than HOT holders, and more than one in MOST_HOT of all, is dealt into parts that are
encoded once each, so no task serves all holders of a license line; at most MOST_HOT chunks are that frequent.

Null and empty texts give no ids, an empty table an empty result. Repeated rows, and rows with equal ids, give one
result each. Texts may be as long as Arrow's batches allow (2 GB); one text is encoded by one task. Other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import Encoder
from millrace.llm.common import batches, stash, table
from millrace.llm.op07_jaccard import bloom, in_bloom
from millrace.llm.shingles import mix

WINDOW_STEPS = 5  # 2**5 bytes
MASK = np.uint64((1 << 11) - 1)  # a cut every 2 KiB on average
LEAST = 256  # a chunk shorter than this is joined to the one before
HOT, MOST_HOT = 10_000, 1 << 16
TOGETHER = 1 << 21  # bytes of texts that one batch holds
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_P = np.uint64(0xD6E8FEB86659FD93)
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[33:127] = True


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions inside a text's bytes where a chunk starts, by its content alone; never inside a character."""
    n = len(data)
    size = 1 << WINDOW_STEPS
    if n <= size:
        return np.zeros(0, dtype=np.int64)
    h, p = _BYTE[data], np.array([_P])  # an array wraps silently
    for step in range(WINDOW_STEPS):  # windows of 1, 2, 4 .. bytes double
        width = 1 << step
        h = h[:-width] * p + h[width:]
        p = p * p
    at = np.flatnonzero((mix(h) & MASK) == 0) + size
    at = at[at < n]
    return at[(data[at] & 0xC0) != 0x80]


def chunks(data: np.ndarray) -> np.ndarray:
    """The edges of a text's chunks, from 0 to its length."""
    at = cuts(data)
    if len(at):
        kept, last = [], 0
        for c in at.tolist():
            if c - last >= LEAST:
                kept.append(c)
                last = c
        at = np.array(kept, dtype=np.int64)
    return np.concatenate([[0], at, [len(data)]]).astype(np.int64)


def safe_points(data: np.ndarray) -> np.ndarray:
    """Places of single spaces between two visible ASCII characters: always edges of the tokenizer's pieces."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero((data[1:-1] == 32) & _VISIBLE[data[:-2]] & _VISIBLE[data[2:]]) + 1


def kept_parts(data: np.ndarray, edges: np.ndarray, ids: list[np.ndarray], encoder: Encoder) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, ids) of the stretches of a text whose ids those of its chunks are; what lies between is encoded again.

    A chunk's ids are kept from its first to its last safe point at which one of its tokens ends; a chunk without such
    places is encoded again as a whole, together with the stretches at its sides.
    """
    safe, n = safe_points(data), len(data)
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        ends = np.concatenate([[a], a + np.cumsum(encoder.sizes[ids[k]])])
        inner = safe[np.searchsorted(safe, a) : np.searchsorted(safe, b, side="right")].tolist()
        low = [0] if a == 0 else inner
        high = [n] if b == n else inner[::-1]
        start = next((p for p in low if ends[np.searchsorted(ends, p)] == p), None)
        stop = next((p for p in high if ends[min(np.searchsorted(ends, p), len(ends) - 1)] == p), None)
        if start is not None and stop is not None and stop > start:
            yield start, stop, ids[k][np.searchsorted(ends, start) : np.searchsorted(ends, stop)]


def assemble_batch(texts: list[np.ndarray], edges: list[np.ndarray], ids: list[list[np.ndarray]], encoder: Encoder) -> list[np.ndarray]:
    """The ids of whole texts from those of their chunks; all stretches around joins are encoded together."""
    out: list[list[np.ndarray | None]] = []
    waiting: list[str] = []
    for data, cut, own in zip(texts, edges, ids):
        raw, done, row = data.tobytes(), 0, []
        for start, stop, kept in kept_parts(data, cut, own, encoder):
            if start > done:
                waiting.append(raw[done:start].decode())
                row.append(None)
            row.append(kept)
            done = stop
        if done < len(raw):
            waiting.append(raw[done:].decode())
            row.append(None)
        out.append(row)
    again = iter(encoder.encode_batch(waiting))
    whole = [[np.frombuffer(next(again), dtype="<u4") if x is None else x for x in row] for row in out]
    return [np.concatenate(row) if row else np.zeros(0, dtype="<u4") for row in whole]


def assemble(data: np.ndarray, edges: np.ndarray, ids: list[np.ndarray], encoder: Encoder) -> np.ndarray:
    return assemble_batch([data], [edges], [ids], encoder)[0]


def _digest(ids: np.ndarray, encoder: Encoder) -> tuple[int, str, str]:
    listed = ids.tolist()
    named = hashlib.sha256(b",".join(map(encoder.decimals.__getitem__, listed))).hexdigest()
    back = b"".join(map(encoder.pieces.__getitem__, listed))
    try:
        back.decode()
    except UnicodeDecodeError:
        back = back.decode("utf-8", "replace").encode()
    return len(listed), named, hashlib.sha256(back).hexdigest()


def _hash(b: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(b)).astype(np.int64))


def _texts(batch: pa.RecordBatch) -> dict[bytes, list[int]]:
    """The distinct texts of a batch with the rows that hold each."""
    out: dict[bytes, list[int]] = {}
    for i, raw in enumerate(batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()):
        out.setdefault(raw or b"", []).append(i)
    return out


def _chunked(docs: dict[bytes, list[int]]) -> tuple[list[list[int]], list[list[int]]]:
    """The edges and the hashes of each text's chunks."""
    edges = [chunks(np.frombuffer(d, dtype=np.uint8)).tolist() for d in docs]
    return edges, [[_hash(d[a:b]) for a, b in zip(e, e[1:]) if b > a] for d, e in zip(docs, edges)]


def _chunk_hashes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it, most=TOGETHER):
        found = [h for hashes in _chunked(_texts(batch))[1] for h in hashes]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["h"])


def _hits(hashes: list[list[int]], flat: np.ndarray) -> list[list[int]]:
    """The places of each text's chunks that the filter may hold."""
    hit = in_bloom(np.array([h for hs in hashes for h in hs], dtype=np.int64), flat)
    own = np.cumsum([0, *map(len, hashes)]).tolist()
    return [np.flatnonzero(hit[a:b]).tolist() for a, b in zip(own, own[1:])]


_DONE = ["doc_id", "ids", "n", "named", "back"]


def _finished(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=_DONE)


def _alone(path: str | None, repeated, keep_ids: bool):
    """Finished rows of the texts without a repeated chunk."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches(it, most=TOGETHER):
            docs = _texts(batch)
            hits = _hits(_chunked(docs)[1], repeated.value)
            own = [(d, at) for (d, at), hit in zip(docs.items(), hits) if not hit]
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            rows = []
            for (_, at), b in zip(own, encoder.encode_batch([d.decode() for d, _ in own])):
                done = (b if keep_ids else None, *_digest(np.frombuffer(b, dtype="<u4"), encoder))
                rows += [(ids[i], *done) for i in at]
            yield _finished(rows)

    return run


#: kind 1: a waiting text (docs, row, body); 2: a repeated chunk (h, part, body) with the rows and places that hold it.
_ROWS = "kind int, docs array<long>, row long, h long, part long, body binary, rows array<long>, places array<int>"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
_TYPES = [pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]


def _shared(repeated, hot):
    """The texts that hold repeated chunks, and these chunks; hot: the number of parts of the most frequent ones by hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, turn = TaskContext.get().partitionId() << 33, 0
        for batch in batches(it, most=TOGETHER):
            docs, rows = _texts(batch), []
            edges, hashes = _chunked(docs)
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            held: dict[bytes, tuple[int, list[int], list[int]]] = {}
            for (text, at), e, hs, hit in zip(docs.items(), edges, hashes, _hits(hashes, repeated.value)):
                if hit:
                    rows.append((1, [ids[i] for i in at], row, None, None, text, None, None))
                    for k in hit:
                        _, holders, places = held.setdefault(text[e[k] : e[k + 1]], (hs[k], [], []))
                        holders.append(row)
                        places.append(k)
                    row += 1
            turn += 1
            part = (TaskContext.get().partitionId() * 31 + turn) % MOST_HOT
            rows += [(2, None, None, h, part % hot.value.get(h, 1), body, holders, places) for body, (h, holders, places) in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t) for t in _TYPES], names=_NAMES)

    return run


def _encode_chunks(path: str | None):
    """From rows (h, body, rows, places) sorted by h: (row, place, ids) for each holder; each chunk of a part is encoded once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        kind, known = "<u2" if len(encoder.pieces) <= 1 << 16 else "<u4", {}
        for batch in batches(it, "body", 1 << 21):
            rows, places, ids = [], [], []
            bodies = batch.column(1).to_pylist()
            known = {b: known[b] for b in bodies if b in known}  # a chunk's holders may stand in two batches
            new = [*dict.fromkeys(b for b in bodies if b not in known)]
            known.update((b, np.frombuffer(c, dtype="<u4").astype(kind).tobytes()) for b, c in zip(new, encoder.encode_batch([b.decode() for b in new])))
            for body, at, where in zip(bodies, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                rows += at
                places += where
                ids += [known[body]] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(places, pa.int32()), pa.array(ids, pa.binary())], names=["row", "place", "ids"])

    return run


def _second_pass(path: str | None, keep_ids: bool):
    """From rows (row, place, docs, body) sorted by row and place: a text comes first (place -1), then the ids of its repeated chunks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        kind = "<u2" if len(encoder.pieces) <= 1 << 16 else "<u4"

        def finished(held: list[tuple]) -> pa.RecordBatch:
            """held: (ids of documents, text, token ids of its repeated chunks by place)."""
            texts = [np.frombuffer(text, dtype=np.uint8) for _, text, _ in held]
            edges = [chunks(t) for t in texts]
            rest = [[k for k in range(len(e) - 1) if k not in given] for e, (_, _, given) in zip(edges, held)]
            coded = iter(encoder.encode_batch([h[1][e[k] : e[k + 1]].decode() for h, e, ks in zip(held, edges, rest) for k in ks]))
            ids = [[np.frombuffer(given[k], dtype=kind).astype("<u4") if k in given else np.frombuffer(next(coded), dtype="<u4") for k in range(len(e) - 1)] for e, (_, _, given) in zip(edges, held)]
            rows = []
            for (docs, _, _), own in zip(held, assemble_batch(texts, edges, ids, encoder)):
                done = (own.tobytes() if keep_ids else None, *_digest(own, encoder))
                rows += [(d, *done) for d in docs]
            return _finished(rows)

        held: list[tuple] = []
        size = 0
        for batch in batches(it, "body", 1 << 21):
            for place, docs, body in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if place < 0:
                    if size >= 1 << 21:
                        yield finished(held)
                        held, size = [], 0
                    held.append((docs, body, {}))
                    size += len(body)
                else:
                    held[-1][2][place] = body
        if held:
            yield finished(held)

    return run


def _hot(counts: DataFrame) -> dict[int, int]:
    """The number of parts of each chunk (h, count) with over HOT holders and over one in MOST_HOT of all: fewer than MOST_HOT."""
    least = max(HOT, (counts.agg(F.sum("count")).head()[0] or 0) / MOST_HOT)
    return {h: int(n // least) + 1 for h, n in counts.where(F.col("count") > least).select("h", "count").collect()}


def encode(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every row of docs (doc_id, text).

    ids holds little-endian uint32 where keep_ids is set, else null. path: the tokenizer's file on every worker.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    repeated = stash(docs.select("text").mapInArrow(_chunk_hashes, "h long").groupBy("h").count().where("count > 1"), "repeated")
    flat = spark.sparkContext.broadcast(bloom(repeated, "h"))
    hot = spark.sparkContext.broadcast(_hot(repeated))
    first = stash(docs.mapInArrow(_shared(flat, hot), _ROWS), "bpe")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = first.where("kind = 2").select("h", "body", "rows", "places", "part").repartition(parts, "h", "part").sortWithinPartitions("h", "part")
    coded = shared.mapInArrow(_encode_chunks(path), "row long, place int, ids binary")
    waiting = first.where("kind = 1").select("row", F.lit(-1).alias("place"), "docs", "body")
    both = waiting.unionByName(coded.select("row", "place", F.lit(None).cast("array<long>").alias("docs"), F.col("ids").alias("body")))
    joined = both.repartition(parts, "row").sortWithinPartitions("row", "place")
    done = "doc_id long, ids binary, n long, named string, back string"
    out = docs.mapInArrow(_alone(path, flat, keep_ids), done).unionByName(joined.mapInArrow(_second_pass(path, keep_ids), done))
    return out.select("doc_id", "ids", F.col("n").alias("n_tokens"), F.col("named").alias("ids_sha256"), F.col("back").alias("decoded_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).drop("ids")
