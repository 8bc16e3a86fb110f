"""Corpus curation: de-duplication, near duplicates, gates with reasons, reviews and decontamination."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import key
from millrace.sources.tables import shared_dir


def first_of(rows: DataFrame, keys: list[str], *order: Column, where: Column | None = None) -> DataFrame:
    """The first row of each key among those that pass `where`: a row that fails does not reserve its key."""
    rows = rows if where is None else rows.where(where)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, by: str, position: str, value: str) -> DataFrame:
    """(key, value, position): the last value of each key at the key's first position."""
    return rows.groupBy(by).agg(F.max_by(value, position).alias(value), F.min(position).alias(position))


def decontaminate(docs: DataFrame, held_out: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose whole normalised text is no held-out text."""
    return docs.withColumn("_key", key(text)).join(held_out.select(key(text).alias("_key")), "_key", "left_anti").drop("_key")


def trigrams(text) -> Column:
    """Distinct character trigrams of a text without non-word characters."""
    plain = F.regexp_replace(text, r"[^\p{L}\p{N}_]", "")
    size = F.length(plain)
    return F.when(size >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), size - 2), lambda i: F.substring(plain, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


BLOCK = 1024  # classes that one product compares with as many
BANDS = 4  # of sizes, for each factor of the threshold
BITS = 1024  # of a sketch
TOGETHER = 8  # blocks of one partition where all meet


def _blocks(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """classes with `block`, a number of about `block` classes of like size: the sizes of two near ones are at most BANDS bands apart."""
    banded = classes.withColumn("band", F.floor(F.ln("n") / F.lit(-math.log(threshold)) * BANDS + 1e-9).cast("long"))
    counts = banded.groupBy("band").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("long").alias("blocks"))
    own = banded.join(F.broadcast(counts), "band")  # one row a band: the logarithm of the longest text
    return own.withColumn("block", F.col("band") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")


def sketch(grams: np.ndarray) -> bytes:
    """For each of BITS hashes, whether an odd number of the grams has it."""
    with np.errstate(over="ignore"):
        h = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    odd = np.bincount((h >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _block_row(group: pa.Table) -> pa.Table:
    """From the classes (block, band, id, n, bits) of a block: one row."""
    bits = b"".join(group.column("bits").to_pylist())
    ids, n = group.column("id").to_numpy(), group.column("n").to_numpy()
    return pa.table({"block": group.column("block")[:1], "band": group.column("band")[:1], "ids": pa.array([ids.astype("<i8").tobytes()]), "sizes": pa.array([n.astype("<i8").tobytes()]), "bits": pa.array([bits])})


def _meetings(threshold: float):
    """From rows of two blocks each (low, high, and ids, sizes, bits of both): the classes (id, low, high) whose sketches allow a link with one of the other block.

    Sets differ in no fewer grams than their sketches do in bits.
    """
    share = (1 - threshold) / (1 + threshold)  # of both sizes, what near sets may differ in

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                own = row["low"] == row["high"]
                x, y = (2 * np.unpackbits(np.frombuffer(row[f"{s}_bits"], np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32) - 1 for s in "ab")
                n, m = (np.frombuffer(row[f"{s}_sizes"], "<i8") for s in "ab")
                same = x @ y.T  # BITS less twice the bits that differ
                same += (2 * share * n + 0.01)[:, None].astype(np.float32)
                same += (2 * share * m)[None].astype(np.float32)
                near = same >= BITS
                if own:
                    np.fill_diagonal(near, False)
                a, b = (np.frombuffer(row[f"{s}_ids"], "<i8") for s in "ab")
                ids = np.unique(np.concatenate([a[near.any(axis=1)], b[near.any(axis=0)]]))
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), row["low"])), pa.array(np.full(len(ids), row["high"]))], names=["id", "low", "high"])

    return run


def _products(threshold: float):
    """From the classes (low, high, block, size, id, plain) of two blocks: the pairs that reach the threshold, by products of 0/1 matrices."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        id, block, low = group.column("id").to_numpy(), group.column("block").to_numpy(), group.column("low")[0].as_py()
        grams = [_trigram_codes(t) for t in group.column("plain").to_pylist()]
        n = np.array([len(g) for g in grams])
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == group.column("high")[0].as_py())
        _, column = np.unique(np.concatenate(grams), return_inverse=True)
        row = np.repeat(np.arange(len(id)), n)
        place = np.full((2, len(id)), -1)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        shared = np.zeros((len(left), len(right)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            here = slice(*np.searchsorted(column, (at, at + 2048)))
            x = np.zeros((2, len(id), 2048), dtype=np.float32)[:, : max(len(left), len(right))]
            for side in (0, 1):
                r = place[side, row[here]]
                x[side, r[r >= 0], column[here][r >= 0] - at] = 1
            shared += x[0, : len(left)] @ x[1, : len(right)].T
        near = shared / (n[left][:, None] + n[right][None] - shared) >= threshold - 1e-6
        i, j = np.nonzero(near)
        both = shared[i, j].astype(np.float64)
        similarity = both / (n[left][i] + n[right][j] - both)
        a, b = id[left][i], id[right][j]
        size = group.column("size").to_numpy().astype(np.float64)
        p, q = size[left][i], size[right][j]
        keep = (similarity >= threshold) & (np.minimum(p, q) >= threshold * np.maximum(p, q)) & (a != b) & ((a < b) | (low != group.column("high")[0].as_py()))
        return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": similarity[keep]})

    return run


def _trigram_codes(text: str) -> np.ndarray:
    """The distinct trigrams of a text as numbers, three code points of 21 bits."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _sketches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (plain, id): each text with its length, the number of its distinct trigrams and their sketch."""
    for batch in it:
        texts = batch.column(0).to_pylist()
        grams = [_trigram_codes(t) for t in texts]
        numbers = [pa.array([len(x) for x in v], pa.int64()) for v in (texts, grams)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), *numbers, pa.array([sketch(g) for g in grams], pa.binary())], names=["id", "plain", "size", "n", "bits"])


def near_duplicates(rows: DataFrame, id: str, text: str = "text", threshold: float = 0.75, least: int = 12, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) of different texts of `least` word characters or more, of lengths within the threshold, whose
    trigram Jaccard reaches it.

    Equal texts are one class, and ids are long. Classes of like size fall into blocks, and all blocks of like size meet
    by their sketches of 128 bytes a class, which are read for each meeting and never written again. Texts go only to the
    meetings where a sketch leaves a link possible, and are compared there as products of 0/1 matrices. What is written
    and shuffled grows with the input and its links; products of sketches grow with the square of the classes of a size.
    """
    own = rows.select(F.col(id).cast("long").alias("id"), F.regexp_replace(text, r"[^\p{L}\p{N}_]", "").alias("plain")).where(F.length("plain") >= least)
    classes = own.groupBy("plain").agg(F.min("id").alias("id")).mapInArrow(_sketches, "id long, plain string, size long, n long, bits binary")
    shared = f"{shared_dir(rows.sparkSession)}/trigrams-{uuid.uuid4().hex}"
    classes.write.parquet(f"{shared}/classes")  # read several times below
    classes = _blocks(rows.sparkSession.read.parquet(f"{shared}/classes"), threshold, block)
    packed = classes.select("block", "band", "id", "n", "bits").groupBy("block").applyInArrow(_block_row, "block long, band long, ids binary, sizes binary, bits binary")
    packed.write.parquet(f"{shared}/blocks")
    packed = rows.sparkSession.read.parquet(f"{shared}/blocks")
    dealt = packed.repartition(max(1, -(-packed.count() // TOGETHER)))  # evenly, so few blocks meet in one task
    a, b = (dealt.select(*[F.col(c).alias(f"{s}_{c}") for c in packed.columns]) for s in "ab")
    like = (F.col("a_block") <= F.col("b_block")) & (F.col("b_band") - F.col("a_band") <= BANDS)
    both = a.join(b.hint("shuffle_replicate_nl"), like).select(F.col("a_block").alias("low"), F.col("b_block").alias("high"), *[f"{s}_{c}" for s in "ab" for c in ("ids", "sizes", "bits")])
    both.mapInArrow(_meetings(threshold), "id long, low long, high long").write.parquet(f"{shared}/meetings")
    meets = rows.sparkSession.read.schema("id long, low long, high long").parquet(f"{shared}/meetings")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work: not to be coalesced
    texts = classes.select("id", "block", "size", "plain")
    return meets.join(texts, "id").repartition(parts, "low", "high").groupBy("low", "high").applyInArrow(_products(threshold), "a long, b long, similarity double")


def funnel(rows: DataFrame, reason: str) -> DataFrame:
    """(reason, n) with rows that no reason excludes counted as eligible."""
    return rows.groupBy(F.coalesce(F.col(reason), F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


def replay_audit(spans: DataFrame, sources: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, reason) of stored spans (id, start, size, said) that are not what their source holds there, or have none."""
    both = spans.join(sources.select(id, F.col(text).alias("_text")), id, "left")
    reason = F.when(F.col("_text").isNull(), "missing").when(F.col("said") != F.substring("_text", F.col("start") + 1, F.col("size")), "changed")
    return both.select(id, "start", reason.alias("reason")).where("reason is not null")
