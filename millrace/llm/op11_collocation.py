"""Collocations by contiguous pattern growth: frequent phrases grow rightwards from the occurrences of their first word.

Each frequent word is a prefix with a projected database: for every occurrence, the words that follow it within its
piece. Growth looks at one prefix at a time, one task each: it counts the next words at its pointers, keeps those with
enough support, and goes on depth first with the pointers of each, so no phrase is counted whose prefix is rare. Tasks
that read texts write equal contexts once with a count. A prefix with more than HOT occurrences, and more than one in
MOST_HOT of all, is dealt into parts by the word after it: the pointers of a longer phrase stay together, and at most
MOST_HOT prefixes are that frequent.

A phrase is then cut after each word; the cut whose score floor(1000000 * a * a / (l * r)) is lowest counts, in exact
decimals of 38 digits, which hold counts up to 10**15. Phrases that stand in a longer frequent one with at least half
of their support give way to it.

Null texts are empty and a null language is `und`. Repeated rows and rows with equal ids are texts of their own; ids are
not read. Empty texts, texts of marks alone and an empty table give nothing. Ties are broken by the phrase's bytes. Texts
are read whole, one after another, whatever their length; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import batches, stash, table
from millrace.llm.shingles import column_bytes

LEAST = 10  # occurrences of a phrase
MOST_WORDS = 3
LISTED = 2000  # phrases of a language
HOT, MOST_HOT = 1 << 16, 1 << 20
TOGETHER = 1 << 23  # bytes of texts that are counted at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.zeros(256, dtype=bool)
_MARK[[*b".,;:!?", *range(10, 14)]] = True
_GAP = _MARK.copy()
_GAP[[9, 32]] = True


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of a column's texts in order, and whether the next word follows in the same piece."""
    data, offsets = column_bytes(column)
    inside = ~_GAP[data]
    edges = np.zeros(len(data) + 1, dtype=bool)
    edges[offsets] = True
    first = inside & edges[:-1]
    first[1:] |= inside[1:] & ~inside[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        return pa.array([], pa.large_binary()), np.zeros(0, dtype=bool)
    last = inside & edges[1:]
    last[:-1] |= inside[:-1] & ~inside[1:]
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - start)])
    text = _LOWER[data[inside]]
    breaks = np.cumsum(_MARK[data], dtype=np.int32)[start]
    text_of = np.searchsorted(offsets, start, side="right")
    joined = np.zeros(len(start), dtype=bool)
    joined[:-1] = (breaks[1:] == breaks[:-1]) & (text_of[1:] == text_of[:-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)]), joined


def _coded(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """(language, distinct words, each word's place among them, whether the next one is joined) for batches of (text, lang)."""
    for batch in batches(it, most=TOGETHER):
        langs = batch.column(1).fill_null("und").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            found, joined = words(batch.column(0).filter(pc.equal(langs.indices, k)))
            coded = found.dictionary_encode()
            yield lang, coded.dictionary, coded.indices.to_numpy(), joined


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, known, codes, _ in _coded(it):
        counts = np.bincount(codes, minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(known), pa.string()), known.cast(pa.large_string()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])


def _projected(hot, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, prefix, part, total, contexts, counts): a batch's occurrences of a word that another one follows.

    contexts holds most - 1 words for each distinct context, each with a space behind it, empty beyond the piece's end;
    counts how often it occurs, as unsigned 32-bit integers. hot: language -> (words, their numbers of parts).
    """
    names = ["lang", "prefix", "part", "total", "contexts", "counts"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, known, codes, joined in _coded(it):
            n, none = len(codes), len(known)
            after = [codes]
            for _ in range(most - 1):
                after.append(np.where(joined, np.append(after[-1][1:], none), none).astype(np.int32))
            at = after[1] < none
            after = [x[at] for x in after]
            if not len(after[0]):
                continue
            part = np.zeros(len(after[0]), dtype=np.int32)
            if lang in hot.value:
                frequent, parts = hot.value[lang]
                place = pc.index_in(known.cast(pa.binary()), value_set=pa.array(frequent, pa.binary())).fill_null(-1).to_numpy()
                into = np.where(place < 0, 1, np.append(parts, 1)[place])[after[0]]
                dealt = into > 1
                hashes = np.zeros(none, dtype=np.uint64)
                needed = np.unique(after[1][dealt])
                hashes[needed] = [xxhash.xxh3_64_intdigest(w) for w in known.take(pa.array(needed)).to_pylist()]
                part[dealt] = hashes[after[1][dealt]] % into[dealt].astype(np.uint64)
            order = np.lexsort((*after[:0:-1], part, after[0]))
            columns = [after[0][order], part[order], *(x[order] for x in after[1:])]
            new = [np.append(True, x[1:] != x[:-1]) for x in columns]
            start = np.flatnonzero(np.logical_or.reduce(new))  # of distinct contexts
            own = np.flatnonzero((new[0] | new[1])[start])  # of prefixes among these
            counts = np.diff(np.append(start, len(order)))
            spaced = pc.binary_join_element_wise(pa.concat_arrays([known.cast(pa.binary()), pa.array([b""], pa.binary())]), pa.scalar(b"", pa.binary()), pa.scalar(b" ", pa.binary()))
            listed = spaced.take(pa.array(np.stack([x[start] for x in columns[2:]], axis=1).ravel()))
            edges = np.frombuffer(listed.buffers()[1], dtype=np.int32)[: len(listed) + 1]
            bounds = np.append(own, len(start))
            contexts = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.ascontiguousarray(edges[bounds * (most - 1)])), listed.buffers()[2]])
            numbers = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(counts.astype("<u4"))])
            prefix = known.take(pa.array(columns[0][start][own])).cast(pa.large_string()).cast(pa.string())
            total = np.add.reduceat(counts, own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), prefix, pa.array(columns[1][start][own]), pa.array(total, pa.int64()), contexts, numbers], names=names)

    return run


def grow(codes: np.ndarray, counts: np.ndarray, least: int, none: int, emit: Callable[[tuple[int, ...], int], None], at: np.ndarray | None = None, prefix: tuple[int, ...] = ()) -> None:
    """Emits (next words, support) of every frequent extension of a prefix, depth first.

    codes: the following words of each context in columns, `none` beyond a piece's end; at: pointers to the contexts that
    begin with the prefix's extension so far.
    """
    at = np.arange(len(codes)) if at is None else at
    following = codes[at, len(prefix)]
    order = np.argsort(following, kind="stable")
    at, following = at[order], following[order]
    start = np.flatnonzero(np.append(True, following[1:] != following[:-1]))
    support = np.add.reduceat(counts[at], start)
    for k in np.flatnonzero((support >= least) & (following[start] != none)).tolist():
        longer = (*prefix, int(following[start[k]]))
        emit(longer, int(support[k]))
        if len(longer) < codes.shape[1]:
            grow(codes, counts, least, none, emit, at[start[k] : start[k + 1] if k + 1 < len(start) else len(at)], longer)


def _grown(least: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, phrase, words, a) from projections sorted by language, prefix and part."""

    def mined(rows: pa.Table) -> pa.RecordBatch:
        """The frequent phrases of whole groups of rows."""
        out: list[tuple[str, str, int, int]] = []
        key = [rows.column(k).combine_chunks() for k in range(3)]
        new = np.append(True, np.logical_or.reduce([pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False) for x in key]))
        group = np.cumsum(new) - 1
        totals = np.bincount(group, weights=rows.column(3).to_numpy()).astype(np.int64)
        at = np.flatnonzero(totals[group] >= least)  # a rarer prefix has no frequent extension
        if len(at):
            kept = rows.take(pa.array(at))
            numbers = kept.column(5).to_pylist()
            text = np.frombuffer(b"".join(kept.column(4).to_pylist()), dtype=np.uint8)
            edges = np.append(0, np.flatnonzero(text == 32) + 1)
            listed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(text)]).dictionary_encode()
            known = [w.decode()[:-1] for w in listed.dictionary.to_pylist()]
            none = known.index("") if "" in known else -1
            codes = listed.indices.to_numpy().reshape(-1, most - 1)
            counts = np.frombuffer(b"".join(numbers), dtype="<u4").astype(np.int64)
            bounds = np.append(0, np.cumsum([len(x) // 4 for x in numbers]))
            first = np.flatnonzero(np.append(True, np.diff(group[at]) > 0))
            langs, prefixes = (x.take(pa.array(at[first])).to_pylist() for x in key[:2])
            for k, (lang, prefix) in enumerate(zip(langs, prefixes)):
                a, b = bounds[first[k]], bounds[first[k + 1] if k + 1 < len(first) else len(at)]
                grow(codes[a:b], counts[a:b], least, none, lambda longer, n: out.append((lang, " ".join([prefix, *(known[c] for c in longer)]), 1 + len(longer), n)))  # noqa: B023
        types = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=["lang", "phrase", "words", "a"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[pa.RecordBatch] = []  # of the group that the next batch may go on with
        for batch in it:
            for a, b in _whole(batch):
                piece = batch.slice(a, b - a)
                last = _last_group(piece)
                if last == 0 and open_rows and _key(open_rows[0], 0) == _key(piece, 0):
                    open_rows.append(piece)
                    continue
                if open_rows and _key(open_rows[0], 0) != _key(piece, 0):
                    yield mined(pa.Table.from_batches(open_rows))
                    open_rows = []
                if last:
                    yield mined(pa.Table.from_batches([*open_rows, piece.slice(0, last)]))
                open_rows = [piece.slice(last)]
        if open_rows:
            yield mined(pa.Table.from_batches(open_rows))

    return run


def _whole(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    from millrace.llm.shingles import slices

    return slices(batch.column(4), TOGETHER)


def _key(batch: pa.RecordBatch, row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in range(3))


def _last_group(batch: pa.RecordBatch) -> int:
    """The row at which the last group of sorted rows begins."""
    same = np.logical_and.reduce([pc.equal(batch.column(k), batch.column(k)[len(batch) - 1]).to_numpy(zero_copy_only=False) for k in range(3)])
    return int(np.argmax(same))


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of docs (text, lang)."""
    return docs.select("text", "lang").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hot(counted: DataFrame, hot: int, most_hot: int) -> dict[str, tuple[list[bytes], np.ndarray]]:
    """The words of each language that are dealt into parts, fewer than most_hot, and their numbers of parts."""
    least = max(hot, (counted.agg(F.sum("n")).head()[0] or 0) / most_hot)
    out: dict[str, tuple[list[bytes], list[int]]] = {}
    for lang, word, n in counted.where(F.col("n") > least).collect():
        known, parts = out.setdefault(lang, ([], []))
        known.append(word.encode())
        parts.append(int(n // least) + 1)
    return {k: (w, np.array(p)) for k, (w, p) in out.items()}


def frequent_phrases(docs: DataFrame, counted: DataFrame, least: int = LEAST, most: int = MOST_WORDS, hot: int = HOT) -> DataFrame:
    """(lang, phrase, words, a): the phrases of 2 to `most` words with at least `least` occurrences. counted: count_words(docs)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_hot(counted, hot, MOST_HOT))
    projected = docs.select("text", "lang").mapInArrow(_projected(sent, most), "lang string, prefix string, part int, total long, contexts binary, counts binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = projected.repartition(parts, "lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part")
    return dealt.mapInArrow(_grown(least, most), "lang string, phrase string, words int, a long")


def scored(phrases: DataFrame, counted: DataFrame) -> DataFrame:
    """Adds l, r and score of each phrase's lowest-scoring cut; of equal scores the first cut counts."""
    support = phrases.select("lang", "phrase", "a").unionByName(counted.select("lang", F.col("word").alias("phrase"), F.col("n").alias("a")))
    cut = phrases.select("*", F.split("phrase", " ").alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumn("first", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " "))
    cut = cut.drop("w").join(support.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cut = cut.join(support.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r"))
    exact = cut.withColumn("aa", F.lit(1000000).cast("decimal(7,0)") * (a * a)).withColumn("lr", l * r)
    valued = exact.withColumn("score", F.expr("aa div lr"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return valued.groupBy("lang", "phrase", "words", "a").agg(best).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def overshadowed(phrases: DataFrame, share: int = 50) -> DataFrame:
    """(lang, phrase): phrases inside a longer one that has at least `share` hundredths of their occurrences."""
    longer = phrases.select("lang", F.col("a").alias("most"), "words", F.split("phrase", " ").alias("w"))
    sizes = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("size"))
    at = sizes.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at")).where("size > 1")
    inner = at.select("lang", "most", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    return inner.join(phrases, ["lang", "phrase"]).where(100 * F.col("most").cast("decimal(19,0)") >= share * F.col("a").cast("decimal(19,0)")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, listed: int = LISTED, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `listed` phrases of each language of docs (text, lang)."""
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    counted = stash(count_words(docs), "words")
    phrases = stash(frequent_phrases(docs, counted, least, most), "phrases")
    kept = scored(phrases, counted.where(F.col("n") >= least)).join(overshadowed(phrases, share), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= listed)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), numbered AS (
  SELECT lang, row_number() OVER () AS piece_id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), flat AS (
  SELECT lang, piece_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM numbered
), placed AS (
  SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM flat WINDOW o AS (PARTITION BY piece_id ORDER BY i)
), grams AS (
  SELECT lang, 1 AS k, w AS phrase FROM placed
  UNION ALL SELECT lang, 2, w || ' ' || w2 FROM placed WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM placed WHERE w3 IS NOT NULL
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
), candidates AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10
), parts AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(ws[: cut], ' ') AS first_part, array_to_string(ws[cut + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
), cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, CAST((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first_part JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_ones AS (
  SELECT lang, array_to_string(ws[: 2], ' ') AS phrase, a FROM candidates WHERE k = 3
  UNION ALL SELECT lang, array_to_string(ws[2 :], ' '), a FROM candidates WHERE k = 3
), dropped AS (
  SELECT DISTINCT b.lang, b.phrase FROM best b JOIN inner_ones i ON i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 50 * b.a
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, t.n, score
FROM best b JOIN totals t ON t.lang = b.lang
WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.lang = b.lang AND d.phrase = b.phrase)
QUALIFY rank <= 2000
"""
