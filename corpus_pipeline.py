"""From raw documents to tokens: identify the language, join near duplicates, redact personal data, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and hands the next stage what it reads back. All stages but the last return the columns of documents, unchanged
but where a stage says otherwise; columns of any other name, those of an operator's own results included, pass through.
The stages lower the session's Arrow batches to MOST_ROWS rows, as texts are long and workers' memory is small, and leave
it so, because their results are computed later. Models are fitted on a bounded sample of what reaches their stage. An empty table gives an empty table, and texts of
any length are read whole.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.llm import op01_pii, op02_mixing, op07_jaccard, op09_bpe, op10_language  # noqa: E402
from millrace.llm.common import stash, table  # noqa: E402

#: A document whose best language holds less than this share of its letters is rejected, as is one without letters. With
#: four languages the best share is never below 0.25, with three or fewer never below this, so in effect only documents
#: without letters go; languages that were not learned and evenly mixed texts stay.
LEAST_SHARE = 0.3
MOST_ROWS = 2000
#: SQL has neither a trained field, a network, dependent rounding nor BPE; tests compare run() with plain Python.
ORACLE_SQL = None


def _workers(spark: SparkSession) -> None:
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= MOST_ROWS:
        spark.conf.set(rows, MOST_ROWS)
    root = os.path.dirname(os.path.abspath(__file__))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))


def _numbered(docs: DataFrame, *kept: str) -> tuple[DataFrame, list[str]]:
    """docs with columns c0, c1, .. but for those kept, so that no name clashes with an operator's, and their own names."""
    return docs.toDF(*[c if c in kept else f"c{i}" for i, c in enumerate(docs.columns)]), docs.columns


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters stay, unchanged; LEAST_SHARE says what little else goes.

    Null and empty texts go. Each row is judged by itself: repeated rows stay or go together, and ties between two
    languages are kept.
    """
    _workers(spark)
    model = op10_language.learn(docs)
    plain, names = _numbered(docs, "text")
    found = op10_language.identify(plain, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(plain.columns).toDF(*names)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; rows without an id stay too.

    A document is an id with a text: copies of both are one, and an id that comes with several texts is as many
    documents, each of which stays or goes with its own group. Among those of one id in one group, the smallest digest of
    the text stays; of rows equal in id and text, the smallest in its other columns. Null and empty texts are near
    nothing and stay.
    """
    _workers(spark)
    plain, names = _numbered(docs)
    i, t = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    own = plain.where(F.col(i).isNotNull()).withColumn("digest", F.when(F.col(t).isNotNull(), F.sha2(t, 256)).otherwise(""))
    several = own.groupBy(i).agg((F.min("digest") < F.max("digest")).alias("several")).where("several").limit(1).count()
    if several:  # a document is numbered, as its id is not its own
        numbered = own.select(F.col(i).alias("id"), "digest").distinct().withColumn("key", F.monotonically_increasing_id())
        numbered = stash(numbered, "numbered").hint("merge")
        own = own.join(numbered, (F.col(i) == F.col("id")) & (own["digest"] == numbered["digest"])).select(*plain.columns, "key")
    else:
        own = own.drop("digest").withColumn("key", F.col(i))
    found = op07_jaccard.jaccard_components(own.select(F.col("key").alias("doc_id"), F.col(t).alias("text")))
    found = found.select(F.col("doc_id").alias("key"), "component_id")
    if several:
        named = found.hint("merge").join(numbered, "key")
        first = named.groupBy("component_id").agg(F.min(F.struct("id", "digest", "key")).alias("first"))
        kept = named.join(first.select(F.col("first.key").alias("key")).hint("merge"), "key", "left_semi")
    else:
        kept = found.where("key = component_id")
    kept = stash(kept.groupBy("key").agg(F.count("*").alias("rows")), "kept")
    known = own.join(kept.select("key").hint("merge"), "key", "left_semi")  # grows with the corpus: merged at every size
    if kept.where("rows > 1").limit(1).count():
        order = Window.partitionBy("key").orderBy(*[F.col(c).cast("string") for c in plain.columns if c != t])
        known = known.withColumn("place", F.row_number().over(order)).where("place = 1")
    return known.select(plain.columns).unionByName(plain.where(F.col(i).isNull())).toDF(*names)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans of personal data give way to their kind, and n_chars follows the text.

    Null and empty texts stay as they are; repeated rows are redacted alike.
    """
    _workers(spark)
    redacted = op01_pii.redact(docs, op01_pii.learn(docs))
    if "n_chars" not in docs.columns:
        return redacted.select(docs.columns)
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most twice.

    Texts without a word (null and empty ones) take nothing of the mix: they stand as often as every document of their
    source does at least. Rows that are equal in id, source and words are
    documents of their own; their copies are dealt among them in the order of their texts.
    """
    _workers(spark)
    plain, names = _numbered(docs)
    i, t, s = (f"c{names.index(c)}" for c in ("doc_id", "text", "source"))
    words = F.coalesce(F.regexp_count(t, F.lit(op02_mixing.WORD)), F.lit(0)).cast("long")
    mixed = op02_mixing.mix(plain.select(F.col(i).alias("doc_id"), F.col(s).alias("source"), F.col(t).alias("text")))
    taken = mixed.groupBy("doc_id", "size", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = stash(taken.where("copies > 0"), "taken")  # grows with the corpus: merged at every size, never broadcast
    own = plain.withColumn("words", words)
    both = own.join(taken.hint("merge"), F.col(i).eqNullSafe(F.col("doc_id")) & (F.col("words") == F.col("size")) & F.col(s).eqNullSafe(F.col("source")))
    if taken.where("rows > 1").limit(1).count():
        order = Window.partitionBy("doc_id", "size", "source").orderBy(F.xxhash64(t), *[F.col(c).cast("string") for c in plain.columns])
        place = F.when(F.col("rows") > 1, F.row_number().over(order) - 1).otherwise(0)
        dealt = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("place") < F.col("copies") % F.col("rows"), 1).otherwise(0)
        both = both.withColumn("place", place).withColumn("copies", dealt).where("copies > 0")
    return both.select(*plain.columns, F.explode(F.expr("sequence(1, cast(copies as int))"))).select(plain.columns).toDF(*names)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of each row: ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; repeated rows, and rows with equal ids, give one result each.
    """
    _workers(spark)
    return op09_bpe.encode(docs, keep_ids=True)


STAGES = [
    ("identify_language", identify_language),
    ("join_near_duplicates", join_near_duplicates),
    ("redact_personal_data", redact_personal_data),
    ("mix_sources", mix_sources),
    ("encode_tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
