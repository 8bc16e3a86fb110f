"""Readers and sinks: JSON lines, JSON arrays, CSV, file listings, exclusive writes and immutable generations."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); unset in a local session, as in tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stash(rows: DataFrame, name: str) -> DataFrame:
    """Writes rows in the shared folder and reads them back: what follows is computed from them, whatever executor is lost."""
    path = f"{shared_dir(rows.sparkSession)}/millrace/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder on whatever file system holds it; False where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. A line that is no object fails the read, or stands in _corrupt_record if not strict."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').mode("errorifexists").csv(path)


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".docx", ".md", ".txt"), known: DataFrame | None = None) -> DataFrame:
    """(path, name, size, sha256) of files below a folder by suffix, without those whose lower-cased name is in `known` (name)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = found.select("path", name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    rows = rows.where(F.lower("name").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    if known is not None:
        rows = rows.join(known.select(F.lower("name").alias("_known")).distinct(), F.lower("name") == F.col("_known"), "left_anti")
    return rows


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Refuses to overwrite."""
    rows.write.mode("errorifexists").json(path)


class Generations:
    """Immutable versions of a table with one current pointer: stage, check, publish; a failed build leaves the pointer alone.

    The pointer is a small Parquet table of (name, properties) rows, one folder a revision; the largest revision is
    current. A revision's folder is written only where none exists, so of two publishers of one revision the second fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def stage(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/generations/{name}")
        return name

    def publish(self, name: str, expected: int, **properties) -> int:
        """Makes a staged generation current if it has the expected rows and the properties of its predecessor; gives the new revision."""
        found = self.spark.read.parquet(f"{self.root}/generations/{name}").count()
        if found != expected:
            raise ValueError(f"staged {found} rows; {expected} were expected")
        current = self._current()
        text = json.dumps(properties, sort_keys=True)
        if current is not None and current["properties"] != text:
            raise ValueError(f"properties {text} differ from {current['properties']}")
        revision = 1 if current is None else current["revision"] + 1
        pointer = self.spark.createDataFrame([(name, text)], "name string, properties string")
        pointer.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/pointer/revision={revision}")
        return revision

    def _current(self):
        try:
            rows = self.spark.read.schema("name string, properties string, revision long").parquet(f"{self.root}/pointer")
            return rows.orderBy(F.desc("revision")).limit(1).first()
        except Exception as e:  # no pointer yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def read(self) -> DataFrame:
        current = self._current()
        if current is None:
            raise ValueError("no generation is published")
        return self.spark.read.parquet(f"{self.root}/generations/{current['name']}")
