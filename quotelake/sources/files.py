"""Files of sessions: exports, installed corpora, cases. Everything is written by Spark's committers, so readers see whole
outputs or none."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotelake.operators.history import recent

CASE = "text string, expected string, kind string, conditions map<string, string>, anchor string, origin string, note string"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, where driver and executors see the same files. Without the setting a local
    folder serves local masters only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="quotelake-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _of_session(history: DataFrame, session_id: int | None) -> DataFrame:
    """A session id of 0 or none means all sessions."""
    return history.where(F.col("session_id") == session_id) if session_id else history


def export_csv(history: DataFrame, path: str, session_id: int | None = None) -> bool:
    """Writes rows in order of time as CSV with a header, in files whose names sort in that order; no file and False where
    there are no rows."""
    rows = _of_session(history, session_id)
    if rows.isEmpty():
        return False
    rows.orderBy("detected_at", "id").write.option("header", True).mode("overwrite").csv(path)
    return True


def export_json(history: DataFrame, path: str, session_id: int | None = None, most: int = 10_000) -> None:
    """Writes the newest rows, newest first, as one JSON array in one text file: `most` bounds it."""
    page = recent(history, most, session_id).withColumn("no", F.row_number().over(_newest_first()))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("no", F.struct(*history.columns).alias("row")))), lambda r: r["row"])
    page.agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _newest_first():
    return Window.orderBy(F.desc("detected_at"), F.desc("id"))


def install(passages: DataFrame, path: str) -> None:
    """Replaces the versions that `passages` has in a store of passages, and their counts beside it; other versions stay."""
    write = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{path}/{name}")
    write(passages, "passages")
    counts = passages.groupBy("version").agg(F.countDistinct("book").alias("books"), F.countDistinct("book", "chapter").alias("chapters"), F.count("*").alias("verses"))
    write(counts.coalesce(1), "counts")


#: The tables of a store of passages.
STORE = {"passages": "book string, chapter long, verse long, text string, version string", "counts": "books long, chapters long, verses long, version string"}


def installed(spark: SparkSession, path: str, name: str = "passages") -> DataFrame:
    return spark.read.schema(STORE[name]).parquet(f"{path}/{name}")


def capture(cases: DataFrame, path: str) -> None:
    """Adds cases (id and the fields of CASE) as JSON, in a folder for each, as they are read by `cases_of`."""
    rows = cases.select("id", F.to_json(F.struct("text", "expected", "kind", "conditions", "anchor", "origin", "note")).alias("value"))
    rows.write.mode("append").partitionBy("id").text(path)


def cases_of(spark: SparkSession, path: str) -> DataFrame:
    """The cases under a folder, one folder for each, named by it; what is no JSON object is left out."""
    read = spark.read.schema(CASE + ", bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    case_id = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    named = read.withColumn("id", F.regexp_replace(F.url_decode(case_id), "^id=", ""))
    return named.where("bad is null").drop("bad")


def flat_cases(spark: SparkSession, path: str, stem: str) -> DataFrame:
    """The cases of one file with a list of them; their ids are the stem and the place in the list."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<struct<id: string, text: string, expected: string, kind: string>>")).alias("pos", "c"))
    return rows.select(F.coalesce("c.id", F.format_string(f"{stem}-%03d", "pos")).alias("id"), "c.text", "c.expected", "c.kind")
