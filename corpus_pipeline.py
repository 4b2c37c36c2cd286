"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm import minhash, packing, quality, substring
from quotelake.llm.common import Workspace
from quotelake.llm.queries import table, tokenizer_file


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on `labels`, does not reject: whole rows, whatever is null in them and
    however often they come. Columns named like a score keep their own values."""
    own = {c: f"own_{c}" for c in docs.columns if c in quality.SCORE_NAMES}
    rated = quality.classify(docs.withColumnsRenamed(own), table(spark, sf_dir, "labels"))
    return rated.where("selected").select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; rows repeated as they are go too."""
    found = minhash.near_duplicates(docs)
    keep = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.join(keep, docs["doc_id"] == keep["kept_id"], "left_semi")
    if not kept.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a document with a smaller doc_id holds. Null texts and rows
    with a null doc_id stay as they are; repeated rows lose the same words."""
    return substring.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids; a null text is its end id, repeated rows are packed as often as they come."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", select_quality), ("near_copies", drop_near_copies), ("repeats", remove_repeats), ("packing", pack)]

#: Fitting, shingling and packing are not expressible in SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; what a stage gives is written before the next one reads it."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
