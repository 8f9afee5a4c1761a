"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Toxic documents go; repeated lines go; one document of each near-duplicate group stays (five-word shingles, similarity 0.8 or
more); benchmark passages are cut out; what is left is encoded. Documents that a stage has no reason to reject stay,
those left with empty text too. A stage's function takes (spark, docs, sf_dir) and returns a DataFrame, with the
columns of ``documents`` for all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.llm.bpe import encode_documents
from recurra.llm.common import Scratch, table
from recurra.llm.decontamination import decontaminate
from recurra.llm.line_dedup import dedup_lines
from recurra.llm.near_dedup import near_duplicates
from recurra.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with another column as the text."""
    new = docs.withColumn("text", F.col(text)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return new.select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(dedup_lines(docs), "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(decontaminate(docs, table(spark, sf_dir, "benchmark")), "clean_text")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = encode_documents(docs)
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]
#: The model of the first stage can't be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
