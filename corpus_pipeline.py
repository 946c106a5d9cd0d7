"""From raw documents to token ids: drop toxic ones, near copies, repeated passages and benchmark leaks, then encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last
return the columns of ``documents``. Rows without an id pass through all stages that don't reject their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import chunk_dedup, decontaminate, op1, sentencepiece_bpe, superminhash, toxicity
from marlstone.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what reaches the threshold of its language; labels of the documents at hand teach."""
    return toxicity.classify(docs.select(COLUMNS), table(spark, sf_dir, "labels")).filter("not flagged").select(COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id; of rows equal in id and text one."""
    # a row's own verdict, as ids may be null or repeated
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"))
    kept = superminhash.near_duplicates(docs.select("doc_id", "text", "_hash"), carry=("_hash",)).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("_hash").alias("kept_hash")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("_hash") == F.col("kept_hash")), "left_semi").select(COLUMNS).dropDuplicates(["doc_id", "text"])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay in the document of the smallest id only; every document stays, with its shorter text."""
    found = chunk_dedup.remove_repeats(docs.select(COLUMNS))
    return found.withColumns({"text": F.col("deduplicated"), "n_chars": F.length("deduplicated").cast("long")}).select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the text that they stand for."""
    coded = sentencepiece_bpe.encode_and_decode(docs.select(COLUMNS), op1.model_file())
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_near_dedup", without_near_copies),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: Trained models and digests have no counterpart in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
