"""Query op8: near-duplicate documents by shingles of four words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import table
from marlstone.llm.superminhash import near_duplicates


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=80)
