"""Query op4: toxicity of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import toxicity
from marlstone.llm.common import table
from marlstone.llm.labelled import held_out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = toxicity.classify(docs, table(spark, sf_dir, "labels"), dropping=("text",))
    return found.select("doc_id", held_out(found["doc_id"]).alias("held_out"), "score", "predicted", "flagged")
