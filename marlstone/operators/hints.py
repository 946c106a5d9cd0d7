"""A log of hints: added, marked as deleted, never removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "id long, text string, status string, created_at string, updated_at string, source string"


def add(log: DataFrame, text: str, now: str, source: str = "user") -> DataFrame:
    """The log with one more hint, whose id is one over the largest ever given."""
    clean = text.strip()
    if not clean:
        raise ValueError("a hint must say something")
    new = log.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id")).select("id", F.lit(clean).alias("text"), F.lit("active").alias("status"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit(source).alias("source"))
    return log.unionByName(new)


def _marked(log: DataFrame, which, now: str) -> DataFrame:
    return log.withColumns({"updated_at": F.when(which, now).otherwise(F.col("updated_at")), "status": F.when(which, "deleted").otherwise(F.col("status"))})


def delete(log: DataFrame, hint: int, now: str) -> DataFrame:
    if log.filter(F.col("id") == hint).isEmpty():
        raise KeyError(f"no hint {hint}")
    return _marked(log, F.col("id") == hint, now)


def clear(log: DataFrame, now: str) -> DataFrame:
    return _marked(log, F.col("status") == "active", now)


def active(log: DataFrame) -> DataFrame:
    return log.filter("status <> 'deleted'")


def formatted(log: DataFrame) -> str:
    """Active hints as Markdown; nothing if there are none."""
    rows = active(log).orderBy("id").collect()
    return "\n".join(["# Corpus-local active hints", "", "Respect these user hints for this folder/corpus:", "", *(f"- [{r.id}] {r.text}" for r in rows)]) if rows else ""
