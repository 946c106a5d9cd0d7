"""Labelled documents for training: which rows may teach, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import without


def held_out(doc_id: Column) -> Column:
    """True for the rows from which nothing is learnt; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def usable_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label int) without rows that lack id or label and held-out ones; of several labels of an id the largest counts."""
    return labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *extra: str) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, *extra, label int) of per_class documents of each class at most, chosen by a hash of the
    id, and how many there are of each class.

    Rows without id or label, and held-out ones, are left out; of several labels of an id the largest counts,
    of several documents one.
    """
    usable = usable_labels(labels, label)
    counts = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    chosen = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    texts = without(docs, "label").select("doc_id", "text", *extra)
    # at most twice per_class ids, a parameter: safe to broadcast
    return texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").dropDuplicates(["doc_id"]), counts
