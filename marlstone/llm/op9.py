"""Query op9: fingerprints of documents, of their edited texts, and of the next documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import fingerprint as fp
from marlstone.llm.common import map_batches, stored, table
from marlstone.llm.kernels import text_bytes

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """Columns of RESULT for documents and those that follow them."""
    edited = [edited_text(a, b) for a, b in zip(texts, following, strict=True)]
    own, new, after = (fp.digests(*text_bytes(pa.array(x, pa.large_string()))) for x in (texts, edited, following))
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array(fp.hex_of(own), pa.string()), pa.array(fp.hex_of(new), pa.string()), pa.array(fp.likeness(own, new), pa.float64()), pa.array(fp.likeness(own, after), pa.float64()),
    ]


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row with the one after it; the partition's first and last texts go out for the seams."""
    part, held, seen = TaskContext.get().partitionId(), None, False
    names = [*(f.split()[0] for f in RESULT.split(", ")), "part", "edge", "edge_text"]

    def edge(kind: str, doc_id: int | None, text: str) -> pa.RecordBatch:
        nothing = [pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.string())] * 3, *[pa.nulls(1, pa.float64())] * 2]
        return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *nothing, pa.array([part], pa.int32()), pa.array([kind]), pa.array([text])], names)

    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        if not ids:
            continue
        if not seen:
            yield edge("first", ids[0], texts[0])
            seen = True
        if held:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = (ids[-1], texts[-1])
        if n := len(ids) - 1:
            yield pa.RecordBatch.from_arrays([*compared(ids[:-1], texts[:-1], texts[1:]), pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names)
    if held:
        yield edge("last", *held)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document, as RESULT says.

    Documents are dealt by ranges of descending doc_id (null after the others, equal ids by the text's hash), so
    that one pass over each sorted range sees every next document but the one behind its seam. The two rows
    at each seam, as few as there are partitions, are joined afterwards; the first range follows the last.
    A single document is its own next one.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ranges = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    done = stored(map_batches(ranges.select("doc_id", "text"), f"{RESULT}, part int, edge string, edge_text string", in_order))
    results = done.filter("edge is null").drop("part", "edge", "edge_text")
    parts = sorted(r[0] for r in done.filter("edge = 'first'").select("part").collect())  # as many as partitions at most
    if not parts:
        return results
    behind = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, behind int")
    firsts = done.filter("edge = 'first'").select(F.col("part").alias("behind"), F.col("edge_text").alias("following"))
    seams = done.filter("edge = 'last'").select("doc_id", "edge_text", "part").join(behind, "part").join(firsts, "behind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(compared(*(b.column(c).to_pylist() for c in ("doc_id", "edge_text", "following"))), [f.split()[0] for f in RESULT.split(", ")])

    return results.unionByName(map_batches(seams.select("doc_id", "edge_text", "following"), RESULT, compare))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
