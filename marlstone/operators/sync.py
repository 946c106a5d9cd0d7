"""Keeping tables current: snapshots by content hash, their differences, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as x


def snapshot(files: DataFrame) -> DataFrame:
    """(sha256, media_type, size_bytes, paths): files (path, content) by content, paths in order."""
    rows = files.select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"), "path")
    found = rows.groupBy("sha256").agg(F.max("size_bytes").alias("size_bytes"), F.sort_array(F.collect_list("path")).alias("paths"))
    return found.select("sha256", x.media_type(F.element_at("paths", 1)).alias("media_type"), "size_bytes", "paths")


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(sha256, change) of all hashes: added, deleted, modified (other paths) or unchanged; one full join."""
    o, n = old.select("sha256", F.sort_array("paths").alias("o")), new.select("sha256", F.sort_array("paths").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified").otherwise("unchanged")
    return o.join(n, "sha256", "full").select("sha256", change.alias("change"))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted", "unchanged")])


def changed_files(current: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, hash) that are new or have another hash than the stored state, and stored paths that are gone."""
    s = state.select("path", F.col("hash").alias("old"))
    change = F.when(F.col("hash").isNull(), "deleted").when(F.col("old").isNull(), "added").otherwise("changed")
    return current.select("path", "hash").join(s, "path", "full").filter("not hash <=> old").select("path", change.alias("change"))


def merge_partition(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Chunks after an update: those of untouched paths stay, those of changed and deleted ones are replaced."""
    return old.join(touched.select("path"), "path", "left_anti").unionByName(new)


def stale(rows: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't active any more."""
    return rows.join(active.select(key), key, "left_anti")


def current(rows: DataFrame, active: DataFrame, key: str) -> DataFrame:
    return rows.join(active.select(key), key, "left_semi")


def path_status(paths: DataFrame, seen: DataFrame) -> DataFrame:
    """paths (sha256, path) with status active or missing, by hash and path."""
    marked = paths.join(seen.select("sha256", "path").distinct().withColumn("_s", F.lit(True)), ["sha256", "path"], "left")
    return marked.withColumn("status", F.when(F.col("_s"), "active").otherwise("missing")).drop("_s")


def audit(changes: DataFrame, run_id: str) -> DataFrame:
    return changes.filter("change <> 'unchanged'").select(F.lit(run_id).alias("run_id"), "sha256", "change")


SUMMARY = ("kind", "media_type", "derivative_type", "index_state")


def summary(handles: DataFrame, edges: DataFrame, paths: DataFrame, chunks: DataFrame) -> DataFrame:
    """(what, value, n): totals, handles by axis, edges by type and paths by status; each table is read once."""
    axes = F.array(F.struct(F.lit("handles").alias("what"), F.lit("all").alias("value")), *[F.struct(F.lit(f"by_{a}").alias("what"), F.coalesce(F.col(a), F.lit("<none>")).alias("value")) for a in SUMMARY])
    of_handles = handles.select(F.explode(axes).alias("a")).groupBy("a.what", "a.value").agg(F.count("*").alias("n"))
    of_edges = edges.groupBy(F.lit("edges").alias("what"), F.col("edge_type").alias("value")).agg(F.count("*").alias("n"))
    of_paths = paths.groupBy(F.lit("paths").alias("what"), F.col("status").alias("value")).agg(F.count("*").alias("n"))
    of_chunks = chunks.agg(F.count("*").alias("n")).select(F.lit("chunks").alias("what"), F.lit("all").alias("value"), "n")
    return of_handles.unionByName(of_edges).unionByName(of_paths).unionByName(of_chunks)


def cascade(handles: DataFrame, edges: DataFrame, paths: DataFrame, seen: DataFrame) -> DataFrame:
    """(what, key) of all that goes with sources not seen any more: their handles, edges into or out of them, their paths.

    handles (handle, kind), edges (child, parent), paths (handle, path), seen (handle).
    """
    gone = handles.filter("kind = 'file_ref'").select("handle").join(seen.select("handle"), "handle", "left_anti")
    touching = edges.join(gone.select(F.col("handle").alias("parent")), "parent", "left_semi").unionByName(edges.join(gone.select(F.col("handle").alias("child")), "child", "left_semi").select(edges.columns)).select("child", "parent").distinct()
    key = lambda df, what, of: df.select(F.lit(what).alias("what"), of.alias("key"))
    return key(gone, "handle", F.col("handle")).unionByName(key(touching, "edge", F.concat("child", F.lit(">"), "parent"))).unionByName(key(paths.join(gone, "handle", "left_semi"), "path", F.col("path")))


def totals(chunks: DataFrame) -> DataFrame:
    """(partitions, files, chunks) of chunks (partition_key, path)."""
    return chunks.agg(F.countDistinct("partition_key").alias("partitions"), F.countDistinct("path").alias("files"), F.count("*").alias("chunks"))


def harvested(records: DataFrame, key: str, updated: str) -> DataFrame:
    """Records of a harvest, the newest of each key, newest first."""
    from marlstone.operators.handles import latest

    return latest(records, [key], updated).orderBy(F.desc(updated), key)
