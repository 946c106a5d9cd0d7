"""A folder of tables kept in step with a folder of files: sources, derivatives, chunks and term index, each step on its own or all in a row.

Each step reads what the one before it wrote and replaces its own table; readers see the old table or the new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as x
from marlstone.operators import fts, handles, materialize, sync
from marlstone.sources import files

SNAPSHOT = "sha256 string, media_type string, size_bytes long, paths array<string>"
CONTENTS = "handle string, media_type string, label string, content string"
DERIVATIVES = "handle string, kind string, media_type string, role string, index_state string, derivative_type string, label string, path string, sha256 string, metadata map<string,string>, content string, source_handle string"
CHUNKS = "chunk_id string, path string, source_handle string, materializer string, ordinal int, content string"
PATHS = "sha256 string, path string, status string"


class Library:
    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")

    def read(self, name: str, schema: str) -> DataFrame:
        return files.load_table(self.spark, f"{self.target}/{name}", schema)

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Write beside the old table, then put the new one in its place."""
        jvm = self.spark.sparkContext._jvm
        old, new = (jvm.org.apache.hadoop.fs.Path(f"{self.target}/{name}{end}") for end in ("", ".new"))
        fs = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        df.write.mode("overwrite").parquet(f"{self.target}/{name}.new")
        fs.delete(old, True)
        fs.rename(new, old)
        return self.spark.read.schema(df.schema).parquet(f"{self.target}/{name}")

    def sources(self, root: str, run_id: str = "run") -> dict[str, int]:
        """Take a snapshot of root: how many contents are added, modified, deleted, unchanged. Gone paths stay as missing ones."""
        found = files.corpus(self.spark, root).withColumn("content", files.text_content("content")).select("path", "content")
        old, new = self.read("snapshot", SNAPSHOT), sync.snapshot(found)
        changes = sync.difference(old, new)
        counted = changes.withColumn("run_id", F.lit(run_id))
        kept = self.replace("changes", counted)
        seen = new.select("sha256", F.explode("paths").alias("path"))
        known = self.read("paths", PATHS).select("sha256", "path").unionByName(seen).distinct()
        self.replace("paths", sync.path_status(known, seen).select("sha256", "path", "status"))
        one = found.groupBy(F.sha2("content", 256).alias("sha256")).agg(F.max_by("content", "path").alias("content"), F.max("path").alias("label"))
        self.replace("contents", one.select(F.concat(F.lit("hf_"), "sha256").alias("handle"), x.media_type("label").alias("media_type"), "label", "content"))
        self.replace("files", handles.file_refs(found))
        self.replace("snapshot", new)
        return {k: int(v or 0) for k, v in sync.change_counts(kept).first().asDict().items()}

    def extract(self) -> dict[str, int]:
        """Markdown of sources that have none yet; what was made of sources that are gone goes."""
        contents, old = self.read("contents", CONTENTS), self.read("derivatives", DERIVATIVES)
        current = sync.current(old, contents.select(F.col("handle").alias("source_handle")), "source_handle")
        todo = contents.join(old.select(F.col("source_handle").alias("handle")), "handle", "left_anti")
        made = handles.put(materialize.extracted(todo)).withColumn("source_handle", F.col("metadata")["derived_from"])
        counts = {"deleted": old.count() - current.count(), "todo": todo.count()}
        kept = current.count()
        every = self.replace("derivatives", current.select(*made.columns).unionByName(made))
        added = every.count() - kept
        return {"added": added, "skipped": counts["todo"] - added, "deleted": counts["deleted"]}

    def materialize(self, materializer: str = "paragraph_chunks", most: int = 2000) -> dict[str, int]:
        """Chunks of all derivatives, and their term index."""
        chunks = self.replace("chunks", materialize.chunks(self.read("derivatives", DERIVATIVES), materializer, most))
        fts.write_index(fts.build_index(chunks), f"{self.target}/index")
        n = chunks.count()
        return {"chunks": n, "indexed": self.spark.read.parquet(f"{self.target}/index/documents").count()}

    def update(self, root: str, run_id: str = "run", most: int = 2000) -> dict[str, dict[str, int]]:
        """All steps; the later ones only where the sources changed or nothing was made yet."""
        done = {"sources": self.sources(root, run_id)}
        changed = any(done["sources"][k] for k in ("added", "modified", "deleted"))
        if changed or self.read("chunks", CHUNKS).isEmpty():
            done |= {"extract": self.extract(), "materialize": self.materialize(most=most)}
        return done

    def summary(self) -> DataFrame:
        columns = ["kind", "media_type", "derivative_type", "index_state"]
        derived = self.read("derivatives", DERIVATIVES)
        refs = self.spark.read.parquet(f"{self.target}/files")
        return sync.summary(refs.select(columns).unionByName(derived.select(columns)), derived.select(F.lit("derived_from").alias("edge_type")), self.read("paths", PATHS), self.read("chunks", CHUNKS))

    def cleanup(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.target)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
