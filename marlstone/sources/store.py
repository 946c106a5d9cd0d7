"""An index as Parquet tables below one folder: chunks, vectors, nodes, triples, scopes and file state.

Chunks and vectors are partitioned by ``partition_key``. A table is replaced by writing a new generation beside
the old one and then moving a pointer, so readers see the old rows or the new ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.units import METADATA
from marlstone.sources.files import empty

SCHEMAS = {
    "chunks": f"chunk_id string, path string, start_line int, end_line int, content string, chunk_type string, language string, unit_id string, metadata {METADATA}, partition_key string",
    "vectors": "id string, kind string, embedding array<float>, partition_key string",
    "nodes": "id string, kind string, label string, path string, line int, metadata map<string,string>",
    "triples": "subject string, verb string, object string, source string, bidirectional boolean",
    "scopes": "index_path string, covers string, delegates array<string>, has_vectors boolean",
    "state": "path string, hash string",
}
PARTITIONED = ("chunks", "vectors")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; in local runs one below the warehouse."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"


def removed_at_exit(spark: SparkSession, at: str) -> None:
    """Have a folder deleted when the application ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self, table: str) -> str | None:
        path, fs = self._path(table)
        if not fs.exists(path):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("current="))
        return names[-1].split("=", 1)[1].split("-", 1)[1] if names else None

    def read(self, table: str) -> DataFrame:
        at = self._current(table)
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}/{at}") if at else empty(self.spark, SCHEMAS[table])

    def write(self, table: str, df: DataFrame) -> None:
        columns = [f.split()[0] for f in self.spark.createDataFrame([], SCHEMAS[table]).columns]
        name = f"g{uuid.uuid4().hex}"
        writer = df.select(*columns).write
        (writer.partitionBy("partition_key") if table in PARTITIONED else writer).parquet(f"{self.root}/{table}/{name}")
        path, fs = self._path(table)
        old = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("current=")]
        number = 1 + max([int(p.getName().split("=")[1].split("-")[0]) for p in old], default=0)
        marker, _ = self._path(table, f"current={number:09d}-{name}")
        fs.create(marker).close()
        for p in old:
            fs.delete(p, True)

    def vectors(self, kind: str) -> DataFrame:
        """Vectors of one kind: content, metadata, node or verb."""
        return self.read("vectors").filter(F.col("kind") == kind)

    def scope(self, index_path: str) -> DataFrame:
        return self.read("scopes").filter(F.col("index_path") == index_path)

    def save_scope(self, index_path: str, covers: str = "", delegates: list[str] = (), has_vectors: bool = False) -> None:
        """Put one scope in the place of that of its path."""
        new = self.spark.createDataFrame([(index_path, covers, list(delegates), has_vectors)], SCHEMAS["scopes"])
        self.write("scopes", self.read("scopes").filter(F.col("index_path") != index_path).unionByName(new))

    def partitions(self, table: str) -> DataFrame:
        return self.read(table).select("partition_key").distinct().orderBy("partition_key")

    def vacuum(self) -> None:
        """Delete generations that no pointer names."""
        for table in SCHEMAS:
            path, fs = self._path(table)
            if fs.exists(path):
                current = self._current(table)
                for s in fs.listStatus(path):
                    if s.getPath().getName().startswith("g") and s.getPath().getName() != current:
                        fs.delete(s.getPath(), True)

    def cleanup(self) -> None:
        path, fs = self._path()
        fs.delete(path, True)
