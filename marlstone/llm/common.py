"""Plumbing that the operators of this subpackage share.

Rules that hold for all of them:

* An operator keeps every input row, also repeated ones and rows whose key is null.
* A null text counts as an empty one.
* A column of the input that has the name of an output column gives way to it.
* Results don't depend on how the rows are spread over partitions.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROOT = str(Path(__file__).resolve().parent.parent.parent)
#: Bytes of text that go to Python in one Arrow batch at most; one longer row makes a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as rows of text differ in length by orders of magnitude.

    Also lets Python workers on this machine import the library wherever the session was started; on a
    cluster the library is shipped with --py-files.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, ROOT]))
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What empties the caches that operators keep in a Python worker, and the operator that used the worker last.
_emptied: list[Callable[[], None]] = []
_last = [""]


def kept_in_worker(empty: Callable[[], None]) -> None:
    _emptied.append(empty)


def entered(operator: str) -> None:
    """A worker that serves one operator after another keeps the caches of the current one only."""
    if _last[0] != operator:
        for empty in _emptied:
            empty()
        _last[0] = operator


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def given_back() -> None:
    """Return free memory to the system: a worker waits for its next task, or idle for a minute, and the allocators would keep what its kernels once took."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names, in any letter case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def add_columns(df: DataFrame, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list], texts: tuple[str, ...] = ()) -> DataFrame:
    """Append Arrow-computed columns to every row.

    ``compute`` gets a batch of all columns and returns one array for each of ``fields``. texts: cut batches by
    the bytes of these columns first.
    """
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in {f.name.lower() for f in fields}]
    schema = T.StructType([*[f for f in df.schema.fields if f.name in kept], *fields])
    out = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered(compute.__module__)
        batch = made = None
        for batch in parts(batches, *texts) if texts else batches:
            made = compute(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[a if isinstance(a, pa.Array) else pa.array(a, out.field(f.name).type) for a, f in zip(made, fields, strict=True)]], names=[*kept, *[f.name for f in fields]])
        del batch, made
        given_back()

    return df.mapInArrow(run, schema)


def parts(batches: Iterator[pa.RecordBatch], *texts: str, size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Batches cut into such of about size bytes of text, or one longer row, for kernels that need many times that."""
    for batch in batches:
        length = np.zeros(len(batch), np.int64)
        for c in texts:
            length += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(length)
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - length[first] + size, "right")))
            yield batch.slice(first, last - first)
            first = last


def map_batches(df: DataFrame, schema: str | T.StructType, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    bounded_batches(df.sparkSession)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered(run.__module__)
        yield from run(batches)
        given_back()

    return df.mapInArrow(enter, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; in local runs one below the warehouse."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
    return at


def _hadoop_path(spark: SparkSession, at: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


@contextmanager
def configured(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session with other settings for a while; keys with __ for dots."""
    old = {k: spark.conf.get(k, None) for k in (k.replace("__", ".") for k in values)}
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage is cut, lost executors lose nothing.

    Columnar and compressed, so smaller on disk than ``checkpoint()``. Shuffle files go once the table is
    written. What ``dropped`` doesn't delete goes with the application.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/stages-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        files, path = _hadoop_path(spark, root)
        files.mkdirs(path)
        files.deleteOnExit(path)
    path = f"{root}/{uuid.uuid4().hex}"
    with configured(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


_roots: set[str] = set()


def dropped(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` wrote; for those that nothing lazy reads any more."""
    for df in frames:
        files, path = _hadoop_path(df.sparkSession, df.stored_at)
        files.delete(path, True)


#: Bits of the bitmaps that filter rows before they are shuffled: 16 MB, whatever the size of the corpus.
BITMAP_BITS = 1 << 27


def bitmap(hashes: DataFrame, bits: int = BITMAP_BITS) -> Broadcast:
    """A broadcast bitmap with the bit of each hash set; hashes: one long column.

    Its size is a parameter, so a corpus that outgrows it lets more rows pass the filter, and none is lost.
    """
    # bits of the parts count from 1
    place = F.pmod(F.col(hashes.columns[0]), F.lit(bits)) + 1
    # dealt by part first, as a partial bitmap of each task would be larger than its hashes
    dealt = hashes.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).repartition("part")
    parts = dealt.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
    found = np.zeros(max(bits // 8, 4096), np.uint8)
    # at most bits / 32768 rows of 4 KB
    for r in parts.collect():
        at = (r.part - 1) * 4096
        found[at : at + len(r.map)] = np.frombuffer(bytes(r.map), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(found[: bits // 8].tobytes())


def passes(shared: Broadcast, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (64 bits) have their bit set."""
    found = np.frombuffer(shared.value, np.uint8)
    place = hashes.view(np.uint64) % np.uint64(8 * len(found))
    return found[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1
