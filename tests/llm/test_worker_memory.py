import random
import re
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from test_chunk_dedup import prose

from marlstone.llm import chunk_dedup as cd
from marlstone.llm.common import add_columns, map_batches

HELD = Path("/proc/self/smaps_rollup")


def held():
    return sum(int(x) for x in re.findall(r"\nPss_Anon:\s+(\d+)", HELD.read_text())) >> 10


def strewn():
    """Takes 100 MB in small pieces and keeps the last, below which the allocator alone returns nothing."""
    return [np.ones(8000) for _ in range(1600)][-1]


@pytest.mark.skipif(not HELD.exists(), reason="the kernel doesn't tell")
@pytest.mark.parametrize("way", ["map", "add"])
def test_a_worker_keeps_no_free_memory_between_tasks(spark, way):
    kept = []

    def compute(batch):
        kept.append(strewn())
        return [pa.array([held()] * len(batch))]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(compute(batch), ["taken"])

    # the function that Spark would run, in this process
    schema = T.StructType([T.StructField("id", T.LongType())])
    frame = SimpleNamespace(sparkSession=spark, columns=["id"], schema=schema, mapInArrow=lambda f, schema: f)
    task = map_batches(frame, "taken long", run) if way == "map" else add_columns(frame, [T.StructField("taken", T.LongType())], compute)
    before = held()
    taken = [b.column("taken")[0].as_py() for b in task(iter([pa.RecordBatch.from_arrays([pa.array([1])], ["id"])]))][0]
    assert taken - before > 80 and held() - before < 40


def test_chunks_are_no_table_and_are_released(spark, monkeypatch):
    plain, schemas = cd.stored, []
    monkeypatch.setattr(cd, "stored", lambda df: (schemas.append(df.columns), plain(df))[1])
    persistent = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, text = persistent(), prose(random.Random(21), 3000)
    got = {r.doc_id: r.deduplicated for r in cd.remove_repeats(spark.createDataFrame([(1, text), (2, text), (3, "other words")], "doc_id long, text string")).collect()}
    assert got == {1: text, 2: "", 3: "other words"}
    assert all("digest" not in s for s in schemas) and persistent() == before
