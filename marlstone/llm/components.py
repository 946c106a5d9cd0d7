"""Connected components by union-find inside tasks and contraction between them.

Each round runs union-find over whatever edges a task holds, which leaves an edge to the smallest node
of each local tree; then every node hooks on to its smallest neighbour, chains are halved, and edges
between what has been joined vanish. Nodes that are no local minimum go away in each round, so the
number of rounds is logarithmic, and two to four on stars and dense groups. Nothing is collected;
each round is stored in the shared folder, so that a lost executor repeats one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import dropped, map_batches, stored


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of one task to (node, smallest node of its tree)."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if schema is not None and parent:
        nodes = [x for x in parent if root(x) != x]
        for k in range(0, len(nodes), 50_000):
            part = nodes[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, schema.field("a").type), pa.array([root(x) for x in part], schema.field("b").type)], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any order and repetition, without nulls: stored (node, root) of every node that isn't the smallest of its component."""
    edges = edges.select("a", "b").filter("a <> b")
    labels, read = None, []
    while True:
        edges = stored(map_batches(edges, edges.schema, union_find).distinct())
        dropped(*read)
        read = [edges]
        if edges.isEmpty():
            if labels is None:
                labels = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("root")))
            dropped(edges)
            return labels
        low = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b")).filter("b < a")
        again = low.select(F.col("a").alias("b"), F.col("b").alias("c"))
        hooks = stored(low.join(again, "b", "left").select(F.col("a").alias("node"), F.coalesce("c", "b").alias("root")))
        if labels is None:
            labels = hooks
        else:
            known = labels.join(hooks.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            longer = stored(known.unionByName(hooks.join(labels.select("node"), "node", "left_anti")))
            dropped(labels)
            labels = longer
            read.append(hooks)
        to_a, to_b = hooks.select(F.col("node").alias("a"), F.col("root").alias("x")), hooks.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = edges.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).filter("a <> b").distinct()
