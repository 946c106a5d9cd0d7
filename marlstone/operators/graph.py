"""Graph operators on triples (subject, verb, object, source, bidirectional, pos)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import fixed

MAX_DEPTH = 20


def adjacency(triples: DataFrame) -> DataFrame:
    """(node, verb, next, source, pos, back): every edge, and bidirectional ones the other way round too."""
    there = triples.select(F.col("subject").alias("node"), "verb", F.col("object").alias("next"), "source", "pos", F.lit(0).alias("back"))
    back = triples.filter("bidirectional").select(F.col("object").alias("node"), "verb", F.col("subject").alias("next"), "source", "pos", F.lit(1).alias("back"))
    return there.unionByName(back)


def _cut(df: DataFrame) -> DataFrame:
    """df stored where driver and executors can read it, so that a level's lineage ends there; it goes with the application."""
    from marlstone.sources.store import removed_at_exit, shared_folder

    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def traverse(edges: DataFrame, start: str, depth: int = 3, verbs: list[str] | None = None, sources: list[str] | None = None, most: int = MAX_DEPTH) -> DataFrame:
    """(node, verb, depth, score, path): nodes within reach, each by the path that is found first, level by level.

    edges as ``adjacency`` makes them. Of the ways into a node at its level, that from the earliest found
    node and the earliest edge counts. The start isn't among them. Depths over ``most`` raise.
    """
    if not 0 <= depth <= most:
        raise ValueError(f"depth must be 0 to {most}")
    spark = edges.sparkSession
    for column, wanted in (("verb", verbs), ("source", sources)):
        if wanted is not None:
            edges = edges.filter(F.col(column).isin(*wanted))
    schema = "node string, verb string, depth int, path array<string>, found array<long>"
    seen = spark.createDataFrame([(start, None, -1, [start], [])], schema)
    frontier = seen
    for level in range(depth):
        # found: positions of the edges along the path, which orders nodes as they are found
        steps = frontier.select(F.col("node").alias("_n"), "path", "found").join(edges, F.col("_n") == edges["node"]).select(F.col("next").alias("node"), "verb", F.lit(level).alias("depth"), F.concat("path", F.array("next")).alias("path"), F.concat("found", F.array(F.col("pos") * 2 + F.col("back"))).alias("found"))
        # a partial aggregate, so a node with very many edges into it is no large group
        new = steps.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min(F.struct("found", "verb", "depth", "path")).alias("f")).select("node", "f.verb", "f.depth", "f.path", "f.found")
        frontier = _cut(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth >= 0").select("node", "verb", "depth", (F.lit(1.0) / (F.col("depth") + 1)).alias("score"), "path")


def scope_leaves(scopes: DataFrame, root: str) -> DataFrame:
    """(index_path): indexes below root in the delegation tree that are leaves or hold vectors of their own.

    scopes: (index_path, delegates array<string>, has_vectors).
    """
    level, seen = scopes.filter(F.col("index_path") == root), None
    while not level.isEmpty():
        seen = level if seen is None else seen.unionByName(level)
        below = level.select(F.explode("delegates").alias("index_path")).distinct().join(seen.select("index_path"), "index_path", "left_anti")
        level = _cut(scopes.join(below, "index_path"))
    if seen is None:
        return scopes.select("index_path").limit(0)
    return seen.filter((F.size("delegates") == 0) | F.col("has_vectors")).select("index_path").distinct()


def nearest_index(paths: DataFrame, indexes: DataFrame, levels: int | None = fixed.MAX_LEVELS) -> DataFrame:
    """(path, index_path): the deepest folder at or above each path that has an index, up to ``levels`` levels, or all."""
    parts = F.split("path", "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.greatest(F.lit(0), F.size(parts) - levels) if levels else F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("index_path"))
    return above.join(indexes.select("index_path"), "index_path").groupBy("path").agg(F.max_by("index_path", F.length("index_path")).alias("index_path"))


def known_edges(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples both of whose ends are nodes."""
    ids = nodes.select(F.col("id")).distinct()
    return triples.join(ids.withColumnRenamed("id", "subject"), "subject", "left_semi").join(ids.withColumnRenamed("id", "object"), "object", "left_semi")


def _safe(name: str):
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


def _label(name: str):
    plain = F.translate(name, "\"[]{}", "'()()")
    short = F.when(F.length(plain) > fixed.MAX_LABEL, F.concat(F.substring(plain, 1, fixed.MAX_LABEL - 3), F.lit("..."))).otherwise(plain)
    return F.concat(F.lit('"'), short, F.lit('"'))


def mermaid_lines(nodes: DataFrame, triples: DataFrame, prefix: str | None = None, most_nodes: int | None = fixed.MAX_NODES, most_edges: int | None = fixed.MAX_EDGES) -> DataFrame:
    """(part, pos, line) of a flowchart: nodes (id, kind, label, path, pos), then edges by pos.

    prefix keeps nodes whose path starts so, and triples that touch them. The first nodes and triples, as many
    as asked for (500 and 2000; None: all); edges to other nodes are left out.
    """
    if prefix and prefix != ".":
        nodes = nodes.filter(F.col("path").startswith(prefix))
        ids = nodes.select("id").distinct()
        touched = triples.join(ids, triples["subject"] == ids["id"], "left_semi").unionByName(triples.join(ids, triples["object"] == ids["id"], "left_semi")).distinct()
        triples = touched
    nodes = nodes if most_nodes is None else nodes.orderBy("pos").limit(most_nodes)
    edges = known_edges(triples if most_edges is None else triples.orderBy("pos").limit(most_edges), nodes)
    opening, closing = F.lit("("), F.lit(")")
    for kind, (a, b) in fixed.SHAPES.items():
        opening, closing = F.when(F.col("kind") == kind, a).otherwise(opening), F.when(F.col("kind") == kind, b).otherwise(closing)
    drawn = nodes.select(F.lit(0).alias("part"), "pos", F.concat(F.lit("    "), _safe("id"), opening, _label("label"), closing).alias("line"))
    arrow = F.when(F.col("bidirectional"), " <-->|").otherwise(" -->|")
    return drawn.unionByName(edges.select(F.lit(1).alias("part"), "pos", F.concat(F.lit("    "), _safe("subject"), arrow, _label("verb"), F.lit("| "), _safe("object")).alias("line")))


def mermaid(nodes: DataFrame, triples: DataFrame, prefix: str | None = None) -> str:
    """The flowchart as text; its size is bounded."""
    lines = [r.line for r in mermaid_lines(nodes, triples, prefix).orderBy("part", "pos").collect()]
    return "\n".join(["graph LR", *lines]) if lines else "graph LR\n    empty[No graph data]"
