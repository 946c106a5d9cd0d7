"""One ranking out of several: normalised scores, weights by intent, chunks of units.

Candidates are rows (modality, id, score). Modalities: content, metadata, terms, graph.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import fixed

MODALITIES = ("content", "metadata", "terms", "graph")
#: Labels of results, in the order in which ties are resolved.
LABELS = {"content": "vector", "metadata": "metadata", "terms": "bm25", "graph": "graph"}
OVER_FETCH = 3
#: Results up to which their ids are broadcast to the chunks.
SMALL = 10_000


@dataclass(frozen=True)
class SearchWeights:
    content: float = fixed.DEFAULT_WEIGHTS[0]
    metadata: float = fixed.DEFAULT_WEIGHTS[1]
    terms: float = fixed.DEFAULT_WEIGHTS[2]
    graph: float = fixed.DEFAULT_WEIGHTS[3]

    def __post_init__(self):
        if min(self.content, self.metadata, self.terms, self.graph) < 0 or self.total <= 0:
            raise ValueError("weights must not be negative, and some must be positive")

    @property
    def total(self) -> float:
        return self.content + self.metadata + self.terms + self.graph


def weights_for(intent: str) -> SearchWeights:
    return SearchWeights(*fixed.INTENT_WEIGHTS[intent])


def normalized_scores(candidates: DataFrame) -> DataFrame:
    """Scores of each modality scaled to 0..1; all 1 where they are equal. Bounds come from an aggregate of few rows."""
    bounds = candidates.groupBy("modality").agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    span = F.col("_high") - F.col("_low")
    joined = candidates.join(F.broadcast(bounds), "modality")  # a row per modality, of which there are four
    return joined.select("modality", "id", F.when(span > 0, (F.col("score") - F.col("_low")) / span).otherwise(F.lit(1.0)).alias("score"))


def spread_to_chunks(node_scores: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, score): a unit's score for each of its chunks, the best where units share one."""
    return node_scores.join(chunks.select(F.col("unit_id").alias("id"), "chunk_id"), "id").groupBy("chunk_id").agg(F.max("score").alias("score")).select(F.col("chunk_id").alias("id"), "score")


def fuse(normalized: DataFrame, weights: SearchWeights = SearchWeights()) -> DataFrame:
    """(id, score, source): weighted mean with 0 for what is absent, and the modality that adds most; one shuffle."""
    best = normalized.groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("modality") == m, F.col("score"))), F.lit(0.0)).alias(m) for m in MODALITIES])
    parts = {m: F.lit(getattr(weights, m)) * F.col(m) for m in MODALITIES}
    total = sum((parts[m] for m in MODALITIES[1:]), parts["content"]) / F.lit(weights.total)
    most = F.greatest(*[F.col(m) for m in MODALITIES])
    source = F.lit(LABELS["graph"])
    for m in reversed(MODALITIES[:-1]):
        source = F.when(F.col(m) >= most, LABELS[m]).otherwise(source)
    return best.select("id", total.alias("score"), source.alias("source"))


def over_fetched(candidates: DataFrame, k: int, times: int = OVER_FETCH) -> DataFrame:
    """The ``times * k`` best candidates of each modality but the graph, all of the graph's; ties by id."""
    best = Window.partitionBy("modality").orderBy(F.desc("score"), "id")
    # a window with a row limit keeps as many rows in each task before the shuffle
    ranked = candidates.filter("modality <> 'graph'").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= times * k).drop("_r")
    return ranked.unionByName(candidates.filter("modality = 'graph'"))


def search(candidates: DataFrame, chunks: DataFrame, k: int | None = 20, weights: SearchWeights = SearchWeights()) -> DataFrame:
    """The k best chunks, or all; graph candidates name units. Ids without a chunk drop out; of repeated chunk ids the smallest row counts.

    Only ids and units of chunks take part in the ranking; the other columns join the rows that are left.
    """
    normalized = normalized_scores(candidates)
    graph = spread_to_chunks(normalized.filter("modality = 'graph'").drop("modality"), chunks).withColumn("modality", F.lit("graph"))
    fused = fuse(normalized.filter("modality <> 'graph'").unionByName(graph), weights).withColumnRenamed("id", "chunk_id")
    known = fused.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    best = known if k is None else known.orderBy(F.desc("score"), "chunk_id").limit(k)
    rest = [c for c in chunks.columns if c != "chunk_id"]
    found = chunks.join(F.broadcast(best.select("chunk_id")) if k is not None and k <= SMALL else best.select("chunk_id"), "chunk_id", "left_semi")
    once = found.groupBy("chunk_id").agg(F.min(F.struct(*rest)).alias("_c")).select("chunk_id", "_c.*") if rest else found.distinct()
    out = best.join(once, "chunk_id")
    return out if k is None else out.orderBy(F.desc("score"), "chunk_id")


def shown(results: DataFrame) -> DataFrame:
    """Results as they are printed: rounded scores, the first 500 characters."""
    return results.withColumns({"score": F.round("score", 4), "content": F.substring("content", 1, 500)})
