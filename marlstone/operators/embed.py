"""Vectors of texts by feature hashing, for where no embedding server is at hand; and vectors of a graph's labels and verbs.

A term adds one to the place that its hash names, with a sign that another bit of it names; vectors are scaled
to length one. Equal texts have equal vectors, on any machine. An embedder of one's own is any function from
texts to lists of floats, see ``with_embedder``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import terms

#: Texts that go to an embedder at once, at most.
BATCH = 2048


def place_of(term: Column, dim: int) -> Column:
    """The place of a term in a vector, from eight hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % dim


def sign_of(term: Column) -> Column:
    return F.when(F.substring(F.md5(term), 9, 1) < "8", F.lit(1.0)).otherwise(F.lit(-1.0))


def weights(texts: DataFrame, key: str, text: str = "text", dim: int = 256) -> DataFrame:
    """(key, place, value): the places of each text's vector that aren't zero. Sums are combined before the shuffle."""
    found = texts.select(F.col(key), F.explode(terms(text)).alias("term"))
    sums = found.groupBy(key, place_of(F.col("term"), dim).alias("place")).agg(F.sum(sign_of(F.col("term"))).alias("value")).filter("value <> 0")
    lengths = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_length"))
    return sums.join(lengths, key).select(key, "place", (F.col("value") / F.col("_length")).alias("value"))


def embedded(texts: DataFrame, text: str = "text", dim: int = 256) -> DataFrame:
    """texts with embedding, array<float> of dim places; all zero for texts without terms. No shuffle."""
    places = F.transform(terms(F.coalesce(F.col(text), F.lit(""))), lambda t: F.struct(place_of(t, dim).alias("place"), sign_of(t).alias("sign")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.aggregate(F.filter(F.col("_p"), lambda p: p["place"] == k), F.lit(0.0), lambda s, p: s + p["sign"]))
    length = F.sqrt(F.aggregate("_s", F.lit(0.0), lambda s, v: s + v * v))
    return texts.withColumn("_p", places).withColumn("_s", sums).withColumn("embedding", F.transform("_s", lambda v: (v / F.greatest(length, F.lit(1e-10))).cast("float"))).drop("_p", "_s")


def with_embedder(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dim: int, text: str = "text", batch: int = BATCH) -> DataFrame:
    """texts with embedding by a function of one's own, called with at most ``batch`` texts that aren't blank; blank ones get zeros.

    A vector of another length than dim raises.
    """
    if not 1 <= batch <= BATCH:
        raise ValueError(f"batch must be 1 to {BATCH}")
    kept = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, len(b), batch):
                part = b.slice(first, batch)
                said = part.column(text).to_pylist()
                some = [k for k, t in enumerate(said) if t and t.strip()]
                made = embedder([said[k] for k in some]) if some else []
                if any(len(v) != dim for v in made) or len(made) != len(some):
                    raise ValueError(f"the embedder must give {len(some)} vectors of {dim} numbers")
                out = np.zeros((len(part), dim), np.float32)
                for k, v in zip(some, made, strict=True):
                    out[k] = v
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(out.tolist(), pa.list_(pa.float32()))], [*kept, "embedding"])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def node_vectors(nodes: DataFrame, dim: int = 256) -> DataFrame:
    """(id, kind 'node', embedding) of the labels of nodes (id, label)."""
    return embedded(nodes.select("id", F.lit("node").alias("kind"), "label"), "label", dim).drop("label")


def verb_vectors(triples: DataFrame, dim: int = 256) -> DataFrame:
    """(id, kind 'verb', pos, embedding) of the distinct verbs of triples, each at the place of its first edge."""
    verbs = triples.groupBy(F.col("verb").alias("id")).agg(F.min("pos").alias("pos"))
    return embedded(verbs.select("id", F.lit("verb").alias("kind"), "pos", F.regexp_replace("id", "_", " ").alias("_verb")), "_verb", dim).drop("_verb")


def packed(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Vectors as half precision, two bytes a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            halves = [None if v is None else np.array(v, np.float16).tobytes() for v in b.column(embedding).to_pylist()]
            yield b.set_column(b.schema.get_field_index(embedding), embedding, pa.array(halves, pa.binary()))

    return vectors.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == embedding else f for f in vectors.schema.fields]))


def unpacked(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Vectors that ``packed`` made, as array<float>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [None if v is None else np.frombuffer(v, np.float16).astype(np.float32).tolist() for v in b.column(embedding).to_pylist()]
            yield b.set_column(b.schema.get_field_index(embedding), embedding, pa.array(whole, pa.list_(pa.float32())))

    return vectors.mapInArrow(run, T.StructType([T.StructField(f.name, T.ArrayType(T.FloatType())) if f.name == embedding else f for f in vectors.schema.fields]))
