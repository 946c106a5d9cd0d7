"""Derivatives to tables that can be queried: chunks with their term index, and a registry for each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import fixed
from marlstone.functions.text import sorted_json
from marlstone.operators import chunking
from marlstone.operators.fts import Index, build_index

CHUNKERS = {"full_text_chunk": chunking.full_text_chunks, "section_chunks": chunking.section_chunks, "paragraph_chunks": chunking.paragraph_chunks, "sentence_chunks": chunking.sentence_chunks}
#: Registries: prefix of ids, and what is taken from the metadata besides.
REGISTRIES = {"table_store": ("table_", ("caption",)), "figure_index": ("figure_", ("src", "caption")), "image_registry": ("image_", ("src",)), "reference_graph": ("reference_", ()), "code_graph": ("symbol_", ("symbol_name", "symbol_kind")), "style_rule_index": ("style_", ("selector",))}
CHUNK_COLUMNS = ("chunk_id", "path", "source_handle", "materializer", "ordinal", "content")


def configured(override: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Materializers by derivative type; unknown names raise."""
    config = {k: [v] for k, v in fixed.MATERIALIZERS.items()} if override is None else override
    for names in config.values():
        for name in names:
            if name not in CHUNKERS and name not in REGISTRIES and name != "strided_chunks":
                raise ValueError(f"unknown materializer {name}")
    return config


def chunks(derivatives: DataFrame, materializer: str = "paragraph_chunks", most: int | None = 2000) -> DataFrame:
    """CHUNK_COLUMNS of Markdown and plain text derivatives (handle, media_type, label, content)."""
    if materializer == "strided_chunks":
        raise NotImplementedError("strided chunks of tokens aren't materialised")
    texts = derivatives.filter(F.col("media_type").isin("text/markdown", "text/plain")).select(F.col("handle").alias("source_handle"), F.col("label").alias("path"), F.col("content").alias("_text"))
    limited = materializer in ("paragraph_chunks", "sentence_chunks") and most is not None
    found = CHUNKERS[materializer](texts, "_text", **({"most": most} if limited else {}))
    return found.select(F.concat(F.lit("chunk_"), "source_handle", F.lit(f"_{materializer}_"), F.col("ordinal").cast("string")).alias("chunk_id"), "path", "source_handle", F.lit(materializer).alias("materializer"), "ordinal", "content")


def registry(derivatives: DataFrame, name: str) -> DataFrame:
    """(id, source_handle, …, payload): one row per derivative."""
    prefix, fields = REGISTRIES[name]
    payload = sorted_json(handle=F.col("handle"), content=F.col("content"), metadata=F.col("metadata"), media_type=F.col("media_type"))
    return derivatives.select(F.concat(F.lit(prefix), "handle").alias("id"), F.col("handle").alias("source_handle"), *[F.coalesce(F.col("metadata")[f], F.col("label") if f == "symbol_name" else F.lit("symbol" if f == "symbol_kind" else "")).alias(f) for f in fields], payload.alias("payload"))


def dispatch(derivatives: DataFrame, override: dict[str, list[str]] | None = None, most: int = 2000) -> dict[str, DataFrame]:
    """A table for each materializer that some derivative type asks for."""
    out: dict[str, DataFrame] = {}
    for kind, names in configured(override).items():
        own = derivatives.filter(F.col("derivative_type") == kind)
        for name in names:
            made = registry(own, name) if name in REGISTRIES else chunks(own, name, most)
            out[name] = out[name].unionByName(made) if name in out else made
    return out


def counts(derivatives: DataFrame, override: dict[str, list[str]] | None = None) -> DataFrame:
    """(derivative_type, n, skipped): what the dispatch takes and leaves."""
    config = configured(override)
    return derivatives.groupBy("derivative_type").agg(F.count("*").alias("n")).withColumn("skipped", ~F.coalesce(F.col("derivative_type").isin(*config), F.lit(False)))


def synced_index(chunk_rows: DataFrame, active: DataFrame) -> Index:
    """The term index of chunks whose source is still active."""
    return build_index(chunk_rows.join(active.select(F.col("handle").alias("source_handle")), "source_handle", "left_semi"))


def extracted(files: DataFrame) -> DataFrame:
    """Markdown derivatives of files (handle, media_type, label, content): text as it is, HTML converted; others give none."""
    from marlstone.operators.extract import html

    columns = ["handle", "media_type", "label", "content"]
    plain = files.select(*columns).filter(F.col("media_type").isin("text/markdown", "text/plain"))
    pages = html.markdown(files.select(*columns).filter(F.col("media_type").isin("text/html", "application/xhtml+xml")), "content").withColumnRenamed("markdown", "content")
    every = plain.unionByName(pages)
    meta = F.create_map(F.lit("derived_from"), F.col("handle"), F.lit("source_media_type"), F.col("media_type"))
    return every.select(meta.alias("metadata"), "content", F.lit("text/markdown").alias("media_type"), F.lit("extracted_markdown").alias("derivative_type"), F.concat("label", F.lit(" extracted markdown")).alias("label"))
