"""Chunks of text: whole texts, sections, packed paragraphs and sentences, lines in strides.

Each function adds rows: one per chunk, with the columns of the input, ``ordinal``, ``chunk_type``, ``content``
and what locates the chunk in its text. Null and blank texts have no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marlstone.functions.text import normalized, terms

PARAGRAPH_END, SENTENCE_END = re.compile(r"\n[ \t\n\x0b\f\r]*\n"), re.compile(r"(?<=[.!?])\s+")
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
#: Bytes of an Arrow batch, about, to and from Python; one longer row makes a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as rows of text differ in length by orders of magnitude."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _row_bytes(columns: list[pa.Array], n: int) -> list[int]:
    """Bytes of each row, about: of texts their own, of other columns their mean."""
    total = np.zeros(n, np.int64)
    for c in columns:
        texts = pa.types.is_string(c.type) or pa.types.is_binary(c.type)
        total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) if texts else c.nbytes // max(n, 1)
    return total.tolist()


def per_text(df: DataFrame, text: str, schema: str, rows: Callable[[str], Iterator[tuple]], keep_text: bool = True) -> DataFrame:
    """The columns of df with those of schema, for each row that ``rows`` makes of a text; null texts make none.

    Columns of df with the names of new ones give way, and the text itself without ``keep_text``: else each row
    has the whole text once more, so batches of what is made are cut by bytes. Folds over the lines of a text are linear here, while as
    expressions they copy what they have so far at each step.
    """
    new = T._parse_datatype_string(schema)
    made_names = {f.name.lower() for f in new.fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in made_names and (keep_text or f.name != text)]
    types = to_arrow_schema(new)

    def piece(olds: list[pa.Array], at: list[int], made: list[tuple]) -> pa.RecordBatch:
        of = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*(c.take(of) for c in olds), *(pa.array(c, types.field(i).type) for i, c in enumerate(zip(*made, strict=True)))], [*(f.name for f in kept), *types.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            olds = [batch.column(f.name) for f in kept]
            old_bytes = _row_bytes(olds, len(batch))
            at, made, held = [], [], 0
            for k, said in enumerate(batch.column(text)):
                for row in rows(said.as_py()) if said.is_valid else ():
                    size = old_bytes[k] + sum(len(v) for v in row if isinstance(v, str)) + 8 * len(row)
                    if made and held + size > BATCH_BYTES:
                        yield piece(olds, at, made)
                        at, made, held = [], [], 0
                    at.append(k)
                    made.append(row)
                    held += size
            if made:
                yield piece(olds, at, made)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*kept, *new.fields]))


def _normal(text: str) -> str:
    bare = re.sub("\r\n?", "\n", text).strip()
    return f"{bare}\n" if bare else ""


def _some(parts: list[str]) -> list[str]:
    return [p for p in (p.strip() for p in parts) if p]


def pack(parts: list[str], most: int, joint: str) -> Iterator[tuple[str, int, int]]:
    """(text, first, last part) of neighbours joined greedily while the result has at most ``most`` characters; a longer part stays whole."""
    first, size = 0, 0
    for k, p in enumerate(parts):
        if k > first and size + len(joint) + len(p) > most:
            yield joint.join(parts[first:k]), first, k - 1
            first, size = k, len(p)
        else:
            size += len(p) + (len(joint) if k > first else 0)
    if parts:
        yield joint.join(parts[first:]), first, len(parts) - 1


def _packed(df: DataFrame, text: str, cut: Callable[[str], list[str]], most: int, joint: str, unit: str) -> DataFrame:
    def rows(said: str) -> Iterator[tuple]:
        for k, (body, first, last) in enumerate(pack(_some(cut(_normal(said))), most, joint)):
            yield k, f"text/{unit}", f"{body}\n", first, last

    return per_text(df, text, f"ordinal int, chunk_type string, content string, start_{unit} int, end_{unit} int", rows)


def full_text_chunks(df: DataFrame, text: str = "text") -> DataFrame:
    whole = df.withColumns({"ordinal": F.lit(0), "chunk_type": F.lit("text/full"), "content": normalized(text)})
    return whole.filter(F.col("content") != "")


def paragraph_chunks(df: DataFrame, text: str = "text", most: int = 2000) -> DataFrame:
    return _packed(df, text, PARAGRAPH_END.split, most, "\n\n", "paragraph")


def sentence_chunks(df: DataFrame, text: str = "text", most: int = 1200) -> DataFrame:
    return _packed(df, text, lambda t: SENTENCE_END.split(t.replace("\n", " ")), most, " ", "sentence")


def legacy_chunks(df: DataFrame, text: str = "text", most: int = 2000) -> DataFrame:
    """Paragraphs between empty lines; the first of each later chunk counts two characters more. A blank text is a chunk."""

    def rows(said: str) -> Iterator[tuple]:
        parts = _some(re.sub("\r\n?", "\n", said).split("\n\n")) or [said]
        first, size, k = 0, len(parts[0]), 0
        for i, p in enumerate(parts[1:], start=1):
            if size + len(p) + 2 > most:
                yield k, "\n\n".join(parts[first:i])
                first, size, k = i, 0, k + 1
            size += len(p) + 2
        yield k, "\n\n".join(parts[first:])

    return per_text(df, text, "ordinal int, content string", rows)


def section_chunks(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Sections that begin at # headings, with the path of headings above them and 1-based lines."""

    def rows(said: str) -> Iterator[tuple]:
        plain = _normal(said)
        if not plain:
            return
        lines = plain[:-1].split("\n")
        starts, above = [(1, [])], []
        for k, line in enumerate(lines, start=1):
            if m := HEADING.match(line):
                above = [a for a in above if a[0] < len(m[1])] + [(len(m[1]), m[2])]
                starts.append((k, [title for _, title in above]))
        if len(starts) > 1 and starts[1][0] == 1:
            starts = starts[1:]
        for k, (first, path) in enumerate(starts):
            last = starts[k + 1][0] - 1 if k + 1 < len(starts) else len(lines)
            body = "\n".join(lines[first - 1 : last]).strip()
            if body:
                yield k, "text/section", f"{body}\n", path, first, last

    return per_text(df, text, "ordinal int, chunk_type string, content string, section_path array<string>, start_line int, end_line int", rows, keep_text)


def blank_line_paragraphs(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Groups of lines between blank ones, with the 0-based line at which they start."""

    def rows(said: str) -> Iterator[tuple]:
        k, start, held = 0, 0, []
        for at, line in enumerate([*said.split("\n"), ""]):
            if line.strip():
                start = start if held else at
                held.append(line)
            elif held:
                yield k, start, "\n".join(held)
                k, held = k + 1, []

    return per_text(df, text, "ordinal int, start_line int, content string", rows, keep_text)


def strided_terms(df: DataFrame, text: str = "text", window: int = 512, stride: int = 256) -> DataFrame:
    """Overlapping windows of terms; an addition, as nothing of the kind was finished elsewhere."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    found = df.select(*kept, terms(text).alias("_t")).filter(F.size("_t") > 0)
    rows = found.select(*kept, "_t", F.posexplode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_t") - window + stride), F.lit(stride))).alias("ordinal", "_at"))
    return rows.select(*kept, "ordinal", F.array_join(F.slice(F.col("_t"), F.col("_at"), F.lit(window)), " ").alias("content"))
