from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import text as x
from marlstone.operators import chunking
from marlstone.operators.extract import text as plain


def test_terms_of_a_text_of_over_a_million_characters(spark):
    docs = spark.range(1).select("id", F.concat(F.repeat(F.lit("word "), 200_001), F.lit("Tail")).alias("text"))
    row = docs.select(F.size(x.terms("text")).alias("n"), F.element_at(x.terms("text"), -1).alias("last")).first()
    assert (row.n, row.last) == (200_002, "tail")
    assert chunking.strided_terms(docs).filter("content like '%tail%'").count() > 0


def batches(spark, f, texts, **parameters):
    """What f sends back to Spark for one batch of texts."""
    schema = T._parse_datatype_string("k int, text string")
    df = SimpleNamespace(schema=schema, sparkSession=spark, mapInArrow=lambda run, to: (run, to.names))
    run, names = f(df, **parameters)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.string())], ["k", "text"])
    got = list(run(iter([batch])))
    assert all(b.schema.names == names for b in got)
    return got


MANY = {"section_chunks": "# head\nline of a section\n", "blank_line_paragraphs": "a paragraph\n\n", "references": "References\n- an entry\n"}


@pytest.mark.parametrize("name", MANY)
def test_batches_of_pieces_are_bounded_in_bytes(spark, name):
    f = getattr(chunking, name, None) or getattr(plain, name)
    texts = [None, MANY[name] * 2000, "", *["x" * 200 + "\n" + MANY[name] * 300] * 20]
    whole = batches(spark, f, texts)
    # with the text in each row some 100 MB
    assert len(whole) > 10 and max(b.nbytes for b in whole) < 8 << 20
    bare = batches(spark, f, texts, keep_text=False)
    assert "text" not in bare[0].schema.names and max(b.nbytes for b in bare) < 8 << 20
    rows = [r for b in whole for r in b.drop_columns(["text"]).to_pylist()]
    assert rows == [r for b in bare for r in b.to_pylist()] and sum(r["k"] == 1 for r in rows) >= 2000
    assert all(t == texts[k] for b in whole[::9] for k, t in zip(b["k"].to_pylist(), b["text"].to_pylist(), strict=True))
