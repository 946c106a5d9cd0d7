"""Tables of a sample corpus, derived from plain tables: files, chunks, handles, edges, triples, vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as x
from marlstone.operators import fts, handles
from marlstone.sources.store import removed_at_exit, shared_folder

SUFFIXES = (".md", ".txt", ".py", ".html", ".bin", ".js")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of six kinds, in a folder per source."""
    kind = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), kind).alias("path"), F.col("text").alias("content"), "lang")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an empty line after each line, so that their lines are paragraphs."""
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source")


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings of three levels: their language, then one at each empty line and sentence."""
    text = F.concat(F.lit("# "), F.col("lang"), F.lit("\n"), F.replace(F.replace("text", F.lit("\n\n"), F.lit("\n## part\n")), F.lit(". "), F.lit(".\n### point \n")))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


_indexes: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, sf_dir: str) -> fts.Index:
    """The term index of the documents, built once for an application and folder, stored, and read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"
        fts.write_index(fts.build_index(chunks(spark, sf_dir)), path)
        removed_at_exit(spark, path)
        _indexes[key] = path
    return fts.read_index(spark, _indexes[key])


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part, with a heading, emphasis, a link, lists, a quote, code, a table and a figure."""
    p = lambda c: F.col(c).cast("string")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    html = F.concat(
        F.lit("<html><head><title>t</title><script>no()</script></head><body><h1>Part "), p("p_partkey"), F.lit("</h1><p>A <b>"), p("p_brand"), F.lit("</b> of <em>"), p("p_type"), F.lit("</em> <a href='/p"), p("p_partkey"),
        F.lit("'>here</a>.</p><ul><li>one<ol><li>inner</li></ol></li><li>two</li></ul><blockquote>quoted</blockquote><pre>x  = 1</pre><table><caption>"), p("p_type"), F.lit("</caption><tr><th>Size</th><th>Price</th></tr><tr><td>"), p("p_size"),
        F.lit("</td><td>"), price, F.lit("</td></tr><tr><td>1,000</td><td>no</td></tr></table><figure><img src='"), p("p_partkey"), F.lit(".png' alt='"), p("p_name"), F.lit("'><figcaption>"), p("p_brand"), F.lit("</figcaption></figure></body></html>"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", html.alias("html"))


#: Where the chain of sources begins.
FIRST_SOURCE = "src0"


def source_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples that lead from each source of the documents to the next one in order."""
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    # as many rows as there are sources
    after = F.lead("source").over(Window.orderBy("source"))
    return sources.select(F.col("source").alias("subject"), F.lit("before").alias("verb"), after.alias("object"), F.lit("table").alias("source"), F.lit(False).alias("bidirectional"), F.lit(0).cast("long").alias("pos")).filter("object is not null")


def file_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handles.file_refs(files(spark, sf_dir))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in regions (both ways), customers and suppliers in nations, orders placed by customers."""

    def of(rows: DataFrame, subject: tuple[str, str], verb: str, target: tuple[str, str], first: int, both: bool = False) -> DataFrame:
        name = lambda p: F.concat(F.lit(f"{p[0]}:"), F.col(p[1]).cast("string"))
        return rows.select(name(subject).alias("subject"), F.lit(verb).alias("verb"), name(target).alias("object"), F.lit("table").alias("source"), F.lit(both).alias("bidirectional"), (F.col(subject[1]).cast("long") + first).alias("pos"))

    t = lambda name: table(spark, sf_dir, name)
    parts = [
        of(t("nation"), ("nation", "n_nationkey"), "in", ("region", "n_regionkey"), 0, True),
        of(t("customer"), ("customer", "c_custkey"), "lives_in", ("nation", "c_nationkey"), 10**9, True),
        of(t("supplier"), ("supplier", "s_suppkey"), "sells_in", ("nation", "s_nationkey"), 2 * 10**9),
        of(t("orders"), ("order", "o_orderkey"), "placed_by", ("customer", "o_custkey"), 3 * 10**9),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TRIPLES_SQL = """(select 'nation:' || n_nationkey subject, 'in' verb, 'region:' || n_regionkey as object, 'table' source, true bidirectional, cast(n_nationkey as bigint) pos from nation
 union all select 'customer:' || c_custkey, 'lives_in', 'nation:' || c_nationkey, 'table', true, c_custkey + 1000000000 from customer
 union all select 'supplier:' || s_suppkey, 'sells_in', 'nation:' || s_nationkey, 'table', false, s_suppkey + 2000000000 from supplier
 union all select 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey, 'table', false, o_orderkey + 3000000000 from orders)"""
FILES_SQL = f"(select doc_id, source || '/' || doc_id || (array[{', '.join(repr(s) for s in SUFFIXES)}])[doc_id % {len(SUFFIXES)} + 1] path, text as content, lang from documents)"
