"""Query op2: documents against the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table
from marlstone.llm.decontaminate import with_matches


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


#: Items of fewer words than a window are one window each, so the lengths that windows have are taken from the table.
ORACLE = r"""
with recursive w as (select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
v as (select distinct item_id, least(10, len(ws)) n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') t from b, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) u(i) where len(ws) > 0),
d as (select r, i, n, array_to_string(ws[i : i + n - 1], ' ') t from w, (select distinct n from v), unnest(range(1, len(ws) - n + 2)) u(i)),
m as (select r, i, n, item_id from d join v using (n, t)),
h as (select r, count(distinct i + k) n_hit from (select distinct r, i, n from m), unnest(range(0, n)) u(k) group by r),
g as (select r, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from m group by r)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from w left join h using (r) left join g using (r)
"""
