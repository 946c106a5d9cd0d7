"""Queries that apply the operators to whole tables, and the same results in SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import fixed
from marlstone.functions import text as x
from marlstone.operators import chunking, embed, fts, fusion, graph, handles, hints, materialize, sync, units, vector
from marlstone.operators.extract import html
from marlstone.operators.extract import text as plain
from marlstone.plans import corpus
from marlstone.plans.corpus import FILES_SQL, TRIPLES_SQL, table
from marlstone.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def case(values: dict[str, str], key: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + " end"


def normal(text: str) -> str:
    return rf"(case when trim({text}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' then '' else trim(regexp_replace({text}, '\r\n?', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10) end)"


def strip(text: str) -> str:
    return f"trim({text}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


SUFFIX_SQL = r"regexp_extract(path, '[^/](\.[^./]+)$', 1)"
MEDIA_SQL = f"coalesce({case(fixed.CODE_MEDIA, SUFFIX_SQL)}, {case(fixed.CODE_MEDIA, f'lower({SUFFIX_SQL})')}, {case(fixed.TEXT_MEDIA, f'lower({SUFFIX_SQL})')}, 'application/octet-stream')"
HANDLES_SQL = f"(select 'hf_' || sha256(content) handle, 'file_ref' kind, media media_type, 'source' as role, case when starts_with(media, 'text/') then 'indexable' else 'raw' end index_state, cast(null as varchar) derivative_type, path as label, path, sha256(content) sha256 from (select *, {MEDIA_SQL} media from {FILES_SQL}) qualify row_number() over (partition by content order by path desc) = 1)"
TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
INDEX_TERMS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_./-]+')"


def packed(parts: str, most: int, joint: str, kind: str, unit: str) -> str:
    """SQL for greedy packing; parts: (k, i from 1, p)."""
    full = f"size + {len(joint)} + length(p.p) > {most}"
    j = "chr(10) || chr(10)" if joint == "\n\n" else f"'{joint}'"
    return f"""with recursive parts as materialized ({parts}),
r as (select k, i, cast(0 as bigint) c, length(p) size from parts where i = 1
 union all select r.k, p.i, case when {full} then c + 1 else c end, case when {full} then length(p.p) else size + {len(joint)} + length(p.p) end from r join parts p on p.k = r.k and p.i = r.i + 1)
select k doc_id, cast(c as int) ordinal, '{kind}' chunk_type, string_agg(p, {j} order by i) || chr(10) as content, cast(min(i) - 1 as int) start_{unit}, cast(max(i) - 1 as int) end_{unit} from r join parts using (k, i) group by k, c"""


def numbered(list_sql: str, of: str = "documents") -> str:
    """Non-blank stripped parts of a list per document, numbered."""
    return f"select doc_id k, unnest(range(1, len(l) + 1)) i, unnest(l) p from (select doc_id, list_filter(list_transform({list_sql}, lambda q: {strip('q')}), lambda q: q <> '') l from {of})"


DOUBLE_LINES = "(select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents)"

# text and chunks


@query(f"select doc_id, term, count(*) n from (select doc_id, unnest({TERMS}) term from documents) group by all")
def tokenize_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(x.terms("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"select doc_id, term, count(*) n from (select doc_id, unnest({INDEX_TERMS}) term from documents) group by all")
def index_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(x.index_terms("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"select doc_id, {normal('text')} as text from documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", x.normalized("text").alias("text"))


@query(f"select doc_id, 0 ordinal, 'text/full' chunk_type, {normal('text')} as content from documents where {strip('text')} <> ''")
def chunk_full(spark, sf):
    return chunking.full_text_chunks(table(spark, sf, "documents").select("doc_id", "text")).drop("text")


@query(packed(numbered(rf"string_split_regex({normal('text')}, '\n\s*\n')", DOUBLE_LINES), 2000, "\n\n", "text/paragraph", "paragraph"))
def chunk_paragraphs(spark, sf):
    return chunking.paragraph_chunks(corpus.paragraphs(spark, sf)).drop("text")


@query(packed(numbered(rf"string_split_regex(regexp_replace(replace({normal('text')}, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"), 1200, " ", "text/sentence", "sentence"))
def chunk_sentences(spark, sf):
    return chunking.sentence_chunks(table(spark, sf, "documents").select("doc_id", "text")).drop("text")


@query(f"""with recursive parts as materialized ({numbered("string_split(text, chr(10) || chr(10))", DOUBLE_LINES)}),
r as (select k, i, cast(0 as bigint) c, length(p) size from parts where i = 1
 union all select r.k, p.i, case when size + 2 + length(p.p) > 1500 then c + 1 else c end, case when size + 2 + length(p.p) > 1500 then length(p.p) + 2 else size + 2 + length(p.p) end from r join parts p on p.k = r.k and p.i = r.i + 1)
select k doc_id, cast(c as int) ordinal, string_agg(p, chr(10) || chr(10) order by i) as content from r join parts using (k, i) group by k, c
union all select doc_id, 0, text from {DOUBLE_LINES} where {strip('text')} = ''""")
def chunk_legacy(spark, sf):
    return chunking.legacy_chunks(corpus.paragraphs(spark, sf), most=1500).drop("text")


HEADED = "(select doc_id, '# ' || lang || chr(10) || replace(replace(text, chr(10) || chr(10), chr(10) || '## part' || chr(10)), '. ', '.' || chr(10) || '### point ' || chr(10)) as text from documents)"


@query(rf"""with l as (select doc_id, unnest(range(1, len(q) + 1)) i, unnest(q) line from (select doc_id, string_split(regexp_replace({normal('text')}, '\n$', ''), chr(10)) q from {HEADED} where {strip('text')} <> '')),
h as (select *, length(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*$', 1)) lv, regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*$', 2) title from l),
s as (select *, sum(case when lv > 0 or i = 1 then 1 else 0 end) over (partition by doc_id order by i) sec from h),
b as (select doc_id, sec, min(i) first, max(i) last, {strip("string_agg(line, chr(10) order by i)")} || chr(10) body from s group by all),
p as (select b.doc_id, b.sec, list(a.title order by a.i) path from b join h a on a.doc_id = b.doc_id and a.lv > 0 and a.i <= b.first where not exists (select 1 from h n where n.doc_id = b.doc_id and n.lv > 0 and n.i > a.i and n.i <= b.first and n.lv <= a.lv) group by all)
select b.doc_id, cast(b.sec - 1 as int) ordinal, 'text/section' chunk_type, body as content, coalesce(array_to_string(path, ' > '), '') section_path, cast(first as int) start_line, cast(last as int) end_line from b left join p on p.doc_id = b.doc_id and p.sec = b.sec where body <> chr(10)""")
def chunk_sections(spark, sf):
    return chunking.section_chunks(corpus.headed(spark, sf), keep_text=False).withColumn("section_path", F.array_join("section_path", " > "))


@query(f"""with l as (select doc_id, unnest(range(0, len(q))) i, unnest(q) line from (select doc_id, string_split(text, chr(10)) q from {DOUBLE_LINES})),
g as (select *, sum(case when {strip('line')} = '' then 1 else 0 end) over (partition by doc_id order by i) g from l)
select doc_id, cast(row_number() over (partition by doc_id order by min(i)) - 1 as int) ordinal, cast(min(i) as int) start_line, string_agg(line, chr(10) order by i) as content from g where {strip('line')} <> '' group by doc_id, g""")
def paragraphs_by_blank_lines(spark, sf):
    return chunking.blank_line_paragraphs(corpus.paragraphs(spark, sf), keep_text=False)


@query(f"select doc_id, cast(o as int) ordinal, array_to_string(t[o * 256 + 1 : o * 256 + 512], ' ') as content from (select doc_id, t, unnest(range(0, case when len(t) <= 512 then 1 else cast(ceil((len(t) - 512 + 256) / 256.0) as bigint) end)) o from (select doc_id, {TERMS} t from documents) where len(t) > 0)")
def chunk_strided_terms(spark, sf):
    return chunking.strided_terms(table(spark, sf, "documents").select("doc_id", "text")).drop("text")


# full text

STATS = f"with recursive d as materialized (select doc_id, {INDEX_TERMS} t from documents), s as (select count(*) n, avg(len(t)) mean from d)"


def bm25_sql(tf: str, holds: str) -> str:
    """tf: alias -> SQL of a count per document; holds: condition on the aliases."""
    names = [a for a, _ in tf]
    idf = lambda a: f"case when ln((n - d_{a} + cast(0.5 as double)) / (d_{a} + cast(0.5 as double))) <= 0 then cast(1e-6 as double) else ln((n - d_{a} + cast(0.5 as double)) / (d_{a} + cast(0.5 as double))) end"
    part = lambda a: f"{idf(a)} * {a} * (cast(1.2 as double) + cast(1.0 as double)) / ({a} + cast(1.2 as double) * (cast(1.0 as double) - cast(0.75 as double) + cast(0.75 as double) * length / mean))"
    scored = [a for a in names if not a.startswith("no_")]
    return f"""{STATS}, f as (select doc_id, len(t) length, {", ".join(f"{q} {a}" for a, q in tf)} from d), c as (select {", ".join(f"count(*) filter ({a} > 0) d_{a}" for a in names)} from f)
select doc_id chunk_id, round(-({" + ".join(part(a) for a in scored)}), 6) score from f, s, c where {holds}"""


def times(word: str) -> str:
    return f"len(list_filter(t, lambda w: w = '{word}'))"


def found(spark, sf, text: str, limit: int | None = None) -> DataFrame:
    index = corpus.index(spark, sf)
    hits = fts.matches(index, text) if limit is None else fts.search(index, text, limit)
    return hits.select("chunk_id", F.round("score", 6).alias("score"))


@query(bm25_sql([("a", times("the")), ("b", times("was"))], "a > 0 and b > 0"))
def fts_and(spark, sf):
    return found(spark, sf, "the AND was")


@query(bm25_sql([("a", times("which")), ("b", times("une"))], "a > 0 or b > 0"))
def fts_or(spark, sf):
    return found(spark, sf, "which OR une")


@query(bm25_sql([("a", times("the")), ("no_b", times("was"))], "a > 0 and no_b = 0"))
def fts_not(spark, sf):
    return found(spark, sf, "the NOT was")


@query(bm25_sql([("a", "len(list_filter(t, lambda w: starts_with(w, 'ther')))")], "a > 0"))
def fts_prefix(spark, sf):
    return found(spark, sf, "ther*")


@query(bm25_sql([("a", "len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' and t[i + 1] = 'the'))")], "a > 0"))
def fts_phrase(spark, sf):
    return found(spark, sf, '"of the"')


@query(bm25_sql([("a", times("the")), ("b", times("of")), ("no_n", "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'the' and list_contains(t[greatest(i - 3, 1) : i + 3], 'of')))")], "no_n > 0"))
def fts_near(spark, sf):
    """At most two words between the two."""
    return found(spark, sf, "NEAR(the of, 2)")


@query(bm25_sql([("a", times("the")), ("b", times("and")), ("c", times("of"))], "a > 0 and (b > 0 or c > 0)"))
def fts_nested(spark, sf):
    return found(spark, sf, "the (and OR of)")


@query(bm25_sql([("a", times("the")), ("b", times("une")), ("c", times("und"))], "a > 0 or b > 0 or c > 0") + " order by score, chunk_id limit 10")
def fts_topk(spark, sf):
    """The flagship: the ten best chunks of whole documents."""
    return found(spark, sf, "the OR une OR und", 10)


@query(f"select cast(count(*) as bigint) n, sum(len(t)) terms, round(avg(len(t)), 6) mean from (select {INDEX_TERMS} t from documents)")
def doc_stats(spark, sf):
    return corpus.index(spark, sf).documents.agg(F.count("*").alias("n"), F.sum("length").alias("terms"), F.round(F.avg("length"), 6).alias("mean"))


@query(f"select term, count(distinct doc_id) df, count(*) tf from (select doc_id, unnest({INDEX_TERMS}) term from documents) group by term")
def term_df(spark, sf):
    return corpus.index(spark, sf).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions").cast("long")).alias("tf"))


def okapi_sql(part: str, asked: dict[str, int]) -> str:
    words = ", ".join(f"'{w}'" for w in asked)
    return f"""with d as materialized (select doc_id, {part} part, {TERMS} t from documents), s as (select part, count(*) n, avg(cast(len(t) as double)) mean from d group by part),
f as (select part, term, count(*) df from (select part, unnest(list_distinct(t)) term from d) group by all),
r as (select f.part, term, ln(n - df + cast(0.5 as double)) - ln(df + cast(0.5 as double)) raw, mean from f join s using (part)),
m as (select part, avg(raw) mean_idf from r group by part),
h as (select doc_id, part, len(t) length, w.term, len(list_filter(t, lambda q: q = w.term)) tf from d, (select unnest([{words}]) term) w)
select doc_id, {'h.part source, ' if part == 'source' else ''}round(sum({case({w: n for w, n in asked.items()}, 'h.term').replace("'1'", '1').replace("'2'", '2')} * (case when raw < 0 then cast(0.25 as double) * mean_idf else raw end) * (tf * (cast(1.5 as double) + cast(1.0 as double)) / (tf + cast(1.5 as double) * (cast(1.0 as double) - cast(0.75 as double) + cast(0.75 as double) * length / mean)))), 6) score
from h join r on r.part = h.part and r.term = h.term join m on m.part = h.part where tf > 0 group by all"""


def tokens(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", x.terms("text").alias("tokens"))


@query(okapi_sql("0", {"the": 2, "une": 1}))
def okapi(spark, sf):
    return fts.okapi(tokens(spark, sf), "the une The", "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"select doc_id, score from ({okapi_sql('source', {'the': 1, 'une': 1})}) qualify row_number() over (partition by source order by score desc, doc_id) <= 30 order by score desc, doc_id limit 30")
def okapi_partitions_topk(spark, sf):
    scored = fts.okapi(tokens(spark, sf), "the une", "doc_id", partition="source").withColumn("score", F.round("score", 6))
    return fts.okapi_top(scored, 30, "doc_id", "source").select("doc_id", "score")


@query(rf"select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') || ['document', lang] terms from documents")
def bm25_document(spark, sf):
    """Terms of the content and of the metadata's text."""
    about = F.from_json(F.to_json(F.struct(F.lit("document").alias("kind"), F.col("lang").alias("name"))), units.METADATA)
    return table(spark, sf, "documents").select("doc_id", F.concat(x.terms("text"), x.terms(x.metadata_text(about))).alias("terms"))


# vectors

QUERY_VECTOR = [((k * 37) % 19 - 9) / 10 for k in range(64)]
COSINE = f"list_dot_product(list_transform(embedding, lambda v: cast(v as double)), (select list_transform({QUERY_VECTOR}, lambda v: cast(v as double)))) / greatest(sqrt(list_dot_product(list_transform(embedding, lambda v: cast(v as double)), list_transform(embedding, lambda v: cast(v as double)))), 1e-10) / {sum(v * v for v in QUERY_VECTOR) ** 0.5!r}"


@query(f"select vec_id, round(score, 6) score from (select vec_id, {COSINE} score from embeddings) order by score desc, vec_id limit 20")
def vector_topk(spark, sf):
    return vector.top_k(table(spark, sf, "embeddings"), QUERY_VECTOR, 20).select("vec_id", F.round("score", 6).alias("score"))


@query(f"select label, vec_id, round(score, 6) score, row_number() over (partition by label order by score desc, vec_id) as rank from (select label, vec_id, {COSINE} score from embeddings) qualify rank <= 5")
def vector_topk_per_partition(spark, sf):
    return vector.top_k_per_partition(table(spark, sf, "embeddings"), QUERY_VECTOR, 5, "label").withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query(f"select label, vec_id, round(score, 6) score from (select label, vec_id, {COSINE} score from embeddings qualify row_number() over (partition by label order by {COSINE} desc, vec_id) <= 7) order by score desc, vec_id limit 7")
def node_search(spark, sf):
    """The same kernel on vectors of nodes: the best of each partition, merged."""
    parts = vector.top_k_per_partition(table(spark, sf, "embeddings"), QUERY_VECTOR, 7, "label").drop("rank")
    return vector.merged_top_k(parts, 7).withColumn("score", F.round("score", 6))


@query(rf"""with s as (select doc_id, place, sum(sign) v from (select doc_id, cast('0x' || substr(md5(term), 1, 8) as bigint) % 64 place, case when substr(md5(term), 9, 1) < '8' then 1e0 else -1e0 end sign from (select doc_id, unnest({TERMS}) term from documents)) group by all having sum(sign) <> 0)
select doc_id, place, round(v / sqrt(sum(v * v) over (partition by doc_id)), 6) as value from s""")
def hash_embedding(spark, sf):
    return embed.weights(table(spark, sf, "documents"), "doc_id", dim=64).withColumn("value", F.round("value", 6))


@query(rf"""with e as (select verb, min(pos) pos from {TRIPLES_SQL} group by verb), t as (select verb, unnest(regexp_extract_all(lower(replace(verb, '_', ' ')), '[\p{{L}}\p{{N}}_]+')) term from e),
s as (select verb, cast('0x' || substr(md5(term), 1, 8) as bigint) % 64 place, sum(case when substr(md5(term), 9, 1) < '8' then 1e0 else -1e0 end) v from t group by all),
q as (select cast('0x' || substr(md5(term), 1, 8) as bigint) % 64 place, sum(case when substr(md5(term), 9, 1) < '8' then 1e0 else -1e0 end) v from (select unnest(['lives', 'in']) term) group by 1)
select verb id, pos, round(coalesce((select sum(s.v * q.v) from s join q using (place) where s.verb = e.verb), 0) / sqrt((select sum(s.v * s.v) from s where s.verb = e.verb)) / sqrt((select sum(q.v * q.v) from q)), 5) score from e order by score desc, id limit 3""")
def verb_search(spark, sf):
    """The verbs that are closest to a phrase."""
    phrase = embed.embedded(spark.createDataFrame([("lives in",)], "text string"), dim=64).first()["embedding"]
    vectors = embed.verb_vectors(corpus.triples(spark, sf), 64)
    return vector.top_k(vectors, phrase, 3, "id").join(vectors.select("id", "pos"), "id").withColumn("score", F.round("score", 5))


# fusion

METADATA_VECTOR = [((k * 53) % 23 - 11) / 10 for k in range(64)]
METADATA_COSINE = COSINE.replace(str(QUERY_VECTOR), str(METADATA_VECTOR)).replace(repr(sum(v * v for v in QUERY_VECTOR) ** 0.5), repr(sum(v * v for v in METADATA_VECTOR) ** 0.5))


def candidates(spark, sf) -> DataFrame:
    """What four searches give: two over vectors, one over the terms of whole texts, one over a graph of sources, which are the units."""
    row = lambda df, name, key, score: df.select(F.lit(name).alias("modality"), F.col(key).cast("string").alias("id"), F.round(score, 6).alias("score"))
    vectors = table(spark, sf, "embeddings")
    content, about = (row(vectors, name, "vec_id", vector.cosine(vectors, q)) for name, q in (("content", QUERY_VECTOR), ("metadata", METADATA_VECTOR)))
    words = row(fts.okapi(tokens(spark, sf), "the une", "doc_id"), "terms", "doc_id", F.col("score"))
    reached = graph.traverse(graph.adjacency(corpus.source_chain(spark, sf)), corpus.FIRST_SOURCE)
    return content.unionByName(about).unionByName(words).unionByName(row(reached, "graph", "node", F.col("score")))


def unit_chunks(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("unit_id"), F.col("text").alias("content"))


CANDIDATES = f"""(select 'content' modality, cast(vec_id as varchar) id, round({COSINE}, 6) score from embeddings union all select 'metadata', cast(vec_id as varchar), round({METADATA_COSINE}, 6) from embeddings
 union all select 'terms', cast(doc_id as varchar), score from ({okapi_sql("0", {"the": 1, "une": 1})})
 union all select 'graph', node, round(1e0 / (min(depth) + 1), 6) from (with recursive s as (select source, lead(source) over (order by source) after from (select distinct source from documents)), r as (select '{corpus.FIRST_SOURCE}' node, -1 depth union select after, depth + 1 from r join s on source = node where after is not null and depth < 2) select * from r where depth >= 0) group by node)"""
FETCHED = f"(with c as materialized (select * from {CANDIDATES}) select * from c where modality = 'graph' union all select * from (select * from c where modality <> 'graph' qualify row_number() over (partition by modality order by score desc, id) <= {20 * fusion.OVER_FETCH}))"


def normed_sql(of: str) -> str:
    return f"(select modality, id, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else cast(1.0 as double) end score from {of} window w as (partition by modality))"


def fused_of(of: str, weights: fusion.SearchWeights) -> str:
    w = [f"cast({v} as double)" for v in (weights.content, weights.metadata, weights.terms, weights.graph, weights.total)]
    return f"""(with n as materialized (select * from {normed_sql(of)}) select id, a, b, c, g, ({w[0]} * a + {w[1]} * b + {w[2]} * c + {w[3]} * g) / {w[4]} score from (select id, {", ".join(f"coalesce(max(score) filter (modality = '{m}'), cast(0.0 as double)) {k}" for m, k in zip(fusion.MODALITIES, "abcg", strict=True))}
 from (select modality, id, score from n where modality <> 'graph' union all select 'graph', cast(doc_id as varchar), max(score) from n join documents on id = source where modality = 'graph' group by doc_id) group by id) where id in (select cast(doc_id as varchar) from documents))"""


@query(f"select modality, id, round(score, 5) score from {normed_sql(CANDIDATES)}")
def minmax_norm(spark, sf):
    return fusion.normalized_scores(candidates(spark, sf)).withColumn("score", F.round("score", 5))


@query(f"select cast(doc_id as varchar) id, round(max(score), 5) score from {normed_sql(CANDIDATES)} join documents on id = source where modality = 'graph' group by doc_id")
def graph_scores_of_chunks(spark, sf):
    graph_only = fusion.normalized_scores(candidates(spark, sf)).filter("modality = 'graph'")
    return fusion.spread_to_chunks(graph_only, unit_chunks(spark, sf)).withColumn("score", F.round("score", 5))


@query(f"select modality, id, score from {FETCHED}")
def over_fetch(spark, sf):
    """Of each search three times as many candidates as results."""
    return fusion.over_fetched(candidates(spark, sf), 20)


def fused_sql(of: str, weights: fusion.SearchWeights, rest: str) -> str:
    return f"select id chunk_id, round(score, 5) score, case when a >= greatest(a, b, c, g) then 'vector' when b >= greatest(a, b, c, g) then 'metadata' when c >= greatest(a, b, c, g) then 'bm25' else 'graph' end source from {fused_of(of, weights)} {rest}"


@query(fused_sql(FETCHED, fusion.SearchWeights(), "order by score desc, chunk_id limit 20"))
def fused_search(spark, sf):
    return fusion.search(fusion.over_fetched(candidates(spark, sf), 20), unit_chunks(spark, sf)).select("chunk_id", F.round("score", 5).alias("score"), "source")


@query(fused_sql(CANDIDATES, fusion.weights_for("structural"), ""))
def fused_structural(spark, sf):
    return fusion.search(candidates(spark, sf), unit_chunks(spark, sf), None, fusion.weights_for("structural")).select("chunk_id", F.round("score", 5).alias("score"), "source")


@query(f"select cast(doc_id as varchar) chunk_id, round(score, 4) score, substr(text, 1, 500) as content from (select id, score from {fused_of(FETCHED, fusion.SearchWeights())} order by score desc, id limit 20) join documents on id = cast(doc_id as varchar)")
def search_projection(spark, sf):
    return fusion.shown(fusion.search(fusion.over_fetched(candidates(spark, sf), 20), unit_chunks(spark, sf))).select("chunk_id", "score", "content")


WORDS = lambda of: " or ".join(f"contains(lower(q), '{w}')" for w in of)


@query(rf"with t as (select doc_id, text q from documents) select doc_id, i intent, cast(w[1] as double) content, cast(w[2] as double) metadata, cast(w[3] as double) terms, cast(w[4] as double) graph from (select *, case i {' '.join(f"when '{k}' then {[float(v) for v in w]}" for k, w in fixed.INTENT_WEIGHTS.items())} end w from (select *, case when {WORDS(fixed.STRUCTURAL_WORDS)} then 'structural' when {WORDS(fixed.HISTORY_WORDS)} then 'history' when regexp_matches(q, '[_.]') or (regexp_matches(q, '\p{{Lu}}') and regexp_matches(q, '\p{{Ll}}')) then 'code' else 'conceptual' end i from t))")
def intent_weights(spark, sf):
    return weights_of(table(spark, sf, "documents").select("doc_id", x.intent("text").alias("intent")))


def weights_of(docs: DataFrame) -> DataFrame:
    weight = lambda k: F.element_at(F.create_map(*[F.lit(v) for name, w in fixed.INTENT_WEIGHTS.items() for v in (name, float(w[k]))]), F.col("intent"))
    return docs.select("doc_id", "intent", *[weight(k).alias(m) for k, m in enumerate(fusion.MODALITIES)])


# paths and identities


@query(f"select path, {MEDIA_SQL} media_type, starts_with({MEDIA_SQL}, 'text/x-code-') is_code, {case(fixed.LANGUAGES, SUFFIX_SQL)} as language, lower({SUFFIX_SQL}) in {fixed.TEXT_SUFFIXES} is_text, case when starts_with({MEDIA_SQL}, 'text/') then 'indexable' else 'raw' end index_state from {FILES_SQL}")
def media_type_guess(spark, sf):
    return corpus.files(spark, sf).select("path", x.media_type("path").alias("media_type"), x.is_code_media(x.media_type("path")).alias("is_code"), x.language("path").alias("language"), x.is_text_file("path").alias("is_text"), x.index_state(x.media_type("path")).alias("index_state"))


@query(f"select path, string_split(path, '/')[1] partition_key, substr(sha256(string_split(path, '/')[1]), 1, 12) partition_hash, starts_with(path, 'src1/') below from {FILES_SQL}")
def partition_keys(spark, sf):
    return corpus.files(spark, sf).select("path", x.partition_key("path").alias("partition_key"), x.partition_hash(x.partition_key("path")).alias("partition_hash"), x.is_below("path", F.lit("src1")).alias("below"))


@query(f"select path, substr(sha256(path || ':0:' || length(content) || ':' || content), 1, 16) chunk_id from {FILES_SQL}")
def chunk_ids(spark, sf):
    return corpus.files(spark, sf).select("path", x.chunk_id("path", F.lit(0), F.length("content"), "content").alias("chunk_id"))


@query("select name, case when starts_with(name, '__') and not ends_with(name, '__') then 'private' when starts_with(name, '_') then 'protected' else 'public' end visibility from (select case doc_id % 4 when 0 then '' when 1 then '_' else '__' end || source || case when doc_id % 4 = 3 then '__' else '' end as name from documents)")
def visibility(spark, sf):
    k = F.col("doc_id") % 4
    name = F.concat(F.when(k == 0, "").when(k == 1, "_").otherwise("__"), "source", F.when(k == 3, "__").otherwise(""))
    return table(spark, sf, "documents").select(name.alias("name")).select("name", x.visibility("name").alias("visibility"))


def unit_metadata() -> F.Column:
    parts = {
        "name": F.concat(F.lit("f"), F.col("p_partkey").cast("string")), "qualified_name": F.concat("p_brand", F.lit(".f")), "kind": F.when(F.col("p_partkey") % 2 == 0, "function").otherwise("method"), "parent_name": F.when(F.col("p_partkey") % 2 == 1, F.col("p_type")),
        "parent_kind": F.lit("class"), "parameters": F.when(F.col("p_partkey") % 3 > 0, F.slice(F.array("p_name", "p_brand"), F.lit(1), (F.col("p_partkey") % 3 - 1).cast("int"))), "return_type": F.when(F.col("p_size") > 25, F.lit("int")), "decorators": F.array("p_brand"), "docstring": F.col("p_name"),
        "visibility": F.lit("public"), "cyclomatic_branch_count": F.col("p_size"), "imports_used": F.array().cast("array<string>"), "calls_made": F.array(F.struct(F.lit("a.b").alias("raw"), F.when(F.col("p_size") > 10, F.lit("m.b")).alias("resolved_unit_id"))),
    }
    return F.struct(*[v.alias(k) for k, v in parts.items()]).cast(units.METADATA)


@query("""select p_partkey, concat_ws(chr(10), case when p_partkey % 2 = 0 then 'function' else 'method' end || ' f' || p_partkey || case p_partkey % 3 when 0 then '' when 1 then '()' else '(' || p_name || ')' end || case when p_size > 25 then ' -> int' else '' end,
 case when p_partkey % 2 = 1 then '  in class ' || p_type end, '  qualified: ' || p_brand || '.f', '  visibility: public', '  decorators: ' || p_brand, '  calls: ' || case when p_size > 10 then 'm.b' else 'a.b' end, '  cyclomatic_branch_count: ' || p_size, '  docstring: ' || p_name) as text from part""")
def metadata_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", unit_metadata().alias("m")).select("p_partkey", x.metadata_text(F.col("m")).alias("text"))


# handles


@query(f"select * from {HANDLES_SQL}")
def file_handles(spark, sf):
    return corpus.file_handles(spark, sf)


def derivatives(spark, sf) -> DataFrame:
    f = corpus.files(spark, sf)
    made = f.select("content", F.lit("text/markdown").alias("media_type"), F.element_at(F.array(*[F.lit(k) for k in (*fixed.MATERIALIZERS, "other")]), (F.col("doc_id") % 8 + 1).cast("int")).alias("derivative_type"), F.col("path").alias("label"), F.create_map(F.lit("symbol_name"), F.col("lang"), F.lit("extractor"), F.lit("copy")).alias("metadata"))
    return handles.put(made)


DERIVED = f"""(select 'h_' || sha256('{{"content_sha256":"' || sha256(content) || '","content_type":"text/markdown","derivative_type":"' || t || '","index_state":"indexable","kind":"derivative","metadata":{{"extractor":"copy","symbol_name":"' || lang || '"}},"role":"artifact"}}') handle, content, t derivative_type, path as label, lang from (select *, (array{[*fixed.MATERIALIZERS, 'other']})[doc_id % 8 + 1] t from {FILES_SQL}))"""


@query(f"select label, handle, derivative_type from {DERIVED}")
def handle_ids(spark, sf):
    return derivatives(spark, sf).select("label", "handle", "derivative_type")


@query(f"""with m as (select source, list('{{"handle":"' || h.handle || '","kind":"file_ref","media_type":"' || h.media_type || '"}}' order by doc_id) l from documents d join {HANDLES_SQL} h on h.sha256 = sha256(d.text) group by source)
select source, 'hc_' || sha256('{{"derivative_type":"collection","kind":"collection","members":[' || array_to_string(l, ',') || '],"metadata":{{}},"role":"artifact"}}') handle, len(l) members from m""")
def collection_handles(spark, sf):
    members = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256")).join(corpus.file_handles(spark, sf).select("handle", "kind", "media_type", "sha256"), "sha256")
    return handles.put_collections(members, "source", "doc_id").select("source", "handle", F.size("members").cast("long").alias("members"))


@query(f"select source child, h.handle parent, 'contains' edge_type, cast(row_number() over (partition by source order by doc_id) - 1 as int) ordinal from documents d join {HANDLES_SQL} h on h.sha256 = sha256(d.text)")
def contains_edges(spark, sf):
    members = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256")).join(corpus.file_handles(spark, sf).select("handle", "kind", "media_type", "sha256"), "sha256")
    return handles.contains_edges(handles.put_collections(members, "source", "doc_id").withColumn("handle", F.col("source")))


@query(f"select handle child, 'hf_' || sha256(content) parent, 'derived_from' edge_type, 0 ordinal from {DERIVED}")
def derived_edges(spark, sf):
    return handles.derived_edges(derivatives(spark, sf).select("handle", F.array(x.file_handle("content")).alias("derived_from")))


def versions(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("handle"), F.col("event_type").alias("label"), F.col("event_id").alias("version"))


@query("select cast(user_id as varchar) handle, event_type as label, event_id as version from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def upsert_latest(spark, sf):
    return handles.latest(versions(spark, sf), ["handle"], "version")


@query("""with o as (select cast(user_id as varchar) handle, min(event_id) created_at, min(event_id) updated_at from events where event_id % 3 <> 0 group by 1), n as (select cast(user_id as varchar) handle, max(event_id) created_at, max(event_id) updated_at from events where event_id % 7 = 0 group by 1)
select coalesce(n.handle, o.handle) handle, coalesce(o.created_at, n.created_at) created_at, coalesce(n.updated_at, o.updated_at) updated_at from n full join o on n.handle = o.handle""")
def upsert_merge(spark, sf):
    v = versions(spark, sf)
    of = lambda rows, pick: rows.groupBy("handle").agg(pick("version").alias("created_at"), pick("version").alias("updated_at"))
    return handles.upsert(of(v.filter("version % 3 <> 0"), F.min), of(v.filter("version % 7 = 0"), F.max), ["handle"])


@query("select user_id child, event_type edge_type, max(event_id) version from events group by all")
def edges_latest(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("child"), "event_type", F.col("event_id").alias("version")).withColumnRenamed("event_type", "edge_type")
    return handles.latest(rows, ["child", "edge_type"], "version")


@query(f"select doc_id, substr(text, 1, 300) as content, cast(least(length(text), 300) as int) returned_chars, length(text) > 300 truncated from documents")
def bounded_read(spark, sf):
    return handles.bounded(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), 300)


@query("select axis, coalesce(nullif(value, ''), '<missing>') as value, count(*) n from (" + " union all ".join(f"select '{a}' axis, {a} as value from {HANDLES_SQL}" for a in handles.PROFILED) + ") group by all")
def collection_profile(spark, sf):
    return handles.profile(corpus.file_handles(spark, sf))


@query(f"select handle, path from {HANDLES_SQL} where media_type = 'text/html' and regexp_matches(path, '^src1.*/.*[13579]\\.html$')")
def collection_filter(spark, sf):
    return handles.filtered(corpus.file_handles(spark, sf), path_glob="src1*/*[13579].html", media_type="text/html").select("handle", "path")


@query(f"select count(*) filter (m) members, count(*) filter (not m) skipped, 'text/html' as types, count(*) filter (m) html from (select regexp_matches(path, '^src1.*/.*[13579]\\.html$') and media_type = 'text/html' m from {HANDLES_SQL})")
def collection_filter_counts(spark, sf):
    made = handles.filter_counts(corpus.file_handles(spark, sf), path_glob="src1*/*[13579].html", media_type="text/html")
    return made.select("members", "skipped", F.array_join(F.map_keys("media_types"), ",").alias("types"), F.col("media_types")["text/html"].alias("html"))


@query(f"select handle from {HANDLES_SQL} where kind in ('file_ref', 'index') and index_state = 'indexable'")
def contract_match(spark, sf):
    return corpus.file_handles(spark, sf).filter(handles.HandleContract(kinds=("file_ref", "index"), index_states=("indexable",)).matches()).select("handle")


# snapshots


def snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus, each without a tenth of the files; the later one has some renamed."""
    f = corpus.files(spark, sf)
    moved = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return sync.snapshot(f.filter("doc_id % 10 <> 3")), sync.snapshot(f.filter("doc_id % 10 <> 7").withColumn("path", moved))


SNAPSHOTS = f"o as (select sha256(content) sha256, list_sort(list(path)) paths from {FILES_SQL} where doc_id % 10 <> 3 group by 1), n as (select sha256(content) sha256, list_sort(list(case when doc_id % 11 = 0 then 'moved/' || path else path end)) paths from {FILES_SQL} where doc_id % 10 <> 7 group by 1), c as (select coalesce(o.sha256, n.sha256) sha256, case when o.sha256 is null then 'added' when n.sha256 is null then 'deleted' when o.paths <> n.paths then 'modified' else 'unchanged' end change from o full join n on o.sha256 = n.sha256)"


@query(f"select sha256(content) sha256, max(octet_length(encode(content))) size_bytes, array_to_string(list_sort(list(path)), '|') paths from {FILES_SQL} group by 1")
def dup_groups(spark, sf):
    return sync.snapshot(corpus.files(spark, sf)).select("sha256", "size_bytes", F.array_join("paths", "|").alias("paths"))


@query(f"with {SNAPSHOTS} select * from c")
def sync_diff(spark, sf):
    return sync.difference(*snapshots(spark, sf))


@query(f"with {SNAPSHOTS} select sha256 from c where change = 'added'")
def sync_added(spark, sf):
    return sync.difference(*snapshots(spark, sf)).filter("change = 'added'").select("sha256")


@query(f"with {SNAPSHOTS} select sha256 from c where change = 'deleted'")
def sync_deleted(spark, sf):
    return sync.difference(*snapshots(spark, sf)).filter("change = 'deleted'").select("sha256")


@query(f"with {SNAPSHOTS} select sha256 from c where change = 'modified'")
def sync_modified(spark, sf):
    return sync.difference(*snapshots(spark, sf)).filter("change = 'modified'").select("sha256")


@query(f"with {SNAPSHOTS} select {', '.join(f"count(*) filter (change = '{k}') {k}" for k in ('added', 'modified', 'deleted', 'unchanged'))} from c")
def sync_counts(spark, sf):
    return sync.change_counts(sync.difference(*snapshots(spark, sf)))


@query(f"with {SNAPSHOTS} select 'run' run_id, sha256, change from c where change <> 'unchanged'")
def sync_audit(spark, sf):
    return sync.audit(sync.difference(*snapshots(spark, sf)), "run")


@query(f"""with s as (select path, substr(sha256(content), 1, 16) hash from {FILES_SQL} where doc_id % 10 <> 3), n as (select path, substr(sha256(case when doc_id % 9 = 0 then content || '!' else content end), 1, 16) hash from {FILES_SQL} where doc_id % 10 <> 7)
select coalesce(n.path, s.path) path, case when n.hash is null then 'deleted' when s.hash is null then 'added' else 'changed' end change from n full join s on n.path = s.path where n.hash is distinct from s.hash""")
def changed_files(spark, sf):
    f = corpus.files(spark, sf)
    hashed = lambda rows, content: rows.select("path", F.substring(F.sha2(content, 256), 1, 16).alias("hash"))
    return sync.changed_files(hashed(f.filter("doc_id % 10 <> 7"), F.when(F.col("doc_id") % 9 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))), hashed(f.filter("doc_id % 10 <> 3"), F.col("content")))


@query(f"select path, case when doc_id % 10 <> 7 then 'active' else 'missing' end status from {FILES_SQL}")
def path_status(spark, sf):
    f = corpus.files(spark, sf).select("doc_id", F.sha2("content", 256).alias("sha256"), "path")
    return sync.path_status(f.drop("doc_id"), f.filter("doc_id % 10 <> 7").drop("doc_id")).select("path", "status")


@query("select doc_id from documents where doc_id % 10 = 7")
def stale_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return sync.stale(d, d.filter("doc_id % 10 <> 7"), "doc_id")


@query(f"""select what, value, count(*) n from (select 'handles' what, 'all' as value from {HANDLES_SQL} {' '.join(f"union all select 'by_{a}', coalesce({a}, '<none>') from {HANDLES_SQL}" for a in sync.SUMMARY)}
 union all select 'edges', 'derived_from' from documents union all select 'paths', case when doc_id % 10 <> 7 then 'active' else 'missing' end from documents union all select 'chunks', 'all' from documents) group by all""")
def summary_counts(spark, sf):
    return sync.summary(corpus.file_handles(spark, sf), derived_edges(spark, sf), path_status(spark, sf), corpus.chunks(spark, sf))


@query(f"""with g as (select * from (select distinct 'hf_' || sha256(content) handle from {FILES_SQL}) where handle not in (select 'hf_' || sha256(content) from {FILES_SQL} where doc_id % 10 <> 7))
select 'handle' what, handle as key from g union all select distinct 'edge', d.handle || '>hf_' || sha256(content) from {DERIVED} d join g on g.handle = 'hf_' || sha256(content) union all select 'path', path from {FILES_SQL} join g on handle = 'hf_' || sha256(content)""")
def deleted_cascade(spark, sf):
    """What goes with the contents of which no file is left."""
    f = corpus.files(spark, sf)
    own = f.select("doc_id", x.file_handle("content").alias("handle"), "path")
    edges = derivatives(spark, sf).select(F.col("handle").alias("child"), F.concat(F.lit("hf_"), "sha256").alias("parent"))
    return sync.cascade(corpus.file_handles(spark, sf), edges, own.select("handle", "path"), own.filter("doc_id % 10 <> 7").select("handle").distinct())


@query("select count(distinct source) partitions, count(*) files, count(*) chunks from documents")
def partition_totals(spark, sf):
    return sync.totals(corpus.files(spark, sf).select(x.partition_key("path").alias("partition_key"), "path"))


@query("select user_id, ts, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def harvested_newest(spark, sf):
    return sync.harvested(table(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", "ts")


# graph

ADJACENT = f"adj as (select subject node, verb, object as next, pos, 0 back from {TRIPLES_SQL} union all select object, verb, subject, pos, 1 from {TRIPLES_SQL} where bidirectional)"


@query(f"with {ADJACENT} select node, verb, next, pos, back from adj")
def adjacency(spark, sf):
    return graph.adjacency(corpus.triples(spark, sf)).drop("source")


def reached_sql(start: str, depth: int, where: str) -> str:
    return f"with recursive {ADJACENT}, r as (select '{start}' node, -1 as depth union select next, r.depth + 1 from r join adj on adj.node = r.node where r.depth < {depth - 1} {where}) select node, min(depth) as depth, round(1.0 / (min(depth) + 1), 6) score from r where node <> '{start}' group by node"


@query(reached_sql("region:1", 3, ""))
def bfs_depths(spark, sf):
    return graph.traverse(graph.adjacency(corpus.triples(spark, sf)), "region:1").select("node", "depth", F.round("score", 6).alias("score"))


@query(reached_sql("order:1", 4, "and verb in ('placed_by', 'lives_in')"))
def bfs_verb_filter(spark, sf):
    return graph.traverse(graph.adjacency(corpus.triples(spark, sf)), "order:1", 4, ["placed_by", "lives_in"]).select("node", "depth", F.round("score", 6).alias("score"))


def scopes(spark, sf) -> DataFrame:
    """Regions delegate to their nations, one root delegates to the regions."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("r"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("n"))
    none = F.array().cast("array<string>")
    leaves = n.select(F.col("n").alias("index_path"), none.alias("delegates"), F.lit(True).alias("has_vectors"))
    regions = n.groupBy("r").agg(F.collect_list("n").alias("delegates")).select(F.col("r").alias("index_path"), "delegates", (F.col("r") == "r1").alias("has_vectors"))
    return leaves.unionByName(regions).unionByName(regions.agg(F.collect_list("index_path").alias("delegates")).select(F.lit("root").alias("index_path"), "delegates", F.lit(False).alias("has_vectors")))


@query("select 'n' || n_nationkey index_path from nation union all select 'r1'")
def scope_leaves(spark, sf):
    return graph.scope_leaves(scopes(spark, sf), "root")


@query(f"select path, case when starts_with(path, 'src1/') or starts_with(path, 'src2/') then string_split(path, '/')[1] else '' end index_path from {FILES_SQL}")
def nearest_index(spark, sf):
    return graph.nearest_index(corpus.files(spark, sf).select("path"), spark.createDataFrame([("",), ("src1",), ("src2",)], "index_path string"))


def nodes(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("class").alias("kind"), F.col("n_name").alias("label"), F.lit("a/n").alias("path"), F.col("n_nationkey").cast("long").alias("pos"))
    return n.unionByName(table(spark, sf, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")), F.lit("module"), F.col("r_name"), F.lit("a/r"), F.col("r_regionkey").cast("long") + 100).toDF(*n.columns))


@query(f"""select 0 part, cast(n_nationkey as bigint) pos, '    nation_' || n_nationkey || '["' || n_name || '"]' line from nation union all select 0, r_regionkey + 100, '    region_' || r_regionkey || '[["' || r_name || '"]]' from region
 union all select 1, pos, '    ' || replace(subject, ':', '_') || ' <-->|"in"| ' || replace(object, ':', '_') from {TRIPLES_SQL} where verb = 'in'""")
def mermaid_edges(spark, sf):
    return graph.mermaid_lines(nodes(spark, sf), corpus.triples(spark, sf))


@query(f"select subject, verb, object from {TRIPLES_SQL} where verb = 'in'")
def known_edges(spark, sf):
    return graph.known_edges(corpus.triples(spark, sf), nodes(spark, sf)).select("subject", "verb", "object")


# extraction


@query(f"select doc_id, {strip('text')} || chr(10) as markdown from documents")
def plaintext_markdown(spark, sf):
    return table(spark, sf, "documents").select("doc_id", plain.plaintext_markdown("text").alias("markdown"))


@query()
def html_to_markdown(spark, sf):
    return html.markdown(table(spark, sf, "pages").select("page_id", "html"))


PRICE_SQL = "cast(cast(p_retailprice as decimal(12, 2)) as varchar)"


@query(f"select p_partkey, 1 table_index, p_type caption, 'Size|Price' header, p_size || '|' || {PRICE_SQL} || '/' || '1,000|no' cells, '| Size | Price |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_size || ' | ' || {PRICE_SQL} || ' |' || chr(10) || '| 1,000 | no |' || chr(10) as markdown from part")
def html_tables(spark, sf):
    found = html.tables(corpus.part_pages(spark, sf))
    return found.select("p_partkey", "table_index", "caption", F.array_join("header", "|").alias("header"), F.array_join(F.transform("rows_raw", lambda r: F.array_join(r, "|")), "/").alias("cells"), "markdown")


@query("select p_partkey, 1 figure_index, p_partkey || '.png' src, p_name alt, p_brand caption, '![' || p_name || '](' || p_partkey || '.png)' || chr(10) || chr(10) || p_brand || chr(10) as markdown from part")
def html_figures(spark, sf):
    return html.figures(corpus.part_pages(spark, sf))


@query("select p_partkey, 1 image_index, p_partkey || '.png' src, 'https://h/a/' || p_partkey || '.png' resolved_src, p_name alt from part")
def html_images(spark, sf):
    return html.images(corpus.part_pages(spark, sf), base_url="https://h/a/b").select("p_partkey", "image_index", "src", "resolved_src", "alt")


@query(f"""select p_partkey, concat_ws(chr(10) || chr(10), 't', '# Part ' || p_partkey, 'A **' || p_brand || '** of *' || p_type || '* [here](/p' || p_partkey || ').', '- one' || chr(10) || '  1. inner' || chr(10) || '- two', '> quoted', '```' || chr(10) || 'x  = 1' || chr(10) || '```',
 '| Size | Price |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_size || ' | ' || {PRICE_SQL} || ' |' || chr(10) || '| 1,000 | no |', '![' || p_name || '](' || p_partkey || '.png)', p_brand) || chr(10) as markdown from part""")
def html_markdown_of_parts(spark, sf):
    return html.markdown(corpus.part_pages(spark, sf))


@query(r"""with c as (select o_orderpriority as tab, 0 col, cast(o_orderkey as varchar) as text from orders union all select o_orderpriority, 1, cast(o_custkey as varchar) || '.5' from orders union all select o_orderpriority, 2, case when o_orderkey % 2 = 0 then 'yes' else 'FALSE' end from orders union all select o_orderpriority, 3, o_orderstatus from orders union all select o_orderpriority, 4, '  ' from orders)
select tab, col, case when count(*) filter (trim(text) <> '') = 0 then 'string' when bool_and(regexp_full_match(replace(trim(text), ',', ''), '[-+]?\d+')) filter (trim(text) <> '') then 'integer' when bool_and(regexp_full_match(replace(trim(text), ',', ''), '[-+]?(?:\d+\.\d*|\d*\.\d+|\d+)(?:[eE][-+]?\d+)?')) filter (trim(text) <> '') then 'float' when bool_and(lower(trim(text)) in ('true', 'false', 'yes', 'no')) filter (trim(text) <> '') then 'boolean' else 'string' end as type from c group by all""")
def table_type_inference(spark, sf):
    o = table(spark, sf, "orders")
    texts = F.array(F.col("o_orderkey").cast("string"), F.concat(F.col("o_custkey").cast("string"), F.lit(".5")), F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("FALSE"), F.col("o_orderstatus"), F.lit("  "))
    return o.select(F.col("o_orderpriority").alias("tab"), F.posexplode(texts).alias("col", "text")).groupBy("tab", "col").agg(html.column_type(F.col("text")).alias("type"))


@query("select o_orderkey, o_orderkey as i, cast(o_orderkey as double) + 0.5 f, o_orderkey % 2 = 0 b from orders")
def cell_coercion(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    value = lambda text, kind: html.coerced(text, F.lit(kind))[kind]
    key = F.col("o_orderkey").cast("string")
    return o.select("o_orderkey", value(F.concat(F.lit(" "), key), "integer").alias("i"), value(F.concat(key, F.lit(".5")), "float").alias("f"), value(F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("no"), "boolean").alias("b"))


@query("select doc_id, cast(k as int) reference_index, '- [' || k || '] ' || line || chr(10) reference from (select doc_id, unnest(range(1, len(l) + 1)) k, unnest(l) line from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda q: " + strip("q") + "), lambda q: q <> '') l from documents))")
def references(spark, sf):
    """Each document's lines as a bibliography."""
    lines = F.filter(F.transform(F.split("text", "\n"), x.strip), lambda q: q != "")
    bullets = F.array_join(F.transform(lines, lambda q, i: F.concat(F.lit("- ["), (i + 1).cast("string"), F.lit("] "), q)), "\n")
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("# Paper\n\n## References\n\n"), bullets).alias("text"))
    return plain.references(docs, keep_text=False)


@query("select p_partkey, 'f' || p_partkey symbol_name, 'function' symbol_kind, 2 start_line, 4 end_line, 'function f' || p_partkey || '(a) {' || chr(10) || '  if (a) { b(); }' || chr(10) || '}' || chr(10) as content from part union all select p_partkey, 'K', 'class', 5, 5, 'export class K {}' || chr(10) from part")
def js_symbols(spark, sf):
    code = F.concat(F.lit("// head\nfunction f"), F.col("p_partkey").cast("string"), F.lit("(a) {\n  if (a) { b(); }\n}\nexport class K {}\n"))
    return plain.js_symbols(table(spark, sf, "part").select("p_partkey", code.alias("text"))).drop("text")


@query("select p_partkey, 1 rule_index, '.c' || p_partkey selector, 2 start_line, 4 end_line, '.c' || p_partkey || ' {' || chr(10) || '  color: red;' || chr(10) || '}' || chr(10) as content from part")
def css_rules(spark, sf):
    css = F.concat(F.lit("/* { */\n.c"), F.col("p_partkey").cast("string"), F.lit(" {\n  color: red;\n}\n"))
    return plain.css_rules(table(spark, sf, "part").select("p_partkey", css.alias("text"))).drop("text")


# units and calls


@query(f"select path, path unit_id, 'module' kind, cast(len(string_split(rtrim(content, chr(10)), chr(10))) - 1 as int) end_line from {FILES_SQL} where not ends_with(path, '.py')")
def fallback_units(spark, sf):
    other = corpus.files(spark, sf).filter(~F.col("path").endswith(".py"))
    return units.parsed_units(other.withColumn("content", F.regexp_replace("content", r"\n+$", ""))).select("path", "unit_id", "kind", "end_line")


@query("""select 'm' || p_partkey || '.py' path, 'm' || p_partkey unit_id, 'module' kind, 0 start_line, 7 end_line, cast(null as varchar) calls from part union all select 'm' || p_partkey || '.py', 'm' || p_partkey || '.K', 'class', 2, 4, '[]' from part
 union all select 'm' || p_partkey || '.py', 'm' || p_partkey || '.K.m', 'method', 3, 4, '[{"raw":"f' || p_partkey || '","resolved_unit_id":"m' || p_partkey || '.f' || p_partkey || '"}]' from part
 union all select 'm' || p_partkey || '.py', 'm' || p_partkey || '.f' || p_partkey, 'function', 6, 7, '[{"raw":"os.path.join","resolved_unit_id":"os.path.join"}]' from part""")
def python_units(spark, sf):
    """A module of one class and one function per part."""
    code = F.concat(F.lit("import os\n\nclass K(Base):\n    def m(self):\n        return f"), F.col("p_partkey").cast("string"), F.lit("()\n\ndef f"), F.col("p_partkey").cast("string"), F.lit("(a, b=1):\n    return os.path.join(a)\n"))
    made = units.parsed_units(table(spark, sf, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), code.alias("content")), resolve=True)
    return made.select("path", "unit_id", "kind", "start_line", "end_line", F.to_json("metadata.calls_made").alias("calls"))


@query("""select p_partkey || '.py' path, raw, case raw when 'helper' then 'lib.helper' when 'np.dot' then 'numpy.dot' when 'self.run' then 'm.K.run' when 'K.run' then 'm.K.run' when 'twice' then null end resolved_unit_id from part, (select unnest(['helper', 'np.dot', 'self.run', 'K.run', 'twice', 'x.y.nothing']) raw)""")
def call_resolution(spark, sf):
    """A file per part with the same names: an import, an alias, a method, and a name that two units have."""
    paths = table(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    rows = lambda schema, *values: paths.select("path", F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(schema, row, strict=True)]) for row in values])))
    own = rows(("unit_id", "name", "parent_unit_id", "kind"), ("m.K", "K", "m", "class"), ("m.K.run", "run", "m.K", "method"), ("m.A.twice", "twice", "m.A", "method"), ("m.B.twice", "twice", "m.B", "method"))
    names = units.resolution_map(own, rows(("local", "qualified"), ("helper", "lib.helper"), ("np", "numpy")))
    return units.resolved_calls(rows(("raw",), ("helper",), ("np.dot",), ("self.run",), ("K.run",), ("twice",), ("x.y.nothing",)), names)


@query("select doc_id, coalesce(terms, '') terms from documents left join (select doc_id, string_agg(w, ' ' order by i) terms from (select doc_id, w, min(i) i from (select doc_id, unnest(range(1, len(l) + 1)) i, unnest(l) w from (select doc_id, string_split(text, ' ') l from documents)) group by all) group by doc_id) using (doc_id)")
def ordered_distinct(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("terms"))


@query("select subject, verb, object, case when s = 0 then 'src' else '_root' end partition_key from (select 'src.m' || c_nationkey || '.f' || c_custkey subject, 'calls' verb, 'x' as object, 0 s from customer union all select 'other.g' || s_suppkey, 'calls', 'y', 1 from supplier)")
def triple_partitions(spark, sf):
    made = lambda rows, subject, target: rows.select(subject.alias("subject"), F.lit("calls").alias("verb"), F.lit(target).alias("object"))
    t = made(table(spark, sf, "customer"), F.concat(F.lit("src.m"), F.col("c_nationkey").cast("string"), F.lit(".f"), F.col("c_custkey").cast("string")), "x").unionByName(made(table(spark, sf, "supplier"), F.concat(F.lit("other.g"), F.col("s_suppkey").cast("string")), "y"))
    modules = table(spark, sf, "nation").select(F.concat(F.lit("src.m"), F.col("n_nationkey").cast("string")).alias("unit_id"), F.concat(F.lit("src/m"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), F.lit("module").alias("kind"))
    return units.triple_partitions(t, modules)


# materialising, hints, streaming


@query(f"select derivative_type, count(*) n, derivative_type = 'other' skipped from {DERIVED} group by all")
def materialize_dispatch(spark, sf):
    return materialize.counts(derivatives(spark, sf))


@query(f"select 'symbol_' || handle id, handle source_handle, lang symbol_name, 'symbol' symbol_kind from {DERIVED} where derivative_type = 'code_symbol'")
def materialize_symbols(spark, sf):
    return materialize.dispatch(derivatives(spark, sf))["code_graph"].drop("payload")


def registered(spark, sf, name: str) -> DataFrame:
    return materialize.dispatch(derivatives(spark, sf))[name].drop("payload")


@query(f"select 'table_' || handle id, handle source_handle, '' caption from {DERIVED} where derivative_type = 'table'")
def materialize_tables(spark, sf):
    return registered(spark, sf, "table_store")


@query(f"select 'figure_' || handle id, handle source_handle, '' src, '' caption from {DERIVED} where derivative_type = 'figure'")
def materialize_figures(spark, sf):
    return registered(spark, sf, "figure_index")


@query(f"select 'image_' || handle id, handle source_handle, '' src from {DERIVED} where derivative_type = 'image'")
def materialize_images(spark, sf):
    return registered(spark, sf, "image_registry")


@query(f"select 'reference_' || handle id, handle source_handle from {DERIVED} where derivative_type = 'reference'")
def materialize_references(spark, sf):
    return registered(spark, sf, "reference_graph")


@query(f"select 'style_' || handle id, handle source_handle, '' selector from {DERIVED} where derivative_type = 'style_rule'")
def materialize_styles(spark, sf):
    return registered(spark, sf, "style_rule_index")


def materialized_sql(name: str, parts: str) -> str:
    """SQL of the chunks of extracted Markdown; parts: SQL of greedy packing over (doc_id, text)."""
    return f"select 'chunk_' || handle || '_{name}_' || ordinal chunk_id, label path, handle source_handle, '{name}' materializer, ordinal, p.content from ({parts}) p join {DERIVED} d on d.label = p.doc_id"


MARKDOWN = f"(select label doc_id, content as text from {DERIVED} where derivative_type = 'extracted_markdown')"


@query(materialized_sql("paragraph_chunks", packed(numbered(rf"string_split_regex({normal('text')}, '\n\s*\n')", MARKDOWN), 2000, "\n\n", "text/paragraph", "paragraph")))
def materialize_paragraphs(spark, sf):
    return materialize.dispatch(derivatives(spark, sf))["paragraph_chunks"]


@query(materialized_sql("sentence_chunks", packed(numbered(rf"string_split_regex(regexp_replace(replace({normal('text')}, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))", MARKDOWN), 700, " ", "text/sentence", "sentence")))
def materialize_sentences(spark, sf):
    return materialize.dispatch(derivatives(spark, sf), {"extracted_markdown": ["sentence_chunks"]}, 700)["sentence_chunks"]


@query(f"select 'chunk_' || handle || '_full_text_chunk_0' chunk_id, label path, handle source_handle, 'full_text_chunk' materializer, 0 ordinal, {normal('content')} as content from {DERIVED} where derivative_type = 'extracted_markdown' and {strip('content')} <> ''")
def materialize_chunks(spark, sf):
    return materialize.dispatch(derivatives(spark, sf), {"extracted_markdown": ["full_text_chunk"]})["full_text_chunk"]


@query("select event_id id, case when event_id % 5 = 0 or event_id = 1 then 'deleted' else 'active' end status from events union all select max(event_id) + 1, 'active' from events")
def hint_log(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 5 == 0, "deleted").otherwise("active").alias("status"), F.lit("t0").alias("created_at"), F.lit("t0").alias("updated_at"), F.lit("user").alias("source"))
    return hints.add(hints.delete(log, 1, "t1"), " new ", "t2").select("id", "status")


@query("select date_trunc('hour', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def event_windows(spark, sf):
    return ingest.event_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4))
