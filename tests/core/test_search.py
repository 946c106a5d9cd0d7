import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as x
from marlstone.operators import fts, fusion, vector

ROWS = [
    ("c1", "alpha beta gamma. alpha"), ("c2", "alpha delta café"), ("c3", "beta gamma delta alpha"), ("c4", "Alpha cafe a/b path_x"), ("c5", "gamma delta beta alphabet"),
    ("c6", "one two three four five six seven alpha nine ten eleven beta"), ("c7", "zeta"), ("c8", "alpha alpha beta beta zeta eta theta"), ("c9", ""),
]


@pytest.fixture(scope="module")
def golden():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(content, id unindexed, tokenize=\"unicode61 tokenchars '_./-'\")")
    db.executemany("insert into t(id, content) values (?, ?)", ROWS)
    return lambda q: {i: s for i, s in db.execute("select id, bm25(t) from t where t match ?", (q,))}


@pytest.mark.parametrize("query", [
    "alpha", "gamma", '"gamma."', "cafe", "café", "alpha beta", "alpha AND delta", "alpha OR zeta", "alpha NOT beta", '"beta gamma"', "alph*", '"alpha bet" *', "alpha + beta", "(alpha OR zeta) AND beta",
    "zeta OR beta NOT delta", "NEAR(alpha beta, 2)", "NEAR(alpha beta)", "NEAR(alpha beta, 4)", "nothing", "beta NOT (delta OR zeta)", "ALPHA", '"a/b"', "path_x OR one", '"alpha alpha"',
])
def test_matches_equal_sqlite(spark, golden, query):
    index = fts.build_index(spark.createDataFrame(ROWS, "chunk_id string, content string"))
    got = {r.chunk_id: r.score for r in fts.matches(index, query).collect()}
    want = golden(query)
    assert got.keys() == want.keys()
    if "NEAR" not in query:
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want), (got, want)


def test_bad_queries_raise():
    for query in ("(alpha", "alpha )", "AND", "NEAR(a", "*"):
        with pytest.raises(ValueError):
            fts.parse(query)


def test_stored_index_skips_other_terms(spark, tmp_path):
    chunks = spark.createDataFrame(ROWS, "chunk_id string, content string")
    fts.write_index(fts.build_index(chunks), str(tmp_path / "index"))
    index = fts.read_index(spark, str(tmp_path / "index"))
    hits = fts.search(index, "alpha beta", 3)
    assert [r.chunk_id for r in hits.collect()] == [r.chunk_id for r in fts.search(fts.build_index(chunks), "alpha beta", 3).collect()]
    assert "PushedFilters: [Or(EqualTo(term,alpha),EqualTo(term,beta))]" in hits._jdf.queryExecution().executedPlan().toString()


def test_okapi_formula(spark):
    docs = [(k, t.lower().split()) for k, (_, t) in enumerate(ROWS) if t]
    n, mean = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = {w: sum(w in t for _, t in docs) for _, t in docs for w in t}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else low for w, v in idf.items()}
    want = {k: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in ("alpha", "beta", "beta")) for k, t in docs if {"alpha", "beta"} & set(t)}
    got = {r.id: r.score for r in fts.okapi(spark.createDataFrame(docs, "id int, tokens array<string>"), "alpha beta Beta", "id").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert fts.okapi_top(fts.okapi(spark.createDataFrame(docs, "id int, tokens array<string>"), "!!", "id"), 3, "id").count() == 0


def test_cosine(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, [-1.0, 0.0]), (5, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = [(r.vec_id, round(r.score, 6)) for r in vector.top_k(vectors, [3.0, 0.0], 10).collect()]
    assert got == [(1, 1.0), (3, 1.0), (5, 0.707107), (2, 0.0), (4, -1.0)]
    assert "TakeOrderedAndProject" in vector.top_k(vectors, [1.0, 0.0], 2)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        vector.cosine(vectors, [0.0, 0.0])


def test_fusion(spark):
    scores = spark.createDataFrame([("content", "a", 5.0), ("content", "b", 5.0), ("metadata", "a", 1.0), ("metadata", "c", 3.0), ("terms", "gone", 9.0), ("graph", "u", 2.0)], "modality string, id string, score double")
    chunks = spark.createDataFrame([("a", "u"), ("b", "v"), ("c", "u"), ("c", "u")], "chunk_id string, unit_id string")
    got = [(r.chunk_id, round(r.score, 4), r.source) for r in fusion.search(scores, chunks, 5).collect()]
    assert got == [("a", 0.5, "vector"), ("c", 0.4, "metadata"), ("b", 0.35, "vector")]
    assert fusion.search(scores.limit(0), chunks, 5).count() == 0
    with pytest.raises(ValueError):
        fusion.SearchWeights(-1, 1, 1, 1)
    with pytest.raises(ValueError):
        fusion.SearchWeights(0, 0, 0, 0)


def test_metadata_text(spark):
    m = spark.sql("select named_struct('name', 'f', 'qualified_name', 'm.f', 'kind', 'function', 'parent_name', null, 'parent_kind', null, 'parameters', array(), 'return_type', 'int', 'decorators', array('d'), 'docstring', 'Doc', 'visibility', 'public', 'cyclomatic_branch_count', 0, 'imports_used', array('os'), 'calls_made', array(named_struct('raw', 'g', 'resolved_unit_id', 'm.g'), named_struct('raw', 'h', 'resolved_unit_id', null))) m")
    assert m.select(x.metadata_text(F.col("m"))).first()[0].split("\n") == ["function f() -> int", "  qualified: m.f", "  visibility: public", "  decorators: d", "  calls: m.g, h", "  imports used: os", "  cyclomatic_branch_count: 0", "  docstring: Doc"]
