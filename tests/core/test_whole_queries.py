import pytest

from marlstone.plans.queries import QUERIES


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Documents whose last words lie beyond 300 characters."""
    to = str(tmp_path_factory.mktemp("sf"))
    rows = [(k, "Filler " * 60 + f"who calls Tail{k}", "en", "s", 1) for k in range(1, 41)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    return to


def test_bm25_document_has_all_terms(spark, sf):
    got = {r.doc_id: r.terms for r in QUERIES["bm25_document"](spark, sf).collect()}
    assert got == {k: ["filler"] * 60 + ["who", "calls", f"tail{k}", "document", "en"] for k in range(1, 41)}


def test_late_words_are_listed_and_tell_the_intent(spark, sf):
    got = {r.doc_id: r.terms for r in QUERIES["ordered_distinct"](spark, sf).collect()}
    assert got == {k: f"Filler who calls Tail{k}" for k in range(1, 41)}
    assert {r.intent for r in QUERIES["intent_weights"](spark, sf).collect()} == {"structural"}


def test_names_of_calls_are_never_broadcast(spark, tmp_path):
    """Six calls and five names a file, which Spark counts as one row."""
    spark.range(50).selectExpr("id p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    made = QUERIES["call_resolution"](spark, str(tmp_path))
    assert "Broadcast" not in made._jdf.queryExecution().sparkPlan().toString()
    got = {(r.path, r.raw): r.resolved_unit_id for r in made.collect()}
    assert len(got) == made.count() == 300
    assert {got["7.py", raw] for raw in ("self.run", "K.run")} == {"m.K.run"} and got["7.py", "np.dot"] == "numpy.dot" and got["7.py", "twice"] is None
