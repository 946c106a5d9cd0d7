import json

import pytest
from pyspark.sql import functions as F

from marlstone import cli
from marlstone.operators import embed, handles, passes, sync, units
from marlstone.operators.extract import html
from marlstone.plans.library import Library
from marlstone.sources import files
from marlstone.sources.store import Store


def test_steps_one_by_one(spark, tmp_path, capsys):
    root, target = tmp_path / "docs", str(tmp_path / "library")
    root.mkdir()
    (root / "a.txt").write_text("alpha\n\nbeta")
    (root / "b.bin").write_bytes(b"\x00\x01")
    run = lambda *a: (cli.main(list(a)), json.loads(capsys.readouterr().out))[1]
    assert run("sync", "sources", target, str(root)) == {"added": 2, "modified": 0, "deleted": 0, "unchanged": 0}
    assert run("sync", "extract", target) == {"added": 1, "skipped": 1, "deleted": 0}
    assert Library(spark, target).materialize(most=8) == {"chunks": 2, "indexed": 2}
    rows = {(r["what"], r["value"]): r["n"] for r in run("sync", "summary", target)}
    assert rows["handles", "all"] == 3 and rows["by_kind", "derivative"] == 1 and rows["paths", "active"] == 2
    (root / "a.txt").write_text("alpha changed")
    (root / "c.txt").write_text("gamma")
    done = run("sync", "run", target, str(root))
    assert done["sources"] == {"added": 2, "modified": 0, "deleted": 1, "unchanged": 1} and done["extract"] == {"added": 2, "skipped": 1, "deleted": 1}
    assert {r["content"] for r in cli.search(spark, target, "alpha OR beta OR gamma")} == {"alpha changed\n", "gamma\n"}
    assert run("sync", "run", target, str(root)) == {"sources": {"added": 0, "modified": 0, "deleted": 0, "unchanged": 3}}
    (root / "c.txt").unlink()
    run("sync", "run", target, str(root))
    assert {(r["what"], r["value"]): r["n"] for r in run("sync", "summary", target)}["paths", "missing"] == 2  # the old content of a.txt too
    assert [h["text"] for h in run("hints", "add", target, " be kind ")] == ["be kind"] and run("hints", "delete", target, "1") == [] and run("hints", "list", target) == []
    assert "pyspark" in run("doctor")
    assert cli.main(["cleanup", target]) == 0 and not (tmp_path / "library").exists()


def test_units_of_a_file_are_shown(tmp_path, capsys):
    (tmp_path / "m.py").write_text("def f():\n    return 1\n")
    assert cli.main(["units", str(tmp_path / "m.py")]) == 0
    assert [u["kind"] for u in json.loads(capsys.readouterr().out)] == ["module", "function"]


def test_tools_chunk_texts(spark, capsys):
    assert cli.main(["tools"]) == 0
    names = json.loads(capsys.readouterr().out)
    assert names == sorted(names) and {"add", "chunk_sections", "echo", "full_text_search"} <= set(names)
    assert cli.main(["tools", "chunk_sections", json.dumps({"text": "# A\n\nAlpha\n\n## B\n\nBeta"})]) == 0
    assert [c["section_path"] for c in json.loads(capsys.readouterr().out)] == [["A"], ["A", "B"]]


def test_deep_pages_and_large_images(spark):
    deep = "<div>" * 5000 + "text" + "</div>" * 5000
    lists = "<ul><li>x" * 1500 + "</li></ul>" * 1500
    assert html.to_markdown(deep) == "text\n" and html.to_markdown(lists).count("- x") == 1500
    assert html.to_markdown("<ul><li>a <b>b</b><ol><li>c</li><li>d</li></ol></li><li>e</li></ul>") == "- a **b**\n  1. c\n  2. d\n- e\n"
    pages = spark.createDataFrame([(1, "<img src='data:image/png;base64,QUJDRA=='><img src='data:image/png;base64,QUI='>")], "id int, html string")
    assert [(r.byte_count, r.base64, r.error) for r in html.images(pages, most=3).collect()] == [(4, None, "the image has more than 3 bytes"), (2, "QUI=", None)]


CODE = """import os
from lib import helper as h
class K(Base):
    def run(self):
        self.stop(); h(); os.path.join(1); twice()
    def stop(self):
        K.run(1); unknown()
class A:
    def twice(self): pass
class B:
    def twice(self): top()
def top():
    a.b.stop()
"""


def test_calls_resolve_alike_in_both_forms(spark):
    rows = [("p/m.py", CODE), ("p/n.py", "def top():\n    return top()\n"), ("x.txt", "text")]
    files_ = spark.createDataFrame(rows, "path string, content string")
    calls = lambda df: {r.unit_id: [(c.raw, c.resolved_unit_id) for c in r.metadata.calls_made or ()] for r in df.collect()}
    made, later = calls(units.parsed_units(files_, resolve=True)), calls(units.with_resolved_calls(units.parsed_units(files_)))
    assert made == later
    assert made["p.m.K.run"] == [("self.stop", "p.m.K.stop"), ("h", "lib.helper"), ("os.path.join", "os.path.join"), ("twice", None)]
    assert made["p.m.K.stop"] == [("K.run", "p.m.K.run"), ("unknown", None)] and made["p.m.top"] == [("a.b.stop", "p.m.K.stop")] and made["p.n.top"] == [("top", "p.n.top")]
    plan = units.with_resolved_calls(units.parsed_units(files_))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_passes_in_order(spark):
    rows = spark.createDataFrame([("m.py", "def f(): pass"), ("m.sql", "select 1"), ("t.txt", "words")], "path string, content string")
    one = lambda content, path: iter([(path, None, path, "query", 0, 0, content, {"name": path}, [], {}, None)])
    sql = passes.Pass("sql", lambda p: p.endswith(".sql"), lambda f: units.parsed_units(f, parsers={".sql": one}), order=20)
    found, chunks = passes.run(rows, [passes.REST, sql, passes.PYTHON])
    assert {(r.path, r.kind, r["pass"]) for r in found.collect()} == {("m.py", "module", "python"), ("m.py", "function", "python"), ("m.sql", "query", "sql"), ("t.txt", "module", "rest")}
    assert {r["pass"] for r in chunks.collect()} == {"python", "sql", "rest"}
    with pytest.raises(ValueError):
        passes.run(rows, [sql, sql])


def test_embedding(spark):
    texts = spark.createDataFrame([(1, "alpha beta alpha"), (2, "Alpha, beta; ALPHA"), (3, ""), (4, None)], "id int, text string")
    got = {r.id: r.embedding for r in embed.embedded(texts, dim=32).collect()}
    assert got[1] == got[2] and abs(sum(v * v for v in got[1]) - 1) < 1e-5 and got[3] == got[4] == [0.0] * 32
    sparse = {(r.id, r.place): r.value for r in embed.weights(texts, "id", dim=32).collect()}
    assert {k: round(v, 5) for k, v in enumerate(got[1]) if v} == {p: round(v, 5) for (i, p), v in sparse.items() if i == 1}
    sizes = lambda t: [[float(len(x))] * 3 for x in t]
    assert [list(r.embedding) for r in embed.with_embedder(texts, sizes, 3, batch=1).orderBy("id").collect()] == [[16.0] * 3, [18.0] * 3, [0.0] * 3, [0.0] * 3]
    with pytest.raises(ValueError):
        embed.with_embedder(texts, sizes, 3, batch=5000)
    halves = embed.packed(embed.embedded(texts, dim=32))
    assert {len(r.embedding) for r in halves.collect()} == {64}
    assert max(abs(a - b) for a, b in zip(embed.unpacked(halves).first().embedding, got[1], strict=True)) < 1e-3


def test_small_additions(spark, tmp_path):
    (tmp_path / "r" / "sub").mkdir(parents=True)
    (tmp_path / "r" / ".gitignore").write_text("*.log\n!keep.log\n")
    (tmp_path / "r" / "sub" / ".gitignore").write_text("x/\n")
    assert files.ignore_rules(spark, str(tmp_path / "r"), ["", "sub", "none"]) == {"": ["*.log", "!keep.log"], "sub": ["x/"]}
    members = spark.createDataFrame([("h1", "a.html", "text/html"), ("h2", "b.pdf", "application/pdf")], "handle string, path string, media_type string")
    row = handles.filter_counts(members, media_type="text/html").first()
    assert (row.members, row.skipped, row.media_types) == (1, 1, {"text/html": 1})
    assert handles.filter_counts(members, media_type="none").first().members == 0
    newest = handles.latest(spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "z")], "k int, v int, s string"), ["k"], "v")
    assert [tuple(r) for r in newest.collect()] == [(1, 5, "b")]
    store = Store(spark, str(tmp_path / "store"))
    store.save_scope("a", "all", ["b"])
    store.save_scope("a", "some", [], True)
    assert [tuple(r) for r in store.scope("a").collect()] == [("a", "some", [], True)]
    chunks = spark.createDataFrame([("p", "x"), ("p", "x"), ("q", "y")], "partition_key string, path string")
    assert tuple(sync.totals(chunks).first()) == (2, 2, 3)
    edges = spark.createDataFrame([("d", "f1"), ("c", "f1"), ("d", "f2")], "child string, parent string")
    known = spark.createDataFrame([("f1", "file_ref"), ("f2", "file_ref"), ("d", "derivative")], "handle string, kind string")
    gone = sync.cascade(known, edges, spark.createDataFrame([("f1", "one")], "handle string, path string"), known.filter(F.col("handle") == "f2"))
    assert {tuple(r) for r in gone.collect()} == {("handle", "f1"), ("edge", "d>f1"), ("edge", "c>f1"), ("path", "one")}
