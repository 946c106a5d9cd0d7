import hashlib
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph, handles, hints, materialize, sync
from marlstone.plans import registry, schemas
from marlstone.plans.config import ChunkingConfig, Config, SearchConfig
from marlstone.sources import files, store
from marlstone.streaming import ingest

TRIPLES = "subject string, verb string, object string, source string, bidirectional boolean, pos long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_snapshot_differences(spark):
    def snap(**content):
        return sync.snapshot(spark.createDataFrame([(k.replace("_", "."), v) for k, v in content.items()], "path string, content string"))

    def diff(old, new):
        got = {}
        for r in sync.difference(old, new).collect():
            got.setdefault(r.change, set()).add(r.sha256)
        return got

    none = snap(a_txt="x").limit(0)
    one, two, three = snap(a_txt="alpha"), snap(a_txt="alpha changed", b_txt="beta"), snap(b_txt="beta")
    assert diff(none, one) == {"added": {sha("alpha")}}
    assert diff(one, one) == {"unchanged": {sha("alpha")}}
    assert diff(one, two) == {"added": {sha("alpha changed"), sha("beta")}, "deleted": {sha("alpha")}}
    assert diff(two, three) == {"deleted": {sha("alpha changed")}, "unchanged": {sha("beta")}}
    same = snap(a_txt="same", b_txt="same")
    assert [tuple(r.paths) for r in same.collect()] == [("a.txt", "b.txt")]
    assert diff(snap(a_txt="same"), same) == {"modified": {sha("same")}}
    assert sync.change_counts(sync.difference(one, two)).first().asDict() == {"added": 2, "modified": 0, "deleted": 1, "unchanged": 0}


def test_updates_keep_other_files_and_drop_deleted(spark):
    old = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "path string, hash string")
    new = spark.createDataFrame([("a", "h1"), ("b", "h9"), ("d", "h4")], "path string, hash string")
    changed = sync.changed_files(new, old)
    assert {r.path: r.change for r in changed.collect()} == {"b": "changed", "c": "deleted", "d": "added"}
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, v int")
    merged = sync.merge_partition(rows, spark.createDataFrame([("b", 2), ("d", 2)], "path string, v int"), changed)
    assert sorted(map(tuple, merged.collect())) == [("a", 1), ("b", 2), ("d", 2)]


def test_handles_edges_and_reading(spark):
    refs = handles.file_refs(spark.createDataFrame([("a.html", "one"), ("b.pdf", "two"), ("c.html", "one")], "path string, content string"))
    rows = {r.handle: r for r in refs.collect()}
    assert len(rows) == 2 and rows[f"hf_{sha('one')}"].path == "c.html" and rows[f"hf_{sha('two')}"].index_state == "raw"
    members = refs.withColumns({"by": F.lit(1), "o": F.when(F.col("path") == "b.pdf", 0).otherwise(1)})
    collections = handles.put_collections(members, "by", "o")
    again = handles.put_collections(members.repartition(5), "by", "o")
    name = collections.first().handle
    assert name == again.first().handle and name.startswith("hc_")
    edges = handles.contains_edges(collections)
    assert [(r.parent, r.ordinal) for r in edges.orderBy("ordinal").collect()] == [(f"hf_{sha('two')}", 0), (f"hf_{sha('one')}", 1)]
    every = refs.select("handle", "kind").unionByName(collections.select("handle", F.lit("collection").alias("kind")))
    payloads = spark.createDataFrame([(name, "[]")], "handle string, content string")
    got = handles.read(every, payloads, edges, name).first()
    assert got.content == "[]" and got.members == [f"hf_{sha('two')}", f"hf_{sha('one')}"]
    assert handles.parents(edges, name).count() == 2 and handles.children(edges, f"hf_{sha('one')}").count() == 1


def test_collections(spark):
    refs = handles.file_refs(spark.createDataFrame([("a.html", "1"), ("b.pdf", "2")], "path string, content string"))
    profile = {(r.axis, r.value): r.n for r in handles.profile(refs).collect()}
    assert profile["media_type", "text/html"] == profile["media_type", "application/pdf"] == 1 and profile["derivative_type", "<missing>"] == 2
    assert [r.path for r in handles.filtered(refs, media_type="text/html").collect()] == ["a.html"]
    assert handles.filtered(refs, path_glob="*.p?f", role="source").count() == 1 and handles.filtered(refs, most=1).count() == 1
    with pytest.raises(ValueError):
        handles.filtered(refs, most=0)
    with pytest.raises(ValueError):
        handles.sample(refs, 201, "handle")
    assert refs.filter(handles.HandleContract().matches()).count() == 2 and refs.filter(handles.HandleContract(media_types=("text/html",)).matches()).count() == 1


def test_upsert_keeps_creation(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, created_at int, updated_at int")
    new = spark.createDataFrame([("b", 2, 2), ("c", 2, 2)], "k string, created_at int, updated_at int")
    assert sorted(map(tuple, handles.upsert(old, new, ["k"]).collect())) == [("a", 1, 1), ("b", 1, 2), ("c", 2, 2)]


def walk(edges, start, depth):
    """First-found paths of a plain breadth-first search."""
    seen, queue = {start: (None, -1, [start])}, [start]
    for node in queue:
        _, d, path = seen[node]
        if d + 1 < depth:
            for _, back, verb, target in sorted((p, b, v, t) for n, v, t, p, b in edges if n == node):
                if target not in seen:
                    seen[target] = (verb, d + 1, [*path, target])
                    queue.append(target)
    return {k: v for k, v in seen.items() if k != start}


def test_traversal_equals_a_plain_search(spark):
    rng = random.Random(3)
    rows = [(f"n{rng.randrange(25)}", rng.choice("xy"), f"n{rng.randrange(25)}", "ast", rng.random() < 0.3, k) for k in range(60)]
    adjacent = graph.adjacency(spark.createDataFrame(rows, TRIPLES))
    edges = [(r.node, r.verb, r.next, r.pos, r.back) for r in adjacent.collect()]
    for depth in (0, 1, 2, 4):
        got = {r.node: (r.verb, r.depth, r.path) for r in graph.traverse(adjacent, "n0", depth).collect()}
        assert got == walk(edges, "n0", depth)
    only = {r.node for r in graph.traverse(adjacent, "n0", 20, verbs=["x"], sources=["ast"]).collect()}
    assert only == set(walk([e for e in edges if e[1] == "x"], "n0", 20))
    with pytest.raises(ValueError):
        graph.traverse(adjacent, "n0", 21)


def test_flowcharts(spark):
    nodes = spark.createDataFrame([("a.b", "class", 'A "x" [y]', "p/a", 1), ("c", "module", "c" * 70, "p/c", 2), ("q", "odd", "Q", "z", 3)], "id string, kind string, label string, path string, pos int")
    triples = spark.createDataFrame([("a.b", "uses", "c", "ast", True, 1), ("a.b", "uses", "q", "ast", False, 2), ("q", "x", "nowhere", "ast", False, 3)], TRIPLES)
    assert graph.mermaid(nodes, triples, "p/") == "graph LR\n    a_b[\"A 'x' (y)\"]\n    c[[\"" + "c" * 57 + '..."]]\n    a_b <-->|"uses"| c'
    assert graph.mermaid(nodes, triples).count("\n") == 5
    assert graph.mermaid(nodes.limit(0), triples) == "graph LR\n    empty[No graph data]"


def test_hints(spark):
    log = spark.createDataFrame([], hints.SCHEMA)
    for text in ("one", " two ", "three"):
        log = hints.add(log, text, "t0")
    log = hints.delete(log, 3, "t1")
    log = hints.add(log, "four", "t2")
    assert [(r.id, r.text, r.status, r.updated_at) for r in log.orderBy("id").collect()] == [(1, "one", "active", "t0"), (2, "two", "active", "t0"), (3, "three", "deleted", "t1"), (4, "four", "active", "t2")]
    assert hints.formatted(log).endswith("- [1] one\n- [2] two\n- [4] four")
    cleared = hints.clear(log, "t3")
    assert hints.active(cleared).count() == 0 and hints.formatted(cleared) == "" and cleared.filter("updated_at = 't3'").count() == 3
    with pytest.raises(ValueError):
        hints.add(log, " ", "t")
    with pytest.raises(KeyError):
        hints.delete(log, 99, "t")


def test_materialising(spark):
    made = handles.put(spark.createDataFrame([("alpha\n\nbeta", "text/markdown", "extracted_markdown", "a.txt", {}), ("{}", "application/json", "table", "t", {"caption": "C"}), ("def f(): pass\n", "text/x-code-python", "code_symbol", "s", {"symbol_name": "f", "symbol_kind": "function"}), ("x", "text/plain", "odd", "o", {})], "content string, media_type string, derivative_type string, label string, metadata map<string,string>"))
    tables = materialize.dispatch(made, most=8)
    assert [r.content for r in tables["paragraph_chunks"].orderBy("ordinal").collect()] == ["alpha\n", "beta\n"]
    assert tables["table_store"].first().caption == "C" and [r.symbol_name for r in tables["code_graph"].collect()] == ["f"]
    assert {r.derivative_type for r in materialize.counts(made).filter("skipped").collect()} == {"odd"}
    sections = spark.createDataFrame([("h", "text/markdown", "l", "# A\n\nAlpha\n\n## B\n\nBeta")], "handle string, media_type string, label string, content string")
    assert materialize.chunks(sections, "section_chunks").count() == 2
    with pytest.raises(ValueError):
        materialize.configured({"table": ["nothing"]})
    with pytest.raises(NotImplementedError):
        materialize.chunks(sections, "strided_chunks")
    index = materialize.synced_index(tables["paragraph_chunks"], made.limit(0).select("handle"))
    assert index.documents.count() == 0


def test_pipeline_of_files(spark, tmp_path):
    """Files to handles to Markdown to chunks, as one goes through the corpus."""
    (tmp_path / "a.txt").write_text("alpha\n\nbeta")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "c.html").write_text("<h1>Title</h1><script>bad()</script><p>Body</p>")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "d.txt").write_text("no")
    found = files.corpus(spark, str(tmp_path))
    assert [r.path for r in found.orderBy("path").collect()] == ["a.txt", "b.bin", "c.html"]
    refs = handles.file_refs(found.withColumn("content", files.text_content("content")))
    texts = refs.join(found.select("path", files.text_content("content").alias("content")), "path")
    derived = handles.put(materialize.extracted(texts))
    assert sorted(r.content for r in derived.collect()) == ["# Title\n\nBody\n", "alpha\n\nbeta"]
    assert materialize.chunks(derived, "paragraph_chunks", 8).count() == 4


def test_discovery(spark):
    rows = [("a.py", 5), ("b/c.md", 5), ("b/skip.md", 5), (".hidden/x.py", 5), ("d/e/f.txt", 5), ("big.py", 2_000_000), ("empty.py", 0), ("image.png", 5), ("Makefile", 5), ("b/keep.log.md", 5), ("build/x.py", 5)]
    f = spark.createDataFrame(rows, "path string, size_bytes long")
    paths = lambda **p: sorted(r.path for r in files.discover(f, **p).collect())
    assert paths() == ["Makefile", "a.py", "b/c.md", "b/keep.log.md", "b/skip.md", "build/x.py", "d/e/f.txt"]
    assert paths(delegates=["d"], rules={"": ["build/", "*.md"], "b": ["*.md", "!keep*"]}) == ["Makefile", "a.py", "b/keep.log.md"]
    assert "b/c.md" not in paths(rules={"": ["*.md"]}, inherit=True) and "b/c.md" in paths(rules={"": ["*.md"]})
    rules = files.IgnoreRules(["# no", "*.log", "!keep.log", "out/", "a/b*"])
    assert [rules.ignores(p, d) for p, d in (("x.log", False), ("keep.log", False), ("out", True), ("out", False), ("a/bc", False))] == [True, False, True, False, True]
    listed, counts = files.listed(f, "*.md", 2)
    assert listed.count() == 2 and counts == {"matched": 3, "returned": 2, "truncated": True}


def test_store_replaces_whole_tables(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "index"))
    assert s.read("state").count() == 0
    for hashes in (["h1", "h2"], ["h3"]):
        s.write("state", spark.createDataFrame([(h, h) for h in hashes], "path string, hash string"))
    assert [r.hash for r in s.read("state").collect()] == ["h3"]
    vectors = spark.createDataFrame([("a", "content", [1.0], "p"), ("b", "content", [2.0], "q")], "id string, kind string, embedding array<float>, partition_key string")
    s.write("vectors", vectors)
    assert [r.partition_key for r in s.partitions("vectors").collect()] == ["p", "q"]
    assert "PartitionFilters: [isnotnull(partition_key" in s.read("vectors").filter("partition_key = 'p'")._jdf.queryExecution().executedPlan().toString()
    s.vacuum()
    assert s.read("state").count() == 1
    s.cleanup()
    assert s.read("state").count() == 0


def test_streams_give_what_batches_give(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for k, names in enumerate((["a.txt", "b.txt"], ["c.txt"])):
        for n in names:
            (src / n).write_text("same" if n != "a.txt" else "alpha")
        ingest.ingest(ingest.file_stream(spark, str(src)), out, str(tmp_path / "check")).awaitTermination(60)
        assert ingest.current(spark, out).count() == 2
    assert {r.sha256 for r in ingest.current(spark, out).collect()} == {sha("alpha"), sha("same")}


def test_registry(tmp_path):
    for root, folder, body in (("one", "join", "a + b"), ("two", "join", "'shadowed'"), ("two", "other", "a")):
        (tmp_path / root / folder).mkdir(parents=True)
        (tmp_path / root / folder / "extension.py").write_text(f"from marlstone.plans.registry import operator\n@operator(name='{folder}')\ndef f(a: str, b: str = 'x') -> str:\n    return {body}\n")
    r = registry.default_registry(tmp_path / "one", tmp_path / "two", tmp_path / "none")
    assert r.names() == sorted([*(f.operator.name for f in registry.BUILT_IN), "join", "other"])
    assert r.call("add", {"a": 2, "b": 3}) == 5 and r.call("echo", '{"text": "hi"}') == "hi" and r.call("join", {"a": "q"}) == "qx"
    for arguments, error in (({"a": 1}, TypeError), ({"a": 1, "b": 2, "c": 3}, TypeError), ({"a": 1, "b": {1: 2}}, TypeError)):
        with pytest.raises(error):
            r.call("add", arguments)
    with pytest.raises(KeyError):
        r.call("nothing")
    with pytest.raises(ValueError):
        r.add(registry.echo)


def test_settings_and_schemas(spark):
    assert Config().search.top_k == 20
    with pytest.raises(ValueError):
        ChunkingConfig(max_tokens=256)
    with pytest.raises(ValueError):
        SearchConfig(bm25_scope="other")
    assert schemas.strict('{"queries": [], "intent": "code", "filters": {}}', "search_plan")["intent"] == "code"
    with pytest.raises(ValueError):
        schemas.strict('{"queries": [], "more": 1}', "search_plan")
    row = spark.createDataFrame([('{"facts":[{"subject":"s","predicate":"p","object":"o"}]}',), ("no",)], "t string").select(schemas.parsed("t", "rdf_extract").alias("v")).collect()
    assert row[0].v.facts[0].predicate == "p" and not row[1].v.facts
