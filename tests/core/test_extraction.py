import base64

import pytest
from pyspark.sql import functions as F

from marlstone.operators import units
from marlstone.operators.extract import html, text

PAGE = """<html><head><style>p{}</style><script>bad("<p>")</script></head><body><h1>T &amp; U</h1><p>One <b>two</b> <a href="/x">three</a><br>four</p>
<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><ol><li>x</li><li>y</li></ol><pre>code  here
 more</pre><blockquote><p>q</p></blockquote>
<table><caption>Cap</caption><tr><th>Year</th><th>Value</th></tr><tr><td>2024</td><td>1.5</td></tr></table>
<figure><img src="img.png" alt="Alt"><figcaption>Fig cap</figcaption></figure><img alt="none"><img src="data:image/png;base64,QUJD"></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id int, html string")


def test_markdown(pages):
    got = {r.page_id: r.markdown for r in html.markdown(pages).collect()}
    assert 2 not in got and got[3] == "\n"
    for part in ("# T & U\n", "One **two** [three](/x)  \nfour", "- a\n  - b\n- c\n", "1. x\n2. y\n", "```\ncode  here\n more\n```", "> q\n", "| Year | Value |\n| --- | --- |\n| 2024 | 1.5 |", "![Alt](img.png)"):
        assert part in got[1], part
    assert "bad" not in got[1] and "p{}" not in got[1]


def test_tables_and_types(spark, pages):
    tables = html.tables(pages)
    (t,) = tables.collect()
    assert (t.table_index, t.caption, t.header, t.rows_raw) == (1, "Cap", ["Year", "Value"], [["2024", "1.5"]])
    typed = html.typed_cells(html.cells(tables, "page_id", "table_index"), "page_id", "table_index")
    assert {(r.name, r.type, r.value.integer, r.value.float) for r in typed.collect()} == {("Year", "integer", 2024, None), ("Value", "float", None, 1.5)}
    cases = {"integer": ["1,234", " -5 ", ""], "float": ["1e3", "2", ".5", "1."], "boolean": ["yes", "FALSE"], "string": ["", " "], "string2": ["1", "x"], "string3": ["--1"]}
    rows = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k string, v string")
    got = {r.k: r.t for r in rows.groupBy("k").agg(html.column_type(F.col("v")).alias("t")).collect()}
    assert got == {k: k.rstrip("23") for k in cases}
    value = rows.filter("k = 'integer'").select("v", html.coerced(F.col("v"), F.lit("integer")).alias("c")).collect()
    assert {r.v: r.c.integer for r in value} == {"1,234": 1234, " -5 ": -5, "": None}


def test_figures_and_images(spark, pages):
    figures = [(r.figure_index, r.src, r.alt, r.caption, r.markdown) for r in html.figures(pages).orderBy("figure_index").collect()]
    assert figures[0] == (1, "img.png", "Alt", "Fig cap", "![Alt](img.png)\n\nFig cap\n") and figures[1] == (2, "", "none", "", "![none]()\n") and len(figures) == 3
    files = spark.createDataFrame([("https://h/img.png", bytearray(b"bytes"), "image/png")], "path string, content binary, media_type string")
    images = {r.image_index: r for r in html.with_files(html.images(pages, base_url="https://h/"), files).collect()}
    assert sorted(images) == [1, 3] and images[1].base64 == base64.b64encode(b"bytes").decode() and images[1].byte_count == 5
    assert images[3].base64 == "QUJD" and images[3].media_type == "image/png"


def test_references(spark):
    paper = "# Paper\nReferences to come\n\n## References\n\n- First ref\n  goes on\n\n[2] Second ref\n3) Third\nlast\n## Next\n- no\n"
    rows = spark.createDataFrame([(1, paper), (2, "nothing"), (3, "bibliography\nopen entry\n1. x"), (4, None)], "k int, text string")
    got = [(r.k, r.reference_index, r.reference) for r in text.references(rows).orderBy("k", "reference_index").collect()]
    assert got == [(1, 1, "- First ref\n  goes on\n"), (1, 2, "[2] Second ref\n"), (1, 3, "3) Third\nlast\n"), (3, 1, "open entry\n"), (3, 2, "1. x\n")]
    assert spark.createDataFrame([(" hello ",)], "t string").select(text.plaintext_markdown("t")).first()[0] == "hello\n"
    with pytest.raises(NotImplementedError):
        text.pdf_tables("x")


def test_js_and_css(spark):
    js = "export default function a() {\n  if (x) { y }\n}\nexport class B {\n}\nconst c = async (q) => {\n}\nlet d = function () {}\nasync function no() {}\nfunction open(\nexport default class No {}\n"
    got = [(r.symbol_name, r.symbol_kind, r.start_line, r.end_line) for r in text.js_symbols(spark.createDataFrame([(js,)], "text string")).orderBy("start_line").collect()]
    assert got == [("a", "function", 1, 3), ("B", "class", 4, 5), ("c", "function", 6, 7), ("d", "function", 8, 8), ("open", "function", 10, 11)]
    css = "/* { */\n\na,\nb { x: y }\n@media q {\n  .c {\n  }\n}\n.d\n{\n}\n"
    rows = spark.createDataFrame([(css,)], "text string")
    got = [(r.rule_index, r.selector, r.start_line, r.end_line) for r in text.css_rules(rows).orderBy("rule_index").collect()]
    assert got == [(1, "b", 4, 4), (2, "@media q", 5, 8), (3, "", 10, 11)]
    assert [r.selector for r in text.css_rules(rows, full_selector=True).orderBy("rule_index").collect()] == ["a, b", "@media q", ".d"]


CODE = '''import os
import numpy as np
from .lib import helper as h, other
from ..up import thing

class A(Base, x.Mixin):
    """Doc."""

    @property
    def run(self, a, *args, b: int = 2, **kw) -> str:
        def inner():
            hidden()
        if a and b or a:
            return h(np.dot(a), self.stop())

    def stop(self):
        pass

def free(q=1):
    return [other(i) for i in q] if q else A()

def broken_later(): return os.path.join("a")
'''


def test_python_units(spark):
    files = spark.createDataFrame([("pkg/sub/m.py", CODE), ("bad.py", "def ("), ("note.txt", "one\ntwo"), ("blank.py", " \n")], "path string, content string")
    parsed = units.parsed_units(files)
    rows = {r.unit_id: r for r in parsed.collect()}
    assert set(rows) == {"pkg.sub.m", "pkg.sub.m.A", "pkg.sub.m.A.run", "pkg.sub.m.A.stop", "pkg.sub.m.free", "pkg.sub.m.broken_later", "bad", "note.txt"}
    run = rows["pkg.sub.m.A.run"]
    assert (run.kind, run.parent_unit_id, run.start_line, run.end_line) == ("method", "pkg.sub.m.A", 8, 13)
    assert run.metadata.parameters == ["self", "a", "*args", "b: int = 2", "**kw"] and run.metadata.return_type == "str" and run.metadata.decorators == ["property"]
    assert run.metadata.cyclomatic_branch_count == 3 and [c.raw for c in run.metadata.calls_made] == ["h", "np.dot", "self.stop"]
    assert rows["pkg.sub.m.A"].metadata.docstring == "Doc." and rows["pkg.sub.m.A"].bases == ["Base", "x.Mixin"]
    assert rows["pkg.sub.m"].import_map == {"os": "os", "np": "numpy", "h": "pkg.sub.lib.helper", "other": "pkg.sub.lib.other", "thing": "pkg.up.thing"}
    assert rows["bad"].error and rows["note.txt"].kind == "module"
    resolved = {r.unit_id: {c.raw: c.resolved_unit_id for c in r.metadata.calls_made or []} for r in units.with_resolved_calls(parsed).collect()}
    assert resolved["pkg.sub.m.A.run"] == {"h": "pkg.sub.lib.helper", "np.dot": "numpy.dot", "self.stop": "pkg.sub.m.A.stop"}
    assert resolved["pkg.sub.m.free"] == {"other": "pkg.sub.lib.other", "A": "pkg.sub.m.A"} and resolved["pkg.sub.m.broken_later"] == {"os.path.join": "os.path.join"}
    triples = {(r.subject, r.verb, r.object) for r in units.graph_triples(parsed).collect()}
    assert {("pkg.sub.m", "imports", "os"), ("pkg.sub.m", "contains", "pkg.sub.m.A"), ("pkg.sub.m.A", "contains", "pkg.sub.m.A.run"), ("pkg.sub.m.A", "inherits", "Base"), ("pkg.sub.m.free", "calls", "A")} <= triples
    assert units.graph_nodes(parsed).count() == 7
    assert {r.partition_key for r in units.triple_partitions(units.graph_triples(parsed), parsed).collect()} == {"pkg"}
    symbols = [(r.symbol_name, r.symbol_kind, r.start_line) for r in units.python_symbols(files).collect()]
    assert symbols == [("A", "class", 6), ("free", "function", 19), ("broken_later", "function", 22), ("run", "function", 10), ("stop", "function", 16), ("inner", "function", 11)]


def test_ambiguous_names_stay_open(spark):
    rows = spark.createDataFrame([("p", "m.A.go", "go", "m.A", "method"), ("p", "m.B.go", "go", "m.B", "method")], "path string, unit_id string, name string, parent_unit_id string, kind string")
    names = {r.name: r.target for r in units.resolution_map(rows, spark.createDataFrame([], "path string, local string, qualified string")).collect()}
    assert names == {"m.A.go": "m.A.go", "m.B.go": "m.B.go", "A.go": "m.A.go", "B.go": "m.B.go"}


def test_strides(spark):
    content = "def f(a):\n" + "".join(f"    x{k} = {k}\n" for k in range(40))
    got = list(units.strides(content, "function", 40, 10))
    lines = content.splitlines(keepends=True)
    covered = set()
    for first, last, part in got:
        assert units.count_tokens(part) <= 40 and part.startswith("def f(a):\n")
        covered.update(range(first, last + 1))
    assert covered == set(range(41)) and got[0][0] == 0 and got[-1][1] == 40
    assert list(units.strides("a\nb", "module", 10, 2)) == [(0, 1, "a\nb")]
    wide = list(units.strides("one two three four five six\n" * 3, "module", 3, 2))
    assert [(a, b) for a, b, _ in wide] == [(0, 0), (1, 1), (2, 2)]
    files = spark.createDataFrame([("m.py", content)], "path string, content string")
    chunks = units.unit_chunks(units.parsed_units(files), 40, 10)
    assert chunks.filter("chunk_type = 'function'").count() == len(got) and chunks.filter("language = 'python'").count() == chunks.count()
    assert "".join(lines) == content
