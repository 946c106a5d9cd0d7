import fnmatch
import hashlib
import re

from pyspark.sql import functions as F

from marlstone.functions import text as x
from marlstone.operators import chunking


def values(spark, column, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r.v for r in rows.select("k", column.alias("v")).orderBy("k").collect()]


def chunks(spark, f, text, *columns, **parameters):
    rows = f(spark.createDataFrame([(1, text)], "k int, text string"), **parameters).orderBy("ordinal").collect()
    return [tuple(r[c] for c in columns) for r in rows]


def test_media_types(spark):
    got = values(spark, x.media_type("text"), "a.py", "a.R", "A.PY", "x/a.htm", "a.pdf", "noext", ".py", "a.tar.gz", "a.xhtml", "a.Md")
    assert got == ["text/x-code-python", "text/x-code-r", "text/x-code-python", "text/html", "application/pdf", "application/octet-stream", "application/octet-stream", "application/octet-stream", "application/xhtml+xml", "text/markdown"]
    assert values(spark, x.indexable("text"), "text/css", "application/json", "application/xhtml+xml", "image/png") == [True, True, True, False]
    assert values(spark, x.indexable("text", True), "application/xhtml+xml", "application/toml") == [False, True]


def test_globs_match_like_the_shell(spark):
    names = ["a.py", "ab/c.py", "a[1].txt", "x", "", "a\nb", "file-é.md", "!x", "b1", "^"]
    for pattern in ("*.py", "a?b", "[ab]*", "[!a]*", "a[[]1].txt", "*", "?", "file-*.md", "[a-c]1", "[^]", "[", "a/*"):
        assert values(spark, x.matches_glob("text", pattern), *names) == [fnmatch.fnmatchcase(n, pattern) for n in names], pattern


def test_identities(spark):
    assert values(spark, x.chunk_id(F.lit("example.py"), F.lit(0), F.lit(0), "text"), "def hello(): return 'world'") == ["a09ec4f49f72c916"]
    assert values(spark, x.file_handle("text"), "alpha") == ["hf_8ed3f6ad685b959ead7022518e1af76cd816f8e8ec7ccdda1ed4018e8f2223f8"]
    plain = '{"content_sha256":"%s","content_type":"text/plain","derivative_type":null,"index_state":"indexable","kind":"derivative","metadata":{"a":"\\"q\\"","b":"é"},"role":"artifact"}' % hashlib.sha256(b"x").hexdigest()
    for order in (("a", '"q"', "b", "é"), ("b", "é", "a", '"q"')):
        handle = x.derivative_handle(F.lit("text/plain"), F.lit(None).cast("string"), F.col("text"), F.create_map(*map(F.lit, order)))
        assert values(spark, handle, "x") == ["h_" + hashlib.sha256(plain.encode()).hexdigest()]


def test_names_and_paths(spark):
    assert values(spark, x.visibility("text"), "f", "_f", "__f", "__f__") == ["public", "protected", "private", "protected"]
    assert values(spark, x.partition_key("text"), "a/b/c", "a") == ["a", "_root"]
    assert values(spark, x.is_below("text", F.lit("a/b")), "a/b", "a/b/c", "a/bc") == [True, True, False]
    assert values(spark, x.intent("text"), "who calls f", "last change", "my_name", "A b", "plain words", "Fooling the USES") == ["structural", "history", "code", "code", "conceptual", "structural"]


def test_normalised_and_terms(spark):
    assert values(spark, x.normalized("text"), "\r\n a\r\nb\rc  \n", " \n ", None) == ["a\nb\nc\n", "", None]
    assert values(spark, x.terms("text"), "Foo_bar, x2-É! ñ") == [["foo_bar", "x2", "é", "ñ"]]
    assert values(spark, x.index_terms("text"), "Café gamma. a/b-c x,y") == [["cafe", "gamma.", "a/b-c", "x", "y"]]


def test_documented_chunks(spark):
    assert chunks(spark, chunking.full_text_chunks, "# Title\n\nBody", "chunk_type", "content") == [("text/full", "# Title\n\nBody\n")]
    assert [c[0] for c in chunks(spark, chunking.section_chunks, "# A\n\nAlpha\n\n## B\n\nBeta", "section_path")] == [["A"], ["A", "B"]]
    assert chunks(spark, chunking.paragraph_chunks, "One. Two.\n\nThree.", "content", "start_paragraph", "end_paragraph", most=8) == [("One. Two.\n", 0, 0), ("Three.\n", 1, 1)]
    assert [c[0] for c in chunks(spark, chunking.sentence_chunks, "One. Two.\n\nThree.", "content", most=6)] == ["One.\n", "Two.\n", "Three.\n"]
    assert len(chunks(spark, chunking.paragraph_chunks, "A paragraph.\n\nAnother paragraph.", "content", most=20)) == 2
    assert [c[0] for c in chunks(spark, chunking.legacy_chunks, "alpha\n\nbeta", "content", most=8)] == ["alpha", "beta"]
    assert [c[0] for c in chunks(spark, chunking.legacy_chunks, "  ", "content")] == ["  "]


def test_sections_by_lines(spark):
    text = "before\n# A\ntext\n### C ###\n## B\n```\n# not code\n```\n#no\n"
    got = chunks(spark, chunking.section_chunks, text, "section_path", "start_line", "end_line", "content")
    assert got == [([], 1, 1, "before\n"), (["A"], 2, 3, "# A\ntext\n"), (["A", "C ###"], 4, 4, "### C ###\n"), (["A", "B"], 5, 6, "## B\n```\n"), (["not code"], 7, 9, "# not code\n```\n#no\n")]


def slow_pack(parts, most, joint):
    out, current = [], []
    for p in parts:
        if current and len(joint.join([*current, p])) > most:
            out.append(joint.join(current))
            current = []
        current.append(p)
    return out + [joint.join(current)] * bool(current)


def test_packing_equals_a_loop(spark):
    import random

    rng = random.Random(1)
    for most in (1, 10, 40):
        text = "\n\n".join("".join(rng.choice("ab c.") for _ in range(rng.randint(1, 30))) for _ in range(20))
        parts = [p.strip() for p in re.split(r"\n\s*\n", text.strip()) if p.strip()]
        assert [c[0] for c in chunks(spark, chunking.paragraph_chunks, text, "content", most=most)] == [b + "\n" for b in slow_pack(parts, most, "\n\n")]
        sentences = [p.strip() for p in re.split(r"(?<=[.!?])\s+", text.strip().replace("\n", " ")) if p.strip()]
        assert [c[0] for c in chunks(spark, chunking.sentence_chunks, text, "content", most=most)] == [b + "\n" for b in slow_pack(sentences, most, " ")]


def test_blank_lines_and_strides(spark):
    assert chunks(spark, chunking.blank_line_paragraphs, "\na\nb\n \n\nc", "start_line", "content") == [(1, "a\nb"), (5, "c")]
    got = chunks(spark, chunking.strided_terms, " ".join(map(str, range(10))), "content", window=4, stride=3)
    assert [c[0] for c in got] == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]
    none = spark.createDataFrame([(1, None), (2, " ")], "k int, text string")
    assert all(f(none).count() == 0 for f in (chunking.full_text_chunks, chunking.paragraph_chunks, chunking.sentence_chunks, chunking.section_chunks, chunking.strided_terms))
