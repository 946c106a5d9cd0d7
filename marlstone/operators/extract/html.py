"""HTML to Markdown, tables, figures and images, with the standard library's parser in Arrow batches."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marlstone.functions import fixed

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "template"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "figure", "figcaption", "form", "address", "dl", "dd", "dt", "details", "summary", "fieldset"}


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Element | None = None
    children: list = field(default_factory=list)

    def walk(self) -> Iterator[Element]:
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]

    def all(self, *tags: str) -> list[Element]:
        return [e for e in self.walk() if e.tag in tags]

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in DROPPED:
                stack += reversed(c.children)

    def text(self) -> str:
        """Stripped pieces of text, joined by blanks."""
        return " ".join(s.strip() for s in self.strings() if s.strip())

    def above(self, *tags: str) -> Element | None:
        e = self.parent
        while e is not None and e.tag not in tags:
            e = e.parent
        return e


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("")

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _joined(children: list, done: dict[int, str]) -> str:
    return "".join(re.sub(r"[ \t\r\n]+", " ", c) if isinstance(c, str) else done[id(c)] for c in children)


def _inline(children: list, done: dict[int, str]) -> str:
    return re.sub(r"\s+", " ", _joined(children, done)).strip()


def _list(e: Element, done: dict[int, str]) -> str:
    """A list with those inside its items, two blanks further in at each level."""
    out, number = [], {}
    is_list = lambda c: isinstance(c, Element) and c.tag in ("ul", "ol")
    stack = [(c, 0) for c in reversed(e.children)]
    while stack:
        c, depth = stack.pop()
        if is_list(c):
            stack += [(x, depth) for x in reversed(c.children)]
        elif isinstance(c, Element) and c.tag == "li":
            number[id(c.parent)] = number.get(id(c.parent), 0) + 1
            mark = f"{number[id(c.parent)]}." if c.parent.tag == "ol" else "-"
            out.append("  " * depth + f"{mark} {_inline([x for x in c.children if not is_list(x)], done)}".rstrip())
            stack += [(x, depth + 1) for x in reversed(c.children) if is_list(x)]
    return "\n".join(out)


def _table(e: Element) -> str:
    rows = [[c.replace("|", "\\|") for c in r] for r in matrix(e)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def _markdown(node: Element, done: dict[int, str]) -> str:
    """An element, those inside it done before."""
    tag = node.tag
    if tag in DROPPED:
        return ""
    if re.fullmatch("h[1-6]", tag):
        return f"\n\n{'#' * int(tag[1])} {_inline(node.children, done)}\n\n"
    if tag in ("ul", "ol"):
        # a list inside an item is part of the outermost one
        return "" if node.parent is not None and node.parent.tag == "li" and node.above("ul", "ol") else f"\n\n{_list(node, done)}\n\n"
    if tag == "table":
        return f"\n\n{_table(node)}\n\n"
    if tag == "pre":
        return "\n\n```\n" + "".join(node.strings()).strip("\n") + "\n```\n\n"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
    inner = _joined(node.children, done)
    if tag == "a" and node.attrs.get("href") and inner.strip():
        return f"[{inner.strip()}]({node.attrs['href']})"
    for tags, mark in ((("b", "strong"), "**"), (("i", "em"), "*"), (("code", "kbd", "samp"), "`")):
        if tag in tags and inner.strip():
            return f"{mark}{inner.strip()}{mark}"
    if tag == "blockquote":
        return "\n\n" + "\n".join(f"> {line}".rstrip() for line in inner.strip().split("\n")) + "\n\n"
    return f"\n\n{inner.strip()}\n\n" if tag in BLOCKS else inner


def to_markdown(html: str) -> str:
    """Headings with #, bullets with -, links, emphasis, code, quotes, tables; scripts and styles are left out."""
    root, done = parse(html), {}
    for e in reversed([root, *root.walk()]):
        done[id(e)] = _markdown(e, done)
    text = done[id(root)]
    lines = [line if line.endswith("  ") else line.rstrip() for line in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip() + "\n"


def matrix(table: Element) -> list[list[str]]:
    """Texts of the direct cells of each row; rows of inner tables count too, rows without cells don't."""
    rows = [[c.text() for c in tr.children if isinstance(c, Element) and c.tag in ("th", "td")] for tr in table.all("tr")]
    return [r for r in rows if r]


def _applied(df: DataFrame, html: str, schema: str, rows: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """The columns of df but html, with the columns of schema, for each row that ``rows`` makes of the HTML."""
    kept = [f for f in df.schema.fields if f.name != html]
    new = T._parse_datatype_string(schema)
    types = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], []
            for k, text in enumerate(batch.column(html).to_pylist()):
                for row in rows(text) if text is not None else ():
                    at.append(k)
                    made.append(row)
            of = pa.array(at, pa.int64())
            columns = list(zip(*made, strict=True)) if made else [[] for _ in types.names]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(of) for f in kept), *(pa.array(c, types.field(i).type) for i, c in enumerate(columns))], [*(f.name for f in kept), *types.names])

    return df.mapInArrow(run, T.StructType([*kept, *new.fields]))


def markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    return _applied(pages, html, "markdown string", lambda text: iter([(to_markdown(text),)]))


def tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """(…, table_index, caption, header, rows_raw, markdown) of every table, counted from 1."""

    def rows(text: str):
        for k, t in enumerate(parse(text).all("table"), start=1):
            cells, caption = matrix(t), next(iter(t.all("caption")), None)
            yield k, caption.text() if caption else "", cells[0] if cells else [], cells[1:], _table(t) + "\n"

    return _applied(pages, html, "table_index int, caption string, header array<string>, rows_raw array<array<string>>, markdown string", rows)


def figures(pages: DataFrame, html: str = "html") -> DataFrame:
    """(…, figure_index, src, alt, caption, markdown) of every image, also of those without a source."""

    def rows(text: str):
        for k, img in enumerate(parse(text).all("img"), start=1):
            figure = img.above("figure")
            caption = next(iter(figure.all("figcaption")), None) if figure else None
            src, alt, said = img.attrs.get("src", ""), img.attrs.get("alt", ""), caption.text() if caption else ""
            yield k, src, alt, said, f"![{alt}]({src})\n\n{said}\n".strip() + "\n"

    return _applied(pages, html, "figure_index int, src string, alt string, caption string, markdown string", rows)


def data_uri(uri: str) -> tuple[bytes, str] | None:
    head, comma, body = uri.removeprefix("data:").partition(",")
    if not uri.startswith("data:") or not comma:
        return None
    try:
        content = base64.b64decode(body) if head.endswith(";base64") else unquote_to_bytes(body)
    except binascii.Error:
        return None
    return content, head.split(";")[0] or "text/plain"


def images(pages: DataFrame, html: str = "html", base_url: str = "", most: int = 10_000_000) -> DataFrame:
    """(…, image_index, src, resolved_src, alt, media_type, byte_count, base64, error) of images with a source.

    Bytes come with data: sources only; others resolve against base_url and join a table of files (see
    ``with_files``), nothing is fetched. Images without a source count in the index. One of more than ``most``
    bytes has an error and no bytes.
    """

    def rows(text: str):
        for k, img in enumerate(parse(text).all("img"), start=1):
            if src := img.attrs.get("src", ""):
                found = data_uri(src)
                large = found is not None and len(found[0]) > most
                yield k, src, src if found else urljoin(base_url, src), img.attrs.get("alt", ""), found[1] if found else None, len(found[0]) if found else None, base64.b64encode(found[0]).decode() if found and not large else None, f"the image has more than {most} bytes" if large else None

    return _applied(pages, html, "image_index int, src string, resolved_src string, alt string, media_type string, byte_count int, base64 string, error string", rows)


def with_files(found: DataFrame, files: DataFrame) -> DataFrame:
    """Images with the bytes of files (path, content, media_type) where their source names one."""
    f = files.select(F.col("path").alias("resolved_src"), F.base64("content").alias("_b"), F.octet_length("content").alias("_n"), F.col("media_type").alias("_m"))
    joined = found.join(f, "resolved_src", "left")
    return joined.withColumns({"base64": F.coalesce("base64", F.regexp_replace("_b", "\\s", "")), "byte_count": F.coalesce("byte_count", "_n"), "media_type": F.coalesce("media_type", "_m")}).drop("_b", "_n", "_m")


# types of table cells


def plain_number(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), ",", "")


def column_type(values: Column) -> Column:
    """Aggregate: integer, float, boolean or string of a column's texts; blank ones have no say."""
    some = F.trim(values) != ""
    every = lambda pattern, of: F.bool_and(F.when(some, of.rlike(pattern)))
    number = plain_number(values)
    integer, real = every(f"^(?:{fixed.INTEGER})$", number), every(f"^(?:{fixed.REAL})$", number)
    boolean = every("^(?:true|false|yes|no)$", F.lower(F.trim(values)))
    return F.when(integer, "integer").when(real, "float").when(boolean, "boolean").otherwise("string")


def coerced(value: Column, kind: Column) -> Column:
    """A cell as a struct of which the field of its type is set; blank cells set none."""
    some, number = F.trim(value) != "", plain_number(value)
    pick = lambda k, v: F.when(some & (kind == k), v)
    return F.struct(pick("integer", number.try_cast("long")).alias("integer"), pick("float", number.try_cast("double")).alias("float"), pick("boolean", F.lower(F.trim(value)).isin("true", "yes")).alias("boolean"), pick("string", value).alias("string"))


def cells(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, row, col, name, text) of tables as ``tables`` makes them."""
    rows = found.select(*keys, "header", F.posexplode("rows_raw").alias("row", "_r"))
    return rows.select(*keys, "row", F.posexplode("_r").alias("col", "text"), F.col("header")).withColumn("name", F.get("header", F.col("col"))).drop("header")


def typed_cells(table_cells: DataFrame, *keys: str) -> DataFrame:
    kinds = table_cells.groupBy(*keys, "col").agg(column_type(F.col("text")).alias("type"))
    return table_cells.join(kinds, [*keys, "col"]).withColumn("value", coerced(F.col("text"), F.col("type")))
