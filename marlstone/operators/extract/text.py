"""Plain text and Markdown: copies, references of papers, symbols of JavaScript, rules of stylesheets."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import fixed
from marlstone.functions.text import col, strip
from marlstone.operators.chunking import per_text

REFERENCES_TITLE, ENTRY_START, ANY_HEADING = re.compile(fixed.REFERENCES_TITLE, re.IGNORECASE), re.compile(fixed.ENTRY_START), re.compile(fixed.ANY_HEADING)


def plaintext_markdown(text: Column | str) -> Column:
    return F.concat(strip(text), F.lit("\n"))


def markdown_source(text: Column | str) -> Column:
    return col(text)


def _lines(text: Column | str) -> Column:
    plain = F.regexp_replace(F.regexp_replace(col(text), r"\r\n?", "\n"), r"\n$", "")
    return F.split(plain, "\n")


def references(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """(…, reference_index, reference): entries between a references or bibliography line and the next heading.

    An entry begins at a bullet or number if one is open, else at any line; other lines go on with it.
    """

    def rows(said: str) -> Iterator[tuple]:
        k, entry, inside = 0, [], False
        for line in [*re.sub("\r\n?", "\n", said).removesuffix("\n").split("\n"), "# "]:
            if not inside:
                inside = REFERENCES_TITLE.match(line) is not None
            elif ANY_HEADING.match(line) or line == "# ":
                break
            elif entry and ENTRY_START.match(line):
                k += 1
                yield k, "\n".join(entry).strip() + "\n"
                entry = [line]
            elif line.strip():
                entry.append(line)
        if entry:
            yield k + 1, "\n".join(entry).strip() + "\n"

    return per_text(df, text, "reference_index int, reference string", rows, keep_text)


def _count(line: Column, mark: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))


def js_symbols(df: DataFrame, text: str = "text") -> DataFrame:
    """(…, symbol_name, symbol_kind, start_line, end_line, content): one per line that a pattern matches.

    A symbol ends where the braces opened from its first line on are closed; if that never is, at its first line.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    numbered = F.transform(_lines(text), lambda x, i: F.struct(x.alias("line"), (i + 1).alias("no")))
    first = lambda x, of: F.coalesce(*[F.when(F.regexp_extract(x, p, 1) != "", F.regexp_extract(x, p, 1) if of == "name" else F.lit(k)) for p, k in fixed.JS_SYMBOLS], F.lit(""))
    marks = F.filter(F.transform("_l", lambda e: F.struct(first(e["line"], "name").alias("name"), first(e["line"], "kind").alias("kind"), e["no"].alias("no"))), lambda m: m["name"] != "")
    rows = df.select(*kept, numbered.alias("_l")).select(*kept, "_l", F.explode(marks).alias("_m"))
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit(0).alias("end"))

    def step(s: Column, e: Column) -> Column:
        depth, opened = s["depth"] + _count(e["line"], "{") - _count(e["line"], "}"), s["open"] | e["line"].contains("{")
        return F.when(s["end"] > 0, s).otherwise(F.struct(depth.alias("depth"), opened.alias("open"), F.when(opened & (depth <= 0), e["no"]).otherwise(0).alias("end")))

    end = F.aggregate(F.slice(F.col("_l"), F.col("_m.no"), F.size("_l")), state, step, lambda s: s["end"])
    found = rows.select(*kept, "_l", F.col("_m.name").alias("symbol_name"), F.col("_m.kind").alias("symbol_kind"), F.col("_m.no").alias("start_line"), end.alias("_e")).withColumn("end_line", F.when(F.col("_e") > 0, F.col("_e")).otherwise(F.col("start_line")))
    body = F.array_join(F.transform(F.slice(F.col("_l"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), lambda e: e["line"]), "\n")
    return found.select(*kept, "symbol_name", "symbol_kind", "start_line", "end_line", F.concat(body, F.lit("\n")).alias("content"))


def css_rules(df: DataFrame, text: str = "text", full_selector: bool = False) -> DataFrame:
    """(…, rule_index, selector, start_line, end_line, content) of outermost blocks.

    The selector is what stands before the brace on its line; ``full_selector`` also takes the lines before
    it. Blank lines and lines that begin a comment count for nothing.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    numbered = F.transform(_lines(text), lambda x, i: F.struct(x.alias("line"), (i + 1).alias("no")))
    state = F.struct(F.array().cast("array<struct<selector:string,first:int,last:int>>").alias("done"), F.lit("").alias("selector"), F.lit(0).alias("start"), F.lit(0).alias("depth"))

    def step(s: Column, e: Column) -> Column:
        line = strip(e["line"])
        opens = (s["depth"] == 0) & line.contains("{")
        head = strip(F.substring_index(line, "{", 1))
        joined = lambda x: F.when(s["selector"] == "", x).otherwise(F.concat(s["selector"], F.lit(" "), x))
        selector = F.when(opens, joined(head) if full_selector else head).when((s["depth"] == 0) & (s["start"] == 0), joined(line)).otherwise(s["selector"])
        start = F.when(opens, e["no"]).otherwise(s["start"])
        depth = s["depth"] + _count(e["line"], "{") - _count(e["line"], "}")
        closed = (start > 0) & (depth <= 0)
        rule = F.array(F.struct(strip(selector).alias("selector"), start.alias("first"), e["no"].alias("last")))
        after = F.struct(F.when(closed, F.concat(s["done"], rule)).otherwise(s["done"]).alias("done"), F.when(closed, "").otherwise(selector).alias("selector"), F.when(closed, 0).otherwise(start).alias("start"), F.when(closed, 0).otherwise(depth).alias("depth"))
        return F.when((line == "") | line.startswith("/*"), s).otherwise(after)

    rows = df.select(*kept, numbered.alias("_l")).select(*kept, "_l", F.posexplode(F.aggregate("_l", state, step, lambda s: s["done"])).alias("_i", "_r"))
    body = F.array_join(F.transform(F.slice(F.col("_l"), F.col("_r.first"), F.col("_r.last") - F.col("_r.first") + 1), lambda e: e["line"]), "\n")
    return rows.select(*kept, (F.col("_i") + 1).alias("rule_index"), F.col("_r.selector").alias("selector"), F.col("_r.first").alias("start_line"), F.col("_r.last").alias("end_line"), F.concat(body, F.lit("\n")).alias("content"))


def pdf(*_, **__):
    """Markdown, images, figures and tables of PDF files: kept as names, not there yet."""
    raise NotImplementedError("extraction from PDF files is not available")


pdf_markdown = pdf_images = pdf_figures = pdf_tables = pdf
