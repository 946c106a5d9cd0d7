"""Semantic units of source files, their metadata, the graph of them, resolved calls, and chunks by tokens.

Python files are parsed once each, in Arrow batches, with the standard library's parser. A file that
it can't read, and any other text file, is one module unit; the parser's message goes to ``error``.
Bodies of functions aren't searched for further units.
"""

from __future__ import annotations

import ast
import posixpath
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marlstone.functions.text import chunk_id, language, partition_key, visibility

CALL = "struct<raw:string,resolved_unit_id:string>"
METADATA = (
    "struct<name:string,qualified_name:string,kind:string,parent_name:string,parent_kind:string,parameters:array<string>,return_type:string,decorators:array<string>,"
    f"docstring:string,visibility:string,cyclomatic_branch_count:int,imports_used:array<string>,calls_made:array<{CALL}>>"
)
UNITS = f"path string, unit_id string, parent_unit_id string, name string, kind string, start_line int, end_line int, content string, metadata {METADATA}, bases array<string>, import_map map<string,string>, error string"
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp)
DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def module_name(path: str) -> str:
    return path.replace("/", ".").removesuffix(".py")


def _branches(node: ast.AST) -> int:
    """Decisions in a node; a chain of n operands with and/or is n - 1 of them."""
    return sum(len(n.values) - 1 if isinstance(n, ast.BoolOp) else isinstance(n, BRANCHES) for n in ast.walk(node))


def _calls(node: ast.AST, source: str) -> list[str]:
    """What is called inside, outermost first, but not in definitions inside."""
    out: dict[str, None] = {}

    def visit(n: ast.AST) -> None:
        if isinstance(n, ast.Call):
            out[ast.get_source_segment(source, n.func) or ast.unparse(n.func)] = None
        for child in ast.iter_child_nodes(n):
            if not isinstance(child, DEFINITIONS):
                visit(child)

    for child in [*getattr(node, "decorator_list", []), *([node.args, node.returns] if hasattr(node, "args") else getattr(node, "bases", [])), *node.body]:
        if isinstance(child, ast.AST) and not isinstance(child, DEFINITIONS):
            visit(child)
    return list(out)


def _parameters(args: ast.arguments, source: str) -> list[str]:
    shown = []
    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    text = lambda a, d, eq: (ast.get_source_segment(source, a) or a.arg) + (f"{eq}{ast.get_source_segment(source, d)}" if d is not None else "")
    for a, d in zip(plain, defaults, strict=True):
        shown.append(text(a, d, " = " if a.annotation else "="))
    if args.vararg:
        shown.append("*" + text(args.vararg, None, ""))
    for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True):
        shown.append(text(a, d, " = " if a.annotation else "="))
    return [*shown, "**" + text(args.kwarg, None, "")] if args.kwarg else shown


def _imports(tree: ast.Module, path: str) -> tuple[list[str], dict[str, str]]:
    """(modules imported at the top, local name to what it stands for)."""
    package, names, local = module_name(path).split(".")[:-1], {}, {}
    for n in tree.body:
        if isinstance(n, ast.Import):
            for a in n.names:
                if not a.asname:
                    names[a.name] = None
                local[a.asname or a.name.split(".")[0]] = a.name
        elif isinstance(n, ast.ImportFrom):
            base = package[: len(package) - n.level + 1] if n.level and n.level - 1 <= len(package) else []
            module = ".".join([*base, *([n.module] if n.module else [])]) or None
            # of a relative import only the first name after it is a dotted name of its own
            names[n.module if not n.level else n.names[0].name] = None
            for a in n.names:
                if a.name != "*":
                    local[a.asname or a.name] = f"{module}.{a.name}" if module else a.name
    return [n for n in names if n and n != "*"], local


def python_units(source: str, path: str) -> Iterator[tuple]:
    """Rows of UNITS without path: the module, then its classes, functions and methods in order."""
    module = module_name(path)
    lines = source.splitlines()
    try:
        tree, error = ast.parse(source), None
    except (SyntaxError, ValueError, RecursionError) as e:
        tree, error = ast.Module(body=[], type_ignores=[]), str(e)
    imports, local = _imports(tree, path)
    about = {"name": module, "qualified_name": module, "kind": "module", "visibility": "public", "imports_used": imports}
    yield module, None, module, "module", 0, max(len(lines) - 1, 0), source, about, [], local, error

    def visible(name: str) -> str:
        return "private" if name.startswith("__") and not name.endswith("__") else "protected" if name.startswith("_") else "public"

    def below(body: list, parent: str | None, parent_kind: str | None) -> Iterator[tuple]:
        for n in body:
            if not isinstance(n, DEFINITIONS):
                continue
            is_class = isinstance(n, ast.ClassDef)
            kind = "method" if parent_kind == "class" else "class" if is_class else "function"
            full = ".".join(filter(None, [module, parent, n.name]))
            first = min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1
            doc = ast.get_docstring(n, clean=False)
            about = {
                "name": n.name, "qualified_name": full, "kind": kind, "parent_name": parent, "parent_kind": parent_kind, "parameters": [] if is_class else _parameters(n.args, source),
                "return_type": ast.get_source_segment(source, n.returns) if not is_class and n.returns else None, "decorators": [ast.get_source_segment(source, d) for d in n.decorator_list],
                "docstring": doc.strip() if doc else None, "visibility": visible(n.name), "cyclomatic_branch_count": _branches(n), "imports_used": imports,
                "calls_made": [{"raw": c, "resolved_unit_id": None} for c in _calls(n, source)],
            }
            bases = [ast.get_source_segment(source, b) for b in n.bases] if is_class and parent is None else []
            yield full, f"{module}.{parent}" if parent else module, n.name, kind, first, n.end_lineno - 1, "\n".join(lines[first : n.end_lineno]), about, bases, {}, None
            if is_class:
                yield from below(n.body, n.name, "class")

    yield from below(tree.body, None, None)


def parsed_units(files: DataFrame, resolve: bool = False, parsers: dict[str, Callable[[str, str], Iterator[tuple]]] | None = None) -> DataFrame:
    """UNITS of files (path, content); blank files have none.

    resolve: calls name the units they reach, see ``with_resolved_calls``. parsers: by the suffix of a path, functions
    of content and path that give rows of UNITS without path; other files are one module.
    """
    by_suffix = {".py": python_units, **(parsers or {})}
    schema = T._parse_datatype_string(UNITS)
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if path and content and content.strip():
                    found = list(by_suffix.get(posixpath.splitext(path)[1], _fallback)(content, path))
                    if resolve:
                        _resolve([(r[0], r[1], r[2], r[3], r[7]) for r in found], found[0][9])
                    rows += [(path, *r[:9], list(r[9].items()), r[10]) for r in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, types.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=types)

    return files.select("path", "content").mapInArrow(run, schema)


def _resolve(units: list[tuple], imports: dict[str, str]) -> None:
    """Fill in what calls reach, in the metadata of one file's units (unit_id, parent_unit_id, name, kind, metadata)."""
    inner = [u for u in units if u[3] != "module"]
    times: dict[str, int] = {}
    for _, _, name, _, _ in inner:
        times[name] = times.get(name, 0) + 1
    # what stands first is overwritten by what counts more
    known = {i: i for i, *_ in inner} | {f"{parent.rpartition('.')[2]}.{name}": i for i, parent, name, _, _ in reversed(inner) if parent and "." in parent}
    known |= {name: i for i, _, name, _, _ in inner if times[name] == 1} | imports
    for *_, about in units:
        for call in (about or {}).get("calls_made") or []:
            raw = call["raw"]
            head, dot, _ = raw.partition(".")
            last = raw.rpartition(".")[2]
            call["resolved_unit_id"] = known[raw] if raw in known else None if not dot else known[head] + raw[len(head) :] if head in known else known.get(last)


def _fallback(content: str, path: str) -> Iterator[tuple]:
    about = {"name": path, "qualified_name": path, "kind": "module"}
    yield path, None, path, "module", 0, max(len(content.splitlines()) - 1, 0), content, about, [], {}, None


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, symbol_name, symbol_kind, start_line, end_line, content): all classes and functions, outer ones first; lines without decorators."""

    def rows(path: str, source: str):
        lines = source.splitlines()
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            return
        for n in ast.walk(tree):
            if isinstance(n, DEFINITIONS):
                yield path, n.name, "class" if isinstance(n, ast.ClassDef) else "function", n.lineno, n.end_lineno, "\n".join(lines[n.lineno - 1 : n.end_lineno]) + "\n"

    schema = T._parse_datatype_string("path string, symbol_name string, symbol_kind string, start_line int, end_line int, content string")
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) if c is not None for r in rows(p, c)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, types.field(i).type) for i, c in enumerate(zip(*found, strict=True))], schema=types)

    return files.select("path", "content").mapInArrow(run, schema)


# the graph


def graph_nodes(units: DataFrame) -> DataFrame:
    return units.filter(F.col("path").endswith(".py")).select(F.col("unit_id").alias("id"), "kind", F.col("name").alias("label"), "path", F.when(F.col("kind") == "module", F.lit(0)).alias("line"), F.when(F.col("kind") != "module", F.create_map(F.lit("visibility"), F.col("metadata.visibility"))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"))


def graph_triples(units: DataFrame) -> DataFrame:
    """(subject, verb, object, source, bidirectional): imports, contains, calls and inherits."""
    code = units.filter(F.col("path").endswith(".py"))
    of = lambda subject, verb, target, rows: rows.select(subject.alias("subject"), F.lit(verb).alias("verb"), target.alias("object"), F.lit("ast").alias("source"), F.lit(False).alias("bidirectional"))
    inner = code.filter("kind <> 'module'")
    imports = of(F.col("unit_id"), "imports", F.col("i"), code.filter("kind = 'module'").select("unit_id", F.explode("metadata.imports_used").alias("i")))
    contains = of(F.col("parent_unit_id"), "contains", F.col("unit_id"), inner)
    calls = of(F.col("unit_id"), "calls", F.col("c.raw"), inner.select("unit_id", F.explode("metadata.calls_made").alias("c")))
    inherits = of(F.col("unit_id"), "inherits", F.col("b"), inner.select("unit_id", F.explode("bases").alias("b")))
    return imports.unionByName(contains).unionByName(calls).unionByName(inherits)


def triple_partitions(triples: DataFrame, units: DataFrame) -> DataFrame:
    """Triples with the partition of the file their subject is in, or _root; subjects are units or stand below one."""
    of = units.filter("kind = 'module'").select(F.col("unit_id").alias("m"), partition_key("path").alias("partition_key")).dropDuplicates(["m"])
    parts = F.split("subject", r"\.")
    heads = triples.select("subject").distinct().select("subject", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("m"))
    best = heads.join(of, "m").groupBy("subject").agg(F.max_by("partition_key", F.length("m")).alias("partition_key"))
    return triples.join(best, "subject", "left").withColumn("partition_key", F.coalesce("partition_key", F.lit("_root")))


# calls


def resolution_map(units: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, name, target): what names stand for in each file; imports (path, local, qualified) go before units.

    Full names, Class.method, and bare names that one unit of the file alone has.
    """
    inner = units.filter("kind <> 'module'").select("path", "unit_id", "name", "parent_unit_id")
    full = inner.select("path", F.col("unit_id").alias("name"), F.col("unit_id").alias("target"))
    dotted = inner.filter(F.col("parent_unit_id").contains(".")).select("path", F.concat(F.element_at(F.split("parent_unit_id", r"\."), -1), F.lit("."), "name").alias("name"), F.col("unit_id").alias("target"))
    bare = inner.groupBy("path", "name").agg(F.count("*").alias("n"), F.max("unit_id").alias("target")).filter("n = 1").select("path", "name", "target")
    every = imports.select("path", F.col("local").alias("name"), F.col("qualified").alias("target"), F.lit(0).alias("o"))
    for k, part in enumerate((bare, dotted, full), start=1):
        every = every.unionByName(part.withColumn("o", F.lit(k)))
    return every.groupBy("path", "name").agg(F.min_by("target", F.struct("o", F.xxhash64("target"))).alias("target"))


def resolved_calls(calls: DataFrame, names: DataFrame) -> DataFrame:
    """calls (path, raw, …) with resolved_unit_id: the whole name, else its head with the rest, else its last part.

    Names grow with the files; Spark takes them for far smaller where they come out of lists, so it must not choose to broadcast them.
    """
    table = lambda c: names.select("path", F.col("name").alias(c), F.col("target").alias(f"_{c}")).hint("merge")
    keyed = calls.withColumns({"exact": F.col("raw"), "head": F.when(F.col("raw").contains("."), F.substring_index("raw", ".", 1)), "last": F.when(F.col("raw").contains("."), F.substring_index("raw", ".", -1))})
    for c in ("exact", "head", "last"):
        keyed = keyed.join(table(c), ["path", c], "left")
    rest = F.expr("substring(raw, length(head) + 1)")
    return keyed.withColumn("resolved_unit_id", F.coalesce("_exact", F.concat("_head", rest), "_last")).drop("exact", "head", "last", "_exact", "_head", "_last")


def with_resolved_calls(units: DataFrame) -> DataFrame:
    """Units whose calls name the units they reach, as far as names tell. Units are read and shuffled once, by path.

    Names of a file: what it imports, then bare names that one unit of it alone has, Class.method, full names. A call
    is looked up by its whole name, else by its head with the rest kept, else by its last part.
    """
    schema = units.schema
    types = to_arrow_schema(schema)
    at = {c: schema.names.index(c) for c in ("path", "unit_id", "parent_unit_id", "name", "kind", "metadata", "import_map")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[list]) -> pa.RecordBatch:
            imports: dict[str, str] = {}
            for r in rows:
                imports |= dict(r[at["import_map"]] or ()) if r[at["kind"]] == "module" else {}
            _resolve([tuple(r[at[c]] for c in ("unit_id", "parent_unit_id", "name", "kind", "metadata")) for r in rows], imports)
            return pa.RecordBatch.from_arrays([pa.array(c, types.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=types)

        rows: list[list] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[-1][at["path"]] != r[at["path"]]:
                    yield made(rows)
                    rows = []
                rows.append(list(r))
        if rows:
            yield made(rows)

    return units.repartition("path").sortWithinPartitions("path", "start_line", "unit_id").mapInArrow(run, schema)


# chunks


def count_tokens(text: str) -> int:
    """Runs of letters, digits and underscores, and single other marks; stands in for a tokenizer that needs a download."""
    n, inside = 0, False
    for c in text:
        word = c.isalnum() or c == "_"
        n += (word and not inside) or (not word and not c.isspace())
        inside = word
    return n


def strides(content: str, kind: str, most: int, overlap: int, tokens: Callable[[str], int] = count_tokens) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of windows of a unit, each with at most ``most`` tokens and the unit's head.

    The head is up to five lines until one with a colon or brace, for functions, methods and classes.
    Windows share max(overlap // 10, 1) lines; a line that is too long even so stands alone.
    """
    lines = content.splitlines(keepends=True)
    if tokens(content) <= most:
        yield 0, max(len(lines) - 1, 0), content
        return
    head: list[str] = []
    if kind in ("function", "method", "class"):
        for line in lines[:5]:
            head.append(line)
            if ":" in line or "{" in line:
                break
        if sum(map(tokens, head)) >= most:
            head = []
    at, room = len(head), most - sum(map(tokens, head))
    while at < len(lines):
        end, used = at, 0
        while end < len(lines) and (end == at or used + tokens(lines[end]) <= room):
            used += tokens(lines[end])
            end += 1
        text = "".join([*head, *lines[at:end]])
        if text.strip():
            yield 0 if at == len(head) else at, end - 1, text
        if end == len(lines):
            return
        at = max(end - max(overlap // 10, 1), at + 1)


def unit_chunks(units: DataFrame, most: int = 8192, overlap: int = 256, tokens: Callable[[str], int] = count_tokens) -> DataFrame:
    """(chunk_id, path, start_line, end_line, content, chunk_type, language, unit_id, metadata): one per unit, or windows of a long one.

    Units with the same place and text, as a file that is one class, keep a chunk each.
    """
    if most <= overlap:
        raise ValueError("most must be larger than overlap")
    cut = "array<struct<first:int,last:int,text:string>>"

    @F.udf(cut, useArrow=True)
    def windows(content, kind):
        return [] if content is None else list(strides(content, kind, most, overlap, tokens))

    rows = units.withColumn("c", F.explode(windows("content", "kind")))
    rows = rows.select("path", (F.col("start_line") + F.col("c.first")).alias("start_line"), (F.col("start_line") + F.col("c.last")).alias("end_line"), F.col("c.text").alias("content"), F.col("kind").alias("chunk_type"), language("path").alias("language"), "unit_id", "metadata")
    return rows.select(chunk_id("path", "start_line", "end_line", "content").alias("chunk_id"), "*")


__all__ = ["UNITS", "count_tokens", "graph_nodes", "graph_triples", "parsed_units", "python_symbols", "resolution_map", "resolved_calls", "strides", "triple_partitions", "unit_chunks", "visibility", "with_resolved_calls"]
