"""Operators by name: a decorator, a registry that checks calls, and folders of extensions."""

from __future__ import annotations

import importlib.util
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from marlstone.operators import chunking


@dataclass(frozen=True)
class Operator:
    name: str
    call: Callable
    description: str = ""
    requires: str = ""
    produces: str = ""


def operator(name: str | None = None, description: str = "", requires: str = "", produces: str = "") -> Callable:
    """Mark a function as an operator; loaders find it by this mark."""

    def mark(f: Callable) -> Callable:
        f.operator = Operator(name or f.__name__, f, description or (inspect.getdoc(f) or "").split("\n")[0], requires, produces)
        return f

    return mark


def check_json(value: object, at: str = "value") -> object:
    """The value, if JSON can hold it with string keys."""
    if isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str):
                raise TypeError(f"{at} has a key that is no string")
            check_json(v, f"{at}.{k}")
    elif isinstance(value, list | tuple):
        for i, v in enumerate(value):
            check_json(v, f"{at}[{i}]")
    elif value is not None and not isinstance(value, bool | int | float | str):
        raise TypeError(f"{at} is no JSON value: {type(value).__name__}")
    return value


class Registry:
    def __init__(self):
        self._operators: dict[str, Operator] = {}

    def add(self, op: Operator | Callable) -> None:
        op = getattr(op, "operator", op)
        if not isinstance(op, Operator):
            raise TypeError("only marked functions can be added")
        if op.name in self._operators:
            raise ValueError(f"there is an operator {op.name} already")
        kinds = {p.kind for p in inspect.signature(op.call).parameters.values()}
        if kinds & {inspect.Parameter.VAR_POSITIONAL, inspect.Parameter.VAR_KEYWORD, inspect.Parameter.POSITIONAL_ONLY}:
            raise TypeError(f"{op.name} must take named parameters only")
        self._operators[op.name] = op

    def names(self) -> list[str]:
        return sorted(self._operators)

    def get(self, name: str) -> Operator:
        if name not in self._operators:
            raise KeyError(f"no operator {name}")
        return self._operators[name]

    def call(self, name: str, arguments: dict | str | None = None) -> object:
        """Call with JSON arguments; unknown and missing ones raise."""
        given = json.loads(arguments) if isinstance(arguments, str) else dict(arguments or {})
        check_json(given, "arguments")
        parameters = inspect.signature(self.get(name).call).parameters
        if unknown := sorted(given.keys() - parameters.keys()):
            raise TypeError(f"{name} doesn't take {', '.join(unknown)}")
        if missing := [k for k, p in parameters.items() if p.default is p.empty and k not in given]:
            raise TypeError(f"{name} needs {', '.join(missing)}")
        return self.get(name).call(**given)

    def load_folders(self, *roots: str | Path) -> None:
        """Operators of <root>/<extension>/extension.py; of extensions of one name that of the first root counts."""
        seen: set[str] = set()
        for root in map(Path, roots):
            for folder in sorted(p for p in (root.iterdir() if root.is_dir() else ()) if (p / "extension.py").is_file()):
                if folder.name in seen:
                    continue
                seen.add(folder.name)
                spec = importlib.util.spec_from_file_location(f"marlstone_extension_{folder.name}", folder / "extension.py")
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
                for _, f in inspect.getmembers(module, lambda f: hasattr(f, "operator")):
                    if f.__module__ == module.__name__:
                        self.add(f)


@operator(description="Give back a text.")
def echo(text: str) -> str:
    return text


@operator(description="Add two numbers.")
def add(a: float, b: float) -> float:
    return a + b


def _chunks(text: str, chunk: Callable, **sizes) -> list[dict]:
    from pyspark.sql import SparkSession

    df = SparkSession.builder.getOrCreate().createDataFrame([(text,)], "text string")
    return [r.asDict() for r in chunk(df, "text", **sizes).drop("text").orderBy("ordinal").collect()]


@operator(description="A text as one chunk.", requires="text", produces="chunks")
def chunk_full_text(text: str) -> list[dict]:
    return _chunks(text, chunking.full_text_chunks)


@operator(description="A Markdown text by its headings.", requires="text", produces="chunks")
def chunk_sections(text: str) -> list[dict]:
    return _chunks(text, chunking.section_chunks)


@operator(description="A text by paragraphs, packed up to a size.", requires="text", produces="chunks")
def chunk_paragraphs(text: str, most: int = 2000) -> list[dict]:
    return _chunks(text, chunking.paragraph_chunks, most=most)


@operator(description="A text by sentences, packed up to a size.", requires="text", produces="chunks")
def chunk_sentences(text: str, most: int = 1200) -> list[dict]:
    return _chunks(text, chunking.sentence_chunks, most=most)


@operator(description="The best chunks of an index for a full-text query.", requires="index", produces="chunks")
def full_text_search(target: str, query: str, limit: int = 10) -> list[dict]:
    from marlstone import cli

    return cli.search(cli.session(), target, query, limit)


@operator(description="How many handles, edges, paths and chunks an index has.", requires="index", produces="counts")
def index_summary(target: str) -> list[dict]:
    from marlstone import cli

    return cli.summary(cli.session(), target)


BUILT_IN = (echo, add, chunk_full_text, chunk_sections, chunk_paragraphs, chunk_sentences, full_text_search, index_summary)


def default_registry(*roots: str | Path) -> Registry:
    """The library's own operators, then those of folders of extensions."""
    registry = Registry()
    for f in BUILT_IN:
        registry.add(f)
    registry.load_folders(*roots)
    return registry
