"""Extraction passes: ordered ways to make units and chunks of files, of which the first that takes a file counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import units


@dataclass(frozen=True)
class Pass:
    """takes: which paths; parse: files (path, content) to units; chunk: units to chunks; passes of a lower order come first."""

    name: str
    takes: Callable[[Column], Column]
    parse: Callable[[DataFrame], DataFrame] = units.parsed_units
    chunk: Callable[[DataFrame], DataFrame] = units.unit_chunks
    order: int = 100


PYTHON = Pass("python", lambda path: path.endswith(".py"), lambda files: units.parsed_units(files, resolve=True), order=10)
REST = Pass("rest", lambda path: F.lit(True), order=1000)


def in_order(passes: list[Pass]) -> list[Pass]:
    """By order, then by name; two passes of one name raise."""
    if len({p.name for p in passes}) < len(passes):
        raise ValueError("passes must have names of their own")
    return sorted(passes, key=lambda p: (p.order, p.name))


def run(files: DataFrame, passes: list[Pass] = (PYTHON, REST)) -> tuple[DataFrame, DataFrame]:
    """(units, chunks) of files, with the name of the pass; files that no pass takes give none."""
    if not passes:
        raise ValueError("there must be a pass")
    ordered = in_order(list(passes))
    which = F.lit(None).cast("string")
    for p in reversed(ordered):
        which = F.when(p.takes(F.col("path")), p.name).otherwise(which)
    dealt = files.withColumn("_pass", which)
    every = chunks = None
    for p in ordered:
        own = p.parse(dealt.filter(F.col("_pass") == p.name).drop("_pass"))
        made = own.withColumn("pass", F.lit(p.name)), p.chunk(own).withColumn("pass", F.lit(p.name))
        every, chunks = made if every is None else (every.unionByName(made[0]), chunks.unionByName(made[1]))
    return every, chunks
