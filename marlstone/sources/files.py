"""Files as tables: discovery with ignore rules, corpus scans, snapshots of state."""

from __future__ import annotations

import fnmatch
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import fixed
from marlstone.functions import text as x


def scan(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, size_bytes, modified, content): files below root, path relative to it. Content is read only if it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    base = re.sub(r"^[a-z]+:/+", "/", root).rstrip("/") + "/"
    local = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    return files.select(F.substr(local, F.lit(len(base) + 1)).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")


def not_excluded(path: Column | str) -> Column:
    return ~F.exists(F.split(x.col(path), "/"), lambda p: p.isin(*fixed.EXCLUDED_DIRS))


def corpus(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """All files but those in folders of tools, in order of path when sorted."""
    return scan(spark, root, glob).filter(not_excluded("path"))


class IgnoreRules:
    """Patterns of ignore files: the last that matches wins, ! takes back, a closing / is for folders only."""

    def __init__(self, lines: list[str]):
        texts = [t.strip() for t in lines]
        self.patterns = [(t.removeprefix("!"), t.startswith("!")) for t in texts if t and not t.startswith("#")]

    def ignores(self, path: str, is_dir: bool) -> bool:
        ignored = False
        for pattern, negated in self.patterns:
            bare = pattern.rstrip("/")
            name = posixpath.basename(path)
            if pattern.endswith("/"):
                hit = is_dir and (fnmatch.fnmatchcase(name, bare) or fnmatch.fnmatchcase(path, bare))
            else:
                hit = fnmatch.fnmatchcase(path if "/" in pattern else name, pattern)
            ignored = not negated if hit else ignored
        return ignored


def ignored_column(path: Column, rules: IgnoreRules, is_dir: bool) -> Column:
    """The rules as an expression, for paths by the million."""
    out = F.lit(False)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    for pattern, negated in rules.patterns:
        bare = pattern.rstrip("/")
        if pattern.endswith("/") and not is_dir:
            continue
        hit = (x.matches_glob(name, bare) | x.matches_glob(path, bare)) if pattern.endswith("/") else x.matches_glob(path if "/" in pattern else name, pattern)
        out = F.when(hit, F.lit(not negated)).otherwise(out)
    return out


def _unary(f):
    """f as a function of one argument; Spark counts arguments, also those with defaults."""
    return lambda x: f(x)


def discover(files: DataFrame, rules: dict[str, list[str]] | None = None, delegates: list[str] = (), inherit: bool = False, most_bytes: int | None = fixed.MAX_FILE_BYTES) -> DataFrame:
    """Text files (path, size_bytes, …) to index, less hidden folders, delegated subtrees, ignored, empty and large ones.

    rules: lines of the ignore files of each folder ('' for the root). They hold for what is directly in the
    folder, and with ``inherit`` for all below; patterns are matched on paths from the root. most_bytes: the size
    up to which files count, or None.
    """
    kept = files.filter(x.is_text_file("path") & (F.col("size_bytes") > 0))
    if most_bytes is not None:
        kept = kept.filter(F.col("size_bytes") <= most_bytes)
    parts = F.split("path", "/")
    kept = kept.filter(~F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.startswith(".")))
    for d in delegates:
        kept = kept.filter(~x.is_below("path", F.lit(d)))
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    for folder, lines in (rules or {}).items():
        own = IgnoreRules(lines)

        def here(path: Column, folder=folder) -> Column:
            above = F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")
            return (above == folder) | (F.lit(inherit) & (F.lit(folder == "") | above.startswith(f"{folder}/")))

        def hit(a: Column, own=own, here=here) -> Column:
            return here(a) & F.when(a == F.col("path"), ignored_column(a, own, False)).otherwise(ignored_column(a, own, True))

        gone = F.exists(ancestors, _unary(hit))
        kept = kept.filter(~gone)
    return kept


def ignore_rules(spark: SparkSession, root: str, folders: list[str] = ("",), name: str = ".gitignore") -> dict[str, list[str]]:
    """Lines of the ignore files of folders below root ('' for the root itself), as ``discover`` takes them; folders without one are left out.

    Read on the driver, as table scans pass over files whose names begin with a dot.
    """
    jvm, out = spark.sparkContext._jvm, {}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path("/".join(filter(None, [root.rstrip("/"), folder, name])))
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            stream = fs.open(path)
            try:
                out[folder] = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            finally:
                stream.close()
    return out


def listed(files: DataFrame, glob: str = "*", most: int = 1000) -> tuple[DataFrame, dict]:
    """(the first matching files by path, {matched, returned, truncated})."""
    if not 1 <= most <= 10_000:
        raise ValueError("most must be 1 to 10000")
    found = files.filter(x.matches_glob(x.base_name("path"), glob))
    n = found.count()
    return found.orderBy("path").limit(most), {"matched": n, "returned": min(n, most), "truncated": n > most}


def text_content(content: Column | str) -> Column:
    """UTF-8, with a replacement character for what isn't."""
    return F.make_valid_utf8(x.col(content).cast("string"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one where none has been written yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else empty(spark, schema)
