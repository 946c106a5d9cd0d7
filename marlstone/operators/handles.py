"""Content-addressed handles, the edges between them, and collections of them.

handles: handle, kind, media_type, role, index_state, derivative_type, label, path, sha256, metadata
map<string,string>, status. payloads: handle, content. edges: child, parent, edge_type, ordinal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as x

KINDS, ROLES, STATES = ("derivative", "file_ref", "collection", "index"), ("source", "artifact"), ("raw", "indexable", "index", "metadata")
COLLECTION_MEDIA = "application/vnd.corpus.collection+json"
MAX_CONTENT = 5_000_000


@dataclass(frozen=True)
class HandleContract:
    """What an operator takes or makes; an empty tuple means any."""

    kinds: tuple[str, ...] = ()
    media_types: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    index_states: tuple[str, ...] = ()

    def matches(self) -> Column:
        out = F.lit(True)
        for column, wanted in (("kind", self.kinds), ("media_type", self.media_types), ("role", self.roles), ("index_state", self.index_states)):
            if wanted:
                out = out & F.col(column).isin(*wanted)
        return out


def file_refs(files: DataFrame) -> DataFrame:
    """Handles of files (path, content): equal bytes share one, and the last path in order names it."""
    media = x.media_type("path")
    rows = files.select(x.file_handle("content").alias("handle"), F.lit("file_ref").alias("kind"), media.alias("media_type"), F.lit("source").alias("role"), x.index_state(media).alias("index_state"), F.lit(None).cast("string").alias("derivative_type"), F.col("path").alias("label"), "path", F.sha2("content", 256).alias("sha256"))
    last = rows.groupBy("handle").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "handle"]), "path").alias("r"))
    return last.select("handle", "r.*")


def put(derived: DataFrame) -> DataFrame:
    """Handles of derived content (content, media_type, derivative_type, label, metadata map)."""
    state = x.index_state("media_type", derivative=True)
    return derived.select(x.derivative_handle(F.col("media_type"), F.col("derivative_type"), F.col("content"), F.col("metadata")).alias("handle"), F.lit("derivative").alias("kind"), "media_type", F.lit("artifact").alias("role"), state.alias("index_state"), "derivative_type", "label", F.lit(None).cast("string").alias("path"), F.sha2("content", 256).alias("sha256"), "metadata", "content")


def put_collections(members: DataFrame, by: str, ordinal: str) -> DataFrame:
    """(handle, by, members): one collection per value of ``by``; members (handle, kind, media_type) in order of ordinal."""
    rows = members.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.struct("handle", "kind", "media_type").alias("m")))).alias("_m"))
    ordered = F.transform("_m", lambda v: v["m"])
    return rows.select(x.collection_handle(ordered, F.lit("collection"), F.create_map().cast("map<string,string>")).alias("handle"), by, ordered.alias("members"))


def contains_edges(collections: DataFrame) -> DataFrame:
    return collections.select(F.col("handle").alias("child"), F.posexplode("members").alias("ordinal", "m")).select("child", F.col("m.handle").alias("parent"), F.lit("contains").alias("edge_type"), "ordinal")


def derived_edges(handles: DataFrame) -> DataFrame:
    """An edge to each parent named in derived_from (array<string>), in order."""
    return handles.select(F.col("handle").alias("child"), F.posexplode("derived_from").alias("ordinal", "parent")).select("child", "parent", F.lit("derived_from").alias("edge_type"), "ordinal")


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, of the highest version: what inserting over and over leaves. Of equal versions the largest row counts.

    A partial aggregate, so a key with very many versions is no large group anywhere.
    """
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(F.col(version).alias("_v"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(rest)])).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r._{rest.index(c)}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new rows over those of the same key; created_at stays where the row was there, updated_at is the new one's."""
    n, o = new.alias("n"), old.alias("o")
    columns = []
    for c in old.columns:
        first = ("o", "n") if c == "created_at" else ("n", "o")
        columns.append(F.when(F.col(f"n.{keys[0]}").isNull(), F.col(f"o.{c}")).when(F.col(f"o.{keys[0]}").isNull() | F.lit(first[0] == "n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"n.{k}") == F.col(f"o.{k}"))
    return n.join(o, on, "full").select(*columns)


def read(handles: DataFrame, payloads: DataFrame, edges: DataFrame, handle: str) -> DataFrame:
    """One handle with its content and its members in order."""
    one = handles.filter(F.col("handle") == handle)
    members = edges.filter((F.col("child") == handle) & (F.col("edge_type") == "contains")).groupBy(F.col("child").alias("handle")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "parent"))), lambda m: m["parent"]).alias("members"))
    return one.join(payloads, "handle", "left").join(members, "handle", "left")


def bounded(payloads: DataFrame, most: int, content: str = "content") -> DataFrame:
    """Payloads cut to ``most`` characters, with how many there are and whether some are missing."""
    if most <= 0:
        raise ValueError("most must be positive")
    size = F.length(content)
    return payloads.withColumns({content: F.substring(content, 1, most), "returned_chars": F.least(size, F.lit(most)), "truncated": size > most})


def parents(edges: DataFrame, handle: str) -> DataFrame:
    return edges.filter(F.col("child") == handle).orderBy("edge_type", "ordinal")


def children(edges: DataFrame, handle: str) -> DataFrame:
    return edges.filter(F.col("parent") == handle).orderBy("edge_type", "child")


PROFILED = ("kind", "media_type", "role", "index_state", "derivative_type")


def profile(members: DataFrame) -> DataFrame:
    """(axis, value, n) over the five axes in one pass; empty and null values count as <missing>."""
    axes = [F.struct(F.lit(a).alias("axis"), F.coalesce(F.nullif(F.col(a), F.lit("")), F.lit("<missing>")).alias("value")) for a in PROFILED]
    return members.select(F.explode(F.array(*axes)).alias("a")).groupBy("a.axis", "a.value").agg(F.count("*").alias("n"))


def sample(members: DataFrame, size: int, order: str) -> DataFrame:
    if not 0 <= size <= 200:
        raise ValueError("size must be 0 to 200")
    return members.orderBy(order).limit(size)


def filtered(members: DataFrame, path_glob: str | None = None, label_glob: str | None = None, most: int | None = None, order: str = "handle", **equal: str) -> DataFrame:
    """Members that match all given values of axes and shell patterns; with ``most``, the first of them."""
    for axis, value in equal.items():
        members = members.filter(F.col(axis) == value)
    for column, pattern in (("path", path_glob), ("label", label_glob)):
        if pattern is not None:
            members = members.filter(x.matches_glob(column, pattern))
    if most is not None and most <= 0:
        raise ValueError("most must be positive")
    return members if most is None else members.orderBy(order).limit(most)


def filter_counts(members: DataFrame, **filters) -> DataFrame:
    """(members, skipped, media_types): how many match ``filtered``'s arguments, how many don't, and the matching ones by media type."""
    some = filtered(members, **filters)
    by_type = some.groupBy("media_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("media_type", "n")))).alias("media_types"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))
    return by_type.crossJoin(F.broadcast(members.agg(F.count("*").alias("_all")))).select("members", (F.col("_all") - F.col("members")).alias("skipped"), "media_types")  # one row each
