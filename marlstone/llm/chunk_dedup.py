"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes (shift by one, add a random number for the byte), so it depends on the
last 32 bytes; where its top bits are zero, a chunk ends. Boundaries so depend on the content around
them alone: after an insertion they fall into step again, and a passage is cut alike in all texts but
for its two ends. A boundary closer than ``LEAST`` bytes behind another candidate doesn't count, and chunks over
``MOST`` bytes are cut at multiples of it.

Chunks are told apart by digest (128 bits) and length. Of a repeated chunk the first occurrence, by id and place,
stays; all others are seeds. Seeds that lie alike in the same earlier text are a match, which grows byte by byte to
both sides as far as the two texts agree: to the left up to 39 bytes behind the cut before it, to the right up to the
end of the first whole chunk that begins 40 bytes on. What agrees further holds seeds of its own, as a cut
depends on 39 bytes before it. Matches of ``RUN`` bytes at least go, and so do runs of adjacent seeds of that
length; shorter ones are phrases that texts share by chance, and stay. What goes is narrowed to whole words, so
no word or character is torn.

Documents are read four times, and no text is moved before the last. The first pass counts digests; a bitmap of
bounded size lets the second emit the chunks that are repeated and few others, and the third the
bytes around the places where matches end. A bitmap that is too small for a corpus lets more rows through
and changes no result. Documents that are costly to make should be stored beforehand.

Null and empty texts have no chunks and stay as they are. Rows that are equal in id and text are one
document and treated alike. The key is an integer column; a null one comes before all others. An empty table
gives an empty one; columns with the names of the new ones give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import add_columns, bitmap, dropped, map_batches, parts, passes, stored, table, without
from marlstone.llm.kernels import MIX_1, MIX_2, NOT_SPACE, U64, Rolling, mix, spread, text_bytes

WINDOW, BITS, LEAST, MOST, RUN = 32, 5, 8, 256, 96
#: Bytes before a cut that decide on it: the window, and the candidates that may be too close behind.
REACH = WINDOW + LEAST - 1
CHUNKS = "_k long, _t long, start int, n int, digest long, check long"
#: Runs of seeds of the text _k, _t from a to b that lie d bytes further on in the text fk, ft; hashes of the two places there.
HULLS = "_k long, _t long, fk long, ft long, d int, a int, b int, left long, right long"


def names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def gear_table() -> np.ndarray:
    return (mix(np.arange(256, dtype=U64) + U64(1)) >> U64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: sums of twice as many shifted numbers in each step."""
    h = gear_table()[data]
    step = 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, step * 2
    return h


def content_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted places where a text begins or ends, or the gear hash cuts it."""
    n = len(data)
    ends = np.flatnonzero(gear(data) >> np.uint32(32 - BITS) == 0) + 1
    # the window must lie within the text
    ends = ends[ends < n]
    ends = ends[ends - offsets[np.searchsorted(offsets, ends, "right") - 1] >= WINDOW]
    close = np.zeros(len(ends), bool)
    close[1:] = np.diff(ends) < LEAST
    return np.unique(np.concatenate([ends[~close], offsets]))


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of the chunks of all texts, and the end of the last one."""
    cuts = content_cuts(data, offsets)
    extra = np.maximum(np.diff(cuts) - 1, 0) // MOST
    if extra.any():
        chunk, place = spread(extra)
        cuts = np.unique(np.concatenate([cuts, cuts[:-1][chunk] + (place + 1) * MOST]))
    return cuts


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.withColumns({"_k": F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), "_t": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})


def digests(docs: DataFrame, text: str) -> DataFrame:
    """(digest) of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text):
            data, offsets = text_bytes(batch.column(text))
            cuts = boundaries(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(digest_of(Rolling(data), cuts[:-1], cuts[1:]).view(np.int64))], ["digest"])

    return map_batches(docs.select(text), "digest long", run)


def digest_of(rolling: Rolling, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(rolling.at(start, end) + (end - start).astype(U64)) if len(start) else np.zeros(0, U64)


def chunks(docs: DataFrame, text: str, among: Broadcast) -> DataFrame:
    """CHUNKS of docs, which have _k and _t, that pass a bitmap of digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text):
            data, offsets = text_bytes(batch.column(text))
            cuts = boundaries(data, offsets)
            digest = digest_of(Rolling(data), cuts[:-1], cuts[1:])
            some = np.flatnonzero(passes(among, digest))
            start, end, digest = cuts[:-1][some], cuts[1:][some], digest[some]
            check = digest_of(Rolling(data, MIX_2), start, end)
            doc = np.searchsorted(offsets, start, "right") - 1
            of = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(of), batch.column("_t").take(of), pa.array(start - offsets[doc], pa.int32()), pa.array(end - start, pa.int32()), pa.array(digest.view(np.int64)), pa.array(check.view(np.int64))], names(CHUNKS))

    return map_batches(docs.select("_k", "_t", text), CHUNKS, run)


def hulls(start: np.ndarray, n: np.ndarray, fk: np.ndarray, ft: np.ndarray, fs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(fk, ft, d, a, b) of the seeds of one text, sorted by start: of all that lie alike in one run of adjacent seeds, the first start and last end."""
    out: dict[tuple, list[int]] = {}
    block, last = 0, None
    for a, size, k, t, s in zip(*(x.tolist() for x in (start, n, fk, ft, fs)), strict=True):
        block += last is not None and a != last
        last = a + size
        out.setdefault((block, k, t, s - a), [a, last])[1] = last
    return [(k, t, d, a, b) for (_, k, t, d), (a, b) in out.items()]


def place_hash(k: np.ndarray, t: np.ndarray, place: np.ndarray, right: bool) -> np.ndarray:
    return mix(mix(k.astype(np.int64).view(U64) * MIX_1 + t.astype(np.int64).view(U64)) + place.astype(U64) * U64(2) + U64(right))


def hulls_of(seeds: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, start, n, fk, ft, fs = lists_of(batch, "_seeds", ("start", "n", "fk", "ft", "fs"))
            found = [hulls(*(x[i:j] for x in (start, n, fk, ft, fs))) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            made = np.array([h for x in found for h in x], np.int64).reshape(-1, 5).T
            k, t, d, a, b = made
            ints = [pa.array(x, pa.int32()) for x in (d, a, b)]
            places = [pa.array(place_hash(k, t, x + d, right).view(np.int64)) for x, right in ((a, False), (b, True))]
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(of), batch.column("_t").take(of), pa.array(k), pa.array(t), *ints, *places], names(HULLS))

    return map_batches(seeds, HULLS, run)


def lists_of(batch: pa.RecordBatch, column: str, fields: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """(ends of the lists of structs after a zero, values of each field); null lists are empty."""
    lists = batch.column(column)
    ends = np.concatenate([[0], np.cumsum(np.where(lists.is_null(), 0, np.diff(lists.offsets.to_numpy())))])
    return ends, *(lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in fields)


def windows(docs: DataFrame, text: str, among: Broadcast) -> DataFrame:
    """(fk, ft, p, right, near): bytes on one side of the places that pass a bitmap, as far as a match without seeds can grow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text):
            data, offsets = text_bytes(batch.column(text))
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_k", "_t")]
            content, cuts = content_cuts(data, offsets), boundaries(data, offsets)
            for right in (False, True):
                # a place between two texts ends the one and begins the other
                at = cuts[1:] if right else cuts[:-1]
                doc = np.searchsorted(offsets, at, "left" if right else "right") - 1
                doc = np.clip(doc, 0, max(len(batch) - 1, 0))
                some = np.flatnonzero(passes(among, place_hash(keys[0][doc], keys[1][doc], at - offsets[doc], right))) if len(at) else np.zeros(0, np.int64)
                at, doc = at[some], doc[some]
                if right:
                    low, end = at, offsets[doc + 1]
                    first = np.searchsorted(content, np.minimum(low + REACH + 1, end))
                    high = np.minimum(content[np.minimum(first + 1, len(content) - 1)], end)
                else:
                    before = np.maximum(np.searchsorted(content, at) - 1, 0)
                    low, high = np.maximum(content[before] - REACH, offsets[doc]), at
                near = pa.array([data[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())
                of = pa.array(doc)
                yield pa.RecordBatch.from_arrays([batch.column("_k").take(of), batch.column("_t").take(of), pa.array(at - offsets[doc], pa.int32()), pa.array(np.full(len(doc), right)), near], ["fk", "ft", "p", "right", "near"])

    return map_batches(docs.select("_k", "_t", text), "fk long, ft long, p int, right boolean, near binary", run)


def agree(one: np.ndarray, two: np.ndarray) -> int:
    """Bytes that are equal from the start on."""
    size = min(len(one), len(two))
    other = np.flatnonzero(one[:size] != two[:size])
    return int(other[0]) if len(other) else size


def whole_runs(data: np.ndarray, start: np.ndarray, n: np.ndarray, matches: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Runs of adjacent seeds, and matches, of least bytes, joined and narrowed to whole words."""
    if not len(start):
        return []
    first = np.flatnonzero(np.concatenate([[True], start[1:] != (start + n)[:-1]]))
    runs = zip(start[first].tolist(), (start + n)[np.append(first[1:], len(start)) - 1].tolist(), strict=True)
    joined: list[list[int]] = []
    for x, y in sorted(s for s in (*runs, *matches) if s[1] - s[0] >= least):
        if joined and x <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], y)
        else:
            joined.append([x, y])
    out = []
    for x, y in joined:
        while 0 < x < y and NOT_SPACE[data[x]] and NOT_SPACE[data[x - 1]]:
            x += 1
        while x < y < len(data) and NOT_SPACE[data[y]] and NOT_SPACE[data[y - 1]]:
            y -= 1
        # what stays on both sides stays apart
        if 0 < x < y < len(data) and NOT_SPACE[data[x - 1]] and NOT_SPACE[data[y]]:
            x += 1
        if x < y:
            out.append((x, y))
    return out


def seeds_and_sides(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Of each text that has any: (_k, _t, _seeds: start, n) and (_k, _t, _sides: a, b, right, near), both stored."""
    known = bitmap(digests(docs, text).groupBy("digest").count().filter("count > 1").select("digest"))
    # kept on the executors' disks until the seeds are stored; what an executor loses is cut again
    found = chunks(docs, text, known).persist(StorageLevel.DISK_ONLY)
    same = ["digest", "check", "n"]
    repeated = found.groupBy(same).agg(F.count("*").alias("times"), F.min(F.struct("_k", "_t", "start")).alias("first")).filter("times > 1")
    again = found.join(repeated, same).filter(F.struct("_k", "_t", "start") != F.col("first"))
    seed = F.struct("start", "n", F.col("first._k").alias("fk"), F.col("first._t").alias("ft"), F.col("first.start").alias("fs"))
    seeds = stored(again.groupBy("_k", "_t").agg(F.array_sort(F.collect_set(seed)).alias("_seeds")))
    found.unpersist()
    matches = stored(hulls_of(seeds))
    asked = bitmap(matches.select(F.explode(F.array("left", "right"))))
    # rows that are equal in id and text are one document
    near = windows(docs, text, asked).groupBy("fk", "ft", "p", "right").agg(F.first("near").alias("near"))
    side = lambda right, at: F.struct(F.lit(right).alias("right"), (F.col(at) + F.col("d")).alias("p"))
    ends = matches.withColumn("_side", F.explode(F.array(side(False, "a"), side(True, "b")))).select("_k", "_t", "fk", "ft", "d", "a", "b", "_side.right", "_side.p")
    sides = stored(ends.join(near, ["fk", "ft", "p", "right"]).groupBy("_k", "_t").agg(F.collect_list(F.struct("a", "b", "right", "near")).alias("_sides")))
    known.unpersist()
    asked.unpersist()
    dropped(matches)
    return seeds, sides


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """docs with n_bytes, removed_spans (start and end bytes) and deduplicated (the text that remains, null for null)."""
    docs = keyed(without(docs, "n_bytes", "removed_spans", "deduplicated", "_k", "_t", "_seeds", "_sides"), key, text)
    seeds, sides = seeds_and_sides(docs, text)
    joined = docs.join(seeds, ["_k", "_t"], "left").join(sides, ["_k", "_t"], "left").drop("_k", "_t")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("removed_spans", T.ArrayType(span)), T.StructField("deduplicated", T.StringType())]

    def compute(batch: pa.RecordBatch) -> list:
        data, offsets = text_bytes(batch.column(text))
        nulls = batch.column(text).is_null().to_pylist()
        ends, start, n = lists_of(batch, "_seeds", ("start", "n"))
        s_ends, a, b, right, near = lists_of(batch, "_sides", ("a", "b", "right", "near"))
        spans, texts = [], []
        for k, null in enumerate(nulls):
            own = data[offsets[k] : offsets[k + 1]]
            grown: dict[tuple, list[int]] = {}
            for i in range(s_ends[k], s_ends[k + 1]):
                x, y, bytes_ = int(a[i]), int(b[i]), np.frombuffer(near[i], np.uint8)
                grown.setdefault((x, y), [0, 0])[int(right[i])] = agree(own[y:], bytes_) if right[i] else agree(own[:x][::-1], bytes_[::-1])
            runs = whole_runs(own, start[ends[k] : ends[k + 1]], n[ends[k] : ends[k + 1]], [(x - left, y + more) for (x, y), (left, more) in grown.items()], run)
            spans.append([{"start": x, "end": y} for x, y in runs])
            edges = [0, *(x for r in runs for x in r), len(own)]
            texts.append(None if null else b"".join(own[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
        return [pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(texts, pa.binary()).cast(pa.string())]

    return add_columns(joined, fields, compute, (text,)).drop("_seeds", "_sides")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7: documents without repeated passages."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.col("deduplicated").alias("text"))
