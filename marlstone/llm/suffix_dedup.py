"""Exact removal of repeated byte strings by distributed prefix doubling.

A position's rank at offset h is the pair of its rank at half of that offset and of the rank half an offset
on. Spark sorts and counts the pairs, positions whose pair is unique drop out, the others are ranked again at a
larger offset, until they are unique or the threshold is reached. The ranks that make up a pair are 64-bit
fingerprints of the bytes, formed where the bytes are, as numbers counted in an earlier round would have to be
joined to every position of the corpus; so equal strings have equal pairs in all tasks, and pairs have 128 bits.

Billions of positions would make as many rows, so the rounds below the threshold rank samples that
stand for all: of the strings of h bytes inside a string of ``length`` bytes, the one of the least
fingerprint is its anchor. Equal strings have equal anchors, so if an anchor is unique, every string it
stands for is. Neighbouring strings mostly share an anchor and are one row, a stretch. A stretch that
occurs twice as a whole is settled as repeated; one copy of it goes on to stand against stretches of the
same anchor that differ. As h grows, stretches shrink around the places where copies part, and in
the last round, at the threshold, every position left is a row of its own.

Matches never cross texts. Null and empty texts, and those shorter than ``length``, lose nothing. Rows that
repeat an id are texts of their own, so equal ones remove each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import add_columns, dropped, map_batches, parts, stored, without
from marlstone.llm.kernels import BASE, U64, Rolling, mix, sliding_min, spread, text_bytes

LENGTH = 200
#: Parts of the threshold at which samples are ranked before all positions are: offsets 50, 100, 150 and 175 of 200.
PARTS = (0.25, 0.5, 0.75, 0.875)
#: What is known of a stretch: nothing yet; all its strings are repeated; it only repeats strings that came before it in the same stretch.
OPEN, SETTLED, AGAIN = 0, 1, 2
PLACE = "_k long, _t long, base int"
STRETCHES = f"{PLACE}, near long, far long, whole long, start int, n int, state int"
#: The two halves of a rank.
PAIR = ["near", "far"]


def offsets_of(length: int) -> list[int]:
    """Offsets below the threshold at which samples are ranked, the smallest first."""
    return sorted({h for s in PARTS if 8 <= (h := int(length * s)) < length}) or [max(1, length // 2)]


def halves(rolling: Rolling, h: int) -> tuple[np.ndarray, np.ndarray]:
    """The pair of every position at offset h: its rank at half of it, and the rank half of it further on."""
    half = max(h // 2, 1)
    if h == 1:
        return rolling.every(1), np.zeros(max(len(rolling.sums) - 1, 0), U64)
    near, far = rolling.every(half), rolling.every(h - half)[half:]
    return near[: len(far)], far


def anchors(ranks: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Positions whose rank is the least of some window of this width."""
    most = ~sliding_min(~np.concatenate([np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)]), width)
    return np.flatnonzero(most == ranks)


def stretches(data: np.ndarray, low: np.ndarray, high: np.ndarray, h: int, length: int, own: bool) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor, among the strings of length bytes that start in the intervals [low, high).

    (near, far, whole, interval, start, n, state) of each. own: look for strings that a stretch repeats itself; their
    first occurrences are stretches apart, settled ones, and the others need no rank.
    """
    nothing = tuple(np.zeros(0, np.int64) for _ in range(7))
    run, place = spread(high - low)
    at = low[run] + place
    if not len(at):
        return nothing
    rolling = Rolling(data)
    near, far = halves(rolling, h)
    # one number for each pair, by which the least of a window is chosen
    ranks = mix(near * BASE + far)
    least = sliding_min(ranks, length - h + 1)
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (run[1:] != run[:-1])
    state = np.zeros(len(at), np.int8)
    some = anchors(ranks, least, length - h + 1)
    if own:
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        lo, hi = np.searchsorted(some, at[first]), np.searchsorted(some, at[first] + n + length - h)
        of, k = spread(hi - lo)
        twice = np.bincount(of[ranks[some[lo[of] + k]] == value[first][of]], minlength=len(first)) > 1
        of, k = spread(n[twice])
        if len(of):
            index = first[twice][of] + k
            full = rolling.at(at[index], at[index] + length)
            order = np.lexsort((index, full, of))
            same = (full[order][1:] == full[order][:-1]) & (of[order][1:] == of[order][:-1])
            again, before = np.concatenate([[False], same]), np.concatenate([same, [False]])
            state[index[order[again]]] = AGAIN
            state[index[order[before & ~again]]] = SETTLED
            new[1:] |= state[1:] != state[:-1]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start = at[first]
    whole = mix(rolling.at(start, start + n + length - 1) + n.astype(U64))
    # the pair of each stretch's anchor, which its first string holds
    lo, hi = np.searchsorted(some, start), np.searchsorted(some, start + length - h + 1)
    of, k = spread(hi - lo)
    hit = np.flatnonzero(ranks[some[lo[of] + k]] == value[first][of])
    anchor = some[lo + k[hit[np.unique(of[hit], return_index=True)[1]]]]
    return near[anchor].view(np.int64), far[anchor].view(np.int64), whole.view(np.int64), run[first], start, n, state[first]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with (_k, _t), which tell rows apart unless they are equal in key and text."""
    plain = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"_k": F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), "_t": F.xxhash64(plain), "_bytes": plain.cast("binary")})


def _first_round(docs: DataFrame, h: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "_bytes"):
            data, offsets = text_bytes(batch.column("_bytes"))
            near, far, whole, doc, start, n, state = stretches(data, offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - length + 1), h, length, own=True)
            local = pa.array(start - offsets[:-1][doc], pa.int32())
            of = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(of), batch.column("_t").take(of), local, pa.array(near), pa.array(far), pa.array(whole), local, pa.array(n, pa.int32()), pa.array(state, pa.int32())], [f.split()[0] for f in STRETCHES.split(", ")])

    return map_batches(docs.select("_k", "_t", "_bytes"), STRETCHES, run)


def _next_round(segments: DataFrame, active: DataFrame | None, h: int, length: int) -> DataFrame:
    """Stretches at offset h of what is active: all of the segments, or intervals (_k, _t, base, start, n, state) of them."""
    if active is None:
        rows = segments.withColumn("spans", F.array(F.struct(F.col("base").alias("start"), "n", "state"))).drop("n", "state")
    else:
        rows = segments.drop("n", "state").join(active.groupBy("_k", "_t", "base").agg(F.collect_list(F.struct("start", "n", "state")).alias("spans")), ["_k", "_t", "base"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "_bytes"):
            data, offsets = text_bytes(batch.column("_bytes"))
            spans = batch.column("spans")
            of = np.repeat(np.arange(len(batch)), np.diff(spans.offsets.to_numpy()))
            start, n, state = (spans.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n", "state"))
            base = batch.column("base").to_numpy().astype(np.int64)
            low = offsets[:-1][of] + start - base[of]
            near, far, whole, interval, at, n, _ = stretches(data, low, low + n, h, length, own=False)
            row = of[interval]
            place = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(place) for c in ("_k", "_t", "base")), pa.array(near), pa.array(far), pa.array(whole), pa.array(at - offsets[:-1][row] + base[row], pa.int32()), pa.array(n, pa.int32()), pa.array(state[interval], pa.int32())], [f.split()[0] for f in STRETCHES.split(", ")])

    return map_batches(rows.select("_k", "_t", "base", "_bytes", "spans"), STRETCHES, run)


def _ranked(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans found to be repeated, distinct stretches that go on) of a round's stored stretches, which are deleted."""
    ranks = found.filter(F.col("state") != AGAIN).groupBy(PAIR).agg(F.count("*").alias("times")).filter("times > 1")
    again = stored(found.filter(F.col("state") != AGAIN).join(ranks, PAIR).drop("times"))
    wholes = again.groupBy(*PAIR, "whole").agg(F.count("*").alias("times"), F.max("state").alias("state"), F.min(F.struct("_k", "_t", "base", "start", "n")).alias("one"))
    wholes = stored(wholes.withColumn("state", F.when(F.col("times") > 1, SETTLED).otherwise(F.col("state"))))
    settled = again.filter(F.col("state") == OPEN).join(wholes.filter("times > 1").select(*PAIR, "whole"), [*PAIR, "whole"]).select("_k", "_t", "start", "n")
    spans = stored(settled)
    mixed = wholes.groupBy(PAIR).agg(F.count("*").alias("kinds"), F.min("state").alias("least")).filter((F.col("kinds") > 1) & (F.col("least") == OPEN)).select(PAIR)
    onwards = stored(wholes.join(mixed, PAIR, "left_semi").select("one.*", "state"))
    dropped(found, again, wholes)
    return spans, onwards


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(_k, _t, start, n): strings that start at start .. start+n-1 and occur elsewhere; docs as _keyed makes them."""
    offsets = offsets_of(length)
    found = stored(_first_round(docs, offsets[0], length))
    local = stored(found.filter(F.col("state") != OPEN).select("_k", "_t", "start", "n"))
    spans, first = _ranked(found)
    spans = spans.unionByName(local)
    cut = first.select("_k", "_t", F.col("start").alias("base"), "n", "state")
    segments = stored(docs.select("_k", "_t", "_bytes").join(cut, ["_k", "_t"]).select("_k", "_t", "base", "n", "state", F.expr(f"substring(_bytes, base + 1, n + {length - 1})").alias("_bytes")))
    if segments.count() > segments.select("_k", "_t", "base").distinct().count():
        segments = stored(segments.groupBy("_k", "_t", "base").agg(*[F.first(c).alias(c) for c in ("n", "state", "_bytes")]))
    active = None
    for h in offsets[1:]:
        more, active = _ranked(stored(_next_round(segments, active, h, length)))
        spans = spans.unionByName(more)
    last = stored(_next_round(segments, active, length, length).drop("whole", "base"))
    ranks = last.groupBy(PAIR).agg(F.count("*").alias("times")).filter("times > 1").select(PAIR)
    more = stored(last.filter(F.col("state") == OPEN).join(ranks, PAIR).select("_k", "_t", "start", "n"))
    dropped(last, segments)
    return spans.unionByName(more)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with n_bytes, spans (maximal removed runs of bytes, as start and end) and kept (the bytes that remain).

    Every byte covered by a string of length bytes that starts anywhere else too is removed, all copies alike.
    key is an integer column.
    """
    docs = without(docs, "n_bytes", "spans", "kept", "_k", "_t", "_bytes")
    keyed = _keyed(docs, key, text)
    spans = stored(repeated_spans(keyed, length).groupBy("_k", "_t").agg(F.collect_list(F.struct("start", "n")).alias("_spans")))
    joined = keyed.join(spans, ["_k", "_t"], "left").drop("_k", "_t")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())]

    def compute(batch: pa.RecordBatch) -> list:
        data, offsets = text_bytes(batch.column("_bytes"))
        lists = batch.column("_spans")
        size = np.where(lists.is_null(), 0, np.diff(lists.offsets.to_numpy()))
        row = np.repeat(np.arange(len(batch)), size)
        start, n = (lists.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
        change = np.zeros(len(data) + 1, np.int64)
        np.add.at(change, offsets[:-1][row] + start, 1)
        np.add.at(change, offsets[:-1][row] + start + n + length - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = gone[1:] != gone[:-1]
        edge[offsets] = True
        edges = np.flatnonzero(edge)
        begin, end = edges[:-1][gone[edges[:-1]]] if len(data) else edges[:0], edges[1:][gone[edges[:-1]]] if len(data) else edges[:0]
        doc = np.searchsorted(offsets, begin, "right") - 1
        found = pa.StructArray.from_arrays([pa.array(begin - offsets[doc], pa.int32()), pa.array(end - offsets[doc], pa.int32())], ["start", "end"])
        return [pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(batch) + 1)), pa.int32()), found), pa.array(kept, pa.binary())]

    return add_columns(joined, fields, compute, ("_bytes",)).drop("_bytes", "_spans")
