"""Benchmark decontamination with suffix arrays over the documents.

Each Arrow batch of documents is a shard: its word sequence, cut down to the runs of words that some
benchmark item has, gets a suffix array by prefix doubling. All test suffixes are searched in it at
once by binary search, word by word, which gives for every suffix its longest verbatim match and the
places of it. A window (``width`` consecutive words of an item, or the whole of a shorter item) that
occurs marks the document's words it covers.

The benchmark goes to the tasks in blocks of bounded size; a larger one takes more passes over the
documents, a few of them in one stage, never a shuffle of the documents.

Words: runs of digits, ASCII letters (A-Z as a-z) and characters beyond ASCII. Null and empty texts
have no words, nor items and hits. Repeated items count once; an item with a null id marks words but
isn't listed. Repeated documents each get a row, an empty table an empty one, and columns with
the names of computed ones give way, except in ``decontaminate``, which returns the columns it got.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import add_columns, kept_in_worker, map_batches, stored, without
from marlstone.llm.kernels import spread

WIDTH = 10
#: Bytes of benchmark text that one pass holds.
BLOCK_BYTES = 8 << 20
#: Passes in one stage, each with a block and Python workers of its own; the table is stored in between.
AT_ONCE = 4
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("longest_match", T.IntegerType()),
    T.StructField("hit_spans", T.ArrayType(SPAN)),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall(text.lower()) if text else []


class TestSuffixes:
    """One block of the benchmark: its words by number, and all its suffixes and windows."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int):
        sequences = [words_of(text) for _, text in items]
        self.vocabulary: dict[bytes, int] = {}
        numbers = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in s] for s in sequences]
        lengths = np.array([len(s) for s in numbers], np.int64)
        self.words = np.fromiter(chain.from_iterable([*s, 0] for s in numbers), np.int32)
        item, place = spread(lengths)
        self.start = np.cumsum(lengths + 1)[item] - lengths[item] - 1 + place
        self.left = lengths[item] - place
        self.item_of, self.place = item, place
        self.deepest = int(lengths.max(initial=0))
        window = np.minimum(width, lengths)[item]
        is_window = self.left >= window
        #: Length of the window that begins with a suffix, or 0; equal windows share a number.
        self.window = np.where(is_window, window, 0)
        known: dict[bytes, int] = {}
        self.number = np.full(len(item), -1)
        users: list[set[int]] = []
        for k in np.flatnonzero(is_window):
            key = self.words[self.start[k] : self.start[k] + window[k]].tobytes()
            if key not in known:
                known[key] = len(known)
                users.append(set())
            self.number[k] = known[key]
            users[known[key]].add(int(item[k]))
        self.first_use = np.unique(self.number[is_window], return_index=True)[1] if len(known) else np.zeros(0, np.int64)
        self.search_window = np.zeros(len(item), bool)
        self.search_window[np.flatnonzero(is_window)[self.first_use]] = True
        self.item_ids = [i for i, _ in items]
        self.users = [sorted({self.item_ids[i] for i in u if self.item_ids[i] is not None}) for u in users]
        self.least = int(window.min(initial=width)) if len(window) else width


class Shard:
    """Suffix array over the runs of known words of a batch of documents."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, least: int, deepest: int):
        n = len(words)
        stop = np.ones(n + 1, bool)
        np.equal(words, 0, out=stop[:n])
        cuts = np.unique(np.concatenate([np.flatnonzero(stop), offsets]))
        begin = np.concatenate([[0], cuts])[:-1]
        begin += (words[np.minimum(begin, max(n - 1, 0))] == 0) if n else 0
        keep = cuts - begin >= least
        begin, end = begin[keep], cuts[keep]
        run, place = spread(end - begin + 1)
        self.at = begin[run] + place if len(run) else np.zeros(0, np.int64)
        #: A run ends in 0, which no test word is; a last 0 lets reads beyond the end fail alike.
        self.words = np.where(self.at < end[run], words[np.minimum(self.at, max(n - 1, 0))], 0).astype(np.int64) if len(run) else np.zeros(0, np.int64)
        self.sorted = self._sort(min(deepest, int((end - begin).max(initial=0))))
        self.words = np.append(self.words, 0)

    def _sort(self, deep: int) -> np.ndarray:
        """Order of suffixes by their first words, as many as a test suffix can have."""
        n, rank, step = len(self.words), self.words, 1
        if not n:
            return np.zeros(0, np.int64)
        order = np.argsort(rank, kind="stable")
        while step < deep:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (int(after.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        return order

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            seen = self.words[np.minimum(self.sorted[np.minimum(middle, len(self.sorted) - 1)] + depth, len(self.words) - 1)]
            right = open_ & ((seen <= word) if after else (seen < word))
            low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
        return low

    def search(self, test: TestSuffixes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, suffixes, low, high) for each length: the test suffixes that match so far, and their intervals."""
        active, low, high = np.arange(len(test.start)), np.zeros(len(test.start), np.int64), np.full(len(test.start), len(self.sorted), np.int64)
        depth = 0
        while len(active):
            word = test.words[test.start[active] + depth]
            a, b = self._bound(low, high, depth, word, False), self._bound(low, high, depth, word, True)
            found = a < b
            active, low, high = active[found], a[found], b[found]
            depth += 1
            yield depth, active, low, high
            more = test.left[active] > depth
            active, low, high = active[more], low[more], high[more]


_blocks: dict[str, TestSuffixes] = {}
kept_in_worker(_blocks.clear)


def _block(shared, key: str, width: int) -> TestSuffixes:
    if key not in _blocks:
        _blocks.clear()
        _blocks[key] = TestSuffixes(shared.value, width)
    return _blocks[key]


def find_matches(words: np.ndarray, offsets: np.ndarray, test: TestSuffixes):
    """Per document: hit flags of all words, longest match, set of items (as (document, window number) pairs).

    Memory grows with words and test suffixes, not with their product: of equal windows one is searched, and of the
    suffixes that match alike at a length one interval is looked at and let go.
    """
    n_docs = len(offsets) - 1
    hit = np.zeros(len(words) + 1, np.int64)
    longest = np.zeros(n_docs, np.int32)
    pairs = [np.zeros((0, 2), np.int64)]
    shard = Shard(words, offsets, test.least, test.deepest)
    if len(shard.sorted) and len(test.start):
        position = shard.at[shard.sorted]
        doc = np.searchsorted(offsets, position, "right") - 1
        for length, active, low, high in shard.search(test):
            if length < test.least:
                continue
            low_, high_ = np.divmod(np.unique(low * (len(position) + 1) + high), len(position) + 1)
            one, place = spread(high_ - low_)
            longest[doc[low_[one] + place]] = length
            done = test.search_window[active] & (test.window[active] == length)
            one, place = spread(high[done] - low[done])
            at = low[done][one] + place
            hit += np.bincount(position[at], minlength=len(hit))
            hit -= np.bincount(position[at] + length, minlength=len(hit))
            pairs.append(np.unique(np.stack([doc[at], test.number[active[done]][one]], axis=1), axis=0))
    return np.cumsum(hit)[: len(words)] > 0, longest, np.concatenate(pairs)


def least_within(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of value[low:high] for each pair; intervals aren't empty. Minima of twice as long stretches in each step."""
    out = np.zeros(len(low), value.dtype)
    wide = np.floor(np.log2(np.maximum(high - low, 1))).astype(np.int64)
    table = value
    for k in range(int(wide.max(initial=-1)) + 1):
        of = wide == k
        out[of] = np.minimum(table[low[of]], table[high[of] - (1 << k)])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


def numbered(column: pa.Array, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(words of all documents as numbers, 0 for those no item has; offsets)."""
    found = [words_of(t) for t in column.cast(pa.binary()).to_pylist()]
    offsets = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(w) for w in found], out=offsets[1:])
    return np.fromiter(map(test.vocabulary.get, chain.from_iterable(found), repeat(0)), np.int32, int(offsets[-1])), offsets


def _shared_blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[tuple]:
    """The benchmark as broadcasts of about block_bytes each, at least one; with a key for what workers keep."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("binary").alias("content")).filter(F.length("content") > 0).distinct()
    size = items.agg(F.sum(F.length("content"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "content"), F.lit(blocks)) == k).collect()
        yield spark.sparkContext.broadcast(sorted(((r.item, bytes(r.content)) for r in rows), key=lambda r: (r[0] or "", r[1]))), uuid.uuid4().hex


def longest_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every test suffix with a match of a window's length or more: the longest one in any document, and where.

    (item_id string, item_word int, length int, key, word int): of equally long ones, that of the smallest key
    (null first) and word. Each shard gives one place for a suffix, however often it occurs there.
    """
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField(key, docs.schema[key].dataType), T.StructField("word", T.IntegerType())])
    found = []
    for shared, name in _shared_blocks(benchmark, item_id, item_text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                test = _block(shared, name, width)
                order = pc.sort_indices(batch, [(key, "ascending")], null_placement="at_start")
                batch = batch.take(order)
                words, offsets = numbered(batch.column(text), test)
                shard = Shard(words, offsets, test.least, test.deepest)
                if not len(shard.sorted) or not len(test.start):
                    continue
                longest, low, high = (np.zeros(len(test.start), np.int64) for _ in range(3))
                for length, active, a, b in shard.search(test):
                    longest[active], low[active], high[active] = length, a, b
                suffix = np.flatnonzero(longest >= test.least)
                # documents are in the order of their keys, so the first place is the smallest
                at = least_within(shard.at[shard.sorted], low[suffix], high[suffix])
                doc = np.searchsorted(offsets, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([test.item_ids[i] for i in test.item_of[suffix]], pa.string()), pa.array(test.place[suffix], pa.int32()), pa.array(longest[suffix], pa.int32()), batch.column(key).take(pa.array(doc)), pa.array(at - offsets[doc], pa.int32())], schema.names)

        found.append(map_batches(docs.select(key, text), schema, run))
    every = reduce(DataFrame.unionByName, found)
    best = every.groupBy("item_id", "item_word").agg(F.min(F.struct((-F.col("length")).alias("n"), F.col(key), F.col("word"))).alias("best"))
    return best.select("item_id", "item_word", (-F.col("best.n")).cast("int").alias("length"), F.col(f"best.{key}"), F.col("best.word"))


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the columns of FIELDS.

    n_words; longest_match: words of the longest stretch shared with an item if that has the length of the
    shortest window at least, else 0; hit_spans: maximal runs of words inside occurrences of windows;
    hit_items: items with such windows, sorted.
    """
    live = []
    for k, (shared, name) in enumerate(_shared_blocks(benchmark, item_id, item_text, block_bytes)):
        if len(live) == AT_ONCE:
            docs = stored(docs)
            for done in live:
                done.unpersist()
            live.clear()
        live.append(shared)
        docs = _one_pass(docs, shared, name, text, width, first=k == 0)
    return docs


def _one_pass(docs: DataFrame, shared, name: str, text: str, width: int, first: bool) -> DataFrame:
    def compute(batch: pa.RecordBatch) -> list:
        test = _block(shared, name, width)
        words, offsets = numbered(batch.column(text), test)
        hit, longest, pairs = find_matches(words, offsets, test)
        items: list[set] = [set() for _ in range(len(batch))]
        for doc, number in pairs.tolist():
            items[doc].update(test.users[number])
        if not first:
            longest = np.maximum(longest, np.array(batch.column("longest_match")))
            old, spans = batch.column("hit_items").to_pylist(), batch.column("hit_spans").to_pylist()
            for k, (more, runs) in enumerate(zip(old, spans, strict=True)):
                items[k].update(more)
                for r in runs:
                    hit[offsets[k] + r["start"] : offsets[k] + r["end"]] = True
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        cut = np.zeros(len(hit) + 1, bool)
        cut[offsets] = True
        both = np.concatenate([[False], hit[:-1] & hit[1:], [False]])[: len(hit) + 1] & cut
        starts, ends = np.flatnonzero((edge > 0) | both), np.flatnonzero((edge < 0) | both)
        doc = np.searchsorted(offsets, starts, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(starts - offsets[doc], pa.int32()), pa.array(ends - offsets[doc], pa.int32())], ["start", "end"])
        of = np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32)
        return [pa.array(np.diff(offsets)), pa.array(longest), pa.ListArray.from_arrays(pa.array(of), spans), pa.array([sorted(s) for s in items], pa.list_(pa.string()))]

    return add_columns(docs, FIELDS, compute)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs without those that hold a window of a benchmark item; other columns stay as they are."""
    plain = without(docs, *[f.name for f in FIELDS])
    if len(plain.columns) == len(docs.columns):
        return with_matches(docs, benchmark, **parameters).filter(F.size("hit_spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    # columns that have the names of computed ones are kept aside
    renamed = docs.toDF(*[f"_{k}_{c}" if c not in plain.columns else c for k, c in enumerate(docs.columns)])
    return with_matches(renamed, benchmark, **parameters).filter(F.size("hit_spans") == 0).select(*[F.col(f"`{c}`").alias(d) for c, d in zip(renamed.columns, docs.columns, strict=True)])
