"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find.

A document's set holds its distinct shingles of ``size`` words. Each shingle goes through the slots of
the signature in a random order of its own; in its j-th step it offers rank j plus a random fraction
to the slot it is at, and a slot keeps the least offer. As every step of a shingle visits another
slot, ranks are correlated and a signature varies less than one of independent hashes; a document
stops as soon as all its slots are filled, mostly after one to three steps.

``BANDS`` bands of ``ROWS`` slots make candidates: two sets of similarity 0.8 share no band with a chance
of 3e-6. Documents with equal sets are one class beforehand. A bucket's members aren't paired with each
other: each is compared with the bucket's centre, the member that shares the most buckets. Links are
confirmed on the full sets; those between members that are connected already can't change a component.

Members that stay unconnected are told apart by what differs from their centre. Two sets that lack r and s of
the centre's n shingles and have a and b others share n - r - s shingles and as many more as their
differences have in common. Unless both are linked with the centre, a link needs a least number of
common differences, mostly a large one. So differences are sorted by how rare they are around the centre,
and two members are paired only if the first one that they have in common comes early enough to
leave that many behind it in both. This loses no link, and copies edited at random are hardly ever paired.
Members that share a difference are first paired with one among them, and with each other only where that
left them unconnected. The members of a centre are dealt over parts, its text to each part.

Null and empty texts, and those without words, have empty sets and are linked with nothing. Rows that repeat
an id keep a row each. Rows without an id can join a component but not name it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import configured, dropped, map_batches, stored
from marlstone.llm.common import parts as parts_of
from marlstone.llm.components import components
from marlstone.llm.kernels import MIX_1, NOT_SPACE, U64, combine, hashed_words, list_array, mix, text_bytes

SLOTS, ROWS = 252, 6
BANDS = SLOTS // ROWS
#: Shingles whose permutations are held at once.
HELD = 1 << 16
#: Rows of a centre that meet in one task with its text, about; and copies of what is known of a centre.
PER_PART, SALTS = 256, 32
#: Bytes of a table that may be broadcast: Spark judges by files, and digests take ten times as much in the driver's memory.
BROADCAST = 1 << 20
FRACTION = U64(56)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed shingles, sorted in each text; offsets)."""
    words, of = hashed_words(data, offsets, NOT_SPACE)
    every = combine(words, size)
    sets = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        sets.append(np.unique(every[a : b - size + 1]) if b - a >= size else combine(words[a:b], b - a) if b > a else every[:0])
    lengths = np.array([len(s) for s in sets], np.int64)
    return np.concatenate([*sets, np.zeros(0, U64)]), np.concatenate([[0], np.cumsum(lengths)])


def _offer(x: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank with fraction, place among the slots from step on) of each shingle in a step."""
    random = mix(x + U64((step + 1) * int(MIX_1) & (1 << 64) - 1))
    return (U64(step) << FRACTION) | (random >> U64(8)), step + (mix(random) % U64(SLOTS - step)).astype(np.int64)


def signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, SLOTS); rows of empty sets are all ones."""
    n, empty = len(offsets) - 1, ~U64(0)
    out = np.full(n * SLOTS, empty, U64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    value, slot = _offer(shingles, 0)
    np.minimum.at(out, doc * SLOTS + slot, value)
    out = out.reshape(n, SLOTS)
    open_ = np.flatnonzero((out == empty).any(axis=1) & (np.diff(offsets) > 0))
    group = np.cumsum(np.diff(offsets)[open_]) // HELD
    for g in np.unique(group):
        docs = open_[group == g]
        _finish(out, docs, shingles, offsets, slot, empty)
    return out


def _finish(out: np.ndarray, docs: np.ndarray, shingles: np.ndarray, offsets: np.ndarray, first: np.ndarray, empty: np.uint64) -> None:
    """Further steps for texts with slots unfilled, each shingle with a permutation shuffled so far."""
    counts = offsets[docs + 1] - offsets[docs]
    row = np.repeat(np.arange(len(docs)), counts)
    at = np.repeat(offsets[docs] - (np.cumsum(counts) - counts), counts) + np.arange(len(row))
    x, local = shingles[at], out[docs]
    order = np.broadcast_to(np.arange(SLOTS, dtype=np.uint8), (len(x), SLOTS)).copy()
    order[np.arange(len(x)), first[at]] = 0
    for step in range(1, SLOTS):
        value, k = _offer(x, step)
        here = np.arange(len(x))
        slot = order[here, k]
        order[here, k] = order[:, step]
        flat = local.reshape(-1)
        np.minimum.at(flat, row * SLOTS + slot, value)
        going = (local == empty).any(axis=1)
        if not going.any():
            break
        keep = going[row]
        if not keep.all() and keep.mean() < 0.7:
            x, row, order = x[keep], row[keep], order[keep]
    out[docs] = local


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of each band's slots and number."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=U64) + U64(7), parts.shape[:2])
    for k in range(ROWS):
        key = mix(key * MIX_1 + parts[:, :, k])
    return key.view(np.int64)


def class_digests(shingles: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128 bits for each set, alike for equal sets; none for empty ones."""
    sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(shingles * U64(m) + U64(k)))]) for m, k in ((3, 1), (5, 2))]
    digest = np.stack([s[offsets[1:]] - s[offsets[:-1]] for s in sums], axis=1).tobytes()
    return [digest[16 * k : 16 * k + 16] if offsets[k] < offsets[k + 1] else None for k in range(len(offsets) - 1)]


def sketches(docs: DataFrame, key: str, text: str, size: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_shingles, class, bands): equal sets have equal classes, empty ones none."""
    schema = T.StructType([docs.schema[key], *[docs.schema[c] for c in carry], T.StructField("n_shingles", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, text):
            shingles, offsets = shingle_sets(*text_bytes(batch.column(text)), size)
            bands = band_keys(signatures(shingles, offsets))
            classes = pa.array(class_digests(shingles, offsets), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(key), *[batch.column(c) for c in carry], pa.array(np.diff(offsets)), classes, list_array(bands.ravel(), np.arange(len(batch) + 1) * BANDS, pa.int64())], schema.names)

    return map_batches(docs.select(key, text, *carry), schema, run)


def _texts(docs: DataFrame, wanted: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(class, text), one text of each wanted class (class, first)."""
    schema = T.StructType([T.StructField("class", T.BinaryType()), T.StructField("text", T.StringType())])
    keys = wanted.select(F.col("first").alias("_key")).distinct()
    some = docs.select(F.col(key).alias("_own"), F.col(text).alias("text")).join(keys, F.col("_own").eqNullSafe(F.col("_key")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text"):
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([pa.array(class_digests(*shingle_sets(*text_bytes(texts), size)), pa.binary()), texts], schema.names)

    # an id may be repeated with another text, so the class is computed anew
    return map_batches(some.select("text"), schema, run).join(wanted.select("class"), "class", "left_semi").groupBy("class").agg(F.first("text").alias("text"))


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets are similar enough."""
    with_text = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text_a", "text_b"):
            one, i = shingle_sets(*text_bytes(batch.column("text_a")), size)
            two, j = shingle_sets(*text_bytes(batch.column("text_b")), size)
            similar = []
            for k in range(len(batch)):
                a, b = one[i[k] : i[k + 1]], two[j[k] : j[k + 1]]
                either = len(np.union1d(a, b))
                similar.append(100 * (len(a) + len(b) - either) >= percent * either)
            yield batch.select(["a", "b"]).filter(pa.array(similar, pa.bool_()))

    return map_batches(with_text.select("a", "b", "text_a", "text_b"), schema, run)


def _pairs(df: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of (a, n_a, b, n_b), less those whose sizes alone differ too much."""
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return df.filter((F.col("a") != F.col("b")) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _named(df: DataFrame, roots: DataFrame, of: str, label: str) -> DataFrame:
    """df with the component of a class as its label."""
    return df.join(roots.select(F.col("node").alias(of), F.col("root").alias(label)), of, "left").withColumn(label, F.coalesce(label, of))


def _copies(of_centres: DataFrame) -> DataFrame:
    """SALTS copies of each row. Spark counts what comes out of an explosion as what went in, so it must not choose to broadcast them."""
    return of_centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def _spread(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of centres with members that aren't connected, with a part for each row; (centre, part)): parts have about PER_PART rows.

    named has a salt; rows learn about their centre from one of SALTS copies, so no centre's rows meet in one task.
    """
    known = named.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(PER_PART)).cast("int").alias("parts"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = stored(known.filter("low <> high").select("centre", "parts"))
    dealt = named.join(_copies(mixed), ["centre", "salt"]).withColumn("part", F.pmod(F.xxhash64("class", F.lit(1)), F.col("parts")).cast("int")).drop("salt", "parts")
    return dealt, mixed.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def _differences(group: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """group with the shingles that either the class or its centre has (items), and how many of the centre's it lacks."""
    text = lambda c: texts.select(F.col("class").alias(c), F.col("text").alias(f"text_{c}"))
    dealt, parts = _spread(group)
    # a centre's text goes to each part of its rows
    joined = dealt.join(text("class"), "class").join(text("centre").join(parts, "centre"), ["centre", "part"])
    schema = T.StructType([*group.select("class", "n", "label", "centre", "n_centre", "label_centre").schema, T.StructField("lacks", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text_class", "text_centre"):
            own, i = shingle_sets(*text_bytes(batch.column("text_class")), size)
            other, j = shingle_sets(*text_bytes(batch.column("text_centre")), size)
            items = [np.setxor1d(own[i[k] : i[k + 1]], other[j[k] : j[k + 1]], assume_unique=True) for k in range(len(batch))]
            length = np.array([len(x) for x in items])
            lacks = (length - np.diff(i) + np.diff(j)) // 2
            values = np.concatenate([*items, np.zeros(0, U64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-2]), pa.array(lacks, pa.int64()), list_array(values, np.concatenate([[0], np.cumsum(length)]), pa.int64())], schema.names)

    return map_batches(joined.select(*schema.names[:-2], "text_class", "text_centre"), schema, run)


def _shared_differences(group: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(c, item, class, label, outside, need, behind), stored: the differences by which members of a centre may be paired.

    Two members must have enough differences from it in common: twice (100 + percent) times the number of these
    must reach the sum of the members' ``need``.
    """
    unit = 2 * (100 + percent)
    need = 2 * percent * F.col("n") + unit * F.col("lacks") - (100 + percent) * F.col("n_centre")
    found = stored(_differences(group, texts, size).withColumns({"need": need, "outside": F.col("label") != F.col("label_centre"), "salt": F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")}))
    least = found.groupBy("centre").agg(F.min("need").alias("any"), F.min(F.when(F.col("outside"), F.col("need"))).alias("out"))
    least = _copies(stored(least))
    # of two members one at least is outside the centre's component
    partner = F.col("need") + F.when(F.col("outside"), F.col("any")).otherwise(F.col("out"))
    sized = found.join(least, ["centre", "salt"]).withColumn("common", F.greatest(F.lit(1), F.ceil(partner / F.lit(unit) - F.lit(1e-9))))
    rows = sized.select(F.xxhash64("centre").alias("c"), "class", F.xxhash64("label").alias("label"), "outside", "need", "common", F.size("items").alias("size"), F.explode("items").alias("item"))
    times = rows.groupBy("c", "item").agg(F.count("*").alias("times"))
    rank = F.row_number().over(Window.partitionBy("c", "class").orderBy("times", "item"))
    ranked = rows.join(times, ["c", "item"]).withColumn("behind", F.col("size") - rank + 1).filter("times > 1 and behind >= common").select("c", "item", "class", "label", "outside", "need", "behind")
    out = stored(ranked)
    dropped(found)
    return out


def _mixed(ranked: DataFrame) -> DataFrame:
    """Only differences that members of more than one component share."""
    some = ranked.groupBy("c", "item").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("c", "item")
    return ranked.join(some, ["c", "item"], "left_semi")


def _enough(percent: int):
    return F.least("behind_a", "behind_b") * F.lit(2 * (100 + percent)) >= F.col("need_a") + F.col("need_b")


def _with_first(ranked: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each row and the one of its difference that has the most behind it: as many as rows."""
    row = lambda k: [F.col(x).alias(f"{x}_{k}") for x in ("class", "label", "outside", "need", "behind")]
    first = ranked.groupBy("c", "item").agg(F.max(F.struct("behind", "class", "label", "outside", "need")).alias("f")).select("c", "item", "f.*")
    pairs = ranked.select("c", "item", *row("a")).join(first.select("c", "item", *row("b")), ["c", "item"])
    return pairs.filter((F.col("label_a") != F.col("label_b")) & (F.col("outside_a") | F.col("outside_b")) & _enough(percent)).select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def _with_each(ranked: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows that share a difference and aren't connected."""
    a, b = (ranked.select("c", "item", *[F.col(x).alias(f"{x}_{k}") for x in ("class", "label", "outside", "need", "behind")]) for k in "ab")
    pairs = a.join(b, ["c", "item"]).filter((F.col("class_a") < F.col("class_b")) & (F.col("label_a") != F.col("label_b")) & (F.col("outside_a") | F.col("outside_b")) & _enough(percent))
    return pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def _links(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of the classes that links join; members: (bucket, members, class, n)."""
    popular = members.groupBy("class").agg(F.sum("members").alias("popular"))
    now = stored(members.select("bucket", "class", "n").join(popular, "class"))
    centre = now.groupBy("bucket").agg(F.max(F.struct("popular", "class", "n")).alias("c"))
    beside = now.join(centre, "bucket").filter("class <> c.class").select("class", "n", F.col("c.class").alias("centre"), F.col("c.n").alias("n_centre"))
    # two classes mostly share many buckets
    beside = stored(beside.distinct())
    edges = _confirmed(_pairs(beside.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("centre").alias("b"), F.col("n_centre").alias("n_b")), percent), texts, size, percent)
    roots = components(edges)
    dropped(now)
    # a centre's component comes with the edges' few centres, so that their members aren't dealt by centre for it
    of_centres = _copies(_named(beside.select("centre").distinct(), roots, "centre", "label_centre"))
    salted = _named(beside, roots, "class", "label").withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int"))
    named = stored(salted.join(of_centres, ["centre", "salt"]))
    dropped(beside)
    ranked = _shared_differences(named, texts, size, percent)
    dropped(named)
    joins = lambda links: components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
    # what the first pairs join needs no more pairs, so the second join has few rows for each difference
    once = joins(_confirmed(_with_first(ranked, percent), texts, size, percent))
    relabelled = ranked.join(once.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("label", F.xxhash64(F.coalesce("root", "class"))).drop("root")
    left = stored(_mixed(relabelled))
    dropped(ranked)
    more = stored(_confirmed(_with_each(left, percent), texts, size, percent))
    out = components(once.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    dropped(left, more, once, roots)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns to carry, n_shingles, component_id, kept) of every row.

    Sets are linked if 100 * common >= percent * all shingles; component_id is the smallest key that links
    reach, kept tells whether it is the row's own. Rows without a key are kept where no linked one has one.
    """
    sketch = stored(sketches(docs, key, text, size, carry))
    classes = sketch.filter("class is not null").groupBy("class").agg(F.min(key).alias("first"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes)
    rows = classes.select("class", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    most = docs.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    with configured(docs.sparkSession, spark__sql__autoBroadcastJoinThreshold=str(min(most, BROADCAST))):
        members = stored(rows.join(shared, "bucket"))
        wanted = stored(members.select("class").distinct().join(classes.select("class", "first"), "class"))
        texts = stored(_texts(docs, wanted, key, text, size))
        roots = _links(members, texts, size, percent)
    dropped(members, wanted, texts)
    # the result is planned when it is read, by the session's own settings
    named = classes.select("class", "first").join(roots.withColumnRenamed("node", "class").hint("merge"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = named.join(names, "root").select("class", "component_id")
    out = sketch.drop("bands").join(of_class, "class", "left")
    component = F.when(F.col("n_shingles") == 0, F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, *carry, "n_shingles", component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))
