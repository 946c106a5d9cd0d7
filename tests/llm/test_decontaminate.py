import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from marlstone.llm import decontaminate as dc
from marlstone.llm import op2

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width=10):
    own, hit, found, longest = words(text), set(), set(), 0
    for item_id, item in items:
        w = words(item)
        n = min(width, len(w))
        for i in range(max(len(w) - n + 1, 0) if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item_id)
        for i in range(len(w)):
            for j in range(len(own)):
                k = 0
                while i + k < len(w) and j + k < len(own) and w[i + k] == own[j + k]:
                    k += 1
                longest = max(longest, k)
    return len(own), hit, found, longest


def made_up(seed, n_docs=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Größe", "x1", "漢字", "a", "b", "c", *(f"w{k}" for k in range(30))]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 3, 9, 10, 11, 25, 40]) + 2)) for k in range(8)] + [(8, ""), (9, None), (10, "of THE")]
    docs = []
    for k in range(n_docs):
        parts = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            item = (items[rng.randrange(8)][1] or "").split()
            a = rng.randint(0, len(item))
            parts += [" ".join(item[a : a + rng.randint(0, 20)]).upper(), say(rng.randint(0, 5))]
        docs.append((k, ", ".join(parts)))
    return docs + [(n_docs, None), (n_docs + 1, ""), (n_docs + 2, "!!!")], items


def check(spark, docs, items, **parameters):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for r in dc.with_matches(d, b, **parameters).collect():
        n, hit, found, longest = brute(r.text, items)
        spans = [k for s in r.hit_spans for k in range(s.start, s.end)]
        assert (r.n_words, sorted(hit), sorted(map(str, found))) == (n, spans, r.hit_items), (r.text, items)
        assert r.longest_match == (longest if longest >= min(min(10, len(words(t))) for _, t in items if words(t)) else 0) or "block_bytes" in parameters


def test_against_brute_force(spark):
    for seed in (1, 2):
        check(spark, *made_up(seed))


def test_only_long_items(spark):
    docs, items = made_up(5)
    check(spark, docs, [i for i in items if len(words(i[1])) > 10])


def test_blocks_give_the_same(spark):
    docs, items = made_up(3, 30)
    check(spark, docs, items, block_bytes=150)


def test_random_shards_find_longest():
    rng = np.random.default_rng(0)
    for _ in range(50):
        text = rng.integers(0, 4, 80).astype(np.int32)
        items = [("a", b" ".join(b"abc"[w - 1 : w] for w in rng.integers(1, 4, 14)))]
        test = dc.TestSuffixes(items, 3)
        numbers = np.array([test.vocabulary.get(b"abc"[w - 1 : w], 0) if w else 0 for w in text], np.int32)
        offsets = np.array([0, 30, 30, 80])
        hit, longest, _ = dc.find_matches(numbers, offsets, test)
        item = test.words[:14].tolist()
        for d in range(3):
            part = numbers[offsets[d] : offsets[d + 1]].tolist()
            marked, best = set(), 0
            for i in range(14):
                for j in range(len(part)):
                    k = 0
                    while i + k < 14 and j + k < len(part) and item[i + k] == part[j + k]:
                        k += 1
                    best = max(best, k)
                    if k >= 3:
                        marked.update(range(j, j + 3))
            assert sorted(marked) == np.flatnonzero(hit[offsets[d] : offsets[d + 1]]).tolist()
            assert longest[d] == (best if best >= 3 else 0)


def test_longest_matches_and_places(spark):
    docs, items = made_up(7, 25)
    items = [i for i in items if len(words(i[1])) >= 10]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r.item_word): (r.length, r.doc_id, r.word) for r in dc.longest_matches(d, b).collect()}
    want = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w)):
            for doc, text in docs:
                own = words(text)
                for j in range(len(own)):
                    n = 0
                    while k + n < len(w) and j + n < len(own) and w[k + n] == own[j + n]:
                        n += 1
                    if n >= 10 and (-n, doc, j) < want.get((str(i), k), (0, 0, 0)):
                        want[str(i), k] = (-n, doc, j)
    assert got == {k: (-n, doc, j) for k, (n, doc, j) in want.items()} and got


def test_short_items_and_common_words(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["the", "of", "and", *(f"w{k}" for k in range(12))]) for _ in range(n))
    items = [(k, say(k % 10 + 1)) for k in range(40)] + [(40, "the"), (41, "THE"), (42, "of the")]
    docs = [(k, say(rng.randint(0, 60))) for k in range(25)]
    check(spark, docs, items)
    check(spark, docs, items, block_bytes=40)


def test_one_word_item_costs_no_product():
    """Items times occurrences would be 800 * 20 000 places, of 8 bytes and more each."""
    rng = np.random.default_rng(3)
    texts = [" ".join("the" if r < 0.1 else f"w{int(r * 5000)}" for r in rng.random(500)) for _ in range(400)]
    items = [("x", b"the")] + [(str(k), " ".join(["the", *(f"v{j}" for j in rng.integers(0, 5000, 30)), "the", "the"]).encode()) for k in range(800)]
    test = dc.TestSuffixes(items, 10)
    words_, offsets = dc.numbered(pa.array(texts), test)
    tracemalloc.start()
    hit, longest, pairs = dc.find_matches(words_, offsets, test)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hit.sum() == sum(t.split().count("the") for t in texts) and longest.min() >= 1 and len(pairs) == 400
    assert peak < 60 << 20


def test_least_within():
    rng = np.random.default_rng(4)
    value = rng.integers(0, 1000, 77)
    low = rng.integers(0, 77, 300)
    high = low + 1 + (rng.random(300) * (77 - low)).astype(int).clip(0, 76 - low)
    assert dc.least_within(value, low, high).tolist() == [value[a:b].min() for a, b in zip(low, high, strict=True)]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "one two", 5), (1, "one two", 5), (None, None, 6)], "doc_id long, text string, N_WORDS int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.hit_items) for r in dc.with_matches(docs, none).collect()] == [(2, []), (2, []), (0, [])]
    assert dc.with_matches(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(None, "one two")], "item_id long, text string")
    rows = dc.with_matches(docs.select("doc_id", "text"), one).collect()
    assert [(len(r.hit_spans), r.hit_items) for r in rows] == [(1, []), (1, []), (0, [])]
    assert dc.decontaminate(docs.select("doc_id", "text"), one).count() == 1
    left = dc.decontaminate(docs, one)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(None, None, 6)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    assert {len(w) for w in windows} == {10}
    for r in op2.query(spark, sf).collect():
        w = words(docs[r.doc_id])
        found = [(k, windows[tuple(w[k : k + 10])]) for k in range(len(w) - 9) if tuple(w[k : k + 10]) in windows]
        ids = sorted({str(i) for _, s in found for i in s})
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len({k + j for k, _ in found for j in range(10)}), len(ids))
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest() and r.contaminated == bool(found)
