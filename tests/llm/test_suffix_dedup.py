import hashlib
import random
from collections import Counter

import pytest

from marlstone.llm import op5
from marlstone.llm import suffix_dedup as sd


def brute(rows, length):
    """(id, bytes, spans, kept) from counts of all strings."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    for (doc_id, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = []
        for k, g in enumerate(gone):
            if g and (k == 0 or not gone[k - 1]):
                spans.append([k, k])
            if g:
                spans[-1][1] = k + 1
        yield doc_id, len(b), [tuple(s) for s in spans], bytes(x for x, g in zip(b, gone, strict=True) if not g)


def run(spark, rows, length, parts=3):
    found = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), length=length)
    return sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found.collect()), key=str)


def made_up(seed, n=40):
    rng = random.Random(seed)
    letters = "abcdefgh é漢"
    say = lambda k, of=letters: "".join(rng.choice(of) for _ in range(k))
    shared = [say(rng.randint(15, 150)) for _ in range(6)]
    rows = []
    for k in range(n):
        text = ""
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            piece = rng.choice(shared)
            a = rng.randint(0, len(piece) // 2)
            text += say(rng.randint(0, 60)) if kind < 0.4 else piece[a:] if kind < 0.8 else rng.choice("xyz") * rng.randint(1, 90) if kind < 0.9 else say(rng.randint(1, 5)) * rng.randint(1, 20)
        rows.append((k, text))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1] + "!"), (n + 2, None), (n + 3, "")]
    return rows


@pytest.mark.parametrize(("seed", "length"), [(1, 24), (2, 40), (3, 16)])
def test_against_brute_force(spark, seed, length):
    rows = made_up(seed)
    assert run(spark, rows, length) == sorted(brute(rows, length), key=str)


def test_runs_of_one_letter_and_periods(spark):
    rows = [(1, "a" * 500), (2, "ab" * 120), (3, "b" + "ab" * 60), (4, "a" * 39), (5, "c" * 40), (6, "d" * 41), (7, "xyz" * 30 + "q" + "xyz" * 30)]
    assert run(spark, rows, 40) == sorted(brute(rows, 40), key=str)


def test_copies_with_edits(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3000))
    rows = []
    for k in range(12):
        copy = list(base)
        for _ in range(6):
            copy[rng.randrange(len(copy))] = rng.choice("ABC")
        rows.append((k, "".join(copy[rng.randint(0, 50) :])))
    assert run(spark, rows, 200, 5) == sorted(brute(rows, 200), key=str)


def test_edges(spark):
    assert run(spark, [], 40) == []
    text = "the same text again and again, word by word by word"
    rows = [(1, text), (1, text), (1, text[3:]), (None, text), (None, "short"), (2, "x" * 39)]
    assert run(spark, rows, 40) == sorted(brute(rows, 40), key=str)
    odd = spark.createDataFrame([(1, text, 3, 4, 5)], "doc_id long, text string, kept int, start int, n int")
    assert sd.remove_repeats(odd, length=40).columns == ["doc_id", "text", "start", "n", "n_bytes", "spans", "kept"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in brute(rows, 200))
    assert sorted(map(tuple, op5.query(spark, sf).collect())) == want
