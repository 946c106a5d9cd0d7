import random

import numpy as np
import pyarrow as pa

from marlstone.llm import chunk_dedup as cd
from marlstone.llm.kernels import text_bytes

GEAR = cd.gear_table().tolist()


def slow_cuts(b: bytes):
    """Ends of chunks that the content decides on, byte by byte."""
    h, ends, last = 0, [], None
    for i, x in enumerate(b):
        h = (h << 1) + GEAR[x] & 0xFFFFFFFF
        if h >> (32 - cd.BITS) == 0 and cd.WINDOW <= i + 1 < len(b):
            if last is None or i + 1 - last >= cd.LEAST:
                ends.append(i + 1)
            last = i + 1
    return ends


def slow_chunks(b: bytes):
    """(start, end) of each chunk."""
    out, ends = [], slow_cuts(b)
    for a, e in zip([0, *ends], [*ends, len(b)], strict=True):
        while e - a > cd.MOST:
            out.append((a, a + cd.MOST))
            a += cd.MOST
        if a < e:
            out.append((a, e))
    return out


def slow_growth(own: bytes, other: bytes, a: int, e: int, d: int):
    """own[a:e] is other[a + d:e + d]; both grow while they agree, within the bounds that the docstring names."""
    cuts = [0, *slow_cuts(other), len(other)]
    low = max([c for c in cuts if c < a + d], default=0) - 39
    begins = [c for c in cuts if c >= min(e + d + 40, len(other))]
    high = min([c for c in begins if c > begins[0]], default=len(other))
    while a > 0 and a + d > max(low, 0) and own[a - 1] == other[a + d - 1]:
        a -= 1
    while e < len(own) and e + d < high and own[e] == other[e + d]:
        e += 1
    return a, e


def brute(rows, run=cd.RUN):
    rows = sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0])
    first = {}
    for i, t in rows:
        b, seeds = (t or "").encode(), []
        for a, e in slow_chunks(b):
            if b[a:e] in first:
                seeds.append((a, e, *first[b[a:e]]))
            else:
                first[b[a:e]] = b, a
        blocks, matches = [], {}
        for a, e, other, at in seeds:
            if blocks and blocks[-1][1] == a:
                blocks[-1][1] = e
            else:
                blocks.append([a, e])
            one = matches.setdefault((len(blocks), id(other), at - a), [a, e, other, at - a])
            one[1] = e
        spans = sorted([*map(tuple, blocks), *(slow_growth(b, other, a, e, d) for a, e, other, d in matches.values())])
        gone = [False] * len(b)
        for a, e in spans:
            if e - a >= run:
                gone[a:e] = [True] * (e - a)
        space, done = b" \t\n\x0b\x0c\r", []
        edges = [k for k in range(len(b) + 1) if (k > 0 and gone[k - 1]) != (k < len(b) and gone[k])]
        for a, e in zip(edges[::2], edges[1::2], strict=True):
            while 0 < a < e and b[a] not in space and b[a - 1] not in space:
                a += 1
            while a < e < len(b) and b[e] not in space and b[e - 1] not in space:
                e -= 1
            if 0 < a < e < len(b) and b[a - 1] not in space and b[e] not in space:
                a += 1
            if a < e:
                done.append((a, e))
        kept = b"".join(b[x:y] for x, y in zip([0, *(e for _, e in done)], [*(a for a, _ in done), len(b)], strict=True))
        yield i, len(b), done, None if t is None else kept.decode()


def run(spark, rows):
    found = cd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.removed_spans], r.deduplicated) for r in found.collect()), key=str)


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulmnrst äß") for _ in range(rng.randint(1, 9))).strip() for _ in range(n))


def test_chunks_equal_a_rolling_pass():
    rng = random.Random(1)
    texts = ["", "short", "x" * 1000, *(prose(rng, rng.randint(1, 300)) for _ in range(20))]
    data, offsets = text_bytes(pa.array(texts))
    cuts = cd.boundaries(data, offsets)
    want = [(int(offsets[k]) + a, int(offsets[k]) + e) for k, t in enumerate(texts) for a, e in slow_chunks(t.encode())]
    assert list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) == want


def test_insertions_shift_nothing_far_away():
    rng = random.Random(2)
    text = prose(rng, 400).encode()
    other = text[:700] + b"inserted words" + text[700:]
    one = {text[a:e] for a, e in slow_chunks(text)}
    two = [other[a:e] for a, e in slow_chunks(other)]
    assert np.mean([c in one for c in two]) > 0.9


def test_against_brute_force(spark):
    rng = random.Random(3)
    passages = [prose(rng, rng.randint(51, 90)) for _ in range(5)]
    rows = [(k, " ".join(x for _ in range(3) for x in (prose(rng, rng.randint(0, 40)), rng.choice([*passages, ""])))) for k in range(40)]
    rows += [(40, rows[2][1]), (41, rows[2][1] + " more"), (42, None), (43, ""), (None, passages[0])]
    got = run(spark, rows)
    assert got == sorted(brute(rows), key=str)
    assert any(s for _, _, s, _ in got)


def test_passages_stay_once_and_clean_texts_stay(spark):
    rng = random.Random(4)
    passages = [prose(rng, 55) for _ in range(20)]
    clean = [(k, prose(rng, 200)) for k in range(20)]
    holders = [(100 + k, " ".join([prose(rng, 60), passages[k % 20], prose(rng, 60)])) for k in range(60)]
    got = {i: (spans, text) for i, _, spans, text in run(spark, clean + holders)}
    assert all(got[i] == ([], t) for i, t in clean)
    assert all(not got[100 + k][0] for k in range(20)) and all(got[100 + k][0] for k in range(20, 60))
    assert all(passages[k % 20] in got[100 + k][1] for k in range(20))


def test_edges(spark):
    assert run(spark, []) == []
    long = prose(random.Random(5), 30_000)
    rows = [(1, long), (2, long), (2, long), (3, "a" * 5000)]
    assert run(spark, rows)[0][2] == [] and [r[3] for r in run(spark, rows) if r[0] == 2] == ["", ""]
    odd = spark.createDataFrame([(1, "x", 3, 4)], "doc_id long, text string, digest int, N_Bytes int")
    assert cd.remove_repeats(odd).columns == ["doc_id", "text", "digest", "n_bytes", "removed_spans", "deduplicated"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, sum(b - a for a, b in s), len(s), t) for i, n, s, t in brute(rows))
    assert sorted(map(tuple, cd.query(spark, sf).collect())) == want
