import hashlib
import random

import numpy as np
import pyarrow as pa

from marlstone.llm import fingerprint as fp
from marlstone.llm import op9
from marlstone.llm.kernels import text_bytes


def slow_digest(text: str) -> str:
    data = text.encode()
    counts = [0] * fp.BUCKETS
    for i in range(len(data)):
        for (a, b, c), factor in fp.TRIPLETS:
            if i + c < len(data):
                counts[((data[i + a] | data[i + b] << 8 | data[i + c] << 16) * factor & 0xFFFFFFFF) >> 25] += 1
    ranked = sorted(counts)
    q1, q2, q3 = ranked[31], ranked[63], ranked[95]
    codes = [(n > q1) + (n > q2) + (n > q3) for n in counts]
    packed = bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 128, 4))
    head = bytes([min(255, int(np.floor(np.log1p(len(data)) * 10))), (q1 * 15 // max(q3, 1)) << 4 | q2 * 15 // max(q3, 1)])
    return (head + packed).hex()


def test_digests_equal_a_slow_count():
    rng = random.Random(3)
    texts = ["", "a", "ab", "abc", "é漢", "x" * 500, *("".join(rng.choice("abcdef éß漢") for _ in range(rng.randint(0, 900))) for _ in range(40))]
    assert fp.hex_of(fp.digests(*text_bytes(pa.array(texts)))) == [slow_digest(t) for t in texts]


def test_slices_do_not_matter(monkeypatch):
    texts = ["abc def " * k for k in range(50)]
    whole = fp.hex_of(fp.digests(*text_bytes(pa.array(texts))))
    monkeypatch.setattr(fp, "SLICE", 100)
    assert fp.hex_of(fp.digests(*text_bytes(pa.array(texts)))) == whole


def test_likeness_is_bounded_and_falls_with_edits(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(600))
    edited = text[:-200] + " ".join(rng.choice(words) for _ in range(30))
    other = " ".join(rng.choice("klmnopqrst") * 7 for _ in range(600))
    a, b, c, d = fp.digests(*text_bytes(pa.array([text, edited, other, text])))
    near, far, same = (fp.likeness(a[None], x[None])[0] for x in (b, c, d))
    assert same == 1.0 and 0.8 < near < 1.0 and 0.0 <= far < near
    pairs = spark.createDataFrame([(bytes(a).hex(), bytes(b).hex()), (None, bytes(a).hex())], "a string, b string")
    assert [r.likeness for r in fp.with_likeness(pairs, "a", "b").collect()] == [near, None]


def brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, new, after = (slow_digest(t) for t in (text, edited, following))
        row = lambda h: np.frombuffer(bytes.fromhex(h), np.uint8)[None]
        yield doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new, fp.likeness(row(own), row(new))[0], fp.likeness(row(own), row(after))[0]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()][:120]
    got = op9.edited_fingerprints(spark.createDataFrame(rows, docs.schema).repartition(5))
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_query_edges(spark):
    run = lambda rows: sorted(map(tuple, op9.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, part int")).collect()), key=str)
    assert run([]) == []
    assert run([(7, "abcd", 1)]) == sorted(brute([(7, "abcd")]), key=str)
    assert run([(7, None, 1), (8, "x" * 50_000, 2), (2, "é", 3)]) == sorted(brute([(7, None), (8, "x" * 50_000), (2, "é")]), key=str)
    assert len(run([(None, "a", 1), (1, "b", 2), (1, "b", 2), (None, None, 1)])) == 4
