import random

import pytest
from test_chunk_dedup import prose

from marlstone.llm import chunk_dedup as cd


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def extended(spark, rows):
    found = cd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return {r.doc_id: (r.n_bytes, [tuple(s) for s in r.removed_spans], r.deduplicated) for r in found.collect()}


def test_passages_of_51_words_go_whole(spark):
    rng = random.Random(11)
    passages = [words(rng, 51) for _ in range(300)]
    rows = [(k, " ".join([words(rng, 40), p, words(rng, 40)])) for k, p in enumerate(passages)]
    around = [(words(rng, 40), words(rng, 40)) for _ in passages]
    rows += [(1000 + k, " ".join([a, p, b])) for k, ((a, b), p) in enumerate(zip(around, passages, strict=True))]
    got = extended(spark, rows)
    assert all(got[k][1] == [] and got[k][2] == t for k, t in rows[:300])
    # a passage without any whole chunk inside has no seed
    whole = sum(got[1000 + k][2] == " ".join(x) for k, x in enumerate(around))
    assert whole >= 0.98 * len(passages)


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27])
def test_a_full_bitmap_changes_nothing(spark, monkeypatch, bits):
    plain = cd.bitmap
    monkeypatch.setattr(cd, "bitmap", lambda hashes: plain(hashes, bits))
    rng = random.Random(12)
    p = [words(rng, 55) for _ in range(10)]
    rows = [(k, f"{words(rng, 3000)} {x} {words(rng, 30)}") for k, x in enumerate(p)]
    rows += [(100 + k, f"one {x} two") for k, x in enumerate(p)]
    got = extended(spark, rows)
    assert sum(got[100 + k][2] == "one two" for k in range(10)) >= 9


def test_edges_of_extension(spark):
    rng = random.Random(13)
    long = prose(rng, 3000)
    got = extended(spark, [(1, long), (2, long), (3, "a" * 5000), (4, None), (5, ""), (None, "x")])
    assert got[1][1] == [] and got[2][2] == "" and got[4][2] is None and got[5][2] == "" and got[None][2] == "x"
    twice = extended(spark, [(1, long), (2, "b " + long), (2, "b " + long)])
    assert twice[2][2] == "b " or twice[2][2] == "b"
