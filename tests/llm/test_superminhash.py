import random
import re

import numpy as np
import pyarrow as pa

from marlstone.llm import op8
from marlstone.llm import superminhash as smh
from marlstone.llm.components import components
from marlstone.llm.kernels import U64, text_bytes


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    near = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    for i, j in near:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    names = {}
    for k, g in enumerate(group):
        if rows[k][0] is not None:
            names[g] = min(names.get(g, rows[k][0]), rows[k][0])
    return sorted(((i, len(s), names.get(g), i == names.get(g)) for (i, _), s, g in zip(rows, sets, group, strict=True)), key=str)


def run(spark, rows, size=4, parts=3):
    return sorted(map(tuple, smh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), size=size).collect()), key=str)


def family(rng, n, length, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        yield " ".join(copy)


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((30, 20), (200, 180), (50, 300), (40, 39)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n != 40 else [(k, k + 1) for k in range(39)]
        parent = list(range(n))
        for a, b in edges * n if n < 60 else edges * 60:
            parent[a] = parent[b] = min(parent[a], parent[b])
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
        assert got == {k: p for k, p in enumerate(parent) if p != k}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for n in (1, 3, 40, 300, 2000):
        for _ in range(20):
            pool = rng.integers(0, 2**63, 2 * n).astype(U64)
            a, b = np.unique(pool[: int(1.5 * n) + 1]), np.unique(pool[n // 2 :])
            s = smh.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert (s != ~U64(0)).all()
            errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def slow_signature(xs):
    """Shingle by shingle, with the whole permutation of each."""
    best = {}
    for x in xs:
        p = list(range(smh.SLOTS))
        for j in range(smh.SLOTS):
            value, k = smh._offer(np.array([x], U64), j)
            p[j], p[int(k[0])] = p[int(k[0])], p[j]
            best[p[j]] = min(best.get(p[j], 2**64), int(value[0]))
    return [best[k] for k in range(smh.SLOTS)]


def test_early_stopping_changes_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(smh, "HELD", 64)
    sets = [rng.integers(0, 2**63, n).astype(U64) for n in (1, 2, 7, 0, 60, 90)]
    offsets = np.cumsum([0, *map(len, sets)])
    got = smh.signatures(np.concatenate(sets), offsets)
    for row, s in zip(got, sets, strict=True):
        assert row.tolist() == (slow_signature(s) if len(s) else [2**64 - 1] * smh.SLOTS)


def test_sets_equal_brute_force():
    texts = ["", None, "one", "A a A a A a", "one two three four", "x\ty\x0bz\x1fw v ÄÖ\n", "a b c d a b c d e"]
    for size in (4, 5):
        got, offsets = smh.shingle_sets(*text_bytes(pa.array(texts)), size)
        assert np.diff(offsets).tolist() == [len(shingles(t, size)) for t in texts]


def test_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for length, edits, n in ((60, 3, 25), (12, 2, 15), (300, 12, 20), (5, 1, 10), (100, 9, 40)):
        rows += [(len(rows) + k, t) for k, t in enumerate(family(rng, n, length, edits))]
    rows += [(len(rows) + k, " ".join(f"r{rng.randrange(900)}" for _ in range(rng.randint(0, 50)))) for k in range(60)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows, 4)
    assert run(spark, rows, size=5, parts=7) == brute(rows, 5)


def test_chain_without_a_common_centre(spark):
    """Each text is near the next one only, so no single centre links the bucket."""
    base = [f"w{k}" for k in range(400)]
    rows = [(100 - k, " ".join(base[6 * k : 6 * k + 120])) for k in range(40)]
    want = brute(rows, 4)
    assert len({r[2] for r in want}) == 1
    assert run(spark, rows) == want


def test_families_around_a_hub(spark):
    """Copies of copies: some are near each other, but not near the text that most others are near to."""
    rng = random.Random(11)
    hub = [f"w{rng.randrange(4000)}" for _ in range(150)]

    def edited(base, n):
        copy = list(base)
        for k in rng.sample(range(len(copy)), n):
            copy[k] = f"x{rng.randrange(10**6)}"
        return copy

    texts = [edited(hub, rng.choice([1, 2, 3, 5, 8, 12])) for _ in range(60)]
    far = [edited(hub, 14) for _ in range(6)]
    texts += far + [edited(f, rng.choice([1, 2, 3])) for f in far for _ in range(5)] + [f[: len(f) - k] for f in (hub, *far) for k in (10, 25, 40, 60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows, 4)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (None, "a"), (None, "b c"), (7, "long " * 20_000), (8, "long " * 20_000), (4, "a"), (9, "q w e r t"), (9, "u i o p a")]
    assert run(spark, rows) == brute(rows, 4)
    assert run(spark, []) == []
    extra = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, kept int, bands int")
    assert smh.near_duplicates(extra).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op8.query(spark, sf).collect()), key=str) == brute(rows, 4)


def test_copies_of_what_is_known_of_centres_are_never_broadcast(spark):
    rows = [(f"{k:016d}".encode(), f"{k % 7:016d}".encode(), k % 5, k % smh.SALTS) for k in range(200)]
    named = spark.createDataFrame(rows, "class binary, centre binary, label int, salt int")
    dealt, parts = smh._spread(named)
    assert "Broadcast" not in dealt._jdf.queryExecution().sparkPlan().toString()
    assert dealt.count() == 200 and parts.count() == 7


def test_the_session_keeps_its_broadcast_threshold(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    run(spark, [(1, "a b c d e"), (2, "a b c d e f")])
    assert spark.conf.get(key) == before
