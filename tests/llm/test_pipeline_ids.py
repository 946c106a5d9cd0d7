import random

import corpus_pipeline as cp


def test_null_and_repeated_ids_bring_back_no_near_copy(spark):
    rng = random.Random(31)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(200))
    one, two, other = text(), text(), text()
    rows = [(1, one), (2, two), (5, other), (5, two + " more"), (None, one + " more"), (None, text())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in cp.without_near_copies(spark, docs, "").collect()), key=str)
    assert kept == sorted([rows[0], rows[1], rows[2], rows[5]], key=str)
