import binascii
import random

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import op4, op6, quality, toxicity
from marlstone.llm.kernels import text_bytes
from marlstone.llm.labelled import held_out

SF = "/root/testdata/sf0.01"


def area(score, label):
    """Chance that a positive has the higher score."""
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Toxic texts hold one of a few stems, bad ones marks after their words; both in two languages."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for k in range(1500):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.8)
        if toxic:
            text.insert(rng.randint(0, len(text)), rng.choice(["zork", "vumpel"]) + rng.choice(["", "a", "en", "ly"]))
        if not good:
            text = [w + rng.choice(["***", "!!"]) for w in text]
        rows.append((k, " ".join(text), rng.choice(["en", "de"])))
        labels.append((k, good, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def evaluate(found, labels, label):
    p = found.withColumn("out", held_out(found["doc_id"])).join(labels, "doc_id").toPandas()
    p = p[p["out"]]
    return area(p["score"].to_numpy(), p[label].to_numpy()), (p["predicted"] == p[label]).mean()


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    auc, right = evaluate(toxicity.classify(docs, labels), labels, "toxic")
    assert auc > 0.97 and right > 0.95
    auc, right = evaluate(quality.classify(docs, labels, threshold=0.5), labels, "quality")
    assert auc > 0.99 and right > 0.97


def test_held_out_rows_teach_nothing(spark, corpus):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", (1 - labels["toxic"]).cast("int")).filter(held_out(labels["doc_id"])).unionByName(labels.filter(~held_out(labels["doc_id"])))
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_held_out_rule(spark):
    ids = [0, 1, 17, 123456, -5, None]
    d = spark.createDataFrame([(i,) for i in ids], "i long")
    got = {r.i: r.h for r in d.select("i", held_out(d["i"]).alias("h")).collect()}
    assert got == {i: True if i is None else binascii.crc32(str(i).encode()) % 5 == 0 for i in ids}


def test_scores_do_not_depend_on_batches():
    texts = ["", "a b", "x " * 500, None, "ÄÖ zork", "zork"] * 3
    net = toxicity.Net(3)
    whole = net.logits(*toxicity.word_numbers(*text_bytes(pa.array(texts))))
    single = [net.logits(*toxicity.word_numbers(*text_bytes(pa.array([t], pa.string()))))[0] for t in texts]
    assert np.allclose(whole, single, atol=1e-5)
    for t, logit in zip(texts, whole, strict=True):
        at, starts = toxicity.word_numbers(*text_bytes(pa.array([t], pa.string())))
        assert np.isclose(net.place(at)[0] @ net.out + net.bias, logit, atol=1e-5)


def test_sparse_dot_products():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    texts = pa.array(["one two two THREE!! four", "", "a"])
    kinds, of = quality.features(*text_bytes(texts))
    batch = pa.RecordBatch.from_arrays([texts, pa.array([1, 0, 1])], ["text", "label"])
    for k, (at, x, _) in enumerate(quality.examples_of(batch)):
        direct = sum(float(weights[f[i]]) for f in kinds for i in range(of[k], of[k + 1])) * quality.SCALE / max(of[k + 1] - of[k], 1) + weights[-1]
        assert np.isclose(weights[at] @ x, direct, atol=1e-3)


def test_edges(spark, corpus):
    docs, labels = corpus
    odd = spark.createDataFrame([(1, None, None, 3), (1, None, None, 3), (None, "", "xx", 4), (2, "zork " * 30_000, "en", 5)], "doc_id long, text string, lang string, Score int")
    for module in (toxicity, quality):
        found = module.classify(docs.limit(0).unionByName(odd.drop("Score")), labels)
        assert found.count() == 4 and found.filter("score between 0 and 1").count() == 4
        assert module.classify(odd, labels.limit(0)).filter("score = 0.5").count() == 4
        assert module.classify(odd.limit(0), labels).count() == 0
        one = labels.withColumn("quality", labels["quality"] * 0 + 1).withColumn("toxic", labels["toxic"] * 0)
        assert module.classify(odd, one).count() == 4


def test_queries(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for module in (op4, op6):
        p = module.query(spark, SF).toPandas()
        assert len(p) == n and p["score"].between(0, 1).all()
        assert (p["predicted"] == (p["score"] >= (0.5 if module is op4 else 0.3))).all()


@pytest.mark.parametrize(("module", "label"), [(op4, "toxic"), (op6, "quality")])
def test_held_out_accuracy_on_the_given_labels(spark, module, label):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    p = module.query(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").toPandas()
    assert len(p) > 200 and area(p["score"].to_numpy(), p[label].to_numpy()) > 0.95
    assert (p["predicted"] == p[label]).mean() > 0.95
