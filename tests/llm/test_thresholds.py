import random

from marlstone.llm import toxicity


def test_each_language_has_its_own_threshold_from_all_labels(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for k in range(1200):
        toxic = rng.random() < 0.3
        text = [rng.choice(words) for _ in range(rng.randint(5, 40))] + (["zork"] if toxic else [])
        rows.append((k, " ".join(text), rng.choice(["en", "en", "de", "fr"])))
        labels.append((k, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    # a sample of 90 a class leaves 18 toxic rows to calibrate on, fewer than LEAST
    model, trained = toxicity.fitted(docs, labels, per_class=90)
    cuts = toxicity.thresholds(toxicity.scored(docs, model), labels, trained)
    assert set(cuts) == {"", "en", "de", "fr"} and len({round(c, 6) for c in cuts.values()}) > 1
    assert len(trained) == 144 and all(0.04 < c < 0.96 for c in cuts.values())


def test_few_rows_lean_on_the_threshold_of_all():
    clean = [(9, 0.9, 0.95, 0, 10), (1, 0.1, 0.2, 10, 0)]
    assert toxicity.threshold(clean, (1.0, 1.0)) == (0.9 + 0.2) / 2
    assert toxicity.threshold([], (1.0, 1.0)) == 0.5
