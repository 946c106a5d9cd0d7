"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates.

Tokens are words and runs of other visible characters. A text's features are its tokens, pairs of
neighbours (a repeated token gives one common feature) and triples of token shapes, hashed into
``WIDTH`` weights; each counts as often as it occurs, divided by the number of tokens. A score is so
a sparse dot product: the mean of the weights that the tokens pick.

The model is fitted in one task on a sample of ``PER_CLASS`` labelled documents of each class at most
(see ``labelled.training_sample``); weights make up for the classes' true shares. Its size is fixed, so it
is collected and sent to all tasks. Scores lie in 0..1; a null or empty text gets that of the bias alone.
Without labelled rows of both classes the score is the share of ones, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import add_columns, map_batches
from marlstone.llm.kernels import MIX_1, MIX_2, WORDS_AND_MARKS, U64, Rolling, lower_table, mix, text_bytes, word_spans
from marlstone.llm.labelled import training_sample

BITS = 18
PER_CLASS = 3000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-6, 1e-4
SCALE = 10.0
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """(three arrays of weight numbers, one entry per token; offsets of each text's tokens)."""
    starts, ends = word_spans(data, offsets, WORDS_AND_MARKS)
    of = np.searchsorted(starts, offsets)
    n = len(starts)
    if not n:
        return [np.zeros(0, np.int64)] * 3, of
    token = Rolling(lower_table()[data]).at(starts, ends)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    capitals, size = upper[ends] - upper[starts], ends - starts
    form = np.where(capitals == 0, 0, np.where(capitals == size, 3, np.where((capitals == 1) & (_UPPER[data[starts]] == 1), 1, 2)))
    shape = (form * 32 + np.minimum(size // 2, 7) * 4 + WORDS_AND_MARKS[data[starts]]).astype(U64)
    first = np.zeros(n, bool)
    first[of[:-1][of[:-1] < n]] = True
    before = np.where(first, U64(1), np.roll(token, 1))
    pair = np.where(before == token, U64(2), mix(before * MIX_1 + token))
    s1 = np.where(first, U64(0), np.roll(shape, 1))
    s2 = np.where(first | np.roll(first, 1), U64(0), np.roll(shape, 2))
    triple = mix((shape * U64(1024) + s1) * U64(1024) + s2 + MIX_2)
    down = U64(64 - bits)
    return [(mix(x + U64(k)) >> down).astype(np.int64) for k, x in enumerate((token, pair, triple))], of


class Leader:
    """Per-coordinate follow-the-regularised-leader; weights come from the accumulated z and n when needed."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * weight * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], weight: dict[int, float], bits: int = BITS) -> np.ndarray:
    """Weights, the bias last."""
    model = Leader((1 << bits) + 1)
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in order.permutation(len(examples)):
            at, x, label = examples[k]
            model.learn(at, x, label, weight[label])
    return model.weights().astype(np.float32)


def examples_of(batch: pa.RecordBatch, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(weight numbers, values, label) of each text."""
    kinds, of = features(*text_bytes(batch.column("text")), bits)
    for k, label in enumerate(batch.column("label").to_pylist()):
        n = of[k + 1] - of[k]
        at, count = np.unique(np.concatenate([x[of[k] : of[k + 1]] for x in kinds]), return_counts=True)
        yield np.append(at, 1 << bits).astype(np.int32), np.append(count * (SCALE / max(n, 1)), 1.0).astype(np.float32), label


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> np.ndarray:
    sample, counts = training_sample(docs, labels, label, per_class)
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        share = min(max(counts.get(1, 0) / sum(counts.values()), 1e-3), 1 - 1e-3) if counts else 0.5
        return np.append(np.zeros(1 << BITS), np.log(share / (1 - share))).astype(np.float32)
    weight = {k: max(1.0, counts[k] / per_class) for k in (0, 1)}
    weight = {k: w / max(weight.values()) for k, w in weight.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((i, e) for b in batches for i, e in zip(b.column("doc_id").to_pylist(), examples_of(b), strict=True)), key=lambda x: x[0])
        yield pa.RecordBatch.from_arrays([pa.array([fit([e for _, e in found], weight).tobytes()], pa.binary())], ["model"])

    # one task gets the sample, whose size is a parameter
    made = map_batches(sample.select("doc_id", "text", "label").coalesce(1), "model binary", run).first()
    return np.frombuffer(made.model, np.float32) if made else np.zeros((1 << BITS) + 1, np.float32)


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def compute(batch: pa.RecordBatch) -> list:
        w = shared.value
        kinds, of = features(*text_bytes(batch.column(text)))
        total = np.concatenate([[0.0], np.cumsum(sum(w[x].astype(np.float64) for x in kinds))])
        mean = (total[of[1:]] - total[of[:-1]]) * SCALE / np.maximum(np.diff(of), 1)
        return [pa.array(1 / (1 + np.exp(-np.clip(mean + float(w[-1]), -30, 30))), pa.float64())]

    return add_columns(docs, [T.StructField(score, T.DoubleType())], compute, (text,))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **parameters) -> DataFrame:
    """docs with score and predicted (1 from the threshold on)."""
    return scored(docs, train(docs, labels, **parameters)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
