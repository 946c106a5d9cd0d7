"""Toxicity: a convolutional text classifier, trained in numpy, with thresholds for each language.

A word's embedding is the sum of those that its hash and the hashes of its beginnings (``PREFIXES`` bytes)
pick from ``1 << BITS``, so that inflected forms of a stem share what is learnt. Filters of the widths in ``WIDTHS`` slide over the words,
each keeps its largest response in the text (max pooling), and a logistic unit weighs these. The
first component of the embeddings starts from the words' log odds in the training texts, the rest
from small random numbers; all are then trained by AdaGrad. As max pooling passes a gradient to one
place per filter, a step costs little however long a text is.

The model is fitted in one task on a sample of ``PER_CLASS`` labelled documents of each class at most.
A fifth of these isn't trained on; it serves to calibrate the logit (slope and offset, so that 0.5 is a
fair cut). Thresholds come from the scores of all labelled rows that weren't trained on, counted in ``BINS``
bins for each language: the smallest one that leaves a share of ``PRECISION`` toxic among those above. A language's own
threshold is averaged with that of all, which weighs as much as ``LEAST`` toxic rows.

Scores lie in 0..1 and depend on the text alone; a null or empty text has no words and gets the
score of padding. Without labels of both classes every score is the share of ones, or 0.5.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import add_columns, kept_in_worker, map_batches, stored, without
from marlstone.llm.kernels import WORD_BYTES, U64, Rolling, lower_table, mix, text_bytes, word_spans
from marlstone.llm.labelled import training_sample, usable_labels

BITS, DIM, FILTERS, WIDTHS, PREFIXES = 16, 12, 8, (1, 2, 3), (4, 6)
PER_CLASS, EPOCHS, RATE = 3000, 4, 0.05
PRECISION, LEAST, BINS = 0.97, 20, 1000
#: Words whose responses are held at once when scoring.
SLICE = 1 << 17


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(embeddings that each word picks, one row per kind, with pads of the widest filter's reach before each text and after the last; starts)."""
    starts, ends = word_spans(data, offsets, WORD_BYTES)
    of = np.searchsorted(starts, offsets)
    pad, n = max(WIDTHS) - 1, len(offsets) - 1
    out = np.full((1 + len(PREFIXES), len(starts) + pad * (n + 1)), 1 << BITS, np.int64)
    if len(starts):
        rolling = Rolling(lower_table()[data])
        to = np.arange(len(starts)) + pad * (np.repeat(np.arange(n), np.diff(of)) + 1)
        for k, size in enumerate((None, *PREFIXES)):
            hashes = rolling.at(starts, ends if size is None else np.minimum(ends, starts + size))
            out[k, to] = (mix(hashes + U64(k)) >> U64(64 - BITS)).astype(np.int64)
    return out, of + pad * np.arange(n + 1)


class Net:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.words = rng.normal(0, 0.05, ((1 << BITS) + 1, DIM)).astype(np.float32)
        self.words[-1] = 0
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, 0] = 1.0 / len(f)
        self.out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.bias, self.slope, self.offset = 0.0, 1.0, 0.0

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in one padded text, and where."""
        e = self.words[at].sum(axis=0)
        pooled, where = [], []
        n = at.shape[1] - max(WIDTHS) + 1
        for f in self.filters:
            r = sum(e[o : o + n] @ f[o] for o in range(len(f)))
            k = r.argmax(axis=0)
            where.append(k)
            pooled.append(r[k, np.arange(FILTERS)])
        return np.concatenate(pooled), np.concatenate(where)

    def train(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        size = (1 << BITS) + 1
        seen = np.zeros((2, size))
        for at, y in zip(texts, labels, strict=True):
            seen[y, np.unique(at)] += 1
        total = np.bincount(labels, minlength=2)
        both = seen.sum(axis=0)
        # a word of few texts says little
        self.words[:, 0] = np.clip(np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1)), -3, 5) * both / (both + 10)
        self.words[-1] = 0
        g_words, g_filters, g_out, g_bias = np.full(self.words.shape, 1e-4, np.float32), [np.full(f.shape, 1e-4, np.float32) for f in self.filters], np.full(self.out.shape, 1e-4), 1e-4
        order = np.random.default_rng(1)
        for _ in range(EPOCHS):
            for k in order.permutation(len(texts)):
                at = texts[k]
                pooled, where = self.place(at)
                d = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30))) - labels[k]
                down, g = d * self.out, d * pooled
                g_out += g * g
                self.out -= (RATE * g / np.sqrt(g_out)).astype(np.float32)
                g_bias += d * d
                self.bias -= RATE * d / np.sqrt(g_bias)
                for i, f in enumerate(self.filters):
                    part, spot = down[i * FILTERS : (i + 1) * FILTERS], where[i * FILTERS : (i + 1) * FILTERS]
                    for o in range(len(f)):
                        kinds = at[:, spot + o]
                        g = (self.words[kinds].sum(axis=0) * part[:, None]).T
                        back = (f[o] * part).T
                        g_filters[i][o] += g * g
                        f[o] -= RATE * g / np.sqrt(g_filters[i][o])
                        for rows in kinds:
                            real = rows < size - 1
                            np.add.at(g_words, rows[real], back[real] ** 2)
                            np.subtract.at(self.words, rows[real], RATE * back[real] / np.sqrt(g_words[rows[real]]))

    def tables(self) -> list[list[np.ndarray]]:
        """Response of each word at each place of each filter, so that scoring only adds rows."""
        return [[self.words @ f[o] for o in range(len(f))] for f in self.filters]

    def logits(self, at: np.ndarray, starts: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        """Of padded texts, one after another; no filter reaches from one text over the pad into the next."""
        tables = tables or self.tables()
        n = len(starts) - 1
        out = np.zeros((n, len(self.out)), np.float32)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + SLICE, "right")) - 1)
            lo, size = starts[first], starts[last] - starts[first]
            for i, table in enumerate(tables):
                r = np.zeros((size, FILTERS), np.float32)
                for o in range(len(table)):
                    for kind in at:
                        r += table[o][kind[lo + o : lo + o + size]]
                out[first:last, i * FILTERS : (i + 1) * FILTERS] = np.maximum.reduceat(r, starts[first:last] - lo, axis=0)
            first = last
        return out @ self.out + self.bias

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Fit slope and offset by Newton steps on the weighted samples."""
        x = np.stack([logits, np.ones_like(logits)], axis=1).astype(np.float64)
        c = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            h = (x * (weights * p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.05
            step = np.linalg.solve(h, x.T @ (weights * (p - labels)) + c * 0.05)
            c -= np.clip(step, -1, 1)
        self.slope, self.offset = max(float(c[0]), 1e-3), float(c[1])

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits.astype(np.float64) + self.offset, -30, 30)))

    def packed(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, words=self.words.astype(np.float16), out=self.out, numbers=np.array([self.bias, self.slope, self.offset]), **{f"f{i}": x for i, x in enumerate(self.filters)})
        return f.getvalue()

    @classmethod
    def unpacked(cls, content: bytes) -> Net:
        net, f = cls(), np.load(io.BytesIO(content))
        net.words, net.out, net.filters = f["words"].astype(np.float32), f["out"], [f[f"f{i}"] for i in range(len(WIDTHS))]
        net.bias, net.slope, net.offset = map(float, f["numbers"])
        return net


def constant(share: float) -> Net:
    """Gives every text this score."""
    net = Net()
    net.words[:], net.out[:], net.slope, net.offset = 0, 0, 1.0, float(np.log(share / (1 - share)))
    return net


def threshold(bins: list[tuple[int, float, float, int, int]], weights: tuple[float, float]) -> float:
    """The cut for scores counted in bins (bin, least score, largest score, harmless rows, toxic rows)."""
    if not bins:
        return 0.5
    bins = sorted(bins, reverse=True)
    toxic = np.cumsum([x[4] * weights[1] for x in bins])
    good = np.flatnonzero(toxic >= PRECISION * (toxic + np.cumsum([x[3] * weights[0] for x in bins])))
    at = good[-1] if len(good) else 0
    below = bins[at + 1][2] if at + 1 < len(bins) else 0.0
    # no bin is clean: above the highest one's scores as far as they are known
    return float(np.clip((bins[at][1] + below) / 2 if len(good) else bins[0][2], 0.05, 0.95))


def thresholds(found: DataFrame, labels: DataFrame, trained: list[int], label: str = "toxic", lang: str = "lang") -> dict[str, float]:
    """By language, and of all under an empty name, from the scores of all usable labelled rows that weren't trained on."""
    usable = usable_labels(labels, label)
    counts = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    ids = usable.sparkSession.createDataFrame([(i,) for i in trained], "doc_id long")
    code = F.col(lang) if lang in found.columns else F.lit(None).cast("string")
    # at most twice per_class ids
    rows = found.select("doc_id", F.struct("score", code.cast("string").alias("lang")).alias("x")).join(usable.join(F.broadcast(ids), "doc_id", "left_anti"), "doc_id").groupBy("doc_id", "label").agg(F.min("x").alias("x"))
    placed = rows.select("label", "x.*", F.floor(F.col("x.score") * BINS).alias("bin")).groupBy("lang", "bin").agg(F.min("score"), F.max("score"), F.count(F.when(F.col("label") == 0, 1)), F.count(F.when(F.col("label") == 1, 1)))
    by: dict[str | None, list] = {}
    every: dict[int, tuple] = {}
    for code, *x in placed.collect():
        by.setdefault(code, []).append(tuple(x))
        old = every.get(x[0], (x[0], 1.0, 0.0, 0, 0))
        every[x[0]] = (x[0], min(old[1], x[1]), max(old[2], x[2]), old[3] + x[3], old[4] + x[4])
    # the two classes as they are among all labelled rows
    weights = tuple(counts.get(k, 0) / max(sum(x[3 + k] for x in every.values()), 1) for k in (0, 1))
    whole = threshold(list(every.values()), weights)
    out = {"": whole}
    for code, bins in sorted((k, v) for k, v in by.items() if k):
        n = sum(x[4] for x in bins)
        out[code] = (n * threshold(bins, weights) + LEAST * whole) / (n + LEAST)
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> bytes:
    """The packed model; its size is fixed."""
    return fitted(docs, labels, label, per_class)[0]


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> tuple[bytes, list[int]]:
    """The packed model and the ids that it was trained on; none for a constant one."""
    sample, counts = training_sample(docs, labels, label, per_class)
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return constant(min(max(counts.get(1, 0) / sum(counts.values()), 1e-3), 1 - 1e-3) if counts else 0.5).packed(), []
    weight = [max(1.0, counts[k] / per_class) for k in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            at, starts = word_numbers(*text_bytes(b.column("text")))
            for k, (i, y) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), strict=True)):
                rows.append((i, at[:, starts[k] : starts[k + 1] + max(WIDTHS) - 1].astype(np.int32), y))
        rows.sort(key=lambda r: r[0])
        labels = np.array([r[2] for r in rows], np.int64)
        aside = np.zeros(len(rows), bool)
        for y in (0, 1):
            aside[np.flatnonzero(labels == y)[::5]] = True
        net = Net()
        net.train([r[1] for r, a in zip(rows, aside, strict=True) if not a], labels[~aside])
        logits = np.array([net.place(r[1])[0] @ net.out + net.bias for r, a in zip(rows, aside, strict=True) if a])
        net.calibrate(logits, labels[aside], np.array(weight)[labels[aside]])
        yield pa.RecordBatch.from_arrays([pa.array([net.packed()], pa.binary()), pa.array([[r[0] for r, a in zip(rows, aside, strict=True) if not a]], pa.list_(pa.int64()))], ["model", "trained"])

    # one task gets the sample, whose size is a parameter
    made = map_batches(sample.coalesce(1), "model binary, trained array<long>", run).first()
    return (bytes(made.model), list(made.trained)) if made else (constant(0.5).packed(), [])


_models: dict[int, tuple[Net, list]] = {}
kept_in_worker(_models.clear)


def scored(docs: DataFrame, model: bytes, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list:
        content = shared.value
        if (key := hash(content)) not in _models:
            _models.clear()
            net = Net.unpacked(content)
            _models[key] = net, net.tables()
        net, tables = _models[key]
        return [pa.array(net.scores(net.logits(*word_numbers(*text_bytes(batch.column(text))), tables)), pa.float64())]

    return add_columns(docs, [T.StructField(score, T.DoubleType())], compute, (text,))


def classify(docs: DataFrame, labels: DataFrame, lang: str = "lang", dropping: tuple[str, ...] = (), **parameters) -> DataFrame:
    """docs with score, predicted (1 from 0.5 on), and flagged: whether the score reaches the threshold of the text's language.

    Scores are stored with the other columns, without those to drop, as both thresholds and result read them;
    so texts are scored once.
    """
    model, trained = fitted(docs, labels, **parameters)
    out = without(scored(docs, model), *dropping)
    cuts = {"": 0.5}
    if trained:
        out = stored(out)
        cuts = thresholds(out, labels, trained, parameters.get("label", "toxic"), lang)
    cut = F.lit(cuts[""])
    for code, value in cuts.items():
        if code and lang in docs.columns:
            cut = F.when(F.col(lang) == code, value).otherwise(cut)
    return out.withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "flagged": F.col("score") >= cut})
