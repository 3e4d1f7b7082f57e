"""Operator 5, quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams are scaled by the log ratio of their smoothed counts in the two classes; on these a
linear model with hinge loss is fitted by dual coordinate descent. The fit uses a bounded sample of labelled rows;
every document's whole text is scored in one scan, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import quoted, slices, tidy

#: Bits of the hashed feature space: the model is two arrays of 2**BITS numbers, whatever the corpus.
BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BY_KIND = np.uint64(0xD6E8FEB86659FD93)
_RUNS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Longer runs of non-blank characters are cut into consecutive chunks of so many, which all give features.
CHUNK = 80


def chunks_of(text: str) -> list[str]:
    """Runs of non-blank characters, long ones in pieces."""
    runs = text.split()
    if len(max(runs, key=len, default="")) <= CHUNK:
        return runs
    return [r[at : at + CHUNK] for r in runs for at in range(0, len(r), CHUNK)]


def shape(chunk: str) -> str:
    """Word shape: runs of letters as X, Xx or x, digits as 9, other characters kept up to three of a run."""
    out = []
    for run in _RUNS.findall(chunk):
        if run[0].isalpha():
            out.append("X" if run.isupper() and len(run) > 1 else "Xx" if run[0].isupper() else "x")
        elif run[0].isdigit():
            out.append("9")
        else:
            out.append(run[:3])
    return "".join(out)


class Features:
    """Text -> sorted distinct numbers of its n-grams: words, word pairs, shapes, shape pairs and triples, lengths.

    A word is a run of non-blank characters; one of more than CHUNK characters is cut into consecutive words.
    """

    def __init__(self, bits: int = BITS, limit: int = 200_000):
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.mask, self.limit = np.uint64((1 << bits) - 1), limit
        self.seen: dict[str, int] = {}
        self._new()

    def _new(self) -> None:
        self.seen.clear()
        self.words = np.zeros(1024, np.uint64)
        self.shapes = np.zeros(1024, np.uint64)

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        if len(self.seen) > self.limit:
            self._new()
        new = [c for c in set(chunks) if c not in self.seen]
        if new:
            first = len(self.seen)
            if first + len(new) > len(self.words):
                room = max(first + len(new), 2 * len(self.words)) - len(self.words)
                self.words, self.shapes = (np.concatenate([a, np.zeros(room, np.uint64)]) for a in (self.words, self.shapes))
            for i, c in enumerate(new, first):
                self.seen[c] = i
                self.words[i] = self.hash(c.lower().strip(".,;:!?\"'()"))
                self.shapes[i] = self.hash("/" + shape(c))
        return np.fromiter(map(self.seen.__getitem__, chunks), np.int64, len(chunks))

    def __call__(self, text: str) -> np.ndarray:
        chunks = chunks_of(text)
        if not chunks:
            return np.zeros(0, np.int64)
        at = self._numbers(chunks)
        with np.errstate(over="ignore"):
            w, s = self.words[at], self.shapes[at]
            pair = s[:-1] * _MIX + s[1:]
            grams = [w, w[:-1] * _MIX + w[1:] + _BY_KIND, s, pair, pair[:-1] * _MIX + s[2:]]
            lines = text.count("\n") + 1
            sizes = [f"len{len(chunks).bit_length()}", f"line{(len(chunks) // lines).bit_length()}", f"distinct{len(np.unique(at)) * 8 // len(chunks)}"]
            grams.append(np.array([self.hash(x) for x in sizes], np.uint64))
            g = np.concatenate(grams) * _MIX
            return np.unique((g >> np.uint64(40)) & self.mask).astype(np.int64)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))); margin = weights over features / sqrt(features) + bias."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, features: np.ndarray) -> float:
        margin = self.bias + (self.weights[features].sum() / np.sqrt(len(features)) if len(features) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, c: float = 1.0, epochs: int = 30, smooth: float = 1.0, seed: int = 17, tolerance: float = 1e-3) -> Model:
    """Fit on features and 0/1 labels. With one class only, every text gets that class's smoothed share.

    The squared-hinge dual min 1/2 |w|^2 + sum a_i^2 / (4 c_i) - sum a_i is solved one coordinate at a time; classes
    weigh alike; rounds end when none moves by ``tolerance``. The margins of three held-out folds then fit the two numbers of the logistic score.
    """
    labels = np.asarray(labels, int)
    dim, positive = 1 << bits, int(labels.sum())
    if not 0 < positive < len(labels):
        share = (positive + 1) / (len(labels) + 2)
        return Model(np.zeros(dim), 0.0, 0.0, float(np.log(share / (1 - share))))

    def solve(idx: np.ndarray) -> tuple[np.ndarray, float]:
        y = np.where(labels[idx] == 1, 1.0, -1.0)
        counts = [np.full(dim, smooth), np.full(dim, smooth)]
        for i in idx:
            counts[labels[i]][rows[i]] += 1
        n = [max(1, int((labels[idx] == k).sum())) for k in (0, 1)]
        ratio = np.log((counts[1] / (n[1] + 2 * smooth)) / (counts[0] / (n[0] + 2 * smooth)))
        xs = [ratio[rows[i]] / np.sqrt(max(1, len(rows[i]))) for i in idx]
        weight = np.where(y > 0, len(idx) / (2 * n[1]), len(idx) / (2 * n[0])) * c
        square = np.array([x @ x for x in xs]) + 1 + 1 / (2 * weight)
        w, b, a, order = np.zeros(dim), 0.0, np.zeros(len(idx)), np.random.default_rng(seed)
        for _ in range(epochs):
            moved = 0.0
            for j in order.permutation(len(idx)):
                f, x = rows[idx[j]], xs[j]
                g = y[j] * (w[f] @ x + b) - 1 + a[j] / (2 * weight[j])
                new = max(0.0, a[j] - g / square[j])
                if (step := new - a[j]) != 0:
                    w[f] += step * y[j] * x
                    b += step * y[j]
                    a[j] = new
                    moved = max(moved, abs(step))
            if moved < tolerance:
                break
        return w * ratio, b

    def margins(model: tuple[np.ndarray, float], idx: np.ndarray) -> np.ndarray:
        return np.array([model[1] + model[0][rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) for i in idx])

    everything, fold = np.arange(len(rows)), np.random.default_rng(seed).integers(0, 3, len(rows))
    m = np.zeros(len(rows))
    for k in range(3):
        if 0 < labels[fold != k].sum() < (fold != k).sum() and (fold == k).any():
            m[fold == k] = margins(solve(everything[fold != k]), everything[fold == k])
    slope, shift, target = 1.0, 0.0, np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    for _ in range(100):  # Newton steps for the logistic of the margins, each class with half the weight
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
        weight = np.where(labels == 1, len(labels) / (2 * positive), len(labels) / (2 * (len(labels) - positive)))
        d, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        grad = np.array([d @ m, d.sum()]) + 1e-3 * np.array([slope - 1, shift])
        hess = np.array([[h @ (m * m), h @ m], [h @ m, h.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        slope, shift = slope - step[0], shift - step[1]
        if abs(step).max() < 1e-8:
            break
    w, b = solve(everything)
    return Model(w, b, float(max(slope, 1e-3)), float(shift))


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            found = [features(t or "").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["label", "features"])

    return tidy(run)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4000, bits: int = BITS) -> Model:
    """Fit on at most ``max_rows`` labelled documents of each class, those whose hashed doc_id comes first.

    Only documents whose crc32(doc_id as text) mod 5 is not 0 are used, labels other than 0 and 1 are none, and of the texts
    of a repeated doc_id the smallest counts. The bound limits the fit alone.
    """
    known = labels.where(F.col(label).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.round(F.avg(F.col(label).cast("double"))).cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").alias("__doc"), "text")
    order = F.xxhash64("doc_id", F.lit(5))
    # At most 2 * max_rows ids: a proven bound for the broadcast.
    sample = known.where("label = 1").orderBy(order).limit(max_rows).unionByName(known.where("label <> 1").orderBy(order).limit(max_rows))
    sampled = texts.join(F.broadcast(sample), F.col("__doc") == F.col("doc_id")).groupBy("__doc").agg(F.max("label").alias("label"), F.min(F.col("text").cast("string")).alias("text"))
    sampled = sampled.select(F.col("label").cast("int"), "text")
    rows = sampled.mapInArrow(_features(bits), "label int, features array<int>").toArrow()
    order_rows = sorted(zip(rows.column(0).to_pylist(), (np.asarray(x.values, np.int64) for x in rows.column(1)), strict=True), key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return fit([r[1] for r in order_rows], np.array([r[0] for r in order_rows], int), bits)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, max_rows: int = 4000, name: str = "score") -> DataFrame:
    """``docs`` with held_out, ``name`` (double, 0 to 1) and predicted (1 if the score is at least ``cut``, else 0).

    The score is a function of the text alone; null text is empty and gets the score of no n-grams. A null doc_id is
    held out. Labels other than 0 and 1 do not count; documents with several take the rounded mean; with no labels or one
    class all scores are alike. Repeated rows get a row each, other columns stay (held_out, score and predicted are replaced).
    """
    from pyspark.sql import types as T

    model = train(docs, labels, label, max_rows)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.slope, model.shift))
    columns = [c for c in docs.columns if c.lower() not in ("held_out", name, "predicted")]
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own = Features(), Model(*sent.value)
        for batch in batches:
            for rows in slices(batch, at):
                text = rows.column(at).to_pylist()
                scores = pa.array([own.score(features(t or "")) for t in text], pa.float64())
                yield pa.RecordBatch.from_arrays([*rows.columns, scores], [*columns, name])

    base = docs.select(*(quoted(c) for c in columns))
    schema = T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return base.mapInArrow(tidy(run), schema).withColumn("held_out", held).withColumn("predicted", (F.col(name) >= cut).cast("int"))
