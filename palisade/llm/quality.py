"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

``score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])``,
the pairwise part by the sum-of-squares identity, so a text costs time linear in its features.

The model is fitted on a sample of labelled rows (``FIT_ROWS`` at most, those smallest by a
hash of their id, so the choice does not depend on order or partitioning); it has a fixed
number of weights, whatever the corpus. Scoring covers every row and whole texts, in one
pass without a shuffle.
"""
from __future__ import annotations

import math
import operator
import string
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import SLICE_ROWS, map_batches

# Labelled rows a model is fitted on, at most.
FIT_ROWS = 8_000
BUCKETS = 1 << 15
FACTORS = 8
_STRUCTURE = 16
_UPPER = string.ascii_uppercase.encode()
_DIGITS = string.digits.encode()
_SYMBOLS = string.punctuation.encode()
_SPACES = string.whitespace.encode()
_UNUSUAL = bytes(set(_SYMBOLS) - set(b".,;:?'\"()-"))
# Words whose buckets a worker remembers, at most.
_SEEN = 200_000


def features(
    text: str | None, metadata: Sequence[float | None], seen: dict[bytes, int] | None = None,
) -> tuple[list[int], list[float]]:
    """Sparse ``(indices, values)``. Words are unit-length term weights; structure statistics
    and metadata follow them, each near [-1, 1]. A null text counts as empty, a null or
    non-finite metadata value as absent. ``seen`` remembers the buckets of words."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    counts = Counter(words)
    seen = {} if seen is None else seen
    buckets = []
    for word in counts:
        bucket = seen.get(word)
        if bucket is None:
            bucket = seen[word] = zlib.crc32(word.lower()) % BUCKETS
        buckets.append(bucket)
    weights = 1.0 + np.log(np.fromiter(counts.values(), dtype=float, count=len(counts)))
    if len(weights):
        weights /= math.sqrt(float(weights @ weights))
    values = weights.tolist()
    for i, v in enumerate(_structure(data, words, counts)):
        if v:
            buckets.append(BUCKETS + i)
            values.append(v)
    for i, v in enumerate(metadata):
        if v is not None and math.isfinite(v):
            buckets.append(BUCKETS + _STRUCTURE + i)
            values.append(math.copysign(math.log1p(abs(v)) / 10, v))
    return buckets, values


def _structure(data: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Shares of character classes, repeats and lengths; bytes beyond ASCII count as letters."""
    size, n = len(data), len(words)
    if not n:
        return [1.0] + [0.0] * (_STRUCTURE - 1)
    upper, digits, symbols, spaces = (
        size - len(data.translate(None, some)) for some in (_UPPER, _DIGITS, _SYMBOLS, _SPACES))
    letters = size - digits - symbols - spaces
    unusual = size - len(data.translate(None, _UNUSUAL))
    lines = data.split(b"\n")
    return [
        0.0, 1.0,
        letters / size, upper / max(1, letters), digits / size, symbols / n / 3,
        unusual / n, sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), len(counts) / n, max(counts.values()) / n,
        letters / n / 10, math.log1p(n) / 10, math.log1p(size / len(lines)) / 10,
        min(size / n / 20, 1.0), spaces / size,
    ]


@dataclass
class FactorisationMachine:
    """Weights for ``size`` features and ``FACTORS`` latent dimensions."""
    bias: float
    linear: np.ndarray
    latent: np.ndarray

    def logits(self, starts: np.ndarray, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Logits of rows whose features lie in ``indices[starts[i]:starts[i + 1]]``; each row
        has at least one feature."""
        x = values[:, None] * self.latent[indices]
        sums = np.add.reduceat(x, starts, axis=0)
        squares = np.add.reduceat(x * x, starts, axis=0)
        first = np.add.reduceat(values * self.linear[indices], starts)
        return self.bias + first + 0.5 * (sums * sums - squares).sum(axis=1)


def fit(
    rows: Sequence[tuple[Sequence[int], Sequence[float]]], labels: Sequence[int], size: int,
    epochs: int = 5, batch: int = 64, rate: float = 0.05, decay: float = 1e-5,
) -> FactorisationMachine:
    """AdaGrad on the logistic loss. No rows, or rows of one class, give a constant score that
    leans to that class."""
    random = np.random.default_rng(11)
    model = FactorisationMachine(
        0.0, np.zeros(size), random.normal(0, 0.01, (size, FACTORS)))
    y = np.asarray(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        model.bias = 0.0 if not len(y) else (2.0 if y[0] else -2.0)
        model.latent[:] = 0
        return model
    seen_linear, seen_latent, seen_bias = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    order = np.arange(len(y))
    for _ in range(epochs):
        random.shuffle(order)
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            lengths = np.array([len(rows[i][0]) for i in chosen])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            indices = np.concatenate([np.asarray(rows[i][0], dtype=np.int64) for i in chosen])
            values = np.concatenate([np.asarray(rows[i][1], dtype=float) for i in chosen])
            p = 1 / (1 + np.exp(-np.clip(model.logits(starts, indices, values), -30, 30)))
            error = np.repeat((p - y[chosen]) / len(chosen), lengths)
            x = values[:, None] * model.latent[indices]
            sums = np.repeat(np.add.reduceat(x, starts, axis=0), lengths, axis=0)
            g_latent = error[:, None] * values[:, None] * (sums - x)
            g_linear = error * values
            touched, where = np.unique(indices, return_inverse=True)
            total = np.zeros((len(touched), FACTORS))
            np.add.at(total, where, g_latent)
            total += decay * model.latent[touched]
            seen_latent[touched] += total ** 2
            model.latent[touched] -= rate * total / np.sqrt(seen_latent[touched])
            flat = np.bincount(where, g_linear, len(touched)) + decay * model.linear[touched]
            seen_linear[touched] += flat ** 2
            model.linear[touched] -= rate * flat / np.sqrt(seen_linear[touched])
            g = float((p - y[chosen]).mean())
            seen_bias += g * g
            model.bias -= rate * g / math.sqrt(seen_bias)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
    text_col: str = "text", metadata: Sequence[str] = (), max_rows: int = FIT_ROWS,
) -> FactorisationMachine:
    """A model from at most ``max_rows`` labelled ids outside the held-out third.

    Null ids and labels are left out; an id with several labels counts as its largest, one
    with several texts as the smallest of them. The chosen ids are joined as a broadcast, which
    ``max_rows`` bounds."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    texts = (
        docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id"))
        .groupBy("_id", "_label").agg(F.min(F.struct(
            F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
            *(F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(metadata)))
        ).alias("_r")).select("_id", "_label", "_r.*"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [c.to_pylist() for c in batch.columns]
        found = [features(t, m) for t, *m in zip(*columns[2:])]
        return pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1),
            pa.array([i for i, _ in found], pa.list_(pa.int32())),
            pa.array([v for _, v in found], pa.list_(pa.float32())),
        ], names=["id", "label", "indices", "values"])

    sample = map_batches(
        texts, run, "id bigint, label int, indices array<int>, values array<float>")
    table = sample.toArrow().sort_by("id")
    flat = [table.column(c).combine_chunks() for c in ("indices", "values")]
    rows = [
        (i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(flat[0], flat[1])]
    return fit(rows, table.column("label").to_pylist(), BUCKETS + _STRUCTURE + len(metadata))


def score_batch(
    model: FactorisationMachine, texts: Sequence[str | None],
    metadata: Sequence[Sequence[float | None]],
) -> np.ndarray:
    """Scores in (0, 1)."""
    if not len(texts):
        return np.zeros(0)
    seen: dict[bytes, int] = {}
    found = []
    for text, extra in zip(texts, metadata):
        found.append(features(text, extra, seen))
        if len(seen) > _SEEN:
            seen.clear()
    lengths = np.array([len(i) for i, _ in found])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    total = int(lengths.sum())
    indices = np.fromiter(chain.from_iterable(i for i, _ in found), np.int64, total)
    values = np.fromiter(chain.from_iterable(v for _, v in found), float, total)
    return 1 / (1 + np.exp(-np.clip(model.logits(starts, indices, values), -30, 30)))


def _scores(model: FactorisationMachine, batch: pa.RecordBatch, text: int, metadata: list[int]):
    texts = batch.column(text).to_pylist()
    columns = [batch.column(i).cast(pa.float64(), safe=False).to_pylist() for i in metadata]
    return score_batch(model, texts, list(zip(*columns)) if columns else [()] * len(texts))


def score(
    docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id",
    text_col: str = "text", metadata: Sequence[str] = (),
) -> DataFrame:
    """``doc_id``, ``score`` of each row, repeated rows and null ids included; empty and null
    texts have a score as well. Other columns than those named are ignored."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = _scores(model, batch, 1, list(range(2, 2 + len(metadata))))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    narrow = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"),
        *(F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(metadata)))
    return map_batches(narrow, run, "doc_id bigint, score double")


def keep_good(
    docs: DataFrame, model: FactorisationMachine, text_col: str = "text",
    metadata: Sequence[str] = (), threshold: float = 0.5,
) -> DataFrame:
    """The rows scored at least ``threshold``, all columns as they were. Null texts are scored as
    empty ones; repeated rows and null ids stay or go by their own score."""
    columns = docs.columns
    text, extra = columns.index(text_col), [columns.index(c) for c in metadata]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_scores(model, batch, text, extra) >= threshold))

    return docs.mapInArrow(
        lambda batches: (run(b.slice(i, SLICE_ROWS)) for b in batches
                         for i in range(0, b.num_rows, SLICE_ROWS)), docs.schema)
