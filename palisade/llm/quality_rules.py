"""Quality rules: plain limits on document statistics, then boosted trees over them.

Rules of thumb reject what no model needs to see. The rest is judged by gradient-boosted trees on
statistics of the text, learned from labels: Newton steps on the logistic loss, splits from
histograms of quantile bins, monotonic where a statistic can only speak against a text. All trees
lie in flat numpy arrays of nodes and are walked together, level by level, for a whole batch.
"""
from __future__ import annotations

import string
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import map_batches
from palisade.llm.quality import held_out

# Labelled rows a model is fitted on, at most.
FIT_ROWS = 8_000
LEAST_WORDS, MOST_REPEATED = 50, 50
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_FOLLOWING = bytes(range(0x80, 0xC0))
_UPPER, _DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
_MARKS = bytes(set(string.punctuation.encode()) - set(_SYMBOLS))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Statistics the trees see, and which way a score may follow them: -1 never up, 0 either way.
FEATURES = {
    "symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1,
    "neighbour_repeat_share": -1, "top_word_share": 0, "distinct_share": 0, "mean_word": 0,
    "long_word_share": 0, "upper_share": 0, "digit_share": 0, "marks_per_word": 0,
    "words_per_line": 0, "capital_word_share": 0, "lone_mark_share": 0, "words": 0}


def repeated_words(ids: np.ndarray, size: int) -> int:
    """How many words stand in a window of three that occurs again; ``ids`` number the words,
    below ``size``."""
    if len(ids) < 3:
        return 0
    _, pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
    _, which, counts = np.unique(
        pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    inside = np.zeros(len(ids), bool)
    for shift in range(3):
        inside[shift:shift + len(again)] |= again
    return int(inside.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of a text; null is empty. Words are what stands between
    ASCII white space."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0, 0, size - len(data.translate(None, _SYMBOLS)), 0, 0], [0.0] * len(FEATURES)
    word_chars = len(data.translate(None, _SPACES + _FOLLOWING))
    symbols, upper, digits, marks = (
        size - len(data.translate(None, some)) for some in (_SYMBOLS, _UPPER, _DIGITS, _MARKS))
    counts = Counter(words)
    index = dict(zip(counts, range(len(counts))))
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    repeats = repeated_words(ids, len(counts))
    lines = [line for line in data.split(b"\n") if line.split(None, 1)]
    dup_lines = len(lines) - len(set(lines))
    lengths = np.fromiter(map(len, words), np.int64, n)
    firsts = bytes([w[0] for w in words])
    lone = sum(counts[w] for w in counts if not w.translate(None, _MARKS + _SYMBOLS))
    return [n, word_chars, symbols, dup_lines, repeats], [
        symbols / n, dup_lines / len(lines), repeats / n, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        max(counts.values()) / n, len(counts) / n, word_chars / n, float((lengths > 14).mean()),
        upper / size, digits / size, marks / n, n / len(lines),
        (n - len(firsts.translate(None, _UPPER))) / n, lone / n, float(n)]


@dataclass
class Trees:
    """Nodes of all trees in flat arrays: a row goes to ``left`` if its value of ``feature`` is at
    most ``threshold``, else to the node after that; a leaf leads to itself."""
    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """One level of all trees a step, for all rows."""
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        row = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            right = rows[row, self.feature[at]] > self.threshold[at]
            # A leaf's threshold is infinite, so that it leads to its left: itself.
            at = self.left[at] + right
        return self.bias + self.value[at].sum(axis=1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -30, 30)))


def constant(bias: float) -> Trees:
    none = np.zeros(0, np.int64)
    return Trees(bias, none, np.zeros(0), none, np.zeros(0), none, 0)


def fit(
    rows: np.ndarray, labels: np.ndarray, monotone: Sequence[int], n_trees: int = 60,
    depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 1.0, ridge: float = 1.0,
) -> Trees:
    """Boosted trees on the logistic loss. No rows, or rows of one class, give a constant score
    that leans to that class. Each node keeps bounds for its values; a split on a monotonic
    feature parts them in the middle between its sides, so no tree below can break the order."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return constant(0.0 if not len(y) else 2.0 if y[0] else -2.0)
    rows = np.asarray(rows, float)
    n, width = rows.shape
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
            for f in range(width)]
    binned = np.column_stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)])
    flat = binned + np.arange(width) * (bins + 1)
    rate_good = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(rate_good / (1 - rate_good)))
    logit = np.full(n, bias)
    feature, threshold, left, value, roots = [], [], [], [], []
    sign = np.asarray(monotone)

    def node() -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(left))
        value.append(0.0)
        return len(left) - 1

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        roots.append(node())
        # Node, its rows, the bounds of its values, its level.
        open_ = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while open_:
            at, inside, low, high, level = open_.pop()
            total_g, total_h = g[inside].sum(), h[inside].sum()
            best = min(max(total_g / (total_h + ridge), low), high)
            found = None
            if level < depth and len(inside) > 1:
                size = width * (bins + 1)
                cells = flat[inside].ravel()
                sums = [np.bincount(cells, np.repeat(v[inside], width), size).reshape(width, -1)
                        for v in (g, h)]
                gl, hl = (np.cumsum(s, axis=1)[:, :-1] for s in sums)
                gr, hr = total_g - gl, total_h - hl
                with np.errstate(divide="ignore", invalid="ignore"):
                    wl, wr = (np.clip(a / (b + ridge), low, high) for a, b in ((gl, hl), (gr, hr)))
                gain = sum(2 * a * w - (b + ridge) * w * w for a, b, w in ((gl, hl, wl), (gr, hr, wr)))
                gain -= 2 * total_g * best - (total_h + ridge) * best * best
                ok = (hl >= least) & (hr >= least) & ((wr - wl) * sign[:, None] >= 0)
                ok &= np.arange(bins)[None, :] < np.array([len(c) for c in cuts])[:, None]
                gain = np.where(ok, gain, -np.inf)
                f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[f, b] > 1e-9:
                    found = int(f), int(b), float(wl[f, b]), float(wr[f, b])
            if found is None:
                value[at] = rate * best
                logit[inside] += value[at]
                continue
            f, b, a_value, b_value = found
            first, second = node(), node()
            feature[at], threshold[at], left[at] = f, float(cuts[f][b]), first
            goes = binned[inside, f] <= b
            middle = (a_value + b_value) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)),
                      -1: ((middle, high), (low, middle))}[int(sign[f])]
            for child, take, limit in zip((first, second), (goes, ~goes), bounds):
                open_.append((child, inside[take], *limit, level + 1))
    return Trees(bias, np.array(feature), np.array(threshold), np.array(left), np.array(value),
                 np.array(roots), depth)


def learn(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
    text_col: str = "text", max_rows: int = FIT_ROWS,
) -> Trees:
    """Trees from at most ``max_rows`` labelled ids outside the held-out third, those smallest by
    a hash of their id.

    Null ids and labels are left out; an id with several labels counts as its largest, one with
    several texts as the smallest of them. The chosen ids are joined as a broadcast, which
    ``max_rows`` bounds. No labels give a constant."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    texts = (
        docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).groupBy("_id", "_label")
        .agg(F.min(F.coalesce(F.col(text_col), F.lit(""))).alias("_text")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1),
            pa.array([statistics(t)[1] for t in batch.column(2).to_pylist()], pa.list_(pa.float64())),
        ], names=["id", "label", "row"])

    found = map_batches(texts, run, "id bigint, label int, row array<double>").toArrow().sort_by("id")
    rows = np.array(found.column("row").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(rows, np.array(found.column("label").to_pylist(), float), list(FEATURES.values()))


def _judged(model: Trees, texts: pa.Array, least_words: int, most_repeated: int):
    """Base counts, which rows fail by them, and scores."""
    base, rows = zip(*map(statistics, texts.to_pylist()))
    base = np.array(base, np.int64)
    failed = (base[:, 0] < least_words) | (100 * base[:, 4] > most_repeated * base[:, 0])
    return base, failed, model.scores(np.array(rows, float))


def judge(
    docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = 0.5, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED,
) -> DataFrame:
    """Per row ``doc_id``, ``n_words`` and the other base counts, ``base_failed``, ``score`` (of
    the trees, 0 to 1), ``kept``.

    A text fails the base rules with fewer than ``least_words`` words or more than
    ``most_repeated`` per cent of them in repeated windows; it is kept if it passes and scores
    ``threshold`` at least. Null and empty texts have no words and fail; repeated rows and null
    ids are judged each on their own; other columns are ignored; an empty table gives no rows.
    One pass over whole texts, no shuffle; a text's words are held one text at a time."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, failed, scores = _judged(model, batch.column(1), least_words, most_repeated)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(scores),
             pa.array(~failed & (scores >= threshold))],
            names=["doc_id", *BASE, "base_failed", "score", "kept"])

    narrow = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))
    return map_batches(narrow, run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE)
                       + ", base_failed boolean, score double, kept boolean")


def keep(
    docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = 0.5,
    least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED,
) -> DataFrame:
    """The rows that ``judge`` keeps, all columns as they were."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, failed, scores = _judged(model, batch.column(at), least_words, most_repeated)
        return batch.filter(pa.array(~failed & (scores >= threshold)))

    return map_batches(docs, run, docs.schema)
