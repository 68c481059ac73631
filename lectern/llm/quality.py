"""Quality scores by histogram gradient-boosted trees over document statistics.

Trees are complete and of one depth, so a forest is three arrays and a batch
of texts walks all trees with one indexing step per level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, narrow

#: Labelled rows to learn from, about; bins per statistic; trees, their depth, learning rate and leaf penalty.
TRAINING_ROWS, BINS = 20_000, 32
TREES, DEPTH, RATE, PENALTY = 60, 4, 0.2, 2.0
STATISTICS = (
    "chars", "words", "word_length", "word_length_spread", "distinct_words", "top_word", "same_as_previous", "short_words",
    "upper", "digits", "symbols", "exclamations", "pipes", "marks", "not_ascii", "lines", "repeated_lines", "line_words",
)
_KINDS = {
    "upper": range(ord("A"), ord("Z") + 1),
    "digits": range(ord("0"), ord("9") + 1),
    "symbols": map(ord, "#*$%&<>@^~\\{}"),
    "exclamations": map(ord, "!?"),
    "pipes": map(ord, "|"),
    "marks": map(ord, ".,;:'\"()-"),
    "not_ascii": range(128, 256),
}
_MASKS = {kind: np.isin(np.arange(256), list(members)).astype(float) for kind, members in _KINDS.items()}


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` for a whole text; None is the empty text."""
    text = text or ""
    words, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts, n = np.bincount(data, minlength=256), max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=float, count=len(words)) if words else np.zeros(1)
    seen = Counter(words)
    of_bytes = {kind: float(counts @ mask) / max(1, len(data)) for kind, mask in _MASKS.items()}
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        float(lengths.mean()),
        float(lengths.std()),
        len(seen) / n,
        max(seen.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        float((lengths <= 3).sum()) / n,
        *of_bytes.values(),
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        len(words) / max(1, len(lines)),
    ]


class Forest(NamedTuple):
    """Inner nodes of all trees in heap order: (trees, 2^depth - 1); leaves: (trees, 2^depth)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that the rows of ``x`` reach; all trees step down together."""
        n_trees, n_inner = self.feature.shape
        if not n_trees:
            return np.full(len(x), self.base)
        tree = np.arange(n_trees)[None, :]
        node = np.zeros((len(x), n_trees), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(n_inner + 1))):
            right = x[rows, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        return self.base + self.leaf[tree, node - n_inner].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, penalty: float = PENALTY) -> Forest:
    """Second-order boosting of the logistic loss on binned columns; no rows give the score 1/2."""
    empty = np.zeros((0, 2**depth - 1))
    if not len(y):
        return Forest(0.0, empty.astype(np.int64), empty, np.zeros((0, 2**depth)))
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    column = np.arange(width) * bins
    margin = np.full(n, base)
    feature = np.zeros((trees, 2**depth - 1), dtype=np.int64)
    threshold = np.full((trees, 2**depth - 1), np.inf)
    leaf = np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, size = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * width * bins + column + binned).ravel()
            sums = [np.bincount(cell, np.repeat(v, width), size * width * bins).reshape(size, width, bins).cumsum(axis=2) for v in (slope, bend)]
            left, whole = [s[:, :, :-1] for s in sums], [s[:, :, -1:] for s in sums]
            right = [w - part for w, part in zip(whole, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + penalty) + right[0] ** 2 / (right[1] + penalty) - whole[0] ** 2 / (whole[1] + penalty)
            gain[(left[1] < 1e-3) | (right[1] < 1e-3)] = -np.inf
            for f in range(width):
                gain[:, f, len(edges[f]) :] = -np.inf
            best = gain.reshape(size, -1).argmax(axis=1)
            for k in range(size):
                f, cut = divmod(int(best[k]), bins - 1)
                if gain[k, f, cut] > 1e-9:
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - (2**depth - 1)
        leaf[t] = rate * np.bincount(at, slope, 2**depth) / (np.bincount(at, bend, 2**depth) + penalty)
        margin += leaf[t, at]
    return Forest(base, feature, threshold, leaf)


def measured(text: Column) -> Column:
    """array<double> of the statistics of a text column."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in batch], dtype=object)

    return run(text)


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    training_rows: int = TRAINING_ROWS,
) -> Forest:
    """A forest from the rows of ``df`` that ``labels`` marks with 1 or 0.

    About ``training_rows`` labels, picked by a hash of the id, are used; the
    texts stay on the executors, their statistics come to the driver. Null ids
    and labels teach nothing; each of several labels of one id counts.
    """
    marked = narrow(labels, id=id_col, label=label_col).where("id IS NOT NULL AND label IS NOT NULL")
    sample = hash_sample(marked, training_rows, "id")
    rows = narrow(df, id=id_col, text=text_col).join(F.broadcast(sample), "id")
    table = rows.select("id", "label", measured(F.col("text")).alias("x")).toPandas().sort_values("id", kind="stable")
    x = np.array(table["x"].tolist(), dtype=float).reshape(len(table), len(STATISTICS))
    return train(x, table["label"].to_numpy(dtype=float))


def score(text: Column, forest: Forest) -> Column:
    """The probability of label 1 for a text column; a null text is the empty text."""

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in batch], dtype=float).reshape(len(batch), len(STATISTICS))
        parts = [forest.scores(x[at : at + 1024]) for at in range(0, len(x), 1024)]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return run(text)


def rate(df: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row of ``df``, whole texts; repeated rows repeat."""
    rows = narrow(df, id=id_col, text=text_col)
    return rows.select(F.col("id").alias(id_col), score(F.col("text"), forest).alias("score"))
