"""A quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text (shares of symbols, capitals, repeated words and so on) is cut into bins, and boosting
goes round the features in turn: a shallow tree on one feature alone adds a step function to that feature's
lookup table.  Then the pairs of features whose joint grid explains most of the rest get tables of their own
in the same way.  A score is the sum of table entries, found for a whole batch by indexing, through a logistic
function.

The model is fitted on the driver from at most ``max_train_rows`` labelled rows, chosen by a hash of their id.
Scoring is one Arrow pass over all rows, without any shuffle.

Edge cases: null text counts as empty and gets a score like any other; without labelled rows every score is
0.5, with labels of one class only it is near that class; a null label is not learned from, nor is an id with
conflicting labels; of rows that repeat a labelled id the one with the least text is learned from, once; repeated
rows score alike; a very long text is counted whole; an empty table gives an empty result; a column of the input
called like the result column is replaced by it, other columns are carried along.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import crc_mod, table, utf8_list
from sparkloom.llm.text_stats import FIELDS, text_stats
from sparkloom.llm.toxicity import training_rows
from sparkloom.llm.trees import binned, quantile_bins

MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_words",
    "word_length",
    "symbols",
    "duplicate_lines",
    "repeated_words",
    "words_per_line",
    "distinct",
    "function_words",
    "capitals",
    "letters",
    "digits",
    "marks",
    "shouts",
    "ended_lines",
    "long_words",
    "top_word",
)
_AT = {k: i for i, k in enumerate(FIELDS)}


def features(stats: np.ndarray) -> np.ndarray:
    """The values named in ``FEATURES`` from rows of counts; shares of an empty text are 0."""
    col = {k: stats[:, i].astype(np.float64) for k, i in _AT.items()}
    words, lines = np.maximum(col["n_words"], 1), np.maximum(col["n_lines"], 1)
    letters, chars = np.maximum(col["n_letters"], 1), np.maximum(col["word_chars"], 1)
    return np.column_stack(
        [
            np.log1p(col["n_words"]),
            col["word_chars"] / words,
            col["n_symbols"] / words,
            col["n_dup_lines"] / lines,
            col["n_repeat_words"] / words,
            col["n_words"] / lines,
            col["n_distinct"] / words,
            col["n_function"] / words,
            col["n_upper"] / letters,
            col["n_letters"] / chars,
            col["n_digits"] / words,
            col["n_marks"] / words,
            col["n_shout"] / words,
            col["n_ended"] / lines,
            col["n_long"] / words,
            col["n_top"] / words,
        ]
    )


def _matrix(texts: list[bytes]) -> np.ndarray:
    return features(np.array([text_stats(x) for x in texts], dtype=np.int64).reshape(len(texts), len(FIELDS)))


class Additive:
    """A bias, a lookup table per feature, and a lookup grid per chosen pair of features."""

    def __init__(self, bias: float, cuts: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]):
        self.bias, self.cuts, self.tables, self.coarse, self.pairs = bias, cuts, tables, coarse, pairs

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        if self.tables:
            fine, rough = binned(x, self.cuts), binned(x, self.coarse)
            for j, steps in enumerate(self.tables):
                out += steps[fine[:, j]]
            for (i, j), grid in self.pairs.items():
                out += grid[rough[:, i], rough[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _shallow(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """Leaf value per bin of a tree over one ordered feature, given each bin's gradient and curvature sums."""
    value = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return value
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = np.where((left_h >= least) & (right_h >= least), left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge), -1.0)
    k = int(gain.argmax())
    if gain[k] <= g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
        return value
    return np.concatenate(
        [_shallow(g[: k + 1], h[: k + 1], depth - 1, ridge, least), _shallow(g[k + 1 :], h[k + 1 :], depth - 1, ridge, least)]
    )


def _shallow_grid(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, float]:
    """Leaf value per cell of a tree that splits one axis once and each half once along the other; and its gain."""
    best, chosen = -1.0, np.full(g.shape, g.sum() / (h.sum() + ridge))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, a.shape[0]):
            halves = [(a[:k].sum(0), b[:k].sum(0)), (a[k:].sum(0), b[k:].sum(0))]
            if min(x[1].sum() for x in halves) < least:
                continue
            steps = [_shallow(x, y, 1, ridge, least) for x, y in halves]
            gain = sum(float((2 * s * x - s * s * (y + ridge / len(y))).sum()) for s, (x, y) in zip(steps, halves, strict=True))
            if gain > best:
                grid = np.vstack([np.tile(steps[0], (k, 1)), np.tile(steps[1], (a.shape[0] - k, 1))])
                best, chosen = gain, grid.T if flip else grid
    return chosen, best


def fit_additive(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 120,
    pair_rounds: int = 40,
    n_pairs: int = 6,
    bins: int = 32,
    pair_bins: int = 6,
    rate: float = 0.1,
    ridge: float = 1.0,
    least: float = 1.0,
) -> Additive:
    """Cyclic boosting of the tables, then of the chosen pairs' grids."""
    share = float(np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Additive(bias, [], [], [], {})
    cuts, coarse = quantile_bins(x, bins), quantile_bins(x, pair_bins)
    fine, rough = binned(x, cuts), binned(x, coarse)
    size = [len(c) + 1 for c in cuts]
    tables = [np.zeros(n) for n in size]
    f = np.full(len(y), bias)
    for _ in range(rounds):
        for j in range(x.shape[1]):
            p = 1 / (1 + np.exp(-f))
            g, h = np.bincount(fine[:, j], y - p, size[j]), np.bincount(fine[:, j], p * (1 - p), size[j])
            step = rate * _shallow(g, h, 2, ridge, least)
            tables[j] += step
            f += step[fine[:, j]]
    shape = [len(c) + 1 for c in coarse]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        cell, n = rough[:, i] * shape[j] + rough[:, j], shape[i] * shape[j]
        return (
            np.bincount(cell, y - p, n).reshape(shape[i], shape[j]),
            np.bincount(cell, p * (1 - p), n).reshape(shape[i], shape[j]),
        )

    gains = {(i, j): _shallow_grid(*sums(i, j), ridge, least)[1] for i, j in combinations(range(x.shape[1]), 2)}
    chosen = sorted(gains, key=lambda k: (-gains[k], k))[:n_pairs]
    pairs = {k: np.zeros((shape[k[0]], shape[k[1]])) for k in chosen if gains[k] > 0}
    for _ in range(pair_rounds):
        for (i, j), grid in pairs.items():
            step = rate * _shallow_grid(*sums(i, j), ridge, least)[0]
            grid += step
            f += step[rough[:, i], rough[:, j]]
    return Additive(bias, cuts, tables, coarse, pairs)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = MAX_TRAIN_ROWS, modulus: int = 5, held: int = 0) -> Additive:
    """Learn from labelled rows whose crc32(id) mod ``modulus`` is not ``held``."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array(list(_matrix(utf8_list(column))), pa.list_(pa.float64()))

    rows = training_rows(docs, labels, "quality", modulus, held, id_col, text_col, max_train_rows)
    got = rows.select("k", "y", F.arrow_udf(run, "array<double>")("text").alias("x")).collect()
    got.sort(key=lambda r: (r["k"], r["y"]))
    x = np.array([r["x"] for r in got], dtype=np.float64).reshape(len(got), len(FEATURES))
    return fit_additive(x, np.array([r["y"] for r in got], dtype=np.float64))


def score_column(model: Additive, text_col: str) -> Column:
    def run(column: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(utf8_list(column))), pa.float64())

    return F.arrow_udf(run, "double")(F.col(text_col).cast("string"))


def score(docs: DataFrame, model: Additive, text_col: str = "text") -> DataFrame:
    """``docs`` with the column quality_score, the probability of label 1."""
    return docs.withColumn("quality_score", score_column(model, text_col))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model).withColumnRenamed("quality_score", "score")
    return scored.select(
        "doc_id",
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
