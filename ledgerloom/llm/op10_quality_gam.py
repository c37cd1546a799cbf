"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a dozen surface features. The model is a sum of lookup tables:
one per feature over its quantile bins and one per chosen pair of features over
the grid of their bins. It is fitted by cyclic gradient boosting on the
logistic loss: rounds visit the features in turn, and each visit adds a shallow
tree (two levels of cuts over the bins) of the current residuals to that
feature's table, at a small learning rate; then the pairs whose best 2 x 2 cut
explains most of what is left get tables in the same way. Scoring looks up the
bins and adds the tables' values, for a whole block of texts at a time.

The fit runs on at most TRAIN_ROWS labelled rows, whose features Spark
computes; everything else reads every row.

Defined results: a null text counts as empty; empty texts get the score that
their bins (no words, all shares 0) add up to. Null labels and ids are left out
of the fit; without labels of both kinds the score is the same for all rows:
the (smoothed) share of label 1. Null ids are not held out. Extra columns are
left out; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textnp
from ledgerloom.llm.common import crc_remainder, labelled_texts, table
from ledgerloom.llm.registry import query

TRAIN_ROWS = 20_000
BINS = 32
ROUNDS = 150
PAIRS = 6
PAIR_ROUNDS = 40
RATE = 0.1
THRESHOLD = 0.3

FEATURES = ["log_words", "word_bytes", "upper", "digits", "symbols", "shouts", "pipes", "stops",
            "other_bytes", "same_as_before", "repeated_windows", "words_per_line",
            "repeated_lines"]

UPPER, DIGIT, SYMBOL = (np.zeros(256, dtype=bool) for _ in range(3))
UPPER[ord("A"):ord("Z") + 1] = True
DIGIT[ord("0"):ord("9") + 1] = True
SYMBOL[[ord(c) for c in "#*$%&<>=+~^_\\{}[]"]] = True


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(mask)
    return np.diff(np.searchsorted(at, offsets)).astype(np.float64)


def _repeats(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many of each owner's values equal an earlier one of the same owner."""
    if not len(h):
        return np.zeros(n)
    key = textnp.mix64(h + owner.astype(np.uint64) * textnp.BASE)
    different = np.unique(key, return_index=True)[1]
    return np.bincount(owner, minlength=n) - np.bincount(owner[different], minlength=n).astype(float)


def features(data, offsets, powers) -> np.ndarray:
    """(texts, FEATURES) values of one block."""
    n = len(offsets) - 1
    with np.errstate(over="ignore"):
        starts, ends, first = textnp.words(data, offsets)
        count = np.diff(first)
        h = textnp.span_hashes(data, starts, ends, powers)
        owner = np.repeat(np.arange(n), count)
        inside = np.bincount(owner, weights=ends - starts, minlength=n)
        size = np.maximum(inside, 1)
        words = np.maximum(count, 1)
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        windows, begin = textnp.shingles(h, first, 3)
        n_windows = np.diff(begin)
        again = _repeats(np.repeat(np.arange(n), n_windows), windows, n)
        line_start, line_end = textnp.spans(data != 10, offsets)
        line_owner = np.searchsorted(offsets, line_start, side="right") - 1
        lines = np.bincount(line_owner, minlength=n)
        line_again = _repeats(line_owner, textnp.span_hashes(data, line_start, line_end, powers), n)
    return np.stack([
        np.log1p(count), inside / words, _per_text(UPPER[data], offsets) / size,
        _per_text(DIGIT[data], offsets) / size, _per_text(SYMBOL[data], offsets) / size,
        _per_text(data == ord("!"), offsets) / size, _per_text(data == ord("|"), offsets) / size,
        _per_text((data == ord(".")) | (data == ord(",")), offsets) / words,
        _per_text(data >= 128, offsets) / size, np.bincount(owner, weights=same, minlength=n) / words,
        again / np.maximum(n_windows, 1), count / np.maximum(lines, 1),
        line_again / np.maximum(lines, 1)], axis=1)


@dataclass
class Model:
    """Bin edges per feature, a table per feature, a grid per pair, and an intercept."""

    edges: list
    tables: list
    pairs: list
    grids: list
    intercept: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right")
                         for f, e in enumerate(self.edges)], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            out += t[b[:, f]]
        for (f, g), grid in zip(self.pairs, self.grids):
            out += grid[b[:, f], b[:, g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _cut(g: np.ndarray, h: np.ndarray, least: float):
    """(gain, place) of the best cut of a row of bins by residual and weight sums."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain = np.where((hl >= least) & (hr >= least), gain, -1)
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 1e-9 else (0.0, 0)


def _shallow_tree(g, h, depth=2, least=1.0) -> np.ndarray:
    """Leaf values per bin of a tree of ``depth`` levels of cuts."""
    gain, at = _cut(g, h, least) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_shallow_tree(g[:at], h[:at], depth - 1, least),
                           _shallow_tree(g[at:], h[at:], depth - 1, least)])


def _cross_tree(g: np.ndarray, h: np.ndarray):
    """(gain, leaf values per cell) of the best single cut of each axis together."""
    best = (0.0, np.zeros_like(g))
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gt, ht = gc[-1, -1], hc[-1, -1]
    quads_g = [gc[:-1, :-1], gc[:-1, -1:] - gc[:-1, :-1], gc[-1:, :-1] - gc[:-1, :-1]]
    quads_h = [hc[:-1, :-1], hc[:-1, -1:] - hc[:-1, :-1], hc[-1:, :-1] - hc[:-1, :-1]]
    quads_g.append(gt - sum(quads_g))
    quads_h.append(ht - sum(quads_h))
    gain = sum(a ** 2 / (b + 1) for a, b in zip(quads_g, quads_h)) - gt ** 2 / (ht + 1)
    if gain.size and gain.max() > 1e-9:
        i, j = np.unravel_index(np.argmax(gain), gain.shape)
        leaf = np.zeros_like(g)
        for (rows, cols), a, b in zip(((slice(0, i + 1), slice(0, j + 1)),
                                       (slice(0, i + 1), slice(j + 1, None)),
                                       (slice(i + 1, None), slice(0, j + 1)),
                                       (slice(i + 1, None), slice(j + 1, None))), quads_g, quads_h):
            leaf[rows, cols] = a[i, j] / (b[i, j] + 1)
        best = (float(gain[i, j]), leaf)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins=BINS, rounds=ROUNDS, pairs=PAIRS,
        pair_rounds=PAIR_ROUNDS, rate=RATE) -> Model:
    """Cyclic boosting of feature tables, then of the strongest pairs' grids."""
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x)
             else np.zeros(0) for f in range(k)]
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], [], [], float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    logit = np.full(len(x), model.intercept)

    def residuals():
        s = 1 / (1 + np.exp(-logit))
        return y - s, s * (1 - s)

    for _ in range(rounds):
        for f in range(k):
            r, w = residuals()
            m = len(model.tables[f])
            step = rate * np.clip(_shallow_tree(np.bincount(b[:, f], r, m),
                                                np.bincount(b[:, f], w, m)), -4, 4)
            model.tables[f] += step
            logit += step[b[:, f]]

    def grid(f, g, r):
        shape = len(model.tables[f]), len(model.tables[g])
        return np.bincount(b[:, f] * shape[1] + b[:, g], r, shape[0] * shape[1]).reshape(shape)

    r, w = residuals()
    gains = sorted(((_cross_tree(grid(f, g, r), grid(f, g, w))[0], f, g)
                    for f in range(k) for g in range(f)), reverse=True)[:pairs]
    model.pairs = [(f, g) for gain, f, g in gains if gain > 0]
    model.grids = [np.zeros((len(model.tables[f]), len(model.tables[g]))) for f, g in model.pairs]
    for _ in range(pair_rounds):
        for n, (f, g) in enumerate(model.pairs):
            r, w = residuals()
            step = rate * np.clip(_cross_tree(grid(f, g, r), grid(f, g, w))[1], -4, 4)
            model.grids[n] += step
            logit += step[b[:, f], b[:, g]]
    return model


def _train_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = textnp.Powers()
    for batch in batches:
        for i, j, data, offsets in textnp.blocks(batch.column("text")):
            x = features(data, offsets, powers)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(i, j - i), lists], names=["label", "x"])


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textnp.Powers()
        for batch in batches:
            for i, j, data, offsets in textnp.blocks(batch.column("text")):
                score = model.score(features(data, offsets, powers))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(score)],
                    names=["doc_id", "score"])
    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS,
          modulus: int = 5, held: int = 0) -> Model:
    sample = labelled_texts(docs, labels, label, rows, modulus, held)
    got = sample.mapInArrow(_train_features, "label int, x array<double>").toArrow()
    # The rows come in no fixed order; sorting them makes the fit repeatable.
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = got["label"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])
    return fit(x[order], y[order])


def classify(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scores(model), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


@query("op10_quality_gam")
def op10_quality_gam(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).select(
        "doc_id", F.coalesce(crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
