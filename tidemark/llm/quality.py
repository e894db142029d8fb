"""Quality classifier: a generalised additive model with pairwise interactions, by cyclic boosting.

Each feature of a text falls into one of at most BINS bins. Boosting goes round the features; each step fits a tree of
up to three leaves to the gradient of the log loss over one feature's bins and adds it, shrunk, to that feature's
lookup table. Then the pairs whose coarse grid fits the remaining gradient best are boosted alike, by trees that cut a
grid once each way. A score is the sigmoid of the sum of table entries: two integer gathers for each feature and row.

Features come from text alone, whole. The model is fitted on the driver from at most `max_train` labelled rows (those
with the least hash of id), as numbers only; all else runs in tasks. Null and empty text have the same features, all
zero, and a score. Labelled rows without a document, and null labels, count for nothing; with no label or one class the
score is the (smoothed) share of label 1. Rows with equal text score alike. An
empty table gives an empty result; a very long text is one row of work. Other columns stay, those named like an output
give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, table, text_chunks
from .words import repeats, word_hashes

BINS, GRID, ROUNDS, RATE, PAIRS, MAX_TRAIN, THRESHOLD = 48, 8, 150, 0.1, 8, 20_000, 0.7
FEATURES = ["log_words", "word_length", "upper", "digit", "other_ascii", "bars", "bangs", "junk", "non_ascii", "stops", "line_words", "distinct", "adjacent", "commonest", "phrase_repeats", "line_repeats"]

_UPPER, _DIGIT, _ALPHA, _BREAK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = _ALPHA[65:91] = _ALPHA[97:123] = True
_BREAK[[32, 9, 10, 11, 12, 13]] = True
_JUNK = np.isin(np.arange(256), list(b"#$%&*@^~<>{}=\\_"))


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a chunk of UTF-8."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1)
    out = np.zeros((n, len(FEATURES)))
    if not data.size:
        return out

    def share(mask) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[offs[1:]] - total[offs[:-1]]) / size

    gap, high = _BREAK[data], data >= 128
    h, doc, _ = word_hashes(data, offs)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    out[:, 0] = np.log1p(words)
    out[:, 1] = (1 - share(gap)) * size / some
    out[:, 2], out[:, 3] = share(_UPPER[data]), share(_DIGIT[data])
    out[:, 4] = share(~(_ALPHA[data] | _DIGIT[data] | gap | high))
    out[:, 5], out[:, 6], out[:, 7], out[:, 8] = share(data == 124), share((data == 33) | (data == 63)), share(_JUNK[data]), share(high)
    out[:, 9] = share(data == 46)
    lines = share(data == 10) * size + 1
    out[:, 10] = np.log1p(words / lines)
    if len(h):
        same = np.append(False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
        out[:, 12] = np.bincount(doc, same, minlength=n) / some
        distinct, most = repeats(h, doc, n)
        out[:, 11], out[:, 13] = distinct / some, most / some
        tri = np.flatnonzero(doc[2:] == doc[:-2]) if len(h) > 2 else np.zeros(0, int)
        out[:, 14] = 1  # of a text without a phrase of three words, whatever stands in its chunk
        if len(tri):
            key, of = h[tri] * np.uint64(3) + h[tri + 1] * np.uint64(5) + h[tri + 2] * np.uint64(7), doc[tri]
            distinct, _ = repeats(key, of, n)
            out[:, 14] = 1 - distinct / np.maximum(np.bincount(of, minlength=n), 1)
    first = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], np.flatnonzero(data == 10) + 1]))
    first = first[first < data.size]
    sums = np.add.reduceat(data.astype(np.int64) * (np.arange(data.size) - np.repeat(first, np.diff(np.append(first, data.size))) + 7) ** 2 * 31, first)
    of = np.searchsorted(offs, first, "right") - 1
    distinct, _ = repeats(sums.astype(np.uint64), of, n)
    out[:, 15] = 1 - distinct / np.maximum(np.bincount(of, minlength=n), 1)
    out[words == 0] = 0
    return out


@dataclass
class Model:
    """Cuts and tables by feature; pairs of features with coarse cuts and grids."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (c, t) in enumerate(zip(self.cuts, self.tables)):
            z += t[np.searchsorted(c, x[:, j], "right")]
        for i, j, grid in self.pairs:
            z += grid[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-z))


def _leaf(g, h):
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of up to three leaves: the best cut, then the best cut of either side."""

    def cut(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        gt, ht = g[lo:hi].sum(), h[lo:hi].sum()
        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
        k = int(gain.argmax())
        return float(gain[k]), lo + k + 1

    n = len(g)
    gain, at = cut(0, n)
    edges = [0, n] if gain <= 0 else [0, at, n]
    if gain > 0:
        sides = [(*cut(0, at), 0), (*cut(at, n), 1)]
        more, where, _ = max(sides)
        if more > 0:
            edges = sorted([*edges, where])
    out = np.zeros(n)
    for a, b in zip(edges[:-1], edges[1:]):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts a grid once each way."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c):
        a = c[:-1, :-1]
        return a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a

    gs, hs = parts(G), parts(H)
    gain = sum(x**2 / (y + 1) for x, y in zip(gs, hs)) - G[-1, -1] ** 2 / (H[-1, -1] + 1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for k, (r, c) in enumerate([(slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))]):
        out[r, c] = _leaf(gs[k][i, j], hs[k][i, j])
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS, grid: int = GRID) -> Model:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    d = x.shape[1]
    cut = lambda j, n: np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1]))
    model.cuts, model.coarse = [cut(j, bins) for j in range(d)], [cut(j, grid) for j in range(d)]
    b = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z = np.full(len(y), model.base)

    def gradient():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            if len(model.tables[j]) > 1:
                g, h = gradient()
                n = len(model.tables[j])
                step = rate * _tree(np.bincount(b[j], g, n), np.bincount(b[j], h, n))
                model.tables[j] += step
                z += step[b[j]]
    q = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.coarse)]
    width = [len(c) + 1 for c in model.coarse]

    def on_grid(i, j, v):
        return np.bincount(q[i] * width[j] + q[j], v, width[i] * width[j]).reshape(width[i], width[j])

    g, h = gradient()
    ranked = sorted(((_grid_tree(on_grid(i, j, g), on_grid(i, j, h))[0], i, j) for i in range(d) for j in range(i) if width[i] > 1 and width[j] > 1), reverse=True)
    model.pairs = [(i, j, np.zeros((width[i], width[j]))) for _, i, j in ranked[:pairs]]
    for _ in range(rounds // 3):
        for i, j, t in model.pairs:
            g, h = gradient()
            step = rate * _grid_tree(on_grid(i, j, g), on_grid(i, j, h))[1]
            t += step
            z += step[q[i], q[j]]
    return model


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df without its text, and array<double> features."""
    where = df.columns.index(text_col)
    kept = [f for f in df.schema if f.name != text_col]

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column(where)):
                rest = [batch.column(i)[lo:hi] for i in range(batch.num_columns) if i != where]
                flat = pa.FixedSizeListArray.from_arrays(pa.array(features(data, offs).ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*rest, flat], names=[*(f.name for f in kept), "features"])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "features array<double>"]))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from at most max_train rows of labels, the first by hash of id, and their documents."""
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("_y"))
    some = some.orderBy(F.xxhash64(id_col), id_col).limit(max_train)
    found = with_features(docs.select(id_col, text_col).join(F.broadcast(some), id_col).select(F.col("_y"), F.col(text_col).alias("text"))).toArrow()
    if not found.num_rows:
        return Model(0.0)
    x = np.asarray(found["features"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = found["_y"].to_numpy()
    order = np.lexsort((*x.T, y))  # the order in which tasks end doesn't matter
    return fit(x[order], y[order])


def classify(df: DataFrame, model: Model, text_col: str = "text", score: str = "score", predicted: str = "predicted", threshold: float = THRESHOLD) -> DataFrame:
    """df with the score and the prediction; columns of df that have these names are replaced."""
    df = df.drop(score, predicted)
    where = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column(where)):
                s = model.score(features(data, offs))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names, score, predicted])
        release()

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]))


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2).alias("held_out")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    return classify(docs.select("doc_id", held_out(), "text"), model).drop("text")
