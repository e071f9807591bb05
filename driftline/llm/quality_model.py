"""Document quality by a generalised additive model with pairwise interactions.

Features of a text are cut into bins at quantiles. Shallow trees are boosted in cycles, one feature
at a time with a small step, so that each feature ends up with a lookup table over its bins; then
the pairs of features whose joint bins still explain most of the residuals get tables the same way.
A score is the sum of table entries, taken for a whole batch at a time.

The model is fitted on the driver to at most `rows` labelled documents, chosen by a hash of their
ids; features of all others are never gathered.

Defined cases: null and empty texts have all features 0 and get that score; equal texts score
alike, so repeated rows do too; with no labelled rows, or of one class only, the score is the
smoothed share of label 1 for every text; an empty table gives an empty result.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import bounded_batches, map_texts, texts_of, words_of

SYMBOLS = "#*$%&<>"
FEATURES = ("words", "word_length", "symbols", "upper", "exclaims", "distinct", "digits", "dup_lines", "echoes",
            "line_length", "stops", "bars", "other_letters", "longest")


def features(text: str) -> tuple:
    n = len(text)
    if not n:
        return (0.0,) * len(FEATURES)
    words = words_of(text)
    k = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = n - len(text.translate(_NO_UPPER)) if text.isascii() else sum(map(str.isupper, text))
    return (
        float(np.log1p(len(words))), n / k, sum(map(text.count, SYMBOLS)) / n, upper / n, text.count("!") / n,
        len(set(words)) / k, sum(map(text.count, "0123456789")) / n, 1 - len(set(lines)) / max(len(lines), 1),
        sum(map(operator.eq, words, words[1:])) / k, float(np.log1p(n / max(len(lines), 1))),
        (text.count(".") + text.count(",")) / k, text.count("|") / k, (len(text.encode("utf-8", "replace")) - n) / n,
        float(np.log1p(max(map(len, words), default=0))))


_NO_UPPER = {c: None for c in range(65, 91)}


@dataclass
class Model:
    bias: float
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pair_edges: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (feature, feature, table)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edges, x[:, k], side="right")]
        for i, j, table in self.pairs:
            z += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"),
                       np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _quantiles(values, bins):
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _value(g, h, damp=1.0):
    return g / (h + damp)


def _gain(g, h, damp=1.0):
    return g * g / (h + damp)


def _tree(g, h, n, depth=2, least=10):
    """Leaf value per bin of the best tree over ordered bins (gradients g, curvatures h, rows n)."""
    out = np.full(len(g), _value(g.sum(), h.sum()))
    if depth == 0 or len(g) < 2:
        return out
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    gain[(left_n < least) | (n.sum() - left_n < least)] = -1
    k = int(np.argmax(gain))
    if gain[k] <= 1e-9:
        return out
    for part in (slice(0, k + 1), slice(k + 1, None)):
        out[part] = _tree(g[part], h[part], n[part], depth - 1, least)
    return out


def _pair_tree(g, h, n):
    """A cut on one axis and one on the other in each half: values per cell and the gain."""
    best, best_gain = np.zeros_like(g), 0.0
    for flip in (False, True):
        a, b, c = (m.T if flip else m for m in (g, h, n))
        for k in range(1, a.shape[0]):
            cells = np.empty_like(a)
            gain = -_gain(a.sum(), b.sum())
            for part in (slice(0, k), slice(k, None)):
                pg, ph = a[part].sum(0), b[part].sum(0)
                leaf = _tree(pg, ph, c[part].sum(0), depth=1)
                cells[part] = leaf
                gain += float((2 * leaf * pg - leaf * leaf * (ph + 1.0 / len(pg))).sum())
            if gain > best_gain:
                best, best_gain = (cells.T if flip else cells), gain
    return best, best_gain


def train(x: np.ndarray, y: np.ndarray, bins=32, rounds=150, pair_bins=8, pair_rounds=40, n_pairs=4, step=0.1) -> Model:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [_quantiles(x[:, k], bins) for k in range(x.shape[1])]
    where = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    rows = [np.bincount(w, minlength=len(t)) for w, t in zip(where, model.tables)]
    z = np.full(len(y), model.bias)
    for _ in range(rounds):
        for w, t, n in zip(where, model.tables, rows):
            p = 1 / (1 + np.exp(-z))
            leaf = step * _tree(np.bincount(w, y - p, len(t)), np.bincount(w, p * (1 - p), len(t)), n)
            t += leaf
            z += leaf[w]
    model.pair_edges = [_quantiles(x[:, k], pair_bins) for k in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]

    def cells(i, j, weights):
        shape = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        return np.bincount(coarse[i] * shape[1] + coarse[j], weights, shape[0] * shape[1]).reshape(shape)

    def joint(i, j):
        p = 1 / (1 + np.exp(-z))
        return _pair_tree(cells(i, j, y - p), cells(i, j, p * (1 - p)), cells(i, j, None))

    candidates = [(i, j) for i in range(x.shape[1]) for j in range(i)]
    ranked = sorted(candidates, key=lambda ij: -joint(*ij)[1])[:n_pairs]
    tables = {ij: np.zeros((len(model.pair_edges[ij[0]]) + 1, len(model.pair_edges[ij[1]]) + 1)) for ij in ranked}
    for _ in range(pair_rounds):
        for i, j in ranked:
            leaf = step * joint(i, j)[0]
            tables[i, j] += leaf
            z += leaf[coarse[i], coarse[j]]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def fit(docs: DataFrame, labels: DataFrame, rows=20_000) -> Model:
    """A model from at most `rows` labelled documents, one text for each id (the smallest where it
    repeats). `labels` has doc_id and quality, and only the rows that may be learned from."""
    known = (labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = map_texts(chosen, lambda texts: [features(t) for t in texts], ", ".join(f"{f} double" for f in FEATURES),
                    keep=("doc_id", "quality")).toPandas().sort_values(["doc_id", *FEATURES])
    return train(got[list(FEATURES)].to_numpy(float), got["quality"].to_numpy(float))


def score_quality(docs: DataFrame, model: Model, keep=("doc_id",)) -> DataFrame:
    """The kept columns and the score (0 to 1) of every whole text."""
    bounded_batches(docs.sparkSession)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in texts_of(b)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(model.score(x), pa.float64())],
                                             names=[*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, score double")
