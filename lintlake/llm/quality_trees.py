"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every text are computed once (``stats``). The trees are fitted in numpy on a sample of at most ``MAX_ROWS`` labelled
rows (the lowest hashes of their ids; the bound only concerns the fit) and flattened into arrays of split features, thresholds and
leaf values, which a batch of texts walks level by level with array indexing.

Null or empty texts get the score of their statistics (all zero); repeated rows the same score; without any label to learn from all
scores are 0.5; several labels of one id count as the highest; null ids have no label; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lintlake.llm import text as T
from lintlake.llm.frames import stash
from lintlake.llm.stats import FEATURES, TextStats

MAX_ROWS, TREES, DEPTH, BINS, RATE, L2, LEAF_ROWS = 20_000, 80, 4, 64, 0.15, 1.0, 10


@dataclass
class Trees:
    """``feature``/``threshold``: (trees, 2^depth - 1) inner nodes in heap order; ``leaf``: (trees, 2^depth); ``base``: prior log-odds."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:  # all rows stand on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner] if len(x) else 0
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting on the logistic loss; splits come from histograms of ``BINS`` quantile bins."""
    prior = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    base, inner = float(np.log(prior / (1 - prior))), 2**DEPTH - 1
    model = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T, strict=True)], 1)
    raw, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        tree = _tree(binned, edges, p - y, p * (1 - p))
        trees.append(tree)
        raw += tree[2][_walk(binned, tree[0], tree[3])]
    return Trees(np.stack([t[0] for t in trees]), np.stack([t[1] for t in trees]), np.stack([t[2] for t in trees]), base)


def _walk(binned, feature, cut):
    node = np.zeros(len(binned), np.int64)
    for _ in range(DEPTH):
        node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
    return node - (2**DEPTH - 1)


def _tree(binned, edges, grad, hess):
    """Split features, thresholds, leaf values and the cut bins of one tree."""
    inner = 2**DEPTH - 1
    feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS, np.int64)
    node = np.zeros(len(binned), np.int64)  # within the level
    for depth in range(DEPTH):
        wide, best, first = 2**depth, np.full(2**depth, 1e-6), 2**depth - 1
        for f in range(binned.shape[1]):
            at = node * BINS + binned[:, f]
            g, h, n = (np.bincount(at, w, wide * BINS).reshape(wide, BINS).cumsum(1) for w in (grad, hess, None))
            gain = g**2 / (h + L2) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + L2) - g[:, -1:] ** 2 / (h[:, -1:] + L2)
            gain[(n < LEAF_ROWS) | (n[:, -1:] - n < LEAF_ROWS)] = 0
            gain[:, len(edges[f]) :] = 0
            top = gain.argmax(1)
            for k in np.flatnonzero(gain[np.arange(wide), top] > best):
                best[k] = gain[k, top[k]]
                feature[first + k], cut[first + k], threshold[first + k] = f, top[k], edges[f][top[k]]
        at = first + node
        node = 2 * node + (binned[np.arange(len(node)), feature[at]] > cut[at])
    g, h = np.bincount(node, grad, inner + 1), np.bincount(node, hess, inner + 1)
    return feature, threshold, -RATE * g / (h + L2), cut


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(labels: DataFrame, label: str, most: int = MAX_ROWS) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled rows that may be learned from: those with the lowest hashes of their ids."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _feature_rows(batches):
    for batch in batches:
        data, off = T.flat(batch.column("text"))
        for lo, hi in T.slices(off):
            x = TextStats(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]).features()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo)] + [pa.array(c) for c in x.T], ["doc_id", *FEATURES]
            )


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (the label 1 is likelier when higher), predicted per row of ``docs``."""
    columns = ", ".join(f"{f} double" for f in FEATURES)
    rows = stash(docs.select("doc_id", "text").mapInArrow(_feature_rows, f"doc_id long, {columns}"), "features")
    sample = rows.join(F.broadcast(learnable(labels, "quality")), "doc_id").select("y", *FEATURES).limit(2 * MAX_ROWS).toPandas()
    trees = docs.sparkSession.sparkContext.broadcast(fit(sample[list(FEATURES)].to_numpy(float), sample["y"].to_numpy(float)))

    def score_rows(batches):
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.value.score(x))], ["doc_id", "score"])

    return rows.mapInArrow(score_rows, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
