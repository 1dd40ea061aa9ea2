"""Multi-class gradient boosting on Spark, and exact attributions of its trees.

Each round grows one regression tree per class on the gradients of the softmax loss.
Features are binned once; for each level of a round one pass sums gradients by class,
node, feature and bin inside the tasks, and only those sums meet. Their number depends
on the model's size, not on the rows.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.session import materialise


@dataclass(frozen=True)
class Shape:
    """``rounds`` trees a class of ``depth`` levels; ``bins`` per feature, at most 256."""

    rounds: int = 16
    depth: int = 3
    rate: float = 0.3
    bins: int = 64
    #: Added to the curvature of a leaf, and the fewest rows on either side of a split.
    ridge: float = 1.0
    least: int = 5


@dataclass
class Trees:
    """Complete binary trees by (tree, class, node), nodes in heap order; a row goes left if its value is at most ``threshold``."""

    names: list[str]
    classes: int
    prior: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    #: Training rows that passed each node, leaves included.
    cover: np.ndarray

    @property
    def depth(self) -> int:
        return self.leaf.shape[2].bit_length() - 1


def _places(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, levels: int) -> np.ndarray:
    """Heap number of the node that each row of ``x`` reaches after so many levels of one tree."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(levels):
        node = 2 * node + 2 - (x[rows, feature[node]] <= threshold[node])
    return node


def _margins(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, prior: np.ndarray) -> np.ndarray:
    depth = leaf.shape[2].bit_length() - 1
    out = np.tile(prior, (len(x), 1))
    for t in range(len(leaf)):
        for c in range(leaf.shape[1]):
            out[:, c] += leaf[t, c, _places(x, feature[t, c], threshold[t, c], depth) - (1 << depth) + 1]
    return out


def margins(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Score of each class for each row of feature values."""
    return _margins(x, trees.feature, trees.threshold, trees.leaf, trees.prior)


def _binned(rows: DataFrame, names: list[str], edges: list[np.ndarray]) -> DataFrame:
    """label and one byte a feature: how many of its edges are below the value."""

    def run(batches):
        for batch in batches:
            x = np.stack([np.searchsorted(e, batch.column(i + 1).to_numpy(zero_copy_only=False)) for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    return rows.select(F.col("label").cast("int"), *[F.col(n).cast("double") for n in names]).mapInArrow(run, "label int, x binary")


def _sums(binned: DataFrame, grown: tuple, level: int, n_features: int, n_bins: int) -> DataFrame:
    """(cls, at, g, h, n): gradients, curvatures and rows by node of the level, feature and bin; ``at`` counts through these."""
    feature, threshold, leaf, prior = grown
    done = len(leaf)
    classes, nodes = len(prior), 1 << level

    def run(batches):
        size = nodes * n_features * n_bins
        total = np.zeros((classes, 3, size))
        spread = np.arange(n_features) * n_bins
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, n_features)
            y = batch.column(0).to_numpy(zero_copy_only=False)
            z = _margins(x, feature[:done], threshold[:done], leaf, prior)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for c in range(classes):
                node = _places(x, feature[done, c], threshold[done, c], level) - nodes + 1
                at = (node[:, None] * (n_features * n_bins) + spread + x).ravel()
                for i, w in enumerate((p[:, c] - (y == c), p[:, c] * (1 - p[:, c]), np.ones(len(x)))):
                    total[c, i] += np.bincount(at, np.repeat(w, n_features), minlength=size)
        for c in range(classes):
            at = np.flatnonzero(total[c, 2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)), *(pa.array(total[c, i][at]) for i in range(3))], ["cls", "at", "g", "h", "n"])

    rows = binned.mapInArrow(run, "cls int, at int, g double, h double, n double")
    return rows.groupBy("cls", "at").agg(*[F.sum(c).alias(c) for c in "ghn"])


def fit(rows: DataFrame, classes: int, names: list[str], shape: Shape = Shape()) -> Trees:
    """Boosted trees for ``rows`` (label from 0, the features ``names``).

    To the driver come the bins' edges and, for each level, sums by class, node, feature
    and bin: their number is given by the model's shape. Without rows the scores are all 0.
    """
    share = [i / shape.bins for i in range(1, shape.bins)]
    clean = rows.filter(F.col("label").isNotNull()).select("label", *names)
    counts = {int(r["label"]): r["count"] for r in clean.groupBy("label").count().collect()}  # a row a class
    n_rows, depth, f = sum(counts.values()), shape.depth, len(names)
    prior = np.log([(counts.get(c, 0) + 1) / (n_rows + classes) for c in range(classes)])
    inner = (1 << depth) - 1
    feature = np.zeros((shape.rounds, classes, inner), np.int64)
    cut = np.full((shape.rounds, classes, inner), 1 << 20, np.int64)  # in bins; all rows go left
    leaf, cover = np.zeros((shape.rounds, classes, inner + 1)), np.zeros((shape.rounds, classes, 2 * inner + 1))
    if not n_rows:
        return Trees(list(names), classes, prior * 0, feature, cut.astype(float) * np.inf, leaf, cover)
    edges = [np.unique(e) for e in clean.approxQuantile(list(names), share, 0.1 / shape.bins)]
    binned = materialise(_binned(clean, names, edges))
    for t in range(shape.rounds):
        for level in range(depth):
            nodes = 1 << level
            got = _sums(binned, (feature, cut, leaf[:t], prior), level, f, shape.bins).toPandas()
            sums = np.zeros((3, classes, nodes * f * shape.bins))
            for i, name in enumerate("ghn"):
                sums[i, got["cls"], got["at"]] = got[name].round(9)
            g, h, n = sums.reshape(3, classes, nodes, f, shape.bins)
            left = np.cumsum((g, h, n), axis=-1)
            whole = left[..., :1, -1:]  # every feature sums to the same
            right = whole - left
            gain = sum(x[0] ** 2 / (x[1] + shape.ridge) for x in (left, right)) - whole[0] ** 2 / (whole[1] + shape.ridge)
            gain = np.where((left[2] >= shape.least) & (right[2] >= shape.least), gain, 0).round(9).reshape(classes, nodes, -1)
            best = gain.argmax(axis=-1)
            for c, k in itertools.product(range(classes), range(nodes)):
                here, (j, b) = nodes - 1 + k, divmod(int(best[c, k]), shape.bins)
                split = gain[c, k, best[c, k]] > 0
                sides = (left[:, c, k, j, b], right[:, c, k, j, b]) if split else (whole[:, c, k, 0, 0], whole[:, c, k, 0, 0] * 0)
                cover[t, c, here] = whole[2, c, k, 0, 0]
                if split:
                    feature[t, c, here], cut[t, c, here] = j, b
                for side, (a, d, m) in enumerate(sides):
                    cover[t, c, 2 * here + 1 + side] = m
                    if level == depth - 1:
                        leaf[t, c, 2 * k + side] = -shape.rate * a / (d + shape.ridge) if m else 0.0
    threshold = np.full(cut.shape, np.inf)
    for at in np.ndindex(*cut.shape):
        if cut[at] < len(edges[feature[at]]):
            threshold[at] = edges[feature[at]][cut[at]]
    return Trees(list(names), classes, prior, feature, threshold, leaf, cover)


def logits(trees: Trees, values: Column) -> Column:
    """Scores of all classes for an array of feature values, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(list(margins(trees, np.stack(rows.to_numpy()).astype(float)))) if len(rows) else pd.Series([], dtype=object)

    return run(values)


def _paths(trees: Trees, t: int, c: int):
    """(leaf's value, {feature: [(threshold, goes left), ...]}, {feature: share of rows that pass}) of each leaf of a tree."""
    for k in range(1 << trees.depth):
        node, tests, share = 0, {}, {}
        for level in range(trees.depth):
            left = not (k >> (trees.depth - 1 - level)) & 1
            below = 2 * node + 2 - left
            j, rows = int(trees.feature[t, c, node]), trees.cover[t, c, node]
            tests.setdefault(j, []).append((trees.threshold[t, c, node], left))
            share[j] = share.get(j, 1.0) * (trees.cover[t, c, below] / rows if rows else 0.0)
            node = below
        yield trees.leaf[t, c, k], tests, share


def expected(trees: Trees, c: int) -> float:
    """Score of class ``c`` when no feature is known: leaves by their share of training rows."""
    return float(trees.prior[c]) + sum(v * math.prod(share.values()) for t in range(len(trees.leaf)) for v, _, share in _paths(trees, t, c))


def contributions(trees: Trees, x: np.ndarray, c: int) -> np.ndarray:
    """Shapley values of the features for the score of class ``c``; with ``expected`` they add up to it.

    A feature that is not known sends a row down both ways by training shares. On the
    path to one leaf the value of a set of known features is then a product over the
    path's features, so each leaf is a game of at most ``depth`` players.
    """
    out = np.zeros(x.shape)
    for t in range(len(trees.leaf)):
        for value, tests, share in _paths(trees, t, c):
            if value == 0.0:
                continue
            known = {j: np.logical_and.reduce([(x[:, j] <= cut) == left for cut, left in own]).astype(float) for j, own in tests.items()}
            d = len(known)
            for j in known:
                others = [i for i in known if i != j]
                total = np.zeros(len(x))
                for size in range(d):
                    weight = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                    for held in itertools.combinations(others, size):
                        product = np.full(len(x), weight)
                        for i in others:
                            product *= known[i] if i in held else share[i]
                        total += product
                out[:, j] += value * (known[j] - share[j]) * total
    return out


def attributions(trees: Trees, values: Column, cls: Column, top: int = 5) -> Column:
    """The ``top`` features by absolute contribution to the score of class ``cls``, ties by name; one pass, no shuffle."""
    names = np.array(trees.names)

    @F.pandas_udf("array<struct<feature:string,contribution:double,observed_value:double>>")
    def run(rows: pd.Series, classes: pd.Series) -> pd.Series:
        out: list = [None] * len(rows)
        if len(rows):
            x, own = np.stack(rows.to_numpy()).astype(float), classes.to_numpy()
            for c in np.unique(own):
                at = np.flatnonzero(own == c)
                for i, phi in zip(at, contributions(trees, x[at], int(c)), strict=True):
                    order = np.lexsort((names, -np.abs(phi)))[:top]
                    out[i] = [{"feature": str(names[j]), "contribution": float(phi[j]), "observed_value": float(x[i, j])} for j in order]
        return pd.Series(out)

    return run(values, cls)
