"""A convolution over the packet sequence beside the tabular features, trained by weighted gradients.

Each step is one pass: every task sums the gradients of its rows, the sums of several
tasks are added in a second stage, and a fixed few of those reach the driver. A class's
weight multiplies its rows' gradients; no row is repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.session import materialise

SLOTS = 128
#: Rows whose activations are held at once, and sums that the driver adds up.
SLICE, SUMS = 512, 16


@dataclass(frozen=True)
class Layers:
    kernels: int = 8
    width: int = 5
    stride: int = 2
    hidden: int = 32
    steps: int = 60
    rate: float = 0.03
    seed: int = 20260906


@dataclass
class Network:
    names: list[str]
    classes: int
    layers: Layers
    mean: np.ndarray
    scale: np.ndarray
    sequence_scale: float
    theta: np.ndarray


def shapes(features: int, classes: int, layers: Layers) -> list[tuple[int, ...]]:
    wide = features + 2 * layers.kernels
    return [(layers.kernels, layers.width), (layers.kernels,), (wide, layers.hidden), (layers.hidden,), (layers.hidden, classes), (classes,)]


def _parts(theta: np.ndarray, sizes: list[tuple[int, ...]]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in sizes:
        n = int(np.prod(shape))
        out.append(theta[at : at + n].reshape(shape))
        at += n
    return out


def forward(theta: np.ndarray, x: np.ndarray, s: np.ndarray, classes: int, layers: Layers):
    """Scores of each class, and what ``gradient`` needs of the way there."""
    kernel, shift, a, a0, b, b0 = _parts(theta, shapes(x.shape[1], classes, layers))
    spans = np.lib.stride_tricks.sliding_window_view(s, layers.width, axis=1)[:, :: layers.stride]
    c = np.maximum(spans @ kernel.T + shift, 0)
    z = np.concatenate([x, c.mean(axis=1), c.max(axis=1)], axis=1)
    h = np.maximum(z @ a + a0, 0)
    return h @ b + b0, (spans, c, z, h, a, b)


def gradient(theta: np.ndarray, x: np.ndarray, s: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, layers: Layers) -> tuple[np.ndarray, float]:
    """Gradient and value of the weighted log loss, summed over the rows."""
    o, (spans, c, z, h, a, b) = forward(theta, x, s, classes, layers)
    p = np.exp(o - o.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = float(-(weight * np.log(np.maximum(p[rows, y], 1e-300))).sum())
    p[rows, y] -= 1
    do = p * weight[:, None]
    dh = (do @ b.T) * (h > 0)
    dz = dh @ a.T
    n, k = x.shape[1], layers.kernels
    dc = np.repeat(dz[:, None, n : n + k] / c.shape[1], c.shape[1], axis=1)
    top = c.argmax(axis=1)
    dc[rows[:, None], top, np.arange(k)] += dz[:, n + k :]
    dc *= c > 0
    parts = [np.tensordot(dc, spans, ([0, 1], [0, 1])), dc.sum(axis=(0, 1)), z.T @ dh, dh.sum(axis=0), h.T @ do, do.sum(axis=0)]
    return np.concatenate([q.ravel() for q in parts]), loss


def _summed(rows: DataFrame, theta: np.ndarray, features: int, classes: int, layers: Layers) -> np.ndarray:
    """Gradient over all rows: sums of tasks, then of groups of tasks, then of ``SUMS`` groups."""

    def run(batches):
        total = np.zeros(len(theta))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x, s = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.float32).reshape(part.num_rows, -1).astype(float) for i in (2, 3))
                total += gradient(theta, x, s, part.column(0).to_numpy(), part.column(1).to_numpy(), classes, layers)[0]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([total.tobytes()])], ["part", "g"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [np.sum([np.frombuffer(g) for g in group["g"]], axis=0).tobytes()]})

    sums = rows.mapInArrow(run, "part int, g binary").groupBy("part").applyInPandas(add, "g binary")
    return np.sum([np.frombuffer(r["g"]) for r in sums.collect()], axis=0)


def fit(rows: DataFrame, classes: int, names: list[str], layers: Layers = Layers()) -> Network:
    """Trained on ``rows``: label from 0, the features ``names``, and ``seq`` of ``SLOTS`` signed sizes.

    A class counts by total / (rows of it * classes). Without rows the scores are those of
    the start.
    """
    clean = rows.filter(F.col("label").isNotNull())
    counts = {int(r["label"]): r["count"] for r in clean.groupBy("label").count().collect()}  # a row a class
    n = sum(counts.values())
    facts = clean.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names)],
                      F.max(F.aggregate("seq", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))).alias("top")).first()
    mean = np.array([facts[f"m{i}"] or 0.0 for i in range(len(names))])
    scale = np.array([facts[f"s{i}"] or 1.0 for i in range(len(names))])
    top = float(facts["top"] or 1.0)
    rng = np.random.default_rng(layers.seed)
    theta = np.concatenate([(rng.normal(size=q) / np.sqrt(q[0] if len(q) > 1 else np.inf)).ravel() for q in shapes(len(names), classes, layers)])
    if not n:
        return Network(list(names), classes, layers, mean, scale, top, theta)

    def packed(batches):
        for batch in batches:
            x, s = (np.array(batch.column(i).to_pylist(), float).reshape(batch.num_rows, -1) for i in (1, 2))
            x, s = ((x - mean) / scale).astype(np.float32), (s / top).astype(np.float32)
            y = batch.column(0).to_numpy()
            weight = np.array([n / (counts[int(c)] * len(counts)) for c in y], float) / n
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(weight), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in s], pa.binary())], ["label", "weight", "x", "s"])

    wide = clean.select(F.col("label").cast("int"), F.array(*[F.col(c).cast("double") for c in names]).alias("x"), "seq")
    table = materialise(wide.mapInArrow(packed, "label int, weight double, x binary, s binary"))
    first, second = np.zeros(len(theta)), np.zeros(len(theta))
    for step in range(1, layers.steps + 1):
        g = _summed(table, theta, len(names), classes, layers)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - layers.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Network(list(names), classes, layers, mean, scale, top, theta)


def logits(net: Network, values: Column, sequence: Column) -> Column:
    """Scores of all classes for an array of feature values and a sequence, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series, sequences: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        x, s = ((np.stack(rows.to_numpy()).astype(float) - net.mean) / net.scale, np.stack(sequences.to_numpy()).astype(float) / net.sequence_scale)
        return pd.Series(list(forward(net.theta, x, s, net.classes, net.layers)[0]))

    return run(values, sequence)
