"""Quality by compression: a text's sizes under a dictionary of good and one of bad texts."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import as_bytes, bounded, in_small_batches, remainder, slices

THRESHOLD = 0.5


@dataclass(frozen=True)
class Training:
    """``rows`` bounds the labelled sample, ``pieces`` of ``piece`` bytes what each text gives to a dictionary of ``size`` bytes."""

    rows: int = 8000
    pieces: int = 4
    piece: int = 1024
    size: int = 1 << 16
    level: int = 3
    #: One in so many sampled texts calibrates and is not in the dictionaries.
    calibrate: int = 4


@dataclass(frozen=True)
class Model:
    """Dictionaries by label, and the logistic curve over the difference; no dictionaries: the bias alone."""

    bad: bytes = b""
    good: bytes = b""
    slope: float = 0.0
    bias: float = 0.0
    piece: int = 1024
    level: int = 3


class Compressors:
    """Compressed sizes by both dictionaries; one a task."""

    def __init__(self, model: Model):
        self.piece = model.piece
        self.pair = []
        for data in (model.bad, model.good):
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=model.level)
            self.pair.append(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_dict_id=False))

    def difference(self, data: bytes | None) -> float:
        """(size by the bad dictionary - size by the good one) / size of the text.

        The whole text counts, in blocks that each begin anew from the dictionary: else a
        long text would be measured against itself.
        """
        if not data:
            return 0.0
        bad, good = (c.compress for c in self.pair)
        gain = 0
        for at in range(0, len(data), self.piece):
            block = data[at : at + self.piece]
            gain += len(bad(block)) - len(good(block))
        return gain / len(data)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few samples for one, their bytes themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:].ljust(8, b"\n")


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of the logistic curve by Newton steps; targets a little inside 0 and 1."""
    n1 = y.sum()
    n0 = len(y) - n1
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(2), np.array([1e-6, 1e-6])

    def loss(w):
        s = z @ w
        return float((np.logaddexp(0, s) - target * s).sum() + (ridge * w * w).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (p - target) + ridge * w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def train(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:
    """Fit on a bounded sample of the labelled rows: ``labels`` (doc_id, quality), ``docs`` (doc_id, text).

    Pieces of up to ``pieces * piece`` bytes come from all over each text and reach the
    driver, equal ones once; both dictionaries get equally many bytes. Texts kept apart
    are then measured whole and set the curve. Rows without an id or label teach nothing;
    contradicting labels of one id count as bad. If only one label is known, every score
    is its share; if none, 0.5.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").cast("int").alias("_quality"))
    known = bounded(known, training.rows, "_id")
    # At most ``rows`` pairs of numbers: safe to broadcast, and the texts stay where they are.
    sample = docs.select(F.col("doc_id").cast("long").alias("_key"), "text").join(F.broadcast(known), F.col("_key") == F.col("_id"))
    aside = F.pmod(F.xxhash64("_id", F.lit("calibrate")), F.lit(training.calibrate)) == 0
    sample = sample.filter("text IS NOT NULL AND text <> ''").select("_id", "text", "_quality", aside.alias("_aside"))
    whole, part = training.pieces * training.piece, training.piece

    def drawn(batches):
        for rows in slices(batches):
            out = []
            for name, data in zip(rows.column(0).to_pylist(), as_bytes(rows.column(1)), strict=True):
                starts = range(0, len(data), part) if len(data) <= whole else sorted(random.Random(name).sample(range(len(data) - part), training.pieces))
                out.append([data[at : at + part] for at in starts])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary())), rows.column(2)], ["pieces", "quality"])

    rows = in_small_batches(sample.filter(~F.col("_aside")).drop("_aside")).mapInArrow(drawn, "pieces array<binary>, quality int").collect()
    samples = [sorted({bytes(p) for r in rows if r["quality"] == label for p in r["pieces"]}) for label in (0, 1)]
    if not all(samples):
        n = [sum(r["quality"] == label for r in rows) for label in (0, 1)]
        return Model(bias=float(np.log((n[1] + 1) / (n[0] + 1))))
    rng, least = random.Random(7), min(sum(map(len, x)) for x in samples)
    for label, own in enumerate(samples):
        rng.shuffle(own)
        samples[label] = own[: 1 + int(np.searchsorted(np.cumsum([len(p) for p in own]), least))]
    found = Model(*(_dictionary(x, training.size) for x in samples), piece=part, level=training.level)
    aside = sample.filter("_aside").select(F.col("_id").alias("doc_id"), "text", "_quality")
    measured = differences(aside, found, "_quality").collect()
    if len({r["_quality"] for r in measured}) < 2:  # too few to set some apart
        measured = differences(sample.select(F.col("_id").alias("doc_id"), "text", "_quality"), found, "_quality").collect()
    measured = sorted((r["difference"], r["_quality"]) for r in measured)
    slope, bias = _curve(np.array([x for x, _ in measured]), np.array([y for _, y in measured]))
    return Model(found.bad, found.good, slope, bias, part, training.level)


def differences(docs: DataFrame, model: Model, *others: str) -> DataFrame:
    """doc_id, the columns ``others`` and ``difference`` (null without dictionaries) of every row of ``docs`` (doc_id, text), from whole texts."""

    def run(batches):
        compressors = Compressors(model) if model.good else None
        for part in slices(batches):
            values = [compressors.difference(data) if compressors else None for data in as_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(values, pa.float64())], ["doc_id", *others, "difference"])

    rows = in_small_batches(docs).select(F.col("doc_id").cast("long"), "text", *others)
    kinds = dict(rows.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in others), "difference double"])
    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted and difference of every row of ``docs`` (doc_id, text).

    Null and empty texts have difference 0. Equal texts get equal scores, a null id stays
    null, an empty table gives no rows; other columns are not read.
    """
    z = F.lit(model.slope) * F.coalesce("difference", F.lit(0.0)) + F.lit(model.bias)
    found = differences(docs, model).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z)))))
    return found.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "difference")


def learnable(labels: DataFrame) -> DataFrame:
    return labels.filter(remainder("doc_id", 3) != 1)
