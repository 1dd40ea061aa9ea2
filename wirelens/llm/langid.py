"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import bounded, filtered, in_small_batches, remainder, slices

UNKNOWN = "und"
ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
#: Code points handled at once; longer texts go in pieces of at most this length, cut beside a character that is no letter.
PIECE = 1 << 17
#: Code points of a training text among which subwords are drawn, at a place that its length gives.
WINDOW = 1 << 20


@dataclass(frozen=True)
class Training:
    """``rows`` bounds the labelled sample, ``grams`` what is drawn of each of its texts, from ``WINDOW`` code points of it."""

    rows: int = 8000
    grams: int = 384
    size: int = 16
    epochs: int = 12
    rate: float = 2.0
    batch: int = 64
    #: Share of right calibration documents that rejection may lose, and the highest threshold.
    lose: float = 0.0005
    ceiling: float = 0.35


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    #: Embeddings times softmax weights: what one subword adds to the scores, by bucket.
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def subwords(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, position where it starts) of the subwords of lower-case text, word edges included."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    before = np.r_[False, letter[:-1]]
    at = np.flatnonzero(letter | before)  # runs of other characters count as one space
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = np.where(letter[at], codes[at], 32).astype(np.uint64)
    x, at = np.r_[np.uint64(32), x, np.uint64(32)], np.r_[0, at, len(codes)]
    gap = x == 32
    out, where = [], []
    for n in ORDERS:
        if len(x) < n:
            continue
        m = len(x) - n + 1
        h = np.full(m, n, np.uint64)
        ok = ~(gap[:m] & gap[n - 1 :]) if n == 2 else np.ones(m, bool)
        for j in range(n):
            h = (h ^ x[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < j < n - 1:
                ok &= ~gap[j : j + m]
        out.append((h[ok] >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))
        where.append(np.where(gap[:m], at[1 : m + 1], at[:m])[ok])  # a letter's place
    return np.concatenate(out), np.concatenate(where)


def _cut(text: str):
    """Pieces of up to ``PIECE`` code points; only a longer run of letters is cut inside a word."""
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            at = end
            while at > start and text[at - 1].isalpha() and text[at].isalpha():
                at -= 1
            end = at if at > start else end
        yield text[start:end]
        start = end


def _pieces(texts: list[str | None]):
    """Runs of (texts' numbers, their pieces) of about ``PIECE`` code points together."""
    numbers, held, size = [], [], 0
    for i, text in enumerate(texts):
        for part in _cut(text or ""):
            part = part.lower()
            if size + len(part) > PIECE and held:
                yield numbers, held
                numbers, held, size = [], [], 0
            numbers.append(i)
            held.append(part)
            size += len(part) + 1
    if held:
        yield numbers, held


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, calibrated score and rejection of each text, from the whole of it."""
    k = len(model.langs)
    total, count = np.zeros((len(texts), k)), np.zeros(len(texts))
    for numbers, held in _pieces(texts):
        buckets, where = subwords("\n".join(held).replace("\x00", " "))
        ends = np.cumsum([len(p) + 1 for p in held])
        owner = np.asarray(numbers)[np.minimum(np.searchsorted(ends, where, side="right"), len(held) - 1)]
        order = np.bincount(owner, minlength=len(texts))
        count += order
        for j in range(k):
            total[:, j] += np.bincount(owner, model.scores[buckets, j], minlength=len(texts))
    some = count > 0
    z = np.where(some[:, None], total / np.maximum(count, 1)[:, None] + model.bias, 0) / model.temperature
    p = np.exp(z - z.max(axis=1, keepdims=True)) if k else np.zeros((len(texts), 1))
    p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    score = np.where(some, p.max(axis=1), 0.0) if k else np.zeros(len(texts))
    langs = [model.langs[j] if s and k else UNKNOWN for j, s in zip(p.argmax(axis=1), some, strict=True)]
    return langs, score, (score < model.threshold) | ~some


def _sample(docs: DataFrame, training: Training) -> list:
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = bounded(rows.select("doc_id", "text", "lang"), training.rows, "doc_id")

    def run(batches):
        for part in slices(batches):
            drawn = []
            for text in part.column(1).to_pylist():
                rng = np.random.default_rng(len(text))
                start = int(rng.integers(0, max(1, len(text) - WINDOW)))
                found = subwords(text[start : start + WINDOW].lower())[0]
                if len(found):  # with repeats, so that every text gives equally many
                    found = rng.choice(found, training.grams)
                drawn.append(found.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(drawn, pa.binary())], ["doc_id", "lang", "grams"])

    rows = rows.mapInArrow(run, "doc_id long, lang string, grams binary").filter(F.length("grams") > 0)
    return sorted(rows.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"]))


def train(docs: DataFrame, training: Training = Training()) -> Model:
    """Fit on a bounded sample of the rows of ``docs`` (doc_id, text, lang) that have a language.

    A fifth of the sample calibrates: the temperature that makes scores match their
    accuracy, then the score below which a text is rejected. Without labelled rows the
    model knows no language and calls everything unknown.
    """
    rows = _sample(docs.select(F.col("doc_id").cast("long"), "text", "lang"), training)
    langs = tuple(sorted({r["lang"] for r in rows}))
    if not langs:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    x = np.stack([np.frombuffer(r["grams"], "<u2") for r in rows]).astype(np.int64)
    y = np.array([langs.index(r["lang"]) for r in rows])
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    k = len(langs)
    e = rng.uniform(-0.5, 0.5, (BUCKETS, training.size)).astype(np.float32) / training.size
    w, b = np.zeros((training.size, k), np.float32), np.zeros(k, np.float32)
    share = np.bincount(y[used], minlength=k) / len(used)
    weight = (1 / np.maximum(share * k, 1e-9)) ** 0.5
    for epoch in range(training.epochs):
        rate = training.rate * (1 - epoch / training.epochs)
        rng.shuffle(used)
        for start in range(0, len(used), training.batch):
            rows_ = used[start : start + training.batch]
            grams = x[rows_]
            hidden = e[grams].mean(axis=1)
            z = hidden @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows_)), y[rows_]] -= 1
            p *= (weight[y[rows_]] / len(rows_))[:, None]
            back = (p @ w.T / grams.shape[1]).astype(np.float32)
            w -= (rate * hidden.T @ p).astype(np.float32)
            b -= (rate * p.sum(axis=0)).astype(np.float32)
            np.add.at(e, grams.ravel(), -rate * len(rows_) * np.repeat(back, grams.shape[1], axis=0))
    scores = (e @ w).astype(np.float32)
    if not len(held):
        return Model(langs, scores, b, 1.0, 0.0)
    z = scores[x[held]].mean(axis=1) + b

    def loss(t):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), y[held]]).mean())

    temperature = min(np.geomspace(0.05, 20, 120), key=loss)
    p = np.exp(z / temperature - (z / temperature).max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p[np.arange(len(p)), y[held]][p.argmax(axis=1) == y[held]]
    low = float(np.quantile(right, training.lose)) if len(right) else 0.0
    return Model(langs, scores, b, float(temperature), min(low, training.ceiling))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(remainder("doc_id", 4) != 2)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row of ``docs`` (doc_id, text).

    A null text, or one without a letter, is ``und`` with score 0 and rejected. Equal
    texts get equal results. Longer texts are read in pieces, between which words end
    (see ``_cut``). Other columns are not read.
    """

    def run(batches):
        for part in slices(batches):
            langs, score, rejected = judge(model, part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"])

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rejected rows, all columns unchanged.

    Texts that are null, empty or without a letter are rejected; equal rows go or stay
    together, whatever their ids; an empty table stays empty.
    """
    return filtered(docs, "text", lambda: lambda texts: list(~judge(model, texts)[2]))
