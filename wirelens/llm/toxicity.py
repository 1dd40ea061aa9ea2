"""Toxicity from weak supervision: mined lexicon voters and pattern voters, a label model, a linear classifier."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import MEMORY, WordIds, bounded, filtered, in_small_batches, mixed, remainder, slices
from wirelens.llm.neardup import shingle_set, signature

_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (3, 4, 5, 6)
_LONGEST = 40

#: Pattern voters: what insults look like whatever their words are.
PATTERNS = {
    "address": re.compile(r"\b(?:you|your|you're|tu|vous|du|ihr)\b[^.!?\n]{0,24}!"),
    "shouting": re.compile(r"(?:\b[A-Z]{4,}\b[ ,]*){3,}"),
    "marks": re.compile(r"[!?]{3,}"),
    "grawlix": re.compile(r"\b\w+[@#$%*]{3,}\w*"),
}


@dataclass(frozen=True)
class Training:
    """``rows`` bounds the labelled sample; ``mined`` the features that are looked at in detail."""

    rows: int = 8000
    mined: int = 3000
    voters: int = 300
    precision: float = 0.95
    support: int = 4
    share: float = 0.02
    rounds: int = 40
    ridge: float = 0.02
    alone: int = 3


@dataclass(frozen=True)
class Model:
    """Weight by lexicon feature (``=word`` or ``stem*``) and by pattern."""

    bias: float = -30.0
    words: dict[str, float] = field(default_factory=dict)
    patterns: dict[str, float] = field(default_factory=dict)


def features(piece: str) -> list[str]:
    """Lexicon features of a piece of lower-cased text between white space."""
    out = []
    for word in _WORD.findall(piece):
        if len(word) <= _LONGEST:
            out.append("=" + word)
        out += [word[:n] + "*" for n in _STEMS if len(word) > n]
    return out


class Hits(dict):
    """Known features by piece, remembered up to a bound."""

    def __init__(self, known):
        super().__init__()
        self.known = known

    def __missing__(self, piece: str) -> tuple[str, ...]:
        if len(self) >= MEMORY:
            self.clear()
        value = tuple(f for f in features(piece) if f in self.known)
        if len(piece) <= 2 * _LONGEST:
            self[piece] = value
        return value


def found(text: str | None, hits: Hits) -> set[str]:
    out: set[str] = set()
    for piece in set((text or "").lower().split()):
        out.update(hits[piece])
    return out


def _counts(sample: DataFrame) -> DataFrame:
    """Toxic and other documents by feature, summed within each task first."""

    def run(batches):
        toxic, other = {}, {}
        for part in slices(batches):
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                into = toxic if label else other
                seen = set()
                for piece in set((text or "").lower().split()):
                    seen.update(features(piece))
                for f in seen:
                    into[f] = into.get(f, 0) + 1
        # A feature that no toxic text of this task has still counts against it elsewhere.
        names = list(toxic.keys() | other.keys())
        for at in range(0, len(names), 50_000):
            these = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(these), pa.array([toxic.get(f, 0) for f in these], pa.int64()), pa.array([other.get(f, 0) for f in these], pa.int64())],
                ["feature", "toxic", "other"])

    rows = sample.mapInArrow(run, "feature string, toxic long, other long")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _votes(sample: DataFrame, mined: list[str]) -> list:
    """Matched features and patterns of the sampled documents, one of each group of near copies.

    Copies share all their words and would make any of them look telling. Two texts
    are taken for copies if one of four pairs of MinHash values agrees.
    """
    number = {f: i for i, f in enumerate(mined)}
    factors = mixed(np.arange(1, 9, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)

    def run(batches):
        hits, ids = Hits(number), WordIds()
        for part in slices(batches):
            texts = part.column(0).to_pylist()
            words = [sorted(number[f] for f in found(t, hits)) for t in texts]
            shapes = [[k for k, p in enumerate(PATTERNS.values()) if p.search(t or "")] for t in texts]
            bands = [signature(shingle_set((t or "").encode("utf-8", "surrogatepass"), 5, ids), factors).view(np.int64).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.int32())), part.column(1), pa.array(bands, pa.list_(pa.int64()))],
                ["words", "shapes", "toxic", "bands"])

    rows = sample.mapInArrow(run, "words array<int>, shapes array<int>, toxic int, bands array<long>").collect()
    rows.sort(key=lambda r: (list(r["bands"]), r["toxic"], list(r["words"])))
    owner, seen = list(range(len(rows))), {}

    def top(i):
        while owner[i] != i:
            owner[i] = i = owner[owner[i]]
        return i

    for i, r in enumerate(rows):
        for k, band in enumerate(r["bands"]):
            j = top(seen.setdefault((k, r["toxic"], band), i))
            owner[max(top(i), j)] = min(top(i), j)
    return [r for i, r in enumerate(rows) if top(i) == i]


def _lexicon(rows: list, mined: list[str], training: Training) -> list[int]:
    """The precise features with the most support, nested stems included."""
    y = np.array([r["toxic"] for r in rows], bool)
    has = np.zeros((len(rows), len(mined)), bool)
    for i, r in enumerate(rows):
        has[i, r["words"]] = True
    toxic, other = has[y].sum(axis=0), has[~y].sum(axis=0)
    least = max(training.support, int(training.share * y.sum()))
    good = (toxic >= least) & (toxic >= training.precision * (toxic + other))
    return [int(i) for i in np.argsort(-toxic, kind="stable") if good[i]][: training.voters]


def label_model(votes: np.ndarray, precise: np.ndarray, rounds: int, precision: float) -> np.ndarray:
    """Posterior of the hidden label of each row.

    Voters (columns) fire or abstain, which says nothing; that no precise voter fires is a
    vote of its own. Expectation maximisation gives how often each fires under either
    label; no labels take part. ``precise`` voters are known to be right at least that
    often, which bounds their accuracy from below. Voters that still go together once
    the label is known form a group: its members that fire share one vote.
    """
    silent = ~votes[:, precise].any(axis=1)
    v = np.c_[votes, silent].astype(float)
    precise = np.r_[precise, False]
    m = v.shape[1]
    group = np.eye(m)
    q = np.where(silent, 0.02, 0.9)
    for turn in range(2):
        share = v @ group
        for _ in range(rounds):
            prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
            on, off = (q @ v + 0.5) / (q.sum() + 1), ((1 - q) @ v + 0.5) / ((1 - q).sum() + 1)
            odds = np.log(prior / (1 - prior))
            vote = np.log(on / off)
            vote = np.where(precise, np.maximum(vote, np.log(precision / (1 - precision)) - odds), vote)
            z = odds + ((v * vote) @ group / np.maximum(share, 1)).sum(axis=1)
            q = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if turn or m < 2:
            break
        rest = np.zeros((m, m))
        for weight in (q, 1 - q):
            mean = (weight @ v) / max(weight.sum(), 1e-9)
            d = (v - mean) * np.sqrt(weight)[:, None]
            rest += d.T @ d
        spread = np.sqrt(np.maximum(np.diag(rest), 1e-12))
        tied = rest / np.outer(spread, spread) > 0.3
        first = np.arange(m)
        for i in range(m):  # the earliest voter of a chain of ties names the group
            others = np.flatnonzero(tied[i, :i])
            if len(others):
                first[i] = first[others].min()
        group = np.eye(m)[first]
    return q


def _logistic(x: np.ndarray, q: np.ndarray, ridge: float) -> np.ndarray:
    """Weights with the bias last, by Newton steps: each row's likelier label, as far as it is sure."""
    sure, q = np.abs(2 * q - 1), (q >= 0.5).astype(float)
    x = np.c_[x.astype(float), np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (sure * (p - q)) + penalty * w
        h = (x * (sure * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:
    """Fit on a bounded sample of the labelled rows: ``labels`` (doc_id, toxic), ``docs`` (doc_id, text).

    Labels only find the lexicon. Without labelled toxic rows every score is near 0.
    Contradicting labels of one document count as toxic.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    known = bounded(known, training.rows, "_id")
    # At most ``rows`` pairs of numbers: safe to broadcast, and the texts stay where they are.
    sample = docs.select(F.col("doc_id").cast("long").alias("_key"), "text").join(F.broadcast(known), F.col("_key") == F.col("_id"))
    sample = sample.select("text", F.col("_toxic").alias("toxic"))
    counts = _counts(sample).filter((F.col("toxic") >= training.support) & (F.col("toxic") >= training.precision * (F.col("toxic") + F.col("other"))))
    mined = [r["feature"] for r in counts.orderBy(F.desc("toxic"), "feature").limit(training.mined).collect()]
    rows = _votes(sample, mined) if mined else []
    chosen = _lexicon(rows, mined, training) if rows else []
    if not chosen:
        return Model()
    votes = np.zeros((len(rows), len(chosen) + len(PATTERNS)), bool)
    place = {c: j for j, c in enumerate(chosen)}
    for i, r in enumerate(rows):
        votes[i, [place[c] for c in r["words"] if c in place]] = True
        votes[i, [len(chosen) + k for k in r["shapes"]]] = True
    q = label_model(votes, np.arange(votes.shape[1]) < len(chosen), training.rounds, training.precision)
    # A text that only one voter marks may not be in the sample: each voter also stands
    # alone, with the stems that always go with it, ``alone`` times.
    v = votes[:, : len(chosen)].astype(float)
    always = np.zeros((len(chosen), votes.shape[1]), bool)
    always[:, : len(chosen)] = (v.T @ v).T >= 0.999 * v.sum(axis=0)[:, None]
    votes = np.r_[votes, np.repeat(always, training.alone, axis=0)]
    q = np.r_[q, np.ones(len(chosen) * training.alone)]
    w = _logistic(votes, q, training.ridge)
    return Model(float(w[-1]), {mined[c]: float(w[j]) for c, j in place.items()},
                 {name: float(w[len(chosen) + k]) for k, name in enumerate(PATTERNS)})


def learnable(labels: DataFrame) -> DataFrame:
    return labels.filter(remainder("doc_id", 3) != 1)


def judge(model: Model, texts: list[str | None], hits: Hits) -> np.ndarray:
    z = np.full(len(texts), model.bias)
    live = [(PATTERNS[name], w) for name, w in model.patterns.items() if abs(w) > 0.05]
    for i, text in enumerate(texts):
        if text:
            z[i] += sum(model.words[f] for f in found(text, hits)) + sum(w for p, w in live if p.search(text))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


THRESHOLD = 0.7


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row of ``docs`` (doc_id, text), from whole texts.

    Null and empty texts get the score of a text that no voter marks. Equal texts get
    equal scores. Other columns are not read.
    """

    def run(batches):
        hits = Hits(model.words)
        for part in slices(batches):
            p = judge(model, part.column(1).to_pylist(), hits)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def tolerable(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns unchanged.

    Null and empty texts are judged as texts that no voter marks; equal rows go or stay
    together, whatever their ids; an empty table stays empty.
    """

    def keep():
        hits = Hits(model.words)
        return lambda texts: list(judge(model, texts, hits) < THRESHOLD)

    return filtered(docs, "text", keep)
