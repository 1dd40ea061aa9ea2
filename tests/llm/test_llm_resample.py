"""Resampling against a plain computation with one sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus
import pytest
from pyspark.sql import functions as F
from wirelens.llm import resample
from wirelens.llm.common import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    return words, words + [" ".join(p) for p in zip(words, words[1:], strict=False)]


def brute(rows, target, draw=resample.Draw()):
    """Sorted (doc_id, n_features, weight, score, rank); ties of one id by content are left to the caller."""
    n = draw.buckets
    count = lambda texts: Counter(zlib.crc32(f.encode()) % n for t in texts for f in features(t)[1])
    s, t = count(r[1] for r in rows), count(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + n) / ((s[b] + 1) * (sum(t.values()) + n)))) for b in range(n)]
    out, fit = [], []
    for row in rows:
        words, own = features(row[1])
        weight = sum(gain[zlib.crc32(f.encode()) % n] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{draw.seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([row[0], len(own), weight, score, None])
        if len(words) >= draw.least_words:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: len(fit) * draw.percent // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=repr)


def test_equals_one_sort(spark):
    rng = random.Random(8)
    rows = [(i, corpus.sentence(rng, rng.randint(0, 70)).title()) for i in range(500)]
    rows += [(600 + i, "the same long text of many words that " * 6) for i in range(60)] + corpus.edges()
    target = [corpus.sentence(rng, 40) for _ in range(20)] + [None, ""]
    other = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(corpus.frame(spark, rows), other)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target)


def test_repeated_ids_and_rows_are_drawn_exactly(spark):
    rows = [(5, "one and the same row of text " * 5)] * 41 + [(5, "another text with this very id " * 5)] * 7 + [(None, "no id but enough words here " * 5)] * 3
    got = resample.resample(corpus.frame(spark, rows), corpus.frame(spark, rows[:1])).collect()
    assert len(got) == 51 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 13))
    worst, best = min(r["score"] for r in got if r["rank"]), max(r["score"] for r in got if not r["rank"])
    assert worst >= best


@pytest.mark.parametrize("k", [1, 2, 499, 500, 1700, 2000])
def test_cutoff_equals_sorting(spark, k):
    rng = random.Random(k)
    keys = [(-rng.randint(0, 30), False, rng.randint(0, 9), rng.randint(0, 3), i) for i in range(1400)] + [(-99, False, 1, 1, 2000 + i) for i in range(600)]
    rows = spark.createDataFrame(keys, "k_score long, k_null boolean, k_id long, k_tie long, k_place long").repartition(7, F.col("k_score"))
    runs = Scratch(spark).keep(resample.sorted_runs(rows), "runs")
    assert tuple(resample.cutoff(runs, k, rest=5)) == sorted(keys)[k - 1]


def test_empty_tables(spark):
    empty = corpus.frame(spark, [])
    assert resample.resample(empty, empty).count() == 0
    rows = [(i, corpus.sentence(random.Random(i), 30)) for i in range(8)]
    got = resample.resample(corpus.frame(spark, rows), empty)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, [])
