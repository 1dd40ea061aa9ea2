"""Compression classifier: sizes against direct calls, held-out accuracy, odd inputs."""

import math
import random
import zlib

import corpus
import pytest
import zstandard
from wirelens.llm import compressor


def texts(rng, n):
    rows = []
    for i in range(n):
        words = corpus.sentence(rng, rng.randint(30, 300)).split()
        if i % 4 == 0:
            words = [w + rng.choice(["%%%", "###", "***"]) for w in words] if i % 8 else [w for w in words for _ in range(9)]
        rows.append((i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = texts(random.Random(1), 900)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = corpus.frame(spark, rows)
    return rows, docs, compressor.train(docs, compressor.learnable(labels))


def test_held_out_accuracy(trained):
    rows, docs, model = trained
    got = {r["doc_id"]: r for r in compressor.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum(got[i]["predicted"] == int(i % 4 != 0) for i in held)
    assert len(held) > 200 and right >= 0.97 * len(held)
    clean = [i for i in held if i % 4]
    assert sum(got[i]["predicted"] for i in clean) >= 0.98 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_scores_equal_direct_sizes(spark, trained):
    _, _, model = trained
    rows = corpus.edges()
    sizes = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.bad, model.good)]
    want = []
    for i, text in rows:
        data = (text or "").encode()
        blocks = [data[at : at + 1024] for at in range(0, len(data), 1024)]
        gain = sum(len(sizes[0].compress(b)) - len(sizes[1].compress(b)) for b in blocks)
        want.append((i, 1 / (1 + math.exp(-(model.slope * (gain / len(data) if data else 0) + model.bias)))))
    got = [(r["doc_id"], r["score"]) for r in compressor.score(corpus.frame(spark, rows), model).collect()]
    for (i, x), (j, y) in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert i == j and x == pytest.approx(y, abs=1e-9)


def test_scores_are_calibrated(trained):
    rows, docs, model = trained
    got = [(r["score"], int(r["doc_id"] % 4 != 0)) for r in compressor.score(docs, model).collect()]
    assert abs(sum(s for s, _ in got) / len(got) - sum(y for _, y in got) / len(got)) < 0.05


def test_few_or_no_labels(spark):
    docs = corpus.frame(spark, corpus.edges())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in compressor.score(docs, compressor.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(6, 1), (None, 0), (7, None)], "doc_id long, quality int")
    assert {r["predicted"] for r in compressor.score(docs, compressor.train(docs, one)).collect()} == {1}
    few = spark.createDataFrame([(4, 0), (5, 1), (6, 1), (8, 0), (9, 1)], "doc_id long, quality int")
    assert compressor.score(docs, compressor.train(docs, few)).count() == len(corpus.edges())
    assert compressor.score(corpus.frame(spark, []), compressor.Model()).count() == 0
