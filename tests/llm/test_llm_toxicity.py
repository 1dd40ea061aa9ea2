"""The classifier on held-out planted rows, and the label model alone."""

import random

import corpus
import numpy as np
from wirelens.llm import toxicity

BAD = "loser idiot scum moron trash".split()


def planted(spark, n=900):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        text, toxic = corpus.sentence(rng, rng.randint(5, 120)), int(rng.random() < 0.25)
        if toxic:
            w = text.split()
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(BAD) if i % 3 else "grk" + rng.choice(corpus.SYLLABLES) + rng.choice(corpus.SYLLABLES))
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, toxic))
    return corpus.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_rows(spark):
    docs, labels, truth = planted(spark)
    known = toxicity.learnable(labels)
    model = toxicity.train(docs, known)
    seen = {r["doc_id"] for r in known.collect()}
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect() if r["doc_id"] not in seen}
    assert len(got) > 200 and np.mean([got[i] == truth[i] for i in got]) > 0.98
    kept = toxicity.tolerable(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in toxicity.score(docs, model).collect())


def test_labels_of_other_rows_change_nothing(spark):
    docs, labels, _ = planted(spark, 300)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    assert toxicity.train(docs, toxicity.learnable(labels)) == toxicity.train(docs, toxicity.learnable(turned))


def test_label_model_without_labels():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.2
    votes = np.stack([(y & (rng.random(3000) < hit)) | (~y & (rng.random(3000) < miss)) for hit, miss in ((0.6, 0.005), (0.5, 0.005), (0.5, 0.01), (0.4, 0.4))], axis=1)
    votes = np.c_[votes, votes[:, 0]]  # a copy of a voter adds nothing
    q = toxicity.label_model(votes, np.array([True, True, True, False, True]), 40, 0.9)
    fired = votes[:, :3].any(axis=1)
    assert ((q > 0.5) == fired).mean() > 0.98


def test_odd_rows(spark):
    docs, labels, _ = planted(spark, 300)
    model = toxicity.train(docs, labels)
    got = toxicity.score(corpus.frame(spark, [*corpus.edges(), (50, "an idiot " * 3), (51, "IDIOT!")]), model).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    assert score[50] >= 0.7 and score[51] >= 0.7 and score[1] == score[2] < 0.5
    nothing = toxicity.train(docs, labels.filter("toxic > 5"))
    assert nothing == toxicity.Model() and toxicity.score(docs, nothing).filter("predicted = 1").count() == 0
    assert toxicity.score(corpus.frame(spark, []), model).count() == 0
