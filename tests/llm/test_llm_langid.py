"""Held-out accuracy on planted languages, and odd rows."""

import random

import corpus
import numpy as np
from wirelens.llm import langid

TONGUES = {"aa": "ba na ta mo ri ku".split(), "bb": "sch ung heit ver auf ötz".split(), "cc": "ción ñar llo que ez ía".split()}


def planted(spark, n=450):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        lang = rng.choice(list(TONGUES))
        rows.append((i, " ".join("".join(rng.choice(TONGUES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang if i % 7 else None))
    return corpus.frame(spark, rows), {i: lang for i, _, lang in rows}


def test_held_out_rows_and_rejection(spark):
    docs, truth = planted(spark)
    known = langid.learnable(docs)
    model = langid.train(known)
    assert model.langs == tuple(sorted(TONGUES))
    seen = {r["doc_id"] for r in known.collect()}
    got = [r for r in langid.identify(docs, model).collect() if r["doc_id"] not in seen and truth[r["doc_id"]]]
    assert len(got) > 50 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.98
    assert not any(r["rejected"] for r in got) and all(0 < r["score"] <= 1 for r in got)
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_odd_rows(spark):
    model = langid.train(planted(spark)[0])
    got = langid.identify(corpus.frame(spark, [*corpus.edges(), (60, "123 !?"), (61, "a"), (62, "İstanbul ﬁ 𝔘")]), model).collect()
    pred = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in got}
    assert len(got) == 14 and all(pred[i] == ("und", 0.0, True) for i in (1, 2, 3, 60))
    assert all(pred[i][0] in TONGUES for i in (None, 4, 6, 8, 61, 62)) and pred[6] == pred[7]
    assert langid.identify(corpus.frame(spark, []), model).count() == 0


def test_no_labels(spark):
    model = langid.train(corpus.frame(spark, [(1, "words", None)]))
    assert [tuple(r) for r in langid.identify(corpus.frame(spark, [(1, "words")]), model).collect()] == [(1, "und", 0.0, False)]


def test_a_long_text_counts_whole(monkeypatch):
    text = "ba na " * 50 + "schung verheit " * 400
    whole = np.sort(langid.subwords(text)[0])
    model = langid.Model(("a", "b"), np.random.default_rng(1).normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    score = langid.judge(model, [text, None, text])[1]
    z = model.scores[whole].mean(axis=0)
    assert np.allclose(score[0], (np.exp(z) / np.exp(z).sum()).max(), atol=1e-5) and score[0] == score[2]
    monkeypatch.setattr(langid, "PIECE", 600)
    assert np.allclose(langid.judge(model, [text])[1], score[0], atol=0.02)
