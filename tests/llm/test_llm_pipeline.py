"""The pipeline on written tables, stage by stage against each operator's own verdict."""

import random

import corpus
import corpus_pipeline
import __spark_entry__ as contract
from wirelens.llm import decontam, langid, neardup, queries, toxicity
from wirelens.llm.common import Scratch, maybe_among, without


def written(spark):
    rng = random.Random(12)
    bench = [(i, corpus.sentence(rng, 30)) for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        text = corpus.sentence(rng, rng.randint(20, 80))
        toxic = int(i % 6 == 0)
        if toxic:
            text += " you idiot " + rng.choice(["scum", "moron"])
        if i % 25 == 3:
            text += " " + bench[i % 5][1]
        rows.append((i, text, "en" if i % 4 else "de"))
        labels.append((i, 1, toxic))
    rows += [(1000 + k, rows[7][1], "en") for k in range(60)] + [(2000, None, None), (2001, "", "en"), (2002, "!!! 12", "en")]
    folder = Scratch(spark).path("tables")
    corpus.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_each_stage_does_what_its_operator_says(spark):
    folder = written(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scratch = Scratch(spark)
    verdicts = [
        lambda d: {r["doc_id"] for r in toxicity.score(d, toxicity.train(d, toxicity.learnable(spark.read.parquet(f"{folder}/labels.parquet")))).collect() if r["predicted"]},
        lambda d: {r["doc_id"] for r in langid.identify(d, langid.train(langid.learnable(d))).collect() if r["rejected"]},
        lambda d: {r["doc_id"] for r in neardup.near_duplicates(d).collect() if not r["kept"]},
        lambda d: {r["doc_id"] for r in decontam.contaminated(d, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}]
    for (name, stage), verdict in zip(corpus_pipeline.STAGES[:-1], verdicts, strict=True):
        gone, before = verdict(docs), {r["doc_id"] for r in docs.collect()}
        after = scratch.keep(stage(spark, docs, folder), name)
        assert after.columns == docs.columns
        assert {r["doc_id"] for r in after.collect()} == before - gone and gone, name
        docs = after
    last = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in docs.collect()}
    assert 2002 not in {r["doc_id"] for r in docs.collect()} and 1 in {r["doc_id"] for r in docs.collect()}


def test_near_dedup_stage_drops_copies_from_80_percent(spark):
    rng = random.Random(6)
    new = lambda k: [f"v{rng.randrange(10**12)}" for _ in range(k)]
    rows = []
    for i in range(60):  # a copy at 108 of 132 shingles, another text's copy at 106 of 134
        w, v = new(124), new(124)
        rows += [(i, " ".join(w)), (100 + i, " ".join(w[:50] + new(8) + w[58:]))]
        rows += [(200 + i, " ".join(v)), (300 + i, " ".join(v[:50] + new(10) + v[60:]))]
    kept = corpus_pipeline.drop_near_duplicates(spark, corpus.frame(spark, rows), "")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if not 100 <= i < 200}


def test_membership_filter(spark):
    docs = corpus.frame(spark, [(i, "x") for i in range(500)] + [(None, "x"), (-5, "y"), (3, "again")])
    ids = spark.createDataFrame([(i,) for i in range(0, 500, 7)] + [(-5,), (10**15,)], "id long")
    flagged = maybe_among(docs, "doc_id", ids)
    assert {r["doc_id"] for r in flagged.filter("_maybe").collect()} >= {*range(0, 500, 7), -5}
    left = sorted((r["doc_id"] for r in without(docs, "doc_id", ids).collect()), key=repr)
    assert left == sorted([i for i in range(500) if i % 7] + [None, 3], key=repr)


def test_all_are_registered():
    names = contract.queries()
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) < set(names) and "pipeline" in names and set(queries.SQL) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "decontamination", "byte_bpe"]
