"""Leaks against brute-force tiling: whole, in parts, reordered, by chance."""

import random

import corpus
import numpy as np
from wirelens.llm import decontam
from wirelens.llm.common import WordIds


def greedy(doc, item, size):
    """Covered item tokens by the plain algorithm: longest unmarked match first."""
    in_doc, in_item, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in in_doc and b + n not in in_item:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < size:
            return covered
        covered += n
        in_doc |= set(range(a, a + n))
        in_item |= set(range(b, b + n))


def planted(seed=2):
    rng = random.Random(seed)
    items = [(i, corpus.sentence(rng, rng.randint(15, 40)).capitalize() + ".") for i in range(12)]
    items += [(90, "three word item"), (91, None), (92, ""), (None, "no name for this")]
    docs = []
    for i in range(80):
        words = corpus.sentence(rng, 60).split()
        w = items[i % 12][1].lower().rstrip(".").split()
        kind = i % 5
        if kind == 1:
            words[20:20] = w
        if kind == 2:
            cut = len(w) // 2
            words[40:40] = w[:cut]
            words[5:5] = w[cut:]
        if kind == 3:
            words[9:9] = w[: rng.randint(3, len(w))]
        docs.append((i, " ".join(words) if kind != 1 else "\n".join(words).upper()))
    docs += [(200, "a three word item here"), (201, (items[0][1] + " ") * 50)]
    return docs, items


def test_equals_greedy_tiling(spark):
    docs, items = planted()
    item_rows = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, hash string")
    for block in (2_000_000, 40):
        tiling = decontam.Tiling(block=block)
        got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(corpus.frame(spark, docs + corpus.edges()), item_rows, tiling).collect()}
        want = {}
        for d, text, *_ in docs:
            for i, item in items:
                a, b = (decontam._TOKEN.findall((t or "").lower()) for t in (text, item))
                if i is not None and b:
                    covered = greedy(a, b, min(tiling.seed, len(b))) if len(set(a) & set(b)) > 2 and d != 201 else 0
                    if covered >= tiling.coverage * len(b):
                        want[d, i] = covered
        want[201, 0] = len(decontam._TOKEN.findall(items[0][1]))
        assert {k: r["covered"] for k, r in got.items()} == want
    assert len(want) > 30 and any(r["n_tiles"] > 1 for r in got.values())


def test_clean_rows_stay(spark):
    docs, items = planted(5)
    rows = corpus.frame(spark, docs + corpus.edges())
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    # The edge rows repeat ids of planted rows, so each half is judged alone.
    halves = [[d[:2] for d in part] for part in (docs, corpus.edges())]
    gone = [{r["doc_id"] for r in decontam.contaminated(corpus.frame(spark, part), benchmark).collect()} for part in halves]
    kept = decontam.decontaminated(rows, benchmark)
    assert kept.columns == rows.columns
    want = [d[0] for part, bad in zip(halves, gone, strict=True) for d in part if d[0] not in bad]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    docs, items = planted()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.contaminated(corpus.frame(spark, []), benchmark).count() == 0
    assert decontam.contaminated(corpus.frame(spark, docs), benchmark.limit(0)).count() == 0


def test_rolling_hash_is_that_of_each_window():
    x = decontam.tokens(corpus.sentence(random.Random(1), 300), WordIds())
    for size in (1, 4, 7):
        h = decontam.windows(x, size)
        assert len(h) == 301 - size
        assert (h == [decontam.windows(x[k : k + size], size)[0] for k in range(len(h))]).all()
    assert not len(decontam.windows(x[:3], 4)) and isinstance(h, np.ndarray)


def test_rows_that_repeat_an_id_are_matched_alone(spark):
    item = " ".join(f"word{i}" for i in range(20)).split()
    part = lambda a, b: " ".join(["other", "things", *item[a:b], "and", "more"])
    rows = [(1, part(0, 9)), (1, part(11, 20)), (2, part(0, 20)), (2, "a clean text under that id"), (None, part(0, 20))]
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    docs = corpus.frame(spark, rows).withColumnsRenamed({"label": "_spot", "node": "_GONE", "score": "_maybe", "hash": "content"})
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()] == [(2, 7)]
    kept = decontam.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted((tuple(r) for r in docs.collect() if r["text"] != rows[2][1] or r["doc_id"] is None), key=repr)
