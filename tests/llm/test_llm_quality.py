"""Counts of the base rules against plain Python, and the verdict on odd texts."""

import math
import random
import re

import corpus
from wirelens.llm import quality


def brute(text):
    text = text or ""
    w = corpus.words(text)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    counts, marked, seen, dup = {}, set(), set(), 0
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    for k, g in enumerate(grams):
        if counts[g] > 1:
            marked |= set(range(k, k + 5))
    for line in text.split("\n"):
        if corpus.words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def texts():
    rng = random.Random(8)
    out = [corpus.sentence(rng, rng.randint(1, 300)) for _ in range(60)]
    out += [" ".join(rng.choice("ab") for _ in range(n)) for n in (4, 5, 6, 9, 10, 40)]
    out += ["\n".join([out[0], "x #1", "", " ", "x #1", "x #1 ", out[0]]), "| a | b |\n" * 30, "w " * 5000, "a b \x0b c\x0cd\re"]
    return out


def test_counts_and_base_rules(spark):
    rows = [*[(100 + i, t) for i, t in enumerate(texts())], *corpus.edges()]
    got = quality.judged(corpus.frame(spark, rows)).collect()
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append(brute(t))
    assert len(got) == len(rows)
    for r in got:
        found = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert found in want[r["doc_id"]]
        assert r["base_failed"] == (found[0] < 10 or 100 * found[4] > 20 * found[0])
        assert not (r["base_failed"] and r["kept"])


def test_strays_go_and_plain_texts_stay(spark):
    rng = random.Random(1)
    plain = [(i, corpus.sentence(rng, 300), "en") for i in range(200)]
    junk = [(900, " ".join(w + "$%#" for w in corpus.sentence(rng, 300).split()), "en"), (901, "".join(f"{rng.random()} " for _ in range(300)), "en")]
    unknown = [(950, corpus.sentence(rng, 300), None), (951, corpus.sentence(rng, 300), "xx"), (952, corpus.sentence(rng, 20), "de")]
    got = {r["doc_id"]: r for r in quality.judged(corpus.frame(spark, plain + junk + unknown)).collect()}
    assert all(got[i]["kept"] for i in [*range(200), 950, 951, 952])
    assert not got[900]["kept"] and not got[901]["kept"]
    assert got[950]["word_distance"] is None and got[952]["class_distance"] is None


def test_distance_is_jensen_shannon(spark):
    p, q = [3, 0, 5, 2], [1, 4, 0, 5]
    df = spark.createDataFrame([(p, q)], "p array<long>, q array<long>").select(quality.distance("p", "q").alias("d"))
    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda u, v: sum(x * math.log2(x / y) for x, y in zip(u, v, strict=True) if x)
    m = [(x + y) / 2 for x, y in zip(a, b, strict=True)]
    assert abs(df.first()["d"] - math.sqrt((kl(a, m) + kl(b, m)) / 2)) < 1e-9


def test_empty_table_and_no_python(spark):
    assert quality.judged(corpus.frame(spark, [])).count() == 0
    plan = quality.measured(corpus.frame(spark, [(1, "x")]).select("doc_id", "text", "lang"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)
