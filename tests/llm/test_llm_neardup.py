"""Near-duplicates against brute force: copies, near copies, chains, hot groups, odd rows."""

import random
from collections import Counter
from itertools import combinations

import corpus
import numpy as np
from wirelens.llm import graph, neardup
from wirelens.llm.common import Scratch


def sets_of(rows):
    out = []
    for i, text, *_ in rows:
        w = corpus.words(text, lower=True)
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute(rows):
    """Component by row of (doc_id, text): equal sets and pairs from 85 % on."""
    known = sets_of(rows)
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        (i, x), (j, y) = known[a], known[b]
        if i is None or j is None or not x or not y:
            continue
        if 100 * len(x & y) >= 85 * len(x | y):
            top[max(find(a), find(b))] = min(find(a), find(b))
    names = {}
    for k, (i, _) in enumerate(known):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return [(i, len(s), None if i is None else names[find(k)]) for k, (i, s) in enumerate(known)]


def planted(seed=3):
    rng = random.Random(seed)
    rows, n = [], 100
    for _ in range(40):
        base = corpus.sentence(rng, rng.randint(30, 200)).split()
        rows.append((n, " ".join(base)))
        n += 1
        for _ in range(rng.randint(0, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "changed" + str(rng.randrange(1000))
            rows.append((n, " ".join(w).upper() if rng.random() < 0.3 else "  ".join(w)))
            n += 1
    hot = corpus.sentence(rng, 120).split()
    for _ in range(80):  # one large group: each differs by a word, and copies of each
        w = list(hot)
        w[rng.randrange(len(w))] = "z" + str(rng.randrange(10**6))
        for _ in range(2):
            rows.append((n, " ".join(w)))
            n += 1
    chain = [f"w{k}" for k in range(200)]
    for step in range(12):  # neighbours are similar, the ends are not
        rows.append((n, " ".join(chain[step * 8 : step * 8 + 120])))
        n += 1
    rng.shuffle(rows)
    return rows


def result(spark, rows):
    got = neardup.near_duplicates(corpus.frame(spark, rows)).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr), got


def test_planted_groups_equal_brute_force(spark):
    rows = planted()
    got, full = result(spark, rows)
    assert got == sorted(brute(rows), key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in full)


def test_odd_rows(spark):
    rows = corpus.edges()
    got, full = result(spark, rows)
    assert got == sorted(brute(rows), key=repr)
    assert [r["kept"] for r in full if r["doc_id"] is None] == [True]


def test_empty_table(spark):
    assert neardup.near_duplicates(corpus.frame(spark, [])).count() == 0


def test_kept_rows_keep_all_columns(spark):
    docs = corpus.frame(spark, planted(4)[:120])
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    components = {r[2] for r in brute([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert {r["doc_id"] for r in kept.collect()} == components


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 120)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert {(r["node"], r["label"]) for r in got} == {(i, 1) for i in range(1, 121)} | {(1000 + k, 1000) for k in range(300)}
    assert len(got) == 420


def template_rows(n, seed=11):
    """Texts of one template, pairwise at 0.80; every tenth has a partner at 0.875 far away by id."""
    rng = random.Random(seed)
    new = lambda k: [f"v{rng.randrange(10**12)}" for _ in range(k)]
    base, texts, partners = new(124), [], []
    for i in range(n):
        w = base[:40] + new(9) + base[49:]
        texts.append(w)
        if i % 10 == 0:
            partners.append(w[:90] + new(4) + w[94:])
    return [(i, " ".join(w)) for i, w in enumerate(texts + partners)]


def brute_by_counts(rows, percent):
    """Component by id, from the counts of common shingles of all pairs."""
    sets = [s for _, s in sets_of(rows)]
    often = Counter(g for s in sets for g in s)
    at = {g: k for k, g in enumerate(g for g, c in often.items() if c > 1)}
    m = np.zeros((len(sets), len(at)), np.float32)
    for i, s in enumerate(sets):
        m[i, [at[g] for g in s if g in at]] = 1
    n, both = np.array([len(s) for s in sets]), m @ m.T
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1)), strict=True):
        top[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_links_inside_a_large_region_of_one_template(spark):
    rows = template_rows(4000)
    want = brute_by_counts(rows, 85)
    assert sum(i != c for i, c in want.items()) == 400
    _, full = result(spark, rows)
    assert {r["doc_id"]: r["component_id"] for r in full} == want


def test_removal_goes_by_row_and_spares_clashing_columns(spark):
    rng = random.Random(3)
    text, other = corpus.sentence(rng, 60), corpus.sentence(rng, 60)
    docs = corpus.frame(spark, [(1, text), (5, text), (5, other), (9, other), (None, text), (7, None)])
    docs = docs.withColumnsRenamed({"label": "_spot", "node": "_gone", "score": "_bucket", "hash": "key0", "part": "_marks"})
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["_spot"], r["_gone"], r["key0"]) for r in kept.collect()), key=repr) == sorted(
        [(i, t, "x", "y", "h") for i, t in [(1, text), (5, other), (None, text), (7, None)]], key=repr)
