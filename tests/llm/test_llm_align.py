"""Alignment against a plain walk over both token lists and plain counts."""

import hashlib
import random
from collections import Counter

import corpus
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer
from wirelens.llm import align

NAMES = align.Vocabularies(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(NAMES.a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=NAMES.b)


def plain(libraries, text):
    """(A ids, B ids) of each group, by walking both lists byte by byte."""
    if not text:
        return []
    first, second = libraries
    own = align.tools(NAMES)
    data = b" " + text.encode()
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    if b"".join(own.a.bytes[i] for i in a) != data or b"".join(own.b.bytes[i] for i in b) != data:
        return []
    out, i, j, end_a, end_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if end_a <= end_b and i < len(a):
            end_a += len(own.a.bytes[a[i]])
            out[-1][0].append(a[i])
            i += 1
        else:
            end_b += len(own.b.bytes[b[j]])
            out[-1][1].append(b[j])
            j += 1
        if end_a == end_b:
            out.append(([], []))
    return out[:-1]


def brute(libraries, rows):
    groups = [plain(libraries, r[1]) for r in rows]
    counts = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for row, g in zip(rows, groups, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        links = [(a[-1], b[-1]) for a, b in g]
        out.append((row[0], sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), hashlib.sha256(text.encode()).hexdigest() if g else "",
                    sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links)))
    return out


ODD = ["<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b changes", "▁", "\n\n\n", " ", "   three  spaces   ", "\x00\x01", "naïve café ßü 中文字 🙂🙂 ​﻿ x", "don't I'll we've", "1234567 8901 ٣٤", "ｆｕｌｌ　ｗｉｄｔｈ", "é ͸ \U00010940"]


def test_digests_equal_a_plain_walk(spark, libraries):
    rng = random.Random(4)
    rows = [(i, corpus.sentence(rng, rng.randint(0, 80))) for i in range(150)] + [(900 + i, t) for i, t in enumerate(ODD)] + corpus.edges()
    got = align.digests(corpus.frame(spark, rows), NAMES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(libraries, rows), key=repr)


def test_cuts_rebuild_the_groups(spark, libraries):
    rows = [(i, t) for i, t in enumerate([*ODD, None, "", "several plain words, and some more"])]
    for r in align.align(corpus.frame(spark, rows), NAMES).collect():
        groups = [(r["a_ids"][i:j], r["b_ids"][k:m]) for i, j, k, m in zip(r["a_cuts"], r["a_cuts"][1:], r["b_cuts"], r["b_cuts"][1:], strict=False)]
        assert groups == plain(libraries, rows[r["doc_id"]][1])


def test_gallop_equals_binary_search():
    rng = np.random.default_rng(3)
    for n, m in [(0, 5), (5, 0), (1, 1), (3, 900), (700, 900), (900, 700), (40, 40_000), (3000, 3000)]:
        a, b = (np.unique(rng.integers(0, 3 * max(n, m, 1), k)) for k in (n, m))
        assert align.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()
        ia, ib = align.common(a, b)
        assert a[ia].tolist() == b[ib].tolist() == np.intersect1d(a, b).tolist()


def test_every_character_splits_alike(libraries):
    """The rank library and the json file's own agree around every code point."""
    own, library = align.tools(NAMES).a, libraries[0]
    marks = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(marks), 3000):
        texts = [f"a{c} {c}1{c}{c}." for c in marks[start : start + 3000]]
        joined = "\n".join(texts)
        if own.encode(joined) != library.encode(joined, add_special_tokens=False).ids:
            wrong = [hex(ord(t[1])) for t in texts if own.encode(t) != library.encode(t, add_special_tokens=False).ids]
            raise AssertionError(wrong[:20])


def test_long_white_space_and_empty_table(spark, libraries):
    text = "x" + " " * 300_000 + "y" + "\n" * 5000
    rows = [(1, text)]
    assert sorted(map(tuple, align.digests(corpus.frame(spark, rows), NAMES).collect())) == brute(libraries, rows)
    assert align.digests(corpus.frame(spark, []), NAMES).count() == 0
