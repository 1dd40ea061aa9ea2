"""Ids against the tiktoken library, round trips and the perfect hash."""

import base64
import hashlib
import random
import struct

import corpus
import public_tokenizers
import tiktoken
from wirelens.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert sorted(map(table.slot, keys)) == list(range(5000))
    assert all(table.slot(b"x" + k) == -1 for k in keys)
    assert bpe.PerfectHash([]).slot(b"") == -1


def test_random_strings_equal_the_library():
    rng, want = random.Random(6), library()
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "1", "23", "!", "'s", "'LL", "　", "\xa0", "中", "🙂", "the", " of", "\x1c", "<|endoftext|>"]
    encoder = bpe.Encoder(bpe.codec(PATH, PATTERN))
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = want.encode_ordinary(text)
        assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def test_rows_equal_the_library(spark):
    rng, want = random.Random(7), library()
    rows = [*corpus.edges(), *[(100 + i, corpus.sentence(rng, 80).capitalize() + ".\n") for i in range(30)], (500, "x" * 20_000), (501, "ab" * 9000 + " end")]
    got = bpe.digests(bpe.decode(bpe.encode(corpus.frame(spark, rows), PATH, PATTERN), PATH, PATTERN)).collect()
    expected = []
    for i, text, *_ in rows:
        ids = want.encode_ordinary(text or "")
        expected.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert bpe.encode(corpus.frame(spark, []), PATH, PATTERN).count() == 0
