"""Shards against one sorted pass."""

import random
import zlib

import corpus
from wirelens.llm import sharding


def brute(rows, count):
    rows = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, before, out, slots = sum(r[1] for r in rows), 0, [], {}
    for i, size, crc in rows:
        shard = min(count - 1, (2 * before + size) * count // (2 * total))
        slot = slots[shard] = slots.get(shard, -1) + 1
        out.append((i, size, crc, "bytes", shard, slot, None))
        before += size
    return out


def test_shards_equal_one_pass(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(300), corpus.sentence(rng, rng.randint(0, 60))) for _ in range(400)] + corpus.edges()
    rows += [(77, "the same row")] * 150
    for count in (8, 3):
        got = sharding.shards(corpus.frame(spark, rows), count, runs=7).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, count), key=repr)


def test_sizes_are_near_equal_and_slots_gapless(spark):
    rng = random.Random(3)
    rows = [(i, corpus.sentence(rng, rng.randint(1, 50))) for i in range(1000)]
    got = sharding.shards(corpus.frame(spark, rows)).collect()
    sums = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(sums) - min(sums) <= 2 * max(r["size"] for r in got)
    for s in range(8):
        mine = sorted((r["doc_id"], r["slot"]) for r in got if r["shard"] == s)
        assert [slot for _, slot in mine] == list(range(len(mine)))


def test_empty_table(spark):
    assert sharding.shards(corpus.frame(spark, [])).count() == 0
