"""Benchmark passages in documents, found by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import Scratch, WordIds, in_small_batches, mixed, row_key, slices, without

_TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Tiling:
    """``seed`` tokens in a row are the shortest match; an item is contaminated from ``coverage`` on.

    Items with fewer tokens than ``seed`` are their own seed. Items are taken in blocks of
    ``block`` seeds, whose hashes (8 bytes each) go to every task.
    """

    seed: int = 4
    coverage: float = 0.5
    block: int = 2_000_000


def tokens(text: str | None, ids: WordIds) -> np.ndarray:
    """Hashes of the lower-cased runs of letters and digits."""
    words = _TOKEN.findall((text or "").lower())
    return np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))


def windows(x: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``size`` tokens, rolled over the whole sequence.

    hash(i) = x[i] B^(size-1) + ... + x[i+size-1] modulo 2^64, from prefix hashes
    P(i) = P(i-1) / B + x[i]: B is odd, so it has an inverse.
    """
    n = len(x) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    back = np.full(len(x), pow(base, -1, 1 << 64), np.uint64)
    back[0] = np.uint64(1)
    down = np.multiply.accumulate(back)  # B^-i
    sums = np.r_[np.uint64(0), np.cumsum(x * down, dtype=np.uint64)]
    up = np.full(n, base, np.uint64)
    up[0] = np.uint64(pow(base, size - 1, 1 << 64))
    return mixed((sums[size:] - sums[:-size]) * np.multiply.accumulate(up) + np.uint64(size))


def seeds(items: DataFrame, tiling: Tiling) -> DataFrame:
    """(item_id, n_item, size, at, hash) of every seed of every benchmark item (item_id, text)."""

    def run(batches):
        ids = WordIds()
        for part in slices(batches):
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                x = tokens(text, ids)
                size = min(tiling.seed, len(x))
                if not size:
                    continue
                h = windows(x, size)
                k = len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * k, pa.int64()), pa.array([len(x)] * k, pa.int64()), pa.array([size] * k, pa.int32()),
                     pa.array(np.arange(k)), pa.array(h.view(np.int64))], ["item_id", "n_item", "size", "at", "hash"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(
        run, "item_id long, n_item long, size int, at long, hash long")


def hits(docs: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """(doc_id, content, doc_at, hash) of the windows of ``docs`` whose hash is in a sorted array of seeds, by size.

    ``content`` is a hash of the text: rows that repeat an id are matched each on its own.
    """

    def run(batches):
        ids = WordIds()
        for part in slices(batches):
            names, contents, ats, found = [], [], [], []
            for name, text, content in zip(*(c.to_pylist() for c in part.columns), strict=True):
                x = tokens(text, ids)
                for size, known in wanted.items():
                    h = windows(x, size).view(np.int64)
                    place = np.searchsorted(known, h)
                    at = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == h)
                    if len(at):
                        names.append(np.full(len(at), name))
                        contents.append(np.full(len(at), content))
                        ats.append(at)
                        found.append(h[at])
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (names, contents, ats, found)], ["doc_id", "content", "doc_at", "hash"])

    rows = in_small_batches(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("content"))
    return rows.mapInArrow(run, "doc_id long, content long, doc_at long, hash long")


def tiles(doc_at: np.ndarray, at: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document position, item position, length) from matching seeds.

    Consecutive seeds of one diagonal form a maximal match. The longest unmarked match is
    marked in both texts, what it covers is cut off the others, until none of ``size``
    tokens is left. Equally long matches go by document, then item position.
    """
    order = np.lexsort((doc_at, doc_at - at))
    d, i = doc_at[order], at[order]
    breaks = np.flatnonzero(np.r_[True, (np.diff(d - i) != 0) | (np.diff(d) != 1)])
    lengths = np.diff(np.r_[breaks, len(d)]) + size - 1
    open_ = [(int(n), int(d[b]), int(i[b])) for b, n in zip(breaks, lengths, strict=True)]
    in_doc, in_item, out = set(), set(), []
    heap = [(-n, a, b) for n, a, b in open_]
    heapq.heapify(heap)
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [a + k not in in_doc and b + k not in in_item for k in range(n)]
        if all(free):
            out.append((a, b, n))
            in_doc.update(range(a, a + n))
            in_item.update(range(b, b + n))
            continue
        k = 0
        while k < n:  # what is left of it competes again
            stop = k
            while stop < n and free[stop]:
                stop += 1
            if stop - k >= size:
                heapq.heappush(heap, (k - stop, a + k, b + k))
            k = stop + 1
    return out


FOUND = "doc_id long, item_id long, n_item long, covered long, coverage double, n_tiles int, tiles array<struct<doc_at:long,item_at:long,length:long>>"

ROW = ["doc_id", "content"]
MATCHED = FOUND.replace("item_id", "content long, item_id", 1)


def contaminated(docs: DataFrame, items: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """Pairs of ``docs`` (doc_id, text) and ``items`` (item_id, text) whose tiles cover enough of the item.

    Positions count tokens. Reordered passages keep their coverage, as tiles lie in any
    order. Null or tokenless texts and null ids match nothing; rows that repeat an id are
    matched each on its own, and the id's best row is told. No pair, no row; each pair once.
    """
    best = F.max(F.struct("covered", "coverage", "n_item", "n_tiles", "tiles")).alias("best")
    found = _matched(docs, items, tiling).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", *[f"best.{f.split(' ')[0]}" for f in FOUND.split(", ")[2:]])


def _matched(docs: DataFrame, items: DataFrame, tiling: Tiling) -> DataFrame:
    """``FOUND`` of every text and item, with ``content``, which tells rows of one id apart."""
    scratch = Scratch(docs.sparkSession)
    known = scratch.keep(seeds(items.filter("item_id IS NOT NULL"), tiling), "seeds")
    blocks = -(-max(1, known.count()) // tiling.block)
    out = None
    for block in range(blocks):
        mine = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else known
        sizes = [r["size"] for r in mine.select("size").distinct().collect()]
        # About ``tiling.block`` hashes of 8 bytes: a bounded part of a stated query set.
        wanted = {}
        for size in sorted(sizes):
            column = mine.filter(F.col("size") == size).select("hash").distinct().toPandas()["hash"]
            wanted[size] = np.sort(column.to_numpy(np.int64))
        if not wanted:
            continue
        pairs = scratch.keep(hits(docs, wanted).join(mine, "hash"), f"hits{block}")
        # Seeds bound the coverage from above: most chance pairs end here, before any grouping of rows.
        enough = pairs.groupBy(*ROW, "item_id").agg(
            F.count_distinct("at").alias("k"), F.max("size").alias("s"), F.max("n_item").alias("m")).filter(
            F.col("k") * F.col("s") >= tiling.coverage * F.col("m")).select(*ROW, "item_id")
        kept = pairs.join(enough, [*ROW, "item_id"], "left_semi")
        found = kept.groupBy(*ROW, "item_id").applyInPandas(_tiler(tiling), MATCHED)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], MATCHED)
    return out


def _tiler(tiling: Tiling):
    def run(key, rows):
        import pandas as pd

        rows = rows.drop_duplicates(["doc_at", "at"])
        n = int(rows["n_item"].iloc[0])
        found = tiles(rows["doc_at"].to_numpy(), rows["at"].to_numpy(), int(rows["size"].iloc[0]))
        covered = sum(t[2] for t in found)
        if covered < tiling.coverage * n:
            return pd.DataFrame(columns=[f.split(" ")[0] for f in MATCHED.split(", ")])
        return pd.DataFrame([[*key, n, covered, covered / n, len(found), [{"doc_at": a, "item_at": b, "length": k} for a, b, k in found]]],
                            columns=[*ROW, "item_id", "n_item", "covered", "coverage", "n_tiles", "tiles"])

    return run


def decontaminated(docs: DataFrame, items: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, all columns unchanged.

    Rows are told apart by id and text, so a repeated id loses only the rows whose own
    text holds an item; equal rows go together. Null texts and null ids stay, and without
    items all rows do.
    """
    return without(docs, row_key(docs), _matched(docs, items, tiling).select(*ROW).distinct())
