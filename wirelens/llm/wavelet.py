"""Token files as wavelet matrices: one per shard, with rank directories for direct questions."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm.bpe import odd_space
from wirelens.llm.common import in_small_batches, slices

#: Bits between two entries of a rank directory.
STEP = 512
SHARD_TOKENS = 1 << 22
#: Pieces that a Python worker remembers from task to task, about 200 bytes each.
MEMORY = 1_000_000
#: Bytes of texts that are cut into pieces together.
TOGETHER = 1 << 23
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Where a pre-token ends whatever surrounds it: after a letter that none follows, and after a single line feed before a letter.
BORDER = re.compile(f"(?<=[{LETTER}])(?=[\\x00-@\\[-`{{-\\x7f])|(?<=[{LETTER}!-~]\n)(?=[{LETTER}])")
FILE = "part int, block int, n long, doc_ids array<long>, lengths array<long>, bits int, zeros array<long>, planes binary, ranks binary"


class WaveletMatrix:
    """A sequence of ids as bit-planes, the highest bit first.

    At each plane ids with a 0 go stably before those with a 1, so every question
    follows one position per plane by rank (down) or select (up).
    """

    def __init__(self, n: int, bits: int, zeros: list[int], planes: bytes, ranks: bytes):
        self.n, self.bits, self.zeros = n, bits, zeros
        self.planes = np.frombuffer(planes, np.uint8).reshape(bits, -1) if n else np.empty((bits, 0), np.uint8)
        self.ranks = np.frombuffer(ranks, "<u4").reshape(bits, -1)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n, zeros, planes, ranks = len(ids), [], [], []
        width = -(-n // STEP) * STEP // 8
        for level in range(bits):
            one = (ids & ids.dtype.type(1 << (bits - 1 - level))) != 0
            plane = np.zeros(width, np.uint8)
            packed = np.packbits(one, bitorder="little")
            plane[: len(packed)] = packed
            sums = np.bitwise_count(plane.view(np.uint64)).reshape(-1, STEP // 64).sum(axis=1, dtype=np.int64)
            ranks.append(np.r_[0, np.cumsum(sums)].astype("<u4").tobytes())
            low = ids.take(np.flatnonzero(~one))  # places cost less than a mask whose bits alternate
            zeros.append(len(low))
            planes.append(plane.tobytes())
            ids = np.concatenate([low, ids.take(np.flatnonzero(one))])
        return cls(n, bits, zeros, b"".join(planes), b"".join(ranks))

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level, i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        block = i // STEP
        data = self.planes[level, block * STEP // 8 : -(-i // 8)]
        extra = int(np.bitwise_count(data).sum())
        if i & 7 and len(data):
            extra -= int(data[-1] >> (i & 7)).bit_count()
        return int(self.ranks[level, block]) + extra

    def _find(self, level: int, k: int, one: bool) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        count = self.ranks[level].astype(np.int64)
        if not one:
            count = np.arange(len(count)) * STEP - count
        block = int(np.searchsorted(count, k, side="right")) - 1
        flags = np.unpackbits(self.planes[level, block * STEP // 8 : (block + 1) * STEP // 8], bitorder="little") == one
        return block * STEP + int(np.flatnonzero(flags)[k - int(count[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            b, ones = self._bit(level, i), self._ones(level, i)
            i = self.zeros[level] + ones if b else i - ones
            value = value << 1 | b
        return value

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` before position ``i``."""
        start = 0
        for level in range(self.bits):
            one = value >> (self.bits - 1 - level) & 1
            a, b = self._ones(level, start), self._ones(level, i)
            start, i = (self.zeros[level] + a, self.zeros[level] + b) if one else (start - a, i - b)
        return i - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``value``, or -1."""
        start, steps = 0, []
        if not 0 <= k < self.count(value):
            return -1
        for level in range(self.bits):
            one = value >> (self.bits - 1 - level) & 1
            ones = self._ones(level, start)
            start = self.zeros[level] + ones if one else start - ones
            steps.append(one)
        at = start + k
        for level in reversed(range(self.bits)):
            at = self._find(level, at - self.zeros[level] if steps[level] else at, bool(steps[level]))
        return at

    def all(self) -> np.ndarray:
        """The whole sequence, plane by plane from the lowest bit."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            low, z = out, self.zeros[level]
            out = np.empty_like(low)
            out[np.flatnonzero(~one)] = low[:z]
            out[np.flatnonzero(one)] = low[z:] | out.dtype.type(1 << (self.bits - 1 - level))
        return out


@functools.lru_cache(2)
def _tokenizer(path: str, added: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = not added
    return found


class Encoder:
    """Ids of whole texts by the tokenizers library, as bytes of ``dtype``.

    Texts are cut at spaces where a pre-token begins in any surroundings (see
    ``bpe.Encoder``); the library encodes each piece once and the ids are remembered.
    With ``added`` the file counts as it is: a text that holds the content of an added
    token goes to the library whole. Without it such contents are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        self.library = _tokenizer(path, added)
        self.contents = [t.content for t in self.library.get_added_tokens_decoder().values()] if added else []
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        #: Which ids begin with a space; no piece has one inside.
        self.opens = np.zeros(self.library.get_vocab_size(), bool)
        self.opens[[i for token, i in self.library.get_vocab().items() if token[0] == "Ġ"]] = True
        #: Ids by first pieces and by pieces after a space.
        self.memory: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def _pack(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        width, whole, at, out = int(self.dtype[-1]), np.array(list(chain.from_iterable(ids)), self.dtype).tobytes(), 0, []
        for one in ids:
            start, at = at, at + width * len(one)
            out.append(whole[start:at])
        return out

    def _ids(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of ``pieces`` where a text begins, or after a space; those with a border inside are put together from their parts."""
        memory = self.memory[bool(lead)]
        found = list(map(memory.get, pieces))
        missing = [i for i, known in enumerate(found) if known is None]
        if len(memory) + len(missing) > MEMORY:
            memory.clear()
        unknown, cut = set(), {}
        for w in map(pieces.__getitem__, missing):
            parts = () if w.isalpha() else tuple(BORDER.split(w))
            if len(parts) > 1:
                cut[w] = parts
            unknown.add(parts[0] if parts else w)
        later = {part for parts in cut.values() for part in parts[1:]}
        if not lead:
            unknown |= later
        unknown -= memory.keys()
        # In order, so that the library meets together what begins alike; words of letters are sure to be cut well when joined.
        words = sorted(filter(str.isalpha, unknown))
        for these in (words, sorted(unknown.difference(words))):
            for at in range(0, len(these), 4096):
                some = these[at : at + 4096]
                memory.update(zip(some, self._spaced(some) if lead else self._pack(some), strict=True))
        after = dict(zip(later, self._ids(list(later), ""), strict=True)) if lead and later else memory
        for i in missing:  # what is put together is not remembered: most of it never comes again
            parts = cut.get(pieces[i])
            found[i] = memory[pieces[i]] if parts is None else memory[parts[0]] + b"".join([after[part] for part in parts[1:]])
        return found

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces after a space: one text, cut before the tokens that begin with a space."""
        if any(not w or w[0].isspace() or w[-1].isspace() for w in pieces):
            return self._pack([" " + w for w in pieces])
        joined = " " + " ".join(pieces)
        if self._holds_added(joined):  # a content with a space in it, made by the joining
            return self._pack([" " + w for w in pieces])
        ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids)
        cuts = np.flatnonzero(self.opens[ids])
        if len(cuts) != len(pieces):
            return self._pack([" " + w for w in pieces])
        width, whole = int(self.dtype[-1]), ids.astype(self.dtype).tobytes()
        ends = [*(cuts[1:] * width).tolist(), len(whole)]
        return [whole[a:b] for a, b in zip((cuts * width).tolist(), ends, strict=True)]

    def _holds_added(self, text: str) -> bool:
        return any(c in text for c in self.contents)

    def batch(self, texts: list[str | None]) -> list[bytes]:
        cut = [bool(t) and not odd_space(t) and not self._holds_added(t) for t in texts]
        found = iter(self._by_pieces([t for t, c in zip(texts, cut, strict=True) if c]))
        return [next(found) if c else self._pack([t])[0] if t else b"" for t, c in zip(texts, cut, strict=True)]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be cut at every space; each piece is looked up once, Arrow lays the ids out."""
        if not texts:
            return []
        rows = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = rows.offsets.to_numpy()
        coded = rows.values.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = rows.values.take(pa.array(bounds[:-1])).to_pylist()
        at = coded.indices.to_numpy().astype(np.int64)
        at[bounds[:-1]] = len(pieces) + np.arange(len(heads))
        ids = pa.array(self._ids(pieces, " ") + self._ids(heads, ""), pa.large_binary()).take(pa.array(at))
        ends, whole = np.frombuffer(ids.buffers()[1], np.int64)[bounds].tolist(), ids.buffers()[2].to_pybytes()
        return [whole[a:b] for a, b in zip(ends, ends[1:])]


@functools.lru_cache(1)
def encoder_of(path: str, added: bool = False) -> Encoder:
    """One a worker process: later tasks find what earlier ones have learnt."""
    return Encoder(path, added)


def gathered(batches: Iterator[pa.RecordBatch], size: int = TOGETHER) -> Iterator[pa.Table]:
    """Consecutive rows of about ``size`` bytes: of more texts at a time, fewer pieces are new."""
    held, total = [], 0
    for rows in slices(batches):
        held.append(rows)
        total += rows.nbytes
        if total >= size:
            yield pa.Table.from_batches(held)
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def shards(docs: DataFrame, path: str, end_id: int, shard_tokens: int = SHARD_TOKENS, added: bool = False) -> DataFrame:
    """Rows of the file format: consecutive documents as one wavelet matrix a row.

    Documents are range-partitioned and sorted by doc_id (null first, equal ids by
    content), each gets ``end_id`` after its ids; a shard ends with the document that
    fills it, so only a longer document makes a larger shard.
    """
    order = [F.asc_nulls_first("doc_id"), F.asc("_tie")]
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_tie"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        part, block = TaskContext.get().partitionId(), 0
        encoder = encoder_of(path, added)
        bits = max(1, max(end_id, encoder.library.get_vocab_size() - 1).bit_length())
        end, width = np.array([end_id], encoder.dtype).tobytes(), int(encoder.dtype[-1])
        ids, names, sizes, total = [], [], [], 0

        def shard():
            m = WaveletMatrix.build(np.frombuffer(b"".join(ids), encoder.dtype), bits)
            row = [part, block, m.n, names, sizes, bits, m.zeros, m.planes.tobytes(), m.ranks.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in FILE.split(", ")])

        for rows_ in gathered(batches):
            for name, data in zip(rows_.column(0).to_pylist(), encoder.batch(rows_.column(1).to_pylist()), strict=True):
                ids.append(data + end)
                names.append(name)
                sizes.append(len(data) // width + 1)
                total += sizes[-1]
                if total >= shard_tokens:
                    yield shard()
                    ids, names, sizes, total, block = [], [], [], 0, block + 1
        if ids:
            yield shard()

    return rows.mapInArrow(run, FILE)


def write(docs: DataFrame, out: str, path: str, end_id: int, shard_tokens: int = SHARD_TOKENS, added: bool = False) -> None:
    shards(docs, path, end_id, shard_tokens, added).write.option("compression", "zstd").parquet(out)


def open_files(spark, out: str) -> DataFrame:
    return spark.read.schema(FILE).parquet(out)


def matrix(row) -> WaveletMatrix:
    return WaveletMatrix(row["n"], row["bits"], row["zeros"], row["planes"], row["ranks"])


def starts(files: DataFrame) -> DataFrame:
    """First token's number of each shard: sums of partitions, then sums within them."""
    sizes = files.groupBy("part", "block").agg(F.sum("n").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part").select(
        "part", "block", (F.col("before") + F.col("inside")).alias("shard_start"))


def documents(files: DataFrame) -> DataFrame:
    """part, block, doc_id, inside, n_tokens, ids (little-endian unsigned 32-bit, end id included).

    All ids are read off the planes; ``inside`` counts from the shard's first token.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids = matrix(row).all().astype("<u4")
                ends = np.cumsum(row["lengths"])
                for at in range(0, len(ends), 512):
                    stop = ends[at : at + 512]
                    begin = stop - np.array(row["lengths"][at : at + 512])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["part"]] * len(stop), pa.int32()), pa.array([row["block"]] * len(stop), pa.int32()),
                         pa.array(row["doc_ids"][at : at + 512], pa.int64()), pa.array(begin, pa.int64()), pa.array(stop - begin, pa.int64()),
                         pa.array([ids[a:b].tobytes() for a, b in zip(begin, stop, strict=True)], pa.binary())],
                        ["part", "block", "doc_id", "inside", "n_tokens", "ids"])

    return files.mapInArrow(run, "part int, block int, doc_id long, inside long, n_tokens long, ids binary")


def placed(found: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``documents`` with ``start``, their first token's number in the whole corpus."""
    return found.join(starts(files), ["part", "block"]).withColumn("start", F.col("shard_start") + F.col("inside")).drop(
        "part", "block", "inside", "shard_start")


def occurrences(files: DataFrame, value: int) -> DataFrame:
    """Shards that have the id ``value`` with its count and its positions in the whole corpus; no row for shards without it."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                m = matrix(row)
                n = m.count(value)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["part"]], pa.int32()), pa.array([row["block"]], pa.int32()), pa.array([n], pa.int64()),
                         pa.array([[m.select(value, k) for k in range(n)]], pa.list_(pa.int64()))], ["part", "block", "count", "at"])

    rows = files.mapInArrow(run, "part int, block int, count long, at array<long>")
    return rows.join(starts(files), ["part", "block"]).select(
        "part", "block", "count", F.transform("at", lambda x: x + F.col("shard_start")).alias("positions"))


def crc32s(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files; only digests are shuffled."""
    found = documents(files).select("part", "block", "doc_id", "inside", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return placed(found, files).select("doc_id", "start", "n_tokens", "ids_crc32")
