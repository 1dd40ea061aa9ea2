"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import functools
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import FORGET, in_small_batches, slices

#: A space with white space (or a border of the text) on both sides: the text can't be cut there.
ODD_SPACE = re.compile(r"\s \s|^ \s|\s $|^ $")
#: White space besides the space and the line feed.
RARE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n")


def odd_space(text: str) -> bool:
    """Whether a space of ``text`` has white space (or a border) on both sides."""
    likely = ("  " in text or "\n \n" in text or text.startswith(" ") or text.endswith(" ") or any(c in text for c in RARE_SPACE))
    return likely and ODD_SPACE.search(text) is not None


#: Longer pieces are not remembered.
LONGEST = 128
#: Bytes that the pieces a Python worker remembers from task to task may take, in all.
MEMORY = 160 << 20
#: Of a remembered piece besides its characters and ids: two objects and a place in a dictionary.
OVERHEAD = 200


class PerfectHash:
    """Hash and displace: every key has a slot of its own, and no slot is empty."""

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = n // 3 + 1
        groups: dict[int, list[tuple[int, int, bytes]]] = {}
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h >> 40, (h >> 16) & 0xFFFFFF, key))
        self.shift = [0] * self.buckets
        self.slots: list[bytes | None] = [None] * n
        free = 0
        for b, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:  # takes the next free slot; stored as a negative number
                while self.slots[free] is not None:
                    free += 1
                self.shift[b] = -free - 1
                self.slots[free] = members[0][2]
                continue
            d = 0
            while True:
                taken = [(f + d * (g | 1) + d * d) % n for f, g, _ in members]
                if len(set(taken)) == len(taken) and all(self.slots[t] is None for t in taken):
                    break
                d += 1
            self.shift[b] = d
            for t, (_, _, key) in zip(taken, members, strict=True):
                self.slots[t] = key

    def slot(self, key: bytes) -> int:
        """The slot of ``key``, or -1 if it is none of the keys."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        t = -d - 1 if d < 0 else ((h >> 40) + d * (((h >> 16) & 0xFFFFFF) | 1) + d * d) % self.n
        return t if self.slots[t] == key else -1


class Codec:
    """Ranks of a vocabulary, ready to encode and decode."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.table = PerfectHash(list(ranks))
        self.ids = [struct.pack("<I", ranks[k]) if k is not None else b"" for k in self.table.slots]
        self.tokens = {i: b for b, i in ranks.items()}

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def pre_token(self, token: str) -> bytes:
        data = token.encode("utf-8", "surrogatepass")
        at = self.table.slot(data)
        return self.ids[at] if at >= 0 else self.merged(data)

    def merged(self, data: bytes) -> bytes:
        """Ids of a pre-token that is no entry: the lowest-ranked, then leftmost pair merges first.

        ``after`` and ``before`` link the parts by where they begin; a heap entry is the
        pair's rank and place in one number, stale once the pair at that place has changed.
        """
        n, get = len(data), self.ranks.get
        after, before = list(range(1, n + 2)), list(range(-1, n))
        at = [get(data[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair that begins here
        at.append(-1)
        heap = [r * n + i for i, r in enumerate(at) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i = divmod(pop(heap), n)
            if at[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            at[j] = at[i] = -1
            if k < n:
                before[k] = i
                r = get(data[i : after[k]])
                if r is not None:
                    at[i] = r
                    push(heap, r * n + i)
            if i:
                h = before[i]
                r = get(data[h:k])
                if r is None:
                    at[h] = -1
                else:
                    at[h] = r
                    push(heap, r * n + h)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            k = after[i]
            out.append(ranks[data[i:k]])
            i = k
        return struct.pack(f"<{len(out)}I", *out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec.load(path, pattern)


class Room:
    """One budget of bytes for several memories.

    When half of it is used up, what the memories hold becomes their older half, and the
    older half before is forgotten; pieces asked for again move to the new one.
    """

    def __init__(self, size: int):
        self.half, self.used, self.users = size // 2, 0, []

    def take(self, size: int) -> None:
        self.used += size
        if self.used > self.half:
            for user in self.users:
                user.old = dict(user)
                user.clear()
            self.used = size

    def forget(self) -> None:
        self.used = 0
        for user in self.users:
            user.old = {}
            user.clear()


class Pieces(dict):
    """Ids of a piece of text by the piece, remembered as far as ``room`` allows; ``lead`` goes before it."""

    def __init__(self, code: Codec, lead: str, room: Room):
        super().__init__()
        self.code, self.lead, self.room, self.old = code, lead, room, {}
        room.users.append(self)

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            found = self.code.find(self.lead + piece)
            if len(found) > 1 and self.lead and len(found[0]) > 1 and not found[0][1].isspace():
                # A word before a mark is a piece of its own, and likely known.
                ids = self[found[0][1:]] + b"".join(map(self.code.pre_token, found[1:]))
            else:
                ids = b"".join(map(self.code.pre_token, found))
        if len(piece) <= LONGEST:
            self.room.take(len(piece) + len(ids) + OVERHEAD)
            self[piece] = ids
        return ids


class Encoder:
    """Encodes whole texts.

    Where a single space follows or precedes a character that is no white space, a
    match of the pattern begins at that space whatever stands around it. So texts are
    cut there and pieces remembered; a text with a space that lies between white space
    is matched as a whole.
    """

    def __init__(self, code: Codec):
        self.room = Room(MEMORY)
        self.code, self.first, self.spaced = code, Pieces(code, "", self.room), Pieces(code, " ", self.room)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if odd_space(text):
            return b"".join(map(self.first.__getitem__, self.code.find(text)))
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))


@functools.lru_cache(1)
def encoder(path: str, pattern: str) -> Encoder:
    """One a worker process: later tasks find what earlier ones have learnt, until other work comes to the process."""
    found = Encoder(codec(path, pattern))
    FORGET["bpe"] = found.room.forget
    return found


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every row of ``docs`` (doc_id, text).

    ``path`` names a file of base64 tokens and ranks that every executor has. Null and
    empty texts have no ids; special tokens are ordinary text. Other columns are not read.
    """

    def run(batches):
        known = encoder(path, pattern)
        for part in slices(batches, "bpe"):
            ids = [known.encode(text) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the bytes that the ids stand for.

    Null and empty ids give no bytes, a null doc_id stays null, repeated rows are decoded
    each; an empty table stays empty. An id outside the vocabulary is an error.
    """

    def run(batches):
        code = codec(path, pattern)
        for part in slices(batches, "bpe"):
            data = [code.decode(ids or b"") for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and both digests of every row of ``decode``'s result; no ids have the digest of nothing."""
    return decoded.select(
        "doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
