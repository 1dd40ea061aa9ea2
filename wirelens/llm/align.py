"""Tokens of two tokenizers over the same bytes: where both end, which ids meet there, how often.

The ends of the shorter list gallop through the longer one: steps that double, then a
binary search in the last step. Ends found in both cut the tokens of a text into groups.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wirelens.llm.common import Scratch, in_small_batches, slices

#: Every so many ends one is searched from the one before; those between start from it.
STRIDE = 16
#: Bytes of texts whose tokens are held at once; a longer text is taken alone.
TOGETHER = 1 << 20
#: The columns that ``align`` can return besides doc_id.
OUTPUTS = {
    "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    "a_ids": pa.list_(pa.int32()), "b_ids": pa.list_(pa.int32()), "a_cuts": pa.list_(pa.int32()), "b_cuts": pa.list_(pa.int32()),
    "links": pa.binary(),
}


@dataclass(frozen=True)
class Vocabularies:
    """``a``: a byte-level BPE json file; ``b``: a piece model with byte fallback; ``pattern``: how A splits."""

    a: str
    b: str
    pattern: str


def _byte_of() -> dict[str, int]:
    """Byte of each character of byte-level entries: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A: encodes to ids, and knows the bytes of each id."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        byte, special = _byte_of(), {t["content"] for t in model["added_tokens"]}
        entries = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max(entries.values(), default=-1) + 1)
        for token, i in entries.items():
            self.bytes[i] = token
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        merged = (x if isinstance(x, list) else x.split(" ") for x in model["model"]["merges"])
        order = [entries[bytes(byte[c] for c in left + right)] for left, right in merged]
        #: Where later merges have higher ids, ranks say all; a faster library reads those.
        self.ranks = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=entries, special_tokens={}) if order == sorted(order) else None

    def encode(self, text: str) -> list[int]:
        if self.ranks is not None:
            try:
                return self.ranks.encode_ordinary(text)
            except ValueError:  # its pattern search gives up on very long runs of white space
                pass
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """B: the same for a piece model; a piece's mark of a space is a space, ``<0xHH>`` a byte."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece) if self.library.is_byte(i) else None
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1)


class Tools:
    """Both tokenizers, and all pairs of ids that can end together.

    Two tokens that end at the same byte are a suffix one of the other, so the pairs
    are given by the vocabularies: one for each entry and each suffix of it that is an
    entry of the other, fewer than the vocabularies have bytes.
    """

    def __init__(self, names: Vocabularies):
        self.a, self.b = ByteLevel(names.a, names.pattern), Pieces(names.b)
        self.n_b = len(self.b.bytes)
        self.a_size = np.array([len(x) for x in self.a.bytes])
        self.b_size = np.array([len(x) for x in self.b.bytes])
        found: set[int] = set()
        for own, other, key in ((self.a.bytes, self.b.bytes, lambda x, y: x * self.n_b + y), (self.b.bytes, self.a.bytes, lambda x, y: y * self.n_b + x)):
            ids: dict[bytes, list[int]] = {}
            for i, token in enumerate(other):
                ids.setdefault(token, []).append(i)
            for i, token in enumerate(own):
                for at in range(len(token)):
                    found.update(key(i, j) for j in ids.get(token[at:], ()))
        #: Sorted; a pair's number is its place.
        self.pairs = np.array(sorted(found), np.int64)
        texts = [f"{i}{mark}".encode() for n, marks in ((len(self.a.bytes), ",|"), (self.n_b, ",;")) for mark in marks for i in range(n)]
        self.texts = np.array(texts, object)


@functools.lru_cache(1)
def tools(names: Vocabularies) -> Tools:
    """One a worker process, or driver."""
    return Tools(names)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of ``short``, the place of the first value of ``long`` that is no less; both ascend."""
    n, m = len(short), len(long)
    if not n or not m:
        return np.zeros(n, np.int64)
    if n <= STRIDE:
        at, low = np.empty(n, np.int64), 0
        for i, value in enumerate(short.tolist()):
            step = 1
            while low + step < m and long[low + step] < value:
                step *= 2
            low = at[i] = low + step // 2 + int(np.searchsorted(long[low + step // 2 : low + step + 1], value))
        return at
    low = np.repeat(gallop(short[::STRIDE], long), STRIDE)[:n]
    high, step = low.copy(), 1
    live = np.flatnonzero(long[np.minimum(low, m - 1)] < short)
    live = live[low[live] < m]
    while len(live):
        low[live] = high[live] + 1
        high[live] = np.minimum(high[live] + step, m)
        step *= 2
        live = live[high[live] < m]
        live = live[long[high[live]] < short[live]]
    while len(live := np.flatnonzero(low < high)):
        middle = (low[live] + high[live]) // 2
        less = long[middle] < short[live]
        low[live[less]] = middle[less] + 1
        high[live[~less]] = middle[~less]
    return low


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the values that both have; the shorter is searched in the longer."""
    if len(a) > len(b):
        return common(b, a)[::-1]
    at = gallop(a, b)
    both = np.flatnonzero((at < len(b)) & (b[np.minimum(at, max(len(b) - 1, 0))] == a)) if len(b) else np.empty(0, np.int64)
    return both, at[both]


def _tokens(own: Tools, text: str | None) -> tuple[list[int], list[int]]:
    """Ids by A and B, none where a side does not give the text's bytes back."""
    if not text:
        return [], []
    data = b" " + text.encode("utf-8", "surrogatepass")
    a, b = own.a.encode(" " + text), own.b.encode(text)
    if b"".join(map(own.a.bytes.__getitem__, a)) != data or b"".join(map(own.b.bytes.__getitem__, b)) != data:
        return [], []
    return a, b


def _aligned(own: Tools, texts: list[str | None], outputs: tuple[str, ...]) -> list[pa.Array]:
    """The columns of some texts, all of whose tokens lie one after another on one line of bytes."""
    each = [_tokens(own, text) for text in texts]
    a, b = (np.fromiter((i for ids in each for i in ids[k]), np.int64) for k in (0, 1))
    ia, ib = common(np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b]))
    a_cuts, b_cuts = np.r_[0, ia + 1], np.r_[0, ib + 1]  # ranks: a group has the tokens between two cuts
    a_ends, b_ends = (np.cumsum([0, *(len(ids[k]) for ids in each)]) for k in (0, 1))
    first = np.searchsorted(a_cuts, a_ends)  # groups before each text; a text's last byte ends a group
    made: dict[str, list] = {"n_a": np.diff(a_ends), "n_b": np.diff(b_ends), "n_groups": np.diff(first), "n_links": np.diff(first)}
    spans = list(zip(first[:-1], first[1:], strict=True))
    if "links" in outputs:
        numbers = np.searchsorted(own.pairs, a[ia] * own.n_b + b[ib]).astype("<i4")
        made["links"] = [numbers[i:j].tobytes() for i, j in spans]
    if "groups_sha256" in outputs:
        group_a = np.repeat(np.arange(len(ia)), np.diff(a_cuts))
        group_b = np.repeat(np.arange(len(ib)), np.diff(b_cuts))
        line = np.empty(len(a) + len(b), np.int64)
        n_a = len(own.a.bytes)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[ia], last_b[ib] = n_a, own.n_b
        line[np.arange(len(a)) + b_cuts[group_a]] = a + last_a
        line[np.arange(len(b)) + a_cuts[group_b + 1]] = b + last_b + 2 * n_a
        parts = own.texts[line].tolist()
        ends = (a_ends + b_ends).tolist()
        made["groups_sha256"] = [hashlib.sha256(b"".join(parts[i:j])[:-1]).hexdigest() if i < j else "" for i, j in zip(ends, ends[1:], strict=False)]
    if "a_ids" in outputs:
        made["a_ids"] = [x for x, _ in each]
    if "b_ids" in outputs:
        made["b_ids"] = [x for _, x in each]
    for name, cuts, starts in (("a_cuts", a_cuts, a_ends), ("b_cuts", b_cuts, b_ends)):
        if name in outputs:
            made[name] = [(cuts[i : j + 1] - s if i < j else cuts[:0]).tolist() for (i, j), s in zip(spans, starts, strict=False)]
    return [pa.array(made[name], OUTPUTS[name]) for name in outputs]


def _portions(texts: list[str | None]):
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > TOGETHER:
            yield texts[start:i]
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield texts[start:]


def align(docs: DataFrame, names: Vocabularies, outputs: tuple[str, ...] = ("n_a", "n_b", "a_ids", "b_ids", "a_cuts", "b_cuts")) -> DataFrame:
    """doc_id and the ``outputs`` (of ``OUTPUTS``) of every row of ``docs`` (doc_id, text), in one pass without a shuffle.

    A encodes a space and the text, B the text, to which it adds the space; strings of
    special tokens are plain text. Group g of a text has A's tokens from a_cuts[g] to
    a_cuts[g + 1] - 1 and B's likewise. ``links`` are the numbers of the pairs of ids that
    end each group, as little-endian 32-bit integers (see ``Tools.pairs``). Null and empty
    texts, and texts that a tokenizer changes, have no tokens: zeros, empty lists and an
    empty ``groups_sha256``. Equal rows give equal rows, a null id stays null, an empty
    table gives none; other columns of ``docs`` are not read. A text is held whole.
    """

    def run(batches):
        own = tools(names)
        for part in slices(batches):
            at = 0
            for texts in _portions(part.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(texts)), *_aligned(own, texts, outputs)], ["doc_id", *outputs])
                at += len(texts)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int32()): "array<int>"}
    schema = ", ".join(["doc_id long", *(f"{name} {kinds[OUTPUTS[name]]}" for name in outputs)])
    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many ``links`` of all rows have each pair number.

    Every task sums its own links first; what meets is at most one row a task and pair.
    """

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(x or b"" for x in batch.column(0).to_pylist()), "<i4"))
            if len(found) > len(total):
                total, found = found.astype(np.int64), total
            total[: len(found)] += found
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(total[pair], pa.int64())], ["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def by_counts(aligned: DataFrame, names: Vocabularies) -> DataFrame:
    """``aligned`` (with ``links``) and n_best, count_sum in place of the links.

    n_best: links whose count is the highest of all pairs with their B id; count_sum:
    the counts of the links added up. The counts go through the driver to the tasks:
    there are no more than pairs that can end together (``Tools.pairs``), however many
    documents there are.
    """
    own = tools(names)
    found = pair_counts(aligned).toPandas()
    counts = np.zeros(len(own.pairs), np.int64)
    counts[found["pair"]] = found["n"]
    highest = np.zeros(own.n_b, np.int64)
    np.maximum.at(highest, own.pairs % own.n_b, counts)
    best = counts == highest[own.pairs % own.n_b]
    sent = aligned.sparkSession.sparkContext.broadcast((counts, best))
    at = aligned.columns.index("links")
    names_ = [c for c in aligned.columns if c != "links"] + ["n_best", "count_sum"]

    def run(batches):
        counts, best = sent.value
        for batch in batches:
            links = [np.frombuffer(x or b"", "<i4") for x in batch.column(at).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            columns += [pa.array([int(best[x].sum()) for x in links], pa.int64()), pa.array([int(counts[x].sum()) for x in links], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names_)

    kinds = dict(aligned.dtypes) | {"n_best": "bigint", "count_sum": "bigint"}
    return aligned.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names_))


def digests(docs: DataFrame, names: Vocabularies) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row of ``docs`` (see ``align``).

    The alignment is kept in the shared folder, as the counts need all of it first.
    """
    kept = Scratch(docs.sparkSession).keep(align(docs, names, ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")), "aligned")
    return by_counts(kept, names)
