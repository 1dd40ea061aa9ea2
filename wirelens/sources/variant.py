"""Many VARIANTs at once, read where their bytes lie, without rebuilding what is around a value.

A place is a position in the bytes of a column; -1 stands for a missing value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

OBJECT, ARRAY = 2, 3


def names(metadata: bytes) -> list[str]:
    """Field names by id."""
    size = 1 + (metadata[0] >> 6)
    n = int.from_bytes(metadata[1:1 + size], "little")
    starts = [int.from_bytes(metadata[at:at + size], "little") for at in range(1 + size, 1 + (n + 2) * size, size)]
    base = 1 + (n + 2) * size
    return [metadata[base + a:base + b].decode() for a, b in zip(starts, starts[1:], strict=False)]


def slices(column: pa.StructArray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows, each with at most ``most`` bytes of values or a single row."""
    ends = _ends(column.field("value"))
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        yield row, stop
        row = stop


def _ends(binary: pa.Array) -> np.ndarray:
    return np.frombuffer(binary.buffers()[1], np.int32)[binary.offset:binary.offset + len(binary) + 1]


def _expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owner and the number, from 0, of each of ``counts`` things."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Fields:
    """Fields of objects that play a role, an object's in the order of their names."""

    def __init__(self, objects: int, owner: np.ndarray, role: np.ndarray, place: np.ndarray):
        self.objects, self.owner, self.role, self.place = objects, owner, role, place

    def at(self, role: int) -> np.ndarray:
        """The place of each object's first field of ``role``."""
        own = self.role & role != 0
        found = np.full(self.objects, -1)
        found[self.owner[own][::-1]] = self.place[own][::-1]  # of equal owners the last one assigned stays
        return found


class Values:
    """Rows of a VARIANT column as Arrow holds it; ``roles`` gives the roles, as bits, that a field plays by its name."""

    def __init__(self, column: pa.StructArray, roles: Callable[[str], int]):
        value, metadata = column.field("value"), column.field("metadata").dictionary_encode()
        ends = _ends(value)
        self.data = np.frombuffer(value.buffers()[2], np.uint8)[ends[0]:ends[-1]]
        self.data = np.concatenate([self.data, np.zeros(8, np.uint8)])  # numbers are read four bytes wide
        self.starts = (ends[:-1] - ends[0]).astype(np.int64)
        known = [[roles(name) for name in names(m)] for m in metadata.dictionary.to_pylist()]
        self._roles = np.array([role for some in known for role in some], np.int64)
        self._first = (np.cumsum([0, *map(len, known)])[:-1])[metadata.indices.to_numpy()]

    def kind(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.data[place] & 3, -1)

    def _number(self, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Unsigned little-endian numbers of one to four bytes."""
        out = self.data[place].astype(np.int64)
        for k in range(1, int(size.max(initial=1))):
            wide = size > k
            out[wide] |= self.data[place[wide] + k].astype(np.int64) << 8 * k
        return out

    def _counted(self, place: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many things a container holds, and the place behind that number."""
        return self._number(place + 1, np.where(large, 4, 1)), place + np.where(large, 5, 2)

    def fields(self, place: np.ndarray, row: np.ndarray) -> Fields:
        """Fields of the objects at ``place``, which belong to the rows ``row``."""
        head = self.data[place].astype(np.int64)
        n, at = self._counted(place, head & 64 != 0)
        wide, size = 1 + (head >> 2 & 3), 1 + (head >> 4 & 3)
        owner, k = _expanded(n)
        role = self._roles[self._first[row][owner] + self._number(at[owner] + k * size[owner], size[owner])]
        owner, k, role = owner[role != 0], k[role != 0], role[role != 0]
        at = at + n * size
        start = self._number(at[owner] + k * wide[owner], wide[owner])
        return Fields(len(place), owner, role, (at + (n + 1) * wide)[owner] + start)

    def items(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, number and place of repeated elements, whether rendered as a list or as a bare value."""
        head = self.data[place].astype(np.int64)
        lists = (place >= 0) & (head & 3 == ARRAY)
        n, at = self._counted(place, lists & (head & 16 != 0))
        n = np.where(lists, n, place >= 0)
        owner, k = _expanded(n)
        wide = 1 + (head >> 2 & 3)
        found, inside = place[owner], lists[owner]
        o = owner[inside]
        found[inside] = (at + (n + 1) * wide)[o] + self._number(at[o] + k[inside] * wide[o], wide[o])
        return owner, k, found

    def whole(self, place: np.ndarray, parse: Callable[[str], int | None]) -> tuple[np.ndarray, np.ndarray]:
        """Whole numbers, texts by ``parse``, and where there is one; each text that occurs is parsed once."""
        head = self.data[place].astype(np.int64)
        long = (place >= 0) & (head == 64)
        text = (place >= 0) & (head & 3 == 1) | long
        number, known = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        size = np.where(long, self._number(place + 1, np.where(long, 4, 1)), head >> 2)[text]
        start = (place + np.where(long, 5, 1))[text]
        owner, k = _expanded(size)
        texts = pa.Array.from_buffers(pa.large_utf8(), len(size), [
            None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(self.data[start[owner] + k])]).dictionary_encode()
        parsed = [parse(t) for t in texts.dictionary.to_pylist()]
        which = texts.indices.to_numpy()
        number[text] = np.array([p or 0 for p in parsed], np.int64)[which]
        known[text] = np.array([p is not None for p in parsed], bool)[which]
        for i in np.flatnonzero((place >= 0) & (head & 3 == 0) & ~long):
            if (found := self._primitive(int(place[i]))) is not None:
                number[i], known[i] = found, True
        return number, known

    def _primitive(self, at: int) -> int | None:
        """A number that is whole and has 64 bits at most."""
        kind = int(self.data[at]) >> 2
        if 3 <= kind <= 6:
            return int.from_bytes(self.data[at + 1:at + 1 + (1 << kind - 3)].tobytes(), "little", signed=True)
        if not 8 <= kind <= 10:
            return None
        scaled = int.from_bytes(self.data[at + 2:at + 2 + (4 << kind - 8)].tobytes(), "little", signed=True)
        whole, rest = divmod(scaled, 10 ** int(self.data[at + 1]))
        return whole if rest == 0 and -(1 << 63) <= whole < 1 << 63 else None
