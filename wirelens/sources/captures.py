"""Capture files to frames: discovery, framing and rejects.

Classic capture files have no sync marks. A file is cut into splits of fixed size that
are framed at the same time: each split but the first guesses where its first record
begins (a chain of plausible headers), and the guess counts only if the split before
ends there; otherwise the split is framed again from that place. So one large file
spreads over all tasks, and the records are those of a walk from header to header.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelens.session import materialise

# First four bytes -> (byte order, nanosecond fractions).
MAGICS = {
    bytes.fromhex("d4c3b2a1"): ("<", False),
    bytes.fromhex("4d3cb2a1"): ("<", True),
    bytes.fromhex("a1b2c3d4"): (">", False),
    bytes.fromhex("a1b23c4d"): (">", True),
}
FILE_HEADER, RECORD_HEADER = 24, 16
CHUNK_BYTES = 64 * 1024 * 1024
#: Headers in a row that a guess needs, and bytes in which it is looked for at a time.
CHAIN = 8
LOOK = 1 << 20
#: Longest record that a guess believes in where the file names none, and seconds around the file's first.
LONGEST, AROUND_S = 1 << 18, 10 * 366 * 86_400
SPLITS = ("path string, size long, byte_order string, nano boolean, linktype int, longest long, first_s long, no long, "
          "begin long, end long, start long, stop long, records long, error string")
CHUNKS = ("path string, byte_order string, nano boolean, linktype int, start long, stop long, "
          "first_index long, error string")
FRAMES = ("path string, index long, ts_us long, linktype int, captured_len int, orig_len int, frame binary")


def scan_captures(spark: SparkSession, root: str, pattern: str = "*.pcap") -> DataFrame:
    """(path, length) of every capture below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root).select("path", "length")
    )


def _open(path: str):
    """A seekable input on any file system pyarrow knows."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(inner)


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _spread(rows: DataFrame, length: Column, *keys: str) -> DataFrame:
    """Few short rows that stand for ``length`` bytes of work each, dealt out to tasks by number.

    By the rows' own size AQE would join them into one task.
    """
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(n, max(4 * cores, size // CHUNK_BYTES))), *keys)


def _plan(path: str, chunk_bytes: int) -> list[tuple]:
    """Splits of one file by its size, or one row with the reason it is refused."""
    def refused(reason: str) -> list[tuple]:
        return [(path, *[None] * 12, reason)]

    with _open(_uri(path)) as fh:
        size, head = fh.size(), fh.read_at(FILE_HEADER + 4, 0)
    if len(head) < FILE_HEADER:
        return refused("truncated file header")
    if head[:4] not in MAGICS:
        return refused("not a classic capture file")
    order, nano = MAGICS[head[:4]]
    longest, linktype = struct.unpack(order + "II", head[16:24])
    first = struct.unpack(order + "I", head[24:28])[0] if len(head) == FILE_HEADER + 4 else 0
    return [(path, size, order, nano, linktype, longest or LONGEST, first, no, at, min(at + chunk_bytes, size), None, None, None, None)
            for no, at in enumerate(range(FILE_HEADER, size, chunk_bytes))]


def _guess(fh, r) -> int | None:
    """Where the first record at or after ``begin`` seems to begin, if that is before ``end``."""
    header = np.dtype(r.byte_order + "u4")
    ticks = 1_000_000_000 if r.nano else 1_000_000

    def plausible(head: np.ndarray) -> np.ndarray:
        # Runs of zeros read as records of nothing, so a guess does not believe in those.
        second, tick, captured, original = (head[..., i].astype(np.int64) for i in range(4))
        return (tick < ticks) & (captured > 0) & (captured <= original) & (captured <= r.longest) & (abs(second - r.first_s) <= AROUND_S)

    for base in range(r.begin, r.end, LOOK):
        block = fh.read_at(LOOK + RECORD_HEADER - 1, base)
        n = min(len(block) - RECORD_HEADER + 1, r.end - base)
        if n <= 0:
            return None
        heads = np.lib.stride_tricks.sliding_window_view(np.frombuffer(block, np.uint8), RECORD_HEADER)[:n]
        for i in np.flatnonzero(plausible(np.ascontiguousarray(heads).view(header))):
            pos = base + int(i)
            for _ in range(CHAIN):
                if pos == r.size:
                    return base + int(i)
                head = fh.read_at(RECORD_HEADER, pos)
                if len(head) < RECORD_HEADER or not plausible(np.frombuffer(head, header)):
                    break
                pos += RECORD_HEADER + int(np.frombuffer(head, header)[2])
            else:
                return base + int(i)
    return None


def _places(body: bytes, order: str, until: int) -> tuple[list[int], int]:
    """Places of the headers in ``body`` that begin before ``until``, and where the last record ends."""
    at, pos, captured = [], 0, struct.Struct(order + "I")
    try:
        while pos < until:
            at.append(pos)
            pos += RECORD_HEADER + captured.unpack_from(body, pos + 8)[0]
    except struct.error:
        return at, -1
    return at, pos


def _framed(r, start: int | None) -> tuple:
    """(start, stop, records, error) of one split, from ``start``."""
    if start is None:
        return None, None, None, None
    if start >= r.end:
        return start, start, 0, None
    with _open(_uri(r.path)) as fh:
        body = fh.read_at(min(r.end + RECORD_HEADER, r.size) - start, start)
    at, stop = _places(body, r.byte_order, r.end - start)
    if stop < 0 or at[-1] + RECORD_HEADER > len(body):
        return start, None, None, "truncated record header"
    if start + stop > r.size:
        return start, None, None, "truncated record body"
    return start, start + stop, len(at), None


def _frame_splits(splits: DataFrame, chunk_bytes: int, known: str | None = None) -> DataFrame:
    """``splits`` framed from the column ``known``, or from a guess (the first split of a file from its begin).

    With ``known`` the walk goes on over as many splits of the file as ``ahead`` says, or up to an error.
    """
    names = [c.split()[0] for c in SPLITS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                if known is None and r.no:
                    with _open(_uri(r.path)) as fh:
                        start = _guess(fh, r)
                else:
                    start = int(getattr(r, known)) if known else int(r.begin)
                rows = []
                for _ in range(int(r.ahead) if known else 1):
                    rows.append([*r[:names.index("start")], *_framed(r, start)])
                    start = rows[-1][names.index("stop")]
                    if start is None or r.end >= r.size:
                        break
                    r = r._replace(no=r.no + 1, begin=r.end, end=min(r.end + chunk_bytes, r.size))
                yield pd.DataFrame(rows, columns=names).astype({"start": "Int64", "stop": "Int64", "records": "Int64"})

    columns = [*names, known, "ahead"] if known else names
    return _spread(splits.select(*columns), F.expr("end - begin"), "path", "no").mapInPandas(run, SPLITS)


def index_chunks(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of every file, and one row with ``error`` for each refused file.

    Splits are framed at once from guesses. While a split does not start where the one
    before it stops, it is framed again from there; a split whose start is right is
    never wrong. The walk from a file's first wrong split goes on over twice as many splits
    each round, so the number of rounds is at most the logarithm of the file's splits,
    however many guesses in a row are wrong. A file with an unfinished record is refused whole.
    """
    names = [c.split()[0] for c in SPLITS.split(", ")]

    def plans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    rows = _plan(path, chunk_bytes)
                except OSError as exc:
                    rows = [(path, *[None] * 12, f"unreadable: {exc}")]
                yield pd.DataFrame(rows, columns=names).astype({
                    "nano": "boolean", "linktype": "Int32", "error": "object",
                    **{c: "Int64" for c in ("size", "longest", "first_s", "no", "begin", "end", "start", "stop", "records")}})

    planned = materialise(files.select("path").mapInPandas(plans, SPLITS))
    refused = planned.filter(F.col("error").isNotNull())
    splits = materialise(_frame_splits(planned.filter(F.col("error").isNull()), chunk_bytes))
    along, ahead = Window.partitionBy("path").orderBy("no"), 1
    while True:
        due = F.when(F.col("no") == 0, F.col("begin")).otherwise(F.lag("stop").over(along))
        splits = splits.withColumn("due", due)
        wrong = F.col("due").isNotNull() & ~F.col("start").eqNullSafe(F.col("due"))
        since = F.col("no") - F.min("no").over(Window.partitionBy("path"))
        again = splits.filter(wrong).withColumn("since", since).filter(f"since = 0 OR since >= {ahead}")
        again = materialise(again.withColumn("ahead", F.when(F.col("since") == 0, ahead).otherwise(1)))
        if again.isEmpty():
            break
        mended = materialise(_frame_splits(again, chunk_bytes, "due"))
        splits = materialise(splits.join(mended.select("path", "no"), ["path", "no"], "left_anti").drop("due").unionByName(mended))
        ahead *= 2
    # An error counts where the walk has come to; the first one refuses the file.
    broken = splits.filter(F.col("error").isNotNull() & F.col("due").isNotNull()).groupBy("path").agg(F.min_by("error", "no").alias("error"))
    before = F.coalesce(F.sum("records").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    good = splits.join(broken, "path", "left_anti").withColumn("first_index", before).filter("records > 0")
    columns = [c.split()[0] for c in CHUNKS.split(", ")]
    bad = refused.select("path", "error").unionByName(broken)
    nothing = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CHUNKS.split(", ")[1:-1]]
    return good.select(*columns).unionByName(bad.select("path", *nothing, "error"))


def read_chunks(chunks: DataFrame, batch_rows: int = 8192) -> DataFrame:
    """Frames of the given chunks, yielded in bounded batches and cut by offsets."""
    names = [c.split()[0] for c in FRAMES.split(", ")]

    def run(batches):
        for batch in batches:
            for c in batch.to_pylist():
                with _open(_uri(c["path"])) as fh:
                    body = fh.read_at(c["stop"] - c["start"], c["start"])
                at, _ = _places(body, c["byte_order"], len(body))
                raw = np.frombuffer(body, np.uint8)
                for i in range(0, len(at), batch_rows):
                    place = np.array(at[i : i + batch_rows], np.int64)
                    end = at[i + batch_rows] if i + batch_rows < len(at) else len(body)
                    heads = raw[place[:, None] + np.arange(RECORD_HEADER)].view(c["byte_order"] + "u4").astype(np.int64)
                    second, tick, captured, original = heads.T
                    keep = np.ones(end - place[0], bool)  # all but the headers is frames, one after another
                    keep[(place - place[0])[:, None] + np.arange(RECORD_HEADER)] = False
                    offsets = np.r_[0, np.cumsum(captured)].astype(np.int32)
                    frames = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(raw[place[0] : end][keep].tobytes())])
                    n = len(place)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c["path"]] * n), pa.array(c["first_index"] + i + np.arange(n)),
                         pa.array(second * 1_000_000 + (tick // 1000 if c["nano"] else tick)), pa.array(np.full(n, c["linktype"], np.int32)),
                         pa.array(captured.astype(np.int32)), pa.array(original.astype(np.int32)), frames], names)

    # One chunk per row: spread them so that a large file uses many tasks.
    spread = _spread(chunks.filter(F.col("error").isNull()).drop("error"), F.expr("stop - start"), "path", "start")
    return spread.mapInArrow(run, FRAMES)


def capture_name(path: Column) -> Column:
    """Capture id from a path: the file's stem, or its folder for ``capture.pcap``."""
    stem = F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.when(stem == "capture", folder).otherwise(stem)


def read_frames(spark: SparkSession, root: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(frames, rejects) of all captures below ``root``.

    The chunk list is a few dozen bytes per 64 MB of capture. It is written to
    the checkpoint folder so that the framing is not repeated for the two results.
    """
    chunks = materialise(index_chunks(scan_captures(spark, root).repartition("path"), chunk_bytes))
    frames = read_chunks(chunks).withColumn("capture_id", capture_name(F.col("path"))).drop("path")
    rejects = chunks.filter(F.col("error").isNotNull()).select("path", F.col("error").alias("reason"))
    return frames, rejects


def digest_files(files: DataFrame, block: int = 8 << 20) -> DataFrame:
    """path, sha256, size_bytes, magic of the files at ``path``, of any size: each is read block by block in a task."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                digest, size, magic = hashlib.sha256(), 0, b""
                with _open(_uri(path)) as fh:
                    while data := fh.read(block):
                        magic = magic or data[:4]
                        digest.update(data)
                        size += len(data)
                columns = [[path], [digest.hexdigest()], [size], [magic.hex()]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["path", "sha256", "size_bytes", "magic"])

    length = F.col("length") if "length" in files.columns else F.lit(0)
    return _spread(files, length, "path").select("path").mapInArrow(run, "path string, sha256 string, size_bytes long, magic string")
