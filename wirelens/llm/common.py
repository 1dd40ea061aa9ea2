"""Input tables, tables kept in the shared folder, and passes over texts in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.session import checkpoint_ready

#: Rows whose texts are Python objects at the same time.
SLICE = 256
#: Entries of a per-task memory of words; it starts anew when full, which only costs time.
MEMORY = 150_000

_LEFT: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Parquet tables in the folder of ``spark.checkpoint.dir``, each written once.

    A kept table cuts the lineage: a lost executor costs the tasks it ran, not the
    chain before. ``drop`` removes tables that no returned frame reads; ``release``
    removes the rest when the results have been written.
    """

    def __init__(self, spark: SparkSession):
        checkpoint_ready(spark)
        self.spark, self.root, self.paths = spark, spark.sparkContext.getCheckpointDir(), {}

    def path(self, name: str) -> str:
        where = f"{self.root}/{name}-{uuid.uuid4().hex}"
        self.paths.setdefault(name, []).append(where)
        _LEFT.append(where)
        return where

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            for where in self.paths.pop(name, []):
                _delete(self.spark, where)
                _LEFT.remove(where)


def release(spark: SparkSession) -> None:
    """Remove every table that operators of this package still keep."""
    while _LEFT:
        _delete(spark, _LEFT.pop())


class WordIds(dict):
    """64-bit hashes of words given as bytes, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with Arrow batches of at most a thousand rows unless the session names a number.

    Texts are long: Spark's ten thousand rows would be held several times over in each task.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, "1000")
    return docs


#: How to empty what a worker process remembers between tasks, by the operator that does.
FORGET: dict[str, Callable[[], None]] = {}


def slices(batches: Iterator[pa.RecordBatch], keep: str = "") -> Iterator[pa.RecordBatch]:
    """Slices of ``SLICE`` rows. A process that did other work before empties its memories, but for those of ``keep``."""
    for name, forget in FORGET.items():
        if name != keep:
            forget()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def filtered(docs: DataFrame, text: str, keep: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows of ``docs`` whose texts pass, all columns unchanged.

    ``keep`` runs once a task and returns the test of a list of texts.
    """
    at = docs.columns.index(text)

    def run(batches):
        test = keep()
        for part in slices(batches):
            yield part.filter(pa.array(test(part.column(at).to_pylist()), pa.bool_()))

    return in_small_batches(docs).mapInArrow(run, docs.schema)


def remainder(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def bounded(df: DataFrame, rows: int, key: str) -> DataFrame:
    """About ``rows`` rows of ``df``, chosen by a hash of ``key``; all of them if there are fewer."""
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * rows / n))


#: Size of a membership filter: 8 MB, whatever the number of ids.
FILTER_BITS = 1 << 26


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``df`` is called so in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(docs: DataFrame, text: str = "text") -> list[F.Column]:
    """What tells rows of ``docs`` apart that repeat a doc_id: the id and a hash of the text."""
    return [docs["doc_id"].cast("long"), F.xxhash64(docs[text])]


def _keys(docs: DataFrame, key: str | list[F.Column]) -> list[F.Column]:
    return [docs[key].cast("long")] if isinstance(key, str) else key


def maybe_among(docs: DataFrame, key: str | list[F.Column], ids: DataFrame, flag: str = "_maybe") -> DataFrame:
    """``docs`` with ``flag``: false only where ``key`` is surely no row of ``ids``.

    ``key`` is a column or columns of numbers as ``ids`` has them, in order. The ids become
    hashed bitmaps of a fixed total size, which are broadcast; wide rows stay where they
    are. With very many ids the filter lets more rows pass, none less.
    """
    spot, bucket, byte, marks = fresh(docs, "_spot", "_bucket", "_byte", "_marks")
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS)) + 1
    found = ids.select(place([F.col(c).cast("long") for c in ids.columns]).alias(spot)).groupBy(F.bitmap_bucket_number(spot).alias(bucket)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias(marks))
    rows = docs.withColumn(spot, place(_keys(docs, key)))
    rows = rows.withColumn(bucket, F.bitmap_bucket_number(spot)).join(F.broadcast(found), bucket, "left")
    value = F.expr(f"substring({marks}, cast(bitmap_bit_position({spot}) div 8 as int) + 1, 1)")
    rows = rows.withColumn(byte, F.conv(F.hex(value), 16, 10).cast("int"))
    bit = F.expr(f"shiftright({byte}, cast(bitmap_bit_position({spot}) % 8 as int)) & 1")
    return rows.select(*[rows[f"`{c}`"] for c in docs.columns], F.coalesce(bit == 1, F.lit(False)).alias(flag))


def without(docs: DataFrame, key: str | list[F.Column], gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``key`` (see ``maybe_among``) is a row of ``gone``; rows with a null in the key stay.

    Only rows that pass the membership filter are shuffled for the exact comparison.
    All columns stay as they are, whatever their names; repeated rows go or stay together.
    """
    columns, names = docs.columns, [f"key{i}" for i in range(len(_keys(docs, key)))]
    flag, *names = fresh(docs, "_maybe", *names)
    wide = docs.withColumns(dict(zip(names, _keys(docs, key), strict=True)))
    flagged = maybe_among(wide, [F.col(n) for n in names], gone, flag)
    sure = flagged.filter(~F.col(flag)).select(*[f"`{c}`" for c in columns])
    rest = flagged.filter(flag)
    gone = gone.toDF(*[f"{n}_gone" for n in names]).distinct()
    same = [rest[n] == gone[f"{n}_gone"].cast("long") for n in names]
    return sure.unionByName(rest.join(gone, same, "left_anti").select(*[f"`{c}`" for c in columns]))
