"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm.common import Scratch


def _before(column: str, window) -> F.Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def shards(docs: DataFrame, count: int = 8, runs: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text).

    Rows lie in order of doc_id (null first; equal ids by checksum and size). A row goes
    to the shard in whose equal share of all bytes its middle falls, so shards are
    contiguous and miss their share by one document's half at each end at most. A slot is the
    place within the shard. Texts stay where they are read: only ids, sizes and checksums
    move, in ``runs`` sorted runs, of which only totals meet. A null text has size 1.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    runs = runs or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    # Rows alike in all three are interchangeable, but their number may be large: a serial splits them.
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("_serial"))
    rows = scratch.keep(rows, "sizes")
    order = [F.asc_nulls_first("doc_id"), F.asc("text_crc32"), F.asc("size"), F.asc("_serial")]
    rows = scratch.keep(rows.repartitionByRange(runs, *order).withColumn("_run", F.spark_partition_id()), "runs")
    scratch.drop("sizes")
    totals = rows.groupBy("_run").agg(F.sum("size").alias("bytes"), F.count("size").alias("rows"))
    # One row a run: the only place where all meet.
    w = Window.orderBy("_run")
    totals = totals.select("_run", _before("bytes", w).alias("bytes_before"), _before("rows", w).alias("rows_before"),
                           F.sum("bytes").over(Window.partitionBy()).alias("bytes_all"))
    w = Window.partitionBy("_run").orderBy(*order)
    rows = rows.withColumn("_start", _before("size", w)).withColumn("_place", F.row_number().over(w) - 1).join(totals, "_run")
    shard = F.expr(f"least({count - 1}, ((2 * (bytes_before + _start) + size) * {count}) div (2 * bytes_all))").cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("_place")).alias("_row"))
    rows = scratch.keep(rows, "placed")
    scratch.drop("runs")
    first = rows.groupBy("shard").agg(F.min("_row").alias("_first"))
    return rows.join(F.broadcast(first), "shard").select(  # ``count`` rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
