"""Streaming operators run over the event table as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wirelens.catalog.registry import query
from wirelens.catalog.traffic import rounded
from wirelens.plans import adapters
from wirelens.session import checkpoint_ready
from wirelens.streaming import live


def packet_stream(spark, sf):
    schema = adapters.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return adapters.packets_of(events)


def fresh_folder(spark) -> str:
    """A new folder next to the checkpoints, on storage all executors share."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def collected(spark, stream):
    folder = fresh_folder(spark)
    live.run_available(stream, folder)
    return spark.read.parquet(f"{folder}/rows")


# Rows of one file form one batch; windows that end after the watermark stay open.
@query("stream_windows", "T1", views="packets", sql="""
WITH w AS (SELECT (max(ts_us) // 1000 * 1000) - 10000000 AS mark FROM packets WHERE proto = 'esp'),
x AS (SELECT capture_id, least(src, dst) AS lo, greatest(src, dst) AS hi, src = least(src, dst) AS up, esp_len AS len,
             unnest([ts_us // 5000000 * 5000000, ts_us // 5000000 * 5000000 - 5000000]) AS start_us FROM packets WHERE proto = 'esp')
SELECT capture_id, lo, hi, start_us, count(*) AS packet_count, CAST(sum(len) AS BIGINT) AS byte_count, min(len) AS esp_len_min, max(len) AS esp_len_max,
       round(avg(len), 6) AS esp_len_mean, round(coalesce(stddev_samp(len), 0), 6) AS esp_len_std, count(*) FILTER (up) AS up_packets,
       count(*) FILTER (NOT up) AS down_packets, CAST(coalesce(sum(len) FILTER (up), 0) AS BIGINT) AS up_bytes,
       CAST(coalesce(sum(len) FILTER (NOT up), 0) AS BIGINT) AS down_bytes, """ + ", ".join(
    f"count(*) FILTER (len % 16 = {r}) AS mod16_{r}" for r in range(16)) + """
FROM x WHERE start_us + 10000000 <= (SELECT mark FROM w) GROUP BY capture_id, lo, hi, start_us""")
def stream_windows(spark, sf):
    return rounded(collected(spark, live.stream_windows(packet_stream(spark, sf))))


@query("stream_sequence", "T2", views="packets", sql="""
WITH s AS (SELECT *, (idx - CASE WHEN idx % 97 = 0 THEN 2 ELSE 0 END) // 7 AS n FROM packets WHERE proto = 'esp'),
o AS (SELECT *, lag(n) OVER (PARTITION BY capture_id, src, dst, spi, n // 65536 ORDER BY ts_us, idx) AS p FROM s),
t AS (SELECT capture_id, src, dst, spi, count(*) AS packets, count(*) - count(DISTINCT n) AS duplicates, count(*) FILTER (n < p) AS out_of_order,
             min(n) AS first_seq, max(n) AS last_seq FROM o GROUP BY ALL)
SELECT *, last_seq - first_seq + 1 - (packets - duplicates) AS missing,
       round((last_seq - first_seq + 1 - (packets - duplicates)) / (last_seq - first_seq + 1), 6) AS gap_ratio FROM t""")
def stream_sequence(spark, sf):
    p = packet_stream(spark, sf).withColumn(
        "seq", F.expr("CASE WHEN spi IS NOT NULL THEN (index - CASE WHEN index % 97 = 0 THEN 2 ELSE 0 END) div 7 END"))
    return live.sequence_totals(collected(spark, live.stream_sequence(p)))


@query("stream_rekey", "T3", views="spi_series", sql="""
SELECT capture_id, src, dst, spi, start_ts_us AS start_us, coalesce(gap_s, -1) AS gap_s FROM spi_series""")
def stream_rekey(spark, sf):
    return live.rekey_gaps(collected(spark, live.stream_starts(packet_stream(spark, sf))))
