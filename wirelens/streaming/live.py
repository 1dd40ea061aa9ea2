"""Structured Streaming forms of the window, sequence and rekey operators.

Windows here are aligned to the epoch, not to each pair's first packet, and
hold only features that merge; ordered features need the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wirelens.operators import flows

ENDS = ["capture_id", "src", "dst"]
SEQ_SPAN = 65_536


def with_event_time(packets: DataFrame, delay: str = "10 seconds") -> DataFrame:
    return packets.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)


def stream_windows(packets: DataFrame, window: str = "10 seconds", stride: str = "5 seconds",
                   delay: str = "10 seconds") -> DataFrame:
    """Mergeable features per endpoint pair and sliding window; ``up`` runs from the lower address."""
    up = F.col("src") == F.col("lo")
    size = F.coalesce("esp_payload_len", F.lit(0))
    rows = (
        with_event_time(packets.filter(F.col("proto").isin("esp", "ah") & F.col("spi").isNotNull()), delay)
        .withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    )
    return rows.groupBy("capture_id", "lo", "hi", F.window("event_time", window, stride)).agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum(size).alias("byte_count"),
        F.min(size).alias("esp_len_min"), F.max(size).alias("esp_len_max"),
        F.avg(size).alias("esp_len_mean"), F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("esp_len_std"),
        F.count_if(up).alias("up_packets"), F.count_if(~up).alias("down_packets"),
        F.coalesce(F.sum(F.when(up, size)), F.lit(0)).alias("up_bytes"),
        F.coalesce(F.sum(F.when(~up, size)), F.lit(0)).alias("down_bytes"),
        *[F.count_if(size % 16 == r).alias(f"mod16_{r}") for r in range(16)],
    ).select(
        "capture_id", "lo", "hi", F.unix_micros("window.start").alias("start_us"), "packet_count", "byte_count",
        "esp_len_min", "esp_len_max", "esp_len_mean", "esp_len_std", "up_packets", "down_packets", "up_bytes",
        "down_bytes", *[f"mod16_{r}" for r in range(16)],
    )


SEQUENCE_OUT = ("capture_id long, src string, dst string, spi long, span long, packets long, duplicates long, "
                "out_of_order long, first_seq long, last_seq long")
SEQUENCE_STATE = "seen binary, previous long"


def stream_sequence(packets: DataFrame, delay: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """What each micro-batch adds to every (SPI, span of 65,536 sequence numbers).

    Equal numbers fall into one span, so duplicates are found exactly while the
    state of a span is one 8 KB bitmap, and a busy SPI is spread over its spans.
    Rows are increments: ``sequence_totals`` sums them, so nothing is lost when a span's
    state goes after ``idle_ms`` of event time without packets; only repeats of
    numbers from before that pause then count as new. Reordering is judged inside a span.
    """
    keys = ["capture_id", "src", "dst", "spi", "span"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, previous = state.get if state.exists else (bytes(SEQ_SPAN // 8), None)
        rows = pd.concat(list(batches)).sort_values(["ts_us", "index"])
        seq = rows["seq"].to_numpy(np.int64)
        flags = np.unpackbits(np.frombuffer(seen, np.uint8))
        fresh = np.unique(seq - key[4] * SEQ_SPAN)
        new = int((flags[fresh] == 0).sum())
        flags[fresh] = 1
        late = int((seq[1:] < seq[:-1]).sum()) + int(previous is not None and seq[0] < previous)
        state.update((np.packbits(flags).tobytes(), int(seq[-1])))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + idle_ms)
        yield pd.DataFrame([(*key, len(seq), len(seq) - new, late, int(seq.min()), int(seq.max()))],
                           columns=[c.split()[0] for c in SEQUENCE_OUT.split(", ")])

    rows = with_event_time(packets.filter("spi is not null and seq is not null"), delay).withColumn(
        "span", F.expr(f"seq div {SEQ_SPAN}"))
    return rows.select(*keys, "seq", "ts_us", "index", "event_time").groupBy(*keys).applyInPandasWithState(
        step, SEQUENCE_OUT, SEQUENCE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sequence_totals(increments: DataFrame) -> DataFrame:
    """One row per SPI from the rows of ``stream_sequence``: counts, missing numbers and their share."""
    sums = increments.groupBy(*ENDS, "spi").agg(
        F.sum("packets").alias("packets"), F.sum("duplicates").alias("duplicates"), F.sum("out_of_order").alias("out_of_order"),
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))
    width = F.col("last_seq") - F.col("first_seq") + 1
    missing = F.greatest(F.lit(0), width - (F.col("packets") - F.col("duplicates")))
    return sums.withColumn("missing", missing.cast("bigint")).withColumn("gap_ratio", F.round(F.col("missing") / width, 6))


START_OUT = "capture_id long, src string, dst string, spi long, start_ts_us long, first_index long"


def stream_starts(packets: DataFrame, delay: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """The first packet of every SPI, once for as long as the SPI lives.

    State is one number per (direction, SPI), so busy directions spread over their
    SPIs. It goes after ``idle_ms`` of event time without packets; a later packet then
    starts the SPI anew. Packets below the watermark are dropped and counted in the
    query's progress.
    """
    keys = [*ENDS, "spi"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = [b.sort_values(["ts_us", "index"]).iloc[0] for b in batches if len(b)]
        known = state.exists
        state.update((1,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + idle_ms)
        if not known and rows:
            first = min((int(r["ts_us"]), int(r["index"])) for r in rows)
            yield pd.DataFrame([(*key, *first)], columns=[c.split()[0] for c in START_OUT.split(", ")])

    rows = with_event_time(packets.filter("spi is not null"), delay).select(*keys, "ts_us", "index", "event_time")
    return rows.groupBy(*keys).applyInPandasWithState(step, START_OUT, "known int", "append", GroupStateTimeout.EventTimeTimeout)


def rekey_gaps(starts: DataFrame) -> DataFrame:
    """Gap to the previous SPI of the direction for every row of ``stream_starts``; -1 for the first."""
    return flows.spi_series(starts).select(*ENDS, "spi", F.col("start_ts_us").alias("start_us"), F.coalesce("gap_s", F.lit(-1)).alias("gap_s"))


def run_available(stream: DataFrame, folder: str) -> None:
    """Process what is there and stop; results and progress go below ``folder``."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    query = writer.outputMode("append").format("parquet").option("path", f"{folder}/rows").start()
    query.awaitTermination()
