"""Sliding windows anchored at each pair's first packet, and span merging."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.operators import ordered

WINDOW_US = 10_000_000
STRIDE_US = 5_000_000
MIN_PACKETS = 20
WINDOW_KEYS = ["capture_id", "pair_id", "k"]
#: A pane is a stretch of time that lies in the same windows.
PANE_KEYS = ["capture_id", "pair_id", "pane"]


def pane_us(window_us: int = WINDOW_US, stride_us: int = STRIDE_US) -> int:
    return math.gcd(window_us, stride_us)


def in_windows(rows: DataFrame, window_us: int = WINDOW_US, stride_us: int = STRIDE_US) -> DataFrame:
    """``rows`` (pane) once for every window ``k`` that holds the pane."""
    size = pane_us(window_us, stride_us)
    step, width = stride_us // size, window_us // size
    spans = rows.withColumns({"_from": F.expr(f"greatest(0L, (pane - {width} + {step}) div {step})"), "_to": F.expr(f"pane div {step}")})
    return spans.filter("_from <= _to").withColumn("k", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")


def assign_windows(tagged: DataFrame, window_us: int = WINDOW_US,
                   stride_us: int = STRIDE_US) -> DataFrame:
    """One row per (packet, window it lies in); window k is ``[first+k*stride, +window)``.

    A range join by arithmetic: only the columns the sequences need are carried
    through the explode, which at the default sizes doubles the rows.
    """
    rel = "(ts_us - first_us)"
    lo = f"if({rel} >= {window_us}, ({rel} - {window_us}) div {stride_us} + 1, 0)"
    hi = f"{rel} div {stride_us}"
    return tagged.select(
        "capture_id", "pair_id", "paired", "first_us",
        F.explode(F.expr(f"sequence({lo}, {hi})")).alias("k"),
        "ts_us", "index", F.coalesce("esp_payload_len", F.lit(0)).alias("length"), "up",
    ).withColumn("start_us", F.col("first_us") + F.col("k") * stride_us)


def window_counts(tagged: DataFrame, window_us: int = WINDOW_US, stride_us: int = STRIDE_US) -> DataFrame:
    """Packets per window, summed from panes; windows without a forward packet are dropped."""
    size = pane_us(window_us, stride_us)
    counts = tagged.groupBy("capture_id", "pair_id", "first_us", F.expr(f"(ts_us - first_us) div {size}").alias("pane")).agg(
        F.count(F.lit(1)).alias("packets"), F.count_if("up").alias("up_packets"))
    found = in_windows(counts, window_us, stride_us).groupBy(*WINDOW_KEYS).agg(
        (F.min("first_us") + F.col("k") * stride_us).alias("start_us"), F.sum("packets").alias("packets"), F.sum("up_packets").alias("up_packets"))
    return found.filter(F.col("up_packets") > 0).withColumn("end_us", F.col("start_us") + window_us)


def scorable(windows: DataFrame, min_packets: int = MIN_PACKETS) -> DataFrame:
    """Windows with enough packets to score."""
    return windows.filter(F.col("packets") >= min_packets)


def gap_summary(tagged: DataFrame, window_us: int = WINDOW_US, stride_us: int = STRIDE_US) -> DataFrame:
    """gaps, total_us and longest_us between the packets of each window.

    Gaps are taken inside panes; a window adds those between its panes.
    """
    keys = PANE_KEYS
    size = pane_us(window_us, stride_us)
    rows = tagged.select("capture_id", "pair_id", F.expr(f"(ts_us - first_us) div {size}").alias("pane"), "ts_us", "index")
    gap = F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy(*keys).orderBy("ts_us", "index"))
    states = rows.withColumn("_gap", gap).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last"), F.max("_gap").alias("longest"))
    rows = in_windows(states, window_us, stride_us)
    between = F.col("first") - F.lag("last").over(Window.partitionBy(*WINDOW_KEYS).orderBy("pane"))
    return rows.withColumn("between", between).groupBy(*WINDOW_KEYS).agg(
        (F.sum("n") - 1).alias("gaps"), (F.max("last") - F.min("first")).alias("total_us"),
        F.coalesce(F.greatest(F.max("longest"), F.max("between")), F.lit(0)).alias("longest_us"))


def pane_heads(tagged: DataFrame, n: int = 128, window_us: int = WINDOW_US, stride_us: int = STRIDE_US) -> DataFrame:
    """The first ``n`` packets of each pane: all that the first ``n`` of any window can need."""
    rows = tagged.withColumn("_pane", F.expr(f"(ts_us - first_us) div {pane_us(window_us, stride_us)}"))
    order = Window.partitionBy("capture_id", "pair_id", "_pane").orderBy("ts_us", "index")
    return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn", "_pane")


def sequence_vector(windowed: DataFrame, n: int = 128) -> DataFrame:
    """First ``n`` signed sizes of each window, zero padded.

    The ranking filter is applied on the map side as well, so at most ``n`` rows
    per window and map task reach the shuffle.
    """
    order = Window.partitionBy(*WINDOW_KEYS).orderBy("ts_us", "index")
    head = windowed.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n)
    signed = F.col("length") * F.when(F.col("up"), F.lit(1.0)).otherwise(F.lit(-1.0))
    seq = head.groupBy(*WINDOW_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("_rn", signed.alias("v")))).alias("s")
    )
    values = F.col("s.v")
    return seq.select(
        *WINDOW_KEYS,
        F.concat(values, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(values))).alias("seq"),
    )


def merge_spans(predictions: DataFrame, keys: Sequence[str] = ("capture_id", "pair_id"),
                bucket_us: int = 600_000_000) -> DataFrame:
    """Join consecutive windows of one label that touch or overlap.

    Input: keys, start_us, end_us, label, probability, top_features. A span keeps
    its first window's attributions and its weakest probability.
    """
    keys = list(keys)
    order = ["start_us", "end_us"]
    bucket = F.expr(f"start_us div {bucket_us}")
    rows = ordered.lagged(predictions, keys, order, bucket, ["label", "end_us"])
    starts = (
        F.col("prev_label").isNull() | (F.col("label") != F.col("prev_label"))
        | (F.col("prev_end_us") < F.col("start_us"))
    )
    rows = ordered.running_sum(
        rows.withColumn("_new", F.when(starts, 1).otherwise(0)), keys, order, bucket, F.col("_new"), "span_no",
    )
    return rows.groupBy(*keys, "span_no").agg(
        F.min_by("label", F.struct(*order)).alias("label"),
        F.min("probability").alias("probability"),
        F.min("start_us").alias("window_start_us"),
        F.max_by("end_us", F.struct(*order)).alias("window_end_us"),
        F.count(F.lit(1)).alias("windows"),
        F.min_by("top_features", F.struct(*order)).alias("top_features"),
    )
