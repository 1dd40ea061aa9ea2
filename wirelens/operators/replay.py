"""Sequence-number health and rekey intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.functions import attrs
from wirelens.operators import ordered
from wirelens.session import materialise

GAP_TOLERANCE = 0.02
CONFIDENCE = 0.95
MIN_SEQUENCED = 20
FLOW = ["capture_id", "pair_id", "src", "dst", "spi"]


def sequence_stats(tagged: DataFrame, bucket_rows: int = 1_000_000) -> DataFrame:
    """Duplicates, reordering and gaps of each directed flow, in capture order.

    Packets are scanned and shuffled once, by flow and bucket of indexes, so a flow of
    any size is spread. What is kept of a bucket merges: its numbers as bitmaps of 32,768,
    its first and last number, and how often a number fell. Falls between buckets are
    those from a last to the next first number.
    """
    part = [*FLOW, "bucket"]
    rows = tagged.filter(F.col("seq").isNotNull()).select(*FLOW, "index", "seq", F.expr(f"index div {bucket_rows}").alias("bucket"))
    rows = rows.withColumn("_prev", F.lag("seq").over(Window.partitionBy(*part).orderBy("index")))
    # Bitmap positions start at one, sequence numbers at zero.
    one = (F.col("seq") + 1).cast("bigint")
    place = F.struct("index", "seq")
    states = materialise(rows.groupBy(*part, F.bitmap_bucket_number(one).alias("span")).agg(
        F.count(F.lit(1)).alias("c"), F.min("seq").alias("lo"), F.max("seq").alias("hi"),
        F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"), F.count_if(F.col("seq") < F.col("_prev")).alias("falls"),
        F.min(place).alias("first"), F.max(place).alias("last")))
    spans = states.groupBy(*FLOW, "span").agg(
        F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("d"))
    counts = spans.groupBy(*FLOW).agg(
        F.sum("c").alias("packets"), F.sum(F.col("c") - F.col("d")).alias("duplicates"),
        F.sum("d").alias("distinct_seqs"), F.min("lo").alias("first_seq"), F.max("hi").alias("last_seq"),
    )
    buckets = states.groupBy(*part).agg(F.sum("falls").alias("falls"), F.min("first").alias("first"), F.max("last").alias("last"))
    before = F.lag("last").over(Window.partitionBy(*FLOW).orderBy("bucket"))  # a row a bucket
    late = buckets.withColumn("_before", before).groupBy(*FLOW).agg(
        (F.sum("falls") + F.count_if(F.col("first.seq") < F.col("_before.seq"))).alias("out_of_order"))
    span = F.col("last_seq") - F.col("first_seq") + 1
    return (
        counts.join(late, FLOW)
        .withColumn("missing", F.greatest(F.lit(0), span - F.col("distinct_seqs")))
        .withColumn("gap_ratio", F.col("missing") / F.greatest(F.lit(1), span))
        .drop("distinct_seqs")
    )


def sequence_health(stats: DataFrame, tolerance: float = GAP_TOLERANCE,
                    min_packets: int = MIN_SEQUENCED) -> DataFrame:
    """``replay_sane`` per pair: both directions without duplicates or wide gaps."""
    pair = stats.groupBy("capture_id", "pair_id").agg(
        F.sum("packets").alias("packets"), F.sum("duplicates").alias("duplicates"),
        F.sum("out_of_order").alias("out_of_order"), F.sum("missing").alias("missing"),
        F.max("gap_ratio").alias("gap_ratio"),
    )
    sane = (F.col("duplicates") == 0) & (F.col("gap_ratio") <= tolerance)
    proof = attrs.evidence("esp_sequence_analysis", measured={
        **{c: F.col(c) for c in ("packets", "duplicates", "out_of_order", "missing")},
        "gap_ratio": F.round("gap_ratio", 4),
    })
    note = F.when(sane, "sequence numbers rise without duplicates").otherwise(
        F.format_string("%d duplicate and %d missing sequence numbers", "duplicates", "missing"))
    return pair.withColumn("replay_sane", F.when(
        F.col("packets") < min_packets,
        attrs.unavailable("too few sequenced packets to judge", "boolean"),
    ).otherwise(attrs.inferred(sane, "boolean", CONFIDENCE, proof, note)))


def rekey_interval(series: DataFrame) -> DataFrame:
    """Upper median of the gaps between successive SPIs of one direction.

    Gaps are whole seconds, so the median is read off a value histogram.
    """
    keys = ["capture_id", "src", "dst"]
    hist = series.filter(F.col("gap_s").isNotNull()).groupBy(*keys, "gap_s").agg(
        F.count(F.lit(1)).alias("c"))
    cum = ordered.running_sum(hist, keys, ["gap_s"], F.expr("gap_s div 86400"), F.col("c"), "cum")
    totals = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("spi_count"), F.count("gap_s").alias("gaps"))
    rank = F.floor(F.col("gaps") / 2) + 1
    found = cum.join(totals, keys).filter((F.col("cum") >= rank) & (F.col("cum") - F.col("c") < rank))
    out = totals.join(found.select(*keys, F.col("gap_s").alias("median_s")), keys, "left")
    proof = attrs.evidence("spi_rotation_timing", measured={
        "spi_count": F.col("spi_count"), "median_interval_s": F.col("median_s")})
    note = F.format_string("%d rotations observed; the median interval is reported", "gaps")
    return out.withColumn("observed_rekey_s", F.when(
        F.col("spi_count") < 2,
        attrs.unavailable("one SPI only: no rekey inside this capture", "int"),
    ).otherwise(attrs.inferred(F.col("median_s"), "int", CONFIDENCE, proof, note)))
