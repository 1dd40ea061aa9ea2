"""Capture quality, admission and caveats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ESP_PACKETS = 200
MIN_DISTINCT_LENGTHS = 8


def messages(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, in order."""
    slots = [F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs]
    return F.filter(F.array(*slots), lambda m: m.isNotNull())


def capture_quality(packets: DataFrame, captures: DataFrame | None = None,
                    min_esp: int = MIN_ESP_PACKETS,
                    min_distinct: int = MIN_DISTINCT_LENGTHS) -> DataFrame:
    """Counts, truncation, key-exchange presence and sieve fitness per capture.

    Two aggregations: per (capture, flow, length) first, which the map side
    reduces to the distinct lengths, then per capture. Captures without a packet
    are reported with zeros when ``captures`` lists them.
    """
    esp = F.col("proto") == "esp"
    # A captures row per (flow, length) keeps one busy capture spread out.
    fine = packets.groupBy(
        "capture_id",
        F.when(esp, F.col("esp_payload_len")).alias("length"),
        F.when(F.col("proto").isin("esp"), F.struct("src", "dst", "spi")).alias("flow"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts_us").alias("lo"),
        F.max("ts_us").alias("hi"),
        F.max(F.col("captured_len") < F.col("orig_len")).alias("cut"),
        F.max(F.col("proto").isin("isakmp", "isakmp_natt")).alias("ike"),
        F.max(F.coalesce(F.col("ike_message_id") == 0, F.lit(False))).alias("init"),
    )
    mid = fine.groupBy("capture_id", "length").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max("cut").alias("cut"), F.max("ike").alias("ike"), F.max("init").alias("init"),
    )
    sas = (
        fine.filter(F.col("flow.spi").isNotNull()).groupBy("capture_id", "flow").agg(F.lit(1).alias("x"))
        .groupBy("capture_id").agg(F.count(F.lit(1)).alias("esp_sa_count"))
    )
    q = mid.groupBy("capture_id").agg(
        F.sum("n").alias("packet_count"),
        ((F.max("hi") - F.min("lo")) / 1e6).alias("duration_s"),
        F.max("cut").alias("truncated"),
        F.max("ike").alias("has_ike"),
        F.max("init").alias("init"),
        F.sum(F.when(F.col("length").isNotNull(), F.col("n")).otherwise(0)).alias("esp_packets"),
        F.count("length").alias("distinct_lengths"),
    ).join(sas, "capture_id", "left")
    if captures is not None:
        q = captures.select("capture_id").join(q, "capture_id", "left")

    def no(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    q = q.select(
        "capture_id", zero("packet_count").alias("packet_count"),
        F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"),
        no("truncated").alias("truncated"), no("has_ike").alias("has_ike"),
        (no("has_ike") & no("init")).alias("ike_complete"),
        zero("esp_sa_count").alias("esp_sa_count"),
        zero("esp_packets").alias("esp_packets"), zero("distinct_lengths").alias("distinct_lengths"),
    )
    fit = (
        ~F.col("truncated") & (F.col("esp_packets") >= min_esp)
        & (F.col("distinct_lengths") >= min_distinct)
    )
    warn = messages(
        (F.col("truncated"), "capture is truncated: some packets were cut short by the snaplen"),
        (F.col("has_ike") & ~F.col("ike_complete"),
         "key exchange is present but its first exchange was not captured"),
        (~fit & ~F.col("truncated") & (F.col("esp_packets") > 0),
         F.format_string("too few distinct ESP lengths for the suite sieve: %d packets and %d lengths",
                         "esp_packets", "distinct_lengths")),
    )
    return q.withColumn("sufficient_for_lattice", fit).withColumn("warnings", warn)


def quality_caveats(quality: DataFrame) -> DataFrame:
    """Reader-facing caveats per capture, in report order."""
    texts = messages(
        (F.col("truncated"), "truncated: packet geometry could not be analysed"),
        (~F.col("has_ike"), "no key exchange captured: settings estimated where possible"),
        (F.col("has_ike") & ~F.col("ike_complete"), "key exchange joined mid-stream"),
        (~F.col("sufficient_for_lattice") & (F.col("esp_sa_count") > 0),
         "too few distinct packet sizes to identify the cipher family"),
    )
    return quality.select("capture_id", texts.alias("caveats"))


def admit_sessions(packets: DataFrame, sessions: DataFrame, floor: int = 20,
                   per_packet_s: int = 4) -> DataFrame:
    """Sessions with their ESP packet count and whether it reaches the floor.

    The floor is ``max(20, duration // 4)``; rejected sessions stay in the
    result with ``admitted`` false.
    """
    counts = packets.filter(F.col("proto") == "esp").groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("esp_packets")
    )
    need = F.greatest(F.lit(floor), F.expr(f"duration_s div {per_packet_s}"))
    return (
        sessions.join(counts, "capture_id", "left")
        .withColumn("esp_packets", F.coalesce("esp_packets", F.lit(0)))
        .withColumn("required", need.cast("bigint"))
        .withColumn("admitted", F.col("esp_packets") >= F.col("required"))
    )
