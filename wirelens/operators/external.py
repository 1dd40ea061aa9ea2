"""Captures without ESP: address-pair flows, name labels and their gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.functions import scalars

MIN_PACKETS = 8


def as_esp_shaped(packets: DataFrame) -> DataFrame:
    """Use the IP payload length where the features read the ESP one."""
    return packets.withColumn("esp_payload_len", F.col("ip_payload_len"))


def external_pairs(packets: DataFrame, min_packets: int = MIN_PACKETS) -> DataFrame:
    """Address pairs with enough packets; the direction seen first is forward.

    Directed sums are reduced map-side; the two directions of a pair meet by
    their unordered addresses, two rows per pair.
    """
    d = (
        packets.filter((F.col("src") != "") & (F.col("dst") != ""))
        .groupBy("capture_id", "src", "dst")
        .agg(F.min("index").alias("first_index"), F.min("ts_us").alias("start_ts_us"),
             F.max("ts_us").alias("end_ts_us"), F.count(F.lit(1)).alias("packets"))
    )
    side = F.struct("first_index", "src", "dst", "start_ts_us", "end_ts_us", "packets")
    p = d.groupBy("capture_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(
        F.min(side).alias("fwd"), F.max(side).alias("other"), F.count(F.lit(1)).alias("sides"),
        F.sum("packets").alias("packets"))
    p = p.filter(F.col("packets") >= min_packets)
    return p.select(
        "capture_id", F.col("fwd.first_index").alias("pair_id"), "fwd",
        F.when(F.col("sides") > 1, F.col("other")).alias("rev"),
        (F.col("sides") > 1).alias("paired"), "packets",
        scalars.address_pair_id(F.col("fwd.src"), F.col("fwd.dst")).alias("fwd_spi"),
    )


def tag_external(packets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Packets with their address pair and direction, sizes ESP-shaped."""
    ends = pairs.select(
        "capture_id", "pair_id", "paired",
        F.least("fwd.start_ts_us", "rev.start_ts_us").alias("first_us"),
        F.greatest("fwd.end_ts_us", "rev.end_ts_us").alias("last_us"),
        F.col("fwd.src").alias("fs"), F.col("fwd.dst").alias("fd"),
    )
    sides = ends.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("up")).select(
        "capture_id", "pair_id", "paired", "first_us", "last_us", "up",
        F.when(F.col("up"), F.col("fs")).otherwise(F.col("fd")).alias("src"),
        F.when(F.col("up"), F.col("fd")).otherwise(F.col("fs")).alias("dst"))
    return as_esp_shaped(packets).join(sides, ["capture_id", "src", "dst"])


def name_labels(files: DataFrame) -> DataFrame:
    """Add the class and the tunnel flag a file's name encodes."""
    return files.withColumns({
        "label": scalars.label_from_name(F.col("name")),
        "tunnelled": scalars.is_tunnelled(F.col("name")),
    })


def gap_report(files: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Counts of what a corpus could not contribute.

    ``files``: name, label, flows, unreadable. Out-of-vocabulary labels count
    their flows, the others count files.
    """
    usable = ~F.col("unreadable") & (F.col("flows") > 0)
    return files.agg(
        F.count_if(F.col("unreadable")).alias("unreadable"),
        F.count_if(~F.col("unreadable") & (F.col("flows") == 0)).alias("empty"),
        F.count_if(usable & F.col("label").isNull()).alias("unmapped"),
        F.coalesce(F.sum(F.when(usable & F.col("label").isNotNull() & ~F.col("label").isin(*vocabulary),
                                F.col("flows"))), F.lit(0)).alias("labels_not_in_model"),
        F.coalesce(F.sum(F.when(usable & F.col("label").isin(*vocabulary), F.col("flows"))), F.lit(0)).alias("scorable"),
    )


def substitute_means(flows: DataFrame, means: dict[str, float]) -> DataFrame:
    """Hold the padding-geometry features at their training means."""
    return flows.withColumns({c: F.lit(float(means.get(c, 0.0))) for c in dims.NOT_COMPARABLE})


def scorable_flows(flows: DataFrame, vocabulary: list[str], tunnelled_only: bool = False) -> DataFrame:
    kept = flows.filter(F.col("label").isin(*vocabulary))
    return kept.filter("tunnelled") if tunnelled_only else kept
