"""Forward secrecy from the size of rekey exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.functions import attrs

KEYS = ["capture_id", "lo", "hi"]
CREATE_CHILD, INFORMATIONAL = 36, 37
TOLERANCE = 0.4


def exchange_sizes(messages: DataFrame) -> DataFrame:
    """Size histogram of version-2 exchanges per unordered endpoint pair and kind."""
    kind = F.when(F.col("exchange_type") == CREATE_CHILD, "create_child").when(
        F.col("exchange_type") == INFORMATIONAL, "informational")
    return (
        messages.filter((F.col("ike_version") == "ikev2") & (F.col("length") != 0))
        .select("capture_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"),
                kind.alias("kind"), "length")
        .filter(F.col("kind").isNotNull())
        .groupBy(*KEYS, "kind", "length").agg(F.count(F.lit(1)).alias("messages"))
    )


def exchange_summary(sizes: DataFrame) -> DataFrame:
    """Messages and median size per kind and endpoint pair."""
    return sizes.groupBy(*KEYS, "kind").agg(
        F.sum("messages").alias("messages"),
        F.percentile("length", F.lit(0.5), F.col("messages")).alias("median_length"),
    )


def infer_pfs(create_child: DataFrame, baseline: DataFrame, groups: DataFrame,
              tolerance: float = TOLERANCE) -> DataFrame:
    """Whether rekeys carry a fresh key exchange, per endpoint pair.

    ``create_child`` and ``baseline``: KEYS, length, messages (size histograms,
    the second of exchanges known to carry no key exchange). ``groups``: KEYS,
    dh_group. Informational sizes are no baseline.
    """
    def median(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*KEYS).agg(
            F.percentile("length", F.lit(0.5), F.col("messages")).alias(f"{name}_median"),
            F.sum("messages").alias(f"{name}_n"))

    j = groups.join(median(create_child, "create"), KEYS, "left").join(
        median(baseline, "base"), KEYS, "left")
    known = dims.lookup(dims.DH_PUBLIC_BYTES, F.col("dh_group")).cast("int")
    j = j.withColumn("expected", known + dims.KE_HEADER_BYTES).withColumn(
        "delta", F.col("create_median") - F.col("base_median"))
    enabled = F.abs(F.col("delta") - F.col("expected")) <= F.col("expected") * tolerance
    ecp = F.col("dh_group").isin(*dims.ECP_GROUPS)
    confidence = F.when(ecp, 0.65).otherwise(0.9)
    proof = attrs.evidence("create_child_sa_size_delta", measured={
        "dh_group": F.col("dh_group"), "expected_delta_bytes": F.col("expected"),
        "observed_delta_bytes": F.bround("delta", 0).cast("int"),
        "baseline_median_bytes": F.bround("base_median", 0).cast("int"),
        "create_child_median_bytes": F.bround("create_median", 0).cast("int"),
        "create_child_exchanges": F.col("create_n"),
    })
    note = F.format_string("rekey exchanges are %d bytes larger than the baseline; %d expected",
                           F.bround("delta", 0).cast("int"), F.col("expected"))
    return j.withColumn("pfs_enabled", (
        F.when(F.col("dh_group").isNull(),
               attrs.unavailable("the key-exchange group was not observed", "boolean"))
        .when(known.isNull(), attrs.unavailable("the group's public size is not known", "boolean"))
        .when(F.col("create_n").isNull(),
              attrs.unavailable("no rekey exchange in this capture", "boolean"))
        .when(F.col("base_n").isNull(),
              attrs.unavailable("no exchange without a key exchange to measure from", "boolean"))
        .otherwise(attrs.inferred(enabled, "boolean", confidence, proof, note))
    ))
