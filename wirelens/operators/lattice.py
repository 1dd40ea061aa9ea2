"""Cipher-suite sieve over ESP payload lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.functions import attrs

KEYS = ["capture_id", "pair_id"]
# Most constrained first: larger block, then larger overhead, then table order.
RANKED = sorted(dims.SUITES, key=lambda s: (s[3], s[1] + s[2]), reverse=True)

TRUNCATED = "the capture is truncated, so recorded lengths are not the real ones"
TOO_UNIFORM = "too few packets or distinct lengths for the suite sieve"
NO_SUITE = "no candidate suite fits every observed length"


def length_histogram(tagged: DataFrame) -> DataFrame:
    """(pair, length, packets): what the sieve reads, reduced on the map side."""
    return (
        tagged.filter((F.col("proto") == "esp") & F.col("esp_payload_len").isNotNull())
        .groupBy(*KEYS, "esp_payload_len").agg(F.count(F.lit(1)).alias("packets"))
        .withColumnRenamed("esp_payload_len", "length")
    )


def suite_survivors(lengths: DataFrame) -> DataFrame:
    """Per pair the suites every length fits, best first.

    The eight tests are eight boolean aggregates over distinct lengths, so no
    candidate rows are generated.
    """
    tests = []
    for i, (_, iv, icv, block, _, _) in enumerate(RANKED):
        body = F.col("length") - (iv + icv)
        tests.append(F.min((body % block == 0) & (body >= block)).alias(f"_s{i}"))
    agg = lengths.groupBy(*KEYS).agg(
        F.sum("packets").alias("esp_packets"), F.count(F.lit(1)).alias("distinct_lengths"),
        F.min("length").alias("shortest_length"), F.max("length").alias("longest_length"), *tests,
    )
    slots = [
        F.when(F.col(f"_s{i}"), F.struct(
            F.lit(name).alias("suite"), F.lit(enc).alias("encryption"), F.lit(integ).alias("integrity")))
        for i, (name, _, _, _, enc, integ) in enumerate(RANKED)
    ]
    return agg.select(
        *KEYS, "esp_packets", "distinct_lengths", "shortest_length", "longest_length",
        F.filter(F.array(*slots), lambda s: s.isNotNull()).alias("survivors"),
    )


def suite_long(lengths: DataFrame) -> DataFrame:
    """Survivors one per row with their rank."""
    s = suite_survivors(lengths)
    return s.select(*KEYS, F.posexplode("survivors").alias("pos", "s")).select(
        *KEYS, (F.col("pos") + 1).alias("place"), "s.suite", "s.encryption", "s.integrity")


def survivor_confidence(count, total: int):
    """1 when one is left, 0 when all are."""
    return F.lit(1.0) - (count - 1) / F.lit(total - 1)


def detect_suite(survivors: DataFrame, quality: DataFrame) -> DataFrame:
    """Suite, encryption and integrity per pair, each with its own confidence.

    ``quality`` gates per capture: truncated or too uniform captures are refused.
    """
    j = survivors.join(
        quality.select("capture_id", "truncated", "sufficient_for_lattice"), "capture_id")
    n = F.size("survivors")
    proof = attrs.evidence("esp_length_lattice", measured={
        "survivors": F.when(n > 0, F.concat_ws(", ", F.col("survivors.suite"))).otherwise("none"),
        "survivor_count": n, "candidates_tested": F.lit(len(RANKED)),
        "esp_packets": F.col("esp_packets"), "distinct_lengths": F.col("distinct_lengths"),
        "shortest_length": F.col("shortest_length"), "longest_length": F.col("longest_length"),
    })

    def answer(field: str, total: int):
        found = F.size(F.array_distinct(F.col(f"survivors.{field}")))
        note = F.format_string("%d of %d candidate suites fit every length; %d distinct answers",
                               n, F.lit(len(RANKED)), found)
        return (
            F.when(F.col("truncated"), attrs.unavailable(TRUNCATED, "string"))
            .when(~F.col("sufficient_for_lattice"), attrs.unavailable(TOO_UNIFORM, "string"))
            .when(n == 0, attrs.unavailable(NO_SUITE, "string", proof))
            .otherwise(attrs.inferred(F.get("survivors", F.lit(0))[field], "string",
                                      survivor_confidence(found, total), proof, note))
        )

    return j.select(
        *KEYS,
        answer("suite", len(RANKED)).alias("suite"),
        answer("encryption", len({s[4] for s in RANKED})).alias("encryption_alg"),
        answer("integrity", len({s[5] for s in RANKED})).alias("integrity_alg"),
    )
