"""Constraints as jobs that return the violating rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens import dims


def bad_features(matrix: DataFrame, names: list[str]) -> DataFrame:
    """Features with a null, NaN or infinite value, counted in one pass."""
    def bad(c: str):
        v = F.col(c)
        return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    counts = matrix.agg(*[F.count_if(bad(c)).alias(c) for c in names])
    return counts.unpivot([], names, "feature", "bad").filter("bad > 0")


def attribute_violations(parameters: DataFrame) -> DataFrame:
    """Provenance rules broken by long-form parameters."""
    p, v, c = F.col("provenance"), F.col("value"), F.col("confidence")
    blank = F.trim(F.coalesce(F.col("note"), F.lit(""))) == ""
    why = (
        F.when((p == "inferred") & c.isNull(), "inferred without confidence")
        .when((p == "inferred") & v.isNull(), "inferred without value")
        .when((p == "observed") & c.isNotNull(), "observed with confidence")
        .when((p == "observed") & v.isNull(), "observed without value")
        .when((p == "unavailable") & c.isNotNull(), "unavailable with confidence")
        .when((p == "unavailable") & v.isNotNull(), "unavailable with value")
        .when((p == "unavailable") & blank, "unavailable without reason")
        .when(~p.isin("inferred", "observed", "unavailable"), "unknown provenance")
        .when((c < 0) | (c > 1), "confidence outside 0..1")
    )
    return parameters.withColumn("detail", why).filter(F.col("detail").isNotNull())


def quality_violations(quality: DataFrame) -> DataFrame:
    why = (
        F.when(F.col("ike_complete") & ~F.col("has_ike"), "complete without key exchange")
        .when(F.col("sufficient_for_lattice") & (F.col("esp_sa_count") == 0), "sufficient without associations")
        .when(F.col("sufficient_for_lattice") & F.col("truncated"), "sufficient though truncated")
    )
    return quality.withColumn("detail", why).filter(F.col("detail").isNotNull())


def sa_violations(sas: DataFrame) -> DataFrame:
    def family(c: str):
        return F.when(F.col(c).contains(":"), 6).otherwise(4)

    why = (
        F.when(F.col("last_us") < F.col("first_us"), "ends before it starts")
        .when((family("src") != F.col("ip_version")) | (family("dst") != F.col("ip_version")), "address family")
        .when((F.col("packet_count") == 0) & (F.col("byte_count") > 0), "bytes without packets")
    )
    return sas.withColumn("detail", why).filter(F.col("detail").isNotNull())


def finding_violations(findings: DataFrame) -> DataFrame:
    cap = dims.lookup(dims.CATEGORY_CAPS, F.col("category"))
    why = F.when(F.col("penalty") > cap, "penalty over cap").when(
        (F.col("severity") == "informational") & (F.col("penalty") != 0), "informational with penalty")
    return findings.withColumn("detail", why).filter(F.col("detail").isNotNull())


def score_violations(scores: DataFrame) -> DataFrame:
    """Totals that do not follow from the category penalties, and broken caps."""
    values = F.map_values("category_penalties")
    lost = F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)
    over = F.exists(F.map_entries("category_penalties"),
                    lambda e: (e["value"] > dims.lookup(dims.CATEGORY_CAPS, e["key"])) | (e["value"] < 0))
    why = F.when(over, "category outside its cap").when(
        F.col("total") != F.greatest(F.lit(0), 100 - lost), "total does not add up")
    return scores.withColumn("detail", why).filter(F.col("detail").isNotNull())


def dangling_references(findings: DataFrame, sas: DataFrame, threats: DataFrame) -> DataFrame:
    """Findings about unknown associations, threats citing unknown findings, duplicates."""
    spis = sas.select("capture_id", F.explode(F.array("spi_initiator", "spi_responder")).alias("sa_spi")).filter(
        F.col("sa_spi").isNotNull())
    lost = findings.filter(F.col("sa_spi").isNotNull()).join(spis, ["capture_id", "sa_spi"], "left_anti").select(
        "capture_id", F.concat_ws(" ", "id", "sa_spi").alias("key"), F.lit("finding without association").alias("detail"))
    cited = threats.select("capture_id", "technique_id", F.explode("finding_ids").alias("id"))
    stray = cited.join(findings.select("capture_id", "id"), ["capture_id", "id"], "left_anti").select(
        "capture_id", F.concat_ws(" ", "technique_id", "id").alias("key"), F.lit("threat without finding").alias("detail"))
    twice = findings.groupBy("capture_id", "id", "sa_spi").count().filter("count > 1").select(
        "capture_id", F.concat_ws(" ", "id", "sa_spi").alias("key"), F.lit("duplicate finding").alias("detail"))
    return lost.unionByName(stray).unionByName(twice)


SPI_FORMAT = r"^([0-9a-f]{8}|[0-9a-f]{16})$"
FINDING_FORMAT = r"^[A-Z][A-Z0-9]*(-[A-Z0-9]+)*$"
TECHNIQUE_FORMAT = r"^T\d{4}(\.\d{3})?$"


def format_violations(findings: DataFrame) -> DataFrame:
    """Identifiers out of format, one row per offending value."""
    checks = F.array(
        F.when(~F.col("sa_spi").rlike(SPI_FORMAT), F.concat(F.lit("spi "), "sa_spi")),
        F.when(~F.col("id").rlike(FINDING_FORMAT), F.concat(F.lit("finding "), "id")),
    )
    techs = F.transform(F.filter("attack_techniques", lambda t: ~t.rlike(TECHNIQUE_FORMAT)),
                        lambda t: F.concat(F.lit("technique "), t))
    bad = F.concat(F.filter(checks, lambda x: x.isNotNull()), techs)
    return findings.select("capture_id", F.explode(bad).alias("detail"))


def evidence_violations(findings: DataFrame) -> DataFrame:
    """Evidence whose total is below what it lists, or which lists too many."""
    e = F.col("evidence")
    why = F.when(e["total_matching"] < F.size(e["packet_indices"]), "total below listed").when(
        F.size(e["packet_indices"]) > 20, "more than 20 listed")
    return findings.withColumn("detail", why).filter(F.col("detail").isNotNull())
