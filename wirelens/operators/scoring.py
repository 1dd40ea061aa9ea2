"""Scores, exposure, threat matrix and finding views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.functions import scalars

CHANCE = 1.0 / 7.0


def category_penalties(findings: DataFrame) -> DataFrame:
    """Penalty per capture and category, before and after its cap."""
    cap = dims.lookup(dims.CATEGORY_CAPS, F.col("category"))
    return findings.groupBy("capture_id", "category").agg(F.sum("penalty").alias("raw")).withColumn(
        "capped", F.least(F.col("raw"), cap.cast("bigint")))


def score(findings: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """100 minus the capped penalties, floored at zero, with its rating."""
    s = category_penalties(findings).groupBy("capture_id").agg(
        F.sum("capped").alias("lost"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "capped")))).alias("category_penalties"),
    )
    if captures is not None:
        s = captures.select("capture_id").join(s, "capture_id", "left")
    total = F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0)))
    return s.select(
        "capture_id", total.alias("total"), scalars.rating(total).alias("rating"),
        F.coalesce("category_penalties", F.create_map().cast("map<string,bigint>")).alias("category_penalties"),
    )


def first_seen_labels(predictions: DataFrame) -> DataFrame:
    """Distinct labels per capture in the order they first appear (at most seven)."""
    seen = predictions.groupBy("capture_id", "label").agg(
        F.min(F.struct("pair_id", "start_us")).alias("at"))
    return seen.groupBy("capture_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda s: s["label"]).alias("identified_classes"))


def exposure(predictions: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """Mean confidence over all predictions of a capture, scaled from chance."""
    m = predictions.groupBy("capture_id").agg(
        F.avg("probability").alias("mean"), F.count(F.lit(1)).alias("windows"))
    m = m.join(first_seen_labels(predictions), "capture_id")
    if captures is not None:
        m = captures.select("capture_id").join(m, "capture_id", "left")
    mean = F.coalesce("mean", F.lit(0.0))
    value = F.when(F.col("windows").isNotNull(), F.bround(
        100 * F.greatest(F.lit(0.0), (mean - CHANCE) / (1.0 - CHANCE)), 0)).otherwise(0).cast("int")
    names = F.concat_ws(", ", "identified_classes")
    why = (
        F.when(F.col("windows").isNull(), "no inner traffic was classified, so exposure was not measured")
        .when(value == 0, F.format_string("%d windows averaged %.2f confidence, no better than chance", "windows", mean))
        .otherwise(F.format_string("identified as %s with mean confidence %.2f over %d windows", names, mean, "windows"))
    )
    return m.select("capture_id", value.alias("score"), mean.alias("mean_classifier_confidence"),
                    F.coalesce("identified_classes", F.array().cast("array<string>")).alias("identified_classes"),
                    why.alias("rationale"))


def threat_matrix(findings: DataFrame) -> DataFrame:
    """Techniques with their distinct findings, worst first, and worst severity.

    Findings are reduced to (capture, technique, rule) before any list is built,
    so a list is never longer than the policy. Rank and cost are one number there:
    its least is kept in a hash table, while the least of a structure would sort all findings.
    """
    bits, low = 1 << 32, 1 << 31
    rank, cost = F.coalesce(dims.severity_rank(F.col("severity")).cast("bigint"), F.lit(-1)), F.coalesce(-F.col("penalty").cast("bigint"), F.lit(-low))
    per_rule = (
        findings.select("capture_id", F.explode("attack_techniques").alias("technique_id"), "id",
                        (rank * bits + cost + low).alias("m"))
        .groupBy("capture_id", "technique_id", "id").agg(F.min("m").alias("m"))
    )
    cost = F.pmod("m", F.lit(bits)) - low
    per_rule = per_rule.withColumn("o", F.struct(
        F.nullif(F.shiftright("m", 32), F.lit(-1)).cast("int").alias("rank"), F.nullif(cost, F.lit(-low)).alias("cost"), "id"))
    rows = per_rule.groupBy("capture_id", "technique_id").agg(
        F.array_sort(F.collect_list("o")).alias("all"), F.min("o.rank").alias("worst"))
    names = {t: n for t, (n, _) in dims.TECHNIQUES.items()}
    tactics = F.lit(None).cast("array<string>")
    for t, (_, list_) in dims.TECHNIQUES.items():
        tactics = F.when(F.col("technique_id") == t, F.array(*[F.lit(x) for x in list_])).otherwise(tactics)
    severity = F.element_at(F.array(*[F.lit(s) for s in dims.SEVERITIES]), F.col("worst") + 1)
    return rows.select(
        "capture_id", "technique_id",
        dims.lookup(names, F.col("technique_id"), F.col("technique_id")).alias("technique_name"),
        F.coalesce(tactics, F.array().cast("array<string>")).alias("tactics"),
        F.col("all.id").alias("finding_ids"), severity.alias("max_severity"),
    )


def order_findings(findings: DataFrame) -> DataFrame:
    """Worst severity first, then penalty, rule and SPI."""
    return findings.orderBy("capture_id", dims.severity_rank(F.col("severity")), F.col("penalty").desc(),
                            "id", F.coalesce("sa_spi", F.lit("")))


def sort_findings(findings: DataFrame, by: str = "penalty", descending: bool = True) -> DataFrame:
    key = {"penalty": F.col("penalty"), "severity": dims.severity_rank(F.col("severity")), "id": F.col("id")}[by]
    return findings.orderBy(key.desc() if descending else key.asc(), "id")


def top_risks(findings: DataFrame, k: int = 3) -> DataFrame:
    """The k worst findings per capture; the rank limit also runs map-side."""
    w = Window.partitionBy("capture_id").orderBy(
        dims.severity_rank(F.col("severity")), F.col("penalty").desc(), "id", "sa_spi")
    return findings.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def filter_findings(findings: DataFrame, severities: list[str] | None = None,
                    technique: str | None = None) -> DataFrame:
    if severities:
        findings = findings.filter(F.col("severity").isin(*severities))
    if technique:
        findings = findings.filter(F.array_contains("attack_techniques", technique))
    return findings


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("capture_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES])
