"""Long-form parameters, assessment comparison and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.session import materialise


def parameter_rows(sas: DataFrame) -> DataFrame:
    """One row per (association, parameter): label, value as text, provenance."""
    items = [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("field"), F.lit(label).alias("label"),
                 F.col(n)["value"].cast("string").alias("value"), F.col(n)["provenance"].alias("provenance"),
                 F.col(n)["confidence"].alias("confidence"), F.col(n)["note"].alias("note"))
        for i, (n, label, _) in enumerate(dims.PARAMETERS)
    ]
    return sas.select("capture_id", "pair_id", F.explode(F.array(*items)).alias("p")).select(
        "capture_id", "pair_id", "p.*")


def first_association(sas: DataFrame) -> DataFrame:
    """Each capture's first association: found by its id, so that only the first ones are shuffled as wide rows."""
    first = materialise(sas.groupBy("capture_id").agg(F.min("pair_id").alias("pair_id")))
    return sas.join(first, ["capture_id", "pair_id"], "left_semi").dropDuplicates(["capture_id"])


def attribute_diffs(sas: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Per comparison (cmp_id, a, b) and field: both sides and whether they differ."""
    rows = parameter_rows(first_association(sas)).filter(F.col("field").isin(*dims.COMPARED_FIELDS))

    def side(name: str) -> DataFrame:
        c = comparisons.select("cmp_id", F.col(name).alias("capture_id"))
        return c.join(rows, "capture_id").select(
            "cmp_id", "field", F.col("value").alias(f"{name}_value"), F.col("provenance").alias(f"{name}_provenance"))

    j = side("a").join(side("b"), ["cmp_id", "field"], "full")
    same = F.col("a_value").eqNullSafe(F.col("b_value")) & F.col("a_provenance").eqNullSafe(F.col("b_provenance"))
    return j.withColumn("changed", ~same)


def finding_sets(findings: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Rules found only in a, only in b, or in both, per comparison."""
    ids = findings.select("capture_id", "id").distinct()

    def side(name: str) -> DataFrame:
        return comparisons.select("cmp_id", F.col(name).alias("capture_id")).join(ids, "capture_id").select("cmp_id", "id")

    both = side("a").withColumn("side", F.lit(1)).unionByName(side("b").withColumn("side", F.lit(2)))
    seen = both.groupBy("cmp_id", "id").agg(F.bit_or("side").alias("sides"))
    return seen.select("cmp_id", "id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("both")), F.col("sides")).alias("found_in"))


def score_delta(scores: DataFrame, comparisons: DataFrame) -> DataFrame:
    a = scores.select(F.col("capture_id").alias("a"), F.col("total").alias("a_total"))
    b = scores.select(F.col("capture_id").alias("b"), F.col("total").alias("b_total"))
    return comparisons.join(a, "a").join(b, "b").select(
        "cmp_id", "a", "b", (F.col("b_total") - F.col("a_total")).alias("score_delta"))


def unavailable_counts(sas: DataFrame) -> DataFrame:
    """Unavailable parameters per capture."""
    return parameter_rows(sas).groupBy("capture_id").agg(
        F.count_if(F.col("provenance") == "unavailable").alias("unavailable"), F.count(F.lit(1)).alias("parameters"))


def timeline(spans: DataFrame) -> DataFrame:
    """One row per span: its midpoint in whole seconds since the capture's first span,
    and its probability in the column of its label."""
    start = spans.groupBy("capture_id").agg(F.min("window_start_us").alias("start_us"))
    mid = (F.col("window_start_us") + F.col("window_end_us")) / 2
    return spans.join(start, "capture_id").select(
        "capture_id", "pair_id", F.floor((mid - F.col("start_us")) / 1e6 + 0.5).alias("t_s"),
        *[F.when(F.col("label") == c, F.col("probability")).alias(c) for c in dims.TRAFFIC_CLASSES])
