"""Parsed parameters against ground-truth labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = ["match", "honest_gap", "inferred", "mismatch", "fabricated", "not_reported"]
FAILED = ["mismatch", "fabricated"]


def label_rows(labels: DataFrame, fields: list[str]) -> DataFrame:
    """Nested labels in long form: (session, field, expected, unobservable)."""
    items = [
        F.struct(F.lit(f).alias("field"), F.col(f"expected.{f}").cast("string").alias("expected"),
                 F.map_contains_key(F.coalesce("not_observable_from_ike", F.create_map().cast("map<string,string>")),
                                    F.lit(f)).alias("unobservable"))
        for f in fields
    ]
    return labels.select(F.col("name").alias("session"), F.explode(F.array(*items)).alias("i")).select(
        "session", "i.*")


def verify_sessions(parameters: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcome per (session, field).

    ``parameters``: session, field, value, provenance. ``labels``: session,
    field, expected, unobservable. A value where the labels say there can be
    none is fabricated even when only inferred. Both sides are sorted and merged:
    the planner sees only the width of exploded parameters, not their number, and
    would send all of them to every task.
    """
    j = labels.join(parameters.hint("merge"), ["session", "field"], "left")
    gap = F.col("provenance").isNull() | (F.col("provenance") == "unavailable")
    outcome = (
        F.when(F.col("provenance").isNull(), "not_reported")
        .when(gap & F.col("unobservable"), "honest_gap")
        .when(gap, "not_reported")
        .when(F.col("unobservable"), "fabricated")
        .when(F.col("provenance") == "inferred", "inferred")
        .when(F.col("value").eqNullSafe(F.col("expected")), "match")
        .otherwise("mismatch")
    )
    return j.withColumn("outcome", outcome)


def verify_totals(results: DataFrame) -> DataFrame:
    """Fields per outcome, outcomes without a field as zero."""
    totals = results.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    return totals.unpivot([], OUTCOMES, "outcome", "fields")


def session_results(results: DataFrame) -> DataFrame:
    """Failures per session and whether it passed."""
    bad = F.col("outcome").isin(*FAILED)
    return results.groupBy("session").agg(
        F.count(F.lit(1)).alias("fields"), F.count_if(bad).alias("failures"),
    ).withColumn("passed", F.col("failures") == 0)


def batch_result(sessions: DataFrame, unreadable: DataFrame) -> DataFrame:
    """One row: the batch passes when every session does and none is unreadable."""
    zero = F.lit(0).cast("bigint")
    s = sessions.agg(F.count(F.lit(1)).alias("sessions"), F.count_if(~F.col("passed")).alias("failed"),
                     zero.alias("unreadable"))
    u = unreadable.agg(zero.alias("sessions"), zero.alias("failed"), F.count(F.lit(1)).alias("unreadable"))
    both = s.unionByName(u).agg(*[F.sum(c).alias(c) for c in ("sessions", "failed", "unreadable")])
    return both.withColumn("passed", (F.col("failed") == 0) & (F.col("unreadable") == 0))
