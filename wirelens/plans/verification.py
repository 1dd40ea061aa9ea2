"""Parsed associations against ground-truth labels, for a whole batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.operators import compare, verify


def verify_batch(sas: DataFrame, labels: DataFrame, unreadable: DataFrame) -> dict[str, DataFrame]:
    """Field outcomes, totals, session verdicts and the batch verdict.

    The first association of each session is checked; its ``capture_id`` is the
    session's name.
    """
    rows = compare.parameter_rows(compare.first_association(sas)).filter(F.col("field").isin(*dims.VERIFIED_FIELDS))
    params = rows.select(F.col("capture_id").alias("session"), "field", "value", "provenance")
    wanted = verify.label_rows(labels, dims.VERIFIED_FIELDS)
    results = verify.verify_sessions(params, wanted)
    sessions = verify.session_results(results)
    return {
        "results": results, "totals": verify.verify_totals(results), "sessions": sessions,
        "batch": verify.batch_result(sessions, unreadable),
    }
