"""Fold assignment by configuration, feature matrices and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.functions import scalars
from wirelens.operators import ordered

FOLDS = ["train", "calibration", "test"]
PROVENANCE = ["config_name", "session_name", "traffic_class", "fold", "start_us"]


def split_configs(windows: DataFrame, calibration: float = 0.15, test: float = 0.20,
                  salt: str = "split") -> DataFrame:
    """(config_name, fold): whole configurations, stratified by class, by hash order.

    Pass the salt of an earlier split to reproduce it. Classes are few, so the
    hash order is split by its first byte to spread one class over many tasks.
    """
    configs = windows.select("traffic_class", "config_name").distinct().withColumn(
        "h", F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("config_name")), 256), 1, 16))
    totals = configs.groupBy("traffic_class").agg(F.count(F.lit(1)).alias("n"))
    placed = ordered.numbered(configs, ["traffic_class"], ["h", "config_name"],
                              F.substring("h", 1, 2), "place").join(totals, "traffic_class")

    def share(fraction: float) -> Column:
        return F.greatest(F.lit(1), F.bround(F.lit(fraction) * F.col("n"), 0).cast("bigint"))

    n_test = F.when(F.col("n") > 2, share(test)).when(F.col("n") > 1, 1).otherwise(0)
    placed = placed.withColumn("n_test", n_test)
    placed = placed.withColumn(
        "n_cal", F.when(F.col("n") - F.col("n_test") > 2, share(calibration)).otherwise(0))
    fold = F.when(F.col("place") <= F.col("n_test"), 2).when(
        F.col("place") <= F.col("n_test") + F.col("n_cal"), 1).otherwise(0)
    # A configuration under several classes takes train before calibration before test.
    first = placed.groupBy("config_name").agg(F.min(fold).alias("f"))
    return first.select("config_name", F.element_at(F.array(*[F.lit(x) for x in FOLDS]), F.col("f") + 1).alias("fold"))


def to_matrix(windows: DataFrame, split: DataFrame) -> DataFrame:
    """Windows with their fold; unassigned configurations are dropped."""
    return windows.join(split, "config_name")


def feature_columns(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in PROVENANCE and c != "seq" and not c.startswith("seq_")]


def sequence_columns(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c == "seq" or c.startswith("seq_")]


def comparable_features(names: list[str]) -> list[str]:
    return sorted(set(names) - set(dims.NOT_COMPARABLE))


def select_comparable(matrix: DataFrame) -> DataFrame:
    """Drop the padding-geometry columns."""
    return matrix.drop(*dims.NOT_COMPARABLE)


def session_configs(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("config_name", scalars.config_name(F.col("session_name")))


def dataset_gaps(sessions: DataFrame, captures: DataFrame, labels: DataFrame, sas: DataFrame) -> DataFrame:
    """Sessions that cannot be used, with every reason that applies."""
    key = "session_name"
    unlabelled = labels.filter(F.col("traffic_class").isNotNull())
    checks = [
        (captures, "missing capture"), (labels, "missing labels"),
        (unlabelled, "no traffic class in labels"), (sas, "no security associations"),
    ]
    out = None
    for table, reason in checks:
        lost = sessions.select(key).join(table.select(key), key, "left_anti").withColumn("reason", F.lit(reason))
        out = lost if out is None else out.unionByName(lost)
    return out


def coverage(rows: DataFrame, names: list[str], expected: DataFrame | None = None) -> DataFrame:
    """Occurrences of each dimension value; expected values without rows count zero."""
    long = rows.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("dimension"), F.col(n).cast("string").alias("value")) for n in names
    ])).alias("d")).select("d.*")
    counts = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("sessions"))
    if expected is None:
        return counts
    return expected.join(counts, ["dimension", "value"], "left").withColumn(
        "sessions", F.coalesce("sessions", F.lit(0)))


def _pair_structs(names: list[str]) -> Column:
    ordered_names = sorted(names)
    return F.array(*[
        F.struct(F.lit(a).alias("left_dim"), F.col(a).cast("string").alias("left_value"),
                 F.lit(b).alias("right_dim"), F.col(b).cast("string").alias("right_value"))
        for i, a in enumerate(ordered_names) for b in ordered_names[i + 1:]
    ])


def pair_coverage(rows: DataFrame, names: list[str]) -> DataFrame:
    """Distinct value pairs of any two dimensions that occur together, with counts."""
    return rows.select(F.explode(_pair_structs(names)).alias("p")).select("p.*").groupBy(
        "left_dim", "left_value", "right_dim", "right_value").agg(F.count(F.lit(1)).alias("sessions"))


def missing_pairs(rows: DataFrame, names: list[str], expected: DataFrame) -> DataFrame:
    """Required value pairs never seen together.

    ``expected`` (dimension, value) is the matrix definition, a short
    configuration list, so its pairs are few whatever the number of sessions.
    """
    a = expected.select(F.col("dimension").alias("left_dim"), F.col("value").alias("left_value"))
    b = expected.select(F.col("dimension").alias("right_dim"), F.col("value").alias("right_value"))
    required = a.join(b, F.col("left_dim") < F.col("right_dim"))
    keys = ["left_dim", "left_value", "right_dim", "right_value"]
    return required.join(pair_coverage(rows, names).select(*keys), keys, "left_anti")


def fold_counts(matrix: DataFrame) -> DataFrame:
    """Windows, configurations and sessions per fold.

    Reduced to (fold, config, session) first, so each fold's distinct counts are
    taken over names instead of windows.
    """
    names = matrix.groupBy("fold", "config_name", "session_name").agg(F.count(F.lit(1)).alias("w"))
    return names.groupBy("fold").agg(
        F.sum("w").alias("windows"), F.count_distinct("config_name").alias("configs"),
        F.count_distinct("session_name").alias("sessions"))


def absent_classes(windows: DataFrame) -> DataFrame:
    """Classes without a scorable window."""
    known = dims.traffic_classes(windows.sparkSession)
    present = windows.select("traffic_class").distinct()
    return known.join(present, "traffic_class", "left_anti").withColumn(
        "reason", F.lit("no window reached the packet floor"))


def fold_checks(matrix: DataFrame) -> DataFrame:
    """Names in more than one fold, per kind; an empty result proves disjointness."""
    out = None
    for kind in ("config_name", "session_name"):
        bad = (
            matrix.select(F.col(kind).alias("name"), "fold").distinct()
            .groupBy("name").agg(F.count(F.lit(1)).alias("folds")).filter("folds > 1")
            .withColumn("kind", F.lit(kind))
        )
        out = bad if out is None else out.unionByName(bad)
    return out


def uncovered_configs(windows: DataFrame, split: DataFrame) -> DataFrame:
    """Configurations the split misses; empty when it is complete."""
    return windows.select("config_name").distinct().exceptAll(split.select("config_name"))
