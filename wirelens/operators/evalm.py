"""Classifier evaluation as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 10


def confusion(predictions: DataFrame) -> DataFrame:
    """(truth, predicted, n): at most classes squared rows after a map-side reduce."""
    return predictions.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """One row per true label, one column per predicted label, zeros kept."""
    spark = predictions.sparkSession
    rows = spark.createDataFrame([(x,) for x in labels], "truth string")
    wide = confusion(predictions).groupBy("truth").pivot("predicted", labels).agg(F.sum("n"))
    return rows.join(wide, "truth", "left").select(
        "truth", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(x) for x in labels])


def f1_table(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """Support, F1 per label of a fixed list; zero where nothing was seen."""
    spark = predictions.sparkSession
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(zero)
    sides = confusion(predictions).select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), zero.alias("chosen"), hit.alias("tp")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), F.col("n").alias("chosen"), zero.alias("tp")),
    )).alias("s")).select("s.*").groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("tp").alias("tp"))
    listed = spark.createDataFrame([(x,) for x in labels], "label string")
    base = F.col("support") + F.col("chosen")
    return listed.join(sides, "label", "left").select(
        "label", F.coalesce("support", zero).alias("support"), F.coalesce("tp", zero).alias("tp"),
        F.when(base > 0, 2 * F.col("tp") / F.when(base > 0, base)).otherwise(0.0).alias("f1"))


def evaluation(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """Macro-F1 over the fixed labels and accuracy over all rows, from one pass."""
    rows = F.sum("support")
    return f1_table(predictions, labels).agg(
        F.avg("f1").alias("macro_f1"),
        F.coalesce(F.sum("tp") / F.nullif(rows, F.lit(0)), F.lit(0.0)).alias("accuracy"),
        rows.alias("rows"))


def edges(bins: int = BINS) -> list[float]:
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def bin_of(confidence: Column, bins: int = BINS) -> Column:
    """Bin whose (lower, upper] holds the confidence, against literal edges; -1 for none."""
    passed = F.lit(-1)
    for lower in edges(bins)[:-1]:
        passed = passed + F.when(confidence > lower, 1).otherwise(0)
    return F.when(confidence <= 1.0, passed).otherwise(-1)


def reliability(predictions: DataFrame, bins: int = BINS) -> DataFrame:
    """Count, mean confidence and accuracy per bin, empty bins as zeros."""
    spark = predictions.sparkSession
    correct = F.when(F.col("truth") == F.col("predicted"), 1.0).otherwise(0.0)
    per_bin = predictions.withColumn("bin", bin_of(F.col("confidence"), bins)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(correct).alias("accuracy"))
    marks = edges(bins)
    every = spark.createDataFrame([(i, marks[i], marks[i + 1]) for i in range(bins)],
                                  "bin int, bin_lower double, bin_upper double")
    return every.join(per_bin, "bin", "left").select(
        "bin", "bin_lower", "bin_upper", F.coalesce("n", F.lit(0)).alias("count"),
        F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"),
        F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def ece(predictions: DataFrame, bins: int = BINS) -> DataFrame:
    """Expected calibration error of the top-class confidence, one row."""
    correct = F.when(F.col("truth") == F.col("predicted"), 1.0).otherwise(0.0)
    per_bin = predictions.withColumn("bin", bin_of(F.col("confidence"), bins)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.avg(correct) - F.avg("confidence")).alias("gap"))
    return per_bin.agg(
        F.coalesce(F.sum(F.when(F.col("bin") >= 0, F.col("n") * F.col("gap"))) / F.sum("n"), F.lit(0.0)).alias("ece"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def feature_means(matrix: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean, std): population std, zero replaced by one."""
    wide = matrix.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in names])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std")) for c in names
    ])).alias("s")).select("s.*")
    return long.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def class_weights(rows: DataFrame, label: str = "traffic_class") -> DataFrame:
    """total / (count * classes) per class."""
    c = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total, k = c.agg(F.sum("n")).scalar(), c.agg(F.count(F.lit(1))).scalar()
    return c.select(label, "n", (total / (F.col("n") * k)).alias("weight"))


def class_distribution(scored: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Mean class probabilities per key over its scored windows, in long form."""
    means = scored.groupBy(*keys).agg(*[
        F.avg(F.get("probabilities", F.lit(i))).alias(f"p{i}") for i in range(len(labels))])
    return means.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(x).alias("traffic_class"), F.col(f"p{i}").alias("p")) for i, x in enumerate(labels)
    ])).alias("d")).select(*keys, "d.*")


def max_per_label(spans: DataFrame, keys: list[str]) -> DataFrame:
    return spans.groupBy(*keys, "label").agg(F.max("probability").alias("probability"))
