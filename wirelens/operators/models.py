"""Classifiers on feature tables, their calibration, scoring and explanation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.functions import attrs
from wirelens.operators import boosting, calibrate, dataset, evalm, external, network, windows
from wirelens.session import materialise

SEED = 20260906
NO_MODEL = "no classifier is installed"


@dataclass
class TrafficModel:
    """A fitted pipeline, or boosted trees, with its label order, inputs, calibration and training means."""

    pipeline: PipelineModel | boosting.Trees | network.Network
    labels: list[str]
    names: list[str]
    kind: str
    knots: DataFrame | None = None
    temperature: float = 1.0
    means: dict[str, float] = field(default_factory=dict)


def vocabulary(matrix: DataFrame) -> list[str]:
    """Sorted class labels; at most the seven known classes."""
    return sorted(r["traffic_class"] for r in matrix.select("traffic_class").distinct().collect())


def _indexer(labels: list[str]) -> StringIndexerModel:
    return StringIndexerModel.from_labels(labels, inputCol="traffic_class", outputCol="label", handleInvalid="skip")


def training_means(matrix: DataFrame, names: list[str]) -> dict[str, float]:
    """Mean per feature: one row with as many values as features."""
    return {r["feature"]: r["mean"] for r in evalm.feature_means(matrix, names).collect()}


def train_traffic(train: DataFrame, labels: list[str], names: list[str] | None = None, kind: str = "boosted",
                  shape: boosting.Shape = boosting.Shape(), trees: int = 20, depth: int = 5) -> TrafficModel:
    """Multi-class tree model over the tabular features: softmax boosting, or a ``forest`` of so many trees."""
    names = names or dims.FEATURES
    rows = _indexer(labels).transform(train)
    if kind == "boosted":
        fitted = boosting.fit(rows, len(labels), names, shape)
    else:
        learner = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED)
        fitted = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), learner]).fit(rows)
    return TrafficModel(fitted, labels, names, kind, means=training_means(train, names))


def train_sequence(train: DataFrame, labels: list[str], names: list[str] | None = None, hidden: int = 32,
                   steps: int = 60) -> TrafficModel:
    """Convolutional network over the 128-slot sequence and the tabular features, classes weighted exactly."""
    names = names or dims.FEATURES
    rows = _indexer(labels).transform(train)
    fitted = network.fit(rows, len(labels), names, network.Layers(hidden=hidden, steps=steps))
    return TrafficModel(fitted, labels, names, "network", means=training_means(train, names))


def raw_scores(model: TrafficModel, rows: DataFrame) -> DataFrame:
    """Add ``logits`` and uncalibrated ``probabilities`` arrays in label order."""
    if model.kind == "boosted":
        found = rows.withColumn("logits", boosting.logits(model.pipeline, F.array(*[F.col(n).cast("double") for n in model.names])))
        return found.withColumn("probabilities", calibrate.softmax(F.col("logits")))
    if model.kind == "network":
        found = rows.withColumn("logits", network.logits(model.pipeline, F.array(*[F.col(n).cast("double") for n in model.names]), F.col("seq")))
        return found.withColumn("probabilities", calibrate.softmax(F.col("logits")))
    out = model.pipeline.transform(rows).withColumn("logits", vector_to_array("rawPrediction"))
    out = out.withColumn("probabilities", vector_to_array("probability"))
    drop = [c for c in ("features", "raw", "rawPrediction", "probability", "prediction") if c in out.columns]
    return out.drop(*drop)


def score(model: TrafficModel, rows: DataFrame) -> DataFrame:
    """Calibrated probabilities, top class and its confidence."""
    out = raw_scores(model, rows)
    if model.kind == "network":
        out = calibrate.apply_temperature(out, model.temperature)
    else:
        out = calibrate.apply_knots(out, model.knots)
    names = F.array(*[F.lit(x) for x in model.labels])
    return out.withColumn("confidence", F.array_max("probabilities")).withColumn(
        "predicted", F.get(names, (F.array_position("probabilities", F.col("confidence")) - 1).cast("int")))


def fit_calibration(model: TrafficModel, fold: DataFrame) -> TrafficModel:
    """Isotonic knots for tree models, a temperature for the network."""
    scored = raw_scores(model, _indexer(model.labels).transform(fold))
    scored = materialise(scored.select(F.col("label").cast("int").alias("label"), "logits", "probabilities"))
    if model.kind == "network":
        model.temperature = calibrate.fit_temperature(scored)
    else:
        model.knots = calibrate.fit_isotonic(scored, len(model.labels))
    return model


def score_windows(model: TrafficModel | None, matrix: DataFrame, explain: bool = False) -> DataFrame:
    """Spans of equal predictions per pair; labels outside the known classes are dropped.

    Without a model the result is empty and typed, which is not the same as "no
    classifiable traffic".
    """
    if model is None:
        return no_predictions(matrix.sparkSession)
    scored = score(model, matrix).filter(F.col("predicted").isin(*dims.TRAFFIC_CLASSES))
    rows = scored.select(
        "capture_id", "pair_id", "k", "start_us", (F.col("start_us") + windows.WINDOW_US).alias("end_us"),
        F.col("predicted").alias("label"), F.col("confidence").alias("probability"))
    rows = rows.withColumn("top_features", F.array().cast(
        "array<struct<feature:string,contribution:double,observed_value:double>>"))
    spans = windows.merge_spans(materialise(rows.drop("k")))
    if not explain:
        return spans
    # Only the first window of each span is explained.
    spans = materialise(spans)
    at = ["capture_id", "pair_id", "start_us"]
    first = spans.select("capture_id", "pair_id", F.col("window_start_us").alias("start_us"))
    heads = matrix.join(first, at, "left_semi")
    top = attribution(model, heads).join(heads.select(*at, "k"), ["capture_id", "pair_id", "k"])
    top = top.withColumnRenamed("start_us", "window_start_us").drop("k")
    return spans.drop("top_features").join(top, ["capture_id", "pair_id", "window_start_us"], "left").select(*spans.columns)


def no_predictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], (
        "capture_id bigint, pair_id bigint, span_no bigint, label string, probability double, window_start_us bigint, "
        "window_end_us bigint, windows bigint, top_features array<struct<feature:string,contribution:double,observed_value:double>>"))


def mode_unavailable(sas: DataFrame) -> DataFrame:
    return sas.withColumn("operating_mode", attrs.unavailable(NO_MODEL, "string"))


def attribution(model: TrafficModel, matrix: DataFrame, top: int = 5) -> DataFrame:
    """(capture_id, pair_id, k, top_features): exact for boosted trees, else by occlusion."""
    if model.kind != "boosted":
        return occlusion_attribution(model, matrix, top)
    return tree_attribution(model, matrix, top)


def tree_attribution(model: TrafficModel, matrix: DataFrame, top: int = 5) -> DataFrame:
    """The features with the largest Shapley values for the score of the predicted class, in one pass over the windows."""
    scored = score(model, matrix)
    cls = (F.array_position("probabilities", F.col("confidence")) - 1).cast("int")
    values = F.array(*[F.col(n).cast("double") for n in model.names])
    return scored.select("capture_id", "pair_id", "k", boosting.attributions(model.pipeline, values, cls, top).alias("top_features"))


def occlusion_attribution(model: TrafficModel, matrix: DataFrame, top: int = 5) -> DataFrame:
    """The features whose replacement by the training mean moves the top class most.

    Each window is scored once per feature, so give it the windows to explain
    (usually the first of each span), not a whole matrix. The rank limit runs
    before the shuffle as well.
    """
    keys = ["capture_id", "pair_id", "k"]
    base = score(model, matrix)
    base = base.withColumn("_top", (F.array_position("probabilities", F.col("confidence")) - 1).cast("int"))
    means = F.array(*[F.lit(float(model.means[n])) for n in model.names])
    keep = [c for c in ("seq",) if c in matrix.columns]
    probe = base.select(
        *keys, *keep, "_top", F.get("probabilities", F.col("_top")).alias("_p"),
        F.array(*model.names).alias("_x"),
    ).select("*", F.posexplode("_x").alias("_i", "_value"))
    changed = F.transform("_x", lambda v, j: F.when(j == F.col("_i"), F.get(means, F.col("_i"))).otherwise(v))
    probe = probe.withColumn("_x", changed).select(
        *keys, *keep, "_top", "_p", "_i", "_value", *[F.get("_x", F.lit(j)).alias(n) for j, n in enumerate(model.names)])
    again = score(model, probe)
    names = F.array(*[F.lit(n) for n in model.names])
    parts = again.select(
        *keys, F.get(names, F.col("_i")).alias("feature"),
        (F.col("_p") - F.get("probabilities", F.col("_top"))).alias("contribution"), F.col("_value").alias("observed_value"))
    w = Window.partitionBy(*keys).orderBy(F.abs("contribution").desc(), "feature")
    best = parts.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= top)
    return best.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_rank", "feature", "contribution", "observed_value"))),
        lambda s: F.struct(s["feature"].alias("feature"), s["contribution"].alias("contribution"),
                           s["observed_value"].alias("observed_value"))).alias("top_features"))


def top_contributions(rows: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """The largest contributions by absolute value per key."""
    w = Window.partitionBy(*keys).orderBy(F.abs("contribution").desc(), "feature")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


# --- tunnel or transport ---------------------------------------------------------

@dataclass
class ModeModel:
    pipeline: PipelineModel
    baseline: DataFrame
    labels: tuple[str, str] = ("transport", "tunnel")


def fit_mode_baseline(sessions: DataFrame) -> DataFrame:
    """Median lengths per class and IP version of transport sessions outside the test fold.

    ``sessions``: traffic_class, ip_version, min_len, modal_len, mode, fold.
    """
    rows = sessions.filter((F.col("mode") == "transport") & (F.col("fold") != "test"))
    return rows.groupBy("traffic_class", "ip_version").agg(
        F.percentile("min_len", F.lit(0.5)).alias("base_min"), F.percentile("modal_len", F.lit(0.5)).alias("base_modal"))


def train_mode(rows: DataFrame, baseline: DataFrame, trees: int = 20) -> ModeModel:
    """Binary model over the six mode features, kept together with its baseline."""
    labelled = rows.withColumn("label", F.when(F.col("mode") == "tunnel", 1.0).otherwise(0.0))
    fitted = Pipeline(stages=[
        VectorAssembler(inputCols=dims.MODE_FEATURES, outputCol="features"),
        GBTClassifier(maxIter=trees, maxDepth=4, seed=SEED),
    ]).fit(labelled)
    return ModeModel(fitted, baseline)


def predict_mode(model: ModeModel, rows: DataFrame) -> DataFrame:
    """``operating_mode`` with its confidence and the six features as evidence."""
    p = F.get(vector_to_array("probability"), F.lit(1))
    tunnel = F.col("_p") >= 0.5
    value = F.when(tunnel, model.labels[1]).otherwise(model.labels[0])
    proof = attrs.evidence("mode_classifier", measured={n: F.col(n) for n in dims.MODE_FEATURES})
    scored = model.pipeline.transform(rows).withColumn("_p", p)
    fact = attrs.inferred(value, "string", F.when(tunnel, F.col("_p")).otherwise(1 - F.col("_p")), proof,
                          "inferred from encapsulation overhead; the traffic class is one input")
    return scored.withColumn("operating_mode", fact).drop("features", "rawPrediction", "probability", "prediction", "_p")


# --- runs --------------------------------------------------------------------------

def evaluate_rows(scored: DataFrame, labels: list[str], model: str) -> DataFrame:
    """Macro-F1, accuracy and calibration error of one scored fold, in long form."""
    rows = scored.select(F.col("traffic_class").alias("truth"), "predicted", "confidence")
    def long(one_row: DataFrame, names: list[str]) -> DataFrame:
        return one_row.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "metric", "value")

    metrics = long(evalm.evaluation(rows, labels), ["macro_f1", "accuracy", "rows"]).unionByName(
        long(evalm.ece(rows), ["ece"]))
    return metrics.select(F.lit(model).alias("model"), "metric", "value")


def train_all(matrix: DataFrame, kind: str = "boosted", sequence: bool = True) -> tuple[dict[str, TrafficModel], DataFrame]:
    """Fit on train, calibrate on calibration, evaluate on test; metrics as a table.

    ``matrix`` carries fold, traffic_class, the features and ``seq``; it is
    materialised once because every stage reads it.
    """
    matrix = materialise(matrix)
    labels = vocabulary(matrix)
    folds = {f: matrix.filter(F.col("fold") == f) for f in dataset.FOLDS}
    fitted = {"traffic": train_traffic(folds["train"], labels, kind=kind)}
    if sequence:
        fitted["sequence"] = train_sequence(folds["train"], labels)
    metrics = None
    for name, model in fitted.items():
        fit_calibration(model, folds["calibration"])
        rows = evaluate_rows(score(model, folds["test"]), labels, name)
        metrics = rows if metrics is None else metrics.unionByName(rows)
    return fitted, metrics


def score_external(model: TrafficModel, flows: DataFrame, tunnelled_only: bool = False) -> DataFrame:
    """External flows scored with their padding features held at the training means."""
    kept = external.scorable_flows(flows, model.labels, tunnelled_only)
    rows = external.substitute_means(kept, model.means)
    return score(model, rows)


def generalisation_gap(internal: DataFrame, scored: DataFrame, labels: list[str]) -> DataFrame:
    """Internal and external macro-F1 side by side with their difference."""
    rows = scored.select(F.col("label").alias("truth"), "predicted", "confidence")
    own = internal.filter((F.col("model") == "traffic") & (F.col("metric") == "macro_f1")).agg(F.max("value")).scalar()
    return evalm.evaluation(rows, labels).select(
        own.alias("internal_macro_f1"), F.col("macro_f1").alias("external_macro_f1"), F.col("rows").alias("flows"),
        (own - F.col("macro_f1")).alias("gap"))
