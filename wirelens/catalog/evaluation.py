"""Folds, coverage, verification, classifier evaluation, calibration and catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelens import dims
from wirelens.catalog import sqlviews
from wirelens.catalog.registry import query
from wirelens.catalog.traffic import rounded, tagged
from wirelens.functions import scalars
from wirelens.operators import (calibrate, catalogue, dataset, evalm, external, features, flows, panes, verify,
                                windows)
from wirelens.plans import adapters

SALT = "folds"
sqlviews.view("sessions", "", "SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in adapters.SESSION.items())
              + ", n_chars AS start_us FROM documents")
sqlviews.view("split", "sessions", f"""
  SELECT config_name, ['train','calibration','test'][min(f) + 1] AS fold FROM (
    SELECT *, CASE WHEN place <= n_test THEN 2 WHEN place <= n_test + (CASE WHEN n - n_test > 2 THEN greatest(1, CAST(round_even(0.15::DOUBLE * n, 0) AS BIGINT)) ELSE 0 END) THEN 1 ELSE 0 END AS f FROM (
      SELECT *, CASE WHEN n > 2 THEN greatest(1, CAST(round_even(0.2::DOUBLE * n, 0) AS BIGINT)) WHEN n > 1 THEN 1 ELSE 0 END AS n_test FROM (
        SELECT traffic_class, config_name, count(*) OVER (PARTITION BY traffic_class) AS n,
               row_number() OVER (PARTITION BY traffic_class ORDER BY sha256('{SALT}:' || config_name)[1:16], config_name) AS place
        FROM (SELECT DISTINCT traffic_class, config_name FROM sessions)))) GROUP BY config_name""")
sqlviews.view("matrix", "sessions split", "SELECT s.*, p.fold FROM sessions s JOIN split p USING (config_name)")


def matrix_of(spark, sf):
    s = adapters.sessions(spark, sf)
    return dataset.to_matrix(s, dataset.split_configs(s, salt=SALT))


@query("fold_split", "W9", views="split", sql="SELECT config_name, fold FROM split")
def fold_split(spark, sf):
    return dataset.split_configs(adapters.sessions(spark, sf), salt=SALT)


@query("fold_matrix", "J7 P10 P12 S11", views="matrix", sql="""
SELECT doc_id, regexp_replace(session_name, '-r[0-9]+$', '') AS config_name, session_name, traffic_class, fold, start_us FROM matrix""")
def fold_matrix(spark, sf):
    s = dataset.session_configs(adapters.sessions(spark, sf).drop("config_name"))
    return dataset.to_matrix(s, dataset.split_configs(s, salt=SALT))


@query("fold_counts", "A36", views="matrix", sql="""
SELECT fold, count(*) AS windows, count(DISTINCT config_name) AS configs, count(DISTINCT session_name) AS sessions FROM matrix GROUP BY fold""")
def fold_counts(spark, sf):
    return dataset.fold_counts(matrix_of(spark, sf))


@query("fold_overlaps", "U4", views="matrix", sql="""
SELECT 'config_name' AS kind, config_name AS name, count(DISTINCT fold) AS folds FROM matrix GROUP BY config_name HAVING count(DISTINCT fold) > 1
UNION ALL SELECT 'traffic_class', traffic_class, count(DISTINCT fold) FROM matrix GROUP BY traffic_class HAVING count(DISTINCT fold) > 1""")
def fold_overlaps(spark, sf):
    """Configurations never span folds; classes, checked by the same job, do."""
    m = matrix_of(spark, sf)
    return dataset.fold_checks(m.withColumn("session_name", F.col("traffic_class"))).withColumn(
        "kind", F.when(F.col("kind") == "session_name", "traffic_class").otherwise(F.col("kind")))


@query("uncovered_configs", "U4", views="sessions split", sql="""
SELECT DISTINCT session_name AS config_name FROM sessions EXCEPT SELECT config_name FROM split""")
def uncovered_configs(spark, sf):
    """Session names checked as configurations: the repeats are the uncovered ones."""
    s = adapters.sessions(spark, sf)
    return dataset.uncovered_configs(s.withColumn("config_name", F.col("session_name")),
                                     dataset.split_configs(s, salt=SALT))


@query("absent_classes", "A36 U3", sql=f"""
SELECT c.traffic_class, 'no window reached the packet floor' AS reason FROM ({sqlviews.VIEWS['classes'][1]}) c
WHERE traffic_class NOT IN (SELECT DISTINCT CASE source WHEN 'src0' THEN 'web' WHEN 'src1' THEN 'icmp' ELSE 'video' END FROM documents)""")
def absent_classes(spark, sf):
    d = adapters.table(spark, sf, "documents").select(
        F.when(F.col("source") == "src0", "web").when(F.col("source") == "src1", "icmp").otherwise("video").alias("traffic_class"))
    return dataset.absent_classes(d)


@query("comparable_features", "P11 U3", views="features", sql="SELECT capture_id, pair_id, k, start_us, "
       + ", ".join(f for f in dims.FEATURES if f not in dims.NOT_COMPARABLE) + " FROM features")
def comparable_features(spark, sf):
    return rounded(dataset.select_comparable(panes.window_features(tagged(spark, sf), windows.MIN_PACKETS)))


sqlviews.view("labelled", "", "SELECT doc_id, CASE WHEN quality = 1 THEN 'voip' END AS traffic_class FROM labels")


@query("dataset_gaps", "J13", views="sessions labelled", sql="""
WITH s AS (SELECT doc_id, session_name FROM sessions)
SELECT session_name, 'missing capture' AS reason FROM s WHERE doc_id NOT IN (SELECT page_id FROM pages)
UNION ALL SELECT session_name, 'missing labels' FROM s WHERE doc_id NOT IN (SELECT doc_id FROM labelled)
UNION ALL SELECT session_name, 'no traffic class in labels' FROM s WHERE doc_id NOT IN (SELECT doc_id FROM labelled WHERE traffic_class IS NOT NULL)
UNION ALL SELECT session_name, 'no security associations' FROM s WHERE doc_id NOT IN (SELECT conv_id FROM conversations)""")
def dataset_gaps(spark, sf):
    s = adapters.sessions(spark, sf).select("doc_id", "session_name")

    def named(df, key):
        return df.withColumnRenamed(key, "doc_id").join(s, "doc_id")

    labels = adapters.table(spark, sf, "labels").withColumn(
        "traffic_class", F.when(F.col("quality") == 1, "voip"))
    return dataset.dataset_gaps(
        s, named(adapters.table(spark, sf, "pages").select("page_id"), "page_id"), named(labels, "doc_id"),
        named(adapters.table(spark, sf, "conversations").select("conv_id").distinct(), "conv_id"))


DIMS = ["p_brand", "p_type", "band"]


def parts(spark, sf):
    return adapters.table(spark, sf, "part").withColumn("band", F.expr("p_size % 5"))


def expected_values(spark, sf):
    p = parts(spark, sf)
    long = dataset.coverage(p, DIMS).select("dimension", "value")
    return long.unionByName(spark.createDataFrame([("band", "9")], "dimension string, value string"))


sqlviews.view("parts", "", "SELECT *, CAST(p_size % 5 AS VARCHAR) AS band FROM part")
sqlviews.view("values_seen", "parts", """
  SELECT 'p_brand' AS dimension, p_brand AS value FROM parts UNION ALL SELECT 'p_type', p_type FROM parts UNION ALL SELECT 'band', band FROM parts""")


@query("dimension_coverage", "A35", views="values_seen", sql="""
SELECT dimension, value, count(*) AS sessions FROM values_seen GROUP BY dimension, value UNION ALL SELECT 'band', '9', 0""")
def dimension_coverage(spark, sf):
    return dataset.coverage(parts(spark, sf), DIMS, expected_values(spark, sf))


sqlviews.view("pairs_seen", "parts", """
  SELECT 'band' AS left_dim, band AS left_value, 'p_brand' AS right_dim, p_brand AS right_value FROM parts
  UNION ALL SELECT 'band', band, 'p_type', p_type FROM parts UNION ALL SELECT 'p_brand', p_brand, 'p_type', p_type FROM parts""")


@query("pair_coverage", "A35", views="pairs_seen", sql="SELECT *, count(*) AS sessions FROM pairs_seen GROUP BY ALL")
def pair_coverage(spark, sf):
    return dataset.pair_coverage(parts(spark, sf), DIMS)


@query("missing_pairs", "U3 A35", views="values_seen pairs_seen", sql="""
WITH v AS (SELECT DISTINCT * FROM values_seen UNION ALL SELECT 'band', '9')
SELECT a.dimension AS left_dim, a.value AS left_value, b.dimension AS right_dim, b.value AS right_value FROM v a JOIN v b ON a.dimension < b.dimension
EXCEPT SELECT * FROM pairs_seen""")
def missing_pairs(spark, sf):
    return dataset.missing_pairs(parts(spark, sf), DIMS, expected_values(spark, sf))


# --- verification -------------------------------------------------------------
FIELD_SQL = " UNION ALL ".join(
    f"SELECT p_partkey AS session, '{f}' AS field, {i} AS i FROM part" for i, f in enumerate(dims.VERIFIED_FIELDS))
sqlviews.view("verified", "", f"""
  SELECT session, field, CAST(v AS VARCHAR) AS expected, p AS provenance,
         CASE WHEN p = 'unavailable' THEN CASE WHEN u THEN 'honest_gap' ELSE 'not_reported' END WHEN u THEN 'fabricated'
              WHEN p = 'inferred' THEN 'inferred' WHEN same THEN 'match' ELSE 'mismatch' END AS outcome
  FROM (SELECT session, field, (session + i) % 7 AS v, (session + i) % 11 <> 0 AS same, (session * 3 + i) % 5 = 0 AS u,
               CASE (session + i) % 3 WHEN 0 THEN 'observed' WHEN 1 THEN 'inferred' ELSE 'unavailable' END AS p FROM ({FIELD_SQL}))""")


def verified(spark, sf):
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("i")) for i, f in enumerate(dims.VERIFIED_FIELDS)])
    base = adapters.table(spark, sf, "part").select(F.col("p_partkey").alias("session"), F.explode(fields).alias("f")).select("session", "f.*")
    labels = base.selectExpr("session", "field", "cast((session + i) % 7 as string) AS expected", "(session * 3 + i) % 5 = 0 AS unobservable")
    params = base.selectExpr(
        "session", "field", adapters.cycle("session + i", ["'observed'", "'inferred'", "'unavailable'"]) + " AS provenance",
        "CASE WHEN (session + i) % 11 <> 0 THEN cast((session + i) % 7 as string) ELSE 'other' END AS value")
    return verify.verify_sessions(params, labels)


@query("label_verification", "J10 S5", views="verified", sql="SELECT session, field, expected, provenance, outcome FROM verified")
def label_verification(spark, sf):
    return verified(spark, sf).select("session", "field", "expected", "provenance", "outcome")


@query("verification_totals", "A34", views="verified", sql="""
SELECT o AS outcome, (SELECT count(*) FROM verified WHERE outcome = o) AS fields
FROM (SELECT unnest(['match','honest_gap','inferred','mismatch','fabricated','not_reported']) AS o)""")
def verification_totals(spark, sf):
    return verify.verify_totals(verified(spark, sf))


@query("session_verdicts", "A34", views="verified", sql="""
SELECT session, count(*) AS fields, count(*) FILTER (outcome IN ('mismatch','fabricated')) AS failures,
       count(*) FILTER (outcome IN ('mismatch','fabricated')) = 0 AS passed FROM verified GROUP BY session""")
def session_verdicts(spark, sf):
    return verify.session_results(verified(spark, sf))


@query("batch_verdict", "A34", views="verified", sql="""
WITH s AS (SELECT session, count(*) FILTER (outcome IN ('mismatch','fabricated')) AS failures FROM verified GROUP BY session)
SELECT count(*) AS sessions, count(*) FILTER (failures > 0) AS failed, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS unreadable,
       count(*) FILTER (failures > 0) = 0 AND (SELECT count(*) FROM supplier WHERE s_acctbal < 0) = 0 AS passed FROM s""")
def batch_verdict(spark, sf):
    lost = adapters.table(spark, sf, "supplier").filter("s_acctbal < 0")
    return verify.batch_result(verify.session_results(verified(spark, sf)), lost)


# --- classifier evaluation ------------------------------------------------------
sqlviews.view("scored", "", f"""
  SELECT event_id, user_id, event_type AS truth, CASE WHEN event_id % 7 = 0 THEN {adapters.NEXT_TYPE} ELSE event_type END AS predicted,
         0.5::DOUBLE + (event_id % 50) / 100.0::DOUBLE AS confidence FROM events""")
EXTENDED = [*adapters.EVENT_TYPES, "web"]


@query("confusion_counts", "A28", views="scored", sql="SELECT truth, predicted, count(*) AS n FROM scored GROUP BY ALL")
def confusion_counts(spark, sf):
    return evalm.confusion(adapters.event_predictions(spark, sf))


@query("confusion_matrix", "A28", views="scored", sql="SELECT t AS truth, " + ", ".join(
    f"count(*) FILTER (predicted = '{x}') AS \"{x}\"" for x in EXTENDED) + f" FROM (SELECT unnest({EXTENDED}) AS t) LEFT JOIN scored ON truth = t GROUP BY t")
def confusion_matrix(spark, sf):
    return evalm.confusion_matrix(adapters.event_predictions(spark, sf), EXTENDED)


sqlviews.view("f1", "scored", f"""
  SELECT t AS label, count(*) FILTER (truth = t) AS support, count(*) FILTER (truth = t AND predicted = t) AS tp,
         CASE WHEN count(*) FILTER (truth = t) + count(*) FILTER (predicted = t) > 0 THEN
           2 * count(*) FILTER (truth = t AND predicted = t) / (count(*) FILTER (truth = t) + count(*) FILTER (predicted = t))::DOUBLE ELSE 0 END AS f1
  FROM (SELECT unnest({EXTENDED}) AS t) CROSS JOIN scored GROUP BY t""")


@query("class_f1", "A28", views="f1", sql="SELECT label, support, tp, round(f1, 6) AS f1 FROM f1")
def class_f1(spark, sf):
    return rounded(evalm.f1_table(adapters.event_predictions(spark, sf), EXTENDED))


@query("model_evaluation", "A28 S12", views="f1", sql="""
SELECT round(avg(f1), 6) AS macro_f1, round((SELECT avg(CASE WHEN truth = predicted THEN 1.0::DOUBLE ELSE 0 END) FROM scored), 6) AS accuracy,
       (SELECT count(*) FROM scored) AS rows FROM f1""")
def model_evaluation(spark, sf):
    return rounded(evalm.evaluation(adapters.event_predictions(spark, sf), EXTENDED))


EDGES = evalm.edges()
sqlviews.view("bins", "", sqlviews.values([(i, EDGES[i], EDGES[i + 1]) for i in range(10)], "bin, lo, hi"))
sqlviews.view("binned", "scored bins", """
  SELECT b.bin, b.lo::DOUBLE AS lo, b.hi::DOUBLE AS hi, count(s.event_id) AS n, coalesce(avg(confidence), 0) AS conf,
         coalesce(avg(CASE WHEN truth = predicted THEN 1.0::DOUBLE ELSE 0 END) FILTER (s.event_id IS NOT NULL), 0) AS acc
  FROM bins b LEFT JOIN scored s ON s.confidence > b.lo::DOUBLE AND s.confidence <= b.hi::DOUBLE GROUP BY ALL""")


@query("reliability_table", "A27 S12", views="binned", sql="""
SELECT bin, round(lo, 6) AS bin_lower, round(hi, 6) AS bin_upper, n AS count, round(conf, 6) AS mean_confidence, round(acc, 6) AS accuracy FROM binned""")
def reliability_table(spark, sf):
    return rounded(evalm.reliability(adapters.event_predictions(spark, sf)))


@query("calibration_error", "A26", views="binned scored", sql="""
SELECT round(sum(n * abs(acc - conf)) / (SELECT count(*) FROM scored), 6) AS ece, (SELECT count(*) FROM scored) AS rows FROM binned""")
def calibration_error(spark, sf):
    return rounded(evalm.ece(adapters.event_predictions(spark, sf)))


MEANS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("feature_means", "A29", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END, 4) AS std FROM lineitem"
    for c in MEANS))
def feature_means(spark, sf):
    m = evalm.feature_means(adapters.table(spark, sf, "lineitem"), MEANS)
    return m.select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("class_weights", "A40", views="sessions", sql="""
WITH c AS (SELECT traffic_class, count(*) AS n FROM sessions GROUP BY traffic_class)
SELECT traffic_class, n, round((SELECT sum(n) FROM c)::DOUBLE / (n * (SELECT count(*) FROM c)), 6) AS weight FROM c""")
def class_weights(spark, sf):
    return rounded(evalm.class_weights(adapters.sessions(spark, sf)))


PROBS = "array((event_id % 10) / 20D, 0.5D, 0.5D - (event_id % 10) / 20D)"


@query("class_distribution", "A32", sql="""
WITH m AS (SELECT user_id, avg((event_id % 10) / 20.0::DOUBLE) AS p0, avg(0.5::DOUBLE) AS p1, avg(0.5::DOUBLE - (event_id % 10) / 20.0::DOUBLE) AS p2 FROM events GROUP BY user_id)
SELECT user_id, 'a' AS traffic_class, round(p0, 6) AS p FROM m UNION ALL SELECT user_id, 'b', round(p1, 6) FROM m UNION ALL SELECT user_id, 'c', round(p2, 6) FROM m""")
def class_distribution(spark, sf):
    s = adapters.table(spark, sf, "events").selectExpr("user_id", f"{PROBS} AS probabilities")
    return rounded(evalm.class_distribution(s, ["user_id"], ["a", "b", "c"]))


@query("max_probability_per_label", "A33", views="scored", sql="""
SELECT user_id, predicted AS label, round(max(confidence), 6) AS probability FROM scored GROUP BY user_id, predicted""")
def max_probability_per_label(spark, sf):
    p = adapters.event_predictions(spark, sf).withColumnsRenamed({"predicted": "label", "confidence": "probability"})
    return rounded(evalm.max_per_label(p, ["user_id"]))


sqlviews.view("window_predictions", "window_counts", """
  SELECT capture_id, pair_id, start_us, end_us, packets % 3 AS label, (packets % 100) / 100.0::DOUBLE AS probability FROM window_counts WHERE packets >= 20""")


@query("prediction_spans", "W5", views="window_predictions", sql="""
WITH a AS (SELECT *, CASE WHEN lag(label) OVER w = label AND lag(end_us) OVER w >= start_us THEN 0 ELSE 1 END AS fresh
           FROM window_predictions WINDOW w AS (PARTITION BY capture_id, pair_id ORDER BY start_us)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY capture_id, pair_id ORDER BY start_us) AS span_no FROM a)
SELECT capture_id, pair_id, CAST(span_no AS BIGINT) AS span_no, CAST(any_value(label) AS VARCHAR) AS label, round(min(probability), 6) AS probability,
       min(start_us) AS window_start_us, max(end_us) AS window_end_us, count(*) AS windows, CAST(min(start_us) AS VARCHAR) AS top_features
FROM b GROUP BY capture_id, pair_id, span_no""")
def prediction_spans(spark, sf):
    w = windows.scorable(windows.window_counts(tagged(spark, sf)))
    p = w.select("capture_id", "pair_id", "start_us", "end_us", F.expr("cast(packets % 3 as string)").alias("label"),
                 F.expr("packets % 100 / 100D").alias("probability"), F.col("start_us").cast("string").alias("top_features"))
    return rounded(windows.merge_spans(p))


# --- calibration --------------------------------------------------------------
KNOTS = [{"x": [0.0, 0.2, 0.45], "y": [0.0, 0.4, 0.6]}, {"x": [0.1, 0.6], "y": [0.0, 0.5]}, {"x": [0.0, 1.0], "y": [0.0, 1.0]}]
P0, P2 = "((event_id % 10) / 20.0::DOUBLE)", "(0.5::DOUBLE - (event_id % 10) / 20.0::DOUBLE)"


@query("calibrated_probabilities", "P38", sql=f"""
WITH c AS (SELECT event_id, CASE WHEN {P0} >= 0.45 THEN 0.6 WHEN {P0} >= 0.2 THEN 0.4 + 0.2 * ({P0} - 0.2) / 0.25 ELSE 0.4 * {P0} / 0.2 END AS a,
             0.5::DOUBLE * (0.5 - 0.1) / 0.5 AS b, {P2} AS c FROM events)
SELECT event_id, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM c""")
def calibrated_probabilities(spark, sf):
    s = adapters.table(spark, sf, "events").selectExpr("event_id", f"{PROBS} AS probabilities")
    c = calibrate.apply_knots(s, calibrate.knot_table(spark, KNOTS))
    return rounded(c.select("event_id", *[F.get("probabilities", F.lit(i)).alias(f"p{i}") for i in range(3)]))


def logits(spark, sf):
    return adapters.table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double") * 10.0).alias("logits"), "label")


@query("tempered_softmax", "M7", sql="""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * 10.0) AS l FROM embeddings),
p AS (SELECT vec_id, l, list_transform(l, lambda v: exp((v - list_max(l)) / 2.0::DOUBLE)) AS z FROM e)
SELECT vec_id, round(list_max(z) / list_sum(z), 6) AS top, list_position(l, list_max(l)) AS place, round(z[1] / list_sum(z), 6) AS p_first FROM p""")
def tempered_softmax(spark, sf):
    p = calibrate.apply_temperature(logits(spark, sf), 2.0)
    return rounded(p.select("vec_id", F.array_max("probabilities").alias("top"),
                            F.expr("array_position(logits, array_max(logits))").alias("place"),
                            F.get("probabilities", F.lit(0)).alias("p_first")))


LOG_TS = [-2.0, -1.0, 0.0, 1.0, 2.0]


@query("temperature_losses", "M6", sql="""
WITH e AS (SELECT label, list_transform(embedding, lambda v: v::DOUBLE * 10.0) AS l FROM embeddings),
g AS (SELECT unnest([-2.0, -1.0, 0.0, 1.0, 2.0])::DOUBLE AS log_t)
SELECT log_t, round(sum(ln(list_sum(list_transform(l, lambda v: exp((v - list_max(l)) / exp(log_t))))) - (l[label + 1] - list_max(l)) / exp(log_t)), 4) AS nll
FROM e CROSS JOIN g GROUP BY log_t""")
def temperature_losses(spark, sf):
    n = calibrate.nll_by_temperature(logits(spark, sf), LOG_TS)
    return n.select("log_t", F.round("nll", 4).alias("nll"))


@query("fitted_temperature", "M6")
def fitted_temperature(spark, sf):
    """The fitted scalar with the loss it reaches on the fold."""
    import math

    df = logits(spark, sf)
    t = calibrate.fit_temperature(df)
    return calibrate.nll_by_temperature(df, [math.log(t)]).withColumn("temperature", F.exp("log_t"))


# The largest over all starts of the smallest over all ends of the mean in between.
ISOTONIC = """
WITH c AS (SELECT unnest(TYPES) AS cls),
e AS (SELECT event_type AS truth, CASE WHEN event_id % 7 = 0 THEN NEXT ELSE event_type END AS predicted, EXACT FROM events),
s AS (SELECT cls, CASE WHEN predicted = cls THEN confidence ELSE (1 - confidence) / DIVISOR END AS x, truth = cls AS hit FROM e, c),
g AS (SELECT cls, x, count(*) FILTER (hit) AS hits, count(*) AS weight FROM s GROUP BY cls, x),
n AS (SELECT *, sum(hits) OVER w AS upto_hits, sum(weight) OVER w AS upto_weight FROM g WINDOW w AS (PARTITION BY cls ORDER BY x)),
p AS (SELECT b.cls, b.x, min((d.upto_hits - a.upto_hits + a.hits)::DOUBLE / (d.upto_weight - a.upto_weight + a.weight)) AS low
      FROM n b JOIN n a ON a.cls = b.cls AND a.x <= b.x JOIN n d ON d.cls = b.cls AND d.x >= b.x GROUP BY b.cls, b.x, a.x),
f AS (SELECT cls, x, max(low) AS y FROM p GROUP BY cls, x),
k AS (SELECT cls, y, min(x) AS x0, max(x) AS x1 FROM f GROUP BY cls, y)
SELECT cls AS label, round(x0, 9) AS x, round(y, 9) AS y FROM k UNION SELECT cls, round(x1, 9), round(y, 9) FROM k"""


def _isotonic(exact: str, divisor: str) -> str:
    kinds = "[" + ", ".join(repr(t) for t in adapters.EVENT_TYPES) + "]"
    return ISOTONIC.replace("TYPES", kinds).replace("NEXT", adapters.NEXT_TYPE).replace("EXACT", exact).replace("DIVISOR", divisor)


def _knots(spark, sf, confidence: str, at_once: int):
    codes = dims.lookup({t: i for i, t in enumerate(adapters.EVENT_TYPES)}, F.col("truth")).cast("int")
    picked = dims.lookup({t: i for i, t in enumerate(adapters.EVENT_TYPES)}, F.col("predicted")).cast("int")
    p = adapters.event_predictions(spark, sf).withColumn("confidence", F.expr(confidence))
    probs = F.array(*[F.when(picked == i, F.col("confidence")).otherwise((1 - F.col("confidence")) / 4) for i in range(5)])
    knots = calibrate.fit_isotonic(p.select(codes.alias("label"), probs.alias("probabilities")), 5, at_once)
    names = F.array(*[F.lit(t) for t in adapters.EVENT_TYPES])
    return knots.select(F.get(names, F.col("cls")).alias("label"), F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("isotonic_knots", "M5", sql=_isotonic("0.5 + (event_id % 50) / 100.0::DOUBLE AS confidence", "4.0::DOUBLE"))
def isotonic_knots(spark, sf):
    """Monotone fit per class over the events' scores, as knot rows."""
    return _knots(spark, sf, "confidence", calibrate.POOLED)


@query("isotonic_knots_in_ranges", "M5", sql=_isotonic("0.5 + (event_id * 37 % 151) / 400.0::DOUBLE AS confidence", "4.0::DOUBLE"))
def isotonic_knots_in_ranges(spark, sf):
    """The same over finer scores, pooled in many small ranges whose borders have to be mended."""
    return _knots(spark, sf, "0.5D + (event_id * 37 % 151) / 400D", 50)


# --- external corpora ------------------------------------------------------------
STEM_SQL = adapters.cycle("doc_id", [f"'{s}'" for s in adapters.FILE_STEMS])
sqlviews.view("file_names", "", f"""
  SELECT doc_id, '/data/' || source || '/' || ({STEM_SQL}) || doc_id || '.pcap' AS name, ({STEM_SQL}) || doc_id AS stem,
         n_chars % 5 AS flows, n_chars % 11 = 0 AS unreadable FROM documents""")
sqlviews.view("named_files", "file_names", "SELECT *, CASE " + " ".join(
    f"WHEN regexp_matches(lower(stem), '{p}') THEN '{c}'" for p, c in dims.NAME_LABELS)
    + " END AS label, regexp_matches(stem, '(?i)^vpn[_-]') AS tunnelled FROM file_names")


@query("file_name_labels", "P8 P9", views="named_files", sql="SELECT doc_id, name, coalesce(label, '') AS label, tunnelled FROM named_files")
def file_name_labels(spark, sf):
    n = external.name_labels(adapters.file_names(spark, sf))
    return n.select("doc_id", "name", F.coalesce("label", F.lit("")).alias("label"), "tunnelled")


VOCABULARY = [c for c in dims.TRAFFIC_CLASSES if c != "icmp"]


@query("corpus_gap_report", "A37", views="named_files", sql=f"""
SELECT count(*) FILTER (unreadable) AS unreadable, count(*) FILTER (NOT unreadable AND flows = 0) AS empty,
       count(*) FILTER (NOT unreadable AND flows > 0 AND label IS NULL) AS unmapped,
       CAST(coalesce(sum(flows) FILTER (NOT unreadable AND label NOT IN ({', '.join(repr(v) for v in VOCABULARY)})), 0) AS BIGINT) AS labels_not_in_model,
       CAST(coalesce(sum(flows) FILTER (NOT unreadable AND label IN ({', '.join(repr(v) for v in VOCABULARY)})), 0) AS BIGINT) AS scorable FROM named_files""")
def corpus_gap_report(spark, sf):
    return external.gap_report(external.name_labels(adapters.file_names(spark, sf)), VOCABULARY)


@query("address_pair_ids", "P7", views="packets", sql="""
SELECT DISTINCT src, dst, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(src || '>' || dst, ''), lambda c: ascii(c)::BIGINT)),
       lambda a, b: (a * 131 + b) & 4294967295) AS pair_hash FROM packets""")
def address_pair_ids(spark, sf):
    p = adapters.packets(spark, sf).select("src", "dst").distinct()
    return p.withColumn("pair_hash", scalars.address_pair_id(F.col("src"), F.col("dst")))


sqlviews.view("ext_pairs", "packets", """
  SELECT capture_id, min(idx) AS pair_id, arg_min(src, idx) AS fs, arg_min(dst, idx) AS fd, count(DISTINCT src) > 1 AS paired, count(*) AS packets
  FROM packets GROUP BY capture_id, least(src, dst), greatest(src, dst) HAVING count(*) >= 8""")


@query("external_pairs", "M12 W10", views="ext_pairs", sql="SELECT capture_id, pair_id, fs AS src, fd AS dst, paired, packets FROM ext_pairs")
def external_pairs(spark, sf):
    p = external.external_pairs(adapters.packets(spark, sf))
    return p.select("capture_id", "pair_id", F.col("fwd.src").alias("src"), F.col("fwd.dst").alias("dst"), "paired", "packets")


sqlviews.view("ext_lists", "packets ext_pairs", """
  SELECT capture_id, pair_id, bool_or(paired) AS paired, min(ts_us) AS lo, max(ts_us) AS hi, list_sort(list(len)) AS lens,
         list_sort(coalesce(list(gap_us) FILTER (gap_us IS NOT NULL), [])) AS gaps,
         list_sort(coalesce(list(len) FILTER (up), [])) AS ups, list_sort(coalesce(list(len) FILTER (NOT up), [])) AS downs
  FROM (SELECT p.capture_id, e.pair_id, e.paired, ts_us, ip_payload_len AS len, p.src = e.fs AS up,
               ts_us - lag(ts_us) OVER (PARTITION BY p.capture_id, e.pair_id ORDER BY ts_us, idx) AS gap_us
        FROM packets p JOIN ext_pairs e ON e.capture_id = p.capture_id AND least(p.src, p.dst) = least(e.fs, e.fd) AND greatest(p.src, p.dst) = greatest(e.fs, e.fd))
  GROUP BY capture_id, pair_id""")


@query("external_flow_features", "M12 P6 W10", views="ext_lists",
       sql="SELECT capture_id, pair_id,\n  " + sqlviews.feature_columns("ext_lists") + "\nFROM ext_lists")
def external_flow_features(spark, sf):
    p = adapters.packets(spark, sf)
    return rounded(features.pair_features(external.tag_external(p, external.external_pairs(p))))


# --- mode features -----------------------------------------------------------------
@query("session_geometry", "A31 P37", views="tagged", sql="""
WITH h AS (SELECT capture_id, pair_id, esp_len, count(*) AS c FROM tagged WHERE esp_len IS NOT NULL GROUP BY ALL)
SELECT capture_id, pair_id, 4 AS ip_version, min(esp_len) AS min_len, max(esp_len) AS max_len, arg_max(esp_len, c * 100000 - esp_len) AS modal_len
FROM h GROUP BY capture_id, pair_id""")
def session_geometry(spark, sf):
    return features.session_geometry(tagged(spark, sf))


def capture_distribution(pairs):
    return pairs.select("capture_id", "pair_id", F.explode(F.expr(
        "array(struct('web' AS traffic_class, 0.5D AS p), struct('voip' AS traffic_class, capture_id / 10D AS p), struct('icmp' AS traffic_class, 0.2D AS p))")).alias("d")
    ).select("capture_id", "pair_id", "d.*")


BASELINE = [("web", 4, 60.0, 1400.0), ("voip", 4, 120.0, 136.0), ("web", 6, 80.0, 1380.0)]


@query("mode_features", "A31 J12 P37", views="tagged packets pairs", sql="""
WITH h AS (SELECT capture_id, pair_id, esp_len, count(*) AS c FROM tagged WHERE esp_len IS NOT NULL GROUP BY ALL),
g AS (SELECT capture_id, pair_id, min(esp_len) AS lo, max(esp_len) AS hi, arg_max(esp_len, c * 100000 - esp_len) AS modal FROM h GROUP BY ALL),
c AS (SELECT capture_id, count(DISTINCT (src, spi)) FILTER (spi IS NOT NULL) AS spis, avg(CASE WHEN proto = 'other' THEN 1.0::DOUBLE ELSE 0 END) AS clear FROM packets GROUP BY capture_id)
SELECT g.capture_id, g.pair_id, round(hi / 1500.0::DOUBLE, 6) AS max_len_over_mtu, round(spis / 2.0::DOUBLE, 6) AS spi_pairs_per_endpoint,
       round(clear, 6) AS cleartext_ratio,
       round(modal - (1400 * 0.5::DOUBLE + 136 * (g.capture_id / 10.0::DOUBLE)) / (0.5::DOUBLE + g.capture_id / 10.0::DOUBLE), 6) AS modal_len_offset,
       round(lo - (60 * 0.5::DOUBLE + 120 * (g.capture_id / 10.0::DOUBLE)) / (0.5::DOUBLE + g.capture_id / 10.0::DOUBLE), 6) AS min_len_offset,
       20.0::DOUBLE AS inner_header_bytes FROM g JOIN c USING (capture_id)""")
def mode_features(spark, sf):
    p = adapters.packets(spark, sf)
    pairs, t = flows.pair_and_tag(p)
    base = spark.createDataFrame(BASELINE, "traffic_class string, ip_version int, base_min double, base_modal double")
    return rounded(features.mode_classifier_features(t, p, capture_distribution(pairs), base))


# --- catalogue ----------------------------------------------------------------------
MAGIC_SQL = adapters.cycle("length(text)", [f"'{m}'" for m in adapters.MAGIC_CYCLE])
sqlviews.view("contents", "", f"""
  SELECT 'f' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, {MAGIC_SQL} AS magic, unhex({MAGIC_SQL}) || encode(text) AS content FROM documents""")


@query("capture_catalogue", "S8", views="contents", sql="""
SELECT sha256(content) AS sha256, min(path) AS path, any_value(octet_length(content)) AS size_bytes, any_value(magic) AS magic
FROM contents WHERE magic <> '00000000' GROUP BY sha256(content)""")
def capture_catalogue(spark, sf):
    return catalogue.register_captures(adapters.contents(spark, sf))


@query("capture_catalogue_increment", "S8", views="contents", sql="""
SELECT sha256(content) AS sha256, min(path) AS path, any_value(octet_length(content)) AS size_bytes, any_value(magic) AS magic
FROM contents WHERE magic NOT IN ('00000000', 'a1b2c3d4') GROUP BY sha256(content)""")
def capture_catalogue_increment(spark, sf):
    """A second load against a catalogue that already holds one kind of file."""
    known = catalogue.register_captures(adapters.contents(spark, sf)).filter("magic = 'a1b2c3d4'")
    return catalogue.register_captures(adapters.contents(spark, sf), known)


@query("artefact_versions", "P39", views="contents", sql="SELECT path, sha256(content)[1:16] AS version FROM contents")
def artefact_versions(spark, sf):
    return catalogue.artefact_versions(adapters.contents(spark, sf))


@query("capture_page", "O4", sql="""
SELECT *, (SELECT count(*) FROM customer) AS total FROM (SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 50 OFFSET 20)""")
def capture_page(spark, sf):
    return catalogue.page(adapters.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 50, 20)


sqlviews.view("outcome_log", "", """
  SELECT 's' || (event_id % 500) AS name, event_id AS finished_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
         user_id AS packet_count, value AS duration_s, CASE WHEN event_type = 'error' THEN repeat(props, 300) ELSE '' END AS error FROM events""")


def outcome_log(spark, sf):
    return adapters.table(spark, sf, "events").selectExpr(
        "concat('s', event_id % 500) AS name", "event_id AS finished_at",
        "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status", "user_id AS packet_count",
        "value AS duration_s", "CASE WHEN event_type = 'error' THEN repeat(props, 300) ELSE '' END AS error")


@query("outcome_manifest", "S14 W11", views="outcome_log", sql="""
SELECT name, count(*) AS attempts, arg_max(status, finished_at) AS status, arg_max(packet_count, finished_at) AS packet_count,
       round(arg_max(duration_s, finished_at), 1) AS duration_s, substr(arg_max(error, finished_at), 1, 2000) AS error, max(finished_at) AS finished_at
FROM outcome_log GROUP BY name""")
def outcome_manifest(spark, sf):
    return catalogue.record_outcomes(outcome_log(spark, sf))


@query("pending_sessions", "S13", views="outcome_log", sql="""
WITH m AS (SELECT name, arg_max(status, finished_at) AS status FROM outcome_log GROUP BY name)
SELECT 's' || c_custkey AS name FROM customer WHERE 's' || c_custkey NOT IN (
  SELECT name FROM m WHERE status = 'completed' AND name IN (SELECT 's' || doc_id FROM documents))""")
def pending_sessions(spark, sf):
    s = adapters.table(spark, sf, "customer").selectExpr("concat('s', c_custkey) AS name")
    f = adapters.table(spark, sf, "documents").selectExpr("concat('s', doc_id) AS name")
    return catalogue.pending(s, catalogue.record_outcomes(outcome_log(spark, sf)), f)
