"""Model training, scoring and explanation over the window matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelens import dims
from wirelens.catalog import sqlviews
from wirelens.catalog.registry import query
from wirelens.catalog.traffic import rounded, tagged
from wirelens.operators import dataset, external, features, models, panes, windows
from wirelens.plans import adapters
from wirelens.session import materialise

CLASS_OF_CAPTURE = {0: "web", 1: "file_transfer", 2: "voip", 3: "email", 4: "video"}


def window_matrix(spark, sf):
    """Scorable windows with features and sequence; five-window stretches are the configurations."""
    t = materialise(tagged(spark, sf))
    heads = windows.sequence_vector(windows.assign_windows(windows.pane_heads(t)))
    m = panes.window_features(t, windows.MIN_PACKETS).join(heads, windows.WINDOW_KEYS)
    m = m.withColumns({
        "traffic_class": dims.lookup(CLASS_OF_CAPTURE, F.col("capture_id")),
        "config_name": F.concat_ws("-", "capture_id", "pair_id", F.expr("k div 5")),
        "session_name": F.concat_ws("-", "capture_id", "pair_id"),
    })
    return dataset.to_matrix(m, dataset.split_configs(m, salt="matrix"))


@query("model_metrics", "M1 M2 M4 M13 S12")
def model_metrics(spark, sf):
    """Both classifiers trained, calibrated and evaluated on held-out configurations."""
    return rounded(models.train_all(window_matrix(spark, sf))[1])


def trained(spark, sf):
    m = materialise(window_matrix(spark, sf))
    model = models.train_traffic(m.filter("fold = 'train'"), models.vocabulary(m))
    return m, models.fit_calibration(model, m.filter("fold = 'calibration'"))


@query("scored_spans", "M8 W5")
def scored_spans(spark, sf):
    m, model = trained(spark, sf)
    return rounded(models.score_windows(model, m).drop("top_features"))


@query("occlusion_attributions", "M9 O3")
def occlusion_attributions(spark, sf):
    """Top five features of each test window."""
    m, model = trained(spark, sf)
    top = models.occlusion_attribution(model, m.filter("fold = 'test'"))
    return rounded(top.select("capture_id", "pair_id", "k", F.posexplode("top_features").alias("place", "f")).select(
        "capture_id", "pair_id", "k", "place", "f.*"))


@query("tree_attributions", "M9 O3")
def tree_attributions(spark, sf):
    """Top five features of each test window by their exact share of the winning class's score."""
    m, model = trained(spark, sf)
    top = models.tree_attribution(model, m.filter("fold = 'test'"))
    return rounded(top.select("capture_id", "pair_id", "k", F.posexplode("top_features").alias("place", "f")).select(
        "capture_id", "pair_id", "k", "place", "f.*"))


@query("top_contributions", "O3", sql="""
SELECT l_orderkey, feature, place, contribution FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(contribution) DESC, feature) AS place FROM (
    SELECT l_orderkey, CAST(l_partkey AS VARCHAR) || '-' || l_linenumber || '-' || l_suppkey AS feature, l_quantity - 25 AS contribution FROM lineitem)) WHERE place <= 5""")
def top_contributions(spark, sf):
    r = adapters.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "concat_ws('-', l_partkey, l_linenumber, l_suppkey) AS feature", "l_quantity - 25 AS contribution")
    return models.top_contributions(r, ["l_orderkey"]).select("l_orderkey", "feature", "place", "contribution")


# Lengths are typical of a class, with some noise; a tunnel's packets carry an inner header too.
MODE_LENGTHS = {
    "min_len": "28 + 8 * (label % 7) + CAST(floor((FIRST + 1) * 4) AS BIGINT)",
    "modal_len": "400 + 120 * (label % 7) + CAST(floor((SECOND + 1) * 6) AS BIGINT)",
}
INNER = "CASE WHEN vec_id % 2 = 0 THEN 0 WHEN vec_id % 4 = 0 THEN 40 WHEN vec_id % 3 = 0 THEN 40 ELSE 20 END"
IP_VERSION = "CASE WHEN vec_id % 4 = 0 OR vec_id % 3 = 0 THEN 6 ELSE 4 END"


def _length(name: str, base: int) -> str:
    sql = MODE_LENGTHS[name].replace("FIRST", f"embedding[{base}]").replace("SECOND", f"embedding[{base + 1}]")
    return f"{sql} + {INNER} AS {name}"


sqlviews.view("mode_sessions", "", f"""
  SELECT vec_id, CASE label % 7 WHEN 0 THEN 'email' WHEN 1 THEN 'file_transfer' WHEN 2 THEN 'icmp' WHEN 3 THEN 'messaging' WHEN 4 THEN 'video' WHEN 5 THEN 'voip' ELSE 'web' END AS traffic_class,
         {IP_VERSION} AS ip_version, {_length('min_len', 1)}, {_length('modal_len', 1)}, CASE WHEN vec_id % 2 = 0 THEN 'transport' ELSE 'tunnel' END AS mode,
         CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS fold FROM embeddings""")


def mode_sessions(spark, sf):
    return adapters.table(spark, sf, "embeddings").selectExpr(
        adapters.cycle("label", [f"'{c}'" for c in dims.TRAFFIC_CLASSES]) + " AS traffic_class",
        f"{IP_VERSION} AS ip_version", _length("min_len", 0), _length("modal_len", 0),
        "CASE WHEN vec_id % 2 = 0 THEN 'transport' ELSE 'tunnel' END AS mode",
        "CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS fold", "vec_id")


@query("mode_baseline", "A30", views="mode_sessions", sql="""
SELECT traffic_class, ip_version, median(min_len)::DOUBLE AS base_min, median(modal_len)::DOUBLE AS base_modal
FROM mode_sessions WHERE mode = 'transport' AND fold <> 'test' GROUP BY traffic_class, ip_version""")
def mode_baseline(spark, sf):
    return models.fit_mode_baseline(mode_sessions(spark, sf))


def mode_rows(sessions, baseline):
    """The six mode features of each session; only lengths and counts are read, never the mode."""
    j = sessions.join(F.broadcast(baseline), ["traffic_class", "ip_version"], "left")  # classes times two versions
    offset = lambda name, base: F.coalesce(F.col(name) - F.col(base), F.lit(0.0))
    return j.select(
        "vec_id", "mode", "fold", (F.col("modal_len") / 1500.0).alias("max_len_over_mtu"), (1.0 + F.col("vec_id") % 3).alias("spi_pairs_per_endpoint"),
        (F.col("vec_id") % 10 / 100.0).alias("cleartext_ratio"), offset("modal_len", "base_modal").alias("modal_len_offset"),
        offset("min_len", "base_min").alias("min_len_offset"), F.when(F.col("ip_version") == 6, 40.0).otherwise(20.0).alias("inner_header_bytes"))


def mode_scored(spark, sf):
    s = materialise(mode_sessions(spark, sf))
    base = materialise(models.fit_mode_baseline(s))
    rows = mode_rows(s, base)
    return models.predict_mode(models.train_mode(rows.filter("fold <> 'test'"), base), rows)


@query("mode_predictions", "M3 J12")
def mode_predictions(spark, sf):
    """Tunnel or transport for every session, from offsets against the fitted baseline."""
    return rounded(mode_scored(spark, sf).select(
        "vec_id", "mode", "fold", F.col("operating_mode.value").alias("predicted"), F.col("operating_mode.confidence").alias("confidence")))


@query("mode_accuracy", "M3", views="mode_sessions", sql="""
SELECT mode, count(*) AS sessions, TRUE AS accurate FROM mode_sessions WHERE fold = 'test' GROUP BY mode""")
def mode_accuracy(spark, sf):
    """Held-out sessions of each mode, and whether at least nine in ten are told apart."""
    p = mode_scored(spark, sf).filter("fold = 'test'")
    return p.groupBy("mode").agg(F.count(F.lit(1)).alias("sessions"), (F.avg(F.when(F.col("operating_mode.value") == F.col("mode"), 1.0).otherwise(0.0)) >= 0.9).alias("accurate"))


@query("external_evaluation", "M11 A37")
def external_evaluation(spark, sf):
    """The window model on address-pair flows, next to its internal score."""
    m = materialise(window_matrix(spark, sf))
    fitted, metrics = models.train_all(m, sequence=False)
    p = adapters.packets(spark, sf)
    ext = features.pair_features(external.tag_external(p, external.external_pairs(p)))
    ext = ext.withColumn("label", dims.lookup(CLASS_OF_CAPTURE, F.col("capture_id"))).withColumn(
        "tunnelled", F.expr("capture_id % 2 = 0"))
    model = fitted["traffic"]
    return rounded(models.generalisation_gap(metrics, models.score_external(model, ext), model.labels))
