"""From packets and key-exchange messages to assessments, for all captures at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.operators import (evalm, features, flows, ike, lattice, models, panes, pfs, policy, quality, replay, scoring,
                                windows)
from wirelens.session import materialise


@dataclass
class Assessment:
    quality: DataFrame
    sas: DataFrame
    findings: DataFrame
    scores: DataFrame
    exposure: DataFrame
    threats: DataFrame
    predictions: DataFrame


def inner_traffic(spans: DataFrame) -> DataFrame:
    """Spans of a pair as its predictions list."""
    item = F.struct(F.col("label"), F.col("probability"), F.col("window_start_us").alias("start_us"),
                    F.col("window_end_us").alias("end_us"))
    order = F.struct(F.col("window_start_us").alias("o"), item.alias("v"))
    return spans.groupBy("capture_id", "pair_id").agg(
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x["v"]).alias("inner_traffic"))


def infer(packets: DataFrame, pairs: DataFrame, rollup: DataFrame, flow_table: DataFrame, quality_table: DataFrame,
          correlated: DataFrame, messages: DataFrame,
          model: models.TrafficModel | None = None, mode_model: models.ModeModel | None = None) -> tuple[DataFrame, DataFrame]:
    """(inferences per association, spans): everything packets alone can tell.

    Spans carry the features behind their first window. The operating mode needs the
    traffic model too: the class decides which lengths are to be expected.
    """
    keys = ["capture_id", "pair_id"]
    tagged = flows.tag_packets(packets, pairs)
    sieve = lattice.detect_suite(lattice.suite_survivors(lattice.length_histogram(tagged)), quality_table)
    health = replay.sequence_health(replay.sequence_stats(tagged)).select(*keys, "replay_sane")
    rekey = ike.with_rekey(rollup, replay.rekey_interval(flows.spi_series(flow_table))).select(*keys, "observed_rekey_s")

    ends = rollup.select(*keys, F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    group = correlated.select(*keys, F.col("negotiation.dh_group").alias("dh_group"))
    asked = ends.join(group, keys).select("capture_id", "lo", "hi", "dh_group").distinct()
    sizes = pfs.exchange_sizes(messages)
    # No exchange is known to be free of a key exchange, so the baseline is empty.
    verdict = pfs.infer_pfs(sizes.filter("kind = 'create_child'"), sizes.filter(F.lit(False)), asked)
    pfs_rows = ends.join(group, keys).join(
        verdict.select("capture_id", "lo", "hi", F.col("dh_group").alias("_g"), "pfs_enabled"), ["capture_id", "lo", "hi"]
    ).filter(F.col("_g").eqNullSafe(F.col("dh_group"))).select(*keys, "pfs_enabled")

    modes = []
    if model is None:
        spans = models.no_predictions(packets.sparkSession)
    else:
        matrix = materialise(panes.window_features(tagged, windows.MIN_PACKETS))
        spans = materialise(models.score_windows(model, matrix, explain=True))
        if mode_model is not None:
            classes = evalm.class_distribution(models.score(model, matrix), keys, model.labels)
            rows = features.mode_classifier_features(tagged, packets, classes, mode_model.baseline)
            modes = [models.predict_mode(mode_model, rows).select(*keys, "operating_mode")]
    out = rollup.select(*keys)
    # One row per association each; written once, so the joins below stay a short plan.
    for part in (sieve.drop("suite"), health, rekey, pfs_rows, inner_traffic(spans), *modes):
        out = out.join(materialise(part), keys, "left")
    return out, spans


def assess(packets: DataFrame, messages: DataFrame, rules: list[dict] | None = None,
           model: models.TrafficModel | None = None, mode_model: models.ModeModel | None = None,
           of_spis: Callable[[DataFrame], DataFrame] | None = None) -> Assessment:
    """One plan over any number of captures; ``of_spis`` as in ``ike.correlate_messages``.

    Flow summaries, matched negotiations, associations and findings are written to the
    checkpoint folder once each: they are small next to the packets and several
    results read them, and a lost executor then costs no packet scan.
    """
    rules = rules if rules is not None else policy.load_policy()
    flow_table = materialise(flows.summarise_flows(packets))
    pairs = materialise(flows.pair_flows(flow_table))
    rollup = flows.sa_rollup(pairs)
    quality_table = materialise(quality.capture_quality(packets))
    correlated = materialise(ike.correlate_messages(rollup, messages, of_spis=of_spis))
    sas = ike.assemble_sas(rollup, correlated)
    inferred, spans = infer(packets, pairs, rollup, flow_table, quality_table, correlated, messages, model, mode_model)
    sas = materialise(ike.overlay(sas, inferred))
    findings = materialise(policy.dedupe_findings(policy.evaluate_policy(sas, rules)))
    predictions = sas.select("capture_id", "pair_id", F.explode("inner_traffic").alias("p")).select("capture_id", "pair_id", "p.*")
    captures = quality_table.select("capture_id")
    return Assessment(quality_table, sas, findings, scoring.score(findings, captures),
                      scoring.exposure(predictions, captures), scoring.threat_matrix(findings), spans)
