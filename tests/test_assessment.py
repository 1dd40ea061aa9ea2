"""Policy, scores, exposure, constraints, verification, folds and calibration."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirelens import dims
from wirelens.functions import attrs, scalars
from wirelens.operators import calibrate, catalogue, constraints, dataset, evalm, policy, scoring, verify

KEYS = "capture_id long, pair_id long, spi_initiator string, first_us long, last_us long"


def association(spark, values, duration_s=100, probabilities=(), pair=1):
    df = spark.createDataFrame([(0, pair, "0000000a", 0, duration_s * 1_000_000)], KEYS)
    for name, _, typ in dims.PARAMETERS:
        if name in values:
            v = values[name]
            col = attrs.inferred(F.lit(v[0]), typ, v[1]) if isinstance(v, tuple) else attrs.observed(F.lit(v), typ)
        else:
            col = attrs.unavailable("not seen", typ)
        df = df.withColumn(name, col)
    items = [F.struct(F.lit("voip").alias("label"), F.lit(p).alias("probability")) for p in probabilities]
    empty = F.array().cast("array<struct<label:string,probability:double>>")
    return df.withColumn("inner_traffic", F.array(*items) if items else empty)


WEAK = {"ike_version": "ikev1", "ike_exchange_mode": "aggressive", "encryption_alg": "3des-cbc", "integrity_alg": "hmac-sha1-96",
        "dh_group": 2, "pfs_enabled": (False, 0.9), "negotiated_lifetime_s": 86400}


def findings(spark, *args, **kwargs):
    return policy.dedupe_findings(policy.evaluate_policy(association(spark, *args, **kwargs), policy.load_policy()))


def test_weak_tunnel_scores_fifteen(spark):
    f = findings(spark, WEAK, probabilities=[0.95, 0.95])
    assert f.count() == 8
    s = scoring.score(f).first()
    assert (s["total"], s["rating"]) == (15, "critical")
    assert s["category_penalties"]["cryptographic_strength"] == 30 and s["category_penalties"]["key_exchange"] == 20


def test_strong_tunnel_scores_ninety(spark):
    f = findings(spark, {"ike_version": "ikev2", "encryption_alg": ("aes-gcm-16", 0.6), "dh_group": 19}, probabilities=[0.93])
    assert [r["id"] for r in f.collect()] == ["META-HIGH-EXPOSURE"]
    s = scoring.score(f).first()
    assert (s["total"], s["rating"]) == (90, "strong")


def test_guards_and_unavailable_values(spark):
    assert findings(spark, {"encryption_alg": ("3des-cbc", 0.69)}).count() == 0
    assert findings(spark, {"encryption_alg": ("3des-cbc", 0.7)}).count() == 1
    assert findings(spark, {}).count() == 0
    assert [r["id"] for r in findings(spark, {}, duration_s=7201).collect()] == ["KEYMGMT-NO-REKEY-OBSERVED"]
    rule = {"attribute": "pfs_enabled", "operator": "gt", "value": 0}
    assert association(spark, {"pfs_enabled": True}).select(policy.predicate(rule).alias("x")).first()["x"] is False
    either = {"any": [{"attribute": "dh_group", "operator": "lt", "value": 3}, {"attribute": "ike_version", "operator": "eq", "value": "ikev1"}]}
    assert association(spark, {"dh_group": 2}).select(policy.predicate(either).alias("x")).first()["x"] is True


def test_baseline_policy_is_clean(spark):
    rules = policy.load_policy()
    assert len(rules) == 14 and policy.lint_policy(policy.policy_rules(spark, rules)).count() == 0
    bad = [dict(rules[0], penalty=31, when={"attribute": "pfs_enabled", "operator": "eq", "value": False}), rules[1], rules[1]]
    assert sorted(r["defect"] for r in policy.lint_policy(policy.policy_rules(spark, bad)).collect()) == [
        "duplicate id", "penalty over cap", "unguarded pfs_enabled"]


@pytest.mark.parametrize("values, expected", [([1 / 7], 0), ([1.0], 100), ([0.05], 0)])
def test_exposure_formula(spark, values, expected):
    p = spark.createDataFrame([(0, 1, i, "voip", v) for i, v in enumerate(values)],
                              "capture_id long, pair_id long, start_us long, label string, probability double")
    assert scoring.exposure(p).first()["score"] == expected


def test_threat_matrix_orders_and_unknown_names(spark):
    f = findings(spark, WEAK).withColumn("attack_techniques", F.concat("attack_techniques", F.array(F.lit("T9999"))))
    t = {r["technique_id"]: r for r in scoring.threat_matrix(f).collect()}
    assert t["T9999"]["technique_name"] == "T9999" and t["T9999"]["finding_ids"][0] == "CRYPTO-3DES"
    assert t["T1040"]["max_severity"] == "critical"


def test_threat_matrix_sorts_no_findings(spark):
    rows = [(1, "medium", 5, "B", ["T1"]), (1, "medium", 9, "C", ["T1"]), (1, "high", 2, "D", ["T1"]), (1, "odd", 7, "E", ["T1", "T2"]),
            (1, "medium", 8, "B", ["T1"]), (1, "high", None, "A", ["T1"]), (1, "critical", 1, "B", ["T2"])]
    f = spark.createDataFrame(rows, "capture_id long, severity string, penalty int, id string, attack_techniques array<string>")
    m = scoring.threat_matrix(f)
    assert "SortAggregate" not in m._jdf.queryExecution().executedPlan().toString()
    assert {(r["technique_id"], tuple(r["finding_ids"]), r["max_severity"]) for r in m.collect()} == {
        ("T1", ("E", "A", "D", "C", "B"), "high"), ("T2", ("E", "B"), "critical")}


def test_evidence_cap(spark):
    r = spark.range(1).select(attrs.evidence("m", F.sequence(F.lit(1), F.lit(100_000)).cast("array<bigint>")).alias("e")).first()["e"]
    assert len(r["packet_indices"]) == 20 and r["total_matching"] == 100_000


def test_attribute_audit_is_empty_for_built_attributes(spark):
    from wirelens.operators import compare
    assert constraints.attribute_violations(compare.parameter_rows(association(spark, WEAK))).count() == 0


@pytest.mark.parametrize("expected, actual, prov, hidden, outcome", [
    ("a", "a", "observed", False, "match"), ("a", "b", "observed", False, "mismatch"), ("a", "a", "inferred", False, "inferred"),
    ("a", None, "unavailable", True, "honest_gap"), ("a", None, "unavailable", False, "not_reported"), ("a", "a", "inferred", True, "fabricated")])
def test_outcomes(spark, expected, actual, prov, hidden, outcome):
    p = spark.createDataFrame([("s", "f", actual, prov)], "session string, field string, value string, provenance string")
    w = spark.createDataFrame([("s", "f", expected, hidden)], "session string, field string, expected string, unobservable boolean")
    assert verify.verify_sessions(p, w).first()["outcome"] == outcome


def test_exploded_parameters_are_not_broadcast(spark):
    base = spark.range(1000).selectExpr("id AS session", "explode(sequence(1, 11)) AS field")
    out = verify.verify_sessions(base.selectExpr("session", "field", "'v' AS value", "'observed' AS provenance"),
                                 base.selectExpr("session", "field", "'v' AS expected", "false AS unobservable"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("outcome = 'match'").count() == 11_000


def test_split_is_disjoint_and_complete(spark):
    rows = [(f"cfg{i}", c) for c in dims.TRAFFIC_CLASSES for i in range(len(c) * 10, len(c) * 10 + 9)]
    w = spark.createDataFrame(rows, "config_name string, traffic_class string").withColumn("session_name", F.col("config_name"))
    s = dataset.split_configs(w)
    assert dataset.uncovered_configs(w, s).count() == 0
    assert dataset.fold_checks(dataset.to_matrix(w, s)).count() == 0
    one = spark.createDataFrame([(f"c{i}", "web") for i in range(9)], "config_name string, traffic_class string")
    assert {r["fold"]: r["count"] for r in dataset.split_configs(one).groupBy("fold").count().collect()} == {"test": 2, "calibration": 1, "train": 6}


def test_names(spark):
    rows = [("s001-ikev2-aes-r3",), ("weak-reference",), ("s000-rekey",)]
    df = spark.createDataFrame(rows, "n string")
    assert [r[0] for r in df.select(scalars.config_name(F.col("n"))).collect()] == ["s001-ikev2-aes", "weak-reference", "s000-rekey"]
    files = spark.createDataFrame([("/x/skype_file1.pcap",), ("vpn_youtube.pcap",), ("tor_x.pcap",)], "n string")
    assert [tuple(r) for r in files.select(scalars.label_from_name(F.col("n")), scalars.is_tunnelled(F.col("n"))).collect()] == [
        ("file_transfer", False), ("video", True), (None, False)]


def test_ece_goldens(spark):
    cols = "truth string, predicted string, confidence double"
    assert evalm.ece(spark.createDataFrame([("a", "a", 1.0)] * 3, cols)).first()["ece"] == 0.0
    assert evalm.ece(spark.createDataFrame([("a", "b", 1.0)] * 3, cols)).first()["ece"] == 1.0
    assert evalm.reliability(spark.createDataFrame([("a", "a", 0.95)], cols)).count() == 10


def test_temperature_is_one_without_errors(spark):
    cols = "logits array<double>, label int"
    assert calibrate.fit_temperature(spark.createDataFrame([([2.0, 0.0], 0)], cols)) == 1.0
    assert calibrate.fit_temperature(spark.createDataFrame([], cols)) == 1.0
    over = spark.createDataFrame([([8.0, 0.0], 0)] * 7 + [([8.0, 0.0], 1)] * 3, cols)
    t = calibrate.fit_temperature(over)
    assert t == pytest.approx(8.0 / 0.8472978603872, rel=0.02)  # logit(0.7) = 0.847


def test_isotonic_absent_class_keeps_rows_normal(spark):
    rows = [([0.7, 0.2, 0.1], 0), ([0.4, 0.5, 0.1], 1), ([0.6, 0.3, 0.1], 0), ([0.3, 0.6, 0.1], 1)]
    df = spark.createDataFrame(rows, "probabilities array<double>, label int")
    knots = calibrate.fit_isotonic(df, 3)
    assert sorted((r["x"], r["y"]) for r in knots.filter("cls = 2").collect()) == [(0.0, 0.0), (1.0, 1.0)]
    for r in calibrate.apply_knots(df, knots).collect():
        assert sum(r["probabilities"]) == pytest.approx(1.0)


def pooled(points):
    """Plain pooling of (x, hits, weight) in order: (first x, last x, mean) of each block."""
    stack = []
    for x, hits, weight in sorted(points):
        stack.append([x, x, hits, weight])
        while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
            last = stack.pop()
            stack[-1][1:] = [last[1], stack[-1][2] + last[2], stack[-1][3] + last[3]]
    return [(a, b, h / w) for a, b, h, w in stack]


@pytest.mark.parametrize("shape", ["noise", "falling", "rising"])
def test_isotonic_in_ranges_equals_one_pass(spark, shape):
    rng = random.Random(shape)
    chance = {"noise": lambda x: x, "falling": lambda x: 1 - x, "rising": lambda x: 1.0 * (x > 0.5)}[shape]
    points = {c: [(x / 3000, int(rng.random() < chance(x / 3000)), 1 + x % 3) for x in rng.sample(range(3000), 700)] for c in (0, 1)}
    rows = [(c, *p) for c, own in points.items() for p in own]
    df = spark.createDataFrame(rows, "cls int, x double, hits long, weight long")
    got = calibrate.pooled_blocks(df, at_once=90).collect()
    for c, own in points.items():
        assert sorted((r["x0"], r["x1"], r["hits"] / r["weight"]) for r in got if r["cls"] == c) == pooled(own)


def test_lookup_equals_interpolation(spark):
    rng = np.random.default_rng(4)
    knots = [{"x": np.sort(rng.random(60)).tolist(), "y": np.sort(rng.random(60)).tolist()}, {"x": [0.4], "y": [0.7]}, {"x": [0.0, 1.0], "y": [0.0, 1.0]}]
    rows = [([float(v) for v in rng.random(3)],) for _ in range(200)] + [([0.0, 1.0, 0.5],)] * 50 + [(knots[0]["x"][:3],), (None,)]
    df = spark.createDataFrame(rows, "probabilities array<double>")
    want = []
    for (p,) in rows:
        v = None if p is None else [float(np.interp(x, k["x"], k["y"])) for x, k in zip(p, knots)]
        want.append(None if p is None else [x / sum(v) for x in v] if sum(v) else p)
    got = [r[0] for r in calibrate.apply_knots(df, calibrate.knot_table(spark, knots)).collect()]
    key = lambda v: (v is None, [round(x, 9) for x in v or []])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a == b or a == pytest.approx(b, abs=1e-12)


def test_manifest_and_pending(spark):
    log = spark.createDataFrame([("a", 1, "failed", 0, 0.0, "x" * 3000), ("a", 2, "completed", 5, 1.26, ""), ("b", 1, "completed", 5, 1.0, "")],
                                "name string, finished_at long, status string, packet_count long, duration_s double, error string")
    m = {r["name"]: r for r in catalogue.record_outcomes(log).collect()}
    assert m["a"]["attempts"] == 2 and m["a"]["status"] == "completed" and m["a"]["duration_s"] == 1.3
    left = catalogue.pending(spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), catalogue.record_outcomes(log),
                             spark.createDataFrame([("a",)], "name string"))
    assert sorted(r[0] for r in left.collect()) == ["b", "c"]


def test_policy_file_is_plain_json():
    with open(policy.BASELINE, encoding="utf-8") as fh:
        assert json.load(fh)["profile"] == "baseline"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_association_reduces_ids_only(spark):
    from wirelens.operators import compare
    sas = spark.createDataFrame([(1, 7, "x"), (1, 3, "y"), (2, 9, "z"), (1, 3, "y")], "capture_id long, pair_id long, note string")
    first = compare.first_association(sas)
    assert sorted(map(tuple, first.collect())) == [(1, 3, "y"), (2, 9, "z")] and "min_by" not in plan_of(first)


def test_deduped_findings_leave_out_unread_columns(spark):
    f = spark.createDataFrame([(1, "R", "s", 5, 1, "late"), (1, "R", "s", 2, 8, None), (1, "Q", "s", 4, 3, "only")],
                              "capture_id long, id string, sa_spi string, pair_id long, penalty int, description string")
    out = policy.dedupe_findings(f)
    assert sorted((r["id"], r["pair_id"], r["penalty"], r["description"]) for r in out.collect()) == [("Q", 4, 3, "only"), ("R", 2, 8, None)]
    narrow = plan_of(out.select("id", "pair_id", "penalty"))
    assert "SortAggregate" not in narrow and "min_by(description" not in narrow


def test_finding_sets_read_findings_once_a_side(spark):
    from wirelens.operators import compare
    f = spark.createDataFrame([(1, "R"), (1, "Q"), (2, "Q"), (2, "P"), (2, "P")], "capture_id long, id string")
    out = compare.finding_sets(f, spark.createDataFrame([(0, 1, 2), (1, 2, 3)], "cmp_id long, a long, b long"))
    assert plan_of(out).count("Scan ExistingRDD[capture_id") <= 2  # before it runs, so the plan is written once
    assert sorted(map(tuple, out.collect())) == [(0, "P", "b"), (0, "Q", "both"), (0, "R", "a"), (1, "P", "a"), (1, "Q", "a")]


def test_parts_of_a_spread_table_do_not_grow_with_it(spark, tmp_path):
    from wirelens.plans import adapters
    spark.range(2000).withColumn("v", F.rand(1)).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert adapters.spread_table(spark, str(tmp_path), "t", 1000).rdd.getNumPartitions() > 8
