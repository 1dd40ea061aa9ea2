"""Classifiers on a separable set, the no-model state and a whole small assessment."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_flows import packet, table
from test_inference import proposal
from wirelens import dims
from wirelens.operators import boosting, flows, ike, models, network, panes, quality
from wirelens.plans import assess, verification
from wirelens.sources import sinks


def separable(spark, per_class=24):
    rng = random.Random(1)
    rows = []
    for c, name in enumerate(("voip", "web")):
        for i in range(per_class):
            fold = "test" if i % 4 == 0 else ("calibration" if i % 4 == 1 else "train")
            seq = [float(100 + 900 * c) + rng.random() for _ in range(128)]
            rows.append((0, c, i, 5_000_000 * i, name, fold, f"{name}{i}", float(100 + 900 * c) + rng.random() * 50, rng.random(), seq))
    cols = "capture_id long, pair_id long, k long, start_us long, traffic_class string, fold string, config_name string, a double, b double, seq array<double>"
    df = spark.createDataFrame(rows, cols)
    return df.withColumns({f: F.col("b") if f == "iat_mean" else F.col("a") for f in dims.FEATURES})


def test_train_calibrate_score_explain(spark):
    m = separable(spark)
    fitted, metrics = models.train_all(m, sequence=False)
    got = {r["metric"]: r["value"] for r in metrics.collect()}
    assert got["macro_f1"] >= 0.85 and got["ece"] <= 0.10
    model = fitted["traffic"]
    assert model.labels == ["voip", "web"]
    spans = models.score_windows(model, m).collect()
    assert {(r["pair_id"], r["label"]) for r in spans} == {(0, "voip"), (1, "web")}
    for explain in (models.occlusion_attribution, models.attribution):
        top = explain(model, m.filter("fold = 'test'")).first()["top_features"]
        sizes = [abs(t["contribution"]) for t in top]
        assert len(top) == 5 and sizes == sorted(sizes, reverse=True)
    assert sizes[0] > 0 and models.train_traffic(m, model.labels, kind="forest").kind == "forest"


def several(spark, n=420, classes=4, seed=3):
    """Classes that need two features together; the others are noise."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.random() for _ in range(5)]
        rows.append((i, int(x[0] > 0.5) * 2 + int(x[1] > 0.4 + 0.2 * (x[0] > 0.5)), *x))
    return spark.createDataFrame(rows, "id long, label int, a double, b double, c double, d double, e double")


@pytest.fixture(scope="module")
def boosted(spark):
    rows = several(spark)
    return rows, boosting.fit(rows.filter("id % 4 <> 0"), 4, list("abcde"), boosting.Shape(rounds=5, depth=3))


def test_boosting_holds_out(boosted):
    rows, trees = boosted
    held = rows.filter("id % 4 = 0").withColumn("z", boosting.logits(trees, F.array(*"abcde"))).collect()
    right = [r["z"].index(max(r["z"])) == r["label"] for r in held]
    assert len(right) == 105 and sum(right) >= 0.9 * len(right)
    none = boosting.fit(rows.limit(0), 4, list("abcde"), boosting.Shape(rounds=2))
    assert set(boosting.margins(none, np.random.default_rng(1).random((5, 5))).ravel()) == {0.0}


def test_boosting_equals_a_plain_first_tree(boosted):
    """The first split of each class is the best of all, by a search over the rows."""
    rows, trees = boosted
    train = rows.filter("id % 4 <> 0").collect()
    x, y = np.array([[r[c] for c in "abcde"] for r in train]), np.array([r["label"] for r in train])
    p = np.exp(trees.prior) / np.exp(trees.prior).sum()
    for c in range(4):
        g, h = p[c] - (y == c), np.full(len(y), p[c] * (1 - p[c]))
        gain = lambda j, cut: sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (x[:, j] <= cut, x[:, j] > cut))
        j, cut = trees.feature[0, c, 0], trees.threshold[0, c, 0]
        best = max(gain(k, v) for k in range(5) for v in x[:, k])
        assert gain(j, cut) > 0.9 * best and trees.cover[0, c, 0] == len(y)


def test_attributions_are_shapley_values(boosted):
    rows, trees = boosted
    x = np.array([[r[c] for c in "abcde"] for r in rows.limit(12).collect()])

    def value(row, held, c):  # the score when only the features of `held` are known
        def below(t, node):
            if node >= trees.feature.shape[2]:
                return trees.leaf[t, c, node - trees.feature.shape[2]]
            j = trees.feature[t, c, node]
            if j in held:
                return below(t, 2 * node + 2 - (row[j] <= trees.threshold[t, c, node]))
            n = trees.cover[t, c, node]
            return sum(trees.cover[t, c, k] / n * below(t, k) for k in (2 * node + 1, 2 * node + 2)) if n else 0.0

        return trees.prior[c] + sum(below(t, 0) for t in range(len(trees.leaf)))

    for c in (0, 3):
        phi = boosting.contributions(trees, x, c)
        assert np.allclose(phi.sum(axis=1) + boosting.expected(trees, c), boosting.margins(trees, x)[:, c])
        for row, own in zip(x, phi):
            for j in range(5):
                rest = [i for i in range(5) if i != j]
                want = sum(math.factorial(len(s)) * math.factorial(4 - len(s)) / 120 * (value(row, {*s, j}, c) - value(row, set(s), c))
                           for k in range(5) for s in itertools.combinations(rest, k))
                assert own[j] == pytest.approx(want, abs=1e-9)


def test_network_reads_the_sequence(spark):
    m = separable(spark, 16)
    model = models.train_sequence(m.filter("fold <> 'test'"), ["voip", "web"], steps=20)
    rows = models.score(model, m.filter("fold = 'test'")).select("traffic_class", "predicted").collect()
    assert all(r["traffic_class"] == r["predicted"] for r in rows)


def test_network_gradients_equal_finite_differences():
    rng = np.random.default_rng(2)
    layers = network.Layers(kernels=3, width=4, stride=3, hidden=5)
    x, s, y, w = rng.normal(size=(6, 4)), rng.normal(size=(6, 20)), rng.integers(0, 3, 6), rng.random(6)
    theta = rng.normal(size=sum(int(np.prod(q)) for q in network.shapes(4, 3, layers)))
    g, _ = network.gradient(theta, x, s, y, w, 3, layers)
    for i in range(0, len(theta), 3):
        step = np.zeros(len(theta))
        step[i] = 1e-6
        up, down = (network.gradient(theta + d, x, s, y, w, 3, layers)[1] for d in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    # A weight is as good as repeats, and sums of parts are the sum.
    twice = network.gradient(theta, np.repeat(x, 2, axis=0), np.repeat(s, 2, axis=0), np.repeat(y, 2), np.repeat(w / 2, 2), 3, layers)[0]
    parts = sum(network.gradient(theta, x[k], s[k], y[k], w[k], 3, layers)[0] for k in (slice(0, 2), slice(2, 6)))
    assert np.allclose(twice, g) and np.allclose(parts, g)


def test_a_rare_class_is_learnt_without_repeats(spark):
    m = separable(spark, 40).filter("traffic_class = 'web' OR k < 4")
    model = models.train_sequence(m, ["voip", "web"], steps=25)
    rows = models.score(model, m).select("traffic_class", "predicted").collect()
    assert len(rows) == 44 and all(r["traffic_class"] == r["predicted"] for r in rows)


def test_no_model_state(spark):
    assert models.score_windows(None, separable(spark, 2)).count() == 0
    r = models.mode_unavailable(spark.range(1)).first()["operating_mode"]
    assert r["provenance"] == "unavailable" and r["note"] == models.NO_MODEL


def messages(spark):
    weak = proposal(1, (1, 3, None), (2, 2, None), (3, 2, None), (4, 2, None))
    rows = [(0, "s", "ikev2", 34, 1, 0, "10.0.0.1", "10.0.0.2", None, [weak], False, 300),
            (0, "s", "ikev2", 34, 2, 1000, "10.0.0.2", "10.0.0.1", "r", [weak], False, 300)]
    return spark.createDataFrame(rows, "capture_id long, init_spi string, ike_version string, exchange_type int, frame_index long, ts_us long, "
                                       f"src string, dst string, resp_spi string, sa_payload {ike.PROPOSALS_TYPE}, nat_detected boolean, length int")


def test_whole_assessment(spark):
    rows = [packet(i, 2_000_000 + i * 10_000, up=i % 2 == 0, spi=1 + i % 2, seq=i // 2, length=28 + 16 * (1 + i % 40)) for i in range(400)]
    a = assess.assess(table(spark, rows), messages(spark))
    sa = a.sas.first()
    # The negotiated cipher is only assumed for the child, so its rule stays quiet.
    assert (sa["encryption_alg"]["value"], sa["encryption_alg"]["confidence"]) == ("3des-cbc", 0.6)
    assert sa["replay_sane"]["value"] is True and sa["pfs_enabled"]["provenance"] == "unavailable"
    assert sorted(r["id"] for r in a.findings.collect()) == ["KEX-WEAK-DH"]
    assert (a.scores.first()["total"], a.exposure.first()["score"]) == (85, 0)
    ids = a.quality.select("capture_id", F.lit("a").alias("assessment_id"), F.lit("t").alias("generated_at"), F.lit("1").alias("engine_version"),
                           F.lit("1.0").alias("policy_version"), F.create_map().cast("map<string,string>").alias("model_versions"))
    made = [sinks.assessment_documents(a.quality, a.sas, a.findings, a.scores, a.exposure, a.threats, ids).first()["document"] for _ in range(2)]
    assert made[0] == made[1]
    doc = json.loads(made[0])
    assert doc["score"]["total"] == 85 and doc["findings"][0]["id"] == "KEX-WEAK-DH"
    assert doc["security_associations"][0]["first_seen"] == "1970-01-01T00:00:02.000000Z"


def test_assessment_with_models_tells_mode_traffic_and_reasons(spark):
    rows = [packet(i, 2_000_000 + i * 10_000, up=i % 2 == 0, spi=1 + i % 2, seq=i // 2, length=28 + 16 * (1 + i % 40)) for i in range(400)]
    packets = table(spark, rows)
    _, tagged = flows.pair_and_tag(packets)
    matrix = panes.window_features(tagged, 2).withColumn("traffic_class", F.when(F.col("k") % 2 == 0, "web").otherwise("voip"))
    traffic = models.train_traffic(matrix, ["voip", "web"], shape=boosting.Shape(rounds=1, depth=1, least=1))
    baseline = spark.createDataFrame([(c, 4, 28.0, 300.0) for c in ("voip", "web")], "traffic_class string, ip_version int, base_min double, base_modal double")
    known = spark.createDataFrame([(m, *[0.4, 1.0, 0.0, 20.0 * (m == "tunnel"), 20.0 * (m == "tunnel"), 20.0]) for m in ("tunnel", "transport") for _ in range(10)],
                                  "mode string, " + ", ".join(f"{n} double" for n in dims.MODE_FEATURES))
    a = assess.assess(packets, messages(spark), model=traffic, mode_model=models.train_mode(known, baseline, trees=3))
    mode = a.sas.first()["operating_mode"]
    assert mode["provenance"] == "inferred" and mode["value"] in ("tunnel", "transport") and 0.5 <= mode["confidence"] <= 1
    spans = a.predictions.collect()
    assert spans and all(len(s["top_features"]) == 5 for s in spans)
    assert a.exposure.first()["score"] > 0 and len(a.sas.first()["inner_traffic"]) == len(spans)


def test_key_exchange_only_capture_is_assessed_without_associations(spark):
    a = assess.assess(table(spark, [packet(0, 0, proto="isakmp", message=0)]), messages(spark))
    assert a.sas.count() == 0 and a.scores.first()["total"] == 100 and a.quality.first()["ike_complete"]


def test_documents_continue_in_parts(spark):
    n = 25
    sas = spark.range(n).select(F.lit(0).cast("bigint").alias("capture_id"), F.col("id").alias("pair_id"), F.lit(0).alias("first_us"), F.lit(1).alias("last_us"))
    f = sas.select("capture_id", "pair_id", F.lit("R").alias("id"), F.lit("high").alias("severity"), F.lit(1).alias("penalty"), F.col("pair_id").cast("string").alias("sa_spi"))
    one = spark.createDataFrame([(0,)], "capture_id long")
    q = quality.capture_quality(table(spark, []), one)
    ids = one.select("capture_id", F.lit("a").alias("assessment_id"), F.lit("t").alias("generated_at"), F.lit("1").alias("engine_version"),
                     F.lit("1").alias("policy_version"), F.create_map().cast("map<string,string>").alias("model_versions"))
    scores = one.select("capture_id", F.lit(90).alias("total"), F.lit("strong").alias("rating"), F.create_map().cast("map<string,bigint>").alias("category_penalties"))
    exp = one.select("capture_id", F.lit(0).alias("score"))
    threats = one.select("capture_id", F.lit("T1040").alias("technique_id"))
    docs = sinks.assessment_documents(q, sas, f, scores, exp, threats, ids, part_associations=10).orderBy("part").collect()
    assert [len(json.loads(d["document"])["security_associations"]) for d in docs] == [10, 10, 5]
    assert sum(len(json.loads(d["document"])["findings"]) for d in docs) == n


def test_verify_batch(spark):
    attr = "struct<value:string,provenance:string,confidence:double,note:string>"
    names = [n for n, _, _ in dims.PARAMETERS]
    sas = spark.createDataFrame([("s1", 1, *[("ikev2", "observed", None, None) if n == "ike_version" else (None, "unavailable", None, "x") for n in names])],
                                "capture_id string, pair_id long, " + ", ".join(f"{n} {attr}" for n in names))
    expected = ", ".join(f"{n}:string" for n in dims.VERIFIED_FIELDS)
    labels = spark.createDataFrame([("s1", tuple("ikev2" if n == "ike_version" else "x" for n in dims.VERIFIED_FIELDS), {"auth_method": "hidden"})],
                                   f"name string, expected struct<{expected}>, not_observable_from_ike map<string,string>")
    none = spark.createDataFrame([], "session string")
    out = verification.verify_batch(sas, labels, none)
    totals = {r["outcome"]: r["fields"] for r in out["totals"].collect()}
    assert totals == {"match": 1, "honest_gap": 1, "not_reported": 9, "inferred": 0, "mismatch": 0, "fabricated": 0}
    assert out["batch"].first()["passed"]
