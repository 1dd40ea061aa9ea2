"""Policy findings, scores, exposure, threats, comparisons and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelens import dims
from wirelens.catalog import sqlviews
from wirelens.catalog.registry import query
from wirelens.catalog.traffic import rounded
from wirelens.operators import compare, policy, scoring
from wirelens.plans import adapters


def _declared() -> str:
    cols = ["o_custkey % 50 AS capture_id", "o_orderkey AS pair_id", "lpad(lower(to_hex(o_orderkey)), 8, '0') AS sa_spi",
            "o_orderkey", "o_custkey", f"({adapters.DECLARED_CONFIDENCE})::DOUBLE AS confidence",
            "(o_orderkey % 20000)::DOUBLE AS sa_duration_s"]
    for i, (name, _, _) in enumerate(dims.PARAMETERS):
        cols += [f"{adapters.DECLARED[name]} AS {name}_v", f"{adapters.declared_provenance(i)} AS {name}_p"]
    return "SELECT " + ", ".join(cols) + " FROM orders"


sqlviews.view("declared", "", _declared())
LABEL = adapters.cycle("o_orderkey + i", [f"'{c}'" for c in dims.TRAFFIC_CLASSES])
sqlviews.view("predictions", "", f"""
  SELECT o_custkey % 50 AS capture_id, o_orderkey AS pair_id, i, {LABEL} AS label, ({adapters.PREDICTED_PROBABILITY})::DOUBLE AS probability,
         i * 5000000 AS start_us, i * 5000000 + 10000000 AS end_us
  FROM orders, LATERAL (SELECT unnest(range(0, {adapters.PREDICTIONS})) AS i)""")


def _test(name: str, test: str, guard: float | None = None) -> str:
    seen = f"{name}_p <> 'unavailable' AND ({test})"
    if guard is not None:
        seen += f" AND ({name}_p = 'observed' OR confidence >= {guard})"
    return seen


# rule, severity, category, penalty, techniques, condition
RULES = [
    ("CRYPTO-3DES", "critical", "cryptographic_strength", 30, "T1040 T1600", _test("encryption_alg", "encryption_alg_v = '3des-cbc'", 0.7)),
    ("CRYPTO-DES", "critical", "cryptographic_strength", 30, "T1040 T1600", _test("encryption_alg", "encryption_alg_v = 'des-cbc'", 0.7)),
    ("CRYPTO-NULL-ENC", "critical", "cryptographic_strength", 30, "T1040", _test("encryption_alg", "encryption_alg_v = 'null'", 0.7)),
    ("CRYPTO-WEAK-INTEG-MD5", "high", "cryptographic_strength", 12, "T1040 T1557", _test("integrity_alg", "integrity_alg_v = 'hmac-md5-96'", 0.7)),
    ("CRYPTO-SHA1", "medium", "cryptographic_strength", 8, "T1040", _test("integrity_alg", "integrity_alg_v = 'hmac-sha1-96'", 0.7)),
    ("CRYPTO-DOWNGRADE-OFFER", "high", "cryptographic_strength", 15, "T1600", _test("downgrade_available", "downgrade_available_v", 0.7)),
    ("KEX-WEAK-DH", "high", "key_exchange", 15, "T1600", _test("dh_group", "dh_group_v IN (1, 2, 5)")),
    ("KEX-PFS-DISABLED", "high", "key_exchange", 12, "T1040", _test("pfs_enabled", "NOT pfs_enabled_v", 0.7)),
    ("PROTO-AGGRESSIVE-MODE", "critical", "protocol_version_mode", 10, "T1557 T1110", _test("ike_exchange_mode", "ike_exchange_mode_v = 'aggressive'")),
    ("PROTO-IKEV1", "high", "protocol_version_mode", 7, "T1557", _test("ike_version", "ike_version_v = 'ikev1'")),
    ("KEYMGMT-LONG-LIFETIME", "high", "key_management", 10, "T1040", _test("negotiated_lifetime_s", "negotiated_lifetime_s_v > 28800")),
    ("KEYMGMT-NO-REKEY-OBSERVED", "medium", "key_management", 6, "T1040", "observed_rekey_s_p = 'unavailable' AND sa_duration_s > 7200"),
    ("REPLAY-SEQ-ANOMALY", "high", "replay_integrity", 10, "T1557", _test("replay_sane", "NOT replay_sane_v", 0.8)),
    ("META-HIGH-EXPOSURE", "medium", "metadata_exposure", 10, "T1040",
     "coalesce((SELECT avg(p.probability) FROM predictions p WHERE p.pair_id = d.pair_id), 0) > 0.5"),
]
sqlviews.view("findings", "declared predictions", " UNION ALL ".join(
    f"SELECT capture_id, pair_id, sa_spi, '{r}' AS id, '{s}' AS severity, {['critical', 'high', 'medium'].index(s)} AS sev, '{c}' AS category, "
    f"{p} AS penalty, '{t}' AS techniques FROM declared d WHERE {w}" for r, s, c, p, t, w in RULES))


def findings_of(spark, sf):
    return policy.evaluate_policy(adapters.declared_sas(spark, sf), policy.load_policy())


@query("policy_findings", "P31 J8 A20 S6", views="findings", sql="""
SELECT capture_id, pair_id, sa_spi, id, severity, category, penalty, replace(techniques, ' ', ',') AS techniques FROM findings""")
def policy_findings(spark, sf):
    return findings_of(spark, sf).select("capture_id", "pair_id", "sa_spi", "id", "severity", "category", "penalty",
                                         F.concat_ws(",", "attack_techniques").alias("techniques"))


@query("finding_evidence", "P19 P31", views="findings declared", sql="""
SELECT f.capture_id, f.pair_id, f.id, 'policy_rule:' || f.id AS method, CAST(d.dh_group_v AS VARCHAR) AS measured
FROM findings f JOIN declared d USING (pair_id) WHERE f.id = 'KEX-WEAK-DH'""")
def finding_evidence(spark, sf):
    f = findings_of(spark, sf).filter("id = 'KEX-WEAK-DH'")
    return f.select("capture_id", "pair_id", "id", F.col("evidence.method").alias("method"),
                    F.col("evidence.measured")["dh_group"].alias("measured"))


@query("derived_values", "A20", views="predictions declared", sql="""
SELECT d.capture_id, d.pair_id, round(coalesce(avg(p.probability), 0), 6) AS metadata_exposure_confidence,
       any_value(observed_rekey_s_p) <> 'unavailable' AS rekey_observed, any_value(sa_duration_s) AS sa_duration_s
FROM declared d LEFT JOIN predictions p ON p.pair_id = d.pair_id GROUP BY d.capture_id, d.pair_id""")
def derived_values(spark, sf):
    d = policy.derived(adapters.declared_sas(spark, sf))
    return rounded(d.select("capture_id", "pair_id", *dims.DERIVED))


@query("findings_deduped", "A24", views="findings", sql="""
SELECT capture_id, sa_spi, id, min(pair_id) AS pair_id, any_value(penalty) AS penalty FROM
 (SELECT * FROM findings UNION ALL SELECT capture_id, pair_id + 1 AS pair_id, sa_spi, id, severity, sev, category, penalty, techniques FROM findings)
GROUP BY capture_id, sa_spi, id""")
def findings_deduped(spark, sf):
    f = findings_of(spark, sf)
    twice = f.unionByName(f.withColumn("pair_id", F.col("pair_id") + 1))
    return policy.dedupe_findings(twice).select("capture_id", "sa_spi", "id", "pair_id", "penalty")


sqlviews.view("scores", "findings caps", """
  SELECT capture_id, CAST(greatest(0, 100 - sum(capped)) AS BIGINT) AS total FROM (
    SELECT f.capture_id, f.category, least(sum(f.penalty), any_value(c.cap)) AS capped FROM findings f JOIN caps c USING (category)
    GROUP BY f.capture_id, f.category) GROUP BY capture_id""")


@query("category_penalties", "A21", views="findings caps", sql="""
SELECT f.capture_id, f.category, CAST(sum(f.penalty) AS BIGINT) AS raw, CAST(least(sum(f.penalty), any_value(c.cap)) AS BIGINT) AS capped
FROM findings f JOIN caps c USING (category) GROUP BY f.capture_id, f.category""")
def category_penalties(spark, sf):
    return scoring.category_penalties(findings_of(spark, sf))


@query("capture_scores", "A21 P18", views="scores", sql="""
SELECT c_custkey AS capture_id, coalesce(total, 100) AS total, CASE WHEN coalesce(total, 100) >= 80 THEN 'strong' WHEN total >= 60 THEN 'good'
  WHEN total >= 40 THEN 'fair' WHEN total >= 20 THEN 'poor' ELSE 'critical' END AS rating
FROM customer LEFT JOIN scores ON scores.capture_id = c_custkey""")
def capture_scores(spark, sf):
    c = adapters.table(spark, sf, "customer").select(F.col("c_custkey").alias("capture_id"))
    return scoring.score(findings_of(spark, sf), c).select("capture_id", "total", "rating")


@query("association_scores", "A21 P18", views="findings caps", sql="""
WITH t AS (SELECT pair_id AS capture_id, CAST(greatest(0, 100 - sum(capped)) AS BIGINT) AS total FROM (
    SELECT f.pair_id, f.category, least(sum(f.penalty), any_value(c.cap)) AS capped FROM findings f JOIN caps c USING (category)
    GROUP BY f.pair_id, f.category) GROUP BY pair_id)
SELECT capture_id, total, CASE WHEN total >= 80 THEN 'strong' WHEN total >= 60 THEN 'good' WHEN total >= 40 THEN 'fair'
  WHEN total >= 20 THEN 'poor' ELSE 'critical' END AS rating FROM t""")
def association_scores(spark, sf):
    """Scores with every association as its own capture, so that all bands occur."""
    f = findings_of(spark, sf).withColumn("capture_id", F.col("pair_id"))
    return scoring.score(f).select("capture_id", "total", "rating")


@query("exposure", "A22 A23", views="predictions", sql="""
WITH m AS (SELECT capture_id, avg(probability) AS mean, count(*) AS n FROM predictions GROUP BY capture_id),
l AS (SELECT capture_id, label, min(pair_id * 100 + i) AS pos FROM predictions GROUP BY capture_id, label),
s AS (SELECT capture_id, string_agg(label, ', ' ORDER BY pos) AS labels FROM l GROUP BY capture_id)
SELECT m.capture_id, CAST(round_even(100 * greatest(0, (mean - 1/7.0::DOUBLE) / (1 - 1/7.0::DOUBLE)), 0) AS INTEGER) AS score,
       round(mean, 6) AS mean_classifier_confidence, labels AS identified_classes,
       'identified as ' || labels || ' with mean confidence ' || printf('%.2f', mean) || ' over ' || n || ' windows' AS rationale
FROM m JOIN s USING (capture_id)""")
def exposure(spark, sf):
    e = scoring.exposure(adapters.predictions(adapters.declared_sas(spark, sf)))
    return rounded(e.withColumn("identified_classes", F.concat_ws(", ", "identified_classes")))


@query("association_exposure", "A22 A23", views="predictions", sql="""
WITH m AS (SELECT pair_id AS capture_id, avg(probability) AS mean, count(*) AS n, string_agg(label, ', ' ORDER BY i) AS labels
           FROM predictions GROUP BY pair_id),
e AS (SELECT *, CAST(round_even(100 * greatest(0, (mean - 1/7.0::DOUBLE) / (1 - 1/7.0::DOUBLE)), 0) AS INTEGER) AS score FROM m)
SELECT o_orderkey AS capture_id, coalesce(score, 0) AS score, round(coalesce(mean, 0), 6) AS mean_classifier_confidence,
       coalesce(labels, '') AS identified_classes
FROM orders LEFT JOIN e ON e.capture_id = o_orderkey""")
def association_exposure(spark, sf):
    p = adapters.predictions(adapters.declared_sas(spark, sf)).withColumn("capture_id", F.col("pair_id"))
    c = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("capture_id"))
    e = scoring.exposure(p, c).drop("rationale")
    return rounded(e.withColumn("identified_classes", F.concat_ws(", ", "identified_classes")))


@query("threat_matrix", "A25 J9", views="findings", sql=f"""
WITH x AS (SELECT DISTINCT capture_id, unnest(string_split(techniques, ' ')) AS technique_id, id, sev, penalty FROM findings)
SELECT capture_id, technique_id, CASE technique_id {' '.join(f"WHEN '{t}' THEN '{n}'" for t, (n, _) in dims.TECHNIQUES.items())} END AS technique_name,
       CASE technique_id {' '.join(f"WHEN '{t}' THEN '{','.join(x)}'" for t, (_, x) in dims.TECHNIQUES.items())} END AS tactics,
       string_agg(id, ',' ORDER BY sev, -penalty, id) AS finding_ids, ['critical','high','medium'][min(sev) + 1] AS max_severity
FROM x GROUP BY capture_id, technique_id""")
def threat_matrix(spark, sf):
    t = scoring.threat_matrix(findings_of(spark, sf))
    return t.withColumn("tactics", F.concat_ws(",", "tactics")).withColumn("finding_ids", F.concat_ws(",", "finding_ids"))


@query("severity_counts", "A38", views="findings", sql="""
SELECT capture_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
       count(*) FILTER (severity = 'medium') AS medium, 0 AS low, 0 AS informational FROM findings GROUP BY capture_id""")
def severity_counts(spark, sf):
    return scoring.severity_counts(findings_of(spark, sf))


@query("findings_ordered", "O1 O6", views="findings", sql="""
SELECT capture_id, id, sa_spi, severity, penalty FROM findings ORDER BY capture_id, sev, penalty DESC, id, sa_spi""")
def findings_ordered(spark, sf):
    return scoring.order_findings(findings_of(spark, sf)).select("capture_id", "id", "sa_spi", "severity", "penalty")


@query("findings_by_penalty", "O6 P14", views="findings", sql="""
SELECT capture_id, id, sa_spi, severity, penalty FROM findings WHERE severity IN ('critical', 'high') AND contains(techniques, 'T1557')
ORDER BY penalty DESC, id""")
def findings_by_penalty(spark, sf):
    f = scoring.filter_findings(findings_of(spark, sf), ["critical", "high"], "T1557")
    return scoring.sort_findings(f).select("capture_id", "id", "sa_spi", "severity", "penalty")


@query("top_risks", "O2", views="findings", sql="""
SELECT capture_id, place, id, sa_spi FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY sev, penalty DESC, id, sa_spi) AS place FROM findings) WHERE place <= 3""")
def top_risks(spark, sf):
    return scoring.top_risks(findings_of(spark, sf)).select("capture_id", "place", "id", "sa_spi")


def _long() -> str:
    return " UNION ALL ".join(
        f"SELECT capture_id, pair_id, {i} AS position, '{n}' AS field, '{label}' AS label, "
        f"CASE WHEN {n}_p = 'unavailable' THEN '' ELSE CAST({n}_v AS VARCHAR) END AS value, {n}_p AS provenance FROM declared"
        for i, (n, label, _) in enumerate(dims.PARAMETERS))


sqlviews.view("parameters", "declared", _long())


@query("parameter_rows", "P35", views="parameters", sql="SELECT * FROM parameters")
def parameter_rows(spark, sf):
    r = compare.parameter_rows(adapters.declared_sas(spark, sf)).drop("confidence", "note")
    return r.withColumn("value", F.coalesce("value", F.lit("")))


@query("unavailable_counts", "A38", views="parameters", sql="""
SELECT capture_id, count(*) FILTER (provenance = 'unavailable') AS unavailable, count(*) AS parameters FROM parameters GROUP BY capture_id""")
def unavailable_counts(spark, sf):
    return compare.unavailable_counts(adapters.declared_sas(spark, sf))


sqlviews.view("comparisons", "", "SELECT n_nationkey AS cmp_id, CAST(n_nationkey AS BIGINT) AS a, CAST(49 - n_nationkey AS BIGINT) AS b FROM nation")


@query("attribute_diffs", "J11", views="parameters comparisons", sql="""
WITH f AS (SELECT p.* FROM parameters p JOIN (SELECT capture_id, min(pair_id) AS pair_id FROM parameters GROUP BY capture_id) m USING (capture_id, pair_id)
           WHERE field <> 'observed_rekey_s')
SELECT c.cmp_id, x.field, x.value AS a_value, x.provenance AS a_provenance, y.value AS b_value, y.provenance AS b_provenance,
       NOT (x.value = y.value AND x.provenance = y.provenance) AS changed
FROM comparisons c JOIN f x ON x.capture_id = c.a JOIN f y ON y.capture_id = c.b AND y.field = x.field""")
def attribute_diffs(spark, sf):
    d = compare.attribute_diffs(adapters.declared_sas(spark, sf), adapters.comparisons(spark, sf))
    return d.withColumn("a_value", F.coalesce("a_value", F.lit(""))).withColumn("b_value", F.coalesce("b_value", F.lit("")))


@query("finding_sets", "U1", views="findings", sql="""
WITH c AS (SELECT o_orderkey AS cmp_id, o_orderkey AS a, o_orderkey + 1 AS b FROM orders), s AS (SELECT DISTINCT pair_id, id FROM findings),
a AS (SELECT cmp_id, id FROM c JOIN s ON s.pair_id = a), b AS (SELECT cmp_id, id FROM c JOIN s ON s.pair_id = b)
SELECT cmp_id, id, CASE WHEN b.id IS NULL THEN 'a' WHEN a.id IS NULL THEN 'b' ELSE 'both' END AS found_in FROM a FULL JOIN b USING (cmp_id, id)""")
def finding_sets(spark, sf):
    """Every association as its own capture, compared with the next one."""
    f = findings_of(spark, sf).withColumn("capture_id", F.col("pair_id"))
    c = adapters.table(spark, sf, "orders").selectExpr("o_orderkey AS cmp_id", "o_orderkey AS a", "o_orderkey + 1 AS b")
    return compare.finding_sets(f, c)


@query("score_delta", "J11", views="scores comparisons", sql="""
SELECT cmp_id, c.a, c.b, y.total - x.total AS score_delta FROM comparisons c JOIN scores x ON x.capture_id = c.a JOIN scores y ON y.capture_id = c.b""")
def score_delta(spark, sf):
    return compare.score_delta(scoring.score(findings_of(spark, sf)), adapters.comparisons(spark, sf))


@query("traffic_timeline", "P36", views="predictions", sql="""
SELECT capture_id, pair_id, CAST(floor((start_us + 5000000 - min(start_us) OVER (PARTITION BY capture_id)) / 1000000.0 + 0.5) AS BIGINT) AS t_s, """
       + ", ".join(f"CASE WHEN label = '{c}' THEN probability ELSE -1.0::DOUBLE END AS {c}" for c in dims.TRAFFIC_CLASSES) + " FROM predictions")
def traffic_timeline(spark, sf):
    p = adapters.predictions(adapters.declared_sas(spark, sf)).withColumnsRenamed(
        {"start_us": "window_start_us", "end_us": "window_end_us"})
    t = compare.timeline(p)
    return t.select("capture_id", "pair_id", "t_s", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in dims.TRAFFIC_CLASSES])
